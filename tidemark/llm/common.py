"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A Bloom filter has 16 to 32 bits a key, and never more than this many bits (16 MB) whatever the number of keys.
BLOOM_BITS, BLOOM_HASHES = 1 << 27, 4
SALTS = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or its checkpoint folder; a temporary folder only where the master is local."""
    global _own_folder
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        return given
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    return f"file://{_own_folder}"


_own_folder = ""
#: Paths written by the operator that is running in this thread (or task of an event loop), which no other one sees.
_frame: ContextVar[list[str] | None] = ContextVar("tidemark-written", default=None)
#: Paths of files that go once no plan reads the table that they belong to: a weak reference to its file index.
_kept: dict[str, object] = {}
_lock = threading.Lock()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it from there, which cuts its lineage.

    Every executor can read the files, so a lost one loses nothing; and their sizes are known, where a checkpoint
    in a loop would carry on estimates that square each round.  The folder goes when the operator is done if its result
    doesn't read it; else some time after the last DataFrame that reads it is gone (see :func:`sweep`), at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    frame = _frame.get()
    if frame is not None:
        frame.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    keep_with(table, path)
    return table


def keep_with(table: DataFrame, path: str) -> None:
    """Keep the files at ``path`` for as long as any plan reads ``table``, which :func:`materialise` made."""
    spark = table.sparkSession
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    leaf = table._jdf.queryExecution().analyzed().collectLeaves().head()
    if leaf.nodeName().startswith("LogicalRelation"):
        held = spark.sparkContext._jvm.java.lang.ref.WeakReference(leaf.relation().location())
        with _lock:
            _kept[path] = held


def sweep(spark: SparkSession) -> int:
    """Delete the tables that no plan reads any more, as far as the JVM has collected their plans; the number of tables left."""
    with _lock:
        gone = [path for path, held in _kept.items() if held.refersTo(None)]
        for path in gone:
            del _kept[path]
    for path in gone:
        _drop(spark, path)
    return len(_kept)


def _place(spark: SparkSession, path: str):
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(sc._jsc.hadoopConfiguration())


def _drop(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)
    with _lock:
        _kept.pop(path, None)


def _read_by(df: DataFrame) -> str:
    """The roots of the files that a plan and its subqueries read, as one text."""
    plan = df._jdf.queryExecution().analyzed()
    plans = [plan, *(plan.subqueriesAll().apply(i) for i in range(plan.subqueriesAll().size()))]
    roots = []
    for p in plans:
        leaves = p.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.nodeName().startswith("LogicalRelation") and hasattr(leaf.relation(), "location"):
                roots.append(leaf.relation().location().rootPaths().mkString("\n"))
    return "\n".join(roots)


def tidy(operator: Callable) -> Callable:
    """Drop an operator's intermediate tables that its result (a DataFrame or a tuple of them) doesn't read, or all if it fails.

    Operators may run side by side: each knows only the tables written in its own context.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs):
        outer = _frame.get()
        paths: list[str] = []
        token = _frame.set(paths)
        try:
            out = operator(*args, **kwargs)
        except BaseException:
            spark = SparkSession.getActiveSession()
            for path in paths if spark else ():
                _drop(spark, path)
            raise
        finally:
            _frame.reset(token)
        results = out if isinstance(out, tuple) else (out,)
        spark = results[0].sparkSession
        used = "\n".join(map(_read_by, results)) if paths else ""
        for path in paths:
            if path.rsplit("/", 1)[1] in used:
                if outer is not None:
                    outer.append(path)
            else:
                _drop(spark, path)
        if outer is None:
            sweep(spark)
        return out

    return run


def _positions(columns: list[Column], bits: int) -> list[Column]:
    return [F.xxhash64(F.lit(i), *columns).bitwiseAND(F.lit(bits - 1)) for i in range(BLOOM_HASHES)]


def bloom(keys: DataFrame, most_bits: int | None = None) -> Callable[..., Column]:
    """A test for rows that may have one of ``keys`` (all its columns): true for every key, and for one other in 400 or fewer
    while the bits are in proportion to the keys.

    The filter is made by aggregates and has a fixed size at most, so it goes to the tasks as a scalar.  Beyond
    the keys that fit it lets more and more other rows through; what uses it must be right for any of them.  Keys may repeat;
    they are read again by each action that tests, so they should be a table.
    """
    n = keys.agg(F.approx_count_distinct(F.xxhash64(*keys.columns))).first()[0]
    if not n:
        return lambda *columns: F.lit(False)
    bits = min(BLOOM_BITS if most_bits is None else most_bits, 1 << (16 * max(n, 64) - 1).bit_length())
    spark, one = keys.sparkSession, F.lit(1).cast("long")
    at = keys.select(F.explode(F.array(*_positions([F.col(c) for c in keys.columns], bits))).alias("at"))
    bit = F.call_function("shiftleft", one, F.col("at").bitwiseAND(63).cast("int"))
    empty = spark.range(max(1, bits >> 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = at.select(F.shiftrightunsigned("at", 6).alias("word"), bit.alias("bit")).unionByName(empty).groupBy("word").agg(F.bit_or("bit").alias("set"))
    in_order = lambda place, what: F.transform(F.array_sort(F.collect_list(F.struct(place, what))), lambda x: x[what]).alias(what)
    rows = words.groupBy(F.shiftright("word", 10).alias("row")).agg(in_order("word", "set"))
    filter_ = rows.agg(in_order("row", "set")).scalar()

    def may_have(*columns: str | Column) -> Column:
        found = F.lit(True)
        for at in _positions([F.col(c) if isinstance(c, str) else c for c in columns], bits):
            word = F.get(F.get(filter_, F.shiftrightunsigned(at, 16).cast("int")), F.shiftrightunsigned(at, 6).bitwiseAND(1023).cast("int"))
            found = found & (F.getbit(word, at.bitwiseAND(63).cast("int")) == 1)
        return found

    return may_have


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row; the optimizer would copy a projected expression into each filter on it."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def named_apart(df: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` and all columns of ``df`` as one struct ``row``, so that no names clash; see :func:`rows_again`."""
    return df.select(*(c.alias(n) for n, c in columns.items()), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def rows_again(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col("row").getField(c).alias(c) for c in like.columns))


def without(df: DataFrame, gone: DataFrame, most_bits: int | None = None) -> DataFrame:
    """The rows of ``df`` whose values of all columns of ``gone`` aren't one of its rows; rows with a null among them stay.

    Two Bloom filters settle nearly all rows where they are: what the first, of ``gone``, rules out stays; of the others, what the
    second rules out, of the keys that aren't in ``gone`` but get through the first, goes.  Only the rest is compared
    with ``gone`` itself.
    """
    keys = gone.columns
    gone = materialise(gone.distinct())
    first = bloom(gone, most_bits)
    here = F.lit(True)
    for c in keys:
        here = here & F.col(c).isNotNull()
    suspect = here & first(*keys)
    passed = df.select(*keys).filter(suspect).distinct().join(gone, keys, "left_anti")
    second = bloom(materialise(passed), most_bits)
    return df.filter(~suspect).unionByName(df.filter(suspect & second(*keys)).join(gone, keys, "left_anti").select(*df.columns))


def salted(df: DataFrame, key: str, salts: int) -> DataFrame:
    """Add ``__salt`` from ``key``, so that the rows of one hot join key go to ``salts`` tasks."""
    return df.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))


def for_each_salt(df: DataFrame, salts: int) -> DataFrame:
    """The other side of :func:`salted`: each row once for every salt.

    Unpivoting makes an Expand, whose size estimate counts the copies; an explode's estimate is that of one copy, and Spark would
    broadcast a table whose copies are far over the threshold.
    """
    each = [f"__s{i}" for i in range(salts)]
    wide = df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(each)))
    return wide.unpivot(df.columns, each, "__of", "__salt").drop("__of")
