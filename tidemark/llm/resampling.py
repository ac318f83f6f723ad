"""Importance resampling of documents towards a target corpus, over hashed n-grams.

1. Words and n-grams.  A task keeps an integer dictionary of its distinct words; an n-gram is the tuple of the ids, numbered through its first
   n-1 words' number and the last word's, so each distinct tuple is one key.  The bytes of a distinct tuple are put together and hashed
   once, whatever its count, and the bucket is joined back to all its occurrences by number.  A dictionary lives as long as a Python worker and
   starts anew past ``KNOWN`` entries or ``KNOWN_BYTES`` bytes, so no word is shuffled and memory doesn't grow with the corpus.
2. Counts.  The buckets of every document are written once; each task sums its documents to one histogram, and the histograms
   are summed by bucket, for the corpus and for the target.
3. Weights.  The gain of each bucket (``buckets`` numbers, whatever the input) goes to all tasks; a document's weight is the sum
   of its buckets' gains.
4. Draw.  Gumbel noise from a hash of the id makes the top scores a draw without replacement.  Scores are laid out in
   order over range partitions; a row's rank is its place in its partition plus the rows of the partitions before (one count each).

Cases: a null text has no words; a document without words has weight 0; a null id is hashed as ``null``; repeated rows are scored and
ranked each on their own, in any order among themselves; ties in score go to the smaller id (null last); a very long text takes memory in
proportion to its words; other columns are ignored, whatever their names; without documents or target texts the counts are 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import slices
from tidemark.llm.branch_merge import CRC_SQL, crc_sql
from tidemark.llm.common import materialise, read, tidy

MAX_N, BUCKETS, MIN_WORDS, PERCENT, SEED, SCALE = 1, 10_000, 20, 10, 2024, 1000
KNOWN, KNOWN_BYTES = 1 << 21, 1 << 26
#: A-Z to lower case; digits, a-z and all bytes beyond ASCII are parts of words, the other bytes part them.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLDED).split() if text else []


class Numbers(dict):
    """Numbers for keys in the order in which they are first asked for; ``fresh``: the keys that aren't hashed yet."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n

    def taken(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh


class Features:
    """Buckets of n-grams, by an integer dictionary of words and of tuples."""

    def __init__(self, max_n: int, buckets: int):
        self.max_n, self.buckets = max_n, buckets
        self.words = Numbers()
        # Of n-grams by n: (number of the first n-1 words << 32 | number of the last) to its number; a word's number is its own.
        self.tuples: list[Numbers] = [Numbers() for _ in range(max_n - 1)]
        self.hashed: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(max_n)]
        self.known_words: list[bytes] = []
        self.spelt: list[list[tuple[int, ...]]] = [[] for _ in range(max_n - 1)]
        self.held = 0

    def hash_new(self, n: int) -> None:
        """Hash the tuples of ``n`` + 1 words that have no bucket yet."""
        if not n:
            fresh = self.words.taken()
            self.known_words += fresh
            self.held += sum(map(len, fresh))
            found = [zlib.crc32(w) % self.buckets for w in fresh]
        else:
            found = []
            for key in self.tuples[n - 1].taken():
                first, last = key >> 32, key & 0xFFFFFFFF
                ids = (*(self.spelt[n - 2][first] if n > 1 else (first,)), last)
                self.spelt[n - 1].append(ids)
                found.append(zlib.crc32(b" ".join(map(self.known_words.__getitem__, ids))) % self.buckets)
        if found:
            self.hashed[n] = np.concatenate([self.hashed[n], np.array(found, np.int64)])

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, features of each text, buckets of all features in the texts' order)."""
        if self.held > KNOWN_BYTES or len(self.words) + sum(map(len, self.tuples)) > KNOWN:
            self.__init__(self.max_n, self.buckets)
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        number = self.words.__getitem__
        ids = np.fromiter((i for w in split for i in map(number, w)), np.int64, int(sizes.sum()))
        self.hash_new(0)
        document = np.repeat(np.arange(len(texts)), sizes)
        found, owners, grams = [self.hashed[0][ids]], [document], ids
        for n in range(1, self.max_n):
            whole = document[n:] == document[:-n] if n < len(ids) else np.zeros(0, bool)
            # An n-gram that would cross into the next document has number -1.
            before = grams[: len(whole)]
            keys = before << 32 | ids[n : n + len(whole)]
            distinct, back = np.unique(keys[whole], return_inverse=True)
            known = np.fromiter(map(self.tuples[n - 1].__getitem__, distinct.tolist()), np.int64, len(distinct))
            self.hash_new(n)
            grams = np.full(len(whole), -1, np.int64)
            grams[whole] = known[back]
            found.append(self.hashed[n][grams[whole]])
            owners.append(document[: len(whole)][whole])
        if self.max_n > 1:
            owner = np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            return sizes, np.bincount(owner, minlength=len(texts)), np.concatenate(found)[order]
        return sizes, sizes, found[0]


#: One dictionary for each kind of features in a Python worker, so that the worker's next task knows the words of its last.
KEPT: dict[tuple[int, int], Features] = {}


def kept_features(max_n: int, buckets: int) -> Features:
    return KEPT.get((max_n, buckets)) or KEPT.setdefault((max_n, buckets), Features(max_n, buckets))


def width(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucketed(docs: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets) of (id, body): the buckets as little-endian integers one after another."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        features, wide = kept_features(max_n, buckets), width(buckets)
        for part in slices(batches):
            words, sizes, found = features.of(part.column(1).to_pylist())
            data = found.astype(wide).tobytes()
            ends = (np.cumsum(sizes) * wide.itemsize).tolist()
            pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pieces, pa.binary())], names=["id", "n_words", "n_features", "buckets"])

    return docs.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, buckets binary")


def flat(column: pa.Array, wide: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sizes, numbers) of a column of little-endian integers, some MB at a time."""
    for value in range(0, len(column), 4096):
        part = [x or b"" for x in column[value : value + 4096].to_pylist()]
        yield np.array([len(x) // wide.itemsize for x in part], np.int64), np.frombuffer(b"".join(part), wide)


def histogram(table: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows, only buckets that occur: one histogram a task, then summed."""

    def run(batches):
        total, wide = np.zeros(buckets, np.int64), width(buckets)
        for batch in batches:
            for _, numbers in flat(batch.column(0), wide):
                total += np.bincount(numbers, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return table.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int, scale: int = SCALE) -> np.ndarray:
    s_all, t_all = sum(corpus.values()), sum(target.values())
    ratio = lambda b: float((target.get(b, 0) + 1) * (s_all + buckets)) / float((corpus.get(b, 0) + 1) * (t_all + buckets))
    return np.array([math.floor(scale * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weighed(table: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    """(id, n_words, n_features, weight): ``gain`` has one number a bucket, so what goes to the tasks has a fixed size."""
    kind = table.schema["id"].dataType.simpleString()
    shared = table.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        each, wide = shared.value, width(buckets)
        for batch in batches:
            sums = [np.zeros(0, np.int64)]
            for sizes, numbers in flat(batch.column(3), wide):
                total = np.concatenate([[0], np.cumsum(each[numbers])])
                ends = np.cumsum(sizes)
                sums.append(total[ends] - total[ends - sizes])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(sums), pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return table.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(id: Column, seed: int, scale: int = SCALE) -> Column:
    """Gumbel noise from the first 32 bits of the SHA-256 of ``seed:id``."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("null"))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``rank`` (1, 2, ...) by ``order`` over all rows, however many.

    Rows are laid out over range partitions and numbered where they are; only the partitions' counts, one row each, are summed up
    in one task.  The rows' place in the input spreads ties, so that a key with many rows doesn't fill one partition.
    """
    given = df.withColumn("__place", F.monotonically_increasing_id())
    laid = given.repartitionByRange(*order, F.col("__place")).sortWithinPartitions(*order, F.col("__place"))
    laid = materialise(laid.withColumn("__at", F.monotonically_increasing_id()).drop("__place"))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = laid.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return laid.withColumns({"__part": part, "__inside": inside}).join(starts, "__part").withColumn("rank", F.col("__start") + F.col("__inside") + 1).drop("__part", "__inside", "__at", "__start")


@tidy
def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank`` is null where it isn't drawn."""
    body = lambda df, c: F.col(f"`{c}`").cast("string").alias("body")
    table = materialise(bucketed(docs.select(F.col(f"`{id_col}`").alias("id"), body(docs, text_col)), max_n, buckets))
    aims = bucketed(target.select(F.lit(0).alias("id"), body(target, target_col)), max_n, buckets)
    # At most one row a bucket, so their number is a parameter's, not the input's.
    corpus, wanted = ({r.bucket: r.n for r in histogram(t, buckets).collect()} for t in (table, aims))
    scored = materialise(weighed(table, gains(corpus, wanted, buckets), buckets).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    fit = F.col("n_words") >= min_words
    drawn = scored.filter(fit).count() * percent // 100
    ranks = ranked(scored.filter(fit), [F.col("score").desc(), F.col("id").asc_nulls_last()])
    none = F.lit(None).cast("long")
    return ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long"))).unionByName(scored.filter(~fit).withColumn("rank", none))


def op11_resampling(spark, sf_dir):
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP11_SQL = rf"""
WITH {CRC_SQL},
words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
aims AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
hashed AS (SELECT w, {crc_sql("w")} % 10000 AS b FROM (SELECT w FROM words UNION SELECT w FROM aims), crc_table),
s AS (SELECT b, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM aims JOIN hashed USING (w) GROUP BY b),
g AS (
  SELECT i AS b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0)::BIGINT FROM s) + 10000))::DOUBLE / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0)::BIGINT FROM t) + 10000))::DOUBLE))::BIGINT AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i),
f AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN g USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN f USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (doc_id)
"""
