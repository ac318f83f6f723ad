"""Embedding near-deduplication by int8 tile products with error bounds.

1. Equal vectors form one class that is compared once; a class's size counts in its neighbours' links.
2. Candidates: each vector falls into one bucket of each of ``tables`` hash tables, by the signs of its products with
   ``bits`` random directions.  ``bits`` grows with the logarithm of the number of vectors, and ``tables`` follows from it so that a
   pair right at the threshold shares no bucket with a probability of ``MISS`` at most (closer pairs with less).
3. A bucket is cut into blocks of about ``TILE`` vectors, and each pair of blocks is a tile of its own, so no bucket has
   to fit into one task.
4. Each vector is quantised to int8 once, and only that form goes to the tiles.  Its quantisation error e is known exactly; with
   |x| = 1 the product of two is off by at most ex + ey + ex ey.  Pairs that the bounds put at or above the threshold
   link, those that they put below it don't.
5. Vectors with pairs that the bounds leave open go once more to the tiles where that is so, now as given, and just these pairs
   are computed in double precision.  No pairs are written, so this is never more than the vectors of those tiles.
6. A pair counts in the first table where both share a bucket.  A tile returns for each vector how many it linked with, and a
   spanning forest of its links instead of the links.

Cases: null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of different
lengths don't link; labels aren't read; repeated ids each count; rows with a null id link with nothing; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import for_each_salt, materialise, read, salted, tidy
from tidemark.llm.components import components

THRESHOLD, MISS, TILE, SEED, SALTS = 0.95, 1e-7, 512, 11, 16


def hash_shape(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors: buckets of some ``TILE`` vectors, and so many tables that ``miss`` holds."""
    bits = max(4, math.ceil(math.log2(max(n, 2) / TILE)))
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    return bits, math.ceil(math.log(miss) / math.log(1 - same**bits))


def directions(dims: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, bits * tables)).astype(np.float32)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scales, errors) of unit vectors; an error bounds the length of x - scale * vector from above."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - scale[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12


def rows_of(values: list[bytes], kind) -> np.ndarray:
    """Byte strings of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def packed(given: DataFrame, wide: bool) -> DataFrame:
    """(id, raw) of the vectors that can link: their components as bytes."""
    kind = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            ids, raws = [], []
            for id_, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values if v.is_valid else None
                if id_ is None or v is None or not len(v) or v.null_count:
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(kind)
                with np.errstate(over="ignore"):
                    size = np.linalg.norm(x.astype(np.float64))
                if np.isfinite(x).all() and 0 < size < np.inf:
                    ids.append(id_)
                    raws.append((x + kind(0)).tobytes())  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], names=["id", "raw"])

    return given.mapInArrow(run, "id bigint, raw binary")


def bucketed(classes: DataFrame, wide: bool, bits: int, tables: int) -> DataFrame:
    """(id, n, raw, q, scale, error, codes, marks): quantised vectors, and the bucket of every table, as numbers with the
    dimension and as bytes without it."""
    kind = mark_kind(bits)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                raw = part.column("raw").to_pylist()
                made = [None] * len(raw)
                for size in {len(r) for r in raw}:
                    here = [i for i, r in enumerate(raw) if len(r) == size]
                    x = rows_of([raw[i] for i in here], np.float64 if wide else np.float32).astype(np.float64)
                    dims = x.shape[1]
                    if dims not in planes:
                        planes[dims] = directions(dims, bits, tables)
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    code = (x.astype(np.float32) @ planes[dims] > 0).reshape(len(here), tables, bits) @ weights
                    for i, q, scale, error, c in zip(here, *quantised(x), code, strict=True):
                        made[i] = (q.tobytes(), scale, error, c + (dims << 40), c.astype(kind).tobytes())
                columns = [part.column(c) for c in ("id", "n", "raw")]
                columns += [pa.array(values, t) for values, t in zip(zip(*made, strict=True), (pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "raw", "q", "scale", "error", "codes", "marks"])

    return classes.mapInArrow(run, "id bigint, n bigint, raw binary, q binary, scale double, error double, codes array<bigint>, marks binary")


def mark_kind(bits: int):
    """The smallest type that holds a bucket's number."""
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.int32


def bounds(a: dict, b: dict, threshold: float) -> tuple[np.ndarray, ...]:
    """Index pairs whose cosine may reach the threshold, and what it is at least and at most, from int8 products.

    Sums of up to 1024 products are exact in float32 and all else is symmetric, so a pair has the same bounds in any tile.
    """
    dots = np.zeros((len(a["q"]), len(b["q"])), np.float64 if a["q"].shape[1] > 1024 else np.float32)
    for at in range(0, a["q"].shape[1], 1024):
        dots += a["q"][:, at : at + 1024].astype(np.float32) @ b["q"][:, at : at + 1024].astype(np.float32).T
    # First by the largest errors of the tile, in single precision with room for its rounding; then by those of each pair.
    rough = dots * a["scale"][:, None].astype(np.float32)
    rough *= b["scale"][None, :].astype(np.float32)
    ea, eb = a["error"].max(), b["error"].max()
    i, j = np.nonzero(rough >= np.float32(threshold - (ea + eb + ea * eb) - 1e-5))
    ea, eb = a["error"][i], b["error"][j]
    value, off = dots[i, j] * (a["scale"][i] * b["scale"][j]), (ea + eb) + ea * eb + 1e-9
    some = value + off >= threshold
    return i[some], j[some], (value - off)[some], (value + off)[some]


def tile_pairs(a: dict, b: dict | None, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of a tile that no earlier table has seen and that may link, and whether they surely do; ``b`` is None for a
    block with itself."""
    other = a if b is None else b
    i, j, low, _ = bounds(a, other, threshold)
    if b is None:
        once = i < j
        i, j, low = i[once], j[once], low[once]
    new = [np.zeros(0, bool)]
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        new.append(~(a["marks"][x, :table] == other["marks"][y, :table]).any(1))
    new = np.concatenate(new)
    return i[new], j[new], low[new] >= threshold


def confirmed(a: dict, b: dict | None, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that link, in double precision."""
    other = a if b is None else b
    keep = [np.zeros(0, bool)]
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        cosine = np.einsum("ij,ij->i", a["raw"][x], other["raw"][y]) / (a["norm"][x] * other["norm"][y])
        keep.append(cosine >= threshold)
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest id among those it is linked with, directly or through others of the tile."""
    label = ids.copy()
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        if (least == label).all():
            return label
        label = least


TILE_KEY = ("table", "code", "x", "y")
FOUND = "id bigint, links bigint, root bigint, table int, code bigint, x int, y int, side int"


def tiles(rows: DataFrame, bits: int, threshold: float, exact: str | None = None) -> DataFrame:
    """FOUND from rows of tiles: (table, code, x, y, side, id, n, q, scale, error, marks and, if ``exact``, raw).

    A row has the links and the root of a vector, or, if a table, stands for a vector with open pairs in that tile.  With
    ``exact``, the type of the components in ``raw``, only open pairs are looked at, and none stays open.
    """

    def block(part: pa.Table) -> dict:
        out = {c: part.column(c).to_numpy() for c in ("id", "n", "scale", "error")}
        out |= {"q": rows_of(part.column("q").to_pylist(), np.int8), "marks": rows_of(part.column("marks").to_pylist(), mark_kind(bits))}
        if exact:
            out["raw"] = rows_of(part.column("raw").to_pylist(), exact).astype(np.float64)
            out["norm"] = np.linalg.norm(out["raw"], axis=1)
        return out

    def answer(key: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(held)
        side = whole.column("side").to_numpy()
        parts = [np.flatnonzero(side == s) for s in (0, 1)]
        if not len(parts[0]) or key[2] != key[3] and not len(parts[1]):
            return None
        a, b = (block(whole.take(p)) if len(p) else None for p in parts)
        i, j, sure = tile_pairs(a, b, key[0], threshold)
        if not len(i):
            return None
        ids, n = (a["id"], a["n"]) if b is None else (np.concatenate([a["id"], b["id"]]), np.concatenate([a["n"], b["n"]]))
        shift = 0 if b is None else len(a["id"])
        open_ = np.zeros(len(ids), bool)
        if exact:
            i, j = confirmed(a, b, i[~sure], j[~sure], threshold)
        else:
            open_[i[~sure]] = open_[j[~sure] + shift] = True
            i, j = i[sure], j[sure]
        j = j + shift
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        some = links > 0
        linked, left = int(some.sum()), int(open_.sum())
        columns = [np.concatenate([ids[some], ids[open_]]), [*links[some].tolist(), *[None] * left], [*forest(len(ids), i, j, ids)[some].tolist(), *[None] * left]]
        columns += [[None] * linked + [k] * left for k in key] + [[None] * linked + [int(k >= shift and b is not None) for k in np.flatnonzero(open_)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.int32(), pa.int64()] + [pa.int32()] * 3, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in TILE_KEY], 1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if tuple(keys[s]) != key:
                    if held and (out := answer(key, held)) is not None:
                        yield out
                    key, held = tuple(int(k) for k in keys[s]), []
                held.append(batch.slice(s, e - s))
        if held and (out := answer(key, held)) is not None:
            yield out

    return rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY).mapInArrow(run, FOUND)


@tidy
def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, n_links, component, kept) for every row of ``vectors``."""
    wide = vectors.schema[vector_col].dataType.elementType.simpleString() == "double"
    given = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>" if wide else "array<float>").alias("v"))
    sound = materialise(packed(given, wide))
    classes = materialise(sound.groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "raw"))
    bits, tables = hash_shape(classes.count(), threshold)
    vectors_in = materialise(bucketed(classes, wide, bits, tables))

    keyed = vectors_in.select("id", F.posexplode("codes").alias("table", "code"))
    sizes = keyed.groupBy("table", "code").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = sizes.select("table", "code", F.ceil(F.col("size") / tile).cast("int").alias("blocks"))
    # Only keys meet the sizes; the quantised vectors come to them by their ids.
    placed = salted(keyed, "id", SALTS).join(for_each_salt(sizes, SALTS), ["table", "code", "__salt"]).drop("__salt")
    own = F.pmod(F.xxhash64(F.lit(SEED), "id", "table"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "table", "code", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    light = vectors_in.select("id", "n", "q", "scale", "error", "marks")
    first = materialise(tiles(dealt.join(light, "id"), bits, threshold))
    left_open = first.filter("table is not null").select("id", *TILE_KEY, "side")
    second = materialise(tiles(left_open.join(vectors_in.drop("codes"), "id"), bits, threshold, "f8" if wide else "f4"))
    found = first.unionByName(second).filter("table is null").select("id", "links", "root")

    grouped = components(found.filter("id <> root"), "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "id", "left").join(grouped, "id", "left")
    of_class = of_class.select("raw", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"), "n")
    # Copies find their class by their bytes; single vectors, by their id.
    several = for_each_salt(of_class.filter("n > 1").select("raw", "n_links", "component"), SALTS)
    copies = salted(sound, "id", SALTS).join(several, ["raw", "__salt"]).select("id", "n_links", "component")
    settled = copies.unionByName(of_class.filter("n = 1").select(F.col("rep").alias("id"), "n_links", "component"))
    settled = settled.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = given.select("id").join(settled, "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def op2_embedding_dedup(spark, sf_dir):
    out = vector_groups(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
