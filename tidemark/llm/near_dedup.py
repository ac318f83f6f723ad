"""MinHash near-deduplication with sequential Bayesian verification.

1. A document's set is the distinct hashes (64 bits) of its word shingles, made by numpy on the bytes of a slice of
   documents; a MinHash signature and its bands come with it.  Documents with equal sets form one class, and only the
   smallest id of a class goes on.
2. Bands: documents that share a band are candidates.  The number of bands follows from the threshold, so that a pair
   right at the threshold shares none with a probability of ``BAND_MISS`` at most.
3. Stars: each document is compared with the ``STARS`` members of its bands that come first, by id and by seeded
   hashes of the id.  Documents of one group meet the same few members there, so most of a group is connected by some
   comparisons a document.
4. Tiles: a band that still holds members of several components (one of those with the same members) is cut into blocks, those of its largest component
   apart from the others, and each pair of blocks but two of the largest component's is a tile.  A tile compares all its pairs of
   different components and returns a spanning forest of the links, so no pair of a band is left out and no pair is a row.
5. A comparison reads the signatures batch by batch and drops the pair once the posterior probability that its
   similarity reaches the threshold is under ``PRUNE_MISS``; the full sets of survivors are compared.
6. Connected components of the links.

In stars the member that many are compared with is sent once for every salt, and the others stream past it.

Which texts, signatures and bands a later step needs is told where they are by Bloom filters of a fixed size at most; what they
let through beside them finds no partner in the joins that follow.  So no text is shuffled but as a set of a candidate.

Cases: null and empty texts and texts of white space have empty sets and link with nothing; fewer words than a shingle
make one; a very long text is one set, however large; rows with the same id are one document, linked if any of them is, and of those that repeat
id and text one row stays; rows with a null id link with nothing and are kept (their component
is null); other columns are carried along whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SALTS, bloom, for_each_salt, materialise, named_apart, read, rows_again, salted, tidy, without
from tidemark.llm.components import components

ROWS, BAND_MISS, PRUNE_MISS, STEP, SEED = 5, 1e-6, 1e-9, 20, 7
STARS, TILE = 3, 384
SLICE = 1 << 20
#: Sets of up to this many shingles are told apart by the shingles themselves, larger ones by all their hashes.
SPELT = 8
U = np.uint64
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
FACTOR = 0x9E3779B97F4A7C15
#: Bytes of a word whose images come from a table; those further on are worked out.
TABLED = 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_images(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit image of each byte at each place of a word."""
    return mixed((place.astype(U) << U(8) | byte.astype(U)) * U(FACTOR) + U(SEED))


IMAGES = byte_images(np.repeat(np.arange(TABLED), 256), np.tile(np.arange(256), TABLED))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each document and the end): words are runs of other bytes than white space.

    A word's hash is the sum of the images of its bytes at their places, which no rule of arithmetic ties together as a polynomial
    would, mixed with its length.
    """
    data = LOWER[data]
    gap = SPACE[data]
    starts, ends = ~gap, ~gap
    starts[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] |= ~gap[edges]
    ends[edges - 1] |= ~gap[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    size = last - first
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    byte = data[~gap]
    image = IMAGES[np.minimum(at, TABLED - 1) << 8 | byte]
    far = np.flatnonzero(at >= TABLED)
    image[far] = byte_images(at[far], byte[far])
    sums = np.concatenate([np.zeros(1, U), np.cumsum(image)])
    end = np.cumsum(size)
    return mixed(sums[end] - sums[end - size] + size.astype(U)), np.searchsorted(first, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    if not len(data):
        return [np.zeros(0, U)] * (len(offsets) - 1)
    words, bounds = word_hashes(data, offsets)
    rolled = words.copy()
    for j in range(1, k):
        rolled = rolled[: len(rolled) - 1] * U(0xD6E8FEB86659FD93) + words[j:] if len(rolled) > 1 else rolled[:0]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif n:
            whole = U(n)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * U(0xA0761D6478BD642F) + w
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, U))
    return out


def sliced_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of (id, body) batches of about ``SLICE`` bytes, with their sets."""
    for batch in batches:
        body = pc.fill_null(batch.column(1), "")
        if isinstance(body, pa.ChunkedArray):
            body = body.combine_chunks()
        wide = pa.types.is_large_string(body.type)
        _, at, data = body.buffers()
        at = np.frombuffer(at, np.int64 if wide else np.int32, len(body) + 1, (8 if wide else 4) * body.offset).astype(np.int64) if len(body) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        start = 0
        while start < len(body):
            stop = max(start + 1, int(np.searchsorted(at, at[start] + SLICE)))
            stop = min(stop, len(body))
            yield batch.slice(start, stop - start), shingle_sets(data[at[start] : at[stop]], at[start : stop + 1] - at[start], k)
            start = stop


def n_bands(threshold: float, rows: int = ROWS, miss: float = BAND_MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The n smallest images of each (not empty) set, the upper 32 bits of them."""
    factors = np.random.default_rng(SEED).integers(1 << 62, size=n, dtype=np.int64).astype(U) * U(2) + U(1)
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    out, image = np.empty((len(sets), n), np.uint32), np.empty_like(every)
    for i, f in enumerate(factors):
        np.multiply(every, f, out=image)
        out[:, i] = np.minimum.reduceat(image, starts) >> U(32)
    return out


def spelt(text: str, k: int) -> bytes:
    """A text's shingles as they are, without repeats and in order."""
    words = text.encode().translate(LOWER.tobytes()).split()
    return b"\0".join(sorted({b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}))


def sketches(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """(id, n_shingles, digest, bands, signature) of (id, body) rows; the last three null for empty sets."""

    def run(batches):
        for part, sets in sliced_sets(batches, k):
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, marks, digests = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                s = signatures([sets[i] for i in full], bands * ROWS)
                key = np.full((len(full), bands), 1, U) * np.arange(1, bands + 1, dtype=U) * U(0x9FB21C651E98DF25)
                for j in range(ROWS):
                    key = mixed(key ^ s[:, j::ROWS].astype(U)) * U(FACTOR)
                short = (s >> np.uint32(16)).astype(np.uint16)
                for row, i in enumerate(full):
                    keys[i], marks[i] = key[row].view(np.int64), short[row].tobytes()
                    told = sets[i].tobytes() if len(sets[i]) > SPELT else spelt(part.column(1)[i].as_py(), k)
                    digests[i] = hashlib.blake2b(told, digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["id", "n_shingles", "digest", "bands", "signature"],
            )

    return docs.mapInArrow(run, "id bigint, n_shingles bigint, digest binary, bands array<bigint>, signature binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, payload): the sets themselves, as bytes."""

    def run(batches):
        for part, sets in sliced_sets(batches, k):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "payload"])

    return docs.mapInArrow(run, "id bigint, payload binary")


def least_matches(n_hashes: int, threshold: float, miss: float = PRUNE_MISS, step: int = STEP) -> list[tuple[int, int]]:
    """(hashes read, matches needed to go on) for each batch of hashes.

    Under a uniform prior, P(similarity >= t | m of n match) is the probability of at most m successes in n + 1 trials of t.
    """
    out = []
    for n in [*range(step, n_hashes, step), n_hashes]:
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def compare(pairs: DataFrame, items: DataFrame, test: Callable[[list[bytes], list[bytes]], np.ndarray]) -> DataFrame:
    """The (a, b) rows of ``pairs`` whose payloads pass ``test(hubs, others)``; ``items`` has (id, payload).

    Rows of one ``a`` come in ``SALTS`` streams, each led by the payload of ``a``; memory has one batch and that payload.
    """
    dealt = salted(pairs, "b", SALTS)
    hubs = dealt.select("a", "__salt").distinct().join(items.withColumnRenamed("id", "a"), "a").select("a", "__salt", F.lit(None).cast("bigint").alias("b"), "payload")
    others = dealt.join(items.withColumnRenamed("id", "b"), "b").select("a", "__salt", "b", "payload")
    stream = hubs.unionByName(others).repartition("a", "__salt").sortWithinPartitions("a", "__salt", F.col("b").asc_nulls_first())

    def run(batches):
        hub, hub_id = None, None
        for batch in batches:
            a, b, payload = (batch.column(c).to_pylist() for c in ("a", "b", "payload"))
            left, right, found = [], [], []
            for x, y, p in zip(a, b, payload, strict=True):
                if y is None:
                    hub, hub_id = p, x
                elif x == hub_id:
                    left.append(hub)
                    right.append(p)
                    found.append((x, y))
            if found:
                good = [f for f, ok in zip(found, test(left, right), strict=True) if ok]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in good], pa.int64()), pa.array([f[1] for f in good], pa.int64())], names=["a", "b"])

    return stream.mapInArrow(run, "a bigint, b bigint")


def by_signature(threshold: float, n_hashes: int) -> Callable:
    needed = least_matches(n_hashes, threshold)

    def test(left: list[bytes], right: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(left), np.uint16).reshape(len(left), -1)
        y = np.frombuffer(b"".join(right), np.uint16).reshape(len(right), -1)
        alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
        for n, least in needed:
            matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(1)
            keep = matches >= least
            alive, matches, done = alive[keep], matches[keep], n
        out = np.zeros(len(left), bool)
        out[alive] = True
        return out

    return test


def by_set(percent: int) -> Callable:
    def test(left: list[bytes], right: list[bytes]) -> np.ndarray:
        out = np.zeros(len(left), bool)
        for i, (p, q) in enumerate(zip(left, right, strict=True)):
            small, large = sorted((len(p) // 8, len(q) // 8))
            if 100 * small >= percent * large:
                x, y = np.frombuffer(p, U), np.frombuffer(q, U)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                out[i] = 100 * both >= percent * (len(x) + len(y) - both)
        return out

    return test


def shared_counts(sets: list[np.ndarray], n_left: int, chunk: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the first ``n_left`` sets with all others, by products of 0/1 matrices.

    Only hashes that two sets have take a column, and columns are made ``chunk`` at a time.
    """
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number = np.cumsum(n > 1) - 1
    shared = n[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n_left, len(sets)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        a, b = np.searchsorted(column, [at, at + chunk])
        m = np.zeros((len(sets), chunk), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m[:n_left] @ m.T
    return out.astype(np.int64)


def tile_links(sets: list[np.ndarray], marks: np.ndarray, component: np.ndarray, n_left: int, same_block: bool, threshold: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, other) of the tile's links between different components."""
    n = np.array([len(s) for s in sets])
    others = np.arange(0 if same_block else n_left, len(sets))
    small, large = np.minimum(n[:n_left, None], n[None, others]), np.maximum(n[:n_left, None], n[None, others])
    may = (component[:n_left, None] != component[None, others]) & (100 * small >= percent * large)
    if same_block:
        may &= np.arange(n_left)[:, None] < others[None, :]
    i, j = np.nonzero(may)
    j = others[j]
    matches, done = np.zeros(len(i), np.int64), 0
    for read, least in least_matches(marks.shape[1], threshold):
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            matches[part] += (marks[i[part], done:read] == marks[j[part], done:read]).sum(1)
        keep = matches >= least
        i, j, matches, done = i[keep], j[keep], matches[keep], read
    if not len(i):
        return i, j
    if len(i) > 2000:
        both = shared_counts(sets, n_left)[i, j]
    else:
        both = np.array([int((sets[x][np.minimum(np.searchsorted(sets[x], sets[y]), n[x] - 1)] == sets[y]).sum()) for x, y in zip(i, j, strict=True)])
    good = 100 * both >= percent * (n[i] + n[j] - both)
    return i[good], j[good]


def tiles(rows: DataFrame, threshold: float, percent: int) -> DataFrame:
    """(a, b): spanning forests of the links of the tiles; rows (band, x, y, side, id, component, signature, payload) sorted by tile."""

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(held)
        side = np.array(whole.column("side").to_pylist(), bool)
        order = np.argsort(side, kind="stable")
        same_block = whole.column("x")[0].as_py() == whole.column("y")[0].as_py()
        ids = np.array(whole.column("id").to_pylist(), np.int64)[order]
        component = np.array(whole.column("component").to_pylist(), np.int64)[order]
        n_left = len(ids) if same_block else int((~side).sum())
        if len(set(component)) < 2 or not n_left or not same_block and n_left == len(ids):
            return None
        payload, signature = whole.column("payload").to_pylist(), whole.column("signature").to_pylist()
        sets = [np.frombuffer(payload[k], U) for k in order]
        marks = np.frombuffer(b"".join(signature[k] for k in order), np.uint16).reshape(len(ids), -1)
        i, j = tile_links(sets, marks, component, n_left, same_block, threshold, percent)
        label = ids.copy()
        while len(i):
            least = label.copy()
            np.minimum.at(least, i, label[j])
            np.minimum.at(least, j, label[i])
            if (least == label).all():
                break
            label = least
        linked = label != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(label[linked])], names=["a", "b"]) if linked.any() else None

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "x", "y")), strict=True))
            start = 0
            for at in range(len(keys) + 1):
                if at == len(keys) or keys[at] != keys[start]:
                    if at > start:
                        if keys[start] != key:
                            if held and (out := answer(held)) is not None:
                                yield out
                            key, held = keys[start], []
                        held.append(batch.slice(start, at - start))
                    start = at
        if held and (out := answer(held)) is not None:
            yield out

    return rows.mapInArrow(run, "a bigint, b bigint")


def once(df: DataFrame, by: list[str], repeats: Callable) -> DataFrame:
    """``df`` without rows that repeat ``by`` (the id first); ``repeats`` may only say no of ids that don't."""
    may = F.coalesce(repeats("id"), F.lit(False))
    return df.filter(~may).unionByName(df.filter(may).dropDuplicates(by))


def repeated_ids(sketched: DataFrame) -> DataFrame:
    """Ids of several rows with the same set."""
    return materialise(sketched.filter("id IS NOT NULL").groupBy("id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("id").distinct())


@tidy
def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, tile: int = TILE, most_bits: int | None = None) -> DataFrame:
    """(id, n_shingles, component, kept) for every row; links: 100 * shared >= percent * all shingles of two documents."""
    threshold = percent / 100
    bands = n_bands(threshold)
    every = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("body"))
    sketched = materialise(sketches(every, words, bands))
    repeats = bloom(repeated_ids(sketched), most_bits)
    known = once(sketched.filter("id IS NOT NULL AND digest IS NOT NULL"), ["id", "digest"], repeats)
    given = once(every.filter("id IS NOT NULL"), ["id", "body"], repeats)

    # Classes of equal sets.
    several = materialise(known.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select("digest", "rep"))
    copies = salted(known.select("id", "digest"), "id", SALTS).join(for_each_salt(several, SALTS), ["digest", "__salt"]).filter("id <> rep").select("id", "digest", "rep")
    copies = materialise(copies)
    reps = without(known.select("id", "digest", "bands"), copies.select("id", "digest"), most_bits)
    # An id with several texts is one document, so its classes are linked.
    texts = known.groupBy("id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1").select("id")
    one = materialise(copies.join(texts, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))

    # Members of the bands that more than one class shares, with each band's first members.
    place = lambda i: F.col("id") if i == 0 else F.xxhash64(F.lit(SEED + i), "id")
    banded = reps.select("id", F.explode("bands").alias("band"))
    firsts = [F.min(F.struct(place(i).alias("at"), F.col("id").alias("a"))).alias(f"first{i}") for i in range(STARS)]
    shared = materialise(banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), *firsts).filter("low < high").drop("low", "high"))
    may_share = bloom(shared.select("band"), most_bits)
    members = salted(banded.filter(may_share("band")), "id", SALTS).join(for_each_salt(shared, SALTS), ["band", "__salt"]).drop("__salt")
    members = materialise(members)

    def needed(items: DataFrame, ids: DataFrame) -> DataFrame:
        """``items`` of these ids, and some others, which what follows joins away."""
        return items.filter(bloom(ids, most_bits)("id"))

    # Stars: of all its bands' first members, a document is compared with the very first, for each of the orders.
    first = members.groupBy("id").agg(*(F.min(f"first{i}").alias(f"first{i}") for i in range(STARS)))
    pairs = materialise(first.select(F.col("id").alias("b"), F.explode(F.array_distinct(F.array(*(f"first{i}.a" for i in range(STARS))))).alias("a")).filter("a <> b"))
    signed = needed(known.select("id", "signature"), members.select("id"))
    likely = materialise(compare(pairs, signed.select("id", F.col("signature").alias("payload")), by_signature(threshold, bands * ROWS)))
    ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
    found = materialise(compare(likely, full_sets(needed(given, ends), words), by_set(percent)).unionByName(one))
    grouped = materialise(components(found))

    # Tiles: bands with several components, the largest one's members in blocks of their own.
    at = materialise(members.select("band", "id").join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id")))
    # Bands with the same members (told by their number and two sums of hashes) need one look.
    marks = [F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("m0"), F.bit_xor(F.xxhash64(F.lit(2), "id")).alias("m1")]
    parts = at.groupBy("band", "component").agg(F.count("*").alias("n"), *marks)
    every = [F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("m0").cast("decimal(38,0)")).alias("m0"), F.bit_xor("m1").alias("m1"), F.max(F.struct("n", "component")).alias("most")]
    open_ = parts.groupBy("band").agg(*every).filter("parts > 1").groupBy("n", "m0", "m1").agg(F.min("band").alias("band"), F.first("most").alias("most"))
    blocks = lambda n: F.ceil(n / tile).cast("int")
    open_ = materialise(open_.select("band", F.col("most.component").alias("largest"), blocks(F.col("n") - F.col("most.n")).alias("small"), blocks(F.col("most.n")).alias("large")))
    apart = salted(at, "id", SALTS).join(for_each_salt(open_, SALTS), ["band", "__salt"]).drop("__salt")
    apart = apart.withColumn("outside", F.col("component") != F.col("largest"))
    apart = apart.withColumn("own", F.pmod(F.xxhash64(F.lit(SEED), "id", "band"), F.when(F.col("outside"), F.col("small")).otherwise(F.col("large"))).cast("int"))
    cell = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.alias("side"))
    among = F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda j: cell(F.least("own", j), F.greatest("own", j), F.col("own") > j))
    against = F.transform(F.sequence(F.lit(0), F.col("large") - 1), lambda j: cell(F.col("own"), F.col("small") + j, F.lit(False)))
    inside = F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda i: cell(i, F.col("small") + F.col("own"), F.lit(True)))
    apart = materialise(apart.withColumn("cell", F.explode(F.when(F.col("outside"), F.concat(among, against)).otherwise(inside))).select("band", "cell.*", "id", "component"))
    sets = full_sets(needed(given, apart.select("id")), words).join(signed, "id")
    dealt = apart.join(sets, "id").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    more = materialise(tiles(dealt, threshold, percent))
    grouped = materialise(components(found.unionByName(more)))

    # Back to all rows: from a copy to its class, from the class to its component.
    of_copies = salted(copies, "id", SALTS).join(for_each_salt(grouped.select(F.col("id").alias("rep"), "component"), SALTS), ["rep", "__salt"], "left")
    settled = of_copies.select("id", F.coalesce("component", "rep").alias("component")).unionByName(grouped.select("id", "component"))
    settled = settled.groupBy("id").agg(F.min("component").alias("component"))
    sizes = sketched.select("id", "n_shingles")
    out = sizes.filter("id IS NOT NULL").join(settled, "id", "left").unionByName(sizes.filter("id IS NULL").withColumn("component", F.lit(None).cast("bigint")))
    component = F.coalesce("component", "id")
    return out.select("id", "n_shingles", component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


@tidy
def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, most_bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all columns, and one row of each id and text."""
    groups = near_groups(docs, id_col, text_col, words, percent, most_bits=most_bits)
    gone = groups.filter("id IS NOT NULL AND NOT kept").select(F.col("id").alias("__gone"))
    repeats = bloom(materialise(groups.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")), most_bits)
    id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = without(named_apart(docs, __gone=id.cast("bigint"), __text=text), gone, most_bits)
    others = [F.col("row").getField(c) for c in docs.columns if c not in (id_col, text_col)]
    may = F.coalesce(repeats("__gone"), F.lit(False))
    first = F.min_by("row", F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(others)))) if others else F.lit("")).alias("row")
    single = rows.filter(may).groupBy("__gone", "__text").agg(first)
    return rows_again(rows.filter(~may).select("row").unionByName(single.select("row")), docs)


def op6_minhash_dedup(spark, sf_dir):
    out = near_groups(read(spark, sf_dir, "documents"), words=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
