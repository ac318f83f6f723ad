"""Token ids in files of independent zstandard frames that can be read one document at a time.

A file (a shard) is a row of zstandard frames, each compressed on its own with the checksum of its content, then a seek table in a
skippable frame, so any zstandard tool decompresses the whole file and a reader finds a frame without reading those before it:

* data frames: token ids as little-endian integers (of 2 bytes if all ids of the vocabulary fit, else of 4), ``FRAME`` of them or fewer.  A frame
  ends where the next document would not fit; a document longer than a frame takes frames of its own.
* one index frame: the documents' ids and numbers of tokens, as an Arrow stream.
* the seek table, in the layout of the public seekable format: for each frame the compressed and the decompressed size and the lower half of the
  XXH64 of its content, then the number of frames, a byte of flags and the magic number.  Reading starts at its end.

Writing: texts are laid over range partitions in ascending order of their ids, and each task encodes its texts and streams them into one
file, a frame at a time.  A file's name has a part of its own for each attempt, and only the files of attempts that Spark counts are
in the manifest (one row a file), so a task that runs twice leaves no trace in the result.  Files are written and read by the tasks
through Arrow's file systems, in the folder that all executors share.

Encoding is the library's.  No word of the vocabulary holds white space, so a text's ids are those of its runs between white space (ASCII);
a Python worker keeps the ids of two generations of runs, each of up to ``KNOWN`` of them or ``KNOWN_BYTES`` characters.

Cases: a null text is empty and has the end id only; null ids come first; rows with the same id follow each other in the order of a hash of their
texts, equal rows in any order; a very long text is one document in several frames; other columns are ignored, whatever their names; an
empty table gives no file and an empty result.
"""

from __future__ import annotations

import os
import string
import struct
import sys
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_symbols, slices, vocabulary
from tidemark.llm.common import keep_with, materialise, read, shared_folder, tidy

END, FRAME, LEVEL = 1, 1 << 18, 3
KNOWN, KNOWN_BYTES = 700_000, 1 << 26
#: Bytes of texts that are encoded together, and runs whose ids are laid out at once.
SLICE, GATHERED = 1 << 24, 1 << 20
PUNCTUATION = string.punctuation
#: Magic numbers and the flag "has checksums" of the seekable format: fixed values.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: One encoder for each vocabulary in a Python worker.
ENCODERS: dict[tuple[str, int], "Encoder"] = {}


class Encoder:
    """Ids of texts by the library, each distinct run between white space once while it is known.

    A slice's runs are numbered by Arrow, so only its distinct ones are looked up.  Punctuation (ASCII) at the end of a run is split off after a
    letter or digit of Latin script: no word of the vocabulary's pattern spans that border, and no normal form does.  What is left, a stem, goes to the
    library's model if it is letters of Latin-1 alone (one word, lowered, its bytes as the model spells them), else to the whole library.
    Of two generations of known runs the older goes once the newer is full, and runs still met move to the newer.
    """

    def __init__(self, spec: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.spelling = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self.kind = np.dtype("<u2" if max(self.library.get_vocab_size(), end) < 1 << 16 else "<u4")
        self.end = end
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def cut(run: str) -> tuple[str, str]:
        stem = run.rstrip(PUNCTUATION)
        if stem and len(stem) < len(run) and stem[-1].isalnum() and stem[-1] < "\u0250" and "<|" not in run:
            return stem, run[len(stem) :]
        return run, ""

    def packed(self, ids: list[int]) -> bytes:
        held = array("H" if self.kind.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            held.byteswap()
        return held.tobytes()

    def spelt(self, word: str) -> str | None:
        """A word of Latin-1 letters as the model spells it; null for all others."""
        if not word.isalpha():
            return None
        if word.isascii():
            return word.lower()  # letters of ASCII are spelt as themselves
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return word.lower().encode().decode("latin-1").translate(self.spelling)

    def learn(self, runs: list[str]) -> None:
        known, older = self.known, self.older
        parts, new = [], []
        for run in runs:
            found = older.get(run)
            if found is not None:
                known[run] = found
                continue
            stem, tail = self.cut(run)
            new.append(stem)
            if tail:
                new.append(tail)
                parts.append((run, stem, tail))
        self.held += sum(map(len, runs))
        others = []
        for word in new:
            if word not in known:
                found = older.get(word)
                if found is not None:
                    known[word] = found
                elif (spelt := self.spelt(word)) is not None:
                    known[word] = self.packed([t.id for t in self.model.tokenize(spelt)])
                else:
                    known[word] = b""  # until the library has told
                    others.append(word)
        for word, found in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False)):
            known[word] = self.packed(found.ids)
        for run, stem, tail in parts:
            known[run] = known[stem] + known[tail]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, the end id after each; the places where each text ends)."""
        if len(self.known) > KNOWN or self.held > KNOWN_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, "").cast(pa.large_string()))
        runs = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        number = runs.indices.to_numpy()
        words = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        pieces = list(map(self.known.get, words))
        missing = [i for i, p in enumerate(pieces) if p is None]
        self.learn([words[i] for i in missing])
        for i in missing:
            pieces[i] = self.known[words[i]]
        data = np.frombuffer(b"".join(pieces), self.kind)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.kind.itemsize
        first = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[number])])[bounds]
        out = np.empty(int(ends[-1]) + len(texts), self.kind)
        place, stops = np.arange(len(texts)), ends[1:]
        closing = stops + place
        out[closing] = self.end
        # All other places take the runs' ids in order, some runs at a time.
        free = np.ones(len(out), bool)
        free[closing] = False
        at = np.flatnonzero(free)
        done = 0
        for start in range(0, len(number), GATHERED):
            some = number[start : start + GATHERED]
            n = size[some]
            total = int(n.sum())
            inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            out[at[done : done + total]] = data[np.repeat(first[some], n) + inside]
            done += total
        return out, closing + 1


class Writer:
    """A file of frames."""

    def __init__(self, sink, kind: np.dtype, frame: int = FRAME, level: int = LEVEL):
        self.sink, self.kind, self.limit = sink, kind, frame * kind.itemsize
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.held, self.size, self.seek = [], 0, []
        self.ids, self.counts, self.written = [], [], 0

    def frame(self, content: bytes) -> None:
        packed = self.pack(content)
        self.sink.write(packed)
        self.written += len(packed)
        self.seek.append(struct.pack("<III", len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.held:
            self.frame(b"".join(self.held))
            self.held, self.size = [], 0

    def add(self, id, data: bytes) -> None:
        self.ids.append(id)
        self.counts.append(len(data) // self.kind.itemsize)
        if self.size + len(data) > self.limit:
            self.flush()
        while len(data) > self.limit:
            self.frame(data[: self.limit])
            data = data[self.limit :]
        self.held.append(data)
        self.size += len(data)

    def close(self, id_type: pa.DataType) -> None:
        self.flush()
        sink = pa.BufferOutputStream()
        index = pa.table({"id": pa.array(self.ids, id_type), "n": pa.array(self.counts, pa.int64())}, metadata={"width": str(self.kind.itemsize)})
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        self.frame(sink.getvalue().to_pybytes())
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.written += 8 + len(table)


class Reader:
    """Reads documents of a file; ``frames_read`` counts the data frames that it had to decompress."""

    def __init__(self, source, size: int):
        self.source, self.frames_read = source, 0
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a file of frames with checksums and a seek table")
        table = np.frombuffer(self.at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        if struct.unpack("<II", self.at(size - 17 - 12 * n, 8)) != (SKIPPABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.packed, self.sums = table[:, 0], table[:, 2]
        self.places = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.bounds = np.concatenate([[0], np.cumsum(table[:-1, 1])])
        index = pa.ipc.open_stream(self.frame(n - 1)).read_all()
        self.width = int(index.schema.metadata[b"width"])
        self.ids, self.counts = index.column("id"), index.column("n").to_numpy()
        self.ends = np.cumsum(self.counts) * self.width

    def at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        content = zstandard.ZstdDecompressor().decompress(self.at(int(self.places[k]), int(self.packed[k])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"the content of frame {k} is damaged")
        return content

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place, ids as little-endian 32-bit integers) of the documents at these places in ascending order, or of all."""
        last, content = -1, b""
        for i in range(len(self.counts)) if wanted is None else wanted:
            end = int(self.ends[i])
            start = end - int(self.counts[i]) * self.width
            pieces = []
            k = int(np.searchsorted(self.bounds, start, "right")) - 1
            while start < end:
                if k != last:
                    last, content = k, self.frame(k)
                    self.frames_read += 1
                here = int(self.bounds[k])
                pieces.append(content[start - here : min(end - here, len(content))])
                start, k = min(end, here + len(content)), k + 1
            data = b"".join(pieces)
            yield i, data if self.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, spec: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, frame: int = FRAME, shards: int | None = None) -> DataFrame:
    """Write the files and return their manifest, a table: (shard, path, first, last, n_docs, n_ids, n_bytes, start), one row a file.

    ``start``: the ids of all files before; ``first`` and ``last``: the smallest and largest id, nulls aside.
    There are ``shards`` files, or as many as Spark makes of its shuffle partitions.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("body")]
    laid = given.repartitionByRange(*[shards] * bool(shards), *order).sortWithinPartitions(*order)

    def run(batches):
        encoder = ENCODERS.get((shared.value, end)) or ENCODERS.setdefault((shared.value, end), Encoder(shared.value, end))
        writer = None
        for part in slices(batches, SLICE):
            if writer is None:
                path = f"{folder}/{uuid.uuid4().hex}.ids.zst"
                files, place = _open(path)
                files.create_dir(os.path.dirname(place), recursive=True)
                stream, id_type = files.open_output_stream(place, compression=None), part.column(0).type
                writer = Writer(stream, encoder.kind, frame)
            ids, ends = encoder.encoded(part.column(1))
            start = 0
            for id, stop in zip(part.column(0).to_pylist(), ends.tolist()):
                writer.add(id, ids[start:stop].tobytes())
                start = stop
        if writer:
            writer.close(id_type)
            stream.close()
            known = [i for i in writer.ids if i is not None]
            row = (TaskContext.get().partitionId(), path, min(known, default=None), max(known, default=None), len(writer.ids), sum(writer.counts), writer.written)
            kinds = [pa.int32(), pa.string(), id_type, id_type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["shard", "path", "first", "last", "n_docs", "n_ids", "n_bytes"])

    files = materialise(laid.mapInArrow(run, f"shard int, path string, first {kind}, last {kind}, n_docs bigint, n_ids bigint, n_bytes bigint"))
    # One row a file: the only thing that is summed up in one task.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, wanted: list | None = None) -> DataFrame:
    """(id, start, n_tokens, tokens) of all documents of a manifest, or of those with the few ids ``wanted``.

    ``tokens``: little-endian unsigned 32-bit integers; ``start``: the ids of all documents before.  A file that can't hold a
    wanted id isn't opened, nor is a frame without a wanted document decompressed.
    """
    kind = manifest.schema["first"].dataType.simpleString()
    if wanted is not None:
        inside = F.lit(False)
        for id in wanted:
            inside = inside | F.lit(id).between(F.col("first"), F.col("last"))
        manifest = manifest.filter(inside)
    files = manifest.select("shard", "path", "start")
    files = files.repartitionByRange(max(1, files.count()), "shard")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                system, place = _open(path)
                with system.open_input_file(place) as source:
                    reader = Reader(source, source.size())
                    places = None if wanted is None else np.flatnonzero(pa.compute.is_in(reader.ids, pa.array(wanted, reader.ids.type)).to_numpy()).tolist()
                    begins = start + np.cumsum(reader.counts) - reader.counts
                    held, size, ids = [], 0, reader.ids.combine_chunks()
                    for found in reader.documents(places):
                        held.append(found)
                        size += len(found[1])
                        if size >= 1 << 22:
                            yield answer(held, ids, begins, reader.counts)
                            held, size = [], 0
                    if held:
                        yield answer(held, ids, begins, reader.counts)

    def answer(held, ids, begins, counts):
        at = np.array([i for i, _ in held])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(begins[at], pa.int64()), pa.array(counts[at], pa.int64()), pa.array([d for _, d in held], pa.binary())], names=["id", "start", "n_tokens", "tokens"])

    return files.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, tokens binary")


@tidy
def op12_token_files(spark, sf_dir):
    """The files lie in the shared folder and go with the manifest that the result reads."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = materialise(write_tokens(read(spark, sf_dir, "documents"), vocabulary(), folder))
    keep_with(manifest, folder)
    return read_tokens(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
