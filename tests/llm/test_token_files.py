"""Files of token ids: an exact round trip against the library, and reading of single documents."""

import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from tidemark.llm import token_files as f
from tidemark.llm.bpe import vocabulary

SCHEMA = "doc_id bigint, text string, start int, tokens string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def plain(rows, library):
    """(id, start, n_tokens, crc) of rows that are in order."""
    out, at = [], 0
    for id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


ODD = ["", " ", "\n\n", "a b c", "tab\tbed \x1c\x85 x", "<|endoftext|>in<|startoftext|> text", "don't  WON'T 123", "İstanbul ΣΑΣ é ä ́x", "日本語 😀😀", "x" * 5000, "é" * 300, None]


def test_round_trip_and_order(spark, library, tmp_path):
    import pyspark.sql.functions as F

    rows = [(3 * i, t) for i, t in enumerate(ODD)] + [(1000 + i, "some words " * (i % 9)) for i in range(300)] + [(5000, "very long text " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], SCHEMA).repartition(4)
    manifest = f.write_tokens(df, vocabulary(), f"file://{tmp_path}/ids", frame=1000, shards=5).cache()
    out = f.read_tokens(manifest).withColumn("crc", F.crc32("tokens"))
    assert sorted((r.id, r.start, r.n_tokens, r.crc) for r in out.collect()) == plain(sorted(rows), library)
    files = manifest.orderBy("shard").collect()
    assert len(files) > 1 and [r.start for r in files] == np.cumsum([0, *[r.n_ids for r in files[:-1]]]).tolist()
    assert all(os.path.getsize(r.path.removeprefix("file://")) == r.n_bytes for r in files)
    assert sorted(r.id for r in f.read_tokens(manifest, [3, 1001, 5000, 77]).collect()) == [3, 1001, 5000]


def test_null_and_repeated_ids(spark, library, tmp_path):
    rows = [(None, "no id"), (None, None), (4, "twice"), (4, "twice"), (4, "other text"), (1, "first")]
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], SCHEMA)
    got = sorted(f.read_tokens(f.write_tokens(df, vocabulary(), f"file://{tmp_path}/x")).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, None, 1, 4, 4, 4]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    sizes = lambda t: len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted(r.n_tokens for r in got) == sorted(sizes(t) for _, t in rows)


def test_empty(spark, tmp_path):
    manifest = f.write_tokens(spark.createDataFrame([], SCHEMA), vocabulary(), f"file://{tmp_path}/x")
    assert manifest.count() == 0 and f.read_tokens(manifest).count() == 0


def written(documents, kind="<u2", frame=10):
    import pyarrow as pa

    sink = io.BytesIO()
    w = f.Writer(sink, np.dtype(kind), frame)
    for i, ids in enumerate(documents):
        w.add(i, np.array(ids, kind).tobytes())
    w.close(pa.int64())
    return sink.getvalue()


def test_only_requested_frames_are_decompressed():
    documents = [[i] * n for i, n in enumerate([3, 4, 9, 0, 35, 2, 10, 1])]
    for kind in ("<u2", "<u4"):
        data = written(documents, kind)
        r = f.Reader(io.BytesIO(data), len(data))
        assert [np.frombuffer(x, "<u4").tolist() for _, x in r.documents()] == documents
        assert r.frames_read == len(r.packed) - 1
        for i, frames in ((0, 1), (3, 0), (4, 4), (7, 1)):
            r = f.Reader(io.BytesIO(data), len(data))
            assert [(k, np.frombuffer(x, "<u4").tolist()) for k, x in r.documents([i])] == [(i, documents[i])]
            assert r.frames_read == frames


def test_layout_is_that_of_seekable_files():
    documents = [[1, 2, 3], [4] * 25]
    data = written(documents)
    # Any zstandard reader passes over the skippable frame and gets all content in order.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole[: 2 * 28], "<u2").tolist() == [x for d in documents for x in d]
    assert data[-4:] == bytes.fromhex("b1ea928f") and data[-5] == 0x80
    n = int.from_bytes(data[-9:-5], "little")
    sizes = [int.from_bytes(data[-9 - 12 * (n - i) :][:4], "little") for i in range(n)]
    assert sum(sizes) == len(data) - 17 - 12 * n and data[sum(sizes) :][:4] == bytes.fromhex("5e2a4d18")


def test_damage_is_found():
    data = bytearray(written([[1, 2, 3]] * 20))
    data[len(data) - 9 - 4] ^= 1  # the index frame's checksum in the seek table
    with pytest.raises(ValueError, match="damaged"):
        f.Reader(io.BytesIO(bytes(data)), len(data))
    data = bytearray(written([[1, 2, 3]] * 20))
    data[10] ^= 0xFF  # inside the first frame
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(f.Reader(io.BytesIO(bytes(data)), len(data)).documents([0]))
    with pytest.raises(ValueError, match="seek table"):
        f.Reader(io.BytesIO(b"\0" * 40), 40)


def test_query(spark, sf_dir, library):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in f.op12_token_files(spark, sf_dir).collect()) == plain(docs, library)
