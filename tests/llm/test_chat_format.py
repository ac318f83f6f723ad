import hashlib
import tracemalloc
from random import Random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat_format as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, formatted int"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "<", "s>", "[", "INST]", "/", "é", "🙂", "a", "\n", "<\\s>", ""]


def plain(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role is not None, role or "", text is not None, text or ""))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        out.add((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def rows():
    rnd = Random(4)
    text = lambda: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12)))
    made = [(rnd.randint(0, 40), rnd.randint(0, 6), rnd.choice(["user", "assistant", "system", "as[INST]s"]), text(), "x", 1) for _ in range(300)]
    made += [(7, 1, "user", None, None, None), (7, 1, None, "no role", None, None), (None, 0, "assistant", "null id", None, None), (None, None, "user", "no turn", None, None)]
    made += [(8, 2, "assistant", "long \\</s> " * 20_000, None, None), (9, 3, "user", "twice", None, None), (9, 3, "user", "twice", None, None)]
    return made + [(50, i, "assistant", f"turn {i}", None, None) for i in range(3000)]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_read_back(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
        out = c.format_chats(df)
        assert {tuple(r)[:5] for r in c.read_back(out).collect()} == plain(rows())
        assert out.count() == len({r[0] for r in rows()})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>"]), st.lists(st.sampled_from(PIECES)).map("".join)), min_size=1, max_size=6))
def test_round_trip_of_bytes(turns):
    out, turn, spans = c.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    text = out.tobytes().decode()
    assert c.parsed(text) == turns
    assert [c.unescape(out[a:b].tobytes().decode()) for a, b in spans] == [t for _, t in turns]
    assert text.count("</s>") == text.count("<s>") == len(turns) and turn[-1] == len(out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "é"]), st.lists(st.sampled_from(PIECES)).map("".join)), min_size=1, max_size=30), st.sampled_from([1, 5, 40]))
def test_small_slices_change_nothing(turns, size):
    schema = pa.schema([("id", pa.int64()), ("n_rows", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_pydict({"id": [i // 4 for i in range(len(turns))], "role": [r for r, _ in turns], "body": [t for _, t in turns]})
    want = c.formatted_batch(batch, schema)
    old, old_most = c.SLICE, c.MOST
    c.SLICE, c.MOST = size, size
    try:
        assert c.formatted_batch(batch, schema).equals(want)
        parts = [c.formatted_batch(p, schema) for p in c.parted(batch)]
        assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([want]))
    finally:
        c.SLICE, c.MOST = old, old_most


def test_memory_of_a_long_conversation():
    """Numpy's and Python's memory; Arrow's escaped copies are some two bytes a byte on top."""
    schema = pa.schema([("id", pa.int64()), ("n_rows", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_pydict({"id": [1] * 40, "role": ["user", "assistant"] * 20, "body": ["é words </s> " * 80_000] * 40})
    tracemalloc.start()
    out = c.formatted_batch(batch, schema)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 1 and most < 3 * batch.nbytes + (150 << 20)


def test_empty(spark):
    assert c.read_back(c.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
