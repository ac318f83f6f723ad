"""The merge against a plain one that builds both branches as tables and compares unit by unit."""

import hashlib
import zlib
from random import Random

import numpy as np
import pytest

from tidemark.llm import branch_merge as b

SCHEMA = "doc_id bigint, text string, lang string, source string, n_clean string"


def code(branch, id, name, m=7):
    return zlib.crc32(f"{branch}:{'' if id is None else id}:{name}".encode()) % m


def edited(value, c):
    return value + {1: "!", 2: "?"}.get(c, "")


def plain(id, text, lang, source):
    base = {"lang": lang or "", "source": source or ""}
    lines = (text or "").split("\n")
    rows, columns, states, gaps = {}, {}, {}, {}
    for side in "LR":
        rows[side] = code(side, id, "row")
        columns[side] = {n: "" if code(side, id, n) == 0 else edited(v, code(side, id, n)) for n, v in base.items()}
        codes = [code(side, id, i) for i in range(len(lines))]
        states[side] = [None if c == 0 else edited(line, c) for line, c in zip(lines, codes)]
        gaps[side] = [{3: "!", 4: "?"}.get(c) for c in codes]
    count = dict.fromkeys(b.COUNTS, 0)

    def merged(old, l, r, conflict):
        if l == r == old:
            return old
        if l == r or r == old or l == old:
            count["n_clean"] += 1
            return l if r == old else r
        count[conflict(l, r)] += 1
        return r

    out = []
    changed = lambda s: columns[s] != base or states[s] != lines or any(gaps[s])
    if rows["L"] == 0 or rows["R"] == 0:
        left_gone, right_gone = rows["L"] == 0, rows["R"] == 0
        if left_gone and right_gone or not changed("R" if left_gone else "L"):
            out.append((id, None, None, None, 1, 0, 0, 0))
        elif left_gone:
            text = [x for s, g in zip(states["R"], gaps["R"]) for x in (s, g) if x is not None]
            out.append((id, *columns["R"].values(), "\n".join(text), 0, 0, 1, 0))
        else:
            out.append((id, None, None, None, 0, 0, 1, 0))
    else:
        either = lambda l, r: "n_edit_delete" if None in (l, r) else "n_edit_edit"
        two = [merged(base[n], columns["L"][n], columns["R"][n], lambda l, r: "n_edit_edit") for n in base]
        text = []
        for i, line in enumerate(lines):
            text.append(merged(line, states["L"][i], states["R"][i], either))
            text.append(merged(None, gaps["L"][i], gaps["R"][i], lambda l, r: "n_insert_insert"))
        out.append((id, *two, "\n".join(x for x in text if x is not None), *count.values()))
    added = [{3: "!", 4: "?"}.get(rows[s]) for s in "LR"]
    if any(added):
        differ = None not in added and added[0] != added[1]
        out.append((None if id is None else -1 - id, *base.values(), added[1] or added[0], int(not differ), 0, 0, int(differ)))
    return out


def test_equal_to_a_plain_merge(spark):
    rnd = Random(1)
    rows = [(i, "\n".join(rnd.choice(["", "a", "b é 😀", "!", "x" * 50]) for _ in range(rnd.choice([1, 1, 2, 5, 30, 120]))), rnd.choice(["en", "", None]), rnd.choice(["s", None, "?"])) for i in range(700)]
    rows += [(10**15 + 7, None, None, None), (None, "p\nq\nr", "en", "s"), (-5, "\n\n\n", "", ""), (3, rows[3][1], *rows[3][2:]), (4, "other", "fr", "s"), (888, "\n".join(map(str, range(12_345))), "en", "s")]
    df = spark.createDataFrame([(*r[:2], *r[2:], "own") for r in rows], SCHEMA)
    got = [tuple(r) for r in b.merge_branches(df.repartition(3)).collect()]
    want = [x for r in rows for x in plain(*r)]
    key = lambda r: tuple(map(repr, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    kinds = np.array([r[4:] for r in want]).sum(0)
    assert (kinds > 20).all() and any(r[3] is None and r[6] for r in want) and any(r[3] and r[6] == 1 for r in want)


def test_codes_of_both_branches_come_from_one_checksum():
    keys = ["", "7", "-12", "123456789012"]
    n = np.array([1, 3, 1205, 11])
    for names, m in ((("L", "R"), 7), (("main", "side"), 1009)):
        left, right = b.line_codes(keys, n, names, m)
        want = [(code(names[0], k, i, m), code(names[1], k, i, m)) for k, c in zip(keys, n) for i in range(c)]
        assert list(zip(left.tolist(), right.tolist())) == want
        for name in ("row", "lang", "é"):
            assert b.name_codes("42", name, names, m) == (code(names[0], 42, name, m), code(names[1], 42, name, m))
    assert b.apart("L", "R", 9) == zlib.crc32(b"L123456789") ^ zlib.crc32(b"Rabcdefghi"[:1] + b"123456789")


def test_empty_and_general(spark):
    assert b.merge_branches(spark.createDataFrame([], SCHEMA)).count() == 0
    out = b.merge_branches(spark.createDataFrame([(1, "x", "y")], "key int, body string, text string"), "key", "body", ("text",), ("aa", "bb"), 11)
    assert out.columns == ["id", "text", "text", *b.COUNTS] and out.count() >= 1
    with pytest.raises(ValueError):
        b.merge_branches(spark.createDataFrame([], SCHEMA), branches=("L", "RR"))


def test_query(spark, sf_dir):
    got = sorted(tuple(r) for r in b.op13_branch_merge(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    want = [(*x[:3], sha(x[3]), *x[4:]) for r in docs for x in plain(*r)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_map_without_a_shuffle(spark, sf_dir):
    plan = b.op13_branch_merge(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
