import math
import re
from random import Random

import numpy as np
import pytest

from tidemark.llm import near_dedup as n
from tidemark.llm.components import components

SCHEMA = "doc_id bigint, text string, band string, component int, a int"


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def plain(rows, k, percent):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {r[0]: plain_set(r[1], k) for r in rows if r[0] is not None}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def made(seed=1, groups=9):
    rnd = Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, at = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 90))]
        for _ in range(rnd.choice([1, 2, 3, 12])):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((at, rnd.choice([" ", "\n", " \t "]).join(text), "x", 1, 2))
            at += rnd.randint(1, 3)
    # A chain whose ends don't link, and texts that share half their words with many.
    chain = [f"c{i}" for i in range(60)]
    for step in range(8):
        chain = chain[3:] + [f"d{step}{i}" for i in range(3)]
        rows.append((at + step, " ".join(chain), None, None, None))
    at += 20
    passage = [f"p{i}" for i in range(40)]
    for i in range(30):
        rows.append((at + i, " ".join(passage + [f"q{i}{j}" for j in range(12)]), None, None, None))
    at += 40
    odd = [None, "", " \n", "one", "ONE", "two words", "Two  Words", "É x y", "é x y", "a b c", "x " * 20_000, "x " * 20_001]
    rows += [(at + i, t, None, None, None) for i, t in enumerate(odd)]
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups(spark, k, percent):
    rows = made()
    rnd = Random(2)
    rnd.shuffle(rows)
    extra = [(None, "null id a b c", None, None, None), rows[0]]
    got = n.near_groups(spark.createDataFrame(rows + extra, SCHEMA).repartition(4), words=k, percent=percent).collect()
    assert len(got) == len(rows) + 2
    want = plain(rows, k, percent)
    assert {r.id: (r.n_shingles, r.component) for r in got if r.id is not None} == want
    assert all(r.kept == (r.id == r.component) for r in got if r.id is not None)
    assert [(r.component, r.kept) for r in got if r.id is None] == [(None, True)]


def test_hot_group_of_near_copies(spark):
    rnd = Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(100)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(text), None, None, None))
    want = plain(rows, 3, 85)
    got = n.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), words=3, percent=85).collect()
    assert {r.id: (r.n_shingles, r.component) for r in got} == want


def test_rows_that_stay(spark):
    rows = made(5)
    df = spark.createDataFrame(rows, SCHEMA)
    out = n.near_dedup(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in plain(rows, 5, 80).items() if i == c}


def test_empty(spark):
    assert n.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in n.near_groups(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()] == [(1, 0, 1, True)]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = n.op6_minhash_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, 3, 85)


def test_prune_bound_is_the_posterior():
    for read, least in n.least_matches(60, 0.85, 1e-6, 20):
        grid = np.linspace(0, 1, 200_001)
        for m in range(max(0, least - 1), min(read, least + 1) + 1):
            like = grid**m * (1 - grid) ** (read - m)
            posterior = like[grid >= 0.85].sum() / like.sum()
            assert (posterior >= 1e-6 * 1.02) <= (m >= least) and (posterior < 1e-6 * 0.98) <= (m < least)


def test_band_miss():
    for t in (0.8, 0.85):
        assert (1 - t**n.ROWS) ** n.n_bands(t) <= n.BAND_MISS
    assert math.isclose(sum(1 for _ in n.least_matches(120, 0.85)), 6)


def test_sets_against_plain():
    rnd = Random(3)
    texts = [" ".join(rnd.choice(["a", "b", "É", "C", "\t", "\n", " ", "longer"]) for _ in range(rnd.randint(0, 30))) for _ in range(200)] + ["", "a", "x" * 50_000]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    whole = np.frombuffer(b"".join(data), np.uint8)
    for k in (1, 3, 5):
        sets = n.shingle_sets(whole, offsets, k)
        assert [len(s) for s in sets] == [len(plain_set(t, k)) for t in texts]
        for i in rnd.sample(range(200), 25):
            for j in rnd.sample(range(200), 25):
                same = len(np.intersect1d(sets[i], sets[j]))
                assert same == len(plain_set(texts[i], k) & plain_set(texts[j], k))


def test_components(spark):
    rnd = Random(6)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 2000 + i) for i in range(300)] + [(7, 7)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    want = {i: root(i) for a, b in links for i in (a, b) if a != b}
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(got) == len(want) and {r.id: r.component for r in got} == want


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_collide_in_polynomials_do_not_link(spark):
    """Modulo 2**64 a polynomial takes the Thue-Morse word of 1,024 letters and its complement for one."""
    for size in (1024, 4096):
        word = thue_morse(size)
        other = word.translate(str.maketrans("ab", "ba"))
        long = " ".join([f"{i} word" for i in range(20)])
        rows = [(1, word), (2, other), (3, f"{long} {word}"), (4, f"{long} {other}"), (5, f"{word} {word[:-1]}"), (6, f"{other} {other[:-1]}")]
        got = n.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=1, percent=98).collect()
        assert all(r.component == r.id for r in got), got


@pytest.mark.parametrize("most_bits", [64])
def test_repeated_ids(spark, most_bits):
    """An id with several texts is one document; repeated rows leave one, whatever the filters let through."""
    rnd = Random(4)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randrange(99)) for _ in range(30)) for _ in range(6)]
    rows = [(10, texts[0], "x", 1, 1), (11, texts[0], "x", 1, 1), (11, texts[1], "x", 1, 1), (12, texts[1] + " tail", "x", 1, 1), (13, texts[2], "b", 1, 1), (13, texts[2], "a", 1, 1)]
    rows += [(20, texts[3], None, None, None)] * 40 + [(21, texts[3] + " end", None, None, None), (None, texts[4], None, None, None), (30, texts[5], None, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = n.near_groups(df, words=3, percent=85, most_bits=most_bits).collect()
    assert {r.id: r.component for r in got} == {10: 10, 11: 10, 12: 10, 13: 13, 20: 20, 21: 20, None: None, 30: 30} and len(got) == len(rows)
    stays = n.near_dedup(df, words=3, percent=85, most_bits=most_bits)
    assert stays.columns == df.columns
    assert sorted((r.doc_id or 0, r.band or "") for r in stays.collect()) == [(0, ""), (10, "x"), (13, "a"), (20, ""), (30, "")]


@pytest.mark.parametrize("most_bits", [64])
def test_groups_whatever_the_filters_let_through(spark, most_bits):
    rows = made(3)
    got = n.near_groups(spark.createDataFrame(rows, SCHEMA), words=3, percent=85, most_bits=most_bits).collect()
    assert {r.id: (r.n_shingles, r.component) for r in got} == plain(rows, 3, 85)
