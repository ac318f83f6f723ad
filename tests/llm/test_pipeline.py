import hashlib
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_near_dedup import plain  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of every stage, on the smallest tables and some odd rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    top = docs.count()
    text = docs.filter("doc_id = 0").first().text
    odd = [(top + 1, None, None, None, None), (top + 2, "", "en", "src0", 0), (top + 3, "12 34", "en", None, 5), (top + 4, text, "en", "src1", 1), (top + 5, text + " more words", "en", "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(path := str(tmp_path_factory.mktemp("stage") / str(i)))
        out.append(spark.read.parquet(path))
    return [(x.columns, [r.asDict() for r in x.collect()]) for x in out]


def test_columns(stages):
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])
    assert stages[-1][0] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "source"]


def test_language(stages):
    assert {r["doc_id"] for r in stages[1][1]} == {r["doc_id"] for r in stages[0][1] if any(c.isalpha() for c in r["text"] or "")}


def test_exact(stages):
    first = {}
    for r in stages[1][1]:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2][1]) == sorted(first.values())


def test_near(stages):
    groups = plain([(r["doc_id"], r["text"]) for r in stages[2][1]], 5, 80)
    assert sorted(r["doc_id"] for r in stages[3][1]) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_mix(stages):
    given = {r["doc_id"]: r for r in stages[3][1]}
    taken = [r["doc_id"] for r in stages[4][1]]
    assert set(taken) <= set(given) and max(taken.count(i) for i in set(taken)) <= 2
    assert all(given[r["doc_id"]] == r for r in stages[4][1])


def test_tokens(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in stages[4][1]}
    assert sorted(r["doc_id"] for r in stages[5][1]) == sorted(r["doc_id"] for r in stages[4][1])
    for r in stages[5][1]:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_language_without_labels(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (None, "más", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.text for r in pipeline.language_id(spark, docs, "").collect()) == ["más", "some words"]


def test_language_fills_missing_labels(spark):
    words = {"en": "the house and the water of people through which they would", "fr": "la maison et le peuple avec très être pour dans une des"}
    rows = [(i, words["en" if i % 2 else "fr"] + f" {i}", ("en" if i % 2 else "fr") if i < 80 else None) for i in range(100)]
    got = {r.doc_id: r.lang for r in pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "").collect()}
    assert got == {i: "en" if i % 2 else "fr" for i in range(100)}


CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, score string, lang_pred string, row string, body string, digest string, key int, salt int, __gone int"


def test_extra_columns_null_ids_and_repeated_rows(spark):
    """Every stage keeps clashing columns and null ids; of repeated rows one stays."""
    extra = (1, "s", "p", "r", "b", "d", 2, 3, 4)
    rows = [(i, f"the words of text number {i} and {i * 7}", "en", f"src{i % 3}", 1, *extra) for i in range(40)]
    rows += [(None, "a text without an id, one of two", None, None, None, *extra), (None, "der zweite Text ohne Nummer", "de", "src0", 1, *extra)]
    rows += [(50, "the same row twice", "en", "src1", 3, *extra)] * 2 + [(51, "the same row twice ", "en", "src1", 3, *extra), (60, "12 34", "en", "src1", 3, *extra)]
    docs = spark.createDataFrame(rows, CLASH)
    # A row without a label gets the predicted one: only "en" can be learned here.
    rows = [(*r[:2], r[2] or "en", *r[3:]) for r in rows]
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialise(stage(spark, docs, ""))
        assert docs.columns == [c.split()[0] for c in CLASH.split(", ")]
        seen[name] = sorted((tuple(r) for r in docs.collect()), key=str)
    unique = sorted([r for r in rows if r[0] not in (50, 51, 60)] + [rows[42]], key=str)
    assert seen["language_id"] == sorted([r for r in rows if r[0] != 60], key=str)
    assert len(seen["exact_dedup"]) == len(unique) + 1 and set(seen["exact_dedup"]) >= set(unique)  # a white space at the end is a text of its own
    assert seen["near_dedup"] == unique
    assert set(seen["mix_sources"]) <= set(unique) and any(r[0] is None for r in seen["mix_sources"])
    out = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(out) == len(seen["mix_sources"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], CLASH)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
