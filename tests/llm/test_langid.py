import zlib
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, label string, score double"
WORDS = {
    "en": "the of and that with from have this which their would about people through water because house",
    "de": "der die und nicht eine auch werden über können für straße schön wasser haus menschen durch",
    "fr": "le la les des est dans une pour qui pas être avec très où maison eau peuple forêt déjà",
    "es": "el los las una por con para más está señor año niño agua casa pueblo porque también después",
    "xx": "zaq zoq quux quuz xyzzy plugh zork frobz gnarq blarg",
}


def made(n=500, seed=1):
    rnd = Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        rows.append((i, " ".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randint(8, 60))), lang, "clash", 0.5))
    return rows


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_odd_rows(spark):
    rows = made()
    odd = [(9001, None, "en", None, None), (9002, "", "en", None, None), (9003, "12 34 !? ½", None, None, None), (9004, "the " * 100_000, None, None, None), (None, "der und nicht", "de", None, None), (3, rows[3][1], rows[3][2], None, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model = langid.train(df, per_language=40)
    assert set(model.languages) == {"germanic", "romance", "xx"}
    got = langid.identify(df, model, whole=True).collect()
    assert len(got) == len(rows) + len(odd)
    assert sorted(map(tuple, (r.row for r in got)), key=str) == sorted(rows + odd, key=str)
    by = {r.id: r for r in got}
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "en"]
    held = [(i, lang) for i, _, lang, *_ in rows if is_held(i)]
    assert np.mean([by[i].lang_pred == lang for i, lang in held]) > 0.97


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = made(200)
    poisoned = [(i, t, "zz" if is_held(i) else lang, a, b) for i, t, lang, a, b in rows]
    a, b = (langid.train(spark.createDataFrame(r, SCHEMA)) for r in (rows, poisoned))
    assert "zz" not in b.languages and a.languages == b.languages
    assert all(np.array_equal(a.of_family[k], b.of_family[k]) for k in a.of_family)


def test_pieces_add_up(monkeypatch):
    text = "Die Straße über den Fluß, the house of señor " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.array_equal(langid.counts(text), whole)


def test_nothing_and_one_language(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, langid.train(empty)).count() == 0
    none = spark.createDataFrame([(1, "the house", None, None, None)], SCHEMA)
    assert langid.identify(none, langid.train(none)).first()[1:] == ("und", 0.0)
    one = spark.createDataFrame([(i, "the house", "en", None, None) for i in range(1, 9)], SCHEMA)
    assert {r[1:] for r in langid.identify(one, langid.train(one)).collect()} == {("en", 1.0)}


def test_repeats_of_one_id_keep_to_the_bound(spark, monkeypatch):
    """At most the bound's rows of a language are learned from, whatever repeats: one id, or whole rows."""
    seen = []
    monkeypatch.setattr(langid, "Model", lambda x, langs: seen.append(list(langs)))
    free = next(i for i in range(1, 100) if not is_held(i))
    words = ["der hund", "le chat"]
    same = spark.range(5000).select(F.lit(free).alias("doc_id"), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 2 + 1).cast("int")).alias("text"), F.when(F.col("id") % 2 == 0, "de").otherwise("fr").alias("lang"))
    langid.train(same.repartition(8), per_language=200)
    apart = same.withColumn("text", F.concat("text", F.lit(" "), F.rand(1).cast("string")))
    langid.train(apart, per_language=200)
    assert sorted(seen[0]) == ["de", "fr"]  # one row of each counts
    assert len(seen[1]) == 400 and seen[1].count("de") == seen[1].count("fr") == 200


def test_separators_against_a_plain_svm(monkeypatch):
    """The dual ascent ends at the optimum that plain gradient descent finds for the same loss; the usual rounds come near it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 12)).astype(np.float32)
    y = np.where(x @ rng.normal(size=12) + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * langid.COST
    wide = np.hstack([x, np.ones((80, 1))])
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (wide @ w)) ** 2).sum()
    plain = np.zeros(13)
    for _ in range(20_000):
        plain -= 1e-4 * (plain - 2 * ((cost * np.maximum(0, 1 - y * (wide @ plain)) * y) @ wide))
    assert (np.sign(wide @ langid.svm(x, y)) == np.sign(wide @ plain)).mean() > 0.9
    monkeypatch.setattr(langid, "EPOCHS", 1000)
    found = langid.svm(x, y).astype(float)
    assert loss(found) < 1.01 * loss(plain)
    assert (np.sign(wide @ found) == np.sign(wide @ plain)).mean() > 0.97


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in langid.op4_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()
    assert all(got[r.doc_id].held_out == is_held(r.doc_id) for r in docs)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in docs if is_held(r.doc_id) and r.lang]) > 0.97


@pytest.mark.parametrize("text", ["a", "é", "ab"])
def test_short(text):
    assert langid.counts(text).sum() > 0


def plain_prediction(model, text):
    """The families' and languages' votes, from byte sequences counted one by one."""
    folded = b" " + b" ".join(bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.lower().encode()).split()) + b" "
    x = np.zeros(langid.BUCKETS)
    m = 1 << 32
    for i, a in enumerate(folded):
        x[(a * 2654435761 % m) >> 19] += 1
        if i + 1 < len(folded):
            two = (a * 40503 + folded[i + 1] * 2246822519) % m
            x[(two * 2654435761 % m) >> 19] += 1
        if i + 2 < len(folded):
            x[((two * 3266489917 + folded[i + 2] * 668265263) % m * 2654435761 % m) >> 19] += 1
    x = np.sqrt(x) / np.linalg.norm(np.sqrt(x))

    def best(names, pairs):
        won = dict.fromkeys(names, 0)
        for (a, b), w in pairs.items():
            won[a if x @ w[:-1] + w[-1] >= 0 else b] += 1
        top = [n for n in names if won[n] == max(won.values())]
        assert len(top) == 1
        return top[0]

    return best(model.languages[best(list(model.languages), model.of_family)], model.of_language[best(list(model.languages), model.of_family)])


def test_query_against_plain_votes(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))
    got = langid.op4_language_id(spark, sf).collect()
    assert {r.doc_id: (r.held_out, r.lang_pred) for r in got} == {
        i: (is_held(i), plain_prediction(model, r.text) if r.text and any(c.isalpha() for c in r.text) else "und") for i, r in docs.items()
    }
