"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

A text's features are hashed counts of its 1- to 3-byte sequences (letters lower-cased, runs of anything but letters as
one space), as an L2-normalised vector.  Linear SVMs (L2 loss, dual coordinate descent) tell each pair of families
apart, then each pair of languages of the family that won most pairs.  Families come from a table of ISO 639-1 codes;
a language that isn't in it is a family of its own.

Training: a bounded sample, at most ``PER_LANGUAGE`` labelled rows a language (whatever repeats) taken by a hash of id and text, of
documents outside the held-out fifth; rows with the same id, text and label count once.  The counts that set the sampling rate are over all rows.  Prediction reads whole
texts, in pieces of ``PIECE`` bytes whose counts add up.

Cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing was learned; one
learned language is predicted for all texts with letters, with score 1; null labels and held-out rows (a remainder
of 0; null ids have none and count as held out) are never learned from; repeated rows get the same prediction; other columns
are ignored, or carried along whatever their names; an empty table gives an empty result.  The separators of every pair of
families and of every pair of languages of one family are on the driver, 32 KB each, so languages may be hundreds but not unbounded.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.common import named_apart, read

BUCKETS, PER_LANGUAGE, PIECE, EPOCHS, COST = 1 << 13, 200, 1 << 20, 15, 10.0
UNKNOWN = "und"
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ur pa gu ne",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

LETTER = regex.compile(r"\p{L}").search
#: Bytes as they count: A-Z as a-z, other ASCII as space.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPACES = regex.compile(rb" {2,}")


def counts(text: str) -> np.ndarray:
    """Hashed counts of the byte sequences of a whole text."""
    total = np.zeros(BUCKETS, np.int64)
    folded = b" " + SPACES.sub(b" ", text.lower().encode("utf-8", "replace").translate(FOLD)).strip() + b" "
    for at in range(0, len(folded), PIECE):
        b = np.frombuffer(folded[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        n = len(b) if at + PIECE + 2 >= len(folded) else PIECE
        one, two = b * np.uint32(2654435761), b[:-1] * np.uint32(40503) + b[1:] * np.uint32(2246822519)
        total += np.bincount(one[:n] >> np.uint32(19), minlength=BUCKETS)
        total += np.bincount((two[:n] * np.uint32(2654435761)) >> np.uint32(19), minlength=BUCKETS)
        if len(b) > 2:
            three = (two[:-1] * np.uint32(3266489917) + b[2:] * np.uint32(668265263)) * np.uint32(2654435761)
            total += np.bincount(three[:n] >> np.uint32(19), minlength=BUCKETS)
    return total


def features(text: str) -> np.ndarray:
    x = np.sqrt(counts(text).astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights (the bias last) of an L2-loss linear SVM, by dual coordinate descent; classes count alike."""
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * COST
    w, bias, a = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(x))
    diag = np.einsum("ij,ij->i", x, x) + 1 + 0.5 / cost
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            g = y[i] * (float(x[i] @ w) + bias) - 1 + a[i] * 0.5 / cost[i]
            new = max(a[i] - g / diag[i], 0.0)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                a[i] = new
    return np.append(w, np.float32(bias))


class Model:
    """Pairwise separators over families, and over the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs = np.array(langs, dtype=object)
        self.languages: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.languages.setdefault(FAMILY.get(lang, lang), []).append(lang)
        family = np.array([FAMILY.get(lang, lang) for lang in langs], dtype=object)
        self.of_family = self.pairs(x, family)
        self.of_language = {f: self.pairs(x[family == f], langs[family == f]) for f in self.languages}

    @staticmethod
    def pairs(x: np.ndarray, label: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
        found = {}
        for a, b in combinations(sorted(set(label)), 2):
            both = (label == a) | (label == b)
            found[a, b] = svm(x[both], np.where(label[both] == a, 1.0, -1.0)).astype(np.float32)
        return found

    @staticmethod
    def vote(x: np.ndarray, names: list[str], pairs: dict) -> tuple[str, float]:
        """The name that wins most pairs (ties: the larger sum of margins, then the first), and how surely it does."""
        won, sums, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), {}
        for (a, b), w in pairs.items():
            m = float(x @ w[:-1] + w[-1])
            margins[a, b], margins[b, a] = m, -m
            won[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(names, key=lambda k: (won[k], sums[k]))
        least = min((m for (a, _), m in margins.items() if a == best), default=None)
        return best, 1.0 if least is None else 1 / (1 + float(np.exp(-4 * least)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.vote(x, sorted(self.languages), self.of_family)
        lang, surer = self.vote(x, self.languages[family], self.of_language[family])
        return lang, sure * surer


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` rows of each language; fitted on the driver, whose share the bound fixes."""
    known = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("label"))
    # Of rows that repeat, one is as good as all, so different ones are counted, by a sketch of their hashes.
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id", "body"), F.lit(1 << 30)))
    by_label = dict(map(tuple, rows.groupBy("label").agg(F.approx_count_distinct("place")).collect()))
    if not by_label:
        return Model(np.zeros((0, BUCKETS), np.float32), [])
    # A rate that leaves about twice the bound of each language; the bound then takes the first by hash, and every task
    # keeps no more than the bound's rows of a language before any go further.
    rate = F.create_map(*[F.lit(v) for label, n in sorted(by_label.items()) for v in (label, min(1 << 30, (2 * per_language << 30) // n + 1))])
    some = rows.filter(F.col("place") < F.element_at(rate, F.col("label"))).groupBy("label", "place").agg(F.min("body").alias("body"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place"))
    picked = some.withColumn("rank", rank).filter(F.col("rank") <= per_language)
    kind = "label string, place bigint, x binary"

    def featured(batches):
        for batch in batches:
            for label, at, body in zip(*(batch.column(c).to_pylist() for c in ("label", "place", "body")), strict=True):
                if body and LETTER(body):
                    yield pa.RecordBatch.from_pydict({"label": [label], "place": [at], "x": [features(body).tobytes()]}, schema=pa.schema([("label", pa.string()), ("place", pa.int64()), ("x", pa.binary())]))

    sample = picked.select("label", "place", "body").mapInArrow(featured, kind).toArrow()
    rows = sorted(zip(*(sample.column(c).to_pylist() for c in ("label", "place", "x")), strict=True))
    del sample
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), BUCKETS)
    return Model(x, [r[0] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``; ``whole``: and the row itself, as a struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = named_apart(docs if whole else docs.select(F.col(id_col), F.col(text_col)))
    fields = given.schema["row"].dataType
    id, text = (fields.names.index(c) for c in (id_col, text_col))
    schema = StructType([StructField("id", fields[id].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())] + ([StructField("row", fields)] if whole else []))

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            told = [shared.value.predict(t.as_py()) for t in pc.struct_field(row, [text])]
            columns = [pc.struct_field(row, [id]), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64()), *[row] * whole]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
