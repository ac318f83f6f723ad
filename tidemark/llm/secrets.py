r"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256).  The ledger has a row for each (blob, rules version) that was
ever scanned, with the spans found.  A run scans one copy of each blob that the ledger lacks under the present rules and joins the
findings back to all paths and versions of the blob.  Hashes, not texts, are shuffled: which rows to scan is told where they are
by three Bloom filters of a fixed size at most, of the keys to scan, of those to skip, and of those to scan that the second has too.
They never pass over a key to scan; a key to skip that they let through is scanned once more than needed, to the same findings.

A rule has a cheap test that decides whether its expression runs on a text at all.  Spans are code points, end
exclusive: the pieces between the matches and the matches' lengths add up to where each match starts.

Cases: a null text is empty and has no spans; very long texts are scanned whole; null paths and versions are values of their own;
repeated rows each get the blob's findings; other columns are ignored; an empty table gives an empty result; without
a ledger everything is unseen.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SALTS, bloom, computed, for_each_salt, materialise, read, salted, tidy


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have; ``test``: literals one of which, or an expression that, any match holds."""

    kind: str
    pattern: str
    literals: tuple[str, ...] = ()
    test: str = ""
    group: int = 0
    least: int = 1


NAMES = r"(password|passwd|secret|token|api_?key)"
BASE = (
    Rule("assign", rf"""(?i){NAMES}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", test=rf"""(?i){NAMES}["']?\x20*[:=]""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", ("AKIA",), least=20),
    Rule("hex", r"[0-9a-f]{24,}", test=r"[0-9a-f]{24}"),  # a run of 24 or more: a shorter run holds no other match
)
ADDED = (
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("-----BEGIN ",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyJ",)),
)
RULES = BASE + ADDED
SPAN = "array<struct<start: int, rank: int, kind: string, end: int>>"


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's leftmost matches that don't overlap, without those whose group is too short."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    sizes = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    each = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(found, F.length).alias("n"), F.transform(sizes, F.length).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["n"]).alias("end"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["g"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.lit(None).cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast(SPAN)).alias("out"))
    hits = F.aggregate(each, start, step, lambda acc: acc["out"])
    test = F.lit(False)
    for word in rule.literals:
        test = test | F.contains(text, F.lit(word))
    if rule.test:
        test = text.rlike(rule.test)
    return F.when(test, hits).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of all rules by start, then by the rules' order."""
    return F.array_sort(F.flatten(F.array(*(spans_of(text, r, i) for i, r in enumerate(rules)))))


@tidy
def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "path", version_col: str | None = "version", text_col: str = "text", most_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, version, blob, spans) for every row of ``versions``, and the new rows of the ledger.

    A ledger has (blob string, rules string, spans array); append the new rows to it for the next run.
    """
    version = rules_version(rules)
    as_key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    number = F.col(version_col) if version_col else F.lit(0)
    named = versions.select(F.col(path_col).alias("path"), number.alias("version"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    keyed = named.withColumns({"p": as_key(F.col("path")), "v": as_key(F.col("version"))})
    blobs = materialise(keyed.select("path", "version", "p", "v", F.sha2("body", 256).alias("blob")))
    firsts = blobs.groupBy("blob").agg(F.min(F.struct("p", "v")).alias("at"))
    if ledger is not None:
        firsts = firsts.join(ledger.filter(F.col("rules") == version).select("blob"), "blob", "left_anti")
    unseen = materialise(firsts.select("blob", "at.p", "at.v"))

    to_scan = unseen.select("p", "v")
    skipped = materialise(blobs.select("p", "v").join(to_scan, ["p", "v"], "left_anti").distinct())
    may_scan, may_skip = bloom(to_scan, most_bits), bloom(skipped, most_bits)
    in_both = bloom(materialise(to_scan.filter(may_skip("p", "v"))), most_bits)
    todo = keyed.filter(may_scan("p", "v") & (~may_skip("p", "v") | in_both("p", "v")))
    found = computed(todo, spans=all_spans(F.col("body"), rules)).filter(F.size("spans") > 0)
    # One key can have several texts (repeated rows), and a blob several scanned rows, so the findings are by blob.
    found = materialise(found.select(F.sha2("body", 256).alias("blob"), "spans").dropDuplicates(["blob"]))
    fresh = unseen.select("blob", F.lit(version).alias("rules")).join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    known = found.select("blob", "spans")
    if ledger is not None:
        old = ledger.filter((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", F.col("spans").cast(SPAN).alias("spans"))
        known = known.unionByName(old.join(blobs.select("blob").distinct(), "blob", "left_semi")).dropDuplicates(["blob"])
    out = salted(blobs, "p", SALTS).join(for_each_salt(known, SALTS), ["blob", "__salt"], "left")
    return out.select("path", "version", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), fresh


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


LEDGER = "blob string, rules string, spans " + SPAN


def op9_secret_scan(spark, sf_dir):
    """Every path has one version and the ledger is empty: all blobs are unseen."""
    rows, _ = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), spark.createDataFrame([], LEDGER), path_col="doc_id", version_col=None)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return rows.select(F.col("path").alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    def either(pattern: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)

    # Only A-Z fold here; the engines' own flags for that differ beyond ASCII.
    assign = either(NAMES) + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    rows = []
    for i, r in enumerate(RULES):
        pattern = assign if r.kind == "assign" else "[0-9a-f]+" if r.kind == "hex" else r.pattern
        least = 24 if r.kind == "hex" else r.least
        rows.append(f"""
SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', {r.group}) AS g FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(rows)}),
e AS (SELECT doc_id, rank, kind, least, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM a),
s AS (SELECT doc_id, rank, kind, (length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], ''))) AS start, length(m[i]) AS n FROM e WHERE length(g[i]) >= least),
f AS (SELECT doc_id,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""


OP9_SQL = _sql()
