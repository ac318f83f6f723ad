r"""URL filters: rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a pattern over ``host + path``: ``||`` at the start stands for the start of the host or of one of its
labels, ``^`` for an end or any character but letters, digits, ``_ - . %``, ``*`` for anything, ``|`` at an end for that
end.  A literal token of a rule is a run of ASCII letters and digits that the pattern bounds on both sides, so every URL
that fits the rule holds it as a whole token.  Each rule is filed under the one of its tokens that the URLs hold least
often; a URL's tokens fetch the rules filed under them, and only those rules' regular expressions run on the URL.

Rules of the list (host, path) fit a host and its subdomains if the path starts with theirs; the longest that fits
decides (of equal length the one with the longer host, then by code point).  Where none fits, the pattern rules decide:
allow rules go before block rules; where none of them fits either, the URL is allowed.

The filed rules are a table of hash buckets that travels in the plan, as large as the list that the caller has in memory; a token
looks into one bucket of it, however many rules there are, and every row is judged where it is, without a shuffle.

Cases: a null URL or one without ``://`` has an empty host and path and fits no rule; hosts are lower-cased in A-Z
only; ports and user names are part of the host; very long URLs are matched whole; each row is judged alone, so repeated rows
and ids give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
LIST = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: (pattern, verdict)
PATTERNS = (
    ("||ads-track.", "block"), ("||ads.", "block"), ("||adserver.", "block"), ("||doubleclick.", "block"), ("||tracker.", "block"),
    ("/ads/", "block"), ("/banner/", "block"), ("/login/", "block"), ("/cart/", "block"), ("/ads/policy/", "allow"),
)


def compiled(pattern: str) -> str:
    """The regular expression of a pattern, one that Java and RE2 read alike."""
    out = ""
    if pattern.startswith("||"):
        out, pattern = r"^([^/]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        out, pattern = "^", pattern[1:]
    end = pattern.endswith("|")
    for c in pattern[:-1] if end else pattern:
        out += ".*" if c == "*" else "([^A-Za-z0-9_.%-]|$)" if c == "^" else c if re.fullmatch(r"[A-Za-z0-9/_ ]", c) else "\\" + c
    return out + "$" * end


def literal_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that any URL that fits holds as whole tokens."""
    start = pattern.startswith("|")
    body = pattern.lstrip("|") if start else pattern
    end = body.endswith("|")
    body = body.rstrip("|")
    found = []
    for m in re.finditer("[A-Za-z0-9]+", body):
        left = start if m.start() == 0 else body[m.start() - 1] != "*"
        right = end if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            found.append(m[0])
    return found


def literal(text: str) -> str:
    return "".join(c if re.fullmatch(r"[A-Za-z0-9/_ ]", c) else "\\" + c for c in text)


def rule_rows(listed=LIST, patterns=PATTERNS) -> list[dict]:
    """The rules in one form; a larger (kind, length, host_length) decides."""
    rows = [{"kind": 2, "length": len(h) + len(p), "host_length": len(h), "rule": h + p, "verdict": v, "regex": r"^([^/]*\.)?" + literal(h + p), "tokens": literal_tokens("||" + (h + p).replace("*", "\0"))} for h, p, v in listed]
    rows += [{"kind": int(v == "allow"), "length": len(p), "host_length": 0, "rule": p, "verdict": v, "regex": compiled(p), "tokens": literal_tokens(p)} for p, v in patterns]
    if bare := [r["rule"] for r in rows if not r["tokens"]]:
        raise ValueError(f"no literal token bounds these rules, so no token can fetch them: {bare}")
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), ASCII_UPPER, ASCII_LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def url_tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(address, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def file_rules(addresses: DataFrame, rules: list[dict]) -> list[dict]:
    """Give each rule its rarest token, by the number of addresses that hold it.

    One pass counts the rules' own tokens only, so what is broadcast and what comes to the driver is bounded by the rule list.
    """
    tokens = addresses.sparkSession.createDataFrame(sorted({(t,) for r in rules for t in r["tokens"]}), "token string")
    held = addresses.select(F.explode(url_tokens(F.col("address"))).alias("token")).join(F.broadcast(tokens), "token")
    counts = dict(map(tuple, held.groupBy("token").count().collect()))
    return [{k: v for k, v in r.items() if k != "tokens"} | {"token": min(r["tokens"], key=lambda t: (counts.get(t, 0), t))} for r in rules]


#: A rule in the table; the first three decide between rules that fit.
RULE = "kind: int, length: int, host_length: int, rule: string, verdict: string, regex: string, token: string"


def filed(rules: list[dict]) -> tuple[Column, int]:
    """(buckets of rules by the CRC of their token, number of buckets)."""
    n = 1 << (2 * len(rules)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for r in rules:
        buckets[crc32(r["token"].encode()) % n].append(r)
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{RULE}>>>"), n


def judge_urls(pages: DataFrame, listed=LIST, patterns=PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, matched) for every row; ``matched`` is the rule or pattern that decided."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("address", F.concat("host", "path"))
    buckets, n = filed(file_rules(urls, rule_rows(listed, patterns)))
    fits = lambda t: F.filter(F.get(buckets, F.pmod(F.crc32(t.cast("binary")), F.lit(n)).cast("int")), lambda r: (r["token"] == t) & F.rlike(F.col("address"), r["regex"]))
    best = urls.withColumn("best", F.array_max(F.flatten(F.transform(url_tokens(F.col("address")), fits))))
    return best.select(
        "id", "host", "path", F.when(F.col("best.kind") == 2, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.col("best.rule").alias("matched"),
    )


def op3_url_filters(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _sql() -> str:
    rows = [r for r in rule_rows()]
    cases = lambda rows, what: "CASE " + " ".join(f"WHEN regexp_matches(address, '{r['regex']}') THEN '{r[what]}'" for r in sorted(rows, key=lambda r: (-r["kind"], -r["length"], -r["host_length"]))) + " END"
    return rf"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS s FROM pages),
v AS (SELECT page_id, translate(s.h, '{ASCII_UPPER}', '{ASCII_LOWER}') AS host, s.p AS path FROM u),
w AS (SELECT *, host || path AS address FROM v)
SELECT page_id, host, path, {cases([r for r in rows if r["kind"] == 2], "rule")} AS rule, coalesce({cases(rows, "verdict")}, 'allow') AS verdict FROM w
"""


OP3_SQL = _sql()
