"""Column builders: defaults, keys, folds, ordered categories, keyword hits, escapes.

Everything stays inside whole-stage code generation.  Missing fields are null (SURVEY Q1); texts count in code points.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.vocab import CATEGORIES, REST, WATCHED


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def default(c: str | Column, value: str = "") -> Column:
    """A field or what stands for a missing one."""
    return F.coalesce(col(c), F.lit(value))


def key(c: str | Column) -> Column:
    """Identity keys are compared as strings."""
    return col(c).cast("string")


def filled(c: str | Column) -> Column:
    """Neither missing nor empty."""
    return default(c) != ""


def first_filled(*cs: str | Column, otherwise: str = "") -> Column:
    """P10: the first that is neither missing nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs), F.lit(otherwise))


def prefix(c: str | Column, n: int) -> Column:
    """P5."""
    return F.left(default(c), F.lit(n))


def spaced(*cs: str | Column) -> Column:
    """Joined by a space, missing parts as empty ones (``concat_ws`` would drop their space)."""
    out = default(cs[0])
    for c in cs[1:]:
        out = F.concat(out, F.lit(" "), default(c))
    return out


def any_word(text: Column, words: Iterable[str]) -> Column:
    """One of the words occurs."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def category(title: str | Column, categories: dict[str, list[str]] = CATEGORIES, rest: str = REST) -> Column:
    """The first category one of whose words occurs in the lower-cased title."""
    text = F.lower(default(title))
    out = None
    for name, words in categories.items():
        out = (F.when if out is None else out.when)(any_word(text, words), name)
    return F.lit(rest) if out is None else out.otherwise(rest)


def hits(text: str | Column, words: list[str] = WATCHED) -> Column:
    """All words that occur in a text, without case, in the vocabulary's order.

    The lower-cased text is a lambda's variable, so it is made once however the optimizer moves or copies the expression;
    as a projected column, a filter on the hits would lower-case the text again for every word.  Words that share a piece are looked for
    only where that piece occurs.
    """
    of = guards([w.lower() for w in words])
    number = {g: i for i, g in enumerate(dict.fromkeys(of.values()))}
    here = lambda low: F.struct(low.alias("low"), *(F.contains(low, F.lit(g)).alias(f"g{i}") for g, i in number.items()))

    def holds(s: Column, word: str) -> Column:
        guard = s[f"g{number[of[word]]}"]
        return guard if of[word] == word else guard & F.contains(s["low"], F.lit(word))

    found = lambda s: F.array_compact(F.array(*(F.when(holds(s, w.lower()), F.lit(w)) for w in words)))
    return F.transform(F.transform(F.array(F.lower(default(text))), here), found)[0]


def guards(words: list[str], least: int = 3) -> dict[str, str]:
    """For each word a piece of it, so that there are few pieces: again and again the one that most of the words left over share."""
    out, left = {}, sorted(set(words))
    while left:
        shared: dict[str, int] = {}
        for w in left:
            for piece in {w[i:j] for i in range(len(w)) for j in range(i + least, len(w) + 1)}:
                shared[piece] = shared.get(piece, 0) + 1
        best = max(shared, key=lambda p: (shared[p], len(p), p), default="")
        here = [w for w in left if best and best in w] if shared.get(best, 0) > 1 else left
        out |= {w: best if len(here) > 1 and best in w and shared.get(best, 0) > 1 else w for w in here}
        left = [w for w in left if w not in out]
    return out


def with_hits(df, text: str | Column, words: list[str] = WATCHED, name: str = "matched_keywords"):
    """The rows that hit, with their hits: worked out once a row, where a filter on a projected column would work them out again."""
    found = hits(text, words)
    return df.select("*", F.explode(F.filter(F.array(found), lambda h: F.size(h) > 0)).alias(name))


def vendor_profile(vendor: str | Column, profiles: str | Column, vendors: list[str], names: list[str], field: str = "pp_short_name") -> Column:
    """The vendor matches without case, and one of the profiles' short names with it."""
    return any_word(F.lower(default(vendor)), vendors) & F.coalesce(F.exists(col(profiles), lambda p: any_word(default(p[field]), names)), F.lit(False))


def changed(old: str | Column, new: str | Column) -> Column:
    """Null-safe difference."""
    return ~col(old).eqNullSafe(col(new))


def fields_changed(o: str, n: str, fields: Iterable[str]) -> Column:
    """Some field differs, where missing and empty are alike."""
    pack = lambda side: F.struct(*(default(f"{side}.{f}").alias(f) for f in fields))
    return ~pack(o).eqNullSafe(pack(n))


def xml_escape(c: str | Column) -> Column:
    """P14."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip(c: str | Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def plural(n: str | Column, noun: str) -> Column:
    """P16."""
    return F.concat(col(n).cast("string"), F.lit(f" {noun}"), F.when(col(n) != 1, "s").otherwise(""))


def header_detail(change: str = "") -> Column:
    """What changed in a document, for people."""
    at = f"{change}." if change else ""
    dates = filled(f"{at}old_last_modified") & filled(f"{at}new_last_modified")
    sizes = F.col(f"{at}old_content_length").isNotNull() & F.col(f"{at}new_content_length").isNotNull()
    arrow = lambda f: F.concat(default(f"{at}old_{f}"), F.lit(" → "), default(f"{at}new_{f}"))
    return F.when(dates, arrow("last_modified")).when(sizes, F.concat(F.lit("Size: "), arrow("content_length"), F.lit(" bytes"))).otherwise("Content changed")


def fingerprint(body: str | Column, n: int = 2048) -> Column:
    """MD5 of the first bytes (not characters)."""
    return F.md5(F.substring(col(body).cast("binary"), 1, n))


def stamps(ts: str | Column) -> dict[str, Column]:
    """The three ways a time is written."""
    return {"day": F.date_format(col(ts), "yyyy-MM-dd"), "minute": F.date_format(col(ts), "yyyy-MM-dd HH:mm 'UTC'"), "long": F.date_format(col(ts), "MMMM dd, yyyy")}
