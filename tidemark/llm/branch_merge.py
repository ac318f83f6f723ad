"""Three-way merge of two branches whose edits are decided by checksums of names.

A unit (row, column, line) of a branch is edited by ``crc32("branch:id:name") % MODULUS``, so both branches and the base
are known from the base alone and a document is merged where it stands: one map over the rows, no shuffle, no state.

1. Codes.  CRC-32 is linear over XOR.  The register after ``branch:id:`` is worked out once a document; a line's name is its number, so
   its code is that register moved on by the name's length, XOR the register that the digits alone give from zero, which all
   documents share.  The right branch's checksum is the left one's XOR a constant that depends on the length only, since the
   messages differ in the branch's name only.  All of it is numpy over the lines of a slice of documents.
2. Merge.  A line's pair of codes says what becomes of it: kept with a tail, replaced by what is inserted after it, or gone,
   and what it counts for.  These 49 outcomes are worked out once from the rules below; a document is one pass over its lines.

Rules.  Code 0 drops a row or line and empties a column, 1 and 2 append ``!`` and ``?`` to a column or line, 3 and 4 insert a line ``!`` or ``?``
after a line, or add a row with that text and the base's columns and the id ``-1 - id``.  A change on one side, or the same on both,
counts as one clean one; different ones count as one conflict and the right side's state holds.  Columns and added rows
are compared by value.  A row that one side drops counts once: as an edit-delete conflict if the other keeps it with changes, else as clean.

Cases: a null text, column or id is empty (a null id stays null in the result); an empty text has one empty line; repeated rows are merged each on its own,
and an added row stands beside a document that has its id already; a very long text takes memory in proportion to
its length; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import slices
from tidemark.llm.common import read

BRANCHES, MODULUS = ("L", "R"), 7
APPENDED = {1: "!", 2: "?"}
INSERTED = {3: "!", 4: "?"}
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
CLEAN, EDIT_EDIT, EDIT_DELETE, INSERT_INSERT = range(4)


def crc_table() -> np.ndarray:
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = (register >> 1) ^ np.where(register & 1, np.uint32(0xEDB88320), np.uint32(0))
    return register


TABLE = crc_table()


def moved(register: np.ndarray, byte: np.ndarray | int = 0) -> np.ndarray:
    """CRC registers one byte later; with a zero byte this is linear in the register."""
    return TABLE[(register ^ np.uint32(byte) if isinstance(byte, int) else register ^ byte) & 0xFF] ^ (register >> np.uint32(8))


def apart(left: str, right: str, length: int) -> int:
    """What the checksums of ``left + x`` and ``right + x`` differ by, for any ``x`` of so many bytes."""
    return zlib.crc32(left.encode() + bytes(length)) ^ zlib.crc32(right.encode() + bytes(length))


class LineNames:
    """Registers that the digits of 0, 1, ... leave when they start from zero, and how many digits there are."""

    def __init__(self):
        self.registers, self.digits = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.registers):
            number = np.arange(max(n, 1024))
            digits = np.ones(len(number), np.int64)
            while (more := number >= 10**digits).any():
                digits += more
            registers = np.zeros(len(number), np.uint32)
            for place in range(int(digits.max()) - 1, -1, -1):
                here = digits > place
                digit = (number[here] // 10**place % 10 + ord("0")).astype(np.uint32)
                registers[here] = moved(registers[here], digit)
            self.registers, self.digits = registers, digits
        return self.registers[:n], self.digits[:n]


NAMES = LineNames()


def line_codes(keys: list[str], n_lines: np.ndarray, branches: tuple[str, str], modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """The left and right codes of all lines of the documents with these keys, one after another."""
    left, right = branches
    longest = int(n_lines.max(initial=0))
    registers, digits = NAMES.first(longest)
    prefixes = np.array([zlib.crc32(f"{left}:{k}:".encode()) ^ 0xFFFFFFFF for k in keys], np.uint32)
    sizes = np.array([len(k.encode()) for k in keys], np.int64)
    document = np.repeat(np.arange(len(keys)), n_lines)
    line = np.arange(len(document)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    most = int(digits[-1]) if longest else 0
    on = [prefixes]
    for _ in range(most):
        on.append(moved(on[-1]))
    length = digits[line]
    crc = np.stack(on)[length, document] ^ registers[line] ^ np.uint32(0xFFFFFFFF)
    after = sizes[document] + length + 2  # the two colons
    constants = np.array([apart(left, right, n) for n in range(int(after.max(initial=0)) + 1)], np.uint32)
    return crc % modulus, (crc ^ constants[after]) % modulus


def name_codes(key: str, name: str, branches: tuple[str, str], modulus: int) -> tuple[int, int]:
    left, right = branches
    rest = f":{key}:{name}".encode()
    crc = zlib.crc32(rest, zlib.crc32(left.encode()))
    return crc % modulus, (crc ^ apart(left, right, len(rest))) % modulus


def settled(base, left, right, none, drop: int = EDIT_EDIT, insert: int = EDIT_EDIT) -> tuple[object, int | None]:
    """(state, what it counts as or None) of a unit with these three states; ``none``: the state of what isn't there."""
    if left == right:
        return left, None if left == base else CLEAN
    if left == base or right == base:
        return right if left == base else left, CLEAN
    return right, drop if none in (left, right) and base != none else insert if base == none else EDIT_EDIT


def line_outcomes(modulus: int) -> tuple[list[bool], list[str], np.ndarray]:
    """For each pair of codes (left * modulus + right): does the line stay, what follows its text, and its four counts.

    What is inserted after a line that is gone starts with a line break too; the caller drops it.
    """
    kept, tails, counts = [], [], np.zeros((modulus * modulus, 4), np.int64)
    for pair in range(modulus * modulus):
        codes = divmod(pair, modulus)
        line, kind = settled("", *(None if c == 0 else APPENDED.get(c, "") for c in codes), None, drop=EDIT_DELETE)
        gap, other = settled(None, *(INSERTED.get(c) for c in codes), None, insert=INSERT_INSERT)
        for k in (kind, other):
            if k is not None:
                counts[pair, k] += 1
        kept.append(line is not None)
        tails.append((line or "") + ("" if gap is None else "\n" + gap))
    return kept, tails, counts


class Merger:
    def __init__(self, columns: tuple[str, ...], branches: tuple[str, str], modulus: int):
        self.columns, self.branches, self.modulus = columns, branches, modulus
        self.kept, tails, self.counts = line_outcomes(modulus)
        self.tails, self.inserted = np.array(tails, object), [t[1:] for t in tails]
        self.gone = np.array([not k for k in self.kept])
        self.present = np.array([k or bool(t) for k, t in zip(self.kept, tails)])
        moves = [c in APPENDED or c in INSERTED or c == 0 for c in range(modulus)]
        self.moves = np.array(moves)

    def text(self, lines: list[str], pairs: np.ndarray) -> str | None:
        """One pass over the lines; null if no line is left."""
        pieces = list(map(str.__add__, lines, self.tails[pairs].tolist()))
        for i in np.flatnonzero(self.gone[pairs]).tolist():
            pieces[i] = self.inserted[pairs[i]]
        stay = self.present[pairs]
        pieces = pieces if stay.all() else list(compress(pieces, stay.tolist()))
        return "\n".join(pieces)

    def branch_text(self, lines: list[str], codes: list[int]) -> str:
        out = []
        for line, code in zip(lines, codes):
            if code:
                out.append(line + APPENDED.get(code, ""))
            if code in INSERTED:
                out.append(INSERTED[code])
        return "\n".join(out)

    def slice(self, ids: list, texts: list[str], columns: list[list[str]]) -> Iterator[tuple]:
        """(id, columns..., text, four counts) of each document and each added row."""
        keys = ["" if i is None else str(i) for i in ids]
        split = [t.split("\n") for t in texts]
        n_lines = np.array([len(x) for x in split], np.int64)
        left, right = line_codes(keys, n_lines, self.branches, self.modulus)
        pairs = (left * self.modulus + right).astype(np.int64)
        ends = np.cumsum(n_lines)
        starts = ends - n_lines
        # No document is without a line, so each has its run of counts.
        sums = np.add.reduceat(self.counts[pairs], starts) if len(ids) else []
        changes = [np.add.reduceat(self.moves[c].astype(np.int64), starts) if len(ids) else [] for c in (left, right)]
        for d, (key, lines) in enumerate(zip(keys, split)):
            base = [c[d] for c in columns]
            row = name_codes(key, "row", self.branches, self.modulus)
            sides: list[list[str]] = [[], []]
            for name, value in zip(self.columns, base):
                for side, code in zip(sides, name_codes(key, name, self.branches, self.modulus)):
                    side.append("" if code == 0 else value + APPENDED.get(code, ""))
            at = slice(starts[d], ends[d])
            count = [0, 0, 0, 0]
            if 0 in row:
                other = int(row[0] == 0)  # the side that may keep the row
                conflict = row[other] != 0 and (sides[other] != base or changes[other][d] > 0)
                count[EDIT_DELETE if conflict else CLEAN] = 1
                if conflict and other == 1:
                    yield (ids[d], *sides[1], self.branch_text(lines, right[at].tolist()), *count)
                else:
                    yield (ids[d], *(None for _ in base), None, *count)
            else:
                count = sums[d].tolist()
                merged = []
                for value, l, r in zip(base, *sides):
                    state, kind = settled(value, l, r, None)
                    merged.append(state)
                    if kind is not None:
                        count[kind] += 1
                yield (ids[d], *merged, self.text(lines, pairs[at]), *count)
            added = [INSERTED.get(c) for c in row]
            if any(added):
                text, kind = settled(None, *added, None, insert=INSERT_INSERT)
                count = [0, 0, 0, 0]
                count[kind] = 1
                yield (None if ids[d] is None else -1 - ids[d], *base, text, *count)


def merge_branches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("lang", "source"), branches: tuple[str, str] = BRANCHES, modulus: int = MODULUS) -> DataFrame:
    """(id, columns..., text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert) for every id that any of the three versions has.

    A row that isn't there after the merge has null columns and text.
    """
    if modulus <= max(INSERTED) or len(branches) != 2 or len(branches[0].encode()) != len(branches[1].encode()):
        raise ValueError("two branches with names of one length, and codes for all edits")
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate((text_col, *columns))))
    names = ["id", *(f"c{i + 1}" for i in range(len(columns))), "text", *COUNTS]
    schema = "id bigint, " + "".join(f"c{i + 1} string, " for i in range(len(columns))) + "text string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    kinds = [pa.int64(), *[pa.string()] * (len(columns) + 1), *[pa.int64()] * 4]

    def run(batches):
        import pyarrow.compute  # noqa: F401

        merger = Merger(columns, branches, modulus)
        for part in slices(batches):
            ids, texts, *rest = (c.to_pylist() for c in part.columns)
            found = list(zip(*merger.slice(ids, texts, rest)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], names=names)

    out = given.mapInArrow(run, schema)
    return out.select("id", *(F.col(f"c{i + 1}").alias(c) for i, c in enumerate(columns)), "text", *COUNTS)


def op13_branch_merge(spark, sf_dir):
    out = merge_branches(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "lang", "source", F.sha2("text", 256).alias("text_sha256"), *COUNTS)


#: CRC-32 by its rule, byte by byte over a table of 256 registers.
CRC_SQL = """
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(message: str, table: str = "t") -> str:
    """DuckDB SQL for the CRC-32 of a string's UTF-8 bytes, with ``crc_table`` joined."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode({message}))), lambda i: ('0x' || substr(hex(encode({message})), (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda a, b: xor(a >> 8, {table}[xor(a & 255, b) + 1])), 4294967295)"""


OP13_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
names AS (
  SELECT doc_id, name FROM d, (VALUES ('row'), ('lang'), ('source')) v(name)
  UNION ALL SELECT doc_id, i::VARCHAR FROM (SELECT doc_id, unnest(range(len(lines))) AS i FROM d)),
codes AS (
  SELECT doc_id, name, {crc_sql("'L:' || doc_id || ':' || name")} % 7 AS l, {crc_sql("'R:' || doc_id || ':' || name")} % 7 AS r FROM names, crc_table),
lines AS (
  SELECT d.doc_id, c.name::INT AS i, d.lines[c.name::INT + 1] AS line, l, r,
    CASE l WHEN 1 THEN '!' WHEN 2 THEN '?' WHEN 0 THEN NULL ELSE '' END AS le, CASE r WHEN 1 THEN '!' WHEN 2 THEN '?' WHEN 0 THEN NULL ELSE '' END AS re,
    CASE l WHEN 3 THEN '!' WHEN 4 THEN '?' END AS lg, CASE r WHEN 3 THEN '!' WHEN 4 THEN '?' END AS rg
  FROM codes c JOIN d USING (doc_id) WHERE c.name NOT IN ('row', 'lang', 'source')),
merged AS (
  SELECT *, CASE WHEN re IS NOT DISTINCT FROM '' THEN line || le ELSE line || re END AS m, coalesce(rg, lg) AS g,
    CASE WHEN le IS NOT DISTINCT FROM re THEN CASE WHEN l < 3 THEN 'clean' END WHEN le IS NOT DISTINCT FROM '' OR re IS NOT DISTINCT FROM '' THEN 'clean' WHEN le IS NULL OR re IS NULL THEN 'ed' ELSE 'ee' END AS lk,
    CASE WHEN lg IS NULL AND rg IS NULL THEN NULL WHEN lg IS NULL OR rg IS NULL OR lg = rg THEN 'clean' ELSE 'ii' END AS gk
  FROM lines),
texts AS (
  SELECT doc_id,
    coalesce(string_agg(CASE WHEN m IS NULL THEN g WHEN g IS NULL THEN m ELSE m || chr(10) || g END, chr(10) ORDER BY i), '') AS text,
    coalesce(string_agg(CASE WHEN re IS NULL THEN rg WHEN rg IS NULL THEN line || re ELSE line || re || chr(10) || rg END, chr(10) ORDER BY i), '') AS right_text,
    count(*) FILTER (WHERE lk = 'clean') + count(*) FILTER (WHERE gk = 'clean') AS clean, count(*) FILTER (WHERE lk = 'ee') AS ee, count(*) FILTER (WHERE lk = 'ed') AS ed, count(*) FILTER (WHERE gk = 'ii') AS ii,
    count(*) FILTER (WHERE l < 5) AS l_changes, count(*) FILTER (WHERE r < 5) AS r_changes
  FROM merged GROUP BY doc_id),
wide AS (
  SELECT doc_id, d.lang, d.source, text, right_text, clean, ee, ed, ii, l_changes, r_changes, w.l AS wl, w.r AS wr,
    CASE a.l WHEN 0 THEN '' WHEN 1 THEN d.lang || '!' WHEN 2 THEN d.lang || '?' ELSE d.lang END AS lang_l, CASE a.r WHEN 0 THEN '' WHEN 1 THEN d.lang || '!' WHEN 2 THEN d.lang || '?' ELSE d.lang END AS lang_r,
    CASE s.l WHEN 0 THEN '' WHEN 1 THEN d.source || '!' WHEN 2 THEN d.source || '?' ELSE d.source END AS source_l, CASE s.r WHEN 0 THEN '' WHEN 1 THEN d.source || '!' WHEN 2 THEN d.source || '?' ELSE d.source END AS source_r
  FROM d JOIN texts USING (doc_id) JOIN codes w USING (doc_id) JOIN codes a USING (doc_id) JOIN codes s USING (doc_id)
  WHERE w.name = 'row' AND a.name = 'lang' AND s.name = 'source'),
told AS (
  SELECT *, CASE WHEN lang_l = lang_r THEN CASE WHEN lang_l = lang THEN 'none' ELSE 'clean' END WHEN lang_l = lang OR lang_r = lang THEN 'clean' ELSE 'ee' END AS ak,
    CASE WHEN source_l = source_r THEN CASE WHEN source_l = source THEN 'none' ELSE 'clean' END WHEN source_l = source OR source_r = source THEN 'clean' ELSE 'ee' END AS sk,
    CASE WHEN wl <> 0 AND wr <> 0 THEN 'both' WHEN wl = 0 AND wr <> 0 AND (lang_r <> lang OR source_r <> source OR r_changes > 0) THEN 'right' WHEN wr = 0 AND wl <> 0 AND (lang_l <> lang OR source_l <> source OR l_changes > 0) THEN 'lost' ELSE 'gone' END AS kind
  FROM wide)
SELECT doc_id,
  CASE kind WHEN 'both' THEN CASE WHEN lang_r = lang THEN lang_l ELSE lang_r END WHEN 'right' THEN lang_r END AS lang,
  CASE kind WHEN 'both' THEN CASE WHEN source_r = source THEN source_l ELSE source_r END WHEN 'right' THEN source_r END AS source,
  CASE kind WHEN 'both' THEN sha256(text) WHEN 'right' THEN sha256(right_text) END AS text_sha256,
  CASE kind WHEN 'both' THEN clean + (ak = 'clean')::INT + (sk = 'clean')::INT WHEN 'gone' THEN 1 ELSE 0 END::BIGINT AS n_clean,
  CASE kind WHEN 'both' THEN ee + (ak = 'ee')::INT + (sk = 'ee')::INT ELSE 0 END::BIGINT AS n_edit_edit,
  CASE kind WHEN 'both' THEN ed WHEN 'gone' THEN 0 ELSE 1 END::BIGINT AS n_edit_delete,
  CASE kind WHEN 'both' THEN ii ELSE 0 END::BIGINT AS n_insert_insert
FROM told
UNION ALL
SELECT -1 - doc_id, lang, source, sha256(CASE coalesce(nullif(greatest((wr = 3)::INT, 2 * (wr = 4)::INT), 0), (wl = 3)::INT + 2 * (wl = 4)::INT) WHEN 1 THEN '!' ELSE '?' END),
  (NOT (wl IN (3, 4) AND wr IN (3, 4) AND wl <> wr))::BIGINT, 0, 0, (wl IN (3, 4) AND wr IN (3, 4) AND wl <> wr)::BIGINT
FROM told WHERE wl IN (3, 4) OR wr IN (3, 4)
"""
