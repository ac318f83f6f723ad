"""BPE encoding and decoding over a trie of distinct words.

A BPE encoding has one last token, and the encoding of a word without its last token's symbols is the encoding of that
prefix.  So a prefix is described by its last token alone: it is the one vocabulary entry that ends the prefix and whose
pair with the last token of what comes before is stable, i.e. encodes to itself.  The distinct words of a slice of texts
form a trie, walked depth-first: in sorted order a word has its path in common with the word before as far as their bytes agree,
and only the rest of the path is new.  The last tokens of the nodes on the path are all the state there is, so a prefix that many words
share is encoded once, and a word takes memory in proportion to its length.  A word's ids are read back from its end.
Which entries end a prefix is found by a trie of the vocabulary's entries read backwards.

Texts are cut into slices of ``SLICE`` characters' worth of documents for the trie; known words are kept between slices
up to ``KNOWN`` of them and ``KNOWN_BYTES`` bytes, so memory doesn't grow with the number of documents.  One document is one row,
however long, and so is a word.

Cases: a null text is empty and has no tokens; special-token strings in a text become special tokens, as in the
library; repeated rows give repeated results; null ids stay null; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read

SLICE, KNOWN, KNOWN_BYTES, PAIRS = 1 << 20, 350_000, 1 << 23, 1 << 18
WORD_END = "</w>"
#: Case pairs of Unicode 16, which the library's tables have and Python's may lack: upper-case code point, lower-case one.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
#: One coder for each vocabulary in a Python worker, so that the worker's next task knows the words of its last.
CODERS: dict[str, "WordBpe"] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary: NFC, lower case, white space dropped, words of a pattern, bytes as symbols."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        model = told["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        # Pairs by the id they merge to, and what each merged token was made of; ids rise in the order of the merges.
        self.made = {self.vocab[a] << 17 | self.vocab[b]: self.vocab[a + b] for a, b in merges}
        self.parts = {self.vocab[a + b]: (self.vocab[a], self.vocab[b]) for a, b in reversed(merges)}
        if list(self.made.values()) != sorted(self.made.values()) or len(self.vocab) > 1 << 17:
            raise ValueError("the vocabulary's ids don't rise in the order of its merges")
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        self.digits = {i: str(i) for i in self.token}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.stable: dict[int, bool] = {}
        # The entries backwards: node and byte to the next node, and the entry (or -1) that each node spells.
        # Entries that end a word start at another root.
        self.before: dict[int, int] = {}
        self.spells = [-1, -1]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        for token, i in self.vocab.items():
            spelt, node = token.removesuffix(WORD_END), int(token.endswith(WORD_END))
            for c in reversed(spelt if all(c in byte_of for c in spelt) else ""):
                node = self.before.setdefault(node << 8 | byte_of[c], len(self.spells))
                if node == len(self.spells):
                    self.spells.append(-1)
            self.spells[node] = i if node > 1 else -1
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.held = 0

    def fits(self, pair: int) -> bool:
        """Does a pair of tokens encode to itself?

        Undo the two tokens' merges from the last one back.  At each point, a merge across the border that comes before
        the next undone one would have been made instead; if there never is one, the border stays.
        """
        left, right = pair >> 17, pair & 0x1FFFF
        bound, made, parts = 1 << 30, self.made, self.parts
        while True:
            over = made.get(left << 17 | right)
            if over is not None and over < bound:
                return False
            if left in parts and (left > right or right not in parts):
                bound, left = left, parts[left][1]
            elif right in parts:
                # Of equal merges the left one is made first, so one across the border goes before the right token's.
                bound, right = right + 1, parts[right][0]
            else:
                return True

    def last_token(self, data: bytes, n: int, node: int, last: list[int]) -> tuple[int, int]:
        """(id, start) of the last token of the first ``n`` bytes, from those of its prefixes (``last``, by length)."""
        before, spells, known = self.before.get, self.spells, self.stable
        at = n
        while at:
            at -= 1
            node = before(node << 8 | data[at])
            if node is None:
                break
            token = spells[node]
            if token >= 0:
                if not at:
                    return token, 0
                pair = last[at] << 17 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fits = known[pair] = self.fits(pair)
                if fits:
                    return token, at
        raise ValueError(f"no token ends {data[:n]!r}")

    def learn(self, words: set[str]) -> None:
        """Encode distinct words by one depth-first walk over their trie."""
        last_token, digits = self.last_token, self.digits.__getitem__
        # By length of the prefix: its last token and where that starts.
        last, starts, path = [0], [0], b""
        for data, word in sorted(((w if w.isascii() else w.translate(NEWER_LOWER)).encode(), w) for w in words):
            n, shared = len(data), 0
            for x, y in zip(data, path):
                if x != y:
                    break
                shared += 1
            path = data[:-1]  # a word's last byte is one of the word end's
            shared = min(shared, n - 1)
            del last[shared + 1 :], starts[shared + 1 :]
            for size in range(shared + 1, n):
                token, at = last_token(data, size, 0, last)
                last.append(token)
                starts.append(at)
            token, at = last_token(data, n, 1, last)
            ids = [token]
            while at:
                ids.append(last[at])
                at = starts[at]
            ids.reverse()
            self.ids_of[word] = " ".join(map(digits, ids))
            self.text_of[word] = self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own, the vocabulary's tokens are joined by spaces."""
        return " ".join(map(self.token.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        """The words of a text in order; special tokens as themselves."""
        if "<|" in text:
            out = []
            for part in self.specials.split(text):
                out += [part] if part in self.special else self.words(self.normal(part))
            return out
        return self.words(self.normal(text))

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            # Lower case is by character: a final sigma is no other letter.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encoded(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by a space, decoded text) of each text."""
        split = [self.split(t) for t in texts]
        if len(self.ids_of) > KNOWN or self.held > KNOWN_BYTES:
            self.ids_of.clear()
            self.text_of.clear()
            self.held = 0
        for content, i in self.special.items():
            self.ids_of[content], self.text_of[content] = str(i), content
        new = {w for words in split for w in words} - self.ids_of.keys()
        self.held += sum(map(len, new))
        self.learn(new)
        ids, text = self.ids_of.__getitem__, self.text_of.__getitem__
        for words in split:
            yield " ".join(map(ids, words)), " ".join(map(text, words))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (column 1) have about ``most`` bytes."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()):
            size += n
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def bpe(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, the ids themselves, for every row of ``docs``.

    ``spec`` is the content of the vocabulary's JSON file (a few MB whatever the input); it goes to the executors as a
    broadcast variable.  ``keep``: columns to carry along.
    """
    import pyarrow.compute  # noqa: F401

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    kept = "".join(f", `keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + kept

    def run(batches):
        import numpy as np
        import pyarrow.compute  # noqa: F401

        pa.default_memory_pool().release_unused()  # what the worker's earlier tasks have freed
        key = hashlib.sha256(shared.value.encode()).hexdigest()
        coder = CODERS.get(key) or CODERS.setdefault(key, WordBpe(shared.value))
        for part in slices(batches):
            counts, firsts, seconds, arrays = [], [], [], []
            for found, text in coder.encoded([t or "" for t in part.column(1).to_pylist()]):
                counts.append(found.count(" ") + 1 if found else 0)
                firsts.append(hashlib.sha256(found.encode()).hexdigest())
                seconds.append(hashlib.sha256(text.encode()).hexdigest())
                if ids:
                    arrays.append(np.array(found.split(), dtype=np.int32))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(firsts, pa.string()), pa.array(seconds, pa.string())]
            if ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.array([], np.int32))))
            columns += part.columns[2:]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *(f"keep_{c}" for c in keep)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = given.mapInArrow(run, schema)
    return out.select("id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *(F.col(f"keep_{c}").alias(c) for c in keep))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark, sf_dir):
    return bpe(read(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")
