"""Byte-level BPE with word ends, encoded through a segment tree over pair ranks.

Every adjacent pair of symbols of a word has the rank of its merge (infinite if there is none).
A segment tree over the pairs gives, at its root, the leftmost pair of the lowest rank; a merge
blanks one leaf and renews its two neighbours, each in logarithmic time, until the root is
infinite. A very long word therefore takes n log n steps. Nodes have 16 children, so in a word of at
most 16 pairs the leaves are the root's children: a tree of one level, whose minimum is a scan of at
most 16 values. Each worker keeps the result of the words it has met in a bounded table.

Null, empty: no tokens, the decoded text is empty. Texts of white space only: the same. Special
strings of the vocabulary in a text become their own token, as in the library. Repeated rows
and repeated ids give a row each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the Unicode property White_Space holds.
WHITE = r"\u0009-\u000d \u0085   -     　"
#: Python also takes these for white space.
SEPARATORS = regex.compile(r"[\u001c-\u001f]")
#: Runs between white space, and words, that a worker keeps encoded.
CACHE = 400_000
#: Characters of the longest run that is kept.
KEEP = 64
#: Rank of a pair that does not merge, and the node that holds it.
NEVER = 1 << 30
NONE = NEVER << 32
#: Characters from here on need the tables of all Unicode; below it none is unassigned.
WIDE = 0x250


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def of_category(group: str, below: int = 0x110000) -> str:
    """The characters of a general category, as ranges of a character class.

    Unicode's versions differ in the newest letters, so the tables of the library's own
    expression engine are asked.
    """
    from tokenizers import Regex, pre_tokenizers

    chars = [c for c in range(1, below) if not 0xD800 <= c < 0xE000]
    runs = pre_tokenizers.Split(Regex(rf"\p{{{group}}}+"), "removed", invert=True).pre_tokenize_str("".join(map(chr, chars)))
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in runs)


def newest_lower() -> dict[int, str]:
    """Lower case, by the library, of characters that Python's own tables do not have yet."""
    from tokenizers import normalizers

    new = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    low = normalizers.Lowercase().normalize_str("\n".join(new)).split("\n")
    return {ord(c): d for c, d in zip(new, low, strict=True) if c != d}


def with_classes(split: str, below: int) -> str:
    """The expression with its categories spelt out for characters below a limit."""
    for group in "LN":
        split = split.replace(rf"[\p{{{group}}}]", f"[{of_category(group, below)}]").replace(rf"\p{{{group}}}", of_category(group, below))
    return split.replace(r"[^\s", f"[^{WHITE}")


class PairTree:
    """Segment tree over pair ranks: the root is the lowest rank, leftmost on ties.

    A node is rank << 32 | leaf, so that the plain minimum of its children decides both. Nodes
    have ``FAN`` children; those of the root are ``top``. Short words have no level in between.
    """

    SHIFT = 4
    FAN = 1 << SHIFT

    def __init__(self, ranks: list[int]):
        self.leaves = level = [r << 32 | k for k, r in enumerate(ranks)]
        self.levels = [level]
        while len(level) > self.FAN:
            level = [min(level[k : k + self.FAN]) for k in range(0, len(level), self.FAN)]
            self.levels.append(level)
        self.top = level

    def renew(self, leaf: int) -> None:
        """Carries a changed leaf up to the root's children."""
        below = self.leaves
        for level in self.levels[1:]:
            leaf >>= self.SHIFT
            least = min(below[leaf << self.SHIFT : leaf + 1 << self.SHIFT])
            if level[leaf] == least:
                return
            level[leaf] = least
            below = level


class Known(dict):
    """Results of a function by its argument, a bounded number of them."""

    def __init__(self, make):
        self.make, self.most = make, CACHE

    def __missing__(self, chunk: str):
        out = self.make(chunk)
        if len(chunk) <= KEEP:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


class Vocabulary:
    """A tokenizer file of the ``tokenizers`` library: BPE, byte level, a suffix at word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [self.ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.digits = {i: str(i) for i in (*self.ids.values(), *self.special.values())}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        self.first, self.final = [self.ids.get(x) for x in symbols], [self.ids.get(x + self.suffix) for x in symbols]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # one expression by the largest character: small classes are quick
        self.split = split
        self.pieces = [(chr(below - 1), regex.compile(with_classes(split, below))) for below in (0x80, WIDE)]
        self.white = regex.compile(f"[{WHITE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Known(self._chunk)
        self.words = Known(self._word)

    @cached_property
    def wide(self) -> regex.Pattern:
        """The expression for all characters, built when a worker meets one that needs it."""
        return regex.compile(with_classes(self.split, 0x110000))

    @cached_property
    def newest(self) -> dict[int, str]:
        return newest_lower()

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word, merged through the tree of its pair ranks."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [i for b in raw[:-1] if (i := self.first[b]) is not None]
        if (i := self.final[raw[-1]]) is not None:
            ids.append(i)
        end = len(ids)
        if end < 2:
            return ids
        rank_of, merged = self.ranks.get, self.merged
        tree = PairTree([rank_of(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)])
        leaves, top = tree.leaves, tree.top
        deep = top is not leaves
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while (root := min(top)) < NONE:
            at = left = root & 0xFFFFFFFF
            new = ids[at] = merged[root >> 32]
            gone = after[at]
            ids[gone] = -1
            nxt = after[at] = after[gone]
            if nxt < end:
                before[nxt] = at
                leaves[at] = rank_of(new << 32 | ids[nxt], NEVER) << 32 | at
            else:
                leaves[at] = NONE
            if gone < end - 1:
                leaves[gone] = NONE
            if at:
                left = before[at]
                leaves[left] = rank_of(ids[left] << 32 | new, NEVER) << 32 | left
            if deep:
                tree.renew(left)
                tree.renew(at)
                if gone < end - 1:
                    tree.renew(gone)
        return [i for i in ids if i >= 0]

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # each character for itself: no other form of the sigma at a word's end
        text = unicodedata.normalize("NFC", text)
        if max(text) < chr(WIDE):
            return text.lower()
        return text.translate(self.newest).replace("Σ", "σ").lower()

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.word_ids(word)
        return len(ids), " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the decoded tokens of a run without white space."""
        if chunk.isascii():
            text = chunk.lower()
            if text.isalpha():
                return self.words[text]
            found = self.pieces[0][1].findall(text)
        else:
            text = self.normal(chunk)
            top = max(text, default="")
            found = next((p for last, p in self.pieces if top <= last), None)
            found = (found or self.wide).findall(text)
        parts = [p for p in map(self.words.__getitem__, found) if p[0]]
        if len(parts) == 1:
            return parts[0]
        n, ids, names = zip(*parts, strict=True) if parts else ((), (), ())
        return sum(n), " ".join(ids), " ".join(names)

    def parts(self, text: str | None) -> list[tuple[int, str, str]]:
        """Number of ids, ids and decoded tokens (joined by spaces) of each run that has any."""
        if not text:
            return []
        if self.cut and any(map(text.__contains__, self.special)):
            runs = self.cut.split(text)
            if len(runs) > 1:
                return [p for k, run in enumerate(runs) for p in ([(1, str(self.special[run]), run)] if k % 2 else self.parts(run))]
        chunks = text.split() if not SEPARATORS.search(text) else self.white.split(text)
        return [p for p in map(self.known.__getitem__, chunks) if p[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_table(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool = False, cache: int = CACHE) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256; on request ids and decoded.

    A map over the table: no shuffle, memory of one batch. ``path`` names a file that every
    executor has; without it, each worker asks the tokenizer package for its own copy. A worker
    keeps ``cache`` encoded runs during a task.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_decoded]
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * with_ids, *[pa.string()] * with_decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path or default_path())
        vocab.known.most = vocab.words.most = cache
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for text in part.column(1).to_pylist():
                    got = vocab.parts(text)
                    n, ids, decoded = zip(*got, strict=True) if got else ((), (), ())
                    ids, decoded = " ".join(ids), " ".join(decoded)
                    row = [sum(n), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()]
                    rows.append((*row, *[np.fromstring(ids, np.int32, sep=" ")] * with_ids, *[decoded] * with_decoded))
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[batch.schema.names[0], *names])
        vocab.known.clear()  # the worker may go on to other tasks
        vocab.words.clear()

    given = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = given.schema[id_col].dataType.simpleString()
    more = ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    return given.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
