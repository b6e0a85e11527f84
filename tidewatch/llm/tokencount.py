"""Token counts of whole texts under a byte-level BPE vocabulary with word ends.

Texts are cut into pre-tokens. New pre-tokens of a slice are merged together, rank by rank: their symbols lie
in one ragged array, and in every round each sequence merges all places of its own lowest-ranked pair at once. What
is left of a sequence is its token count. Counts of pre-tokens are remembered per task up to a fixed number of
entries and then forgotten; the memory changes the time only.

A null text is empty and has no tokens. Every row gives a row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVER = 2048
REMEMBERED = 200_000
SLICE_CHARS = 1 << 21
NONE = np.iinfo(np.int64).max

# The library's tables of characters are of other Unicode versions than Python's. Letters and numbers that the
# library takes for signs (first and last of each range), and capitals whose small letters Python may not know.
SIGN_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
SIGN_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
SMALL_LETTERS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
SMALL_LETTERS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# Below this character both know the same letters.
NEWER = re.compile("[\u0558-\U0010ffff]")


def _without(kind: str, ranges: str) -> str:
    """A character class without the given ranges."""
    left_out = "".join("-".join(f"\\U{int(end, 16):08x}" for end in r.split("-")) for r in ranges.split())
    return rf"[\p{{{kind}}}--[{left_out}]]"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(plain))
    return [names[b] for b in range(256)]


class RankMerger:
    """Counts symbols that survive all merges, for many sequences at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list, word_end: str) -> None:
        names = byte_characters()
        self.inner = np.array([vocabulary[c] for c in names], np.int64)
        self.final = np.array([vocabulary[c + word_end] for c in names], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.products = np.array([vocabulary[a + b] for a, b in pairs], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols of each (non-empty) sequence are left."""
        out = np.zeros(len(sequences), np.int64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        raw = np.frombuffer(b"".join(sequences), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[raw[ends]]
        number = np.arange(len(sequences))
        rank = np.full(len(symbols), NONE)
        rank[:-1] = self._rank(symbols[:-1], symbols[1:])
        rank[ends] = NONE
        while len(symbols):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                out[number[~live]] = sizes[~live]
                kept = np.repeat(live, sizes)
                symbols, rank = symbols[kept], rank[kept]
                number, sizes, least = number[live], sizes[live], least[live]
                if not len(symbols):
                    break
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == least[owner])
            # of places that overlap (a run of one symbol), every second one counts, from the left
            fresh = np.r_[True, np.diff(at) != 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.products[rank[at]]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            sizes = sizes - np.bincount(owner[at], minlength=len(sizes))
            moved = np.cumsum(kept) - 1
            symbols, rank = symbols[kept], rank[kept]
            last = np.cumsum(sizes) - 1
            at = moved[at]
            for place in (at, at[at > 0] - 1):
                place = place[place + 1 < len(symbols)]
                rank[place] = self._rank(symbols[place], symbols[place + 1])
            rank[last] = NONE
        return out


class TokenCounter:
    """Counts tokens as the public tokenizer file says: special strings, normaliser, pre-tokens, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        self.merger = RankMerger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pattern = regex.compile(pattern)
        pinned = pattern.replace(r"\p{L}", _without("L", SIGN_LETTERS)).replace(r"\p{N}", _without("N", SIGN_NUMBERS))
        self.pinned = regex.compile(pinned, regex.VERSION1)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.known: dict[str, int] = {}

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text, and its pre-tokens."""
        parts = self.special.split(text)
        found = []
        for part in parts:
            # one character at a time, so a capital sigma becomes the same letter wherever it stands
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            if part.isascii() or not NEWER.search(part):
                found += self.pattern.findall(part.lower())
            else:
                found += self.pinned.findall(part.translate(SMALL_LETTERS).lower())
        return len(parts) - 1, found

    def _learn(self, pieces: set[str]) -> None:
        new = sorted(pieces - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = sorted(pieces)
        for at in range(0, len(new), REMEMBERED):
            some = new[at : at + REMEMBERED]
            self.known.update(zip(some, self.merger.count([p.encode() for p in some]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        held: list[tuple[int, list[str]]] = []
        size = 0
        for text in [*texts, None]:
            if text is None or (held and size + len(text) > SLICE_CHARS):
                self._learn(set().union(*(p for _, p in held)))
                out += [n + sum(map(self.known.__getitem__, p)) for n, p in held]
                held, size = [], 0
            if text is not None:
                held.append(self._pieces(text))
                size += len(text)
        return out


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            counts = counter.count(texts)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = OVER) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row; the tokenizer file must be on every executor."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    counted = named.mapInArrow(_counter(tokenizer_path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
