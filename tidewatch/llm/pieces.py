"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file is compiled once into a transducer over characters:

* normaliser: a space becomes the visible space, and a text gets one in front;
* pieces: a trie, each of whose final states outputs a piece;
* byte fallback: a character without a piece outputs the pieces of its bytes.

An input is composed with it into a lattice of arcs between character positions, and the shortest path in the tropical
semiring is the encoding. In a unigram model an arc weighs minus its piece's score. In a BPE model an arc's weight depends
on the arc before it: 0 where merging the characters of both by falling score gives these two pieces again, else
infinity. A path of finite weight then exists exactly once, and it is the sequence of merges of the whole text: the first merge
across a border of a path would also be made in the pair on its two sides alone.

Texts are composed in units between places that no piece reaches across; units met before are remembered per task, up
to a fixed number: when as many are held, they become the older half and a unit met again moves to the newer one, so frequent
units stay. That changes the time only.

A null text is empty; an empty text has no pieces. Every row gives a row, in all its columns.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Units and pairs of pieces in each half of what a task remembers.
REMEMBERED, REMEMBERED_PAIRS = 300_000, 400_000
SLICE_CHARS = 1 << 21
# Longer units are composed from the left, without recursion.
SHORT_UNIT = 64
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
INFINITY = float("inf")


class PieceTransducer:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError(f"{path}: only unigram and BPE models with an identity normaliser")
        self.bpe = model.trainer_spec.model_type == BPE
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError(f"{path}: a piece goes on behind a space")
        self.units = regex.compile(self._borders())
        self.trie = self._compile()
        self.lowest = min(self.scores) - 10.0
        self.by_name = {name: self.scores[i] for name, i in self.ids.items()}
        sizes: dict[str, set[int]] = {}
        for name in self.ids:
            sizes.setdefault(name[-1], {1}).add(len(name))
        self.sizes = {c: tuple(sorted(n, reverse=True)) for c, n in sizes.items()}
        self.derived: dict[str, list[tuple[float, str, str]] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.older_fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _borders(self) -> str:
        """The pattern of a unit: text between places that no piece reaches across.

        Such places lie before a run of spaces, around a line end that no piece holds, and, where no piece joins
        a letter to another kind of character, between letters and others.
        """
        cut = "" if any("\n" in name for name in self.ids) else "\n"
        joins = regex.compile(r"[\p{L}\p{M}][^\p{L}\p{M}]|[^\p{L}\p{M}" + SPACE + r"][\p{L}\p{M}]")
        letters = r"\p{L}\p{M}"
        kinds = [rf"[^{SPACE}{cut}]+"] if any(map(joins.search, self.ids)) else [f"[{letters}]+", f"[^{letters}{SPACE}{cut}]+"]
        return "|".join([*([cut] if cut else []), *(f"{SPACE}*{kind}" for kind in kinds), f"{SPACE}+"])

    def _compile(self) -> dict:
        """States as dictionaries; the key '' of a final state holds its piece's id."""
        root: dict = {}
        for name, i in self.ids.items():
            state = root
            for c in name:
                state = state.setdefault(c, {})
            state[""] = i
        return root

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def arcs(self, text: str, at: int) -> Iterator[tuple[int, str, tuple[int, ...]]]:
        """``end, surface, ids`` of the composition's arcs that leave a position."""
        state = self.trie
        single = False
        for end in range(at, len(text)):
            state = state.get(text[end])
            if state is None:
                break
            if "" in state:
                single = single or end == at
                yield end + 1, text[at : end + 1], (state[""],)
        if not single:
            c = text[at]
            yield at + 1, c, self._fallback(c)

    def _derivation(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, in order: score, first and last symbol after it."""
        if piece in self.derived:
            return self.derived[piece]
        parts, steps = list(piece), []
        while len(parts) > 1:
            best, place = -INFINITY, -1
            for k in range(len(parts) - 1):
                score = self.by_name.get(parts[k] + parts[k + 1], -INFINITY)
                if score > best:
                    best, place = score, k
            if place < 0:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
            steps.append((best, parts[0], parts[-1]))
        self.derived[piece] = steps if len(parts) == 1 else None
        return self.derived[piece]

    def _fits(self, before: str, piece: str) -> bool:
        """Whether two pieces may follow one another in a BPE model ('' before the first one).

        The merges of both sides take turns by falling score; the pair fits if at no turn the merge
        across the border comes first.
        """
        key = (before, piece)
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) >= REMEMBERED_PAIRS:
            self.older_fits, self.fits = self.fits, {}
        known = self.older_fits.get(key)
        if known is not None:
            self.fits[key] = known
            return known
        left, right = self._derivation(before) if before else [], self._derivation(piece)
        known = left is not None and right is not None
        if known and before:
            i, j, edge, start = 0, 0, before[-1], piece[0]
            while True:
                a = left[i][0] if i < len(left) else -INFINITY
                b = right[j][0] if j < len(right) else -INFINITY
                across = self.by_name.get(edge + start, -INFINITY)
                if across > a and across >= b:
                    known = False
                    break
                if a == b == -INFINITY:
                    break
                if a >= b:
                    edge = left[i][2]
                    i += 1
                else:
                    start = right[j][1]
                    j += 1
        self.fits[key] = known
        return known

    def _last_piece(self, text: str, end: int, last: list[str | None]) -> str:
        """The surface of the one arc of finite weight that enters a position, expanding only the states it needs."""
        known = last[end]
        if known is not None:
            return known
        fits, ids = self.fits, self.ids
        for size in self.sizes.get(text[end - 1], (1,)):
            if size > end:
                continue
            surface = text[end - size : end]
            if size > 1 and surface not in ids:
                continue
            before = self._last_piece(text, end - size, last)
            fit = fits.get((before, surface))
            if self._fits(before, surface) if fit is None else fit:
                last[end] = surface
                return surface
        raise AssertionError("every position is reached by one arc")

    def _on_demand(self, text: str) -> list[int]:
        """The shortest path of a BPE model in a composition expanded from its final state."""
        last: list[str | None] = [""] + [None] * len(text)
        out: list[int] = []
        end = len(text)
        while end:
            surface = self._last_piece(text, end, last)
            out[:0] = (self.ids[surface],) if surface in self.ids else self._fallback(surface)
            end -= len(surface)
        return out

    def _fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in c.encode()) if self.bytes else (self.unknown,)

    def shortest_path(self, text: str) -> list[int]:
        """The ids on the path of least weight through the lattice of a unit."""
        n = len(text)
        if self.bpe and n <= SHORT_UNIT:
            return self._on_demand(text)
        weight = [INFINITY] * (n + 1)
        back: list[tuple[int, tuple[int, ...]] | None] = [None] * (n + 1)
        last = [""] * (n + 1)
        weight[0] = 0.0
        fits = self.fits
        for at in range(n):
            if weight[at] == INFINITY:
                continue
            for end, surface, ids in self.arcs(text, at):
                if self.bpe:
                    if weight[end] == 0.0:
                        continue
                    fit = fits.get((last[at], surface))
                    w = 0.0 if (self._fits(last[at], surface) if fit is None else fit) else INFINITY
                else:
                    w = weight[at] - (self.scores[ids[0]] if surface in self.ids else self.lowest)
                if w < weight[end]:
                    weight[end], back[end], last[end] = w, (at, ids), surface
        out: list[int] = []
        at = n
        while at:
            at, ids = back[at]
            out[:0] = ids
        return out

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        units = self.units.findall(self.normalise(text))
        for unit in set(units).difference(known):
            path = older.get(unit)
            known[unit] = array("i", self.shortest_path(unit)).tobytes() if path is None else path
        return np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32)

    def decode(self, ids) -> str:
        out = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                out.append(int(self.names[i][3:5], 16))
            elif kind in (NORMAL, USER_DEFINED):
                out += self.names[i].encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def surfaces(self) -> list[bytes]:
        """The bytes each id writes, for decoding many ids at once."""
        out = []
        for name, kind in zip(self.names, self.kinds, strict=True):
            out.append(bytes([int(name[3:5], 16)]) if kind == BYTE else name.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"")
        return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > SLICE_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    yield first, len(texts)


def _surfaces(machine: PieceTransducer) -> pa.Array:
    """The bytes each id writes, and behind them those it writes at the start of a text."""
    plain = machine.surfaces()
    return pa.array(plain + [p.removeprefix(b" ") if machine.prefix else p for p in plain], pa.large_binary())


def _read(surfaces: pa.Array, flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The texts of id sequences, one behind the other; bytes that are no UTF-8 read as the replacement character."""
    at = flat.astype(np.int64)
    # the first id of each text that writes anything
    wrote = np.append(np.flatnonzero(np.diff(np.frombuffer(surfaces.buffers()[1], np.int64, len(surfaces) + 1))[at] > 0), len(at))
    first = wrote[np.searchsorted(wrote, cuts[:-1])]
    at[np.unique(first[first < cuts[1:]])] += len(surfaces) // 2
    written = surfaces.take(pa.array(at))
    ends = np.frombuffer(written.buffers()[1], np.int64, len(at) + 1)[cuts]
    raw = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(ends), written.buffers()[2]])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string())


def _encoder(path: str, and_back: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = PieceTransducer(path)
        surfaces = _surfaces(machine)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for first, last in _slices(texts):
                ids = [machine.encode(t) for t in texts[first:last]]
                cuts, flat = np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids)
                values = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))
                columns = [batch.column(0).slice(first, last - first), values]
                if and_back:
                    columns.append(_read(surfaces, flat, cuts))
                yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "text"][: len(columns)])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = PieceTransducer(path)
        surfaces = _surfaces(machine)
        for batch in batches:
            ids = [i.values.to_numpy() if i.is_valid else np.zeros(0, np.int32) for i in batch.column(1)]
            cuts, flat = np.cumsum([0, *map(len, ids)]), np.concatenate([np.zeros(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), _read(surfaces, flat, cuts)], ["row", "text"])

    return run


def _kept(df: DataFrame, drop: str) -> F.Column:
    kept = [c for c in df.columns if c != drop]
    return F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_"))


def encode(docs: DataFrame, model_path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """The rows without their text, with the piece ids in ``ids_column``; the model file must be on every executor."""
    packed = docs.drop(ids_column) if ids_column != text_column else docs
    packed = packed.select(_kept(packed, text_column).alias("row"), F.col(text_column).cast("string").alias("text"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>"
    return packed.mapInArrow(_encoder(model_path), schema).select("row.*", F.col("ids").alias(ids_column))


def encode_and_decode(docs: DataFrame, model_path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """The rows with the piece ids in ``ids_column`` and, in ``text_column``, the text that these ids stand for."""
    packed = docs.drop(ids_column).select(_kept(docs.drop(ids_column), text_column).alias("row"), F.col(text_column).cast("string").alias("text"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, text string"
    return packed.mapInArrow(_encoder(model_path, and_back=True), schema).select("row.*", F.col("ids").alias(ids_column), F.col("text").alias(text_column))


def decode(encoded: DataFrame, model_path: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """The rows without their ids, with the text the ids stand for in ``text_column``."""
    packed = encoded.drop(text_column) if ids_column != text_column else encoded
    packed = packed.select(_kept(packed, ids_column).alias("row"), F.col(ids_column).alias("ids"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, text string"
    return packed.mapInArrow(_decoder(model_path), schema).select("row.*", F.col("text").alias(text_column))
