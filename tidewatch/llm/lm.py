"""Scoring of whole texts by a causal self-attention model and corpus counts.

Tokens are words and one end per text. A text's probability is the product over its tokens of
P(class of the token | tokens before it) * P(token | class):

* the first factor is the attention model's (see ``attention``), over overlapping windows of 32 positions of which each
  position is scored once, with 8 or more positions of context except at the start of a text;
* the second one is (c + 0.1) / (C + 0.1 * (V + 1)), with the counts of the whole training part: the token's, its class's, and
  the distinct tokens of its class.

A position of the model is a word, seen through two subword ids, its hashed first four and last three bytes. The class
of a word follows from the first one: the most frequent ones have a class each, the others are grouped by the frequent ones they
stand with (k-means), so that a class is, above all, a language.

How it runs. One pass cuts the texts into blocks of about ``BLOCK_BYTES`` and writes, per block, its words as
numbers of its own vocabulary, and one row per word of that vocabulary. Everything later reads that table: the corpus counts (one row
per block and word, however often it stands there), the model's training, and the scoring, for which each block gets the counts of
its vocabulary by a join. A word that stands in every block costs one row a block; nothing that grows is broadcast.
The model is trained in ``ROUNDS`` passes, which step over every training window once: in each, a task steps over one share of its
windows, and the weights are averaged, rows of subwords by how often a task met them. All training texts say which words stand together. What the driver sees has the size of the model.

Rows whose id's crc32 has the remainder 0 are held out: they are scored but add no count and no step. A null text is
empty; an empty text is one end. A null id is held out. Every row gives a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.attention import BY_ROW, CLASSES, HEADS, PARTS, TAILS, AttentionModel, windows
from tidewatch.llm.langid import fold
from tidewatch.llm.words import U64, Words, mix, text_slices, white_space
from tidewatch.runtime import materialize

FOLDS = 10
SMOOTHING = 0.1
BLOCK_BYTES = 8 << 20
# Training passes; each steps over another one of as many shares of the windows, so that all of them are stepped over once.
ROUNDS = 1
OWN_CLASS = 47
END = 0

BLOCKS = (
    "block long, docs array<struct<doc_id: long, held: boolean, n: int>>, words binary, heads binary, tails binary, idx int, hash long, head int, seen int"
)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def subword_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the first four and the last three bytes of each word."""
    head, tail = np.zeros(len(starts), U64), np.zeros(len(starts), U64)
    for k in range(4):
        at = starts + k
        head = head << U64(8) | np.where(at < ends, lower[data[np.minimum(at, len(data) - 1)]], 0).astype(U64)
    for k in range(3):
        at = ends - 1 - k
        tail = tail << U64(8) | np.where(at >= starts, lower[data[np.maximum(at, 0)]], 0).astype(U64)
    return (mix(head) % U64(HEADS)).astype(np.int16), (mix(tail) % U64(TAILS)).astype(np.int16)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text, held`` to one row per block and one per word of its vocabulary."""
    words = Words(white_space())
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    task, serial = TaskContext.get().partitionId(), 0
    docs, held_words, size = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal serial, docs, held_words, size
        number = task << 32 | serial
        serial += 1
        hashed, heads, tails = (np.concatenate([w[k] for w in held_words]) for k in range(3))
        vocabulary, first, idx = np.unique(hashed, return_index=True, return_inverse=True)
        train = np.repeat(np.array([not d["held"] for d in docs], bool), [d["n"] for d in docs])
        seen = np.bincount(idx[train], minlength=len(vocabulary)).astype(np.int32)
        # frequent words get small numbers, which pack better
        rank = np.argsort(-np.bincount(idx, minlength=len(vocabulary)), kind="stable")
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        v = len(vocabulary)
        h, t = heads[first][rank], tails[first][rank]
        none = [None] * v
        columns = {
            "block": pa.array(np.full(v + 1, number, np.int64)),
            "docs": pa.array([docs, *none], pa.list_(pa.struct([("doc_id", pa.int64()), ("held", pa.bool_()), ("n", pa.int32())]))),
            "words": pa.array([_pack(place[idx]), *none], pa.binary()),
            "heads": pa.array([_pack(h), *none], pa.binary()),
            "tails": pa.array([_pack(t), *none], pa.binary()),
            "idx": pa.array(np.r_[v, np.arange(v)].astype(np.int32)),
            "hash": pa.array(np.r_[np.int64(0), vocabulary[rank].view(np.int64)]),
            "head": pa.array(np.r_[0, h].astype(np.int32)),
            "seen": pa.array(np.r_[0, seen[rank]].astype(np.int32)),
        }
        docs, held_words, size = [], [], 0
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    for batch in batches:
        ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for first, last, data, offsets in text_slices(batch.column(1)):
            if docs and size + len(data) > BLOCK_BYTES:
                yield flush()
            starts, ends, doc = words.bounds(data, offsets)
            n = np.bincount(doc, minlength=last - first)
            docs += [{"doc_id": i, "held": x, "n": int(k)} for i, x, k in zip(ids[first:last], held[first:last], n, strict=True)]
            held_words.append((words.hashes(data, starts, ends), *subword_ids(data, starts, ends, lower)))
            size += len(data)
    if docs:
        yield flush()


class Block:
    """One block's texts as sequences of a start and its words, each position asking for the next word or the end."""

    def __init__(self, row: dict) -> None:
        self.ids = [d["doc_id"] for d in row["docs"]]
        self.held = np.array([d["held"] for d in row["docs"]], bool)
        self.n = np.array([d["n"] for d in row["docs"]], np.int64)
        self.words = _unpack(row["words"], np.int32, int(self.n.sum()))
        v = row["idx"]
        self.heads, self.tails = _unpack(row["heads"], np.int16, v), _unpack(row["tails"], np.int16, v)
        self.sizes = self.n + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        inner = np.ones(total, bool)
        inner[self.first] = False
        self.inner = np.flatnonzero(inner)
        last = np.ones(total, bool)
        last[self.first + self.n] = False
        self.asks_word = np.flatnonzero(last)

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        head, tail = np.full(int(self.sizes.sum()), HEADS), np.full(int(self.sizes.sum()), TAILS)
        head[self.inner], tail[self.inner] = self.heads[self.words], self.tails[self.words]
        return head, tail

    def wanted(self, classes: np.ndarray) -> np.ndarray:
        out = np.full(int(self.sizes.sum()), END)
        out[self.asks_word] = classes[self.heads[self.words]]
        return out


BLOCK_COLUMNS = ["block", "docs", "words", "heads", "tails", "idx"]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row["block"], Block(row)


def _together(frequent: np.ndarray):
    """How often the words of each head stand in one text with those of the frequent heads."""
    number = np.full(HEADS, -1)
    number[frequent] = np.arange(len(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((HEADS, len(frequent)))
        for _, b in _blocks_of(batches):
            heads = b.heads[b.words]
            ends = np.cumsum(b.n)
            for k in np.flatnonzero(~b.held).tolist():
                own = heads[ends[k] - b.n[k] : ends[k]]
                near = number[own]
                counts = np.bincount(near[near >= 0], minlength=len(frequent)).astype(float)
                if counts.any():
                    found, times = np.unique(own, return_counts=True)
                    sums[found] += times[:, None] * (counts / counts.sum())
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some].tolist(), pa.list_(pa.float64()))], ["head", "near"])

    return run


def _summed(rows: DataFrame, keys: list[str], values: str, weight: str | None = None) -> DataFrame:
    """Arrays added place by place (weighted means where there is a weight); partial sums go through the shuffle."""
    flat = rows.select(*keys, *([weight] if weight else []), F.posexplode(values).alias("pos", "x"))
    if weight:
        total = F.sum(F.col("x") * F.col(weight)) / F.sum(weight)
    else:
        total = F.sum("x")
    return flat.groupBy(*keys, "pos").agg(total.alias("x"))


def class_map(counts: np.ndarray, near: np.ndarray, frequent: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each head: the frequent ones' own, else a cluster of heads with like neighbours."""
    out = np.zeros(HEADS, np.int64)
    out[frequent] = 1 + np.arange(len(frequent))
    first = 1 + len(frequent)
    rest = np.setdiff1d(np.flatnonzero(counts), frequent)
    groups = classes - first
    out[np.setdiff1d(np.arange(HEADS), np.r_[frequent, rest])] = first
    if len(rest):
        x = np.sqrt(near[rest] / np.maximum(near[rest].sum(axis=1, keepdims=True), 1e-9))
        weight = counts[rest].astype(float)
        centres = x[np.argsort(-weight, kind="stable")[:1]]
        while len(centres) < min(groups, len(rest)):
            far = weight * ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, x[far.argmax()]])
        for _ in range(15):
            own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            for k in range(len(centres)):
                if (own == k).any():
                    centres[k] = np.average(x[own == k], axis=0, weights=weight[own == k])
        out[rest] = first + own
    return out


def _trainer(model: AttentionModel, classes: np.ndarray, turn: int):
    """Steps over the turn's share of the task's windows; yields the weights it ends with and how often each was moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AttentionModel(np.ones(CLASSES) / CLASSES)
        own.params = {k: v.copy() for k, v in model.params.items()}
        used = {k: np.zeros(len(v)) for k, v in own.params.items()}
        squares = {k: np.zeros_like(v) for k, v in own.params.items()}
        for block, b in _blocks_of(batches):
            (head, tail), wanted = b.inputs(), b.wanted(classes)
            train = np.flatnonzero(~b.held)
            w = windows(b.sizes[train], b.first[train])
            draw = mix(np.arange(len(w.at), dtype=U64) + mix(np.array([block + 1], U64))) % U64(ROUNDS)
            some = np.flatnonzero(draw == turn)
            some = some[np.argsort(mix(some.astype(U64)), kind="stable")]
            w.at, w.live, w.scored = w.at[some], w.live[some], w.scored[some]
            own.fit(head, tail, wanted, w, used, squares)
        part, row, weight, values = [], [], [], []
        for k, name in enumerate(PARTS):
            if name in BY_ROW:
                rows = np.flatnonzero(used[name])
                part += [k] * len(rows)
                row += rows.tolist()
                weight += used[name][rows].tolist()
                values += own.params[name][rows].tolist()
            elif used[name].any():
                part.append(k)
                row.append(0)
                weight.append(float(used[name][0]))
                values.append(own.params[name].ravel().tolist())
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((part, row, weight, values), kinds, strict=True)], ["part", "row", "weight", "vals"])

    return run


def _averaged(model: AttentionModel, rows: DataFrame) -> None:
    """Puts the mean weights of all tasks into the model."""
    means = _summed(rows, ["part", "row"], "vals", "weight").toPandas()
    for k, group in means.groupby("part"):
        name = PARTS[k]
        target = model.params[name]
        if name in BY_ROW:
            target[group["row"].to_numpy(), group["pos"].to_numpy()] = group["x"].to_numpy()
        else:
            target.ravel()[group["pos"].to_numpy()] = group["x"].to_numpy()


class Scale:
    """Corpus totals: of all training tokens and by class."""

    def __init__(self, totals: list, train_docs: int, classes: np.ndarray) -> None:
        self.ends = train_docs
        self.tokens = sum(r["c"] for r in totals) + train_docs
        self.distinct = sum(r["v"] for r in totals) + (train_docs > 0)
        self.c, self.v = np.zeros(CLASSES), np.zeros(CLASSES)
        self.c[END], self.v[END] = train_docs, train_docs > 0
        for r in totals:
            self.c[classes[r["head"]]] += r["c"]
            self.v[classes[r["head"]]] += r["v"]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTHING) / (self.tokens + SMOOTHING * (self.distinct + 1)))

    def within(self, c: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTHING) / (self.c[of] + SMOOTHING * (self.v[of] + 1)))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(model: AttentionModel, classes: np.ndarray, scale: Scale):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for _, b in _blocks_of(left.to_batches()):
            counts = np.zeros(len(b.heads))
            counts[right.column("place").to_numpy()] = right.column("c").to_numpy()
            of = classes[b.heads]
            base, within = scale.base(counts), scale.within(counts, of)
            (head, tail), wanted = b.inputs(), b.wanted(classes)
            of_classes = model.class_scores(head, tail, wanted, windows(b.sizes, b.first))
            ends = np.cumsum(b.n)
            add = lambda x, e: np.r_[0.0, np.cumsum(x)][e] - np.r_[0.0, np.cumsum(x)][e - b.n]
            end = np.array([float(scale.ends)])
            known = add((counts > 0)[b.words].astype(float), ends) + (scale.ends > 0)
            scores = np.add.reduceat(of_classes, b.first) + add(within[b.words], ends) + scale.within(end, np.array([END]))[0]
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(b.ids, pa.int64()),
                        "held_out": pa.array(b.held),
                        "n_tokens": pa.array(b.sizes),
                        "n_known": pa.array(np.rint(known).astype(np.int64)),
                        "train_tokens": pa.array(np.full(len(b.n), scale.tokens, np.int64)),
                        "base_score": pa.array(add(base[b.words], ends) + scale.base(end)[0]),
                        "score": pa.array(scores),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({c.split()[0]: [] for c in SCORED.split(", ")}).cast(_SCHEMA)

    return run


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())]
)


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row; ids must be whole numbers."""
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    named = named.withColumn("held", fold("doc_id", FOLDS) == 0)
    cells = materialize(named.mapInArrow(_to_blocks, BLOCKS), "blocks")
    blocks = cells.filter("words is not null").select(*BLOCK_COLUMNS)
    vocabulary = cells.filter("words is null")
    counts = materialize(vocabulary.filter("seen > 0").groupBy("hash").agg(F.sum("seen").alias("c"), F.first("head").alias("head")), "counts")
    totals = counts.groupBy("head").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    train_docs = named.filter(~F.col("held")).count()
    by_head = np.zeros(HEADS)
    for r in totals:
        by_head[r["head"]] = r["c"]
    frequent = np.argsort(-by_head, kind="stable")[:OWN_CLASS]
    near = np.zeros((HEADS, OWN_CLASS))
    for r in _summed(blocks.mapInArrow(_together(frequent), "head int, near array<double>"), ["head"], "near").toPandas().itertuples():
        near[r.head, r.pos] = r.x
    classes = class_map(by_head, near, frequent)
    scale = Scale(totals, train_docs, classes)
    model = AttentionModel((scale.c + SMOOTHING) / (scale.c + SMOOTHING).sum())
    for turn in range(ROUNDS):
        moved = blocks.mapInArrow(_trainer(model, classes, turn), "part int, row int, weight double, vals array<double>")
        _averaged(model, moved)
    wanted = vocabulary.select("block", "idx", "hash").join(counts.select("hash", "c"), "hash")
    wanted = wanted.select(F.col("block").alias("of_block"), F.col("idx").alias("place"), "c")
    return blocks.groupBy("block").cogroup(wanted.groupBy("of_block")).applyInArrow(_scorer(model, classes, scale), SCORED)


