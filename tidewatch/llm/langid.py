"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A text is the mean embedding of its subwords: runs of 3 and 4 bytes inside a word, its borders included, hashed to ``BUCKETS``.
Embeddings and the softmax layer are trained by stochastic gradient descent in numpy on at most ``TRAIN_ROWS`` labelled
rows, an equal share of each language, chosen by a hash of the id; the tasks turn whole texts into subword counts and only those
reach the driver. A fifth of these rows calibrates: a temperature makes the scores probabilities, and the least score to
accept is the smallest one (``LEAST_SCORE`` at least) above which ``PRECISION`` of the calibration rows are right.

As the mean is linear, embeddings times the softmax layer is one small table, and a prediction is a sum of its rows over the whole
text. Language, source and id of a row are not inputs of its prediction.

A null text, and one without a letter, is ``und`` with score 0 and is not accepted. Rows without a language don't train.
Without any row to learn from, everything is ``und``. Every row gives a row; other columns are kept or ignored as named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import text_slices

UND = "und"
FOLDS = 5
TRAIN_ROWS = 4_000
BUCKETS, DIMENSION = 1 << 15, 16
EPOCHS, RATE, BATCH, SUBWORDS = 6, 0.5, 32, 300
PRECISION, LEAST_SCORE = 0.98, 0.4
GRAMS = (3, 4)


def letter_bytes() -> np.ndarray:
    """Each byte as a lower-case letter byte, or a space."""
    table = np.full(256, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def subwords(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of a run of texts, in order, and the bounds of each text's buckets."""
    n = len(offsets) - 1
    # a space in front of and behind every text
    at = np.arange(len(data)) + np.repeat(np.arange(n) * 2 + 1, np.diff(offsets))
    x = np.full(len(data) + 2 * n, 32, np.uint32)
    x[at] = letters[data]
    ends = offsets[1:] + 2 * np.arange(1, n + 1)
    space = x == 32
    buckets, places = [], []
    for size in GRAMS:
        m = len(x) - size + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint32)
        good = ~(space[:m] & space[1 : m + 1])
        for k in range(size):
            key = key * np.uint32(257) + x[k : m + k]
            if 0 < k < size - 1:
                good &= ~space[k : m + k]
        where = np.flatnonzero(good)
        key = key[where] * np.uint32(2654435761) + np.uint32(size * 40503)
        buckets.append(((key ^ (key >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(17)).astype(np.int32))
        places.append(where)
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    bucket, place = np.concatenate(buckets), np.concatenate(places)
    text = np.searchsorted(ends, place, side="right")
    order = np.argsort(text, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(text, minlength=n))]
    return bucket[order], cuts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, text`` to ``lang, buckets, counts``."""
    letters = letter_bytes()
    for batch in batches:
        ids, counts = [], []
        for _, _, data, offsets in text_slices(batch.column(1)):
            bucket, cuts = subwords(data, offsets, letters)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found, n = np.unique(bucket[a:b], return_counts=True)
                ids.append(found.astype(np.int32).tobytes())
                counts.append(n.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "buckets", "counts"])


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = LEAST_SCORE

    def logits(self, bucket: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Mean of the table's rows over each text's subwords, plus the bias."""
        n = len(cuts) - 1
        out = np.zeros((n, len(self.languages)))
        sizes = np.diff(cuts)
        some = np.flatnonzero(sizes)
        if len(some):
            for k in range(len(self.languages)):
                out[some, k] = np.add.reduceat(self.table[:, k][bucket], cuts[:-1][some]) / sizes[some]
        return out + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / self.temperature)
        return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 11) -> LanguageModel | None:
    """A model of ``language, buckets, counts`` rows, their order being random already."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(languages)}
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    layer, bias = rng.normal(0, 0.1, (DIMENSION, len(languages))), np.zeros(len(languages))
    shares = [c / c.sum() for _, _, c in fit]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(fit))
        for at in range(0, len(fit), BATCH):
            some = order[at : at + BATCH]
            drawn = [fit[i][1][rng.choice(len(shares[i]), SUBWORDS, p=shares[i])] for i in some]
            bucket = np.concatenate(drawn)
            mean = vectors[bucket].reshape(len(some), SUBWORDS, DIMENSION).mean(axis=1)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), [number[fit[i][0]] for i in some]] -= 1
            back = p @ layer.T / SUBWORDS
            layer -= rate * mean.T @ p / len(some)
            bias -= rate * p.mean(axis=0)
            # each subword's step is as large as if its text were alone in the batch
            np.add.at(vectors, bucket, -rate * DIMENSION * np.repeat(back, SUBWORDS, axis=0))
    model = LanguageModel(languages, (vectors @ layer).astype(np.float32), bias)
    _calibrate(model, held or fit, number)
    return model


def _calibrate(model: LanguageModel, rows: list[tuple[str, np.ndarray, np.ndarray]], number: dict[str, int]) -> None:
    z = np.array([c @ model.table[b] / c.sum() + model.bias for _, b, c in rows])
    truth = np.array([number[lang] for lang, _, _ in rows])
    best = None
    for t in np.geomspace(0.02, 4.0, 40):
        model.temperature = float(t)
        loss = -np.log(np.maximum(model.scores(z)[np.arange(len(truth)), truth], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(t))
    model.temperature = best[1]
    p = model.scores(z)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    model.least = float(max(LEAST_SCORE, score[order][good[-1]])) if len(good) and good[-1] < len(order) - 1 else LEAST_SCORE


def _predictor(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_bytes()
        for batch in batches:
            lang, score, ok = [], [], []
            for first, last, data, offsets in text_slices(batch.column(1)):
                if model is None:
                    lang += [UND] * (last - first)
                    score += [0.0] * (last - first)
                    ok += [False] * (last - first)
                    continue
                p = model.scores(model.logits(*subwords(data, offsets, letters)))
                lang += [model.languages[k] for k in p.argmax(axis=1)]
                score += p.max(axis=1).tolist()
                ok += (p.max(axis=1) >= model.least).tolist()
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["row", "lang_pred", "score", "accepted"])

    return run


def fold(id_column: str, folds: int = FOLDS):
    """The remainder that decides whether a row is held out (0) from learning; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds, F.lit(0))


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """A model of the rows that are not held out."""
    usable = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id") != 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(17)), F.lit(1 << 30))
    each = rows / len(counts)
    bound = F.lit(0)
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, int(min(1.0, each / n) * (1 << 30))).otherwise(bound)
    drawn = usable.filter(draw < bound).select("lang", "text").mapInArrow(_counted, "lang string, buckets binary, counts binary")
    found = [(r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in drawn.limit(2 * rows).collect()]
    order = np.random.default_rng(5).permutation(len(found))
    found.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    return train([found[i] for i in order])


def predict(docs: DataFrame, model: LanguageModel | None, text_column: str = "text") -> DataFrame:
    """``row`` (all columns), ``lang_pred, score, accepted``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))
    packed = packed.withColumn("row", F.struct("row", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double, accepted boolean"
    out = packed.mapInArrow(_predictor(model), schema)
    has = F.col("row.letters")
    return out.select(
        F.col("row.row").alias("row"),
        F.when(has, F.col("lang_pred")).otherwise(UND).alias("lang_pred"),
        F.when(has, F.col("score")).otherwise(0.0).alias("score"),
        (has & F.col("accepted")).alias("accepted"),
    )


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every row, from a model of the rows not held out."""
    model = learn(docs, id_column, text_column, lang_column)
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = predict(named, model)
    return found.select("row.doc_id", (fold("row.doc_id") == 0).alias("held_out"), "lang_pred", "score", "accepted")


def keep_accepted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows whose language is recognised with an accepted score, with their columns."""
    return predict(docs, learn(docs, id_column, text_column, lang_column), text_column).filter("accepted").select("row.*")
