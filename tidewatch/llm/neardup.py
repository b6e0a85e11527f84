"""Near-duplicate documents by fast similarity sketches, banding and exact checks.

A document is its set of word shingles. The sketch (Dahlgaard, Knudsen and Thorup 2017) throws each
shingle into one of ``COORDINATES`` bins per round; a coordinate keeps the least (round, hash) thrown
into its bin. In the last rounds every shingle goes to one given bin, so no coordinate stays empty.
``BANDS`` groups of coordinates are the keys under which documents meet.

* Documents with the same set are one class from the start, named by their smallest id.
* Hub rounds: in each bucket one member of the largest component is compared with the members that are not yet in its
  component. So a group of near copies becomes one component at the cost of one comparison a member and round.
* What is still apart is peeled, by a bound on the full sets: a document can only be linked through shingles that a candidate of
  another component has too. With k of them, a partner has at most k * (100 + 75) / 75 - size shingles; a document that no
  size suits drops out, and so on for the others.
* The rest meets in its buckets under the conditions that a link needs (sizes within both bounds, different components, and no
  more different shingles than a link allows by a lower bound from parity bits), once per pair, in the first band whose key it shares.
  Every pair that passes is checked on the full sets; no other pair is listed.
* A bucket of many documents is dealt into blocks by hash, and every pair of blocks is a group of its own.
* Hubs, peeling and conditions lose nothing. Two sets at the least similarity, 0.75, share no band with a probability of
  (1 - 0.75^4)^32 = 5e-6, more similar ones far less often.

A null or empty text, and one without words, has an empty set, no links, and is its own component. Every row gives a
row; a row without an id takes its class's component but never names one. Rows with equal ids and equal texts are
copies: each gives a row, and all are one class with one set, so they cost what one costs. Ids are expected to be unique among
different texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import U64, Words, mix, text_slices, white_space
from tidewatch.operators.components import connected_components
from tidewatch.runtime import materialize

SHINGLE_WORDS = 5
COORDINATES, BANDS = 128, 32
# A pair is linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
HUB_ROUNDS, PEEL_ROUNDS = 2, 2
PARITY_BITS = 1024
# Rows of full sets that one comparison step holds.
PAIR_ROWS = 256
# Documents of a bucket that meet in one group of rows; a larger bucket is dealt into blocks of about this many, and blocks meet by pairs.
BUCKET_ROWS = 512


def shingle_sets(texts: pa.Array, words: Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last, data, offsets in text_slices(texts):
        starts, ends, doc = words.bounds(data, offsets)
        hashed = words.hashes(data, starts, ends)
        cuts = np.searchsorted(doc, np.arange(last - first + 1))
        weights = [U64(2 * int(x) + 1) for x in mix(np.arange(11, 11 + SHINGLE_WORDS, dtype=U64)) >> U64(1)]
        n = len(hashed) - SHINGLE_WORDS + 1
        rolled = np.zeros(max(n, 0), U64)
        for k, weight in enumerate(weights):
            if n > 0:
                rolled += hashed[k : k + n] * weight
        rolled = mix(rolled)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= SHINGLE_WORDS:
                yield np.unique(rolled[a : b - SHINGLE_WORDS + 1])
            elif b > a:
                whole = b - a
                for x in hashed[a:b].tolist():
                    whole = (whole * 0xC2B2AE3D27D4EB4F + x) % (1 << 64)
                yield mix(np.array([whole], U64))
            else:
                yield np.zeros(0, U64)


def sketch(hashes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """``t`` coordinates of a set of distinct 64-bit hashes; equal coordinates estimate the similarity."""
    n = len(hashes)
    bits = U64(t.bit_length() - 1)
    out = np.zeros(t, U64)
    empty = np.ones(t, bool)
    done = 0
    step = max(1, -(-3 * t // n))
    while done < t and empty.any():
        rounds = np.arange(done, min(done + step, t), dtype=U64)
        thrown = mix(hashes[None, :] + mix(rounds + U64(1))[:, None])
        # bin, round and 40 bits of the hash, so that one sort puts each bin's least value first
        key = (thrown >> (U64(64) - bits) << (U64(64) - bits)) | rounds[:, None] << U64(40) | (thrown & U64((1 << 40) - 1))
        key = np.sort(key.ravel())
        bins = (key >> (U64(64) - bits)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        new = first[empty[bins[first]]]
        out[bins[new]] = key[new]
        empty[bins[new]] = False
        done = int(rounds[-1]) + 1
        step = max(1, min(2 * step, 1 + (1 << 16) // n))
    for b in np.flatnonzero(empty).tolist():
        out[b] = mix(hashes + mix(np.array([t + b + 1], U64))).min() | U64(1 << 63)
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = coordinates.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=U64)
    for j in range(rows.shape[1]):
        key = mix(key * U64(0x9FB21C651E98DF25) + rows[:, j])
    return key.view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """``PARITY_BITS`` bits, each the parity of the shingles that fall on it.

    Two sets differ in at least as many shingles as their parities differ in bits.
    """
    bits = (np.bincount((hashes & U64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def least_difference(a, b):
    """A lower bound of the number of shingles that only one of two sets has, from their ``parities``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words(white_space())
    empty = np.zeros(0, np.int64)
    for batch in batches:
        sizes, digests, bands, parity = [], [], [], []
        for s in shingle_sets(batch.column(1), words):
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            c = sketch(s) if len(s) else None
            bands.append(empty if c is None else band_keys(c))
            parity.append(empty if c is None else parities(s))
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate([empty, *x]))) for x in (bands, parity)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists], ["doc_id", "n_shingles", "digest", "bands", "parity"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, members`` of each document of a batch, once."""
    words = Words(white_space())
    for batch in batches:
        batch = batch.take(pa.array(np.unique(batch.column(0).to_numpy(), return_index=True)[1]))
        found = [s.view(np.int64) for s in shingle_sets(batch.column(1), words)]
        cuts = np.cumsum([0, *map(len, found)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int64), *found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))], ["doc", "members"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, sa, sb`` to the pairs whose sets reach the similarity."""
    for whole in batches:
        for at in range(0, whole.num_rows, PAIR_ROWS):
            batch = whole.slice(at, PAIR_ROWS)
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = sa.values.to_numpy(), sb.values.to_numpy()
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _hub_pairs(open_: DataFrame, turn: int) -> DataFrame:
    """``a, b``: in each bucket with several components, a member of the largest one and every member outside of it.

    Buckets choose by one order of all documents, so the buckets of a group choose few different hubs.
    """
    order = F.col("doc") if turn == 0 else F.xxhash64("doc", F.lit(turn))
    counted = open_.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.min(F.struct(order.alias("order"), "doc", "n")).alias("first"))
    best = F.struct((-F.col("c")).alias("c"), F.col("first.order").alias("order"), F.col("first.doc").alias("a"), F.col("first.n").alias("na"), F.col("comp").alias("hub"))
    hubs = counted.groupBy("bucket").agg(F.min(best).alias("h"), F.count("*").alias("comps"))
    hubs = hubs.filter("comps > 1").select("bucket", "h.a", "h.na", "h.hub")
    near = (F.col("comp") != F.col("hub")) & (100 * F.least("n", "na") >= PERCENT * F.greatest("n", "na"))
    return open_.join(hubs, "bucket").filter(near).select("a", F.col("doc").alias("b")).distinct()


def _several(open_: DataFrame) -> DataFrame:
    """The buckets' rows without the buckets that hold one component only."""
    mixed = open_.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    return open_.join(mixed, "bucket", "left_semi")


def _peeled(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``rest`` with the most shingles a partner may have (``most``), without the rows that can have no partner."""
    docs = rest.select("doc", "comp", "n").distinct()
    held = sets.join(docs, "doc").select("doc", "comp", "n", F.explode("members").alias("x"))
    shared = held.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("x")
    core = held.join(shared, "x", "left_semi").groupBy("doc", "n").agg(F.count("*").alias("k"))
    most = F.floor(F.col("k") * (100 + PERCENT) / PERCENT - F.col("n") + 1e-6)
    able = core.select("doc", most.alias("most")).filter(F.col("most") * 100 >= PERCENT * F.col("n"))
    return rest.drop("most").join(able, "doc")


def _pairs(rest: DataFrame, bucket_rows: int | None = None) -> DataFrame:
    """``a, b``: the pairs of ``rest`` that meet all conditions a link needs, each in the first band it shares.

    A bucket's blocks meet by pairs (i, j), i <= j: a row stands on the left in the pairs its block begins and on the right in those it
    ends. Two rows of different blocks meet once, in either order; two of one block by their ids.
    """
    full = F.ceil(F.col("rows") / F.lit(bucket_rows or BUCKET_ROWS)).cast("int")
    large = rest.groupBy("bucket").agg(F.count("*").alias("rows")).select("bucket", full.alias("blocks")).filter("blocks > 1")
    dealt = rest.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(5)), F.col("blocks")).cast("int"))
    begins = F.sequence(F.col("block"), F.col("blocks") - 1)
    ends = F.sequence(F.lit(0), F.col("block"))
    left = dealt.select("bucket", F.col("block").alias("i"), F.explode(begins).alias("j"), *[F.col(c).alias(f"{c}_a") for c in ("doc", "n", "comp", "most", "bands", "parity", "pos")])
    right = dealt.select("bucket", F.explode(ends).alias("i"), F.col("block").alias("j"), *[F.col(c).alias(f"{c}_b") for c in ("doc", "n", "comp", "most", "bands", "parity")])
    size = (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a"))
    size &= (100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (100 * F.col("n_b") >= PERCENT * F.col("n_a"))
    first = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) == F.col("pos_a") + 1
    alike = least_difference(F.col("parity_a"), F.col("parity_b")) * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)
    apart = ((left["i"] < left["j"]) | (F.col("doc_a") < F.col("doc_b"))) & (F.col("comp_a") != F.col("comp_b"))
    here = (left["bucket"] == right["bucket"]) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    return left.join(right, here & apart & size & F.when(apart & size, alike & first)).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def _one_each(sets: DataFrame) -> DataFrame:
    """One set per document; only documents of which several rows came are grouped."""
    several = sets.groupBy("doc").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc")
    several = materialize(several, "several")
    if several.isEmpty():
        return sets
    merged = sets.join(several, "doc", "left_semi").groupBy("doc").agg(F.first("members").alias("members"))
    return materialize(sets.join(several, "doc", "left_anti").unionByName(merged), "sets")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("doc").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("members").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_linked, "a long, b long")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links, "a", "b").withColumnRenamed("node", "doc")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, parity array<long>"
    features = materialize(named.mapInArrow(_features, schema), "features")
    distinct = features.filter("digest is not null and doc_id is not null")
    classes = distinct.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("first"))
    classes = materialize(classes.select("digest", F.col("first.doc_id").alias("doc"), F.col("first.n_shingles").alias("n"), F.col("first.bands").alias("bands")), "classes")
    rows = classes.select("doc", "n", F.posexplode("bands").alias("pos", "bucket"))
    shared = rows.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = materialize(rows.join(shared, "bucket").withColumn("comp", F.col("doc")), "members")
    candidates = open_.select("doc").distinct()
    sets = materialize(
        named.join(candidates, F.col("doc_id") == F.col("doc"), "left_semi").select("doc_id", "text").mapInArrow(_sets, "doc long, members array<long>"), "sets"
    )
    sets = _one_each(sets)
    links = None
    for turn in range(HUB_ROUNDS):
        found = materialize(_compare(_hub_pairs(open_, turn), sets), "links")
        links = found if links is None else links.unionByName(found)
        named_comps = _components(links)
        open_ = open_.drop("comp").join(named_comps, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
        open_ = materialize(_several(open_), "open")
    for _ in range(PEEL_ROUNDS):
        open_ = materialize(_several(_peeled(open_, sets)), "peeled")
    keys = features.select(F.col("doc_id").alias("doc"), "bands", "parity").join(open_.select("doc").distinct(), "doc", "left_semi")
    keys = keys.groupBy("doc").agg(F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    links = links.unionByName(_compare(_pairs(materialize(open_.join(keys, "doc"), "rest")), sets))
    named_classes = classes.select("digest", "doc").join(_components(links), "doc", "left")
    named_classes = named_classes.select("digest", F.coalesce("component", "doc").alias("component_id"))
    out = features.select("doc_id", "n_shingles", "digest").join(named_classes, "digest", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component_id", "doc_id")).alias("kept"),
    )
