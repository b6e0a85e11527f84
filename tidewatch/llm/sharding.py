"""Sharding by fixed virtual slots, in column expressions only.

Records are hashed into ``SLOTS`` slots, a number that never changes. The bytes of each slot are summed, and a map from slots to
shards deals the slots, largest first, to the shard with the least bytes. The map is a small table with a version; it is stored,
and edited when shards are added: some slots of every shard change to the new one, all other records stay where they are.

The law of a map is ``bytes``: the sizes of the shards are near equal. A record's size is the UTF-8 bytes of its text and one.

A record is named by a digest of its whole row, so its slot depends on its own values only. Rows that are the same in every column are
counted before the shuffle and numbered as copies; the number is part of the hash, so that a row that makes up a third of the
table is spread over all slots like different rows. Copies are unfolded in pieces of ``COPIES_HELD``.

Null texts count as empty. A null ``doc_id`` is a value like others. Empty tables give empty results. Further columns are only
part of the digest, so their names can't clash. The one thing broadcast is the map, of ``SLOTS`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.crcsql import crc32_sql, CRC_TABLE
from tidewatch.runtime import has_files, materialize

SLOTS, SHARDS = 4096, 8
COPIES_HELD = 10_000


def row_name(docs: DataFrame) -> Column:
    """A digest of all columns; a null differs from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in docs.columns]
    return F.md5(F.concat_ws("\x1f", *parts))


def records(docs: DataFrame) -> DataFrame:
    """``name, doc_id, size, text_crc32, n``: one row for rows that are the same in every column, and how many they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        row_name(docs).alias("name"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return slim.groupBy("name", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))


def slotted(found: DataFrame, slots: int = SLOTS, held: int = COPIES_HELD) -> DataFrame:
    """One row for each row of the documents, with its number among its copies and its virtual slot."""
    few = found.filter(F.col("n") <= held).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / held).cast("long"))).alias("piece")
    many = found.filter(F.col("n") > held).select("*", pieces).repartition("name", "piece")
    last = F.least(F.col("n"), (F.col("piece") + 1) * held) - 1
    many = many.select("*", F.explode(F.sequence(F.col("piece") * held, last)).alias("copy")).drop("piece")
    digits = F.substring(F.md5(F.concat_ws(":", "name", F.col("copy").cast("string"))), 1, 7)
    slot = (F.conv(digits, 16, 10).cast("long") % slots).cast("int")
    return few.unionByName(many).drop("n").withColumn("virtual_slot", slot)


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, bytes, n_rows`` of every slot, empty ones included."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    used = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    return every.join(F.broadcast(used), "virtual_slot", "left").fillna(0, ["bytes", "n_rows"])


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots in falling order of bytes, each to the shard that has the least.

    The fold runs over the rows of the slots, whose number is fixed.
    """
    falling = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "n_rows")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("owners"))

    def deal(state: Column, slot: Column) -> Column:
        loads = state["loads"]
        least = F.array_position(loads, F.array_min(loads)) - 1
        # an empty slot weighs one, so that empty slots are dealt out as well
        grown = F.transform(loads, lambda x, i: F.when(i == least, x - slot["less"] + F.when(slot["less"] == 0, 1).otherwise(0)).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["owners"], F.array(least.cast("int"))).alias("owners"))

    dealt = sizes.agg(falling.alias("slots")).select("slots", F.aggregate("slots", start, deal)["owners"].alias("owners"))
    each = dealt.select(F.posexplode("slots").alias("i", "slot"), "owners")
    return each.select(
        F.lit(1).alias("version"), "slot.virtual_slot", F.get("owners", F.col("i")).alias("shard"), (-F.col("slot.less")).alias("bytes"), "slot.n_rows"
    )


def grown_map(old: DataFrame) -> DataFrame:
    """The next version, with one more shard: from every shard the slots go that it has beyond its new share, and only to the new one."""
    new = F.max("shard").over(Window.partitionBy("version")) + 1
    load = F.sum("bytes").over(Window.partitionBy("version", "shard"))
    share = F.sum("bytes").over(Window.partitionBy("version")) / (new + 1)
    order = Window.partitionBy("version", "shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.sum("bytes").over(order) <= load - share
    return old.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(moved, new).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "n_rows")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored ones; older versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the newest."""
    if not has_files(spark, path):
        raise FileNotFoundError(f"no map of slots in {path}")
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "n_rows")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with ``shard`` and ``slot``, their place in the shard: slots of a shard follow each other, rows within by name."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("version", "virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    turn = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("name", "copy"))
    return rows.withColumn("turn", turn).join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("turn") - 1).drop("turn", "start")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, name`` of every row.

    ``slot`` is the place in the shard, from 0 without gaps; ``grown_shard`` is null, as sizes and not ids alone decide.
    """
    found = materialize(records(docs), "records")
    rows = slotted(found, slots)
    slot_map = materialize(first_map(slot_sizes(rows, slots), shards), "slot-map")
    return place(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"), "name"
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The whole rows as files, a folder for each shard; a document's columns are fields of ``doc``, so that no name clashes."""
    whole = docs.select(row_name(docs).alias("name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).dropDuplicates(["name"])
    put = placed.select("name", "shard", "slot").join(whole, "name").drop("name")
    put.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


_PARTS = ", ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in ("doc_id", "text", "lang", "source", "n_chars"))
SQL = f"""WITH RECURSIVE {CRC_TABLE},
  named AS (SELECT md5(concat_ws(chr(31), {_PARTS})) AS name, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
  copied AS (SELECT *, row_number() OVER (PARTITION BY name) - 1 AS copy FROM named),
  placed AS (SELECT *, ('0x' || substr(md5(name || ':' || copy), 1, 7))::INT % {SLOTS} AS virtual_slot FROM copied),
  sizes AS (SELECT s AS virtual_slot, coalesce(sum(size), 0)::BIGINT AS bytes FROM range({SLOTS}) r(s) LEFT JOIN placed ON virtual_slot = s GROUP BY s),
  ordered AS (SELECT virtual_slot, bytes, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS i FROM sizes),
  deal(i, virtual_slot, loads, shard) AS (SELECT 0::BIGINT, NULL::BIGINT, list_transform(range({SHARDS}), lambda x: 0::BIGINT), NULL::BIGINT UNION ALL
    SELECT o.i, o.virtual_slot, list_transform(d.loads, lambda x, k: CASE WHEN k = list_position(d.loads, list_min(d.loads)) THEN x + greatest(o.bytes, 1) ELSE x END),
      list_position(d.loads, list_min(d.loads)) - 1 FROM deal d JOIN ordered o ON o.i = d.i + 1)
  SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY p.virtual_slot, name, copy) - 1 AS slot,
    NULL::INT AS grown_shard, p.virtual_slot, 1 AS map_version, name FROM placed p JOIN deal USING (virtual_slot)"""
