"""Sharding by fixed virtual slots, with DataFrame and SQL functions alone.

Records are hashed into ``slots`` virtual slots (thousands, fixed for the life of a dataset). Bytes are
aggregated per slot (a partial sum per task, so no key is hot), and a versioned map gives each slot a
shard. The map is stored, one folder a version; rebalancing loads the last version, edits it and stores the
next, and rows move only with their slot. The map has ``slots`` rows whatever the data's size, so it is
proven small and is broadcast.

Law ``bytes``: shards hold nearly equal bytes. The first map assigns slots, largest first, each to the
shard with the fewest bytes so far; that greedy pass is a SQL ``aggregate`` over the slot array. Rows are
hashed by id, text and, where rows repeat, their number among equal ones, so a group of equal texts or rows spreads
over all shards: kept together, a group that holds a third of all rows would break the law.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import fresh_path, materialise

SLOTS = 4096
COPIES = 4096
"""Copies of one row that are numbered together."""


def with_slots(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", block: int = COPIES) -> DataFrame:
    """id, size (UTF-8 bytes of the text, null as none, plus 1), text_crc32 and the virtual slot of every row.

    Equal rows are counted, numbered from 0 and hashed with their number, so the slots of a row's copies depend on
    how many there are and on nothing else. A row of many copies is numbered in blocks of ``block``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    counted = materialise(narrow.groupBy(*key).agg(F.count("*").alias("copies")))
    few = counted.filter(F.col("copies") <= block).withColumn("first", F.lit(0).cast("long"))
    many = counted.filter(F.col("copies") > block).withColumn("first", F.explode(F.expr(f"sequence(0L, copies - 1, {int(block)}L)"))).repartition(*key, "first")
    last = F.least(F.col("first") + block, F.col("copies")) - 1
    rows = few.unionByName(many).withColumn("copy", F.explode(F.sequence("first", last)))
    mark = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"), F.col("size").cast("string"), F.when(F.col("copy") > 0, F.col("copy").cast("string"))))
    return rows.select(*key, (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % slots).cast("int").alias("vslot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every virtual slot, those without rows too."""
    used = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(used), "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def _dealt(sizes: DataFrame, held: DataFrame, shards: int) -> DataFrame:
    """vslot, bytes, shard: each slot of ``sizes``, largest first, to the least loaded shard, on top of what shards hold already (``held``: shard, bytes)."""
    loads = held.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("m"))
    one = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot"))).alias("slots")).crossJoin(loads)  # one row each
    start = f"transform(sequence(0, {int(shards) - 1}), s -> cast(coalesce(try_element_at(m, s), 0) as bigint))"
    step = f"""aggregate(slots, named_struct('loads', {start}, 'at', cast(array() as array<int>)),
        (a, s) -> named_struct(
            'loads', transform(a.loads, (v, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, v - s.minus, v)),
            'at', concat(a.at, array(cast(array_position(a.loads, array_min(a.loads)) - 1 as int)))),
        a -> a.at)"""
    dealt = one.select("slots", F.expr(step).alias("at")).select(F.explode(F.arrays_zip("slots", "at")).alias("z"))
    return dealt.select(F.col("z.slots.vslot").alias("vslot"), (-F.col("z.slots.minus")).alias("bytes"), F.col("z.at").alias("shard"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the slot-to-shard map: vslot, bytes, shard, version."""
    nothing = sizes.select(F.lit(0).alias("shard"), "bytes").limit(0)
    return _dealt(sizes, nothing, shards).withColumn("version", F.lit(1))


def rebalance(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for new sizes or a new number of shards.

    A slot keeps its shard unless that shard would hold more than its equal share; a shard's slots are kept
    smallest first up to the share, and the others (and new slots, and those of removed shards) are dealt
    anew, largest first. The moved bytes are thus near the least that evens the shards.
    """
    now = sizes.select("vslot", "bytes").join(F.broadcast(old.select("vslot", "shard")), "vslot", "left")
    share = sizes.agg((F.sum("bytes") / F.lit(shards)).alias("share"))
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"))
    near = Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    marked = now.crossJoin(F.broadcast(share)).withColumn("upto", F.sum("bytes").over(near))
    keep = F.coalesce(F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.col("upto") <= F.col("share")), F.lit(False))
    kept = marked.filter(keep).select("vslot", "bytes", "shard")
    new = _dealt(marked.filter(~keep).select("vslot", "bytes"), kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")), shards)
    return kept.unionByName(new).crossJoin(F.broadcast(version))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map to those at ``path``."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the last one unless named."""
    every = spark.read.schema("vslot int, bytes long, shard int, version int").parquet(path)
    if version is not None:
        return every.filter(F.col("version") == version)
    return every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version").select("vslot", "bytes", "shard", "version")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", resize: bool = False) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot (its place in the shard, from 0), grown_shard, vslot, map_version.

    The map is stored at ``map_path`` (a new one in the shared folder unless given). Where that holds versions
    already, the last one counts, or with ``resize`` is first edited for the present sizes and ``shards``. The place is the slot's start within its shard plus the row's rank
    within its virtual slot, so no window is larger than one slot. Null texts count as empty (size 1) and null
    ids hash like any value; wholly equal rows are dealt to slots by number and get places of their own. An empty table
    gives no rows; other columns are not read, whatever their names. Texts of any length cost one hash.
    """
    spark = docs.sparkSession
    rows = materialise(with_slots(docs, slots, id_col, text_col))
    sizes = materialise(slot_sizes(rows, slots))
    if map_path is None:
        map_path = fresh_path(spark)
        store_map(first_map(sizes, shards), map_path)
    elif resize:
        store_map(materialise(rebalance(load_map(spark, map_path), sizes, shards)), map_path)
    order = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = load_map(spark, map_path).select("vslot", "shard", "version").join(F.broadcast(sizes.select("vslot", "rows")), "vslot")
    starts = starts.withColumn("begin", F.coalesce(F.sum("rows").over(order), F.lit(0))).drop("rows")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32")
    placed = rows.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(starts), "vslot")
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("begin") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "vslot", F.col("version").alias("map_version"),
    )
