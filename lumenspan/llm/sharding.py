"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame and SQL functions only).

Each shard owns ``vnodes`` points of a ring of 2**32 places. A key's home is the shard of the first point at or
clockwise after the key's own place. A shard holds n / shards keys, rounded so that counts differ by one at most (law
``rows``). Keys first go home; what a full shard cannot hold continues clockwise and fills the first shards that have
room. So exactly ``sum(max(0, home keys - capacity))`` keys move, the least for which the law can hold.

How many keys leave and enter each arc is worked out on the arcs' counts, a table of shards * vnodes rows; rows are
only numbered within their arc. Texts are never shuffled: only id, size and checksum are.

Defined results: a null text has size 8 and checksum 0; a null id has a place of its own; rows that repeat an id share
a place and get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 32
CELL_BITS = 12


def place(text: Column) -> Column:
    """The place on the ring: the first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def ring(spark, n_shards: int, vnodes: int) -> DataFrame:
    """One row per virtual node, clockwise: arc, shard, at."""
    points = spark.range(0, n_shards * vnodes, 1, 1).select(
        (F.col("id") % n_shards).cast("int").alias("shard"), place(F.concat(F.lit("shard "), F.col("id") % n_shards, F.lit(" node "), F.floor(F.col("id") / n_shards))).alias("at")
    )
    return points.withColumn("arc", F.row_number().over(Window.orderBy("at", "shard")) - 1)


def cells(spark, arcs: DataFrame) -> DataFrame:
    """For each of 4,096 equal cells of the ring: its points, and the arc that owns what lies after the last of them."""
    own = arcs.groupBy(F.shiftright("at", RING_BITS - CELL_BITS).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("at", "arc"))).alias("points"))
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spark.range(0, 1 << CELL_BITS, 1, 1)
        .select(F.col("id").alias("cell"))
        .join(F.broadcast(own), "cell", "left")
        .select("cell", F.coalesce("points", F.array().cast("array<struct<at:bigint,arc:int>>")).alias("points"), F.coalesce(F.last(F.col("points")[0]["arc"], ignorenulls=True).over(after), F.lit(0)).alias("next_arc"))
    )


def arc_plan(arcs: DataFrame, counts: DataFrame, n_shards: int) -> DataFrame:
    """Per arc: how many of its keys stay, their first slot, and the pieces that its other keys fall into.

    All tables here have as many rows as there are virtual nodes, whatever the input's size.
    """
    n = F.sum("n").over(Window.partitionBy())
    by_shard = Window.partitionBy("shard").orderBy("arc")
    upto, whole = by_shard.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("shard")
    flow = (
        arcs.join(F.broadcast(counts), "arc", "left")
        .select("arc", "shard", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        .withColumn("cap", F.floor(n / n_shards) + F.when(F.col("shard") < n % n_shards, 1).otherwise(0))
        .withColumn("stay", F.greatest(F.lit(0), F.least(F.col("n"), F.col("cap") - F.sum("n").over(upto) + F.col("n"))))
        .withColumn("slot", F.sum("stay").over(upto) - F.col("stay"))
        .withColumn("home", F.sum("stay").over(whole))
        .withColumn("leave", F.col("n") - F.col("stay"))
        .withColumn("left_before", F.sum("leave").over(Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, 0)) - F.col("leave"))
    )
    row = flow.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "stay", "slot", "leave", "left_before", "cap", "home"))).alias("arcs"))
    # Two laps clockwise: keys that leave queue up; each arc takes from the queue what its shard has room for.
    row = row.selectExpr(
        "arcs",
        f"""aggregate(
            concat(arcs, transform(arcs, a -> named_struct('arc', a.arc, 'shard', a.shard, 'stay', a.stay, 'slot', a.slot, 'leave', 0L, 'left_before', a.left_before, 'cap', a.cap, 'home', a.home))),
            named_struct(
                'used', transform(sequence(0, {n_shards - 1}), s -> coalesce(array_max(transform(filter(arcs, a -> a.shard = s), a -> a.home)), 0L)),
                'queue', 0L, 'sent', 0L, 'pieces', cast(array() as array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>)),
            (z, a) -> named_struct(
                'used', if(z.queue + a.leave = 0, z.used, transform(z.used, (u, s) -> if(s = a.shard, u + least(z.queue + a.leave, a.cap - u), u))),
                'queue', z.queue + a.leave - least(z.queue + a.leave, a.cap - z.used[a.shard]),
                'sent', z.sent + least(z.queue + a.leave, a.cap - z.used[a.shard]),
                'pieces', if(least(z.queue + a.leave, a.cap - z.used[a.shard]) > 0,
                    concat(z.pieces, array(named_struct('lo', z.sent, 'hi', z.sent + least(z.queue + a.leave, a.cap - z.used[a.shard]), 'shard', a.shard, 'slot', z.used[a.shard]))),
                    z.pieces)),
            z -> z.pieces) as pieces""",
    )
    return row.selectExpr(
        "inline(transform(arcs, a -> named_struct('arc', a.arc, 'home_shard', a.shard, 'stay', a.stay, 'first_slot', a.slot, 'left_before', a.left_before, "
        "'pieces', if(a.leave = 0, cast(array() as array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>), filter(pieces, p -> p.hi > a.left_before and p.lo < a.left_before + a.leave)))))"
    )


def ring_shards(docs: DataFrame, n_shards: int = 24, vnodes: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, home_shard, shard, slot, moved for each row; counts of shards differ by one at most."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    arcs = ring(spark, n_shards, vnodes)
    keys = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), place(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("at"))
    placed = (
        keys.withColumn("cell", F.shiftright("at", RING_BITS - CELL_BITS))
        .join(F.broadcast(cells(spark, arcs)), "cell")
        .withColumn("arc", F.coalesce(F.get(F.filter("points", lambda p: p["at"] >= F.col("at")), F.lit(0))["arc"], F.col("next_arc")))
        .select("id", "size", "text_crc32", "at", "arc")
    )
    # Rows that repeat an id have one place; the checksum and size order them.
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("arc").orderBy("at", "id", "text_crc32", "size")) - 1)
    plan = arc_plan(arcs, placed.groupBy("arc").agg(F.count("*").alias("n")), n_shards)
    out = ranked.join(F.broadcast(plan), "arc")
    away = F.col("left_before") + F.col("k") - F.col("stay")
    out = out.withColumn("piece", F.when(F.col("k") >= F.col("stay"), F.get(F.filter("pieces", lambda p: (p["lo"] <= away) & (p["hi"] > away)), F.lit(0))))
    return out.select(
        "id", "size", "text_crc32", "home_shard", F.coalesce("piece.shard", "home_shard").alias("shard"),
        F.coalesce(F.col("piece.slot") + away - F.col("piece.lo"), F.col("first_slot") + F.col("k")).cast("long").alias("slot"),
        F.col("piece").isNotNull().alias("moved"),
    )


def op5_ring_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23 under the law ``rows``."""
    out = ring_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard", "moved")
