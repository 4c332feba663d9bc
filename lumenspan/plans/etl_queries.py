"""Queries on tabular extracts: casts, lookups, counts, sums and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import etl, logs
from ..streaming.status import latest_by_key, status_of

TYPES = ("click", "view", "purchase", "signup", "error", "logout")
PARTS = (("almond", "nut"), ("azure", "blue"), ("blue", "blue"), ("steel", "metal"), ("brass", "metal"), ("copper", "metal"), ("1", "one"), ("2", "two"))


def table(spark, d, name, *columns):
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def season_mean_of_sums(spark, d):
    """Sums by year and season, then their mean by season, in the order of seasons."""
    orders = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), etl.season(F.month("o_orderdate")).alias("season"), F.col("o_totalprice").alias("total"))
    sums = etl.sum_numeric(orders, ["year", "season"])
    return sums.groupBy("season").agg(F.round(F.avg("total"), 2).alias("mean_total")).withColumn("season_no", etl.season_order(F.col("season")).cast("int")).orderBy("season_no")


def year_total(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    metric = F.col("l_extendedprice") + F.col("l_discount") + F.col("l_tax")
    return joined.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum(metric), 2).alias("total")).orderBy("year")


def select_rename_cast(spark, d):
    raw = etl.select_renamed(table(spark, d, "orders"), {"o_orderkey": "order_no", "o_orderpriority": "priority", "o_totalprice": "price"})
    raw = raw.withColumns({"level": F.split_part("priority", F.lit("-"), F.lit(1)), "broken": F.concat("priority", F.lit("x")), "price": F.format_string("%.2f", "price")})
    return etl.cast_columns(raw, but=("order_no", "priority"))


def prefix_strip(spark, d):
    return table(spark, d, "orders").select("o_orderkey", etl.before_dash(F.col("o_orderpriority")).alias("level"))


def ordered_lookup_first_hit(spark, d):
    return table(spark, d, "part").select("p_partkey", etl.ordered_lookup(F.lower("p_name"), r"(\p{L}+een)", PARTS, "other").alias("kind"))


def value_counts_topk(spark, d):
    return etl.value_counts(table(spark, d, "customer"), "c_mktsegment", 15)


def value_counts_by_key(spark, d):
    return etl.value_counts(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")), "day", by_key=True)


def describe_numeric(spark, d):
    out = etl.describe(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return out.select("name", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "lowest", "q1", "q2", "q3", "highest")))


def hourly(spark, d):
    e = table(spark, d, "events", "ts", "event_type", "props", "value")
    n = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    return e.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type", n.alias("k"), F.lit(1).cast("long").alias("one"))


def pivot_sum_fill0(spark, d):
    out = etl.pivot_sum(hourly(spark, d), "hour", "event_type", list(TYPES), ["k", "one"])
    return out.select("hour", *(F.col(f"{t}_{m}").alias(f"{t}_{m}") for t in TYPES for m in ("k", "one")))


def pivot_count_fixed_cols(spark, d):
    return etl.pivot_count(hourly(spark, d), "hour", "event_type", ["click", "view", "absent"], "k")


def json_field_default(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    z = F.get_json_object("props", "$.missing").cast("long")
    return table(spark, d, "events").select("event_id", F.coalesce(k, F.lit(0).cast("long")).alias("k"), F.coalesce(z, F.lit(7).cast("long")).alias("missing"))


def array_unnest_tagged(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "user_id").withColumns(
        {"balanced_cpks": F.array(F.col("event_type")), "dedicated_cpks": F.when(F.col("user_id") % 2 == 0, F.array(F.col("event_type"), F.lit("even"))).otherwise(F.array().cast("array<string>")), "shared_cpks": F.lit(None).cast("array<string>")}
    )
    return etl.unnest_tagged(e, {f"{t}_cpks": t for t in logs.TYPES}, ["event_id"], "cpk")


def first_seen_keys(spark, d):
    return etl.first_seen(table(spark, d, "events"), "event_type", "event_id")


def stage_shares(spark, d):
    sums = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return etl.shares_of_total(sums, "qty", ["l_returnflag"]).select("l_returnflag", "l_linestatus", "qty", F.round("share_pct", 6).alias("share_pct"))


def latest_status(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "value")
    inc = (F.floor(F.col("value")) % 4).cast("long")
    progress = e.groupBy("user_id").agg(F.least(F.lit(100).cast("long"), F.sum(inc)).alias("progress")).withColumn("status", status_of(F.col("progress")))
    return progress.join(latest_by_key(e.select("user_id", "event_id"), "user_id", "event_id"), "user_id").select("user_id", "progress", "status", F.col("event_id").alias("last_event"))


def union_pages(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    parts = [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), o.where("o_orderstatus NOT IN ('F', 'O')")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def metric_log(spark, d):
    """Events as lines of a scheduler's log: two of three are metrics, of allocations or of batches."""
    e = table(spark, d, "events", "event_id", "event_type", "user_id", "ts")
    number = lambda m: F.when(F.col("event_id") % m != 0, F.col("event_id") % m)
    lists = {f"{t}_cpks": F.when(F.col("event_id") % 4 != k, F.array("event_type", F.concat(F.lit(t), F.col("user_id").cast("string")))) for k, t in enumerate(logs.TYPES)}
    return e.select(
        F.when(F.col("event_id") % 3 != 0, "metric").otherwise("info").alias("msg"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.when(F.col("event_id") % 2 == 0, "cpk_allocate").otherwise("batch_summary").alias("metric_type"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("cpk"), number(5).alias("request_count"), number(7).alias("ongoing_count"), number(11).alias("queued_at_start"), F.col("event_id").cast("string").alias("batch_id"), *(c.alias(n) for n, c in lists.items()),
    )


def allocation_rows(spark, d):
    """Lines that are metrics of allocations to a named key."""
    a = logs.allocations(metric_log(spark, d))
    return a.groupBy("cpk", F.date_format("time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(c) for c in ("count", "pending", "queued_at_start", "total")))


def batch_type_rows(spark, d):
    return logs.batch_types(metric_log(spark, d)).select("batch_id", "type", "cpk")


def districts(spark, d):
    """Addresses along the roads of the table, some with the district named."""
    road = F.element_at(F.array(*(F.lit(r) for r, _ in etl.ROADS), F.lit("모르는길")), (F.col("c_custkey") % (len(etl.ROADS) + 1) + 1).cast("int"))
    address = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("서울 신사동 "), road)).when(F.col("c_custkey") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("서울 "), road, F.lit(" "), F.col("c_custkey").cast("string")))
    return table(spark, d, "customer", "c_custkey").select("c_custkey", etl.district(address).alias("district"))


QUERIES = {f.__name__: f for f in (season_mean_of_sums, year_total, select_rename_cast, prefix_strip, ordered_lookup_first_hit, value_counts_topk, value_counts_by_key, describe_numeric, pivot_sum_fill0, pivot_count_fixed_cols, json_field_default, array_unnest_tagged, first_seen_keys, stage_shares, latest_status, union_pages, allocation_rows, batch_type_rows, districts)}

_LOOKUP = " ".join(f"WHEN contains(lower(p_name), '{k}') THEN '{v}'" for k, v in PARTS)
_HOURLY = "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events"
ORACLES = {
    "season_mean_of_sums": """
WITH s AS (SELECT year(o_orderdate) y, CASE WHEN month(o_orderdate) IN (12,1,2) THEN 'winter' WHEN month(o_orderdate) IN (3,4,5) THEN 'spring'
  WHEN month(o_orderdate) IN (6,7,8) THEN 'summer' ELSE 'autumn' END season, sum(o_totalprice) total FROM orders GROUP BY ALL)
SELECT season, round(avg(total), 2) AS mean_total, CAST(list_position(['spring','summer','autumn','winter'], season) AS INTEGER) AS season_no FROM s GROUP BY season""",
    "year_total": "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, round(sum(l_extendedprice + l_discount + l_tax), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "select_rename_cast": "SELECT o_orderkey AS order_no, o_orderpriority AS priority, CAST(format('{:.2f}', o_totalprice) AS DOUBLE) AS price, CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level, CAST(NULL AS DOUBLE) AS broken FROM orders",
    "prefix_strip": "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, '-') THEN trim(split_part(o_orderpriority, '-', 1)) ELSE o_orderpriority END AS level FROM orders",
    "ordered_lookup_first_hit": f"SELECT p_partkey, CASE WHEN regexp_extract(lower(p_name), '(\\p{{L}}+een)', 1) <> '' THEN regexp_extract(lower(p_name), '(\\p{{L}}+een)', 1) {_LOOKUP} ELSE 'other' END AS kind FROM part",
    "value_counts_topk": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 15",
    "value_counts_by_key": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "describe_numeric": " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS lowest, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q2, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3, round(CAST(max({c}) AS DOUBLE), 4) AS highest FROM part" for c in ("p_size", "p_retailprice")
    ),
    "pivot_sum_fill0": "SELECT hour, " + ", ".join(f"CAST(coalesce(sum(k) FILTER (event_type = '{t}'), 0) AS BIGINT) AS {t}_k, count(*) FILTER (event_type = '{t}') AS {t}_one" for t in TYPES) + f" FROM ({_HOURLY}) GROUP BY hour",
    "allocation_rows": """
WITH a AS (SELECT event_type AS cpk, strftime(ts, '%Y-%m-%d') AS day, event_id % 5 AS r, event_id % 7 AS o, event_id % 11 AS q FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0 AND event_type <> 'view')
SELECT cpk, day, count(*) AS n, CAST(sum(r) AS BIGINT) AS count, CAST(sum(o) AS BIGINT) AS pending, CAST(sum(q) AS BIGINT) AS queued_at_start, CAST(sum(r + o) AS BIGINT) AS total FROM a GROUP BY cpk, day""",
    "batch_type_rows": " UNION ALL ".join(f"SELECT CAST(event_id AS VARCHAR) AS batch_id, '{t}' AS type, unnest([event_type, '{t}' || user_id]) AS cpk FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 1 AND event_id % 4 <> {k}" for k, t in enumerate(logs.TYPES)),
    "districts": f"WITH a AS (SELECT c_custkey, [{', '.join(repr(r) for r, _ in etl.ROADS)}, '모르는길'][c_custkey % {len(etl.ROADS) + 1} + 1] AS road FROM customer) "
    + r"SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '신사동' WHEN c_custkey % 10 = 1 THEN '기타' WHEN contains(road, '동') THEN regexp_extract(road, '([\p{L}\p{N}_]+동)', 1) "
    + " ".join(f"WHEN contains(road, '{r}') THEN '{v}'" for r, v in etl.ROADS) + " ELSE '기타' END AS district FROM a",
    "pivot_count_fixed_cols": "SELECT hour, " + ", ".join(f"count(k) FILTER (event_type = '{t}') AS {t}" for t in ("click", "view", "absent")) + f" FROM ({_HOURLY}) GROUP BY hour",
    "json_field_default": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), 7) AS missing FROM events",
    "array_unnest_tagged": "SELECT event_id, 'balanced' AS type, event_type AS cpk FROM events UNION ALL SELECT event_id, 'dedicated', unnest([event_type, 'even']) FROM events WHERE user_id % 2 = 0",
    "first_seen_keys": "SELECT event_type, min(event_id) AS first_at FROM events GROUP BY 1",
    "stage_shares": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(100 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 6) AS share_pct FROM lineitem GROUP BY 1, 2",
    "latest_status": """
WITH p AS (SELECT user_id, least(100, CAST(sum(CAST(floor(value) AS BIGINT) % 4) AS BIGINT)) AS progress, max(event_id) AS last_event FROM events GROUP BY 1)
SELECT user_id, progress, CASE WHEN progress >= 100 THEN 'completed' WHEN progress > 0 THEN 'processing' ELSE 'pending' END AS status, last_event FROM p""",
    "union_pages": "SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT * FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) GROUP BY 1",
}
