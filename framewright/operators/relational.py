"""Relational plans over the star schema: joins, aggregates, grouping sets, windows. Catalyst picks strategies; filters and columns reach the scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.catalog import query, table


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))



def ts(value: str):
    return F.to_timestamp_ntz(F.lit(value))


@query("w_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def w_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= ts("1998-09-02 00:00:00"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum(revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("w_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
def w_forecast(spark, sf_dir):
    d = F.col("l_shipdate")
    li = table(spark, sf_dir, "lineitem").where((d >= ts("1994-01-01 00:00:00")) & (d < ts("1996-01-01 00:00:00")) & F.col("l_discount").between(0.02, 0.06) & (F.col("l_quantity") < 24))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("w_local_supplier", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey < 3 GROUP BY n_name")
def w_local_supplier(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    near = t("nation").join(t("region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = t("supplier").join(near, F.col("s_nationkey") == F.col("n_nationkey"))
    li = t("lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = li.join(t("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return both.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("w_top_customers", "SELECT c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY spent DESC, c_custkey LIMIT 20")
def w_top_customers(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    out = spent.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return out.select("c_custkey", "spent").orderBy(F.desc("spent"), "c_custkey").limit(20)


@query("w_semi_anti", "SELECT 'with' AS kind, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) UNION ALL SELECT 'without', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def w_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    rich = c.join(o.where("o_totalprice > 200000"), on, "left_semi").select(F.lit("with").alias("kind"), "c_custkey")
    return rich.unionByName(c.join(o, on, "left_anti").select(F.lit("without").alias("kind"), "c_custkey"))


@query("w_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS rolled FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def w_rollup(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return r.agg(F.count(F.lit(1)).alias("n"), F.grouping("l_linestatus").cast("long").alias("rolled"))


@query("w_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def w_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("w_grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def w_grouping_sets(spark, sf_dir):
    flag, status, line = map(F.col, ("l_returnflag", "l_linestatus", "l_linenumber"))
    sets = table(spark, sf_dir, "lineitem").groupingSets([[flag, status], [line], []], flag, status, line)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("w_map_counts", "SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'view') AS views, count(*) AS n FROM events GROUP BY user_id")
def w_map_counts(spark, sf_dir):
    """A map from kind to count for each user, read by key, size and values; its entries are counted before they are gathered."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("user_id", F.size("m").cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(0).cast("long")).alias("views"), total.alias("n"))


@query("w_table_function", "SELECT event_id, unnest(generate_series(0, event_id % 4)) AS part, CAST(value AS DOUBLE) / (event_id % 4 + 1) AS share FROM events")
def w_table_function(spark, sf_dir):
    """A table function of the session, in SQL, joined laterally: an event's value in equal parts."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION framewright_parts(id BIGINT, v DOUBLE) RETURNS TABLE (part BIGINT, share DOUBLE) RETURN SELECT p, v / (id % 4 + 1) FROM (SELECT explode(sequence(0L, id % 4)) AS p)")
    return spark.sql("SELECT event_id, part, share FROM {events} AS e, LATERAL framewright_parts(e.event_id, CAST(e.value AS DOUBLE))", events=table(spark, sf_dir, "events"))


@query("w_set_operations", "(SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT p_size, 'except' FROM part EXCEPT SELECT c_nationkey, 'except' FROM customer)")
def w_set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(p.subtract(c).withColumn("kind", F.lit("except")))


@query("w_sessions", "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e) SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, s")
def w_sessions(spark, sf_dir):
    """Islands of activity: a gap of over two hours begins a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = e.withColumn("new", F.when(gap <= 2 * 3_600_000_000, 0).otherwise(1)).withColumn("s", F.sum("new").over(w))
    return e.groupBy("user_id", "s").agg(F.min("ts").alias("begin"), F.count(F.lit(1)).alias("n")).drop("s")


@query("w_sliding", "SELECT event_type, epoch(w)::BIGINT AS w, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY ALL")
def w_sliding(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("t"))
    return e.groupBy("event_type", F.window("t", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_seconds("w.start").alias("w"), "n")


@query("w_asof_join", "SELECT e.event_id, o.k FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, ts, event_id AS k FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) o ON e.user_id = o.user_id AND e.ts >= o.ts")
def w_asof_join(spark, sf_dir):
    """The latest click of the user at or before each view."""
    from framewright.functions.order import latest
    from framewright.schema import DAY_NS, frames

    f = frames(spark, sf_dir).withColumn("is_view", F.col("stream") == "view")
    f = latest(f, ["user_id"], "pts_ns", ["pts_ns", "is_view", "sequence"], F.when(F.col("stream") == "click", F.col("sequence")), "k", 10 * DAY_NS)
    return f.where("is_view").select(F.col("sequence").alias("event_id"), "k")


@query("w_moving_average", "SELECT c_custkey, o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3, CAST(rank() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS place FROM customer JOIN orders ON c_custkey = o_custkey")
def w_moving_average(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    w = Window.partitionBy("c_custkey")
    mean = F.avg("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0))
    return j.select("c_custkey", "o_orderkey", F.round(mean, 4).alias("mean3"), F.rank().over(w.orderBy(F.desc("o_totalprice"))).alias("place"))
