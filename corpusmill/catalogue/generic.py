"""Queries on event-time windows, streams, JSON, graphs and the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import graph
from corpusmill.session import table, work_dir
from corpusmill.streaming import streams


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def q_win_tumbling(spark, sf_dir) -> DataFrame:
    out = streams.windowed(_events(spark, sf_dir), ["event_type"], "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def q_win_sliding(spark, sf_dir) -> DataFrame:
    out = streams.windowed(_events(spark, sf_dir), ["event_type"], "2 days", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def q_win_session(spark, sf_dir) -> DataFrame:
    out = streams.sessions(_events(spark, sf_dir), ["user_id"], "6 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _streamed(spark, sf_dir, build, mode: str) -> DataFrame:
    """The rows that a stream over the events table leaves."""
    base = work_dir(spark)
    df = build(streams.event_stream(spark, f"{sf_dir}/events.parquet"))
    if mode == "append":
        streams.run_available(df, f"{base}/checkpoint", f"{base}/out")
        return spark.read.schema(df.schema).parquet(f"{base}/out")
    name = f"stream_{uuid.uuid4().hex}"
    streams.run_available(df, f"{base}/checkpoint", mode=mode, name=name)
    return spark.table(name)


def q_stream_stats(spark, sf_dir) -> DataFrame:
    out = _streamed(spark, sf_dir, lambda s: streams.running_stats(s, ["event_type"]), "complete")
    return out.withColumn("mean", F.round("mean", 6))


def q_stream_dedup(spark, sf_dir) -> DataFrame:
    """Users and event types that a stream has seen."""
    out = _streamed(spark, sf_dir, lambda s: streams.deduplicated(s, ["user_id", "event_type"], "60 days"), "append")
    return out.select("user_id", "event_type")


def q_stream_anomaly(spark, sf_dir) -> DataFrame:
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = _streamed(spark, sf_dir, lambda s: streams.anomalies(s.withColumn("k", F.concat_ws("/", "user_id", "event_type")), "k"), "append")
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return out.select("event_id", F.round("z", 6).alias("z"))


def q_stream_evaluation(spark, sf_dir) -> DataFrame:
    """Statistics of each micro-batch, summed up."""
    base = work_dir(spark)
    evaluate = lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    streams.evaluate_each(streams.event_stream(spark, f"{sf_dir}/events.parquet"), evaluate, f"{base}/out", f"{base}/checkpoint")
    found = spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
    return found


def q_props_json(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("most"), F.count("k").alias("n"))


def q_loss_grouping_sets(spark, sf_dir) -> DataFrame:
    """Mean value by position in the day, by type, and by both."""
    rows = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "event_type", "value")
    out = rows.groupingSets([["hour"], ["event_type"], ["hour", "event_type"]], "hour", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out


def _imports(spark, sf_dir) -> DataFrame:
    """A graph of customers: each points to the next customer of its nation and segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nxt = F.expr("lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)")
    return c.select(F.col("c_custkey").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")


def q_graph_degrees(spark, sf_dir) -> DataFrame:
    return graph.degrees(_imports(spark, sf_dir))


def q_graph_reach(spark, sf_dir) -> DataFrame:
    return graph.reach(_imports(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")), 4)


def q_graph_cycles(spark, sf_dir) -> DataFrame:
    """Nodes left when sources and sinks are peeled off, with an edge back from every fifth node."""
    edges = _imports(spark, sf_dir)
    back = edges.where("src % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.cyclic(edges.union(back))


def q_star_join(spark, sf_dir) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cust, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    names = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "r_name")
    out = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(cust, orders["o_custkey"] == cust["c_custkey"]).join(F.broadcast(names), cust["c_nationkey"] == names["n_nationkey"])
    return out.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def q_star_pricing(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


def q_star_semi(spark, sf_dir) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def q_star_anti(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def q_star_rollup(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def q_star_cube(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def q_star_topk(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def q_star_setops(spark, sf_dir) -> DataFrame:
    """Customers with urgent but no low-priority orders, and those with both."""
    orders = table(spark, sf_dir, "orders")
    of = lambda p: orders.where(F.col("o_orderpriority") == p).select("o_custkey")
    a, b = of("1-URGENT"), of("5-LOW")
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.subtract(b).withColumn("kind", F.lit("urgent"))).groupBy("kind").agg(F.count("*").alias("n"))


def q_star_outer(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return a.join(b, "nation", "full_outer").fillna(0)


def q_star_pivot(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_WIN = "strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total"
_EDGES = "e AS (SELECT src, dst FROM (SELECT c_custkey AS src, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS dst FROM customer) WHERE dst IS NOT NULL)"
ORACLES = {
    "q_win_tumbling": f"SELECT {_WIN} FROM (SELECT date_trunc('day', ts) AS start, event_type, value FROM events) GROUP BY start, event_type",
    "q_win_sliding": f"SELECT {_WIN} FROM (SELECT date_trunc('day', ts) - to_days(unnest([0, 1])) AS start, event_type, value FROM events) GROUP BY start, event_type",
    "q_win_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id""",
    "q_stream_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
    "q_stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "q_stream_anomaly": """WITH w AS (SELECT event_id, value, avg(value) OVER x AS m, stddev_samp(value) OVER x AS s, count(value) OVER x AS n FROM events WHERE isfinite(value) WINDOW x AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
        SELECT event_id, round((value - m) / s, 6) AS z FROM w WHERE n >= 5 AND s > 0 AND abs(value - m) / s > 3""",
    # the edges are chains, and each edge with one back is a cycle: what stands between a chain's first and last cycle is left
    "q_graph_cycles": """
        WITH n AS (SELECT c_custkey AS node, c_nationkey AS a, c_mktsegment AS b, row_number() OVER w AS k, lead(c_custkey) OVER w AS nxt FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)),
        c AS (SELECT a, b, min(k) AS lo, max(k) + 1 AS hi FROM n WHERE node % 5 = 0 AND nxt IS NOT NULL GROUP BY a, b) SELECT node FROM n JOIN c USING (a, b) WHERE k BETWEEN lo AND hi""",
    "q_stream_evaluation": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "q_props_json": "SELECT event_type, sum(k)::BIGINT AS total, max(k) AS most, count(k) AS n FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY event_type",
    "q_loss_grouping_sets": "SELECT hour(ts)::INT AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((hour(ts)), (event_type), (hour(ts), event_type))",
    "q_graph_degrees": f"WITH {_EDGES}, n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM n GROUP BY node",
    "q_graph_reach": f"WITH RECURSIVE {_EDGES}, r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "q_star_join": "SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "q_star_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "q_star_semi": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY 1",
    "q_star_anti": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "q_star_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "q_star_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "q_star_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "q_star_setops": "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') SELECT CASE WHEN o_custkey IN (SELECT o_custkey FROM b) THEN 'both' ELSE 'urgent' END AS kind, count(*) AS n FROM a GROUP BY 1",
    "q_star_outer": "SELECT coalesce(s_nationkey, c_nationkey) AS nation, coalesce(suppliers, 0) AS suppliers, coalesce(customers, 0) AS customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON s_nationkey = c_nationkey",
    "q_star_pivot": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag",
}
