"""Queries over joins, aggregates, windows and set operations (survey sections C to F)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import joins as J
from ..operators import windows as W
from .registry import Tables, query

MONEY = "decimal(18,2)"


def total(column: str):
    return F.sum(F.col(column).cast(MONEY)).cast("double")


@query("c1_traverse_n1", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def c1(t: Tables) -> DataFrame:
    return J.traverse_n1(t.orders, t.customer, F.expr("o_custkey = c_custkey"), "c_custkey").select("o_orderkey", "c_mktsegment")


@query("c2_traverse_11", "SELECT a.c_custkey, a.c_name FROM customer a JOIN customer b USING (c_custkey)")
def c2(t: Tables) -> DataFrame:
    return J.traverse_11(t.customer, t.customer.select(F.col("c_custkey").alias("k")), F.expr("c_custkey = k")).select("c_custkey", "c_name")


@query("c3_traverse_1n", "SELECT o_orderkey, l_linenumber, l_partkey, 'EXPLODED' AS _grain_context FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def c3(t: Tables) -> DataFrame:
    return J.traverse_1n(t.orders, t.lineitem, F.expr("o_orderkey = l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "_grain_context")


@query("c4_expand", "SELECT l_orderkey, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS value FROM (SELECT l_orderkey, list_sort(list(l_partkey)) AS a FROM lineitem GROUP BY l_orderkey)")
def c4(t: Tables) -> DataFrame:
    return J.expand(t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("a")), "a")


@query("c5_traverse_nm", "SELECT o_orderkey, p_brand, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def c5(t: Tables) -> DataFrame:
    return J.traverse_nm(t.orders, t.lineitem, t.part, F.expr("o_orderkey = l_orderkey"), F.expr("l_partkey = p_partkey"), ("o_orderkey", "l_orderkey")).groupBy("o_orderkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("c6_path", "SELECT o_orderkey, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def c6(t: Tables) -> DataFrame:
    return J.traverse_path(t.orders, [(t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")]).select("o_orderkey", "r_name")


@query("c7_lookup_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def c7(t: Tables) -> DataFrame:
    return J.lookup_join(t.supplier, t.nation, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_name")


HISTORY = "(SELECT o_custkey, min(o_orderkey) AS version, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to FROM orders GROUP BY o_custkey, o_orderdate)"


def history(t: Tables) -> DataFrame:
    h = t.orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("version"))
    return W.shift(h.withColumnRenamed("o_orderdate", "valid_from"), ["o_custkey"], ["valid_from"], "valid_from", -1, None, "valid_to")


@query("c8_asof_interval", f"SELECT c_custkey, h.version FROM customer LEFT JOIN {HISTORY} h ON h.o_custkey = c_custkey AND h.valid_from <= TIMESTAMP '1998-01-01' AND (h.valid_to IS NULL OR TIMESTAMP '1998-01-01' < h.valid_to)")
def c8(t: Tables) -> DataFrame:
    left = t.customer.withColumn("at", F.lit("1998-01-01").cast("timestamp_ntz"))
    return J.asof_interval(left, history(t), F.expr("o_custkey = c_custkey"), "at").select("c_custkey", "version")


@query("c9_asof_last", "SELECT e.event_id, h.version FROM (SELECT event_id, user_id AS o_custkey, ts - INTERVAL 9000 DAY + INTERVAL (user_id * 20) DAY AS at FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS version FROM orders GROUP BY ALL) h ON e.o_custkey = h.o_custkey AND e.at >= h.o_orderdate")
def c9(t: Tables) -> DataFrame:
    left = t.events.select("event_id", F.col("user_id").alias("o_custkey"), F.expr("ts - interval 9000 day + make_dt_interval(cast(user_id * 20 as int))").alias("at"))
    h = t.orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("version"))
    return J.asof_last(left, h, "o_custkey", "at", "o_orderdate", ["version"]).select("event_id", "version")


@query("c10_latest_join", "SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def c10(t: Tables) -> DataFrame:
    from ..sources.tables import latest_snapshot

    latest = latest_snapshot(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return t.customer.join(latest, F.expr("o_custkey = c_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("last_order"))


@query("c11_exact_epoch", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def c11(t: Tables) -> DataFrame:
    left = t.events.select("event_id", "user_id", F.to_date("ts").alias("epoch"), F.lit("EU").alias("scope"))
    right = t.events.select("user_id").distinct().select("user_id", F.lit("2024-01-05").cast("date").alias("epoch"), F.lit("*").alias("scope"))
    return J.exact_epoch_join(left, right, "user_id", "epoch", "scope")[0].select("event_id")


@query("c12_join_or_error", "SELECT CAST(o_orderkey AS VARCHAR) AS source_key, 'CDME-003' AS error_code FROM orders WHERE o_orderkey % 23 = 0")
def c12(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 23 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("c_custkey"))
    return J.join_or_error(left, t.customer.select("c_custkey", "c_name"), "c_custkey", "o_orderkey")[1].select("source_key", "error_code")


@query("c13_keep_matching", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def c13(t: Tables) -> DataFrame:
    return J.keep_matching(t.orders, t.lineitem, F.expr("o_orderkey = l_orderkey")).select("o_orderkey")


@query("c14_keep_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def c14(t: Tables) -> DataFrame:
    return J.keep_missing(t.orders, t.lineitem, F.expr("o_orderkey = l_orderkey")).select("o_orderkey")


SECOND = "(SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice + CASE WHEN o_orderkey % 101 = 0 THEN 5 WHEN o_orderkey % 11 = 0 THEN 0.005 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 997 <> 0)"


def second(t: Tables) -> DataFrame:
    change = F.when(F.col("o_orderkey") % 101 == 0, 5.0).when(F.col("o_orderkey") % 11 == 0, 0.005).otherwise(0.0)
    return t.orders.where("o_orderkey % 997 <> 0").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") + change).alias("o_totalprice"))


@query("c15_compare", f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'LEFT_ONLY' WHEN a.o_orderkey IS NULL THEN 'RIGHT_ONLY' WHEN a.o_totalprice = b.o_totalprice THEN 'EQUAL' ELSE 'DIFFERENT' END AS status FROM orders a FULL JOIN {SECOND} b ON a.o_orderkey = b.o_orderkey")
def c15(t: Tables) -> DataFrame:
    return J.compare(t.orders, second(t), ["o_orderkey"], ["o_totalprice"])


HOT = "(SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN 1 ELSE l_suppkey END AS k FROM lineitem)"


def hot(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("k", F.when(F.col("l_partkey") % 3 != 0, 1).otherwise(F.col("l_suppkey")).cast("long"))


@query("c16_salted_join", f"SELECT k, s_name, count(*) AS n FROM {HOT} JOIN supplier ON k = s_suppkey GROUP BY ALL")
def c16(t: Tables) -> DataFrame:
    joined = J.salted_join(hot(t), t.supplier.select(F.col("s_suppkey").alias("k"), "s_name"), "k", 8, ["l_orderkey", "l_linenumber", "l_partkey"])
    return joined.groupBy("k", "s_name").agg(F.count(F.lit(1)).alias("n"))


@query("c17_key_skew", f"SELECT k, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem) AS share, count(*) / (SELECT count(*) FROM lineitem) > 0.2 AS hot FROM {HOT} GROUP BY k ORDER BY n DESC, k LIMIT 10")
def c17(t: Tables) -> DataFrame:
    return J.key_skew(hot(t), "k")


@query("c18_align", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def c18(t: Tables) -> DataFrame:
    a, b = J.align_partitions(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", 8)
    return a.join(b, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("c19_fanout", "SELECT sum(l * r) AS joined, max(l) AS max_left, max(r) AS max_right, max(l) <= 1 AS cardinality_holds, sum(l * r) <= 100000 AS within_budget FROM (SELECT coalesce(a.n, 0) AS l, coalesce(b.n, 0) AS r FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k)")
def c19(t: Tables) -> DataFrame:
    return J.fanout_audit(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k", "1:N", 100_000)


@query("d1_aggregate_all", "SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem")
def d1(t: Tables) -> DataFrame:
    return G.aggregate_all(t.lineitem, {"n": F.count(F.lit(1)), "total": total("l_extendedprice"), "low": F.min("l_quantity"), "high": F.max("l_quantity"), "mean": F.round(F.avg("l_quantity"), 6)})


@query("d2_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY ALL")
def d2(t: Tables) -> DataFrame:
    return G.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1)), "quantity": total("l_quantity")})


@query("d3_fold_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def d3(t: Tables) -> DataFrame:
    return G.fold(t.nation, ["n_regionkey"], "n_name", "concat", "names")


@query("d3_fold_product", "SELECT l_orderkey, round(product(1 + l_tax), 6) AS p FROM lineitem GROUP BY l_orderkey")
def d3p(t: Tables) -> DataFrame:
    return G.fold(t.lineitem.withColumn("x", 1 + F.col("l_tax")), ["l_orderkey"], "x", "product", "p").withColumn("p", F.round("p", 6))


@query("d4_identity", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def d4(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return G.fold_or_identity(lines, ["o_orderkey"], t.orders, "l_partkey", "count", "n")


@query("d5_option_fold", "SELECT o_custkey, CAST(sum(CAST(CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey")
def d5(t: Tables) -> DataFrame:
    own = t.orders.withColumn("p", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")))
    return G.aggregate(own, ["o_custkey"], {"total": total("p")})


@query("d6_collect", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def d6(t: Tables) -> DataFrame:
    return G.collect(t.events, ["user_id"], "event_type", "event_id", "types").withColumn("types", F.array_join("types", ","))


def _levels() -> str:
    part = "SELECT o_orderstatus, '{0}' AS level, CAST(date_trunc('{0}', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average FROM orders GROUP BY ALL"
    return " UNION ALL ".join(part.format(x) for x in G.LEVELS)


@query("d7_rollup_levels", _levels())
def d7(t: Tables) -> DataFrame:
    return G.rollup_levels(t.orders, "o_orderdate", ["o_orderstatus"], "o_totalprice")


@query("d8_average", "SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average FROM orders GROUP BY ALL")
def d8(t: Tables) -> DataFrame:
    return G.rollup_levels(t.orders, "o_orderdate", ["o_orderpriority"], "o_totalprice", ["day", "month"]).where("level = 'month'").select("o_orderpriority", "period", "average")


@query("d9_levels_report", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def d9(t: Tables) -> DataFrame:
    return G.levels_report(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1))})


@query("d10_salted_aggregate", f"SELECT k, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS n FROM {HOT} GROUP BY k")
def d10(t: Tables) -> DataFrame:
    own = hot(t).withColumn("q", F.col("l_quantity").cast(MONEY))
    return G.salted_aggregate(own, ["k"], {"quantity": "q"}, 16, ["l_orderkey", "l_linenumber", "l_partkey"]).withColumn("quantity", F.col("quantity").cast("double"))


@query("d12_enriched", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def d12(t: Tables) -> DataFrame:
    return J.lookup_join(t.customer, t.nation, F.expr("c_nationkey = n_nationkey")).where("n_name is not null").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("d13_align_and_combine", "SELECT o_orderkey, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / any_value(o_totalprice), 6) AS ratio FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def d13(t: Tables) -> DataFrame:
    fine = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return G.align_and_combine(fine, t.orders, ["o_orderkey"], {"x": total("l_extendedprice")}, {"ratio": F.round(F.col("x") / F.col("o_totalprice"), 6)})


@query("d14_grain", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d14(t: Tables) -> DataFrame:
    return G.grain_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d15_approx_distinct")
def d15(t: Tables) -> DataFrame:
    return G.approx_distinct(t.lineitem, ["l_returnflag"], "l_partkey")


@query("d16_approx_quantiles")
def d16(t: Tables) -> DataFrame:
    return G.approx_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.5, 0.9, 0.99])


@query("d17_sketch_rollup")
def d17(t: Tables) -> DataFrame:
    return G.sketch_rollup(t.events, "ts", "user_id")


@query("d18_custom_fold", "SELECT user_id, max(value) AS value FROM events GROUP BY user_id")
def d18(t: Tables) -> DataFrame:
    return G.custom_fold(t.events, "user_id", "value", max, 0.0)


@query("d19_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def d19(t: Tables) -> DataFrame:
    return G.aggregate(t.lineitem, ["l_returnflag"], {"parts": F.count_distinct("l_partkey")})


@query("d20_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def d20(t: Tables) -> DataFrame:
    return G.pivot(t.events, ["user_id"], "event_type", F.count(F.lit(1)), ["click", "view"]).na.fill(0)


O = ["o_orderdate", "o_orderkey"]  # noqa: E741


@query("e1_ranks", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
def e1(t: Tables) -> DataFrame:
    out = W.rank_within(t.orders, ["o_custkey"], O, "row_number", "rn")
    out = W.rank_within(out, ["o_custkey"], ["o_orderstatus"], "rank", "rk")
    out = W.rank_within(out, ["o_custkey"], ["o_orderstatus"], "dense_rank", "dr")
    return W.rank_within(out, ["o_custkey"], O, "ntile", "nt").select("o_orderkey", "rn", "rk", "dr", "nt")


@query("e2_running", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def e2(t: Tables) -> DataFrame:
    own = t.orders.withColumn("p", F.col("o_totalprice").cast(MONEY))
    return W.running(own, ["o_custkey"], O, "sum", "p", "running").select("o_orderkey", F.col("running").cast("double").alias("running"))


@query("e3_moving", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 6 PRECEDING) AS high FROM orders")
def e3(t: Tables) -> DataFrame:
    return W.moving(t.orders, ["o_custkey"], O, 6, "max", "o_totalprice", "high").select("o_orderkey", "high")


@query("e4_moving_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, date_trunc('second', ts) AS s FROM events)".replace("epoch(ts)::BIGINT", "CAST(epoch(s) AS BIGINT)"))
def e4(t: Tables) -> DataFrame:
    return W.moving_range(t.events, ["user_id"], F.unix_timestamp(F.col("ts").cast("timestamp")), -86400, 0, "count", "event_id", "n").select("event_id", "n")


@query("e5_shift", "SELECT event_id, lag(event_type, 1, 'none') OVER w AS before, lead(event_type, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def e5(t: Tables) -> DataFrame:
    out = W.shift(t.events, ["user_id"], ["ts", "event_id"], "event_type", 1, "none", "before")
    return W.shift(out, ["user_id"], ["ts", "event_id"], "event_type", -2, None, "after").select("event_id", "before", "after")


@query("e6_edges", "SELECT event_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER w AS last_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def e6(t: Tables) -> DataFrame:
    return W.edge_value(t.events, ["user_id"], ["ts", "event_id"], "event_type", "first_type", "last_type").select("event_id", "first_type", "last_type")


@query("e7_share", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def e7(t: Tables) -> DataFrame:
    return W.share_of_total(t.orders, ["o_custkey"], "o_totalprice", "share").select("o_orderkey", F.round("share", 6).alias("share"))


@query("e8_window_project", "SELECT o_orderkey, row_number() OVER w AS rn, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def e8(t: Tables) -> DataFrame:
    w = W.over(["o_custkey"], O)
    return W.window_project(t.orders, {"rn": F.row_number().over(w), "previous": F.lag("o_orderkey").over(w)}).select("o_orderkey", "rn", "previous")


@query("f1_top_values", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 5")
def f1(t: Tables) -> DataFrame:
    return W.top_values(t.part, "p_brand", 5)


@query("f2_sample_rows", f"SELECT a.o_orderkey FROM orders a JOIN {SECOND} b USING (o_orderkey) WHERE a.o_totalprice <> b.o_totalprice ORDER BY 1 LIMIT 100")
def f2(t: Tables) -> DataFrame:
    return W.sample_rows(J.compare(t.orders, second(t), ["o_orderkey"], ["o_totalprice"]).where("status = 'DIFFERENT'"), ["o_orderkey"]).select("o_orderkey")


@query("f3_timeline", "SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'error') ORDER BY ts, event_id")
def f3(t: Tables) -> DataFrame:
    return W.timeline(t.events, ["signup", "error"]).select("event_id", "event_type")


@query("f4_union_tagged", "SELECT c_custkey AS k, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def f4(t: Tables) -> DataFrame:
    return W.union_tagged({"customer": t.customer.select(F.col("c_custkey").alias("k")), "supplier": t.supplier.select(F.col("s_suppkey").alias("k"))})


@query("f5_distinct_keys", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def f5(t: Tables) -> DataFrame:
    return W.distinct_keys([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))], "k")


@query("f6_missing_extra", "SELECT o_orderkey, 'MISSING' AS issue FROM orders WHERE o_orderkey % 5 = 0")
def f6(t: Tables) -> DataFrame:
    return W.missing_extra(t.orders, [t.orders.where("o_orderkey % 5 in (1, 2)"), t.orders.where("o_orderkey % 5 > 2")], "o_orderkey")


@query("f7_overlap", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 15 = 0")
def f7(t: Tables) -> DataFrame:
    return W.overlap(t.orders.where("o_orderkey % 3 = 0"), t.orders.where("o_orderkey % 5 = 0"), "o_orderkey")
