"""Queries over lineage, errors, data quality and fidelity (survey sections H to K)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import errors as E
from ..operators import fidelity as K
from ..operators import lineage as L
from ..operators import quality as Q
from ..operators import windows as W
from .registry import Tables, query
from .shapes import SECOND, second

def rows():
    return F.count(F.lit(1))


@query("h1_excluded", "SELECT o_orderkey, 'o_totalprice > 100000' AS predicate FROM orders WHERE NOT o_totalprice > 100000")
def h1(t: Tables) -> DataFrame:
    return L.filter_traced(t.orders, F.col("o_totalprice") > 100000, "o_orderkey", "o_totalprice > 100000")[1]


def reverse(t: Tables) -> DataFrame:
    return L.aggregate_traced(t.orders, ["o_custkey"], {"n": rows()}, "o_orderkey")[1]


@query("h2_reverse_table", "SELECT o_custkey, o_orderkey AS source_key FROM orders")
def h2(t: Tables) -> DataFrame:
    return reverse(t)


@query("h3_parent_map", "SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(generate_subscripts(a, 1) - 1 AS VARCHAR) AS child_key, l_orderkey AS parent_key FROM (SELECT l_orderkey, list(l_partkey) AS a FROM lineitem GROUP BY l_orderkey)")
def h3(t: Tables) -> DataFrame:
    return L.expand_traced(t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("a")), "a", "l_orderkey")[1]


@query("h4_join_pairs", "SELECT o_orderkey AS left_key, c_custkey AS right_key FROM orders JOIN customer ON o_custkey = c_custkey")
def h4(t: Tables) -> DataFrame:
    return L.join_traced(t.orders, t.customer, F.expr("o_custkey = c_custkey"), "o_orderkey", "c_custkey")[1]


@query("h5_backward", "SELECT DISTINCT o_orderkey AS source_key FROM orders WHERE o_custkey % 50 = 0")
def h5(t: Tables) -> DataFrame:
    return L.backward(t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("o_custkey")), reverse(t), ["o_custkey"])


@query("h6_impact", "SELECT DISTINCT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (1, 2)")
def h6(t: Tables) -> DataFrame:
    keys = t.nation.where("n_nationkey in (1, 2)").select("n_nationkey")
    return L.impact(keys, [(t.customer.select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey"), (t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")])


@query("h7_reconcile", "SELECT o_orderkey AS source_key FROM orders WHERE o_orderstatus = 'P'")
def h7(t: Tables) -> DataFrame:
    kept = t.orders.where("o_orderstatus <> 'P'")
    return L.reconcile(t.orders, L.aggregate_traced(kept, ["o_custkey"], {"n": rows()}, "o_orderkey")[1], "o_orderkey")


@query("h8_reconstruct", "SELECT o_orderkey FROM orders")
def h8(t: Tables) -> DataFrame:
    ok, out = L.filter_traced(t.orders, F.col("o_totalprice") > 100000, "o_orderkey", "p")
    return ok.select("o_orderkey").unionByName(out.select("o_orderkey"))


@query("h9_envelopes", "SELECT o_custkey, min(o_orderkey) AS start_key, max(o_orderkey) AS end_key, count(*) AS n FROM orders GROUP BY o_custkey")
def h9(t: Tables) -> DataFrame:
    return L.capture_lineage(reverse(t), "o_custkey", "KEY_DERIVABLE")


@query("h9_sampled")
def h9s(t: Tables) -> DataFrame:
    return L.capture_lineage(reverse(t), "o_custkey", "SAMPLED")


@query("h10_rebuild", "SELECT o_custkey, count(*) FILTER (o_orderkey BETWEEN a AND b) AS inside, max(n) AS n, count(*) FILTER (o_orderkey BETWEEN a AND b) = max(n) AS complete FROM orders JOIN (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) USING (o_custkey) GROUP BY o_custkey")
def h10(t: Tables) -> DataFrame:
    captured = L.aggregate_traced(t.orders.where("o_orderstatus <> 'P'"), ["o_custkey"], {"n": rows()}, "o_orderkey")[1]
    return L.rebuild_from_envelopes(t.orders, "o_orderkey", L.capture_lineage(captured, "o_custkey", "KEY_DERIVABLE"), "o_custkey")


@query("h11_islands", "SELECT o_orderstatus, min(k) AS start_key, max(k) AS end_key, count(*) AS n FROM (SELECT o_orderstatus, o_orderkey AS k, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g FROM orders) GROUP BY o_orderstatus, g")
def h11(t: Tables) -> DataFrame:
    return L.islands(t.orders.select("o_orderstatus", F.col("o_orderkey").alias("source_key")), "o_orderstatus")


@query("h12_lineage", "SELECT 'orders' AS entity, '2024' AS epoch, 'orders.customer' AS path, 'rates=3' AS lookups, o_custkey AS output_key, count(*) AS n_sources FROM orders GROUP BY o_custkey")
def h12(t: Tables) -> DataFrame:
    return L.lineage_table(reverse(t), "orders", "2024", "orders.customer", {"rates": "3"}, "o_custkey")


@query("h13_attribution", "SELECT o_custkey, o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def h13(t: Tables) -> DataFrame:
    return L.attribute(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey")


@query("h14_subject", "SELECT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS record_key FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 100 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def h14(t: Tables) -> DataFrame:
    subjects = t.customer.where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("k"))
    return L.find_subject({"customer": (t.customer, "c_custkey", "c_custkey"), "orders": (t.orders, "o_custkey", "o_orderkey")}, subjects, "k")


@query("h15_step_class", "SELECT count(DISTINCT o_orderkey) AS sources, count(DISTINCT o_custkey) AS targets, count(DISTINCT o_orderkey) AS all_sources, count(DISTINCT o_orderkey) = count(DISTINCT o_custkey) AS injective, count(DISTINCT o_orderkey) = (SELECT count(DISTINCT o_orderkey) FROM orders) AS total, CASE WHEN count(DISTINCT o_orderkey) = count(DISTINCT o_custkey) THEN 'ISOMORPHISM' ELSE 'PROJECTION' END AS step_class FROM orders")
def h15(t: Tables) -> DataFrame:
    return L.measure_class(reverse(t), t.orders, "o_orderkey", "o_custkey")


@query("i1_split_ok", "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def i1(t: Tables) -> DataFrame:
    return E.split_valid(t.customer, F.col("c_acctbal") > 0, "c_custkey")[0].select("c_custkey")


@query("i1_split_errors", "SELECT CAST(c_custkey AS VARCHAR) AS source_key, 'REFINEMENT' AS error_type FROM customer WHERE NOT coalesce(c_acctbal > 0, false)")
def i1e(t: Tables) -> DataFrame:
    return E.split_valid(t.customer, F.col("c_acctbal") > 0, "c_custkey")[1].select("source_key", "error_type")


@query("i2_validate", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity BETWEEN 1 AND 45 AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL AND regexp_matches(l_linestatus, '^[FO]$')")
def i2(t: Tables) -> DataFrame:
    rules = [("l_quantity", "RANGE", "1:45"), ("l_returnflag", "ALLOWED", ["A", "R"]), ("l_shipdate", "NOT_NULL", None), ("l_linestatus", "PATTERN", "^[FO]$")]
    return S.filter_rows(t.lineitem, *[E.rule_column(*r) for r in rules]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("i3_rules", "SELECT o_orderkey AS source_key, 'positive' AS rule_id, 'ERROR' AS severity, 'CDME-001' AS error_code, 'price' AS message FROM orders WHERE NOT o_totalprice > 50000 UNION ALL SELECT o_orderkey, 'recent', 'WARNING', 'CDME-001', 'date' FROM orders WHERE NOT o_orderdate > TIMESTAMP '1996-01-01'")
def i3(t: Tables) -> DataFrame:
    rules = [E.Rule("positive", F.col("o_totalprice") > 50000, message="price"), E.Rule("recent", F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz"), "WARNING", message="date")]
    return E.apply_rules(t.orders, rules, "o_orderkey")[1]


@query("i4_lookup_rule", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def i4(t: Tables) -> DataFrame:
    return E.validate_lookup(t.customer, "c_nationkey", t.nation.where("n_regionkey < 3"), "n_nationkey").select("c_custkey")


@query("i5_error_record", "SELECT CAST(c_custkey AS VARCHAR) AS source_key, 'TYPE' AS error_type, 'CDME-002' AS error_code, 'c_name' AS path, 'bigint' AS expected, c_name AS actual, 'run' AS run_id, 'epoch' AS epoch FROM customer")
def i5(t: Tables) -> DataFrame:
    return S.safe_cast(t.customer, "c_name", "bigint", "c_custkey")[1].drop("context")


@query("i6_threshold", "SELECT count(*) FILTER (c_acctbal <= 0) AS errors, count(*) AS total, count(*) FILTER (c_acctbal <= 0) > 0.05 * count(*) AS halt FROM customer")
def i6(t: Tables) -> DataFrame:
    counts = t.customer.agg(F.count_if(F.col("c_acctbal") <= 0).alias("errors"), rows().alias("total"))
    return counts.withColumn("halt", E.threshold(F.col("errors"), F.col("total"), share=0.05))


@query("i7_breaker", "SELECT count(*) AS sampled, count(*) FILTER (o_totalprice <= 50000) AS failed, count(*) FILTER (o_totalprice <= 50000) / count(*) AS rate, count(*) FILTER (o_totalprice <= 50000) / count(*) > 0.05 AS tripped FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10000)")
def i7(t: Tables) -> DataFrame:
    return E.circuit_breaker(t.orders, F.col("o_totalprice") > 50000, "o_orderkey")


@query("i10_account_keys", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'MISSING' ELSE 'OVERLAP' END AS issue FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 10 = 0")
def i10(t: Tables) -> DataFrame:
    base = t.orders.where("o_orderkey % 7 <> 0")
    return E.account_keys(t.orders, {"processed": base.where("o_orderkey % 5 <> 1 or o_orderkey % 10 = 0"), "errored": base.where("o_orderkey % 5 = 1 or o_orderkey % 10 = 0")}, "o_orderkey")


@query("i11_account_reverse", "SELECT o_orderkey AS key, 'MISSING' AS issue FROM orders WHERE o_orderstatus = 'P'")
def i11(t: Tables) -> DataFrame:
    rev = L.aggregate_traced(t.orders.where("o_orderstatus <> 'P'"), ["o_custkey"], {"n": rows()}, "o_orderkey")[1]
    return E.account_keys(t.orders, {"aggregated": rev.select(F.col("source_key").alias("o_orderkey"))}, "o_orderkey")


@query("i12_error_summary", "SELECT 'REFINEMENT' AS error_type, 'CDME-001' AS error_code, 'epoch' AS epoch, count(*) AS n FROM customer WHERE c_acctbal <= 0")
def i12(t: Tables) -> DataFrame:
    return E.error_summary(E.split_valid(t.customer, F.col("c_acctbal") > 0, "c_custkey")[1])


def _equal(low: int) -> str:
    return f"WITH a AS (SELECT c_custkey FROM customer WHERE NOT c_acctbal > 0), b AS (SELECT c_custkey FROM customer WHERE NOT c_acctbal > {low}) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS same"


@query("i13_other_errors", _equal(500))
def i13b(t: Tables) -> DataFrame:
    a, b = (E.split_valid(t.customer, F.col("c_acctbal") > low, "c_custkey")[1] for low in (0, 500))
    return E.same_errors(a, b)


@query("i13_same_errors", _equal(0))
def i13(t: Tables) -> DataFrame:
    a = E.split_valid(t.customer, F.col("c_acctbal") > 0, "c_custkey")[1]
    return E.same_errors(a, E.split_valid(t.customer.repartition(3), F.col("c_acctbal") > 0, "c_custkey")[1].withColumn("run_id", F.lit("second")))


@query("i14_step_metrics", "SELECT count(*) AS rows, count(*) FILTER (c_name IS NULL) / count(*) AS null_rate_c_name, count(*) FILTER (c_acctbal <= 0) AS violations FROM customer")
def i14(t: Tables) -> DataFrame:
    return E.step_metrics(t.customer, ["c_name"], F.col("c_acctbal") > 0)


@query("i15_lookup_conflicts", "SELECT l_partkey, CAST(date_trunc('year', l_shipdate) AS DATE) AS epoch, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def i15(t: Tables) -> DataFrame:
    return E.lookup_conflicts(t.lineitem.withColumn("epoch", F.date_trunc("year", "l_shipdate").cast("date")), "l_partkey", "l_suppkey", "epoch")


DAILY = "(SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)"


@query("j1_volume", f"SELECT day, n, CASE WHEN n = 0 THEN 'EMPTY' WHEN n < 330 THEN 'LOW' WHEN n > 350 THEN 'HIGH' ELSE 'OK' END AS status FROM {DAILY}")
def j1(t: Tables) -> DataFrame:
    return Q.volume_check(Q.daily_volume(t.events, "ts"), 330, 350)


@query("j2_baseline", f"SELECT day, n, round(b, 4) AS baseline, low, high, CASE WHEN b IS NULL THEN 'NO_BASELINE' WHEN n < 0.95 * round(b, 4) THEN 'LOW' WHEN n > 1.05 * round(b, 4) THEN 'HIGH' ELSE 'OK' END AS status FROM (SELECT *, avg(n) OVER w AS b, min(n) OVER w AS low, max(n) OVER w AS high FROM {DAILY} WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))")
def j2(t: Tables) -> DataFrame:
    return Q.volume_baseline(Q.daily_volume(t.events, "ts"), F.lit(0), 7, 0.95, 1.05)


@query("j3_field_metrics", "SELECT 'o_totalprice' AS column_name, count(*) AS n, 0.0 AS null_rate, count(DISTINCT o_totalprice) AS n_distinct, min(o_totalprice) AS low, max(o_totalprice) AS high, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS mean, round(stddev_samp(o_totalprice), 2) AS deviation, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders")
def j3(t: Tables) -> DataFrame:
    return Q.field_metrics(t.orders, ["o_totalprice"])


@query("j4_histogram", "SELECT least(9, greatest(0, CAST(floor((value - 0) / 50.0) AS INTEGER))) AS bin, count(*) AS n FROM events GROUP BY 1")
def j4(t: Tables) -> DataFrame:
    return Q.histogram(t.events, "value", 0.0, 500.0, 10)


CUT = "TIMESTAMP '2024-01-15'"


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return t.events.where(F.col("ts") < cut), t.events.where(F.col("ts") >= cut)


@query("j5_drift_threshold", f"SELECT *, round(abs(p99_b - p99_a) / abs(p99_a), 6) AS p99_change, abs(p99_b - p99_a) / abs(p99_a) > 0.01 AS drifted FROM (SELECT 0.0 AS null_a, count(DISTINCT value) FILTER (ts < {CUT}) AS distinct_a, round(quantile_cont(value, 0.99) FILTER (ts < {CUT}), 4) AS p99_a, 0.0 AS null_b, count(DISTINCT value) FILTER (ts >= {CUT}) AS distinct_b, round(quantile_cont(value, 0.99) FILTER (ts >= {CUT}), 4) AS p99_b FROM events)")
def j5(t: Tables) -> DataFrame:
    return Q.drift_threshold(*halves(t), "value", 0.01)


FREQ = f"(SELECT event_type, count(*) FILTER (ts < {CUT}) AS e, count(*) FILTER (ts >= {CUT}) AS o, sum(count(*) FILTER (ts < {CUT})) OVER () AS te, sum(count(*) FILTER (ts >= {CUT})) OVER () AS t2, count(*) OVER () AS k FROM events GROUP BY event_type)"


@query("j6_drift_chi2", f"SELECT round(sum((o - x) * (o - x) / x), 6) AS chi2, count(*) - 1 AS freedom FROM (SELECT o, greatest(e, 0.5) / CAST(te AS DOUBLE) * t2 AS x FROM {FREQ})")
def j6(t: Tables) -> DataFrame:
    return Q.drift_chi2(*halves(t), "event_type")


@query("j7_drift_kl", f"SELECT round(sum(p * ln(p / q)), 9) AS kl FROM (SELECT (o + 1) / CAST(t2 + k AS DOUBLE) AS p, (e + 1) / CAST(te + k AS DOUBLE) AS q FROM {FREQ})")
def j7(t: Tables) -> DataFrame:
    return Q.drift_kl(*halves(t), "event_type")


@query("j8_drift_ks", f"SELECT round(max(abs(ce / CAST(te AS DOUBLE) - co / CAST(t2 AS DOUBLE))), 9) AS ks FROM (SELECT sum(e) OVER (ORDER BY bin) AS ce, sum(o) OVER (ORDER BY bin) AS co, sum(e) OVER () AS te, sum(o) OVER () AS t2 FROM (SELECT least(19, CAST(floor(value / 25.0) AS INTEGER)) AS bin, count(*) FILTER (ts < {CUT}) AS e, count(*) FILTER (ts >= {CUT}) AS o FROM events GROUP BY 1))")
def j8(t: Tables) -> DataFrame:
    return Q.drift_ks(*halves(t), "value", 0.0, 500.0, 20)


@query("j9_profile", "SELECT 'l_quantity' AS column_name, count(*) AS n, 0.0 AS null_rate, count(DISTINCT l_quantity) AS n_distinct, min(l_quantity) AS low, max(l_quantity) AS high, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS mean, round(stddev_samp(l_quantity), 2) AS deviation, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(quantile_cont(l_quantity, 0.99), 4) AS p99 FROM lineitem UNION ALL SELECT 'l_discount', count(*), 0.0, count(DISTINCT l_discount), min(l_discount), max(l_discount), round(CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4), round(stddev_samp(l_discount), 2), round(quantile_cont(l_discount, 0.5), 4), round(quantile_cont(l_discount, 0.99), 4) FROM lineitem")
def j9(t: Tables) -> DataFrame:
    return Q.field_metrics(t.lineitem, ["l_quantity", "l_discount"])


@query("j10_patterns", "SELECT regexp_replace(regexp_replace(c_name, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS pattern, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 9) AS share FROM customer GROUP BY 1")
def j10(t: Tables) -> DataFrame:
    return Q.patterns(t.customer, "c_name")


@query("j11_referential", "SELECT count(*) FILTER (o_orderkey % 23 <> 0) AS valid, count(*) FILTER (o_orderkey % 23 = 0) AS orphan, round(count(*) FILTER (o_orderkey % 23 = 0) / count(*), 9) AS orphan_rate FROM orders")
def j11(t: Tables) -> DataFrame:
    own = t.orders.withColumn("fk", F.when(F.col("o_orderkey") % 23 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")))
    return Q.referential(own, "fk", t.customer, "c_custkey")


@query("j12_freshness", "SELECT event_type, max(ts) AS newest, round((epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 3600.0, 4) AS age_hours, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 3600.0 > 24.5 AS stale FROM events GROUP BY event_type")
def j12(t: Tables) -> DataFrame:
    own = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return Q.freshness(own, "event_type", "at", F.lit("2024-01-31").cast("timestamp"), 24.5).withColumn("newest", F.col("newest").cast("timestamp_ntz"))


@query("j13_expectations", "SELECT 'row_count_min' AS expectation, CAST(count(*) AS DOUBLE) AS measured, CASE WHEN count(*) >= 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders UNION ALL SELECT 'null_rate_max:p', round(r, 9), CASE WHEN r > 0.1 THEN 'FAIL' WHEN r > 0.05 THEN 'WARN' ELSE 'PASS' END FROM (SELECT count(*) FILTER (o_orderkey % 17 = 0) / count(*) AS r FROM orders) UNION ALL SELECT 'null_rate_max:o_orderkey', r, CASE WHEN r > 0.1 THEN 'FAIL' WHEN r > 0.05 THEN 'WARN' ELSE 'PASS' END FROM (SELECT count(*) FILTER (o_orderkey IS NULL) / count(*) AS r FROM orders)")
def j13(t: Tables) -> DataFrame:
    own = t.orders.withColumn("p", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")))
    return Q.expectations(own, 100, {"p": 0.1, "o_orderkey": 0.1})


LATE = "(SELECT event_id, CAST(ts AS DATE) AS epoch, ts + INTERVAL (event_id % 9) HOUR AS processed_at, ts + INTERVAL (event_id % 9) HOUR > date_trunc('day', ts) + INTERVAL 26 HOUR + INTERVAL 2 HOUR AS late FROM events)"


def lateness(t: Tables) -> DataFrame:
    own = t.events.withColumn("processed_at", F.expr("ts + make_dt_interval(0, cast(event_id % 9 as int))"))
    return Q.mark_late(own, "ts", "processed_at", 2, 2)


@query("j14_mark_late", f"SELECT event_id, epoch, late FROM {LATE}")
def j14(t: Tables) -> DataFrame:
    return lateness(t).select("event_id", "epoch", "late")


@query("j15_route_late", f"SELECT event_id, CASE WHEN late THEN 'NEXT_EPOCH' ELSE 'CURRENT' END AS route, CASE WHEN late THEN CAST(processed_at AS DATE) + 1 ELSE epoch END AS target_epoch FROM {LATE}")
def j15(t: Tables) -> DataFrame:
    return Q.route_late(lateness(t), "ACCUMULATE").select("event_id", "route", "target_epoch")


@query("j16_quarantine", f"SELECT event_id, CAST(ts AS DATE) IN (SELECT day FROM {DAILY} WHERE n < 330) AS quarantined FROM events")
def j16(t: Tables) -> DataFrame:
    bad = Q.daily_volume(t.events, "ts").where("n < 330").withColumnRenamed("day", "epoch")
    return Q.act(t.events.withColumn("epoch", F.to_date("ts")), bad, "QUARANTINE").select("event_id", "quarantined")


@query("j17_dedupe", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1")
def j17(t: Tables) -> DataFrame:
    return Q.dedupe(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j18_reservoir", "SELECT o_orderkey FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200")
def j18(t: Tables) -> DataFrame:
    return Q.reservoir(t.orders, 200, "o_orderkey").select("o_orderkey")


@query("j18_stratified", "SELECT o_orderkey, o_orderstatus FROM orders WHERE substr(sha256(o_orderstatus || ':' || CAST(o_orderkey AS VARCHAR)), 1, 2) < '1a'")
def j18s(t: Tables) -> DataFrame:
    return Q.stratified(t.orders, "o_orderstatus", "o_orderkey", "1a").select("o_orderkey", "o_orderstatus")


CONS = f"(SELECT coalesce(a.k, b.k) AS o_custkey, CAST(x AS DOUBLE) AS total_a, CAST(y AS DOUBLE) AS total_b, CAST(abs(coalesce(x, 0) - coalesce(y, 0)) AS DOUBLE) AS gap FROM (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(20,3))) AS x FROM orders GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(20,3))) AS y FROM {SECOND} GROUP BY 1) b ON a.k = b.k)"


@query("k1_conservation", f"SELECT *, gap <= 0.01 AS holds FROM {CONS}")
def k1(t: Tables) -> DataFrame:
    return K.conservation(t.orders, second(t), ["o_custkey"], "o_totalprice", 0.01)


@query("k2_coverage", f"SELECT a.k AS o_custkey, x AS n_a, coalesce(y, 0) AS n_b, coalesce(y, 0) >= x AS holds FROM (SELECT o_custkey AS k, count(*) AS x FROM orders GROUP BY 1) a LEFT JOIN (SELECT o_custkey AS k, count(*) AS y FROM {SECOND} GROUP BY 1) b ON a.k = b.k")
def k2(t: Tables) -> DataFrame:
    return K.coverage(t.orders, second(t), ["o_custkey"])


@query("k3_alignment", f"SELECT a.o_orderkey, a.o_totalprice AS value_a, b.o_totalprice AS value_b FROM orders a JOIN {SECOND} b USING (o_orderkey) WHERE a.o_totalprice <> b.o_totalprice")
def k3(t: Tables) -> DataFrame:
    return K.alignment(t.orders, second(t), "o_orderkey", "o_totalprice")


@query("k4_containment", "SELECT o_orderkey FROM orders WHERE o_orderkey % 997 = 0")
def k4(t: Tables) -> DataFrame:
    return K.containment(t.orders, second(t), "o_orderkey")


@query("k5_severity", f"SELECT a.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'CRITICAL' WHEN abs(a.o_totalprice - b.o_totalprice) >= 1 THEN 'MATERIAL' WHEN a.o_totalprice <> b.o_totalprice THEN 'IMMATERIAL' ELSE 'NONE' END AS severity FROM orders a LEFT JOIN {SECOND} b USING (o_orderkey)")
def k5(t: Tables) -> DataFrame:
    b = second(t).select("o_orderkey", F.col("o_totalprice").alias("b"))
    both = t.orders.join(b, "o_orderkey", "left")
    return both.select("o_orderkey", K.severity(F.abs(F.col("o_totalprice") - F.col("b")), F.col("b").isNull(), 1.0).alias("severity"))


def _grains() -> str:
    part = f"SELECT '{{0}}' AS level, count(*) AS periods, count(*) FILTER (x IS DISTINCT FROM y) AS differ FROM (SELECT date_trunc('{{0}}', o_orderdate) AS p, sum(CAST(o_totalprice AS DECIMAL(20,3))) AS x FROM orders GROUP BY 1) a FULL JOIN (SELECT date_trunc('{{0}}', o_orderdate) AS p, sum(CAST(o_totalprice AS DECIMAL(20,3))) AS y FROM {SECOND} GROUP BY 1) b USING (p)"
    return " UNION ALL ".join(part.format(x) for x in ("day", "month", "year"))


@query("k6_multi_grain", _grains())
def k6(t: Tables) -> DataFrame:
    return K.multi_grain(t.orders, second(t), "o_orderdate", "o_totalprice", ["day", "month", "year"])


@query("k7_sample_check")
def k7(t: Tables) -> DataFrame:
    return K.sample_check(t.orders, second(t), "o_orderkey", "o_totalprice", 20)


@query("k8_delta_check", f"SELECT o_custkey, total_a, total_b, gap, gap <= 0.01 AS holds FROM {CONS} WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 101 = 0)")
def k8(t: Tables) -> DataFrame:
    changed = t.orders.where("o_orderkey % 101 = 0").select("o_custkey")
    a, b = (d.join(changed, "o_custkey", "left_semi") for d in (t.orders, second(t)))
    return K.conservation(a, b, ["o_custkey"], "o_totalprice", 0.01)


@query("k9_breaches", f"SELECT c.o_custkey, total_a AS expected, total_b AS actual, round(gap - 1.0, 3) AS excess, n_sources, first_source, last_source FROM {CONS} c JOIN (SELECT o_custkey, count(*) AS n_sources, min(o_orderkey) AS first_source, max(o_orderkey) AS last_source FROM orders GROUP BY 1) r USING (o_custkey) WHERE gap > 1.0")
def k9(t: Tables) -> DataFrame:
    return K.breaches(K.conservation(t.orders, second(t), ["o_custkey"], "o_totalprice", 0.01), reverse(t), "o_custkey", 1.0)


@query("k10_preflight", "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(20,3))) AS DOUBLE) AS total_a, CAST(sum(CAST(o_totalprice AS DECIMAL(20,3))) + 10 * count(*) FILTER (o_orderkey % 50 = 0) AS DOUBLE) AS total_b, CAST(10 * count(*) FILTER (o_orderkey % 50 = 0) AS DOUBLE) AS gap, count(*) FILTER (o_orderkey % 50 = 0) = 0 AS holds FROM orders GROUP BY o_custkey")
def k10(t: Tables) -> DataFrame:
    from ..sources.tables import merge_upsert

    own = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    changes = own.where("o_orderkey % 50 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 10)
    return K.conservation(own, merge_upsert(own, changes, ["o_orderkey"]), ["o_custkey"], "o_totalprice", 0.01)


@query("k11_fingerprint")
def k11(t: Tables) -> DataFrame:
    return K.fingerprint(t.orders)


@query("k12_chain", "SELECT event_type AS contract, count(*) AS n, count(*) FILTER (p IS NOT NULL AND p <> q) AS broken, count(*) FILTER (day - before > 1) AS gaps, max(day) AS last_day FROM (SELECT *, lag(day) OVER (PARTITION BY event_type ORDER BY day) AS before, lag(h) OVER (PARTITION BY event_type ORDER BY day) AS p, CASE WHEN day = DATE '2024-01-10' THEN 'broken' ELSE lag(h) OVER (PARTITION BY event_type ORDER BY day) END AS q FROM (SELECT event_type, CAST(ts AS DATE) AS day, sha256(event_type || CAST(count(*) AS VARCHAR)) AS h FROM events GROUP BY 1, 2)) GROUP BY 1")
def k12(t: Tables) -> DataFrame:
    per = t.events.groupBy(F.col("event_type").alias("contract"), F.to_date("ts").alias("day")).agg(rows().alias("n"))
    certs = W.shift(per.withColumn("hash", F.sha2(F.concat("contract", F.col("n").cast("string")), 256)), ["contract"], ["day"], "hash", 1, None, "previous")
    broken = certs.withColumn("previous", F.when(F.col("day") == "2024-01-10", "broken").otherwise(F.col("previous")))
    return K.verify_chain(broken)


@query("k13_sync", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'A' WHEN c_custkey % 2 = 0 THEN 'A' WHEN c_custkey % 3 = 0 THEN 'B' ELSE c_mktsegment END AS merged, c_custkey % 6 = 0 AS conflict FROM customer")
def k13(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_mktsegment")
    a = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "A").otherwise(F.col("c_mktsegment")))
    b = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "B").otherwise(F.col("c_mktsegment")))
    return K.sync(base, a, b, "c_custkey", "c_mktsegment", "SOURCE_WINS")


@query("k14_diff_runs", f"SELECT count(*) FILTER (b.o_orderkey IS NULL) AS removed, count(*) FILTER (a.o_totalprice <> b.o_totalprice) AS changed FROM orders a LEFT JOIN {SECOND} b USING (o_orderkey)")
def k14(t: Tables) -> DataFrame:
    from ..operators.joins import compare

    status = compare(t.orders, second(t), ["o_orderkey"], ["o_totalprice"])
    return status.agg(F.count_if(F.col("status") == "LEFT_ONLY").alias("removed"), F.count_if(F.col("status") == "DIFFERENT").alias("changed"))
