"""Queries over the event log and batch twins of the streams (survey sections L and M)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import windows as W
from ..plans import eventlog as M
from ..streaming import streams as L
from .registry import Tables, query

AT = "TIMESTAMP '2024-01-15'"


def at():
    return F.lit("2024-01-15").cast("timestamp_ntz")


@query("l1_mapping_batch", "SELECT event_id, user_id IN (SELECT c_custkey FROM customer) AND value > 100 AS valid FROM events")
def l1(t: Tables) -> DataFrame:
    lookup = t.customer.select("c_custkey")
    return L.stream_mapping(t.events, lookup, F.expr("user_id = c_custkey"), F.expr("c_custkey is not null and value > 100")).select("event_id", "valid")


@query("l2_epochs_batch", "SELECT date_trunc('day', ts) AS epoch_start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2))), 2) AS total FROM events GROUP BY ALL")
def l2(t: Tables) -> DataFrame:
    out = L.stream_epochs(t.events.withColumn("value", F.col("value").cast("decimal(18,2)")), "ts", "1 day", "2 hours")
    return out.select(F.col("epoch_start").cast("timestamp_ntz").alias("epoch_start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("l3_route_late_batch", "SELECT CASE WHEN late THEN 'BACKFILL' ELSE 'CURRENT' END AS route, count(*) AS n FROM (SELECT ts + INTERVAL (event_id % 9) HOUR > date_trunc('day', ts) + INTERVAL 28 HOUR AS late FROM events) GROUP BY 1")
def l3(t: Tables) -> DataFrame:
    own = t.events.withColumn("processed_at", F.expr("ts + make_dt_interval(0, cast(event_id % 9 as int))"))
    return L.stream_route_late(own, "ts", "processed_at", 2, 2, "BACKFILL").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("l5_dedupe_batch", "SELECT DISTINCT event_id FROM events")
def l5(t: Tables) -> DataFrame:
    return Q.dedupe(t.events.union(t.events), ["event_id"], ["ts"]).select("event_id")


@query("l6_bursts", "SELECT user_id, min(ts) AS begun, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s")
def l6(t: Tables) -> DataFrame:
    return L.bursts(t.events, "user_id", "ts", "6 hours").select("user_id", "begun", "n")


@query("l7_volume_batch", "SELECT event_type, count(*) AS n, CASE WHEN count(*) < 1500 THEN 'LOW' WHEN count(*) > 2100 THEN 'HIGH' ELSE 'OK' END AS status FROM events GROUP BY event_type")
def l7(t: Tables) -> DataFrame:
    return Q.volume_check(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), 1500, 2100)


@query("m1_regimes", "SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'conscious' WHEN event_type IN ('click', 'view') THEN 'reflex' ELSE 'unclassified' END AS regime, event_type, count(*) AS n FROM events GROUP BY ALL")
def m1(t: Tables) -> DataFrame:
    return M.regime_summary(t.events, {"conscious": ["purchase", "signup"], "reflex": ["click", "view"]})


@query("m2_density", "SELECT bucket, n, round(n / max(n) OVER (), 9) AS density FROM (SELECT b AS bucket, count(epoch_us) AS n FROM range(10) r(b) LEFT JOIN (SELECT epoch_us, least(9, CAST(floor((epoch_us - lo) / CAST(hi - lo AS DOUBLE) * 10) AS INTEGER)) AS k FROM (SELECT epoch_us(ts) AS epoch_us FROM events), (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)) ON k = b GROUP BY b)")
def m2(t: Tables) -> DataFrame:
    return M.event_density(t.events, "ts", 10)


STATE = "SELECT user_id, count(*) FILTER (event_type = 'view') AS iterations, min(ts) FILTER (event_type = 'view') AS started_at, max(ts) FILTER (event_type = 'purchase') AS converged_at, max_by(event_type, (ts, event_id)) AS last_type, CASE WHEN min(ts) FILTER (event_type = 'view') IS NULL THEN 'NOT_STARTED' WHEN max(ts) FILTER (event_type = 'purchase') >= min(ts) FILTER (event_type = 'view') THEN 'CONVERGED' ELSE 'IN_PROGRESS' END AS status FROM events WHERE ts <= {} GROUP BY user_id"


@query("m3_state_asof", STATE.format(AT))
def m3(t: Tables) -> DataFrame:
    return M.state_asof(t.events, at(), "view", "purchase")


@query("m3_state_tenant", STATE.format(AT + " AND user_id = 7"))
def m3t(t: Tables) -> DataFrame:
    return M.state_asof(t.events, at(), "view", "purchase", 7)


@query("m4_edge_status", f"SELECT event_type, count(*) AS iterations, string_agg(CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR), ',' ORDER BY ts, event_id) AS curve FROM events WHERE ts <= {AT} GROUP BY event_type")
def m4(t: Tables) -> DataFrame:
    return M.edge_status_asof(t.events, at(), F.get_json_object("props", "$.k").cast("bigint"))


@query("m5_matrix", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def m5(t: Tables) -> DataFrame:
    return M.matrix(t.events, "user_id", "event_type", ["click", "view", "error"])


@query("m6_hierarchy", "WITH RECURSIVE known AS (SELECT p_partkey AS id, CASE WHEN p_partkey // 10 IN (SELECT p_partkey FROM part) AND p_partkey // 10 <> p_partkey THEN p_partkey // 10 END AS parent FROM part), tree AS (SELECT id, id AS root, 1 AS depth FROM known WHERE parent IS NULL UNION ALL SELECT k.id, tree.root, tree.depth + 1 FROM known k JOIN tree ON k.parent = tree.id) SELECT id, root, depth FROM tree")
def m6(t: Tables) -> DataFrame:
    return M.hierarchy(t.part.select("p_partkey", F.expr("p_partkey div 10").alias("up")), "p_partkey", "up", 6)


@query("m7_pass_ratio", "SELECT event_type, CAST(count(*) FILTER (value > 200) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) || ' pass' AS ratio FROM events GROUP BY event_type")
def m7(t: Tables) -> DataFrame:
    return M.pass_ratio(t.events, "event_type", F.col("value") > 200)


@query("m8_signals", "SELECT event_type, CASE WHEN value < 10 THEN 'BELOW' ELSE 'ABOVE' END AS side, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND (value < 10 OR value > 400) GROUP BY ALL")
def m8(t: Tables) -> DataFrame:
    return M.signals(t.events, {"click": (10.0, 400.0), "view": (10.0, 400.0)})


@query("m9_all_signals", "SELECT origin, event_type, side, count(*) AS n FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS origin, event_type, CASE WHEN value < 10 THEN 'BELOW' ELSE 'ABOVE' END AS side FROM events WHERE event_type = 'click' AND (value < 10 OR value > 400)) GROUP BY ALL")
def m9(t: Tables) -> DataFrame:
    limits = {"click": (10.0, 400.0)}
    parts = {n: M.signals(t.events.where(f"user_id % 2 = {k}"), limits) for k, n in enumerate(("even", "odd"))}
    return W.union_tagged(parts)


@query("m10_coverage", "SELECT r_name, count(n_nationkey) AS entities, count(n_nationkey) > 0 AS covered FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def m10(t: Tables) -> DataFrame:
    dims = t.region.select(F.col("r_regionkey").alias("k"), "r_name")
    return M.dimension_coverage(dims, t.nation.select(F.col("n_regionkey").alias("k")), "k").select("r_name", "entities", "covered")


@query("m11_tags", "WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\bthe ([a-z]+)ing\\b', 1)) AS tag FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\bof ([a-z]+)ing\\b', 1)) AS tag FROM documents) SELECT coalesce(a.tag, b.tag) AS tag, CASE WHEN a.tag IS NULL THEN 'SECOND' WHEN b.tag IS NULL THEN 'FIRST' ELSE 'BOTH' END AS status FROM a FULL JOIN b ON a.tag = b.tag")
def m11(t: Tables) -> DataFrame:
    return M.tag_coverage(t.documents, "text", r"\bthe ([a-z]+)ing\b", r"\bof ([a-z]+)ing\b")


@query("m12_chains", "WITH RECURSIVE known AS (SELECT event_id AS id, CASE WHEN event_id // 7 IN (SELECT event_id FROM events) AND event_id // 7 <> event_id THEN event_id // 7 END AS parent FROM events), tree AS (SELECT id, id AS root, 1 AS depth FROM known WHERE parent IS NULL UNION ALL SELECT k.id, tree.root, tree.depth + 1 FROM known k JOIN tree ON k.parent = tree.id) SELECT id, root, depth FROM tree")
def m12(t: Tables) -> DataFrame:
    return M.causal_chains(t.events.select("event_id", F.expr("event_id div 7").alias("prior")), "event_id", "prior", 8)


@query("m13_followups", "SELECT user_id, turn, min_by(event_id, (ts, event_id)) AS event_id, bool_or(event_type = 'view') AS has_view, bool_or(event_type = 'click') AS has_click, bool_or(event_type = 'view') AND bool_or(event_type = 'click') AS complete FROM (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events) WHERE turn > 0 GROUP BY user_id, turn")
def m13(t: Tables) -> DataFrame:
    return M.followups(t.events, "signup", ["view", "click"])


@query("m14_durations", "WITH b AS (SELECT user_id, min(ts) AS begun FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, CAST(floor(epoch(ts)) - floor(epoch(begun)) AS BIGINT) AS seconds, event_type AS ended_by FROM events JOIN b USING (user_id) WHERE event_type IN ('purchase', 'error') AND ts >= begun QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def m14(t: Tables) -> DataFrame:
    return M.durations(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "view", ["purchase", "error"])


@query("m15_claims", "SELECT user_id, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def m15(t: Tables) -> DataFrame:
    return M.matrix(t.events, "user_id", "event_type", ["signup", "purchase"])


@query("m16_entity_modules", "SELECT o_custkey, count(DISTINCT l_suppkey) AS modules, count(DISTINCT CASE WHEN l_suppkey IS NULL THEN o_orderkey END) AS untraced FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def m16(t: Tables) -> DataFrame:
    tags = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return M.entity_modules(t.orders, tags, "o_custkey", "o_orderkey", "l_suppkey")


@query("m17_transactions", "SELECT run, CASE WHEN s IS NULL THEN 'ORPHAN' WHEN c IS NULL THEN 'OPEN' ELSE c END AS state FROM (SELECT event_id // 3 AS run, min(ts) FILTER (event_type = 'view') AS s, max_by(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')) AS c FROM events WHERE event_type IN ('view', 'purchase', 'error') GROUP BY 1)")
def m17(t: Tables) -> DataFrame:
    return M.transactions(t.events.withColumn("run", F.expr("event_id div 3")), "run", "view", ["purchase", "error"])
