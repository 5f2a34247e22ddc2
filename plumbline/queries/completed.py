"""Further parts of operators: profiles, pre-flight checks, merges, late strategies, comparisons of runs, sinks read back."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import errors as E
from ..operators import fidelity as K
from ..operators import joins as J
from ..operators import quality as Q
from ..plans import eventlog as M
from ..sources import tables as A
from ..sources.publish import publish, read_published
from .checks import CONS, LATE, lateness, reverse
from .registry import Tables, query
from .shapes import SECOND, second


def scratch(t: Tables, name: str) -> str:
    """A fresh folder under the shared one."""
    return f"{A.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _profile(column: str, declared: str, inferred: str) -> str:
    return f"SELECT '{column}' AS column_name, '{declared}' AS declared_type, CASE WHEN bool_and(v IS NULL OR try_cast(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.')) THEN 'bigint' WHEN bool_and(v IS NULL OR try_cast(v AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS inferred_type, CAST(sum(k) AS BIGINT) AS n, round(coalesce(sum(k) FILTER (v IS NULL), 0) / sum(k), 9) AS null_rate, count(v) AS n_distinct, round(count(*) FILTER (v IS NOT NULL AND k = 1) / sum(k) FILTER (v IS NOT NULL), 9) AS unique_rate, min(len(v)) AS min_length, max(len(v)) AS max_length, arg_max(v, {{'k': k, 'v': v}}) FILTER (v IS NOT NULL) AS top_value, max(k) FILTER (v IS NOT NULL) AS top_count FROM (SELECT {inferred} AS v, count(*) AS k FROM customer GROUP BY 1)"


@query("j9_profile_columns", " UNION ALL ".join((_profile("c_mktsegment", "string", "CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END"), _profile("c_nationkey", "int", "CAST(c_nationkey AS VARCHAR)"), _profile("c_name", "string", "c_name"))))
def j9_columns(t: Tables) -> DataFrame:
    own = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")))
    return Q.profile(own, ["c_mktsegment", "c_nationkey", "c_name"])


@query("j3_top_values", "SELECT l_shipdate AS value, count(*) AS k, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM lineitem GROUP BY 1 ORDER BY k DESC, value LIMIT 20")
def j3_top(t: Tables) -> DataFrame:
    return Q.top_values(t.lineitem, "l_shipdate", 20)


@query("j15_late_errors", f"SELECT CAST(event_id AS VARCHAR) AS source_key, 'LATE' AS error_type, 'CDME-004' AS error_code, CAST(epoch AS VARCHAR) AS epoch FROM {LATE} WHERE late")
def j15_errors(t: Tables) -> DataFrame:
    return Q.late_errors(lateness(t), "event_id").select("source_key", "error_type", "error_code", "epoch")


@query("j15_affected_epochs", f"SELECT epoch, count(*) AS late_rows FROM {LATE} WHERE late GROUP BY epoch")
def j15_epochs(t: Tables) -> DataFrame:
    return Q.affected_epochs(lateness(t))


@query("j15_bounded_route", f"SELECT event_id, CASE WHEN NOT late THEN 'CURRENT' WHEN CAST(processed_at AS DATE) + 1 - epoch > 1 THEN 'ERROR' ELSE 'NEXT_EPOCH' END AS route FROM {LATE}")
def j15_bounded(t: Tables) -> DataFrame:
    return Q.bounded_route(Q.route_late(lateness(t), "ACCUMULATE"), 1).select("event_id", "route")


@query("j18_random", "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 7")
def j18_random(t: Tables) -> DataFrame:
    return Q.share_of(t.orders, "o_orderkey", 7).select("o_orderkey")


@query("k9_contributors", f"SELECT o_custkey, o_orderkey AS source_key FROM orders WHERE o_custkey IN (SELECT o_custkey FROM {CONS} WHERE gap > 1.0)")
def k9_keys(t: Tables) -> DataFrame:
    return K.contributors(K.conservation(t.orders, second(t), ["o_custkey"], "o_totalprice", 0.01), reverse(t), "o_custkey", 1.0)


@query("k5_percent", f"SELECT a.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'CRITICAL' WHEN abs(a.o_totalprice - b.o_totalprice) * 100 >= 0.001 * abs(a.o_totalprice) AND a.o_totalprice <> b.o_totalprice THEN 'MATERIAL' WHEN a.o_totalprice <> b.o_totalprice THEN 'IMMATERIAL' ELSE 'NONE' END AS severity FROM orders a LEFT JOIN {SECOND} b USING (o_orderkey)")
def k5_percent(t: Tables) -> DataFrame:
    both = t.orders.join(second(t).select("o_orderkey", F.col("o_totalprice").alias("b")), "o_orderkey", "left")
    gap = F.abs(F.col("o_totalprice") - F.col("b"))
    return both.select("o_orderkey", K.percent_severity(gap, F.col("o_totalprice"), F.col("b").isNull(), 0.001).alias("severity"))


def _preflight(decision: str) -> str:
    return f"SELECT o_custkey, gap, gap <= 0.01 AS holds, CASE WHEN max(CASE WHEN gap > 0.01 THEN 1 ELSE 0 END) OVER () = 1 THEN '{decision}' ELSE 'ACCEPTED' END AS decision FROM (SELECT o_custkey, CAST(10 * count(*) FILTER (o_orderkey % 50 = 0) AS DOUBLE) AS gap FROM orders GROUP BY o_custkey)"


def proposed(t: Tables, step: float, mode: str) -> DataFrame:
    own = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    changes = own.where("o_orderkey % 50 = 0").withColumn("o_totalprice", F.col("o_totalprice") + step)
    check = lambda after: K.conservation(own, after, ["o_custkey"], "o_totalprice", 0.01)
    return K.preflight(own, changes, ["o_orderkey"], check, mode).select("o_custkey", "gap", "holds", "decision")


@query("k10_strict", _preflight("REJECTED"))
def k10_strict(t: Tables) -> DataFrame:
    return proposed(t, 10, "STRICT")


@query("k10_deferred", _preflight("PENDING"))
def k10_deferred(t: Tables) -> DataFrame:
    return proposed(t, 10, "DEFERRED")


def _measured(step: str, decision: str) -> str:
    """The same from the sums of both sides."""
    after = f"sum(CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + {step} ELSE o_totalprice END AS DECIMAL(20,3)))"
    return f"SELECT o_custkey, gap, gap <= 0.01 AS holds, CASE WHEN max(CASE WHEN gap > 0.01 THEN 1 ELSE 0 END) OVER () = 1 THEN '{decision}' ELSE 'ACCEPTED' END AS decision FROM (SELECT o_custkey, CAST(abs({after} - sum(CAST(o_totalprice AS DECIMAL(20,3)))) AS DOUBLE) AS gap FROM orders GROUP BY o_custkey)"


@query("k10_within_tolerance", _measured("0.002", "REJECTED"))
def k10_tolerance(t: Tables) -> DataFrame:
    return proposed(t, 0.002, "STRICT")


@query("k10_accepted", _measured("0", "WARNED"))
def k10_accepted(t: Tables) -> DataFrame:
    return proposed(t, 0, "ADVISORY")


@query("k12_coverage", "SELECT event_type AS contract, round(100 * count(DISTINCT CAST(ts AS DATE)) / (max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1), 6) AS coverage, DATE '2024-02-10' - max(CAST(ts AS DATE)) AS days_since FROM events WHERE extract('day' FROM ts) % 4 <> 2 GROUP BY 1")
def k12_coverage(t: Tables) -> DataFrame:
    days = t.events.where(F.dayofmonth("ts") % 4 != 2).select(F.col("event_type").alias("contract"), F.to_date("ts").alias("day"))
    return K.chain_coverage(days, F.lit("2024-02-10").cast("date"))


@query("k13_merge", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'A' WHEN c_custkey % 3 = 0 THEN 'B' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 'N' ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN 'c_mktsegment' ELSE '' END AS conflicts FROM customer")
def k13_merge(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_mktsegment", "c_name")
    a = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "A").otherwise(F.col("c_mktsegment")))
    b = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "B").otherwise(F.col("c_mktsegment"))).withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, "N").otherwise(F.col("c_name")))
    return K.merge_columns(base, a, b, "c_custkey", ["c_mktsegment", "c_name"])


@query("k14_diff", f"SELECT count(*) FILTER (a.o_orderkey IS NULL) AS added, count(*) FILTER (b.o_orderkey IS NULL) AS removed, count(*) FILTER (a.o_totalprice <> b.o_totalprice) AS changed FROM (SELECT * FROM orders WHERE o_orderkey % 13 <> 0) a FULL JOIN {SECOND} b USING (o_orderkey)")
def k14_diff(t: Tables) -> DataFrame:
    return K.diff_runs(t.orders.where("o_orderkey % 13 <> 0"), second(t), ["o_orderkey"], ["o_totalprice"])


@query("c1_duplicate_targets", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def c1_report(t: Tables) -> DataFrame:
    return J.duplicate_targets(t.lineitem, "l_orderkey")


@query("a1_formats", "SELECT 'csv' AS format, n_nationkey, n_name FROM nation UNION ALL SELECT 'json', n_nationkey, n_name FROM nation")
def a1_formats(t: Tables) -> DataFrame:
    out = None
    for kind in ("csv", "json"):
        at = scratch(t, kind)
        t.nation.select("n_nationkey", "n_name").write.format(kind).save(at)
        part = A.read_source(t.spark, A.Binding(kind, at, "n_nationkey int, n_name string")).select(F.lit(kind).alias("format"), "n_nationkey", "n_name")
        out = part if out is None else out.unionByName(part)
    return out


@query("a2_slice_version", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def a2_version(t: Tables) -> DataFrame:
    return A.slice_version(t.orders, "o_orderpriority", "1-URGENT").select("o_orderkey")


@query("a5_read_alias", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def a5_alias(t: Tables) -> DataFrame:
    aliases = t.orders.select(F.when(F.col("o_orderstatus") == "F", "current").otherwise("old").alias("alias"), F.col("o_orderstatus").alias("version")).distinct()
    return A.read_alias(t.orders, "o_orderstatus", aliases, "current").select("o_orderkey")


@query("a6_write_result", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def a6_sink(t: Tables) -> DataFrame:
    at = scratch(t, "result")
    own = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    A.write_result(own, at, ["o_orderstatus"])
    A.write_result(own.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), at, ["o_orderstatus"])
    return t.spark.read.parquet(at).select(*own.columns)


@query("a7_write_errors", "SELECT CAST(c_custkey AS VARCHAR) AS source_key, 'REFINEMENT' AS error_type FROM customer WHERE NOT c_acctbal > 0")
def a7_sink(t: Tables) -> DataFrame:
    at = scratch(t, "errors")
    A.write_errors(E.split_valid(t.customer, F.col("c_acctbal") > 0, "c_custkey")[1], at)
    return t.spark.read.parquet(at).select("source_key", "error_type")


@query("a8_merge_since", "SELECT event_id, CASE WHEN CAST(ts AS DATE) > DATE '2024-01-20' THEN value + 1 ELSE value END AS value FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20' OR event_id % 2 = 0")
def a8_since(t: Tables) -> DataFrame:
    own = t.events.select("event_id", F.to_date("ts").alias("day"), "value")
    target = own.where("event_id % 2 = 0 and day <= date '2024-01-20'")
    late = own.where("event_id % 2 = 0 and day > date '2024-01-20'").limit(0)
    return A.merge_since(target.unionByName(late), own.withColumn("value", F.col("value") + 1), ["event_id"], "day", closed=False).select("event_id", "value")


@query("a9_malformed", "SELECT count(*) FILTER (event_id % 50 <> 0) AS parsed, count(*) FILTER (event_id % 50 = 0) AS malformed FROM events")
def a9_malformed(t: Tables) -> DataFrame:
    line = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value", "props"))
    return A.malformed(*A.parse_events(t.events.select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 25)).otherwise(line).alias("value"))))


@query("a9_facets", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def a9_facets(t: Tables) -> DataFrame:
    return A.flattened(t.events, "props", ["k"]).select("event_id", "k")


@query("i8_commit_if", "SELECT o_orderkey, 'published' AS outcome FROM orders WHERE o_totalprice > 50000 UNION ALL SELECT o_orderkey, 'kept' FROM orders WHERE o_orderkey % 2 = 0")
def i8_commit(t: Tables) -> DataFrame:
    ok, old = t.orders.where("o_totalprice > 50000").select("o_orderkey"), t.orders.where("o_orderkey % 2 = 0").select("o_orderkey")
    first, second_one = scratch(t, "published"), scratch(t, "kept")
    publish(old, second_one)
    E.commit_if(ok, False, scratch(t, "staging"), first)
    E.commit_if(ok, True, scratch(t, "staging"), second_one)
    return read_published(t.spark, first).withColumn("outcome", F.lit("published")).unionByName(read_published(t.spark, second_one).withColumn("outcome", F.lit("kept")))


@query("j2_rolling", "SELECT day, n, round(b, 4) AS mean, round(s, 4) AS deviation, k AS seen, CASE WHEN k < 2 THEN 'NO_BASELINE' WHEN abs(n - b) > 1.5 * s AND n < b THEN 'LOW' WHEN abs(n - b) > 1.5 * s THEN 'HIGH' ELSE 'OK' END AS status FROM (SELECT *, avg(n) OVER w AS b, stddev_samp(n) OVER w AS s, count(n) OVER w AS k FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE extract('day' FROM ts) % 5 <> 3 GROUP BY 1) WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))")
def j2_rolling(t: Tables) -> DataFrame:
    return Q.rolling_baseline(Q.daily_volume(t.events.where(F.dayofmonth("ts") % 5 != 3), "ts"), 7, 1.5)


@query("c16_hot_join", "SELECT l_orderkey, l_linenumber, l_partkey, s_name FROM (SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN 1 ELSE l_suppkey END AS k FROM lineitem) JOIN supplier ON k = s_suppkey")
def c16_hot(t: Tables) -> DataFrame:
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 3 != 0, 1).otherwise(F.col("l_suppkey")).alias("s_suppkey"))
    return J.hot_join(left, t.supplier.select("s_suppkey", "s_name"), "s_suppkey", 8, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "s_name")


@query("m4_curve_rows", "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position, CAST(json_extract(props, '$.k') AS INTEGER) AS delta FROM events WHERE ts <= TIMESTAMP '2024-01-20'")
def m4_rows(t: Tables) -> DataFrame:
    return M.curve_rows(t.events, F.lit("2024-01-20").cast("timestamp_ntz"), F.get_json_object("props", "$.k").cast("int"))


@query("m8_gap_signals", "SELECT o_orderkey, 'orders' AS origin, 'total' AS dimension, abs(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 100 ELSE o_totalprice END - o_totalprice) AS gap, o_orderkey % 5 = 0 AS breach FROM orders UNION ALL SELECT o_orderkey, 'orders', 'customer', CAST(o_custkey % 3 AS DOUBLE), o_custkey % 3 > 1 FROM orders")
def m8_gaps(t: Tables) -> DataFrame:
    paid = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice"))
    dims = {"total": (F.col("o_totalprice"), paid, 1.0), "customer": (F.lit(0.0), (F.col("o_custkey") % 3).cast("double"), 1.0)}
    return M.gap_signals(t.orders, "o_orderkey", dims, "orders")


@query("m10_mandatory", "SELECT n_name, count(c_custkey) AS entities, CASE WHEN count(c_custkey) > 0 THEN 'COVERED' WHEN any_value(n_regionkey) < 2 THEN 'MISSING' ELSE 'OPTIONAL' END AS status FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 4 = 0) ON c_nationkey = n_nationkey GROUP BY n_name")
def m10_mandatory(t: Tables) -> DataFrame:
    dims = t.nation.select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    own = M.mandatory_coverage(dims, t.customer.where("c_nationkey % 4 = 0").select(F.col("c_nationkey").alias("k")), "k", F.col("n_regionkey") < 2)
    return own.select("n_name", "entities", "status")


@query("m11_tag_status", "WITH keys AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-z]+)', 1) AS key FROM documents), a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\bthe ([a-z]+)', 1)) AS tag FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\bof ([a-z]+)', 1)) AS tag FROM documents) SELECT lower(key) AS key, CASE WHEN a.tag IS NOT NULL AND b.tag IS NOT NULL THEN 'BOTH' WHEN a.tag IS NOT NULL THEN 'FIRST' WHEN b.tag IS NOT NULL THEN 'SECOND' ELSE 'NEITHER' END AS status FROM (SELECT DISTINCT lower(key) AS key FROM keys) LEFT JOIN a ON a.tag = key LEFT JOIN b ON b.tag = key")
def m11_status(t: Tables) -> DataFrame:
    keys = t.documents.select(F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("key")).distinct()
    return M.tag_status(keys, "key", t.documents, "text", r"\bthe ([a-z]+)", r"\bof ([a-z]+)")


@query("m14_convergence", "SELECT user_id, CAST(floor(epoch(z)) - floor(epoch(b)) AS BIGINT) AS seconds, CASE WHEN e < coalesce(z, TIMESTAMP '9999-01-01') THEN 'escalated' WHEN floor(epoch(z)) - floor(epoch(b)) <= 86400 THEN 'delta_zero' WHEN floor(epoch(m)) - floor(epoch(b)) > 86400 THEN 'timeout' ELSE 'open' END AS kind FROM (SELECT user_id, min(b) AS b, min(ts) FILTER (CAST(json_extract(props, '$.k') AS INTEGER) = 0) AS z, min(ts) FILTER (event_type = 'error') AS e, max(ts) AS m FROM events JOIN (SELECT user_id, min(ts) AS b FROM events WHERE event_type = 'signup' GROUP BY 1) USING (user_id) WHERE ts >= b GROUP BY user_id)")
def m14_kinds(t: Tables) -> DataFrame:
    own = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return M.convergence(own, "user_id", "signup", F.get_json_object("props", "$.k").cast("int"), 86_400, "error")


@query("m15_claim_counts", "SELECT user_id, CAST(ts AS DATE) AS edge, count(*) FILTER (event_type = 'signup') AS granted, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type = 'purchase') AS released, count(*) FILTER (event_type = 'view') AS expired FROM events WHERE event_type IN ('signup', 'error', 'purchase', 'view') GROUP BY 1, 2")
def m15_claims(t: Tables) -> DataFrame:
    return M.claim_counts(t.events, "user_id", F.to_date("ts"), {"signup": "granted", "error": "rejected", "purchase": "released", "view": "expired"})


@query("m17_latest_hash", "SELECT user_id, sha256(max_by(props, (ts, event_id))) AS content_hash FROM events GROUP BY user_id")
def m17_hash(t: Tables) -> DataFrame:
    return M.latest_hash(t.events, "user_id", "props")
