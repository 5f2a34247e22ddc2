"""Queries over segmented scans, selection, compact reverse tables, telemetry and streams run to their end."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..operators import errors as E
from ..operators import fidelity as K
from ..operators import joins as J
from ..operators import lineage as L
from ..operators import quality as Q
from ..operators import windows as W
from ..plans import eventlog as M
from ..sources import publish as P
from ..streaming import streams as X
from .checks import CUT, halves
from .completed import scratch
from .registry import Tables, query
from .shapes import HOT, hot

# segmented scans, on keys of which one holds two thirds of all rows ---------------------------------------------------


@query("e2_running_hot", f"SELECT l_orderkey, l_linenumber, l_partkey, sum(CAST(l_quantity AS BIGINT)) OVER w AS total, count(*) OVER w AS n, max(CAST(l_quantity AS BIGINT)) OVER w AS most FROM {HOT} WINDOW w AS (PARTITION BY k ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def e2_hot(t: Tables) -> DataFrame:
    own = hot(t).withColumn("q", F.col("l_quantity").cast("long")).withColumn("one", F.lit(1))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    own = W.running_many(own, ["k"], order, {"total": ("sum", "q"), "n": ("count", "one"), "most": ("max", "q")}, rows=2000)
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "total", "n", "most")


@query("c9_asof_hot", f"SELECT l_orderkey, l_linenumber, l_partkey, h.version FROM {HOT} e ASOF LEFT JOIN (SELECT CASE WHEN o_custkey % 3 <> 0 THEN 1 ELSE o_custkey END AS k2, o_orderdate, max(o_orderkey) AS version FROM orders GROUP BY 1, 2) h ON e.k = h.k2 AND e.l_shipdate >= h.o_orderdate")
def c9_hot(t: Tables) -> DataFrame:
    key = F.when(F.col("o_custkey") % 3 != 0, 1).otherwise(F.col("o_custkey")).cast("long").alias("k")
    h = t.orders.groupBy(key, "o_orderdate").agg(F.max("o_orderkey").alias("version"))
    return J.asof_last(hot(t), h, "k", "l_shipdate", "o_orderdate", ["version"], rows=2000).select("l_orderkey", "l_linenumber", "l_partkey", "version")


@query("h11_islands_hot", "SELECT s AS target, min(k) AS start_key, max(k) AS end_key, count(*) AS n FROM (SELECT s, k, k - row_number() OVER (PARTITION BY s ORDER BY k) AS g FROM (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'rare' ELSE 'hot' END AS s, o_orderkey AS k FROM orders)) GROUP BY s, g")
def h11_hot(t: Tables) -> DataFrame:
    pairs = t.orders.select(F.when(F.col("o_orderkey") % 5 == 0, "rare").otherwise("hot").alias("target"), F.col("o_orderkey").alias("source_key"))
    return L.islands(pairs, "target", rows=500)


FOLLOW = "SELECT 0 AS user_id, event_id, ts, event_type FROM events WHERE user_id % 3 <> 0 UNION ALL SELECT user_id, event_id, ts, event_type FROM events WHERE user_id % 3 = 0"


@query("m13_followups_hot", f"SELECT user_id, turn, arg_min(event_id, (ts, event_id)) AS event_id, coalesce(bool_or(event_type = 'view'), false) AS has_view FROM (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM ({FOLLOW})) WHERE turn > 0 GROUP BY user_id, turn")
def m13_hot(t: Tables) -> DataFrame:
    own = t.events.withColumn("user_id", F.when(F.col("user_id") % 3 != 0, 0).otherwise(F.col("user_id")))
    return M.followups(own, "click", ["view"], rows=500).select("user_id", "turn", "event_id", "has_view")


# selection ------------------------------------------------------------------------------------------------------------

NULLED = "(SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS value, ts, event_id FROM events)"


@query("j3_metrics_nulls", f"SELECT 'value' AS column_name, count(*) AS n, count(*) FILTER (value IS NULL) / count(*) AS null_rate, count(DISTINCT value) AS n_distinct, min(value) AS low, max(value) AS high, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 4) AS mean, round(stddev_samp(value), 2) AS deviation, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.99), 4) AS p99 FROM {NULLED}")
def j3_nulls(t: Tables) -> DataFrame:
    return Q.field_metrics(t.events.select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")), ["value"])


@query("j5_drift_flags", f"WITH m AS (SELECT count(*) FILTER (value IS NULL AND ts < {CUT}) / count(*) FILTER (ts < {CUT}) AS na, count(*) FILTER (value IS NULL AND ts >= {CUT}) / count(*) FILTER (ts >= {CUT}) AS nb, count(DISTINCT value) FILTER (ts < {CUT}) AS da, count(DISTINCT value) FILTER (ts >= {CUT}) AS db, round(quantile_cont(value, 0.99) FILTER (ts < {CUT}), 4) AS pa, round(quantile_cont(value, 0.99) FILTER (ts >= {CUT}), 4) AS pb FROM (SELECT CASE WHEN event_id % (CASE WHEN ts < {CUT} THEN 7 ELSE 3 END) <> 0 THEN value END AS value, ts FROM events)) SELECT 'null_rate_max' AS metric, na AS base, nb AS current, NULL::DOUBLE AS change, 0.3 AS \"limit\", nb > 0.3 AS flagged FROM m UNION ALL SELECT 'null_rate_change', na, nb, round(abs(nb - na), 6), 0.1, abs(nb - na) > 0.1 FROM m UNION ALL SELECT 'cardinality_change', da, db, round(abs(db - da) / da, 6), 0.25, abs(db - da) / da > 0.25 FROM m UNION ALL SELECT 'percentile_99_change', pa, pb, round(abs(pb - pa) / abs(pa), 6), 0.05, abs(pb - pa) / abs(pa) > 0.05 FROM m")
def j5_flags(t: Tables) -> DataFrame:
    before, after = halves(t)
    base, now = (d.select(F.when(F.col("event_id") % n != 0, F.col("value")).alias("value")) for d, n in ((before, 7), (after, 3)))
    return Q.drift_flags(base, now, "value", 0.3, 0.1, 0.25, 0.05)


def _numbers(column: str, declared: str, inferred: str) -> str:
    v = f"CAST({column} AS DOUBLE)"
    cuts = ", ".join(f"round(quantile_cont({v}, {f}), 4) AS {n}" for n, f in (("median", 0.5), *Q.PERCENTILES.items()))
    return f"SELECT '{column}' AS column_name, '{declared}' AS declared_type, '{inferred}' AS inferred_type, count(*) AS n, count(DISTINCT {column}) AS n_distinct, min({v}) AS low, max({v}) AS high, round(CAST(sum(CAST({column} AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS mean, round(stddev_samp({v}), 2) AS deviation, {cuts}, CAST(NULL AS VARCHAR) AS pattern FROM customer"


@query("j9_full_profile", f"{_numbers('c_acctbal', 'double', 'double')} UNION ALL {_numbers('c_nationkey', 'int', 'bigint')} UNION ALL SELECT 'c_name', 'string', 'string', count(*), count(DISTINCT c_name), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT regexp_replace(regexp_replace(c_name, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS p FROM customer GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) FROM customer")
def j9_full(t: Tables) -> DataFrame:
    out = Q.full_profile(t.customer, ["c_acctbal", "c_nationkey", "c_name"])
    return out.select("column_name", "declared_type", "inferred_type", "n", "n_distinct", "low", "high", "mean", "deviation", "median", *Q.PERCENTILES, "pattern")


# one partitioning for several joins, sketches, databases --------------------------------------------------------------


@query("c17_heavy_keys", f"SELECT k, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem) AS share, count(*) / (SELECT count(*) FROM lineitem) > 0.2 AS hot FROM {HOT} GROUP BY k ORDER BY n DESC, k LIMIT 10")
def c17_heavy(t: Tables) -> DataFrame:
    own = hot(t)
    sketches = None
    for mode in ("R", "A", "N"):
        part = J.key_sketch(own.where(F.col("l_returnflag") == mode), "k")
        sketches = part if sketches is None else sketches.unionByName(part)
    return J.heavy_keys(own, sketches, "k")


@query("c18_three_joins", "SELECT o_orderkey, o_custkey, lines, parts FROM orders JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 10 GROUP BY 1) b ON b.l_orderkey = o_orderkey")
def c18_three(t: Tables) -> DataFrame:
    keyed = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    lines = keyed.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    parts = keyed.where("l_quantity > 10").groupBy("o_orderkey").agg(F.count_distinct("l_partkey").alias("parts"))
    return J.colocated([t.orders.select("o_orderkey", "o_custkey"), lines, parts], "o_orderkey", 8)


# compact reverse tables, classes, chains, telemetry ---------------------------------------------------------------------


def _pairs(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderstatus").alias("target"), F.col("o_orderkey").alias("source_key"))


@query("h11_reverse_forms", "SELECT form, o_orderstatus AS target, o_orderkey AS source_key FROM orders, (VALUES ('ARRAY'), ('BITMAP'), ('RANGES')) f(form)")
def h11_forms(t: Tables) -> DataFrame:
    out = None
    for form in ("ARRAY", "BITMAP", "RANGES"):
        own = L.reverse_pairs(L.reverse_table(_pairs(t), "target", form), "target", form).select(F.lit(form).alias("form"), "target", F.col("source_key").cast("long").alias("source_key"))
        out = own if out is None else out.unionByName(own)
    return out


@query("h11_retention", "SELECT o_orderstatus AS target, o_orderkey AS source_key FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY")
def h11_retention(t: Tables) -> DataFrame:
    aged = t.orders.select(F.col("o_orderstatus").alias("target"), F.col("o_orderkey").alias("source_key"), F.col("o_orderdate").alias("created_at"))
    return L.prune(aged, F.lit("2000-01-01").cast("timestamp_ntz"), 365).select("target", "source_key")


@query("h11_merged_bitmaps", "SELECT o_orderstatus AS target, o_orderkey AS source_key FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def h11_merged(t: Tables) -> DataFrame:
    runs = [L.reverse_table(_pairs(t).where(f"source_key % {n} = 0"), "target", "BITMAP") for n in (2, 3)]
    return L.reverse_pairs(L.merged_bitmaps(runs, "target"), "target", "BITMAP")


@query("h15_composed", "WITH a AS (SELECT count(DISTINCT o_orderkey) = count(DISTINCT o_custkey) AS inj, count(DISTINCT o_orderkey) = (SELECT count(DISTINCT o_orderkey) FROM orders) AS tot FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT count(DISTINCT c_custkey) = count(DISTINCT c_name) AS inj, true AS tot FROM customer) SELECT CASE WHEN a.inj AND b.inj AND a.tot AND b.tot THEN 'ISOMORPHISM' WHEN a.inj AND b.inj THEN 'EMBEDDING' WHEN a.tot AND b.tot THEN 'PROJECTION' ELSE 'LOSSY' END AS chain_class FROM a, b")
def h15_composed(t: Tables) -> DataFrame:
    first = L.measure_class(t.orders.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("source_key"), F.col("o_custkey").alias("target")), t.orders, "o_orderkey", "target")
    second = L.measure_class(t.customer.select(F.col("c_custkey").alias("source_key"), F.col("c_name").alias("target")), t.customer, "c_custkey", "target")
    both = first.select(F.col("step_class").alias("a")).crossJoin(second.select(F.col("step_class").alias("b")))  # one row each
    return both.select(L.composed_class(F.col("a"), F.col("b")).alias("chain_class"))


PRIORS = "CASE WHEN event_id % 11 = 0 THEN CAST([] AS BIGINT[]) ELSE [event_id // 7, event_id // 5 + 1] END"


@query("m12_prior_chains", f"WITH RECURSIVE n AS (SELECT event_id AS id, {PRIORS} AS ps FROM events), e AS (SELECT DISTINCT id, p FROM (SELECT id, unnest(ps) AS p FROM n) WHERE p <> id AND p IN (SELECT id FROM n)), r AS (SELECT id, id AS root, 1 AS depth FROM n WHERE id NOT IN (SELECT id FROM e) UNION SELECT e.id, r.root, r.depth + 1 FROM r JOIN e ON e.p = r.id), d AS (SELECT id, max(depth) AS depth FROM r GROUP BY id) SELECT DISTINCT r.id, r.root, d.depth FROM r JOIN d ON d.id = r.id")
def m12_priors(t: Tables) -> DataFrame:
    priors = F.when(F.col("event_id") % 11 != 0, F.array(F.expr("event_id div 7"), F.expr("event_id div 5 + 1"))).otherwise(F.array().cast("array<bigint>"))
    return M.prior_chains(t.events.select("event_id", priors.alias("priors")), "event_id", "priors")


@query("m4_edge_features", "SELECT event_type, count(*) AS iterations, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(d, (ts, event_id)) AS first_delta, arg_max(d, (ts, event_id)) AS last_delta, min(d) AS least_delta, arg_max(d, (ts, event_id)) = 0 AS converged FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS d FROM events WHERE ts <= TIMESTAMP '2024-01-20') GROUP BY event_type")
def m4_features(t: Tables) -> DataFrame:
    return M.edge_features(t.events, F.lit("2024-01-20").cast("timestamp_ntz"), F.get_json_object("props", "$.k").cast("int"))


@query("i14_telemetry", "WITH o AS (SELECT *, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS p FROM orders), k AS (SELECT * FROM o WHERE o_orderstatus = 'F') SELECT 'filter' AS step, (SELECT count(*) FROM o) AS rows_in, count(*) AS rows_out, count(*) FILTER (p IS NULL OR p <= 100000) AS violations, 'p' AS column_name, count(*) FILTER (p IS NULL) / count(*) AS null_rate FROM k UNION ALL SELECT 'join', (SELECT count(*) FROM k), count(*), 0, 'c_name', count(*) FILTER (c_name IS NULL) / count(*) FROM k LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def i14_telemetry(t: Tables) -> DataFrame:
    seen = E.Telemetry()
    own = t.orders.withColumn("p", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")))
    kept = seen.measured("filter", own, lambda d: d.where("o_orderstatus = 'F'"), ["p"], F.col("p") > 100_000)
    lookup = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    joined = seen.measured("join", kept, lambda d: d.join(lookup, F.expr("o_custkey = c_custkey"), "left"), ["c_name"])
    P.publish(joined.select("o_orderkey", "p", "c_name"), scratch(t, "telemetry"))
    return seen.rows(t.spark).where("column_name is not null")


@query("i3_messages", "SELECT c_custkey AS source_key, 'positive' AS rule_id, 'balance of customer ' || c_custkey || ' in ' || c_mktsegment || ' must be positive' AS message FROM customer WHERE c_acctbal <= 0")
def i3_messages(t: Tables) -> DataFrame:
    rule = E.Rule("positive", F.col("c_acctbal") > 0, message="balance of customer {c_custkey} in {c_mktsegment} must be positive")
    return E.apply_rules(t.customer, [rule], "c_custkey")[1].select("source_key", "rule_id", "message")


@query("b6_distinct_keys", "SELECT count(*) AS n_keys FROM (SELECT DISTINCT a, b FROM (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS a, o_orderpriority AS b FROM orders UNION ALL SELECT coalesce(o_orderstatus, '~') || '|', o_orderpriority FROM orders UNION ALL SELECT o_orderstatus, '|' || o_orderpriority FROM orders UNION ALL SELECT '~', o_orderpriority FROM orders))")
def b6_distinct(t: Tables) -> DataFrame:
    o = t.orders
    rows = [o.select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("a"), F.col("o_orderpriority").alias("b")), o.select(F.concat("o_orderstatus", F.lit("|")).alias("a"), F.col("o_orderpriority").alias("b")), o.select(F.col("o_orderstatus").alias("a"), F.concat(F.lit("|"), "o_orderpriority").alias("b")), o.select(F.lit("~").alias("a"), F.col("o_orderpriority").alias("b"))]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return S.surrogate_key(every, ["a", "b"]).agg(F.count_distinct("sk").alias("n_keys"))


@query("c15_null_keys", "SELECT x.k, CASE WHEN y.n IS NULL THEN 'LEFT_ONLY' WHEN x.n = y.n THEN 'EQUAL' ELSE 'DIFFERENT' END AS status FROM (SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS k, count(*) AS n FROM customer GROUP BY 1) x LEFT JOIN (SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS k, count(*) AS n FROM customer WHERE c_nationkey <> 5 GROUP BY 1) y ON x.k IS NOT DISTINCT FROM y.k")
def c15_nulls(t: Tables) -> DataFrame:
    key = F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("k")
    a, b = (d.groupBy(key).agg(F.count(F.lit(1)).alias("n")) for d in (t.customer, t.customer.where("c_nationkey <> 5")))
    return J.compare(a, b, ["k"], ["n"])


@query("f6_extra", "SELECT o_orderkey, 'MISSING' AS issue FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT l_orderkey + 100000000, 'EXTRA' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 7 = 0)")
def f6_extra(t: Tables) -> DataFrame:
    parts = [t.orders.where("o_orderkey % 10 <> 0"), t.lineitem.where("l_orderkey % 7 = 0").select((F.col("l_orderkey") + 100_000_000).alias("o_orderkey"))]
    return W.missing_extra(t.orders, parts, "o_orderkey")


@query("j1_volume_empty", "SELECT CAST(d AS DATE) AS day, count(event_id) AS n, CASE WHEN count(event_id) = 0 THEN 'EMPTY' WHEN count(event_id) < 5 THEN 'LOW' WHEN count(event_id) > 30 THEN 'HIGH' ELSE 'OK' END AS status FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) r(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) AND event_id % 7 < 3 GROUP BY 1")
def j1_empty(t: Tables) -> DataFrame:
    days = t.spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-02')) as day")
    own = Q.daily_volume(t.events.where("event_id % 7 < 3"), "ts")
    return Q.volume_check(days.join(own, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n")), 5, 30)


def _acted(action: str) -> str:
    kept = {"HALT": "WHERE v.d IS NULL", "WARN": "", "QUARANTINE": ""}[action]
    return f"SELECT event_id, {'v.d IS NOT NULL' if action == 'QUARANTINE' else 'false'} AS quarantined FROM events LEFT JOIN (SELECT CAST(ts AS DATE) AS d FROM events GROUP BY 1 HAVING avg(value) > (SELECT avg(value) FROM events)) v ON CAST(ts AS DATE) = v.d {kept}"


def _act(action: str):
    @query(f"j16_{action.lower()}_epochs", _acted(action))
    def j16(t: Tables) -> DataFrame:
        own = t.events.withColumn("epoch", F.to_date("ts"))
        mean = own.agg(F.avg("value").alias("m"))  # one row
        bad = own.groupBy("epoch").agg(F.avg("value").alias("a")).crossJoin(mean).where("a > m")
        return Q.act(own, bad, action).select("event_id", "quarantined")

    return j16


for _action in ("HALT", "WARN", "QUARANTINE"):
    _act(_action)


@query("k8_incremental", f"SELECT a.o_custkey, a.s AS total_a, b.s AS total_b, abs(coalesce(a.s, 0) - coalesce(b.s, 0)) AS gap, abs(coalesce(a.s, 0) - coalesce(b.s, 0)) <= 0.01 AS holds FROM (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,3))) AS DOUBLE) AS s FROM orders GROUP BY 1) a LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,3))) AS DOUBLE) AS s FROM orders WHERE o_orderkey % 997 <> 0 GROUP BY 1) b USING (o_custkey) WHERE a.o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 997 = 0)")
def k8_incremental(t: Tables) -> DataFrame:
    changed = t.orders.where("o_orderkey % 997 = 0").select("o_custkey")
    return K.incremental(t.orders, t.orders.where("o_orderkey % 997 <> 0"), changed, ["o_custkey"], "o_totalprice", 0.01)


# streams over the events in three files, in order of time, run to the end of what is there --------------------------------


def stream(t: Tables, name: str) -> tuple[DataFrame, str]:
    """The events as a stream of three batches, and the folder that it may use."""
    at = scratch(t, name)
    own = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for low, high in (("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01")):
        own.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return t.spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), at


def each_batch(df: DataFrame, at: str, step) -> None:
    df.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def written_stream(df: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """All rows that a stream gives, with the batch that gave them."""

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/n={number}")

    df.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/out")


@query("l1_threshold_batches", "SELECT event_id, value > 10 AS ok FROM events")
def l1_threshold(t: Tables) -> DataFrame:
    events, at = stream(t, "threshold")
    each_batch(events, at, X.threshold_sink(F.col("value") > 10, f"{at}/out", share=0.2))
    good, bad = X.committed(t.spark, f"{at}/out", events.schema)
    return good.select("event_id", F.lit(True).alias("ok")).unionByName(bad.select("event_id", F.lit(False).alias("ok")))


@query("l4_accumulate_once", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def l4_once(t: Tables) -> DataFrame:
    events, at = stream(t, "accumulate")
    step = X.accumulate_once(f"{at}/out", ["user_id"])

    def twice(batch: DataFrame, number: int) -> None:
        newest = P.read_published(t.spark, f"{at}/out").select("user_id", F.col("event_id").alias("_old")) if number else None
        own = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
        if newest is not None:
            own = own.join(newest, "user_id", "left").select("user_id", F.greatest("event_id", "_old").alias("event_id"))
        step(own, number)
        step(own.withColumn("event_id", F.lit(-1).cast("long")), number)  # the batch again: a no-op, whatever it holds

    each_batch(events, at, twice)
    return P.read_published(t.spark, f"{at}/out").select("user_id", "event_id")


@query("l5_stream_dedupe", "SELECT event_id, count(*) AS n FROM events GROUP BY event_id")
def l5_stream(t: Tables) -> DataFrame:
    events, at = stream(t, "dedupe")
    doubled = events.unionByName(events)
    return written_stream(X.stream_dedupe(doubled, "event_id", "ts", "60 days"), at).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("l7_stream_volume", "SELECT batch, event_type, count(*) AS n, CASE WHEN count(*) < 20 THEN 'LOW' WHEN count(*) > 1000 THEN 'HIGH' ELSE 'OK' END AS status FROM (SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS batch FROM events) GROUP BY 1, 2")
def l7_stream(t: Tables) -> DataFrame:
    events, at = stream(t, "volume")
    each_batch(events, at, X.volume_by_batch(20, 1000, f"{at}/out"))
    return t.spark.read.parquet(f"{at}/out").select(F.col("batch").cast("int").alias("batch"), "event_type", "n", "status")


@query("l8_status_ttl", "SELECT user_id, count(*) FILTER (event_type = 'view') AS iterations, CASE WHEN count(*) FILTER (event_type = 'view') = 0 THEN 'NOT_STARTED' WHEN arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('view', 'purchase')) = 'purchase' THEN 'CONVERGED' ELSE 'IN_PROGRESS' END AS status FROM events GROUP BY user_id")
def l8_ttl(t: Tables) -> DataFrame:
    events, at = stream(t, "status")
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", X.ROCKSDB)
    try:
        rows = written_stream(X.stream_status_ttl(events, "user_id", "view", "purchase", 90 * 86_400), at, "update")
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return rows.groupBy("user_id").agg(F.max_by("iterations", "batch").alias("iterations"), F.max_by("status", "batch").alias("status"))
