"""Queries over sources, scalar operators and the flagship mapping (survey sections A and B)."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.flagship import order_summary
from ..sources import tables as A
from .registry import Tables, query

def doubled(x: pd.Series) -> pd.Series:
    return x * 2


@query("flagship_order_summary", "SELECT c_custkey, c_mktsegment, CAST(o_orderdate AS DATE) AS order_date, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL HAVING sum(CAST(o_totalprice AS DECIMAL(18,2))) > 0")
def flagship(t: Tables) -> DataFrame:
    return order_summary(t.orders, t.customer)[0]


@query("i9_ledger", "SELECT count(*) AS input_count, count(*) FILTER (o_orderstatus <> 'P') AS processed, count(*) FILTER (o_orderstatus = 'P') AS filtered, count(*) - count(*) FILTER (o_orderstatus <> 'P') - count(*) FILTER (o_orderstatus = 'P') AS discrepancy, count(*) = count(*) FILTER (o_orderstatus <> 'P') + count(*) FILTER (o_orderstatus = 'P') AS balanced FROM orders")
def ledger(t: Tables) -> DataFrame:
    return order_summary(t.orders, t.customer)[2]


@query("a1_read_source", "SELECT n_nationkey, n_name FROM nation")
def a1(t: Tables) -> DataFrame:
    return A.read_source(t.spark, A.Binding("parquet", f"{t.folder}/nation.parquet", "n_nationkey int, n_name string"))


@query("a2_slice_epoch", "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def a2(t: Tables) -> DataFrame:
    return A.slice_epoch(t.events, "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz")).select("event_id", "user_id")


@query("a3_read_temporal", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'old' ELSE 'new' END AS origin FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def a3(t: Tables) -> DataFrame:
    old, new = t.events.withColumn("origin", F.lit("old")), t.events.withColumn("origin", F.lit("new"))
    return A.read_temporal([(old, "2024-01-01", "2024-01-15"), (new, "2024-01-15", "2024-02-01")], "ts", "2024-01-10", "2024-01-20").select("event_id", "origin")


@query("a4_latest_snapshot", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def a4(t: Tables) -> DataFrame:
    return A.latest_snapshot(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "event_type")


@query("a5_read_lookup", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-01-01')")
def a5(t: Tables) -> DataFrame:
    return A.read_lookup(t.lineitem, "l_shipdate", as_of=F.lit("1997-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("a8_merge_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def a8(t: Tables) -> DataFrame:
    target = t.orders.select("o_orderkey", "o_orderstatus")
    return A.merge_upsert(target, target.where("o_orderkey % 11 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("a9_parse_events", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 <> 0")
def a9(t: Tables) -> DataFrame:
    line = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value", "props"))
    lines = t.events.select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 25)).otherwise(line).alias("value"))
    return A.parse_events(lines)[0].select("event_id", "user_id", "event_type")


@query("a10_infer_types", "SELECT 'v' AS column_name, count(v) AS n, count(try_cast(v AS BIGINT)) FILTER (NOT contains(v, '.')) AS n_bigint, count(try_cast(v AS DOUBLE)) AS n_double, count(try_cast(v AS DATE)) AS n_date, count(try_cast(v AS BOOLEAN)) AS n_boolean FROM (SELECT CASE WHEN event_id % 13 = 0 THEN 'not_a_number' WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) || '.5' ELSE CAST(user_id + 10 AS VARCHAR) END AS v FROM events)")
def a10(t: Tables) -> DataFrame:
    v = F.when(F.col("event_id") % 13 == 0, "not_a_number").when(F.col("event_id") % 2 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".5"))).otherwise((F.col("user_id") + 10).cast("string"))
    return A.infer_types(t.events.select(v.alias("v")), ["v"])


@query("a11_schema_drift", "SELECT * FROM (VALUES ('o_orderkey', 'same', 1.0), ('o_totalprice', 'changed', 1.0), ('o_orderstatus', 'removed', NULL), ('note', 'added', (SELECT count(*) FILTER (o_orderkey % 3 = 0) / count(*) FROM orders))) t(column_name, status, fill_rate)")
def a11(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = t.orders.select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), F.when(F.col("o_orderkey") % 3 == 0, "x").alias("note"))
    return A.schema_drift(old, new)


@query("a12_scd2", "SELECT c_custkey, c_mktsegment, DATE '2020-01-01' AS valid_from, CASE WHEN c_custkey % 7 = 0 THEN DATE '2021-01-01' END AS valid_to FROM customer UNION ALL SELECT c_custkey, 'NEW', DATE '2021-01-01', NULL FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey + 1000000, 'NEW', DATE '2021-01-01', NULL FROM customer WHERE c_custkey % 100 = 0")
def a12(t: Tables) -> DataFrame:
    history = t.customer.select("c_custkey", "c_mktsegment", F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    seg = F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    changes = t.customer.where("c_custkey % 2 = 0 or c_custkey % 7 = 0").select("c_custkey", seg).unionByName(t.customer.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))
    return A.apply_scd2(history, changes, ["c_custkey"], ["c_mktsegment"], F.lit("2021-01-01").cast("date"))


@query("b1_project", "SELECT c_custkey AS id, c_name AS label FROM customer")
def b1(t: Tables) -> DataFrame:
    return S.project(t.customer, {"id": "c_custkey", "label": "c_name"})


@query("b2_derive", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net FROM lineitem")
def b2(t: Tables) -> DataFrame:
    return S.derive(t.lineitem, "net", "cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as double)").select("l_orderkey", "l_linenumber", "l_partkey", "net")


@query("b3_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS size FROM orders")
def b3(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.when_expr(F.col("o_totalprice") > 250000, F.lit("large"), F.lit("small")).alias("size"))


NULLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 34 = 0 THEN NULL ELSE 1.0 END AS q FROM orders)"


def nulled(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("p"), F.when(F.col("o_orderkey") % 34 != 0, F.lit(1.0)).alias("q"))


@query("b4_fallback", f"SELECT o_orderkey, coalesce(p, q) AS v FROM {NULLED} WHERE coalesce(p, q) IS NOT NULL")
def b4(t: Tables) -> DataFrame:
    return S.fallback(nulled(t), ["p", "q"], "v", "o_orderkey")[0].select("o_orderkey", "v")


@query("b4_fallback_errors", f"SELECT CAST(o_orderkey AS VARCHAR) AS source_key, 'CDME-005' AS error_code FROM {NULLED} WHERE coalesce(p, q) IS NULL")
def b4e(t: Tables) -> DataFrame:
    return S.fallback(nulled(t), ["p", "q"], "v", "o_orderkey")[1].select("source_key", "error_code")


@query("b5_record", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def b5(t: Tables) -> DataFrame:
    return S.unpack(S.make_record(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), "r", ["s_name", "s_nationkey"]), "r")


@query("b6_surrogate_key", "SELECT c_custkey, sha256('|' || CAST(c_custkey AS VARCHAR) || '|' || coalesce(c_mktsegment, '~')) AS sk FROM customer")
def b6(t: Tables) -> DataFrame:
    return S.surrogate_key(t.customer, ["c_custkey", "c_mktsegment"]).select("c_custkey", "sk")


@query("b6_uuid5")
def b6u(t: Tables) -> DataFrame:
    return S.uuid5_key(t.customer, ["c_custkey"], "6ba7b8109dad11d180b400c04fd430c8").select("c_custkey", "uuid")


@query("b7_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def b7(t: Tables) -> DataFrame:
    return S.filter_rows(t.orders, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000).select("o_orderkey")


@query("b8_safe_cast_errors", "SELECT CAST(event_id AS VARCHAR) AS source_key, 'CDME-002' AS error_code, 'not_a_number' AS actual FROM events WHERE event_id % 13 = 0")
def b8(t: Tables) -> DataFrame:
    text = t.events.select("event_id", F.when(F.col("event_id") % 13 == 0, "not_a_number").otherwise(F.col("value").cast("string")).alias("v"))
    return S.safe_cast(text, "v", "double", "event_id")[1].select("source_key", "error_code", "actual")


@query("b8_safe_cast", "SELECT event_id, round(value, 2) AS v FROM events WHERE event_id % 13 <> 0")
def b8o(t: Tables) -> DataFrame:
    text = t.events.select("event_id", F.when(F.col("event_id") % 13 == 0, "not_a_number").otherwise(F.col("value").cast("string")).alias("v"))
    return S.safe_cast(text, "v", "double", "event_id")[0].select("event_id", F.round("v", 2).alias("v"))


@query("b9_clean_strings", "SELECT c_custkey, upper(regexp_replace(trim('  ' || CASE WHEN starts_with(c_name, 'Customer') THEN substr(c_name, 9) ELSE c_name END), '[#0]+', '-', 'g')) AS name, array_to_string(string_split(c_mktsegment, 'I'), '/') AS seg FROM customer")
def b9(t: Tables) -> DataFrame:
    name = S.cleaned(F.concat(F.lit("  "), S.cleaned(F.col("c_name"), [("remove_prefix", "Customer")])), [("trim",), ("replace", "[#0]+", "-"), ("upper",)])
    return t.customer.select("c_custkey", name.alias("name"), S.cleaned(F.col("c_mktsegment"), [("split", "I"), ("join", "/")]).alias("seg"))


@query("b10_clean_dates", "SELECT event_id, strftime(ts - INTERVAL 9 HOUR, '%d/%m/%Y %H:%M') AS shown FROM events")
def b10(t: Tables) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.events.select("event_id", S.clean_dates(text, "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "Asia/Tokyo").alias("shown"))


@query("b11_clean_numbers", "SELECT o_orderkey, round(o_totalprice / 1000, 1) AS r, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c FROM orders")
def b11(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(p / 1000, 1).alias("r"), F.floor(p).alias("f"), F.ceil(p).alias("c"))


@query("b12_clean_arrays", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey % 10) FILTER (l_partkey % 10 > 3))), ',') AS parts FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_partkey % 10 > 3) > 0")
def b12(t: Tables) -> DataFrame:
    arrays = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("a"))
    kept = S.clean_array(F.col("a"), lambda x: x % 10 > 3, lambda x: x % 10)
    return arrays.select("l_orderkey", F.array_join(kept.cast("array<string>"), ",").alias("parts")).where("parts <> ''")


@query("b13_default", f"SELECT o_orderkey, coalesce(p, 0) AS p FROM {NULLED}")
def b13(t: Tables) -> DataFrame:
    return S.with_default(nulled(t), "p", 0.0).select("o_orderkey", "p")


@query("b14_logic_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS status FROM orders")
def b14(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.logic_lookup(F.col("o_orderstatus"), {"O": "open", "F": "done"}, "other").alias("status"))


@query("b15_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def b15(t: Tables) -> DataFrame:
    return S.json_fields(t.events, "props", {"k": "$.k"}).select("event_id", "k")


@query("b16_restrict", "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def b16(t: Tables) -> DataFrame:
    return S.restrict(t.customer.select("c_custkey", "c_name", "c_acctbal"), {"c_acctbal": ["finance"], "c_name": ["finance", "sales"]}, ["sales"])


@query("b17_external_calc", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 2, 2) AS doubled, 'double' AS calc_id, '1' AS calc_version FROM lineitem")
def b17(t: Tables) -> DataFrame:
    out = S.external_calc(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), doubled, "doubled", "double", "double", "1", "l_quantity")
    return out.drop("l_quantity").withColumn("doubled", F.round("doubled", 2))


@query("b18_classify", "SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'goal' WHEN event_type IN ('error') THEN 'fault' ELSE 'noise' END AS class FROM events")
def b18(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.classify(F.col("event_type"), {"goal": ["purchase", "signup"], "fault": ["error"]}, "noise").alias("class"))


@query("b19_erase", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 <> 0")
def b19(t: Tables) -> DataFrame:
    return S.erase(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("b19_pseudonymise", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN sha256(c_name) ELSE c_name END AS c_name FROM customer")
def b19p(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name")
    return S.erase(c, c.where("c_custkey % 10 = 0"), "c_custkey", ["c_name"], "hash")
