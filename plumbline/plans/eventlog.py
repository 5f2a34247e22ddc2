"""Summaries of an event log: state as of a time, density, chains, follow-ups, transactions."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import classify
from ..operators.segments import BUCKET_ROWS, running_sums
from ..sources.tables import shared_folder


def regime_summary(events: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    regime = classify(F.col("event_type"), sets, "unclassified")
    return events.groupBy(regime.alias("regime"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def event_density(events: DataFrame, ts: str, n: int) -> DataFrame:
    """``n`` equal time buckets, each divided by the largest; without any duration all is 1."""
    edges = events.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))  # one row
    span = F.unix_micros(F.col("_hi").cast("timestamp")) - F.unix_micros(F.col("_lo").cast("timestamp"))
    at = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_lo").cast("timestamp"))
    bucket = F.when(span == 0, 0).otherwise(F.least(F.lit(n - 1), F.floor(at / F.greatest(span, F.lit(1)) * n)))
    counts = events.crossJoin(edges).groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spine = events.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    full = spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    top = full.agg(F.max("n").alias("_m"))  # one row
    return full.crossJoin(top).select("bucket", "n", F.round(F.col("n") / F.col("_m"), 9).alias("density"))


def state_asof(events: DataFrame, at: Column, start: str, end: str, tenant: int | None = None) -> DataFrame:
    """Per user and type of event up to a time: iterations, first and last time, whether ``end`` came after ``start``."""
    seen = events.where(F.col("ts") <= at)
    if tenant is not None:
        seen = seen.where(F.col("user_id") == tenant)
    done = F.max(F.when(F.col("event_type") == end, F.col("ts")))
    begun = F.min(F.when(F.col("event_type") == start, F.col("ts")))
    out = seen.groupBy("user_id").agg(F.count_if(F.col("event_type") == start).alias("iterations"), begun.alias("started_at"), done.alias("converged_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    status = F.when(F.col("started_at").isNull(), "NOT_STARTED").when(F.col("converged_at") >= F.col("started_at"), "CONVERGED").otherwise("IN_PROGRESS")
    return out.withColumn("status", status)


def edge_status_asof(events: DataFrame, at: Column, delta: Column) -> DataFrame:
    """Per event type: iterations and the deltas in order of time."""
    seen = events.where(F.col("ts") <= at).select("event_type", F.struct("ts", "event_id", delta.alias("delta")).alias("e"))
    out = seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("iterations"), F.array_sort(F.collect_list("e")).alias("es"))
    return out.select("event_type", "iterations", F.array_join(F.transform("es", lambda e: e["delta"].cast("string")), ",").alias("curve"))


def matrix(events: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return events.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def hierarchy(nodes: DataFrame, id: str, parent: str, depth: int = 12) -> DataFrame:
    """Depth and root of every node; nodes without a known parent are roots of depth 1.

    The first ``depth`` levels go by joins; where roots are higher, the distance doubles in every further round, until all
    are reached. Nodes of a cycle or below one have no root and are left out.
    """
    edges = nodes.select(F.col(id).alias("id"), F.col(parent).alias("parent"))
    known = edges.select(F.col("id").alias("_known"))
    edges = edges.join(known, edges["parent"] == known["_known"], "left").select("id", F.when(F.col("id") != F.col("_known"), F.col("_known")).alias("parent"))
    up = edges.select(F.col("id").alias("_id"), F.col("parent").alias("_up"))
    current = edges.select("id", F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 1).otherwise(2).alias("depth"))
    step = 1
    while step < depth:
        step += 1
        higher = current.join(up, current["root"] == up["_id"], "left")
        current = higher.select("id", F.coalesce("_up", "root").alias("root"), F.when(F.col("_up").isNotNull(), F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"))
    below = edges.where("parent is not null").select(F.col("id").alias("_below")).distinct()
    state = current.join(below, current["root"] == below["_below"], "left").select("id", "root", "depth", F.col("_below").isNotNull().alias("open"))
    state, reach = round_written(state), max(1, depth - 1)
    left = state.where("open").count()
    limit = reach + left  # a path to a root has no more than these further nodes; what is open beyond is cyclic
    while left and reach < limit:
        upper = state.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("open").alias("_open"))
        higher = state.where("open").join(upper, F.col("root") == F.col("_id"))
        higher = higher.select("id", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth") - 1).alias("depth"), F.col("_open").alias("open"))
        state, reach = round_written(state.where("not open").unionByName(higher)), reach * 2
        left = state.where("open").count()
    return state.where("not open").select("id", "root", "depth")


def round_written(df: DataFrame) -> DataFrame:
    """Write a round to the folder that driver and executors share, so that plans do not grow and no round is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hierarchy-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pass_ratio(results: DataFrame, edge: str, passed: Column) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count_if(passed)
    return results.groupBy(edge).agg(F.concat(k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" pass")).alias("ratio"))


def signals(events: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside their type's limits, counted by type and side."""
    low = high = None
    for kind, (a, b) in limits.items():
        hit = F.col("event_type") == kind
        low = F.when(hit, F.lit(a)) if low is None else low.when(hit, F.lit(a))
        high = F.when(hit, F.lit(b)) if high is None else high.when(hit, F.lit(b))
    side = F.when(F.col("value") < low, "BELOW").when(F.col("value") > high, "ABOVE")
    return events.withColumn("side", side).where("side is not null").groupBy("event_type", "side").agg(F.count(F.lit(1)).alias("n"))


def dimension_coverage(dims: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    counts = entities.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dims.join(counts, key, "left").select(*dims.columns, F.coalesce("n", F.lit(0)).alias("entities"), F.col("n").isNotNull().alias("covered"))


def tag_coverage(texts: DataFrame, text: str, first: str, second: str) -> DataFrame:
    """Tags found by two patterns over a text table: in both, in the first, in the second."""

    def tags(p: str, n: str) -> DataFrame:
        return texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1))).alias("tag")).distinct().withColumn(n, F.lit(True))

    both = tags(first, "_a").join(tags(second, "_b"), "tag", "full_outer")
    status = F.when(F.col("_a") & F.col("_b"), "BOTH").when(F.col("_a"), "FIRST").otherwise("SECOND")
    return both.select("tag", status.alias("status"))


def causal_chains(events: DataFrame, id: str, prior: str, depth: int = 12) -> DataFrame:
    return hierarchy(events, id, prior, depth)


def prior_chains(events: DataFrame, id: str, priors: str) -> DataFrame:
    """Chains over lists of prior ids: (id, root, depth), a row for every root that an event goes back to.

    ``depth`` is the number of events on the longest chain that ends in the event, so it is the same in all its rows.
    Priors that are no events, or the event itself, don't count; events without others are roots of depth 1. Events of a
    cycle, or after one, have no depth and are left out. Frontier by frontier: an event is settled when all its priors
    are, so there are as many rounds as the longest chain has events; each is written to the shared folder.
    """
    nodes = events.select(F.col(id).alias("id")).distinct()
    known = nodes.select(F.col("id").alias("prior"))
    edges = events.select(F.col(id).alias("id"), F.explode(priors).alias("prior")).where("id <> prior").distinct().join(known, "prior", "left_semi")
    edges = round_written(edges.select("id", "prior"))
    open_counts = edges.groupBy("id").agg(F.count(F.lit(1)).alias("open"))
    state = round_written(nodes.join(open_counts, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(1).alias("depth")))
    roots = round_written(state.where("open = 0").select("id", F.col("id").alias("root"), "depth"))
    frontier, found = roots.select("id", "depth"), [roots]
    state = state.where("open > 0")
    while not frontier.isEmpty():
        reached = edges.join(frontier.select(F.col("id").alias("prior"), "depth"), "prior").groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("depth") + 1).alias("_d"))
        state = state.join(reached, "id", "left").select("id", (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open"), F.greatest("depth", F.coalesce("_d", F.lit(1))).alias("depth"))
        state = round_written(state)
        frontier, state = state.where("open = 0").select("id", "depth"), state.where("open > 0")
        above = found[0].select(F.col("id").alias("prior"), "root")
        for f in found[1:]:
            above = above.unionByName(f.select(F.col("id").alias("prior"), "root"))
        own = frontier.join(edges, "id").join(above, "prior").select("id", "root", "depth").distinct()
        found.append(round_written(own))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def edge_features(events: DataFrame, at: Column, delta: Column) -> DataFrame:
    """Per event type up to a time: iterations, distinct users, first and last time, first and last delta, the smallest one,
    and whether the edge has converged (last delta 0). Aggregates only; nothing is gathered."""
    seen = events.where(F.col("ts") <= at).withColumn("_delta", delta)
    order = F.struct("ts", "event_id")
    out = seen.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.count_distinct("user_id").alias("users"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("_delta", order).alias("first_delta"),
        F.max_by("_delta", order).alias("last_delta"),
        F.min("_delta").alias("least_delta"),
    )
    return out.withColumn("converged", F.coalesce(F.col("last_delta") == 0, F.lit(False)))


def followups(events: DataFrame, trigger: str, required: Sequence[str], rows: int = BUCKET_ROWS) -> DataFrame:
    """Per trigger event, whether each required type follows before the user's next trigger."""
    marked = events.withColumn("_trigger", (F.col("event_type") == trigger).cast("long"))
    turns = running_sums(marked, ["user_id"], ["ts", "event_id"], "_trigger", "sum", "turn", rows)
    own = turns.where("turn > 0").groupBy("user_id", "turn")
    flags = [F.coalesce(F.bool_or(F.col("event_type") == r), F.lit(False)).alias(f"has_{r}") for r in required]
    out = own.agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), *flags)
    complete = F.lit(True)
    for r in required:
        complete = complete & F.col(f"has_{r}")
    return out.withColumn("complete", complete)


def durations(events: DataFrame, start: str, ends: Sequence[str]) -> DataFrame:
    """Per user: seconds from the first start to the first end after it, and which end it was."""
    begun = events.where(F.col("event_type") == start).groupBy("user_id").agg(F.min("ts").alias("begun"))
    done = events.where(F.col("event_type").isin(list(ends))).select("user_id", "ts", "event_id", "event_type").join(begun, "user_id").where("ts >= begun")
    first = done.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("e"), F.min("begun").alias("begun"))
    return first.select("user_id", (F.unix_timestamp("e.ts") - F.unix_timestamp("begun")).alias("seconds"), F.col("e.event_type").alias("ended_by"))


def entity_modules(entities: DataFrame, tags: DataFrame, entity: str, key: str, module: str) -> DataFrame:
    """Per entity: the modules that carry its keys, and its keys that none carries."""
    both = entities.join(tags, key, "left")
    return both.groupBy(entity).agg(F.count_distinct(F.col(module)).alias("modules"), F.count_distinct(F.when(F.col(module).isNull(), F.col(key))).alias("untraced"))


def transactions(events: DataFrame, run: str, start: str, done: Sequence[str]) -> DataFrame:
    """Per run: start and end; open (no end), orphan (no start) or closed by its last end."""
    begin = F.min(F.when(F.col("event_type") == start, F.col("ts")))
    last = F.max_by(F.when(F.col("event_type").isin(list(done)), F.col("event_type")), F.when(F.col("event_type").isin(list(done)), F.struct("ts", "event_id")))
    out = events.where(F.col("event_type").isin([start, *done])).groupBy(run).agg(begin.alias("started"), last.alias("closed_by"))
    return out.select(run, F.when(F.col("started").isNull(), "ORPHAN").when(F.col("closed_by").isNull(), "OPEN").otherwise(F.col("closed_by")).alias("state"))


def claim_counts(events: DataFrame, agent: str, edge: Column, kinds: Mapping[str, str]) -> DataFrame:
    """Per agent and edge, how many claims of each kind (event type to name) there are."""
    counts = [F.count_if(F.col("event_type") == kind).alias(name) for kind, name in kinds.items()]
    return events.where(F.col("event_type").isin(list(kinds))).groupBy(agent, edge.alias("edge")).agg(*counts)


def gap_signals(df: DataFrame, key: str, dimensions: Mapping[str, tuple[Column, Column, float]], origin: str) -> DataFrame:
    """One row for each dimension (expected, actual, tolerance) of a record: its gap, where it comes from, and whether it
    breaches the tolerance. All dimensions come from one pass."""
    cells = [F.struct(F.lit(name).alias("dimension"), F.abs(actual - expected).alias("gap"), (F.abs(actual - expected) > limit).alias("breach")) for name, (expected, actual, limit) in dimensions.items()]
    return df.select(key, F.lit(origin).alias("origin"), F.explode(F.array(*cells)).alias("c")).select(key, "origin", "c.*").where("gap is not null")


def mandatory_coverage(dims: DataFrame, entities: DataFrame, key: str, mandatory: Column) -> DataFrame:
    """``dimension_coverage`` with a status: COVERED, MISSING (mandatory without entities) or OPTIONAL."""
    own = dimension_coverage(dims.withColumn("mandatory", mandatory), entities, key)
    return own.withColumn("status", F.when(F.col("covered"), "COVERED").when(F.col("mandatory"), "MISSING").otherwise("OPTIONAL"))


def tag_status(keys: DataFrame, key: str, texts: DataFrame, text: str, first: str, second: str) -> DataFrame:
    """Every known key with where its tag is found: BOTH, FIRST, SECOND or NEITHER."""
    found = tag_coverage(texts, text, first, second)
    return keys.join(found, keys[key] == found["tag"], "left").select(key, F.coalesce("status", F.lit("NEITHER")).alias("status"))


def convergence(events: DataFrame, edge: str, start: str, delta: Column, timeout_seconds: int, escalated: str) -> DataFrame:
    """Per edge: seconds from the first start to the first delta of zero, and how it ended: ``delta_zero``, ``escalated`` (that
    event came first), ``timeout`` (nothing of either in time) or ``open``."""
    begun = F.min(F.when(F.col("event_type") == start, F.col("ts")))
    marks = events.join(events.groupBy(edge).agg(begun.alias("_begun")).where("_begun is not null"), edge).where("ts >= _begun")
    out = marks.groupBy(edge).agg(
        F.min("_begun").alias("b"),
        F.min(F.when(delta == 0, F.col("ts"))).alias("z"),
        F.min(F.when(F.col("event_type") == escalated, F.col("ts"))).alias("e"),
        F.max("ts").alias("m"),
    )
    seconds = F.unix_timestamp("z") - F.unix_timestamp("b")
    late = F.lit(timeout_seconds)
    kind = F.when(F.col("e") < F.coalesce("z", F.lit("9999-01-01").cast("timestamp")), "escalated").when(seconds <= late, "delta_zero")
    kind = kind.when(F.unix_timestamp("m") - F.unix_timestamp("b") > late, "timeout").otherwise("open")
    return out.select(edge, seconds.alias("seconds"), kind.alias("kind"))


def latest_hash(events: DataFrame, edge: str, content: str) -> DataFrame:
    """Digest of the newest content of each edge."""
    return events.groupBy(edge).agg(F.sha2(F.max_by(content, F.struct("ts", "event_id")), 256).alias("content_hash"))


def curve_rows(events: DataFrame, at: Column, delta: Column) -> DataFrame:
    """Per event type the deltas up to a time as rows in order (``position`` from 1). Places follow from counts a day and the
    order within a day, so no type is gathered."""
    seen = events.where(F.col("ts") <= at).select("event_type", "ts", "event_id", F.to_date("ts").alias("day"), delta.alias("delta"))
    days = seen.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    placed = seen.join(days.select("event_type", "day", F.coalesce(before, F.lit(0)).alias("_before")), ["event_type", "day"])
    within = F.row_number().over(Window.partitionBy("event_type", "day").orderBy("ts", "event_id"))
    return placed.select("event_type", (F.col("_before") + within).alias("position"), "delta")
