"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors are one node. Pivots are drawn from the nodes by hash (one for ``PER_PIVOT`` nodes, ``PIVOTS`` at most) and
every node joins the shards of its nearest pivots, so shards overlap. Each shard builds a pruned neighbour graph: of a
pool (the ``POOL`` nearest members and all within the threshold) a node keeps the nearest, drops those that are nearer to a
kept one, and so on until the pool is used up. The adjacency lists of all shards are united by node. Then every shard
searches the united graph for each of its members, from the member itself, and expands its range over all nodes within a
slack of the threshold. What is found is verified by the exact cosine in double precision.

No link within a shard is lost, however many members lie equally near: whoever is not in a node's list is nearer to one in
it, so from a node a way leads to each of its links on which that link gets nearer at every step. All steps are within the
threshold, hence in the pools, and nothing on the way is farther from the node than twice the angle of the threshold, whose
cosine, 0.805, is within the slack. Pairs of equal cosine are ordered by their ends, so ties do not break the way.

A pair is counted in the first shard that both share, so no list of pairs is ever shuffled: each shard sends sums and one
edge a node. A crowded shard is cut into pieces and every two pieces are searched against each other, on a graph of both,
so a hot cluster stays whole and no task holds more than two pieces.

The recall is audited against brute force on a bounded sample of nodes; below ``FLOOR`` the overlap is doubled, up to all
pivots, where every shard holds everything. If even that does not reach ``FLOOR``, an error is raised rather than part of
the links returned; ``audited`` returns the recall beside the result.

Defined results: vectors of different lengths never link, each length is searched for itself; vectors that are null, empty,
zero, or hold null or non-finite components link with nothing; so do rows with a
null id, whose component is null; repeated rows are links of each other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .graph import components, roots

THRESHOLD = 0.95
SLACK = 0.15
PER_PIVOT = 400
PIVOTS = 2048
OVERLAP = 3
#: Members of a shard, or of a piece of a crowded one.
CROWD = 2000
POOL = 48
QUERIES = 256
#: Nodes that are expanded, or pairs whose cosine is taken, at once.
STEP = 1 << 15
AUDIT = 200
FLOOR = 0.97


def unit(v: list | None) -> bytes | None:
    """The vector at length one in double precision, or None where it cannot link."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return (x / np.sqrt(x @ x)).tobytes()


def units(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``id``, ``node`` (a hash of the vector) and ``vec`` for every row; the last two null where it cannot link."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            raw = [unit(v) if i is not None else None for i, v in zip(ids, batch.column("v").to_pylist(), strict=True)]
            nodes = [None if r is None else int(np.uint64(xxhash.xxh3_64_intdigest(r)).view(np.int64)) for r in raw]
            yield pa.record_batch([batch.column("id"), pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], ["id", "node", "vec"])

    return df.select(F.col(id).alias("id"), F.col(vector).alias("v")).mapInArrow(step, f"id {df.schema[id].dataType.simpleString()}, node long, vec binary")


def one_vector() -> Column:
    """The vector of a node's rows; that two of them share a hash is an error, not one vector less."""
    return F.when(F.min("vec") == F.max("vec"), F.min("vec")).otherwise(F.raise_error(F.lit("two vectors share a hash")))


def matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def pruned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the graph that robust pruning leaves of each row's pool."""
    n = len(x)
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sim = x @ x.T
    np.round(sim, 12, out=sim)
    np.fill_diagonal(sim, -2)
    size = min(POOL, n - 1)
    for at in range(0, n if n > 1 else 0, QUERIES):
        block = sim[at : at + QUERIES]
        least = np.minimum(np.partition(block, n - size, axis=1)[:, n - size], THRESHOLD - 1e-9)
        sizes = (block >= least[:, None]).sum(axis=1)
        for some in (np.flatnonzero(sizes <= 2 * POOL), np.flatnonzero(sizes > 2 * POOL)):
            if not len(some):
                continue
            rows, near, width = at + some, block[some], int(sizes[some].max())
            pool = np.sort(np.argpartition(-near, width - 1, axis=1)[:, :width], axis=1)
            far = -np.take_along_axis(near, pool, axis=1)
            order = np.argsort(far, axis=1, kind="stable")
            pool, own = np.take_along_axis(pool, order, axis=1), -np.take_along_axis(far, order, axis=1)
            alive = own >= least[some][:, None]
            live = np.arange(len(rows))
            while True:
                first = alive[live].argmax(axis=1)
                left = alive[live, first]
                live, first = live[left], first[left]
                if not len(live):
                    break
                chosen = pool[live, first]
                heads.append(rows[live])
                tails.append(chosen)
                alive[live, first] = False
                to = sim[chosen[:, None], pool[live]]
                alive[live] &= (to < own[live]) | ((to == own[live]) & (chosen > rows[live])[:, None])
    return np.concatenate(heads), np.concatenate(tails)


def searched(x: np.ndarray, heads: np.ndarray, tails: np.ndarray, low: float = THRESHOLD - SLACK) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of rows: the first row, and which rows the search has found within the threshold."""
    n = len(x)
    order = np.argsort(heads, kind="stable")
    start, tails = np.searchsorted(heads[order], np.arange(n + 1)), tails[order]
    degree = np.diff(start)
    for at in range(0, n, QUERIES):
        q = x[at : at + QUERIES]
        m = len(q)
        met, hit = np.zeros(m * n, bool), np.zeros(m * n, bool)
        front = np.arange(m) * n + np.arange(at, at + m)
        met[front] = True
        while len(front):
            fresh = np.zeros(m * n, bool)
            for k in range(0, len(front), STEP):
                who, what = np.divmod(front[k : k + STEP], n)
                size = degree[what]
                place = np.repeat(start[what] - np.cumsum(size) + size, size) + np.arange(size.sum())
                fresh[np.repeat(who * n, size) + tails[place]] = True
            new = np.flatnonzero(fresh & ~met)
            met[new] = True
            cos = np.zeros(len(new))
            for k in range(0, len(new), STEP):
                who, what = np.divmod(new[k : k + STEP], n)
                cos[k : k + STEP] = np.einsum("ij,ij->i", q[who], x[what])
            hit[new] = cos >= THRESHOLD
            front = new[cos >= low]
        yield at, hit.reshape(m, n)


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = pdf["node"].to_numpy()
    heads, tails = pruned(matrix(pdf["vec"]))
    order = np.argsort(heads, kind="stable")
    lists = np.split(nodes[tails[order]], np.searchsorted(heads[order], np.arange(1, len(nodes))))
    return pd.DataFrame({"node": nodes, "near": [a.tolist() for a in lists]})


def search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Link counts of a shard's members and one edge for each to the root of its links here."""
    pdf = pdf.drop_duplicates("node").sort_values("node")
    nodes, weight, piece = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["piece"].to_numpy()
    first, second, shard = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(pdf["shard"].iloc[0])
    x = matrix(pdf["vec"])
    n = len(x)
    sizes = np.fromiter(map(len, pdf["near"]), np.int64, n)
    named = np.concatenate([np.zeros(0, np.int64), *pdf["near"]]).astype(np.int64)
    place = np.minimum(np.searchsorted(nodes, named), n - 1)
    here = nodes[place] == named
    heads, tails = np.repeat(np.arange(n), sizes)[here], place[here]
    if first != second:  # the lists know of no edges between two pieces
        between = pruned(x)
        heads, tails = np.concatenate([heads, between[0]]), np.concatenate([tails, between[1]])
    homes = np.array(pdf["shards"].tolist()).reshape(n, -1)
    kinds, at = np.unique(homes, return_inverse=True)
    earlier = np.zeros((n, len(kinds)), np.float32)
    earlier[np.arange(n)[:, None], at.reshape(homes.shape)] = 1
    earlier = earlier[:, kinds < shard]
    links, label = np.zeros(n, np.int64), np.arange(n)
    for at, hit in searched(x, heads, tails):
        here = slice(at, at + len(hit))
        if not hit.any():
            continue
        own = piece[here, None] != piece[None] if first != second else piece[here, None] == piece[None]
        hit = hit & own & (earlier[here] @ earlier.T == 0)
        links[here] = hit @ weight
        a, b = np.nonzero(hit)
        a, b = label[a + at], label[b]
        if (a != b).any():
            ends, tops = roots(a[a != b], b[a != b])
            to = np.arange(n)
            to[ends] = tops
            label = to[label]
    some = links > 0
    return pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[label[some]]})


def linked(nodes: DataFrame, overlap: int) -> DataFrame:
    """``node``, ``links``, ``root`` parts from all shards; ``nodes`` has node, vec, copies."""
    spark = nodes.sparkSession
    n = nodes.count()
    k = min(PIVOTS, max(1, -(-n // PER_PIVOT)))
    pivots = spark.sparkContext.broadcast(matrix([bytes(r.vec) for r in nodes.orderBy("node").limit(k).collect()]))
    width = min(overlap, k)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = matrix(batch.column("vec").to_pylist()) @ pivots.value.T
                homes = np.sort(np.argpartition(-sim, width - 1, axis=1)[:, :width], axis=1)
                yield batch.append_column("shards", pa.array(homes.tolist(), pa.list_(pa.int64())))

    members = nodes.mapInArrow(join, "node long, vec binary, copies long, shards array<long>")
    members = written(members.select("*", F.explode("shards").alias("shard")), "graph-members")
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("pieces"))  # a row a pivot
    members = members.join(F.broadcast(sizes), "shard").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    lists = members.select("shard", "piece", "node", "vec").groupBy("shard", "piece").applyInPandas(build, "node long, near array<long>")
    united = written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph-lists")  # a list a shard
    others = F.sequence(F.lit(0), F.col("pieces") - 1)
    tasks = members.join(united, "node").withColumn("other", F.explode(others))
    tasks = tasks.withColumn("i", F.least("piece", "other")).withColumn("j", F.greatest("piece", "other"))
    return written(tasks.groupBy("shard", "i", "j").applyInPandas(search, "node long, links long, root long"), "graph-links")


def recall(nodes: DataFrame, links: DataFrame, sample: int = AUDIT) -> float:
    """Share of the true links of a bounded sample of nodes that the search has counted."""
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "vec").collect()
    if not picked:
        return 1.0
    ids, x = np.array([r.node for r in picked]), matrix([bytes(r.vec) for r in picked])
    shared = nodes.sparkSession.sparkContext.broadcast((ids, x))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            if batch.num_rows:
                hit = (q @ matrix(batch.column("vec").to_pylist()).T >= THRESHOLD) & (own[:, None] != batch.column("node").to_numpy()[None, :])
                total += hit @ batch.column("copies").to_numpy()
        yield pa.record_batch([pa.array(own), pa.array(total)], ["node", "true_links"])

    truth = nodes.mapInArrow(step, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    r = truth.join(counted, "node", "left").agg(F.sum("true_links").alias("a"), F.sum(F.least(F.coalesce("links", F.lit(0)), "true_links")).alias("b")).first()
    return r.b / r.a if r.a else 1.0


def searched_links(own: DataFrame) -> tuple[DataFrame, float]:
    """The links of vectors of one length, and their recall on the audited nodes; more overlap where that is low."""
    overlap = OVERLAP
    links = linked(own, overlap)
    most = -(-own.count() // PER_PIVOT)
    while (share := recall(own, links)) < FLOOR:
        if overlap >= min(PIVOTS, most):
            raise RuntimeError(f"the graph search found {share:.3f} of the audited links, {FLOOR} are asked for")
        overlap *= 2
        links = linked(own, overlap)
    return links, share


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``n_links``, ``component_id``, ``kept`` for every row."""
    return audited(df, id, vector)[0]


def audited(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, float]:
    """``near_duplicates`` and the recall of its links on the audited nodes."""
    prepare(df.sparkSession)
    rows = written(units(df, id, vector), "graph-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(one_vector().alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    nodes = written(nodes, "graph-nodes")
    links = nodes.select("node", F.col("copies").alias("links"), F.col("node").alias("root")).limit(0)
    found_share = 1.0
    for r in nodes.select(F.octet_length("vec").alias("size")).distinct().orderBy("size").collect():  # a row a length
        own = nodes.where(F.octet_length("vec") == r["size"]).select("node", "vec", "copies")
        part, share = searched_links(own)
        links, found_share = links.unionByName(part), min(found_share, share)
    found = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.drop("vec").join(found, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    per = joined.join(low, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = rows.drop("vec").join(per, "node", "left")
    component = F.coalesce("component_id", "id")
    result = out.select(
        F.col("id").alias(id),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
    return result, found_share


def op1(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings.select("vec_id", "embedding"))
