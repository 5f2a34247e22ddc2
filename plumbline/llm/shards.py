"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

The ring has ``slots`` places. Every shard owns ``replicas`` virtual nodes on it; a key falls on a slot and belongs to
the next virtual node clockwise. Shards accept keys up to their quota: first the keys of their own arcs, then those that
overflow elsewhere and continue clockwise to the next shard with room. With ``slack`` 0 the quotas add up to the number
of rows, so every shard is filled exactly and counts differ by one at most; only overflowing keys leave their own shard.

How many keys each arc holds is all that the flow needs: at most shards x replicas counts, whatever the number of rows.
Equal rows are counted first, dealt out again in blocks, and numbered, so that each has a number of its own. Rows within an
arc are ordered by a hash of their key, tie-breakers and that number, and dealt to cells (a fixed number for each arc), so
that no task sorts more than a small share of the table even if one arc is hot or a third of all rows are equal. Rows move
without their text.

Defined results: a null text has size 1 and checksum 0; a null key is a key like any other; rows that are equal in all
ordering columns are exchangeable, and each gets its own slot; an empty table gives an empty result; further columns are
left out unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 8
REPLICAS = 64
SLOTS = 1 << 12
#: Cells that the rows of one arc are dealt to.
CELLS = 64
#: Equal rows that are dealt out together.
BLOCK = 1 << 16


def ring(shards: int, replicas: int = REPLICAS, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """For each slot the arc that it belongs to, and for each arc its shard; arcs are numbered clockwise.

    A virtual node sits on the slot that its name hashes to; of several on one slot the first name in hash order owns
    it, so a shard more only takes slots for itself.
    """
    owner: dict[int, tuple[str, int]] = {}
    for s in range(shards):
        for r in range(replicas):
            digest = hashlib.sha256(f"shard {s} replica {r}".encode()).hexdigest()
            at = int(digest[:12], 16) % slots
            owner[at] = min(owner.get(at, (digest, s)), (digest, s))
    places = sorted(owner)
    arcs, k = [], 0
    for slot in range(slots):
        while k < len(places) and places[k] < slot:
            k += 1
        arcs.append(k % len(places))
    return arcs, [owner[p][1] for p in places]


def flow(counts: list[int], shard_of: list[int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go, as (arc, first, end, shard, first slot): own arcs first, overflow clockwise."""
    room = list(quotas)
    kept: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    over: list[tuple[int, int]] = []
    for arc, n in enumerate(counts):
        s = shard_of[arc]
        own = min(n, room[s])
        room[s] -= own
        if own:
            kept[arc].append((0, own, s))
        if n > own:
            over.append((arc, own))
    for arc, first in over:
        step = 0
        while first < counts[arc]:
            step += 1
            s = shard_of[(arc + step) % len(counts)]
            if room[s]:
                got = min(room[s], counts[arc] - first)
                kept[arc].append((first, first + got, s))
                room[s] -= got
                first += got
    used: dict[int, int] = defaultdict(int)
    out = []
    for arc, parts in enumerate(kept):
        for a, b, s in parts:
            out.append((arc, a, b, s, used[s]))
            used[s] += b - a
    return out


def quotas(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def byte_size(text: str) -> Column:
    """UTF-8 bytes of a text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def numbered(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``df`` with ``_copy``: 0, 1, ... for the rows that are equal in all columns. Only counts of them meet in a task."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block))))
    first = F.col("_block") * block
    dealt = blocks.repartition(*df.columns, "_block")
    return dealt.withColumn("_copy", F.explode(F.sequence(first, F.least(first + block, F.col("_n")) - 1))).drop("_n", "_block")


def placed_rows(df: DataFrame, key: str, keep: dict[str, Column], ties: list[str], arcs: list[int]) -> DataFrame:
    """``key``, ``keep`` and ``_copy`` with ``_arc``, ``_cell`` and ``_order`` for every row."""
    slot = F.pmod(F.xxhash64(key), F.lit(len(arcs))).cast("int")
    arc = F.element_at(F.split(F.lit(",".join(map(str, arcs))), ",").cast("array<int>"), slot + 1)
    order = F.xxhash64(F.lit("order"), key, *ties, "_copy")
    rows = numbered(df.select(F.col(key), *[c.alias(n) for n, c in keep.items()]))
    return rows.select("*", arc.alias("_arc"), order.alias("_order"), F.pmod(order, F.lit(CELLS)).cast("int").alias("_cell"))


def assign(df: DataFrame, key: str, keep: dict[str, Column], ties: list[str], shards: int = SHARDS, replicas: int = REPLICAS, slack: float = 0.0) -> DataFrame:
    """``key``, the columns ``keep``, ``shard`` and ``slot`` (gapless in each shard) for every row.

    ``ties`` names columns of ``keep`` that order rows of one key.
    """
    arcs, shard_of = ring(shards, replicas)
    rows = placed_rows(df, key, keep, ties, arcs)
    cells = written(rows.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("_n")), "ring-cells")  # at most arcs x CELLS rows
    before = F.sum("_n").over(Window.partitionBy("_arc").orderBy("_cell")) - F.col("_n")
    offsets = cells.select("_arc", "_cell", before.alias("_before"))
    counts = [0] * len(shard_of)
    for r in cells.groupBy("_arc").agg(F.sum("_n").alias("n")).collect():
        counts[r["_arc"]] = r["n"]
    parts = flow(counts, shard_of, quotas(sum(counts), shards, slack))
    schema = "array<struct<_arc:int,_first:bigint,_end:bigint,shard:int,_at:bigint>>"
    names = ("_arc", "_first", "_end", "shard", "_at")
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, p, strict=True)) for p in parts])), schema)
    segments = df.sparkSession.range(1).select(F.inline(listed))  # at most two segments an arc and one more for each shard
    within = F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy("_order", key, *ties, "_copy"))
    ranked = rows.select("*", within.alias("_within")).join(F.broadcast(offsets), ["_arc", "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    inside = (ranked["_rank"] >= F.col("_first")) & (ranked["_rank"] < F.col("_end"))
    placed = ranked.join(F.broadcast(segments), (ranked["_arc"] == segments["_arc"]) & inside)
    return placed.select(key, *keep, "shard", (F.col("_rank") - F.col("_first") + F.col("_at")).cast("long").alias("slot"))


def op4(docs: DataFrame) -> DataFrame:
    keep = {"size": byte_size("text"), "text_crc32": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")}
    out = assign(docs, "doc_id", keep, ["size", "text_crc32"])
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
