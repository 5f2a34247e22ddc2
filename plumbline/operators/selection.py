"""Exact percentiles by distributed selection: no task or buffer holds the values of a whole column.

Sketches bound each wanted value from below and above; values between the bounds are counted, each once, and what lies
below is counted alone. If few enough distinct values are left, the driver takes the one at the wanted rank from them;
if not, the bounds are drawn closer inside themselves. Each round leaves about a thousandth of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values that the driver takes at once, for all percentiles together.
FEW = 20_000
#: The sketch errs by a part of the rows of at most 1 / ACCURACY; bounds leave four times as much on either side.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY


@dataclass
class Wanted:
    """A percentile of a column: its two neighbouring ranks, bounds of both values, and the rows below the bounds."""

    column: str
    rank: float
    low: float
    high: float
    below: int = 0
    inside: int = 0


def number(column: str) -> Column:
    """The column as a double; what is no number (null or NaN) has no rank."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def picked(counts: list[tuple[float, int]], below: int, rank: float) -> float:
    """The value at a rank (from 0), between two ranks in proportion, from sorted values with counts."""
    lo, hi = math.floor(rank), math.ceil(rank)
    found, seen = [], below
    for value, k in counts:
        seen += k
        found += [value] * sum(len(found) <= i and r < seen for i, r in enumerate((lo, hi)))
        if len(found) == 2:
            break
    return found[0] if lo == hi else found[0] * (hi - rank) + found[1] * (rank - lo)


def percentiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], few: int = FEW) -> dict[tuple[str, float], float | None]:
    """Percentiles by (column, fraction), interpolated between neighbours; None for a column without numbers."""
    names = list(dict.fromkeys(columns))
    edges = F.array(*[F.lit(min(1.0, max(0.0, f + d))) for f in fractions for d in (-MARGIN, MARGIN)])
    row = df.agg(*[F.struct(F.count(number(c)).alias("n"), F.min(number(c)).alias("low"), F.max(number(c)).alias("high"), F.percentile_approx(number(c), edges, ACCURACY).alias("edges")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    out: dict[tuple[str, float], float | None] = {}
    open_ones: dict[tuple[str, float], Wanted] = {}
    for i, c in enumerate(names):
        r = row[f"c{i}"]
        for k, f in enumerate(fractions):
            if not r.n:
                out[c, f] = None
            elif r.n <= few // (len(names) * len(fractions)):
                open_ones[c, f] = Wanted(c, f * (r.n - 1), r.low, r.high)
            else:
                open_ones[c, f] = Wanted(c, f * (r.n - 1), r.edges[2 * k], r.edges[2 * k + 1])
    wanted = list(open_ones.items())
    few = max(few, 16 * len(wanted))  # what a sketch of few rows can leave between its bounds
    while wanted:
        cells = [F.when(number(w.column) < w.low, F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("value"))).when(number(w.column) <= w.high, F.struct(F.lit(i).alias("i"), number(w.column).alias("value"))) for i, (_, w) in enumerate(wanted)]
        counted = df.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).groupBy("c.i", "c.value").agg(F.count(F.lit(1)).alias("k"))
        rows = counted.limit(few + len(wanted) + 1).collect()
        if len(rows) > few + len(wanted):
            before = [(w.low, w.high) for _, w in wanted]
            narrowed(df, [w for _, w in wanted])
            if before == [(w.low, w.high) for _, w in wanted]:
                raise RuntimeError("the bounds of a percentile cannot be drawn closer")
            continue
        for i, (key, w) in enumerate(wanted):
            below = sum(r.k for r in rows if r.i == i and r.value is None)
            out[key] = picked(sorted((r.value, r.k) for r in rows if r.i == i and r.value is not None), below, w.rank)
        break
    return out


def narrowed(df: DataFrame, wanted: list[Wanted]) -> None:
    """Draw the bounds closer, by sketches of the rows between them."""
    within = [F.when(number(w.column).between(w.low, w.high), number(w.column)) for w in wanted]
    counts = df.agg(*[F.struct(F.count_if(number(w.column) < w.low).alias("below"), F.count(x).alias("inside")).alias(f"c{i}") for i, (w, x) in enumerate(zip(wanted, within, strict=True))]).first()
    edges = []
    for i, w in enumerate(wanted):
        w.below, w.inside = counts[f"c{i}"]
        lo, hi = ((r - w.below) / max(1, w.inside - 1) for r in (math.floor(w.rank), math.ceil(w.rank)))
        if not 0 <= lo <= hi <= 1:
            raise RuntimeError(f"the bounds of a percentile of {w.column} do not hold it")
        edges.append(F.array(F.lit(max(0.0, lo - MARGIN)), F.lit(min(1.0, hi + MARGIN))))
    row = df.agg(*[F.percentile_approx(x, e, ACCURACY).alias(f"c{i}") for i, (x, e) in enumerate(zip(within, edges, strict=True))]).first()
    for i, w in enumerate(wanted):
        w.low, w.high = row[f"c{i}"]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, value (as a number or null) and k, so that distinct values are counted once for all columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("cell")
    return df.select(cells).groupBy("cell.column_name", "cell.value").agg(F.count(F.lit(1)).alias("k"))


def distinct_and_percentiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], few: int = FEW) -> tuple[DataFrame, dict[tuple[str, float], float | None]]:
    """Per column its distinct values (column_name, n_distinct), and percentiles; columns of few values take one pass."""
    counted = value_counts(df, columns)
    rows = counted.limit(few + 1).collect()
    if len(rows) > few:
        return counted.groupBy("column_name").agg(F.count("value").alias("n_distinct")), percentiles(df, columns, fractions, few)
    own = {c: sorted((r.value, r.k) for r in rows if r.column_name == c and r.value is not None and not math.isnan(r.value)) for c in columns}
    n = {c: sum(k for _, k in own[c]) for c in columns}
    distinct = {c: sum(r.column_name == c and r.value is not None for r in rows) for c in columns}
    found = {(c, f): picked(own[c], 0, f * (n[c] - 1)) if n[c] else None for c in columns for f in fractions}
    return df.sparkSession.createDataFrame(list(distinct.items()), "column_name string, n_distinct long"), found
