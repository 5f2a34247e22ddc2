"""Failures as rows, validation, thresholds and accounting. A null predicate counts as a failure, once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import moved, point


#: The codes of error records.
CODES = {
    "refinement": "CDME-001",
    "type_cast": "CDME-002",
    "join_key": "CDME-003",
    "validation": "CDME-004",
    "null_field": "CDME-005",
    "grain": "CDME-006",
    "threshold": "CDME-007",
}


def error_rows(df: DataFrame, key: str, error_type: str, code: str, path: str, expected: str, actual: Column, run: str = "run", epoch: str = "epoch") -> DataFrame:
    context = F.create_map(F.lit("path"), F.lit(path))
    return df.select(
        F.col(key).cast("string").alias("source_key"),
        F.lit(error_type).alias("error_type"),
        F.lit(code).alias("error_code"),
        F.lit(path).alias("path"),
        F.lit(expected).alias("expected"),
        actual.cast("string").alias("actual"),
        context.alias("context"),
        F.lit(run).alias("run_id"),
        F.lit(epoch).alias("epoch"),
    )


def split_valid(df: DataFrame, rule: Column, key: str, code: str = CODES["refinement"], path: str = "", expected: str = "") -> tuple[DataFrame, DataFrame]:
    flagged = df.withColumn("_ok", F.coalesce(rule, F.lit(False)))
    return flagged.where("_ok").drop("_ok"), error_rows(flagged.where(~F.col("_ok")), key, "REFINEMENT", code, path, expected, F.lit(None).cast("string"))


def rule_column(column: str, kind: str, argument=None) -> Column:
    """NOT_NULL, RANGE ``lo:hi``, PATTERN, ALLOWED values, NON_EMPTY."""
    c = F.col(column)
    if kind == "NOT_NULL":
        return c.isNotNull()
    if kind == "RANGE":
        lo, hi = argument.split(":")
        return c.between(float(lo), float(hi))
    if kind == "PATTERN":
        return c.rlike(argument)
    if kind == "ALLOWED":
        return c.isin(list(argument))
    if kind == "NON_EMPTY":
        return F.length(F.trim(c)) > 0
    raise ValueError(kind)


@dataclass(frozen=True)
class Rule:
    id: str
    predicate: Column
    severity: str = "ERROR"
    code: str = CODES["refinement"]
    message: str = ""


def filled(message: str, columns: Sequence[str]) -> Column:
    """A message in which ``{column}`` stands for the row's value (``null`` if there is none); other braces stay."""
    parts = re.split(r"\{(\w+)\}", message)
    out = [F.lit(p) if k % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("null")) if p in columns else F.lit("{" + p + "}") for k, p in enumerate(parts)]
    return out[0] if len(out) == 1 else F.concat(*out)


def apply_rules(df: DataFrame, rules: Sequence[Rule], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a failed ERROR rule, and a report row for each failed rule; one pass builds the failures."""
    failed = [F.when(~F.coalesce(r.predicate, F.lit(False)), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.code).alias("error_code"), filled(r.message, df.columns).alias("message"))) for r in rules]
    flagged = df.withColumn("_failed", F.filter(F.array(*failed), lambda x: x.isNotNull()))
    report = flagged.select(F.col(key).alias("source_key"), F.explode("_failed").alias("f")).select("source_key", "f.*")
    return flagged.where(~F.exists("_failed", lambda f: f["severity"] == "ERROR")).drop("_failed"), report


def validate_lookup(df: DataFrame, column: str, lookup: DataFrame, key: str) -> DataFrame:
    """Rows whose code the lookup lacks."""
    return df.join(lookup.select(F.col(key).alias(column)), column, "left_anti").select(*df.columns)


def threshold(errors: int | Column, total: int | Column, absolute: int | None = None, share: float | None = None) -> Column:
    """Halt beyond a count or a share; exactly at it goes on, and an empty batch passes."""
    e, t = (x if isinstance(x, Column) else F.lit(x) for x in (errors, total))
    halt = F.lit(False)
    if absolute is not None:
        halt = halt | (e > absolute)
    if share is not None:
        halt = halt | ((t > 0) & (e / F.greatest(t, F.lit(1)) > share))
    return halt


def circuit_breaker(df: DataFrame, rule: Column, key: str, n: int = 10_000, rate: float = 0.05) -> DataFrame:
    """Verdict on the first ``n`` keys: sampled rows, failures, rate, tripped."""
    first = df.select(key, F.coalesce(rule, F.lit(False)).alias("ok")).orderBy(key).limit(n)
    counts = first.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(~F.col("ok")).alias("failed"))
    return counts.select("sampled", "failed", (F.col("failed") / F.greatest("sampled", F.lit(1))).alias("rate"), threshold(F.col("failed"), F.col("sampled"), share=rate).alias("tripped"))


def commit_if(ok: DataFrame, halted: bool, staging: str, path: str) -> bool:
    """Write to a staging path; only if the verdict allows it, rename that to a version of ``path`` and make it current.

    ``sources.publish.read_published`` reads what is current. Nothing is copied, and a failure at any point leaves the old
    version readable.
    """
    ok.write.mode("overwrite").parquet(staging)
    if not halted:
        version = f"version-{uuid.uuid4().hex}"
        moved(ok.sparkSession, staging, f"{path}/{version}")
        point(ok.sparkSession, path, version)
    return not halted


def ledger(total: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row: input, the rows of each part, and what is unaccounted for."""
    counts = total.agg(F.count(F.lit(1)).alias("input_count"))
    for name, df in parts.items():
        counts = counts.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    rest = F.col("input_count")
    for name in parts:
        rest = rest - F.col(name)
    return counts.withColumn("discrepancy", rest).withColumn("balanced", F.col("discrepancy") == 0)


def account_keys(total: DataFrame, parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Keys that are missing, extra, or in more than one part."""
    tagged = None
    for name, df in parts.items():
        part = df.select(F.col(key).alias("key"), F.lit(name).alias("part"))
        tagged = part if tagged is None else tagged.unionByName(part)
    seen = tagged.groupBy("key").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("rows"))
    from .joins import full_join  # which takes its error rows from here

    both = full_join(total.select(F.col(key).alias("key")).distinct().withColumn("_in", F.lit(True)), seen, ["key"])
    issue = F.when(F.col("parts").isNull(), "MISSING").when(F.col("_in").isNull(), "EXTRA").when(F.col("parts") > 1, "OVERLAP").when(F.col("rows") > 1, "DUPLICATE")
    return both.select("key", issue.alias("issue")).where("issue is not null")


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type", "error_code", "epoch").agg(F.count(F.lit(1)).alias("n"))


def same_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two error tables are equal but for order, by count and sum of row hashes."""
    cols = [c for c in a.columns if c not in ("run_id", "context")]

    def mark(df: DataFrame, n: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"n_{n}"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).alias(f"h_{n}"))

    return mark(a, "a").crossJoin(mark(b, "b")).select("n_a", "n_b", ((F.col("n_a") == F.col("n_b")) & (F.col("h_a") == F.col("h_b"))).alias("same"))


def step_metrics(df: DataFrame, columns: Sequence[str], violated: Column) -> DataFrame:
    """Rows, null rate of each column and rule violations, in one pass."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), *[(F.count_if(F.col(c).isNull()) / n).alias(f"null_rate_{c}") for c in columns], F.count_if(~F.coalesce(violated, F.lit(False))).alias("violations"))


class Telemetry:
    """Rows in and out of each step of a mapping, null rates and violations, taken while the mapping's own job runs.

    ``measured`` puts an observation at either end of a step; nothing is scanned twice, and Spark hands over the numbers
    when an action over the result has ended. ``rows`` then waits for them. The order of steps is that of the calls.
    """

    def __init__(self):
        self.steps: list[tuple[str, Observation, Observation, Sequence[str]]] = []

    def measured(self, name: str, df: DataFrame, step: Callable[[DataFrame], DataFrame], columns: Sequence[str] = (), rule: Column | None = None) -> DataFrame:
        """``step(df)``, with counts of the rows before it, and after it with nulls of ``columns`` and violations of ``rule``."""
        before, after = Observation(f"in-{uuid.uuid4().hex}"), Observation(f"out-{uuid.uuid4().hex}")
        self.steps.append((name, before, after, columns))
        n = F.count(F.lit(1))
        violated = [F.count_if(~F.coalesce(rule, F.lit(False))).alias("violations")] if rule is not None else []
        nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns]
        return step(df.observe(before, n.alias("n"))).observe(after, n.alias("n"), *violated, *nulls)

    def rows(self, spark: SparkSession) -> DataFrame:
        """A row a step and column (null: the step itself): step, rows_in, rows_out, violations, column_name, null_rate."""
        out = []
        for name, before, after, columns in self.steps:
            a, b = before.get, after.get
            violations = b.get("violations", 0)
            out.append((name, a["n"], b["n"], violations, None, None))
            out += [(name, a["n"], b["n"], violations, c, b[f"nulls_{c}"] / b["n"] if b["n"] else None) for c in columns]
        return spark.createDataFrame(out, "step string, rows_in long, rows_out long, violations long, column_name string, null_rate double")


def lookup_conflicts(df: DataFrame, key: str, value: str, epoch: str) -> DataFrame:
    return df.groupBy(key, epoch).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")
