"""Projection, derivation, safe conversion and cleaning; failures become rows of a second table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.errors import CODES, error_rows


def project(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def derive(df: DataFrame, name: str, expression: Column | str) -> DataFrame:
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def when_expr(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def fallback(df: DataFrame, columns: Sequence[str], out: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The first value that is there; rows without any become error rows."""
    flagged = df.withColumn(out, F.coalesce(*[F.col(c) for c in columns]))
    return flagged.where(F.col(out).isNotNull()), error_rows(flagged.where(F.col(out).isNull()), key, "FALLBACK", CODES["null_field"], out, "one of " + ", ".join(columns), F.lit(None).cast("string"))


def make_record(df: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    return df.withColumn(name, F.struct(*fields)).drop(*fields)


def unpack(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], f"{name}.*")


def key_text(columns: Sequence[str]) -> Column:
    """The canonical text of a key: values parted by ``|``, null as ``~``; these signs and the backslash are escaped in
    values, so that different keys have different texts."""
    escaped = lambda c: F.regexp_replace(F.col(c).cast("string"), r"([\\|~])", r"\\$1")
    return F.concat_ws("|", *[F.coalesce(escaped(c), F.lit("~")) for c in columns])


def surrogate_key(df: DataFrame, columns: Sequence[str], name: str = "sk", seed: str = "") -> DataFrame:
    """SHA-256 of the seed and the canonical key text."""
    return df.withColumn(name, F.sha2(F.concat_ws("|", F.lit(seed), key_text(columns)), 256))


def uuid5_key(df: DataFrame, columns: Sequence[str], namespace: str, name: str = "uuid") -> DataFrame:
    """Name-based UUID (version 5) of the canonical key text in a namespace (32 hex digits)."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace)), key_text(columns).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return df.withColumn(name, F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12)))


def filter_rows(df: DataFrame, *predicates: Column) -> DataFrame:
    for p in predicates:
        df = df.where(p)
    return df


def safe_cast(df: DataFrame, column: str, kind: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Converted rows, and error rows for values that are there but do not convert."""
    tried = df.withColumn("_to", F.col(column).try_cast(kind))
    failed = F.col(column).isNotNull() & F.col("_to").isNull()
    ok = tried.where(~failed).withColumn(column, F.col("_to")).drop("_to")
    return ok, error_rows(tried.where(failed), key, "TYPE", CODES["type_cast"], column, kind, F.col(column).cast("string"))


STRING_STEPS: dict[str, Callable[..., Column]] = {
    "trim": F.trim,
    "upper": F.upper,
    "lower": F.lower,
    "title": F.initcap,
    "remove_prefix": lambda c, p: F.when(F.startswith(c, F.lit(p)), F.substring(c, F.lit(len(p) + 1), F.length(c))).otherwise(c),
    "replace": lambda c, a, b: F.regexp_replace(c, a, b),
    "split": lambda c, s: F.split(c, s),
    "join": lambda c, s: F.array_join(c, s),
}


def cleaned(column: Column, steps: Sequence[tuple]) -> Column:
    for name, *args in steps:
        column = STRING_STEPS[name](column, *args)
    return column


def clean_dates(text: Column, parse: str, show: str, from_zone: str | None = None) -> Column:
    ts = F.try_to_timestamp(text, F.lit(parse))
    return F.date_format(F.to_utc_timestamp(ts, from_zone) if from_zone else ts, show)


def clean_array(array: Column, keep: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """Elements that pass, changed, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(array, keep), change)))


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def logic_lookup(key: Column, mapping: Mapping, default=None) -> Column:
    """A table-free lookup: code to value."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def json_fields(df: DataFrame, column: str, paths: Mapping[str, str]) -> DataFrame:
    return df.withColumns({n: F.get_json_object(column, p) for n, p in paths.items()})


def restrict(df: DataFrame, policy: Mapping[str, Sequence[str]], roles: Sequence[str], null: bool = True) -> DataFrame:
    """Columns whose policy names none of the roles are nulled, or removed."""
    hidden = [c for c, allowed in policy.items() if not set(allowed) & set(roles)]
    if not null:
        return df.drop(*hidden)
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden})


def external_calc(df: DataFrame, function, name: str, kind: T.DataType | str, id: str, version: str, *columns: str) -> DataFrame:
    """A registered calculator on Arrow batches; its id and version are stamped on every row."""
    return df.withColumn(name, F.pandas_udf(function, kind)(*columns)).withColumn("calc_id", F.lit(id)).withColumn("calc_version", F.lit(version))


def classify(column: Column, sets: Mapping[str, Sequence[str]], default: str) -> Column:
    out = None
    for name, members in sets.items():
        hit = column.isin(list(members))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def erase(df: DataFrame, subjects: DataFrame, key: str, columns: Sequence[str] = (), mode: str = "remove") -> DataFrame:
    """Remove the rows of subjects, or hash their identifying columns."""
    if mode == "remove":
        return df.join(subjects.select(key), key, "left_anti").select(*df.columns)
    marked = df.join(subjects.select(key).distinct().withColumn("_s", F.lit(True)), key, "left")
    return marked.withColumns({c: F.when(F.col("_s"), F.sha2(F.col(c).cast("string"), 256)).otherwise(F.col(c).cast("string")) for c in columns}).select(*df.columns)
