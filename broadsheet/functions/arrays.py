"""Column functions on arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import col, strip


def literal_array(values, kind: str = "string") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def split_list(csv) -> Column:
    """P05. Comma-separated text → array of trimmed, non-empty entries (empty array for NULL)."""
    parts = F.transform(F.split(F.coalesce(col(csv), F.lit("")), ","), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def join_list(arr, limit: int | None = None, sep: str = ", ") -> Column:
    """P06. Array → text, the first ``limit`` entries only."""
    a = col(arr)
    return F.array_join(F.slice(a, 1, limit) if limit else a, sep)


def parse_affiliations(json) -> Column:
    """P07. JSON object text → map; anything that does not parse is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    c = col(json)
    usable = F.get_json_object(c, "$").startswith("{")
    return F.when(usable, F.coalesce(F.from_json(c, "map<string,string>"), empty)).otherwise(empty)


def first_non_empty(*arrays) -> Column:
    """P10. First array with an element, in the order given; the last one when all are empty."""
    out = None
    for a in arrays[:-1]:
        hit = F.size(F.coalesce(col(a), F.array().cast("array<string>"))) > 0
        out = F.when(hit, col(a)) if out is None else out.when(hit, col(a))
    return out.otherwise(F.coalesce(col(arrays[-1]), F.array().cast("array<string>")))


def coerce_metadata(entries: Column) -> Column:
    """P18. map<string, string> without its NULL entries, for export to a store of scalars."""
    return F.map_filter(entries, lambda k, v: v.isNotNull())


def scalar_text(df: DataFrame, name: str) -> Column:
    """One column in the form :func:`coerce_metadata` exports: lists comma-joined, maps as JSON."""
    kind = df.schema[name].dataType.typeName()
    if kind == "array":
        return F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), ",")
    if kind in ("map", "struct"):
        return F.to_json(F.col(name))
    return F.col(name).cast("string")


def export_metadata(df: DataFrame, columns: list[str], out: str = "metadata") -> DataFrame:
    """P18 over named columns of a table."""
    pairs = [x for name in columns for x in (F.lit(name), scalar_text(df, name))]
    return df.withColumn(out, coerce_metadata(F.create_map(*pairs)))


def distinct_ci(arr) -> Column:
    """R10. Elements distinct without regard to case, the first spelling kept, order kept."""
    a = col(arr)
    lowered = F.transform(a, lambda x: F.lower(x))
    return F.filter(a, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def unnest(df: DataFrame, column: str, name: str, *keep) -> DataFrame:
    """One row per element of a list column. Written as an outer explode and a NULL test, because for a
    plain explode the optimizer adds a size test below the projections that compute the list, and so
    computes the list twice."""
    return df.select(*keep, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())
