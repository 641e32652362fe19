"""Dimension tables: small configuration tables that parameterise the operators.

A :class:`Dim` keeps its rows next to its schema, so building a plan from it starts no job. Any operator
also takes a plain DataFrame with the same columns; its rows are then fetched through a bounded read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.session import bounded_rows

#: Terms up to this many are written into the plan as literals; larger dimensions are joined.
UNROLL_LIMIT = 400
#: Configuration tables (categories, known names) may not be larger than this.
CONFIG_LIMIT = 10_000

GAZETTEER_SCHEMA = (
    "party string, party_ordinal int, requires_figure boolean, kind string, "
    "canonical string, variant string, variant_ordinal int"
)
ALIAS_SCHEMA = "variant string, canonical string, ordinal int"
LEXICON_SCHEMA = "theme string, theme_ordinal int, keyword string, keyword_ordinal int"
TAXONOMY_SCHEMA = "category string, ordinal int, description string, keywords array<string>"


@dataclass(frozen=True)
class Dim:
    schema: str
    rows: tuple

    @property
    def columns(self) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def dicts(self) -> list[dict]:
        return [dict(zip(self.columns, row)) for row in self.rows]


def dim_frame(spark: SparkSession, dim) -> DataFrame:
    """A dimension as a table. A :class:`Dim` of bounded size is marked for broadcast, as a table made from
    rows has no statistics that would tell Catalyst that it is small."""
    if not isinstance(dim, Dim):
        return dim
    frame = dim.frame(spark)
    return F.broadcast(frame) if len(dim.rows) <= CONFIG_LIMIT else frame


def dim_rows(dim, limit: int = UNROLL_LIMIT) -> list[dict] | None:
    """Rows of a dimension as dicts, or None when there are more than ``limit``."""
    if isinstance(dim, Dim):
        return dim.dicts() if len(dim.rows) <= limit else None
    rows = bounded_rows(dim, limit)
    return None if rows is None else [r.asDict() for r in rows]


def config_rows(dim, limit: int = CONFIG_LIMIT) -> list[dict]:
    """Rows of a dimension that is configuration by nature; too many rows is an error."""
    rows = dim_rows(dim, limit)
    if rows is None:
        raise ValueError(f"configuration table has more than {limit} rows")
    return rows


def holds(dim, column: str, value: str) -> bool:
    """Whether a dimension of any size has a row with this value."""
    if isinstance(dim, Dim):
        at = dim.columns.index(column)
        return any(row[at] == value for row in dim.rows)
    return not dim.where(F.col(column) == value).isEmpty()


def gazetteer(parties: dict) -> Dim:
    """``{party: {"names": [...], "figures": {canonical: [variants]}, "requires_figure": bool}}`` → Dim."""
    rows = []
    for ordinal, (party, spec) in enumerate(parties.items()):
        flag = bool(spec.get("requires_figure", False))
        for i, name in enumerate(spec.get("names", [])):
            rows.append((party, ordinal, flag, "party", party, name, i))
        position = len(spec.get("names", []))
        for canonical, variants in spec.get("figures", {}).items():
            for variant in variants:
                rows.append((party, ordinal, flag, "figure", canonical, variant, position))
                position += 1
    return check_gazetteer(Dim(GAZETTEER_SCHEMA, tuple(rows)))


def check_gazetteer(dim: Dim) -> Dim:
    for row in dim.dicts():
        if row["kind"] not in ("party", "figure"):
            raise ValueError(f"gazetteer kind must be party or figure, not {row['kind']!r}")
        if not (row["variant"] or "").strip():
            raise ValueError(f"gazetteer row for {row['party']!r} has an empty variant")
    return dim


def aliases(pairs) -> Dim:
    """(variant, canonical) pairs in priority order → Dim."""
    return Dim(ALIAS_SCHEMA, tuple((v, c, i) for i, (v, c) in enumerate(pairs)))


def gazetteer_aliases(gaz: Dim, extra=()) -> Dim:
    """Alias table with every figure variant of a gazetteer, then ``extra`` pairs."""
    pairs = [(r["variant"], r["canonical"]) for r in gaz.dicts() if r["kind"] == "figure"]
    return aliases([*pairs, *extra])


def lexicon(themes: dict) -> Dim:
    rows = []
    for ordinal, (theme, keywords) in enumerate(themes.items()):
        rows.extend((theme, ordinal, keyword, i) for i, keyword in enumerate(keywords))
    return Dim(LEXICON_SCHEMA, tuple(rows))


def taxonomy(categories: dict) -> Dim:
    rows = [(name, i, text, list(words)) for i, (name, (text, words)) in enumerate(categories.items())]
    return Dim(TAXONOMY_SCHEMA, tuple(rows))


def default_lexicon() -> Dim:
    return lexicon(fixed.THEMES)


def default_topics() -> Dim:
    return lexicon(fixed.TOPICS)


def default_taxonomy() -> Dim:
    return taxonomy(fixed.TAXONOMY)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer kept as JSON lines with the columns of ``GAZETTEER_SCHEMA``."""
    return spark.read.schema(GAZETTEER_SCHEMA).json(path)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias table kept as JSON lines with the columns of ``ALIAS_SCHEMA``."""
    return spark.read.schema(ALIAS_SCHEMA).json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEXICON_SCHEMA).json(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAXONOMY_SCHEMA).json(path)


def grouped(rows: list[dict], key: str, order: str) -> list[tuple[str, list[dict]]]:
    """Rows grouped by ``key`` in the order of ``order``."""
    groups: dict = {}
    for row in sorted(rows, key=lambda r: r[order]):
        groups.setdefault(row[key], []).append(row)
    return list(groups.items())
