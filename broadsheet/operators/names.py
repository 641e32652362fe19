"""Person names: canonical forms and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.dims import CONFIG_LIMIT, Dim, aliases as alias_table, dim_frame
from broadsheet.functions.text import WS, normalize_name
from broadsheet.session import bounded_rows, broadcast_if_small


def canonicalize_exact(df: DataFrame, name: str, aliases, out: str = "canonical") -> DataFrame:
    """J06. Alias lookup by equality; a name without an alias stays as it is."""
    table = dim_frame(df.sparkSession, aliases)
    first = table.groupBy(F.col("variant").alias("_v")).agg(F.min_by("canonical", "ordinal").alias("_c"))
    return df.join(first, F.col(name) == F.col("_v"), "left").withColumn(out, F.coalesce("_c", name)).drop("_v", "_c")


def name_map(df: DataFrame, name: str, aliases, threshold: float = 0.6) -> DataFrame:
    """J07 as a lookup table (name, canonical) over the distinct names of a column.

    Passes: the exact alias; a name that already is canonical; then the first alias, in table order, that
    equals the name without case, or that contains it or is contained in it and shares more than
    ``threshold`` of the longer one's words. A match of the last kind shares a word with the name, so
    candidates come from an equi-join on words, never from all pairs.
    """
    table = dim_frame(df.sparkSession, aliases)
    names = df.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    names = names.withColumn("norm", normalize_name("name"))
    exact = table.groupBy(F.col("variant").alias("norm")).agg(F.min_by("canonical", "ordinal").alias("exact"))
    canon = table.select(F.col("canonical").alias("norm")).distinct().withColumn("is_canonical", F.lit(True))
    stage = names.join(exact, "norm", "left").join(canon, "norm", "left")
    open_names = stage.where("exact is null and is_canonical is null and norm <> ''").select("norm").distinct()

    words = lambda c: F.filter(F.split(F.lower(c), f"[{WS}]+"), lambda w: w != "")
    probe = open_names.select("norm", F.explode(F.array_distinct(words("norm"))).alias("word"))
    forms = table.select(
        "ordinal", "canonical", F.lower("variant").alias("lv"), F.lower("canonical").alias("lc"),
    )
    index = forms.select(
        "*", F.explode(F.array_distinct(F.concat(words("lv"), words("lc")))).alias("word")
    )
    pairs = probe.join(broadcast_if_small(index), "word").drop("word").distinct()
    ln = F.lower("norm")

    def overlap(form: str):
        a, b = words(ln), words(F.col(form))
        return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))

    either = lambda form: F.contains(F.col(form), ln) | F.contains(ln, F.col(form))
    same = (ln == F.col("lv")) | (ln == F.col("lc"))
    close = (either("lv") | either("lc")) & ((overlap("lv") > threshold) | (overlap("lc") > threshold))
    fuzzy = pairs.where(same | close).groupBy("norm").agg(F.min_by("canonical", "ordinal").alias("fuzzy"))
    return stage.join(fuzzy, "norm", "left").select(
        "name",
        F.coalesce("exact", F.when(F.col("is_canonical"), F.col("norm")), "fuzzy", "norm").alias("canonical"),
    )


def canonicalize_fuzzy(df: DataFrame, name: str, aliases, out: str = "canonical", threshold: float = 0.6) -> DataFrame:
    """J07. Adds the canonical form of a name column."""
    lookup = name_map(df, name, aliases, threshold)
    return df.join(
        lookup.select(F.col("name").alias("_n"), F.col("canonical").alias(out)), F.col(name) == F.col("_n"), "left"
    ).drop("_n").withColumn(out, F.coalesce(out, F.lit("")))


def same_person(df: DataFrame, a: str, b: str, aliases, out: str = "same_person") -> DataFrame:
    """J08. Whether two name columns stand for one person."""
    both = df.select(F.col(a).alias("n")).union(df.select(F.col(b).alias("n")))
    lookup = name_map(both, "n", aliases)
    left = lookup.select(F.col("name").alias(a), F.lower("canonical").alias("_ca"))
    right = lookup.select(F.col("name").alias(b), F.lower("canonical").alias("_cb"))
    return (
        df.join(left, a, "left").join(right, b, "left")
        .withColumn(out, F.coalesce("_ca", F.lit("")) == F.coalesce("_cb", F.lit("")))
        .select(*df.columns, out)
    )


def distinct_names(df: DataFrame, key: str, names: str, aliases) -> DataFrame:
    """R10. Canonical names of an array column, distinct without case, first kept, order kept."""
    rows = df.select(key, F.posexplode(names).alias("_pos", "_name"))
    canon = canonicalize_fuzzy(rows, "_name", aliases, "_canonical")
    firsts = canon.groupBy(key, F.lower("_canonical").alias("_low")).agg(
        F.min(F.struct("_pos", "_canonical")).alias("_first"))
    packed = firsts.groupBy(key).agg(F.sort_array(F.collect_list("_first")).alias("_list"))
    return df.join(packed, key, "left").withColumn(
        names, F.coalesce(F.transform("_list", lambda x: x["_canonical"]), F.array().cast("array<string>"))
    ).drop("_list")


def figure_aliases(gaz):
    """Alias table of a gazetteer's figures, variants in gazetteer order."""
    if isinstance(gaz, Dim):
        rows = sorted((r for r in gaz.dicts() if r["kind"] == "figure"), key=lambda r: (r["party_ordinal"], r["variant_ordinal"]))
        return alias_table((r["variant"], r["canonical"]) for r in rows)
    order = F.col("party_ordinal").cast("bigint") * 2**31 + F.col("variant_ordinal")
    return gaz.where("kind = 'figure'").select("variant", "canonical", order.alias("ordinal"))


def distinct_known_names(df: DataFrame, key: str, names: str, known: DataFrame, aliases, limit: int = CONFIG_LIMIT) -> DataFrame:
    """R10 for an array column whose names all come from ``known`` (one column, any table). J07 runs over that list, not
    over the articles, and its result maps the names inside the arrays: no article is shuffled. A list of more than
    ``limit`` names is joined as in ``distinct_names``, by the unique ``key``. NULL arrays become empty."""
    pairs = bounded_rows(name_map(known, known.columns[0], aliases), limit)
    if pairs is None:
        return distinct_names(df, key, names, aliases)
    none = F.array().cast("array<string>")
    if not pairs:
        return df.withColumn(names, F.coalesce(names, none))
    lookup = F.create_map(*[F.lit(x) for p in pairs for x in (p["name"], p["canonical"])])
    found = df.withColumn("_names", F.transform(F.coalesce(names, none), lambda n: F.coalesce(F.try_element_at(lookup, n), n)))
    low = F.transform("_names", lambda n: F.lower(n))
    first = F.filter("_names", lambda n, i: F.array_position(low, F.lower(n)) == i + 1)
    return found.withColumn(names, first).drop("_names")
