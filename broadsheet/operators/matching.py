"""Term matching: which dimension terms occur in which texts.

Three exact forms with one meaning:

* a few terms — one literal test per term in a projection: no join, no shuffle;
* some hundreds — one pass over each text with a term automaton, in Arrow batches: no join, no shuffle
  (where the automaton library is not installed, the first form is used);
* many terms — the same pass, but its hits leave as rows (key, term) that meet the dimension in a join; beyond
  ``SCAN_LIMIT`` terms (or ``SCAN_CHARS`` of them) texts are cut into short anchor grams, joined to the terms on
  the anchor, and each candidate is checked in a window just long enough for the longest term. Only grams travel,
  never whole texts, and a gram that is frequent in the corpus meets only the few terms that start with it, which
  adaptive execution can split.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

from broadsheet.dims import UNROLL_LIMIT
from broadsheet.functions.arrays import unnest
from broadsheet.functions.batches import pieces
from broadsheet.functions.text import WORD, WS, WS_CHARS, escape
from broadsheet.session import bounded_rows

ANCHOR_CHARS = 8
#: Characters that part a name from what stands beside it.
NAME_EDGE = "[" + WS + r",।.\-()]"
#: From this many terms on, one pass with an automaton beats a test per term.
SCAN_FROM = 24
#: Up to so many terms, and characters of them, every task has its own automaton of them all.
SCAN_LIMIT, SCAN_CHARS = 20_000, 1_000_000


def contains_term(lowered: Column, term: str) -> Column:
    return F.contains(lowered, F.lit(term.lower()))


def contains_word(lowered: Column, term: str) -> Column:
    """Term with no letter, mark, digit or underscore next to it. The plain substring test runs first,
    so the regex only sees texts that hold the term; in the regex the term comes first, so the character
    classes are only tried where it occurs."""
    t = term.lower()
    e = escape(t)
    return F.contains(lowered, F.lit(t)) & lowered.rlike(f"{e}(?![{WORD}])(?<![{WORD}]{e})")


TESTS = {"word": contains_word, "substring": contains_term}


def scan_terms(lowered: Column, terms: list[str], mode: str) -> Column:
    """The terms (in lower case) that occur in each text, as an array in term order."""
    words = sorted({t.lower() for t in terms if t})
    edge = None if mode == "substring" else re.compile(r"\w", re.UNICODE)

    def part_of_word(c: str) -> bool:
        return bool(edge.match(c)) or unicodedata.category(c)[0] == "M"

    @F.arrow_udf("array<string>")
    def scan(texts: pa.Array) -> pa.Array:
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        out = []
        for text in texts.to_pylist():
            found = set()
            for end, w in automaton.iter(text or ""):
                if w in found:
                    continue
                start = end - len(w) + 1
                if edge is None or not (
                    (start > 0 and part_of_word(text[start - 1])) or (end + 1 < len(text) and part_of_word(text[end + 1]))
                ):
                    found.add(w)
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.string()))

    return scan(lowered)


def term_tests(df: DataFrame, lowered: str, terms: list[str], mode: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """A test per term, and the table it applies to. Helper columns start with an underscore."""
    if len(terms) < SCAN_FROM or ahocorasick is None:
        return df, lambda term: TESTS[mode](F.col(lowered), term)
    scanned = df.withColumn("_found", scan_terms(F.col(lowered), terms, mode))
    return scanned, lambda term: F.array_contains("_found", term.lower())


def any_test(test: Callable[[str], Column], terms) -> Column:
    out = F.lit(False)
    for i, term in enumerate(terms):
        out = test(term) if i == 0 else out | test(term)
    return out


def any_of(lowered: Column, terms, mode: str = "substring") -> Column:
    return any_test(lambda term: TESTS[mode](lowered, term), terms)


def distinct_hits(lowered: Column, terms) -> Column:
    """How many of the terms occur at least once."""
    out = F.lit(0)
    for term in dict.fromkeys(t.lower() for t in terms):
        out = out + contains_term(lowered, term).cast("int")
    return out


def occurrences(lowered: Column, term: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    t = term.lower()
    left = F.length(lowered) - F.length(F.replace(lowered, F.lit(t), F.lit("")))
    return (left / len(t)).cast("int")


def occurrences_of(lowered: Column, term: Column) -> Column:
    """As ``occurrences``, for a column of terms in lower case."""
    left = F.length(lowered) - F.length(F.replace(lowered, term, F.lit("")))
    return (left / F.length(term)).cast("int")


def _part_of_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LMN"


def scan_rows(df: DataFrame, key: str, text: str, words: list[str], term: str, mode: str) -> DataFrame:
    """(key, term, n) for each row and each of some distinct terms in lower case that occurs in its text: one pass over
    the texts. ``n`` counts occurrences that do not overlap, from the left (for ``substring``; else 1). A row's hits travel
    once, as one list of places and counts, and the result is partitioned by the key, so what groups or joins by it needs
    no shuffle. Rows without a key have no hits."""
    edges = frozenset(WS_CHARS + ",।.-()")
    schema = T.StructType([df.schema[key], T.StructField("_i", T.ArrayType(T.IntegerType())), T.StructField("_n", T.ArrayType(T.IntegerType()))])

    def inside(text: str, start: int, end: int) -> bool:
        before, after = text[start - 1] if start else "\n", text[end + 1:end + 2]
        if mode == "word":
            return not _part_of_word(before) and not (after and _part_of_word(after))
        return before in edges and (not after or after in edges)

    def run(batches):
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, (i, len(w)))
        automaton.make_automaton()
        for part in (p for batch in batches for p in pieces(batch, 1)):
            rows, starts, found, counts = [], [0], [], []
            for row, text in enumerate(part.column(1).to_pylist()):
                n: dict[int, int] = {}
                free: dict[int, int] = {}  # where the next occurrence of a term may start
                for end, (i, size) in automaton.iter(text or ""):
                    start = end - size + 1
                    if mode == "substring":
                        if start >= free.get(i, 0):
                            n[i], free[i] = n.get(i, 0) + 1, end + 1
                    elif i not in n and inside(text, start, end):
                        n[i] = 1
                if n:
                    rows.append(row)
                    found.extend(n)
                    counts.extend(n.values())
                    starts.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *lists], names=[key, "_i", "_n"])

    texts = df.where(F.col(key).isNotNull()).select(key, F.lower(F.col(text)).alias("_low"))
    hits = texts.mapInArrow(run, schema).repartition(key).select(key, F.explode(F.arrays_zip("_i", "_n")).alias("_h"))
    vocabulary = df.sparkSession.createDataFrame(list(enumerate(words)), T.StructType([T.StructField("_i", T.IntegerType()), T.StructField(term, T.StringType())]))
    return hits.select(key, "_h._i", F.col("_h._n").alias("n")).join(F.broadcast(vocabulary), "_i").select(key, term, "n")


def _vocabulary(terms: DataFrame, term: str, scan_limit: int) -> tuple[DataFrame, object, list[str] | None]:
    """Distinct terms in lower case, their sizes, and the terms themselves where they are few enough for an automaton."""
    vocabulary = terms.select(F.lower(F.col(term)).alias("_t")).where(F.length("_t") > 0).distinct()
    sizes = vocabulary.agg(
        F.collect_set(F.least(F.length("_t"), F.lit(ANCHOR_CHARS))).alias("anchors"), F.max(F.length("_t")).alias("longest"),
        F.count("*").alias("terms"), F.sum(F.length("_t")).alias("chars"),
    ).first()
    few = ahocorasick is not None and 0 < sizes["terms"] <= scan_limit and sizes["chars"] <= SCAN_CHARS
    return vocabulary, sizes, sorted(r["_t"] for r in vocabulary.collect()) if few else None


def match_counts(df: DataFrame, key: str, text: str, terms: DataFrame, term: str, scan_limit: int | None = None) -> DataFrame:
    """(key, term, n): how often each term of a dimension of any size occurs in a text, without overlaps, where it does.
    Rows without a key are left out; those of a key that comes more often are to be added up."""
    df = df.where(F.col(key).isNotNull())
    words = _vocabulary(terms, term, SCAN_LIMIT if scan_limit is None else scan_limit)[2]
    if words is not None:
        return scan_rows(df, key, text, words, term, "substring")
    hits = match_by_join(df, key, text, terms, term, "substring", scan_limit)
    found = hits.groupBy(key).agg(F.collect_list(term).alias("_terms"))
    counts = F.transform("_terms", lambda t: F.struct(t.alias(term), occurrences_of(F.col("_lower"), t).alias("n")))
    return df.select(key, F.lower(F.col(text)).alias("_lower")).join(found, key).select(key, F.explode(counts).alias("_e")).select(key, "_e.*")


def match_by_join(df: DataFrame, key: str, text: str, terms: DataFrame, term: str, mode: str, scan_limit: int | None = None) -> DataFrame:
    """(key, term) pairs, distinct, for a dimension of any size. ``term`` is compared in lower case. ``mode`` is
    ``word``, ``substring`` or ``name_part`` (between delimiters of names)."""
    vocabulary, sizes, words = _vocabulary(terms, term, SCAN_LIMIT if scan_limit is None else scan_limit)
    if not sizes["anchors"]:
        return df.select(key, F.lit(None).cast("string").alias(term)).where(F.lit(False))
    if words is not None:
        return scan_rows(df, key, text, words, term, mode).select(key, term).distinct()
    longest = sizes["longest"]
    chars = df.select(key, F.split(F.lower(F.col(text)), "").alias("_c"))

    def windows(size: int) -> Column:
        """One string per position: the character before it (a newline at the start), then the window."""
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("_c") - size + 1, F.lit(1))),
            lambda i: F.concat(
                F.when(i > 1, F.get(F.col("_c"), i - 2)).otherwise(F.lit("\n")),
                F.array_join(F.slice("_c", i, longest + 1), ""),
            ),
        )

    # windows repeat within a text, and repeats are dropped before anything is joined
    pieces = chars.select(key, F.explode(F.array_distinct(windows(1))).alias("_w"))
    grams = F.array(*[F.substring("_w", 2, s) for s in sorted(sizes["anchors"])])
    pieces = pieces.select(key, "_w", F.explode(F.array_distinct(grams)).alias("gram"))
    anchored = vocabulary.withColumn("gram", F.substring("_t", 1, ANCHOR_CHARS))
    window = F.substr(F.col("_w"), F.lit(2))
    hits = pieces.join(anchored, "gram").where(F.startswith(window, F.col("_t")))
    if mode == "word":
        before, after = F.substring("_w", 1, 1), F.substr(window, F.length("_t") + 1, F.lit(1))
        hits = hits.where(~before.rlike(f"[{WORD}]") & ~after.rlike(f"[{WORD}]"))
    elif mode == "name_part":
        before, after = F.substring("_w", 1, 1), F.substr(window, F.length("_t") + 1, F.lit(1))
        hits = hits.where(before.rlike(NAME_EDGE) & ((after == "") | after.rlike(NAME_EDGE)))
    return hits.select(key, F.col("_t").alias(term)).distinct()


def match_terms(df: DataFrame, key: str, text: str, terms: DataFrame, term: str, mode: str = "substring",
                unroll_limit: int = UNROLL_LIMIT) -> DataFrame:
    """(key, term) pairs, distinct and in lower case, in the form that suits the number of terms."""
    found = bounded_rows(terms.select(F.lower(F.col(term)).alias("t")).where("t <> ''").distinct(), unroll_limit)
    if found is None:
        return match_by_join(df, key, text, terms, term, mode)
    if not found:
        return df.select(key, F.lit(None).cast("string").alias(term)).where(F.lit(False))
    work = df.select(key, F.lower(F.col(text)).alias("_low"))
    names = [r["t"] for r in found]
    if len(names) >= SCAN_FROM and ahocorasick is not None:
        each = scan_terms(F.col("_low"), names, mode)
    else:
        each = F.array_compact(F.array(*[F.when(TESTS[mode](F.col("_low"), t), F.lit(t)) for t in names]))
    return unnest(work.withColumn("_each", each), "_each", term, key)
