"""License scan: ordered signatures behind a keyword gate, as one narrow pass of built-in functions.

A text is normalised to lower-case words. One pattern over all rules' keywords (grouped by first letter) finds which
keywords it holds; only rules of those are tried, each as a regular expression whose matches are spans of the text.
Spans that lie inside a span of a rule with an equal or better level are suppressed (of equal spans on one level, the
rule that comes first stays).
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import ascii_lower, narrow
from broadsheet.llm.license_rules import BASE, WEIGHTS, Rule, build

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gate(rules: list[Rule]) -> str:
    """A pattern that matches any rule's keyword as a word, with its first letters told apart first."""
    by_letter = defaultdict(set)
    for r in rules:
        by_letter[r.keyword[0]].add(r.keyword[1:])
    return " (" + "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in sorted(by_letter.items())) + ")(?= )"


def _rule_table(rules: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r.label).alias("label"), F.lit(r.level).alias("level"), F.lit(r.keyword).alias("keyword"),
                              F.lit(f" {r.pattern}(?= )").alias("pattern")) for i, r in enumerate(rules)])


def _spans(text: Column, rule: Column) -> Column:
    """(start, end, level, place, label) of each match: its start is the length of all that was split off before it."""
    hits = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    gaps = F.split(text, rule["pattern"], -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,level:int,place:int,label:string>>").alias("found"))

    def step(state, i):
        begin = state["at"] + F.length(F.element_at(gaps, i))
        end = begin + F.length(F.element_at(hits, i))
        found = F.struct(begin.alias("start"), end.alias("end"), rule["level"].alias("level"), rule["place"].alias("place"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    return F.when(F.size(hits) > 0, F.aggregate(F.sequence(F.lit(1), F.size(hits)), start, step, lambda s: s["found"])).otherwise(start["found"])


def _surviving(spans: Column) -> Column:
    """Spans outside those of equal or better rules. In order of start, then longest, best level and first rule, a span
    can only lie inside one that comes before it, so the furthest end so far of each level decides."""
    levels = len(WEIGHTS)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["level"], s["place"], s["label"], s["end"])))
    start = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"),
                     F.array().cast("array<struct<start:int,end:int,level:int,place:int,label:string>>").alias("kept"))

    def step(state, s):
        inside = F.exists(F.slice(state["ends"], 1, s["level"] + 1), lambda e: e >= s["end"])
        ends = F.transform(state["ends"], lambda e, i: F.when(i == s["level"], F.greatest(e, s["end"])).otherwise(e))
        kept = F.concat(state["kept"], F.array(F.struct(s["start"], s["end"], s["level"], s["place"], s["label"])))
        return F.when(inside, state).otherwise(F.struct(ends.alias("ends"), kept.alias("kept")))

    return F.aggregate(ordered, start, step, lambda s: s["kept"])


def _word_index(text: Column, at: Column) -> Column:
    """Words before a character position: each has one space before it."""
    before = F.substring(text, F.lit(1), at)
    return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("bigint")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word (of the base phrases; null
    without one), base_labels, labels (base and surviving ones; distinct, sorted, comma-joined), score (confidence of the
    best surviving rule, 0 without one) and detections (start, end, level, place, label of surviving spans, as characters
    of the normalised text).

    Null and empty texts have no words and empty labels. Repeated rows and null ids stay as they are.
    """
    rules = build() if rules is None else rules
    plain = F.trim(F.regexp_replace(ascii_lower(F.col("text")), WORD_GAP, " "))
    rows = narrow(docs, id_col, text_col).select("doc_id", F.concat(F.lit(" "), plain, F.lit(" ")).alias("norm"))
    rows = rows.select("doc_id", "norm", F.array_distinct(F.regexp_extract_all("norm", F.lit(gate(rules)), F.lit(1))).alias("keywords"))
    some = F.size("keywords") > 0
    table = _rule_table(rules)
    spans = F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(F.col("keywords"), r["keyword"])), lambda r: _spans(F.col("norm"), r)))
    nothing = F.array().cast("array<struct<start:int,end:int,level:int,place:int,label:string>>")
    rows = rows.withColumn("detections", F.when(some, _surviving(spans)).otherwise(nothing))

    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        pattern, there = f" {phrase}(?= )", F.contains("norm", F.lit(f" {phrase} "))
        gaps = F.split("norm", pattern, -1)
        counts.append(F.when(there, F.size(gaps) - 1).otherwise(0).cast("bigint"))
        firsts.append(F.when(there, _word_index(F.col("norm"), F.length(F.element_at(gaps, 1)))))
        lasts.append(F.when(there, _word_index(F.col("norm"), F.length("norm") - F.length(F.element_at(gaps, -1)) - len(phrase) - 1)))
        labels.append(F.when(there, F.lit(label)))
    base = F.filter(F.array(*labels), lambda x: x.isNotNull())
    n_words = F.when(F.length("norm") <= 2, 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1).cast("bigint")
    weight = F.array(*[F.lit(w) for w in WEIGHTS])
    joined = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"]))))
    return rows.select(
        "doc_id", n_words.alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(joined, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: F.element_at(weight, d["level"] + 1))), F.lit(0.0)).alias("score"), "detections")
