"""Line duplicates by a suffix array over line-ID sequences.

A line's ID is its hash; a suffix is a line's place in its text. Distributed prefix doubling sorts all suffixes by their
first 1, 2, 4, ... lines: the suffixes are range-partitioned and sorted by (rank of the first lines, rank of the lines
that follow, place), each range ranks its own rows, and a summary of a row per range joins the ranges' ranks up. A rank
by ``depth`` lines and the rank of the suffix that starts a line later give the rank by one line more.

Suffixes of one rank are an interval of the array whose common prefixes have at least ``depth`` lines. The first place of
each interval stays; at all others the run of lines is a later copy. A run of ``min_lines`` lines is deleted whatever its
lines hold, a shorter one if it has ``min_words`` words. Every repeated run of more lines is made of runs of ``min_lines``,
so overlapping runs add up to the maximal repeated run, and sorting by more lines would not change what is deleted.
Places take part in the sort, so one very frequent line or run fills no single range.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.llm.common import narrow, parts, stage

MIN_LINES = 3
#: A repeated run of fewer lines goes too if it has so many words.
MIN_WORDS = 20
WORD = r"[^\x20\x09-\x0D]+"
LAST = 2**63 - 1
RANKED = "ord bigint, row_hash bigint, pos int, line_words bigint, run_words bigint, pid int, start bigint, later boolean, edge boolean"


def rank(rows: DataFrame, name: str) -> DataFrame:
    """(ord, row_hash, pos, line_words, run_words, rank, later) for rows (ord, row_hash, pos, line_words, run_words, a, b):
    the number of rows with a smaller (a, b), and whether an equal (a, b) comes earlier by (ord, row_hash, pos)."""
    spark = rows.sparkSession
    keys = ["a", "b", "ord", "row_hash", "pos"]
    ranged = rows.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys)

    def local(batches):
        from pyspark import TaskContext

        pid, n, last, last_start, head = TaskContext.get().partitionId(), 0, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.asarray(batch.column(5)), np.asarray(batch.column(6))
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            new[0] = (x[0], y[0]) != last
            at = np.where(new, np.arange(n, n + len(x)), last_start)
            at = np.maximum.accumulate(at)
            head = (x[0], y[0]) if head is None else head
            edge = (x == head[0]) & (y == head[1])  # may go on from the range before
            yield _batch(batch.columns[:5], pid, at, ~new, edge)
            n, last, last_start = n + len(x), (x[-1], y[-1]), int(at[-1])
        if n:  # the range's summary, marked by a negative position
            yield _summary(pid, n, head, last, last_start)

    both = stage(ranged.select(*PLACE, "a", "b").mapInArrow(local, RANKED + ", n bigint, ends array<bigint>"), name)
    ranges = both.where("n IS NOT NULL").select("pid", "n", "ends", "start").collect()  # one row for each range
    offset, before, out = 0, None, []
    for r in sorted(ranges, key=lambda r: r["pid"]):
        first, last = tuple(r["ends"][:2]), tuple(r["ends"][2:])
        goes_on = before is not None and before[0] == first
        out.append((r["pid"], offset, before[1] if goes_on else offset, goes_on))
        last_start = out[-1][2] if goes_on and last == first else offset + r["start"]
        before, offset = (last, last_start), offset + r["n"]
    offsets = spark.createDataFrame(out, "pid int, offset bigint, first_start bigint, goes_on boolean")
    return (both.where("n IS NULL").join(F.broadcast(offsets), "pid")
            .select(*PLACE, F.when(F.col("edge"), F.col("first_start")).otherwise(F.col("offset") + F.col("start")).alias("rank"),
                    (F.col("later") | (F.col("edge") & F.col("goes_on"))).alias("later")))


def _batch(place, pid, start, later, edge) -> pa.RecordBatch:
    n = len(start)
    return pa.RecordBatch.from_arrays(
        [*place, pa.array(np.full(n, pid, np.int32)), pa.array(start.astype(np.int64)), pa.array(later), pa.array(edge),
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=_NAMES)


def _summary(pid, n, head, last, last_start) -> pa.RecordBatch:
    whole, small, truth = pa.int64(), pa.int32(), pa.bool_()
    one = [pa.array([v], t) for v, t in ((0, whole), (0, whole), (-1, small), (0, whole), (0, whole), (pid, small), (last_start, whole), (False, truth),
                                         (False, truth), (n, whole), ([int(v) for v in (*head, *last)], pa.list_(whole)))]
    return pa.RecordBatch.from_arrays(one, names=_NAMES)


PLACE = ["ord", "row_hash", "pos", "line_words", "run_words"]
_NAMES = [*PLACE, "pid", "start", "later", "edge", "n", "ends"]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(ord, row_hash, pos, n): places from which ``n`` lines are a later copy, with n = ``min_lines``, or fewer lines of
    ``min_words`` words together. ``ord`` is the id (nulls last) and row_hash parts rows that share one."""
    exploded = _rows(docs, id_col, text_col).select("ord", "row_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(WORD)).cast("bigint")
    lines = exploded.select("ord", "row_hash", "pos", words.alias("line_words"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    once = lines.dropDuplicates(["ord", "row_hash", "pos"])  # rows equal in id and text are one text
    ranked, found = rank(once.withColumn("run_words", F.col("line_words")), "lines-1"), []
    place = W.partitionBy("ord", "row_hash").orderBy("pos")
    for depth in range(1, min_lines + 1):
        if depth > 1:
            run_words = F.col("line_words") + F.lead("run_words").over(place)
            pairs = ranked.select("ord", "row_hash", "pos", "line_words", run_words.alias("run_words"), F.col("rank").alias("a"), F.lead("rank").over(place).alias("b"))
            ranked = rank(pairs.where("b IS NOT NULL"), f"lines-{depth}")
        counts = F.col("later") if depth == min_lines else F.col("later") & (F.col("run_words") >= min_words)
        found.append(ranked.where(counts).select("ord", "row_hash", "pos", F.lit(depth).alias("n")))
    return reduce(DataFrame.unionAll, found)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = narrow(docs, id_col, text_col)
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("doc_id", "text").alias("row_hash"), "text")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_removed, kept (the lines left, joined by line feeds).

    Lines are what line feeds part, words what space, tab, vertical tab, form feed and carriage return part. A line is
    removed when a run of lines over it, of ``min_lines`` lines or of fewer with ``min_words`` words, also starts earlier:
    in a row with a smaller id (nulls last; rows that share an id in the order of a hash), or earlier in the same row. Rows
    equal in id and text are one text and have the same result. A null or empty text is one empty line, which alone is no
    run (``min_lines`` 1 apart). A text may lose all its lines: ``kept`` is then empty. An empty table gives none.
    """
    if min_lines < 1:
        raise ValueError("min_lines starts at 1")
    later = repeated_runs(docs, id_col, text_col, min_lines, min_words)
    # Places and lengths in one number each; at most min_lines for each line of a text.
    runs = later.groupBy("ord", "row_hash").agg(F.collect_list(F.col("pos").cast("bigint") * (min_lines + 1) + F.col("n")).alias("runs"))
    rows = _rows(docs, id_col, text_col).join(runs.hint("shuffle_hash"), ["ord", "row_hash"], "left").select("doc_id", "text", "runs")

    def work(batches):
        for batch in batches:
            doc, texts, found = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n_lines, n_removed, kept = [], [], []
            for text, some in zip(texts, found, strict=True):
                lines = text.split("\n")
                n_lines.append(len(lines))
                gone = np.zeros(len(lines), bool)
                if some:
                    at, n = np.divmod(np.array(some, np.int64), min_lines + 1)
                    edges = np.zeros(len(lines) + 1, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + n, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    text = "\n".join(line for line, g in zip(lines, gone.tolist(), strict=True) if not g)
                n_removed.append(int(gone.sum()))
                kept.append(text)
            yield pa.RecordBatch.from_arrays([doc, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_lines", "n_removed", "kept"])

    return rows.mapInArrow(work, "doc_id bigint, n_lines bigint, n_removed bigint, kept string")
