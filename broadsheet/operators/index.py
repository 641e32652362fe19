"""A stored index of vectors for joins of many questions with a large corpus.

The index is a table (shard, cell, vector row): every corpus vector is assigned to the nearest of some centres, which are fitted on
a bounded sample; cells that hold much are cut into parts, and the parts are dealt to shards of about equal size. The table is
bucketed by shard, so joins against it shuffle questions only, each once for a shard with the list of the cells it visits there.
A question visits cells, not rows:

* exact: every cell that can hold one of its k best. Cells are balls; a bound on the similarity inside a ball is compared with the
  question's k-th best among the sample, which its k-th best of all cannot fall below. Nothing is left out.
* approximate: the nearest cells, as many as reach the wanted recall for rows of the sample against the sample.

Filters are tested inside a shard before its best are taken. The corpus is read once, however many the questions. Inside a shard
one matrix product in single precision screens rows against questions: a score that is below the k-th best found so far by more
than rounding can explain is no candidate, and only candidates are scored in double precision.
"""

from __future__ import annotations

import datetime as dt
import heapq
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from broadsheet.functions.vectors import check_metric, matrix, scores
from broadsheet.session import materialize, scratch_path

#: Rows that centres are fitted on and questions are bounded by: all that reaches the driver or is broadcast.
SAMPLE_ROWS = 4_096
#: Cells at most (the sample has four rows for each).
MOST_CELLS = 1_024
#: A cell has so many rows or more on average: below that, visits cost more than the rows they save.
CELL_ROWS = 250
#: Rows of a part of a cell, and questions that meet in a shard at once, about.
PART_ROWS, QUESTION_ROWS = 50_000, 100_000
#: Shards, as long as none holds more than so many rows: what is shuffled is a question for each shard, not for each cell.
SHARDS, SHARD_ROWS = 24, 200_000
#: Tasks at least where blocks of questions meet shards: with many blocks shards go together, so that a question meets fewer.
MEETINGS = 48
#: Scores held at once in a task.
SLICE_SCORES = 4_000_000
#: Questions and rows of one product in a shard, and pairs scored in double precision at once.
TILE_QUESTIONS, TILE_ROWS, PAIRS = 256, 8_192, 50_000
#: Rows of filters' masks held at once in a task.
MASKS = 50_000_000
#: An exact join takes a cell together with others if so many of a shard's questions visit it.
MOST_VISIT = 0.6
#: Rounding of sums of products: bounds are widened by it.
SLACK = 1e-9
FILTERS = ("parties", "people", "themes")


@dataclass
class VectorIndex:
    """``table``: shard, cell, cid, cv and the kept columns. ``radii``: of each cell's ball (NaN: no rows); ``parts``: of each
    cell; ``shards``: of each part, cell by cell. ``sample``: rows (cid, cv, kept columns) that stand in the table too."""

    table: DataFrame
    metric: str
    centres: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    shards: np.ndarray
    sample: pa.Table
    rows: int


def points(m: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as points whose Euclidean distance orders them: of unit length for the cosine (zero vectors: NaN)."""
    if metric != "cosine":
        return m
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm == 0, np.nan, norm)


def _distances(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (p * p).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (p @ centres.T)
    return np.sqrt(np.maximum(squared, 0.0))


def fit_centres(p: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``cells`` groups of the points (Lloyd's rounds from the first distinct ones)."""
    p = p[~np.isnan(p).any(1)]
    distinct = p[np.sort(np.unique(p, axis=0, return_index=True)[1])]
    centres = distinct[:max(1, cells)].copy()
    for _ in range(rounds if len(distinct) > cells else 0):
        nearest = _distances(p, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, p)
        n = np.bincount(nearest, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def deal(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each part: the largest first, each to the shard that holds least."""
    held, out = [(0.0, s) for s in range(shards)], np.zeros(len(sizes), np.int32)
    for at in np.argsort(-sizes, kind="stable"):
        rows, out[at] = heapq.heappop(held)
        heapq.heappush(held, (rows + sizes[at], out[at]))
    return out


def build_index(corpus: DataFrame, metric: str = "cosine", id: str = "id", embedding: str = "embedding", keep: tuple[str, ...] = (),
                sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, cells: int | None = None) -> VectorIndex:
    """The index of a corpus, stored in the shared folder. Ids are integers; rows without a vector (or with a zero vector,
    for the cosine) have no similarity to anything and are left out. ``keep``: columns that filters need. ``cells``: by default
    half the square root of the rows, of CELL_ROWS rows at least, and no more than the sample can place."""
    check_metric(metric)
    spark = corpus.sparkSession
    # staged, so that vectors which the corpus computes are computed once, not for the sample and for the table
    rows = materialize(corpus.select(F.col(id).cast("bigint").alias("cid"), F.col(embedding).alias("cv"), *[F.col(c).alias(c) for c in keep]), "rows").where("cv is not null")
    sample = rows.orderBy(F.xxhash64("cid"), "cid").limit(sample_rows).toArrow()
    n = sample.num_rows if sample.num_rows < sample_rows else rows.count()
    p = points(matrix(sample.column("cv").combine_chunks()), metric) if sample.num_rows else np.zeros((0, 1))
    fit = ~np.isnan(p).any(1)
    sample, p = sample.filter(pa.array(fit)), p[fit]
    cells = cells or max(1, min(MOST_CELLS, len(p) // 4, round(math.sqrt(n) / 2), math.ceil(n / CELL_ROWS)))
    centres = fit_centres(p, cells) if len(p) else np.zeros((1, p.shape[1]))
    share = np.bincount(_distances(p, centres).argmin(1), minlength=len(centres)) / max(1, len(p))
    parts = np.maximum(1, np.ceil(share * n / part_rows)).astype(np.int64)
    first = np.cumsum(parts) - parts
    shards = deal(np.repeat((share * n + 1) / parts, parts), min(int(parts.sum()), max(SHARDS, math.ceil(n / SHARD_ROWS))))

    @F.arrow_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    def place(v: pa.Array, ids: pa.Array) -> pa.Array:
        x = points(matrix(v, centres.shape[1]), metric)
        if x.shape[1] != centres.shape[1]:
            raise ValueError("vectors of one column must have one length")
        cell, away = np.zeros(len(x), np.int64), np.full(len(x), np.nan)
        step = max(1, SLICE_SCORES // len(centres))
        for at in range(0, len(x), step):
            d = _distances(x[at:at + step], centres)
            cell[at:at + step] = np.where(np.isnan(d[:, 0]), -1, np.nan_to_num(d).argmin(1))
            away[at:at + step] = d[np.arange(len(d)), cell[at:at + step]]
        salt = (np.asarray(ids.fill_null(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        part = (salt % parts[cell].astype(np.uint64)).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(shards[first[cell] + part]), pa.array(cell.astype(np.int32)), pa.array(away)], names=["shard", "cell", "away"])

    # not deterministic to Catalyst, which would else place each vector again below the test for a cell
    placed = rows.withColumn("_at", place.asNondeterministic()("cv", "cid"))
    placed = placed.select(F.col("_at.shard").alias("shard"), F.col("_at.cell").alias("cell"), F.col("_at.away").alias("away"), "cid", "cv", *keep).where("cell >= 0")
    name, buckets = f"vectors_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(buckets, "shard").write.bucketBy(buckets, "shard").option("path", scratch_path(spark, "vectors")).saveAsTable(name)
    table = spark.table(name)
    radii = np.full(len(centres), np.nan)
    for r in table.groupBy("cell").agg(F.max("away").alias("r")).collect():  # at most MOST_CELLS rows
        radii[r["cell"]] = r["r"]
    return VectorIndex(table.drop("away"), metric, centres, radii, parts, shards, sample, n)


def best_inside(index: VectorIndex, q: np.ndarray) -> np.ndarray:
    """(questions × cells): the highest similarity that a row of each cell can have (-inf: the cell is empty)."""
    x = points(q, index.metric)
    if index.metric == "dot":
        bound = x @ index.centres.T + np.sqrt((x * x).sum(1))[:, None] * index.radii[None, :]
        bound += SLACK * (1 + np.abs(bound))
    else:
        near = np.maximum(0.0, _distances(x, index.centres) - index.radii[None, :] - 1e-7)
        bound = 1.0 / (1.0 + near) if index.metric == "euclidean" else 1.0 - near * near / 2
        bound += SLACK
    return np.where(np.isnan(index.radii)[None, :], -np.inf, bound)


def probes_for(index: VectorIndex, k: int, recall: float, questions: int = 256) -> int:
    """How many nearest cells reach ``recall`` for the k best, for rows of the sample against the rest of it."""
    m = matrix(index.sample.column("cv").combine_chunks()) if index.sample.num_rows else np.zeros((0, 1))
    if len(m) < 2:
        return len(index.centres)
    q = m[:questions]
    x, centres = points(m, index.metric), index.centres
    cell = _distances(x, centres).argmin(1)
    sim = scores(m, q, index.metric)
    best = np.argsort(-sim, axis=0, kind="stable")[:k]
    order = np.argsort(_distances(points(q, index.metric), centres), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    visited = place[np.arange(len(q))[None, :], cell[best]]  # when each neighbour's cell is visited
    return int(np.sort(visited.ravel())[min(visited.size - 1, math.ceil(recall * visited.size) - 1)]) + 1


def row_masks(filters: list[tuple], table) -> list:
    """The rows that each of some distinct filters admits (None: all). Value lists are indexed once."""
    n = table.num_rows
    masks: list = [None] * len(filters)

    def narrow(i: int, hit: np.ndarray) -> None:
        masks[i] = hit if masks[i] is None else masks[i] & hit

    for at, name in enumerate(FILTERS):
        if not any(f[at] for f in filters):
            continue
        column = table.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        coded = column.flatten().dictionary_encode(null_encoding="encode")
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        rows, codes = pa.compute.list_parent_indices(column).to_numpy()[order], codes[order]
        places = {value: rows[np.searchsorted(codes, code, "left"):np.searchsorted(codes, code, "right")] for code, value in enumerate(coded.dictionary.to_pylist())}
        for i, f in enumerate(filters):
            if f[at]:
                hit = np.zeros(n, dtype=bool)
                for value in f[at]:
                    hit[places.get(value, [])] = True
                narrow(i, hit)
    if any(f[3] or f[4] for f in filters):
        dates = table.column("date").cast(pa.date32()).cast(pa.int32()).fill_null(np.iinfo(np.int32).min)
        dates = np.asarray(dates)
        for i, f in enumerate(filters):
            for bound, test in ((f[3], np.greater_equal), (f[4], np.less_equal)):
                if bound:
                    narrow(i, test(dates, (bound - dt.date(1970, 1, 1)).days) & (dates > np.iinfo(np.int32).min))
    return masks


def _filters_of(questions) -> list[tuple] | None:
    """Filters of some questions (parties, people, themes, from, to), if they have the columns for them."""
    if "filter_parties" not in questions.schema.names:
        return None
    lists = [[tuple(v or ()) for v in questions.column(f"filter_{c}").to_pylist()] for c in FILTERS]
    return list(zip(*lists, *[questions.column(f"filter_{c}").to_pylist() for c in ("from", "to")], strict=True))


def _grouped(filters: list[tuple] | None, n: int) -> tuple[list[tuple], np.ndarray]:
    """The distinct filters, and which of them each of n questions has: questions with equal filters share one test of the rows."""
    known: dict = {}
    group = np.array([known.setdefault(f, len(known)) for f in filters or [None] * n], dtype=np.int64)
    return list(known) if filters else [], group


def _least(index: VectorIndex, questions: pa.RecordBatch, k: int) -> np.ndarray:
    """The k-th best similarity of each question among the rows of the sample that its filters admit (-inf: there are fewer)."""
    if index.sample.num_rows < k:
        return np.full(questions.num_rows, -np.inf)
    n = index.sample.num_rows
    best = Best(matrix(index.sample.column("cv").combine_chunks(), kind=None), np.arange(n), matrix(questions.column("qv")), k, index.metric)
    known, group = _grouped(_filters_of(questions), questions.num_rows)
    for g, mask in enumerate(row_masks(known, index.sample) if known else [None]):
        best.meet(np.arange(n) if mask is None else np.flatnonzero(mask), np.flatnonzero(group == g))
    return best.value[:, -1]


def _visits(index: VectorIndex, questions: pa.RecordBatch, k: int, probes: int | None, least: np.ndarray | None = None) -> np.ndarray:
    """(questions × cells) truth values: which cells each question must visit."""
    if np.isnan(index.radii).all():
        return np.zeros((questions.num_rows, len(index.centres)), bool)
    q = matrix(questions.column("qv"))
    if probes is not None:
        away = np.where(np.isnan(index.radii)[None, :], np.inf, _distances(points(q, index.metric), index.centres))
        order = np.argsort(away, axis=1, kind="stable")[:, :probes]
        out = np.zeros(away.shape, bool)
        np.put_along_axis(out, order, True, axis=1)
        return out & ~np.isinf(away)
    bound, least = best_inside(index, q), _least(index, questions, k) if least is None else least
    return (bound >= least[:, None] - SLACK) & (bound > -np.inf)


class Best:
    """The k best rows of each of some questions, as far as a shard's rows were seen: ``value`` and ``id``, best first, ties by id
    (``ids``: integers in the order of the ids).

    ``rows``: the vectors as stored, a row each; ``questions``: in double precision. Rows meet questions by number.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, questions: np.ndarray, k: int, metric: str):
        self.rows, self.ids, self.questions, self.k, self.metric = rows, ids, questions, k, metric
        self.value, self.id = np.full((len(questions), k), -np.inf), np.zeros((len(questions), k), np.int64)
        #: What orders a question's rows, for each of its k best, and the least that a candidate must reach (-inf: any row is one).
        self.key, self.least = np.full((len(questions), k), -np.inf), np.full(len(questions), -np.inf)
        single = metric == "cosine"
        self.norm, self.kind = np.empty(len(rows)), np.float32 if single else np.float64
        self.x = np.empty((len(rows), rows.shape[1] + (metric == "euclidean")), self.kind)
        with np.errstate(all="ignore"):
            for at in range(0, len(rows), 10_000):
                m = rows[at:at + 10_000].astype(np.float64)
                self.norm[at:at + 10_000] = np.sqrt((m * m).sum(1))
                self.x[at:at + 10_000] = self._screened(m, -(m * m).sum(1) / 2)
            self.q_norm = np.sqrt((questions * questions).sum(1))
            self.y = self._screened(questions, np.ones(len(questions))).astype(self.kind)
            # rounding of a product of two vectors of so many numbers, twice the bound
            away = (rows.shape[1] + 8) * (2.0**-23 if single else 2.0**-52)
            far = self.norm[np.isfinite(self.norm)].max(initial=0.0)
            self.slack = np.full(len(questions), away) if single else away * far * (self.q_norm + far)
        self.valid = ~np.isnan(self.y).any(1)
        # one place for all products, so that memory is touched once
        self.scores, self.hits = np.empty(TILE_QUESTIONS * TILE_ROWS, self.kind), np.empty(TILE_QUESTIONS * TILE_ROWS, bool)

    def _screened(self, m: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Vectors whose products order rows as the similarity does: c·q - |c|²/2 for the distance."""
        return points(m, self.metric) if self.metric != "euclidean" else np.column_stack([m, more])

    def meet(self, rows: np.ndarray, who: np.ndarray) -> None:
        """Some rows meet some questions."""
        who = who[self.valid[who]]
        x = self.x if len(rows) == len(self.x) else self.x[rows]
        for at in range(0, len(who), TILE_QUESTIONS):
            w = who[at:at + TILE_QUESTIONS]
            y, pending, held, low, merged = self.y[w], [], 0, 0, 0
            while low < len(rows):
                high = min(len(rows), low + min(TILE_ROWS, max(1_024, low)))  # short at first, while little is known of the k-th best
                s, hits = (place[:len(w) * (high - low)].reshape(len(w), -1) for place in (self.scores, self.hits))
                np.matmul(y, x[low:high].T, out=s)
                least = self.least[w]
                free = np.isneginf(least)
                if free.any() and high - low > self.k:
                    known = np.where(np.isnan(s[free]), -np.inf, s[free])
                    least[free] = np.partition(known, high - low - self.k, axis=1)[:, high - low - self.k] - self.slack[w[free]]
                hit = _true_places(np.greater_equal(s, (least - self.slack[w]).astype(self.kind)[:, None], out=hits))
                pending.append((rows[low + hit % (high - low)], w[hit // (high - low)]))
                held, low = held + len(hit), high
                if low >= 2 * merged or held > PAIRS or low == len(rows):
                    self._take(*map(np.concatenate, zip(*pending, strict=True)))
                    pending, held, merged = [], 0, low

    def _take(self, row: np.ndarray, who: np.ndarray) -> None:
        """Score pairs of candidates in double precision and keep each question's k best."""
        value, key = np.empty(len(row)), np.empty(len(row))
        with np.errstate(all="ignore"):
            for at in range(0, len(row), PAIRS):
                a, b = row[at:at + PAIRS], who[at:at + PAIRS]
                dot = np.einsum("ij,ij->i", self.rows[a].astype(np.float64), self.questions[b])
                if self.metric == "cosine":
                    value[at:at + PAIRS] = key[at:at + PAIRS] = dot / self.norm[a] / self.q_norm[b]
                elif self.metric == "dot":
                    value[at:at + PAIRS] = key[at:at + PAIRS] = dot
                else:
                    squared = self.norm[a] ** 2 + self.q_norm[b] ** 2 - 2.0 * dot
                    value[at:at + PAIRS] = 1.0 / (1.0 + np.sqrt(np.maximum(squared, 0.0)))
                    key[at:at + PAIRS] = dot - self.norm[a] ** 2 / 2
        kept = value > -np.inf  # no similarity: no candidate
        row, who, value, key = row[kept], who[kept], value[kept], key[kept]
        asked = np.unique(who)
        if not len(asked):
            return
        who = np.concatenate([who, np.repeat(asked, self.k)])
        ids = np.concatenate([self.ids[row], self.id[asked].ravel()])
        value, key = np.concatenate([value, self.value[asked].ravel()]), np.concatenate([key, self.key[asked].ravel()])
        order = np.lexsort((ids, -value, who))
        who = who[order]
        order = order[np.arange(len(who)) - np.searchsorted(who, who, side="left") < self.k]
        shape = (len(asked), self.k)
        self.value[asked], self.id[asked], self.key[asked] = value[order].reshape(shape), ids[order].reshape(shape), key[order].reshape(shape)
        self.least[asked] = np.maximum(self.least[asked], self.key[asked].min(1))


def _true_places(hit: np.ndarray) -> np.ndarray:
    """Places of the few true values, eight looked at as one."""
    flat = hit.reshape(-1)
    whole = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


def _copies(rows: np.ndarray, cells: np.ndarray, k: int) -> np.ndarray:
    """A number for each row that more than k rows of its cell equal, else -1."""
    out = np.full(len(rows), -1)
    words, key = np.ascontiguousarray(rows).view(np.uint32).reshape(len(rows), -1), np.empty(len(rows), np.uint64)
    weights = np.random.default_rng(1).integers(1, 2**63, words.shape[1], dtype=np.uint64)
    for at in range(0, len(rows), 10_000):
        key[at:at + 10_000] = (words[at:at + 10_000] * weights).sum(1, dtype=np.uint64)
    order = np.lexsort((key, cells))
    new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(cells[order]) != 0))
    run = np.cumsum(new) - 1
    often = np.bincount(run)[run] > k
    first = order[np.flatnonzero(new)][run]
    order, first, run = order[often], first[often], run[often]
    equal = (words[order] == words[first]).all(1)
    out[order[equal]] = run[equal]
    return out


def best_in_shard(questions: pa.Table, table: pa.Table, k: int, metric: str, exact: bool = True):
    """(question, id, similarity) of the k best rows of each question among those of the cells it visits, ties by id. Questions with
    equal filters meet the rows that these admit. Exact joins may look into more cells than a question names."""
    table = table.take(pa.compute.sort_indices(table.select(["cid"]), [("cid", "ascending")], null_placement="at_start"))
    rows, cells = matrix(table.column("cv").combine_chunks(), kind=None), table.column("cell").to_numpy()
    order = np.argsort(cells, kind="stable")
    rows, cells = rows[order], cells[order]
    best = Best(rows, order, matrix(questions.column("qv").combine_chunks()), k, metric)
    if "least" in questions.schema.names and metric != "euclidean":  # elsewhere the bound is of another scale than the key
        best.least = questions.column("least").to_numpy() - SLACK * (1 + np.abs(questions.column("least").to_numpy()))
    copies = _copies(rows, cells, k)
    known, group = _grouped(_filters_of(questions), questions.num_rows)
    lists = questions.column("cells").combine_chunks()
    asker, asked = pa.compute.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
    by = np.lexsort((asked, group[asker]))
    asker, asked = asker[by], asked[by]
    bounds = np.searchsorted(group[asker], np.arange(len(known) + 2))

    def met(g: int, at: np.ndarray) -> None:
        # of rows with one vector only the k of the smallest ids can be among the k best
        often = np.flatnonzero(copies[at] >= 0)
        often = often[np.argsort(copies[at[often]], kind="stable")]
        run = copies[at[often]]
        at = np.delete(at, often[np.arange(len(run)) - np.searchsorted(run, run, side="left") >= k])
        near, who_of, everyone = asked[bounds[g]:bounds[g + 1]], asker[bounds[g]:bounds[g + 1]], np.flatnonzero(group == g)
        together = []
        for cell, first, n in zip(*np.unique(cells[at], return_index=True, return_counts=True), strict=True):
            who = who_of[np.searchsorted(near, cell, "left"):np.searchsorted(near, cell, "right")]
            if len(who) == len(everyone) or exact and len(who) >= MOST_VISIT * len(everyone):
                together.append(at[first:first + n])
            elif len(who):
                best.meet(at[first:first + n], who)
        if together:
            best.meet(np.concatenate(together), everyone)

    if not known:
        met(0, np.arange(len(rows)))
    step = max(1, MASKS // len(rows))
    for g in range(0, len(known), step):
        for n, mask in enumerate(row_masks(known[g:g + step], table)):
            met(g + n, np.arange(len(rows)) if mask is None else np.flatnonzero(mask[order]))
    who, place = np.nonzero(best.value > -np.inf)
    return [questions.column("qid").take(pa.array(who)), table.column("cid").take(pa.array(best.id[who, place])), pa.array(best.value[who, place])]


def merge(partial: DataFrame, k: int) -> DataFrame:
    """Best k per question from the shards' bests; a task holds at most k rows of a question for each shard."""
    order = [F.desc("similarity"), F.col("cid")]
    return partial.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k).select("qid", "cid", "similarity", "rank")


def index_join(questions: DataFrame, index: VectorIndex, k: int, probes: int | None = None, question_rows: int = QUESTION_ROWS) -> DataFrame:
    """(qid, cid, similarity, rank): the k best rows of the index for each question (qid, qv, filter columns).

    With ``probes`` only so many nearest cells are visited; without, all that can hold one of the k best.
    """
    spark = questions.sparkSession
    q = questions.where("qv is not null")
    blocks = max(1, math.ceil(q.count() / question_rows))
    n_shards = int(index.shards.max()) + 1
    grouped = 1 if blocks == 1 else max(1, n_shards // max(math.ceil(MEETINGS / blocks), math.ceil(index.rows / SHARD_ROWS)))
    n_shards = math.ceil(n_shards / grouped)
    shared = spark.sparkContext.broadcast(VectorIndex(None, index.metric, index.centres, index.radii, index.parts, index.shards // grouped, index.sample, index.rows))
    schema = T.StructType([*q.schema.fields, T.StructField("least", T.DoubleType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def visit(batches):
        known = shared.value
        first, n_cells = np.cumsum(known.parts) - known.parts, len(known.centres)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_048):
                batch = whole.slice(at, 2_048)
                # approximate joins may not visit the sample's rows, so nothing follows from these
                least = np.full(batch.num_rows, -np.inf) if probes is not None else _least(known, batch, k)
                row, cell = np.nonzero(_visits(known, batch, k, probes, least))
                batch = batch.append_column("least", pa.array(least))
                n = known.parts[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                part = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
                visited = np.unique((row * n_shards + known.shards[first[cell] + part]) * n_cells + cell)
                met, at_cell = visited // n_cells, pa.array((visited % n_cells).astype(np.int32))
                met, starts = np.unique(met, return_index=True)
                cells = pa.ListArray.from_arrays(pa.array(np.append(starts, len(visited)).astype(np.int32)), at_cell)
                for low in range(0, len(met), 20_000):
                    taken = batch.take(pa.array(met[low:low + 20_000] // n_shards))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array((met[low:low + 20_000] % n_shards).astype(np.int32)), cells.slice(low, 20_000)],
                                                     schema=pa.schema([*taken.schema, ("shard", pa.int32()), ("cells", cells.type)]))

    visits, table, keys = q.mapInArrow(visit, schema), index.table, ["shard"]
    if blocks > 1:  # too many questions for one task: blocks of them, each of which meets the whole shard
        visits = visits.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        table = table.withColumn("shard", F.floor(F.col("shard") / grouped).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = [*keys, "block"]
        # by number, so that tasks which hold little but compute much are not put together
        visits, table = (d.repartition(4 * n_shards * blocks, *keys) for d in (visits, table))
    metric = index.metric

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = best_in_shard(left, right, k, metric, probes is None) if left.num_rows and right.num_rows else [[], [], []]
        return pa.table(found, schema=pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("similarity", pa.float64())]))

    return merge(visits.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInArrow(meet, "qid bigint, cid bigint, similarity double"), k)
