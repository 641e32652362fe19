"""Near duplicates by an n-gram Jaccard join over a count-vector R-tree.

A text's set is its distinct word shingles. Equal sets are one class. Shingles are hashed into groups, and the counts of
a set's shingles in each group are its point: two sets share at most the sum of the coordinates' minima, so a node of an
R-tree whose largest coordinates share too little with a point holds none of its partners.

Sets whose Jaccard similarity reaches the threshold share one of their first shingles (one more than they may lose) in
any order that all texts agree on; here very frequent shingles come last, so a bucket, that is the classes with one such
shingle, is small unless they are alike. In each bucket:

1. all classes are compared with one of them, the pivot: as many pairs as classes. The bound on the counts goes first,
   the sets' exact intersection decides. In a group of near copies that already links nearly all.
2. Where classes of a bucket are still in different components, their points go into an R-tree, and only pairs across
   components that the tree leaves are verified. Large buckets are cut into a grid of blocks.

No pair that could link is left out, and pairs within a component are not made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import map_batches, mix, narrow, stage, window_hashes
from broadsheet.llm.components import components
from broadsheet.llm.tokens import SPACE, within, words

SHINGLE = 5
#: Similarity from which on sets link: intersection * DEN >= NUM * union.
NUM, DEN = 80, 100
#: Groups of shingles, that is coordinates of a point. More of them bound the overlap closer: of the pairs that the
#: bound on 64 groups leaves, that on 512 leaves a twentieth.
GROUPS = 512
#: Coordinates of the tree's nodes, each the sum of neighbouring groups; points that are left are compared in full.
COARSE = 64
#: Share of the classes from which on a shingle is frequent. At most 2 / FREQUENT times the mean set size are.
FREQUENT = 1 / 2000
#: Shingles counted together before the frequent ones among them are sent.
SEGMENT = 4_000_000
#: Classes of a bucket that one task compares; larger buckets are cut into pairs of blocks.
BLOCK = 1000
FANOUT = 16
#: Open buckets of a class, the smallest tokens first, that go along with it, so that a pair is made in one bucket only.
KNOWN_BUCKETS = 32
#: Bits of the map of the texts whose sets are needed for verification.
MAP_BITS = 1 << 24
LAST = 2**63 - 1


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first, shingle): distinct shingle hashes of each text in order, and where each text's start."""
    w = words(column, SPACE, lower=True)
    n_docs = len(w.first) - 1
    grams = window_hashes(w.hash, SHINGLE)
    ok = within(w, SHINGLE, len(grams))
    doc, h = w.doc[:len(grams)][ok], grams[ok]
    counts = w.counts()
    short_doc, short_hash = [], []
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = w.hash[w.first[i]:w.first[i + 1]]
        short_doc.append(i)
        short_hash.append(mix(window_hashes(own, len(own)), np.array([len(own)], np.uint64))[0])
    if short_doc:
        doc, h = np.append(doc, short_doc), np.append(h, np.array(short_hash, np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(n_docs + 1)), h


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def class_ids(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One hash of each set, whatever its order."""
    a = sums(mix(h, np.full(len(h), 3, np.uint64)), first)
    b = sums(mix(h, np.full(len(h), 5, np.uint64)), first)
    return mix(mix(a, b), np.diff(first).astype(np.uint64)).view(np.int64)


def points(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Each set's counts by group of its shingles."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    group = (h >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64)
    return np.bincount(doc * GROUPS + group, minlength=n * GROUPS).reshape(n, GROUPS)


def packed(points_: np.ndarray) -> list[bytes]:
    return [(p.astype(np.uint8) if p.max() < 256 else p.astype(np.uint32)).tobytes() for p in points_]


def unpacked(bodies: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(b, np.uint8 if len(b) == GROUPS else np.uint32) for b in bodies], np.int32).reshape(-1, GROUPS)


def coarse(point: np.ndarray) -> np.ndarray:
    return point.reshape(len(point), COARSE, -1).sum(axis=2)


def bound(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sum of the coordinates' minima of a[i] and b[j], a slice at a time."""
    step = max(1, 4_000_000 // max(1, a.shape[1]))
    parts_ = [np.minimum(a[i[k:k + step]], b[j[k:k + step]]).sum(axis=1) for k in range(0, len(i), step)]
    return np.concatenate(parts_) if parts_ else np.empty(0, np.int64)


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """shared / (a + b - shared) >= NUM / DEN, for the size of the intersection or a bound on it."""
    return (DEN + NUM) * shared >= NUM * (a + b)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of n must be looked at: a partner shares at least NUM / DEN of n."""
    return n - -(-n * NUM // DEN) + 1


class Tree:
    """An R-tree over points, bulk-loaded in the order of set size; each node has the largest (coarse) coordinates and
    the smallest size below it."""

    def __init__(self, point: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((point.argmax(axis=1), size))
        self.point, self.size = point, size
        self.levels = [(coarse(point)[self.order], size[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            p, s = self.levels[-1]
            at = np.arange(0, len(p), FANOUT)
            self.levels.append((np.maximum.reduceat(p, at, axis=0), np.minimum.reduceat(s, at)))

    def partners(self, point: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all points whose bound lets them link with a query."""
        rough = coarse(point)
        q = np.repeat(np.arange(len(point)), len(self.levels[-1][0]))
        node = np.tile(np.arange(len(self.levels[-1][0])), len(point))
        for level in range(len(self.levels) - 1, -1, -1):
            p, s = self.levels[level]
            good = linked(bound(rough, q, p, node), size[q], s[node])
            q, node = q[good], node[good]
            if level:
                below = len(self.levels[level - 1][0])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                q, node = q[node < below], node[node < below]
        at = self.order[node]
        good = linked(bound(point, q, self.point, at), size[q], self.size[at])
        return q[good], at[good]


ROW = "kind int, ord bigint, row_hash bigint, cls bigint, n bigint, point binary, token bigint"


def _survey(rows: DataFrame) -> DataFrame:
    """Kind 0: each row's class, set size and point. Kind 1: shingles that are frequent in a segment of texts, with in how
    many of its texts they occur (as ``n``)."""
    def build():
        held, texts = [], 0

        def frequent():
            nonlocal held, texts
            if held:
                token, df = np.unique(np.concatenate(held), return_counts=True)
                often = df >= max(3, texts * FREQUENT / 2)
                token, df = token[often], df[often]
                n = len(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *[pa.nulls(n, pa.int64())] * 3, pa.array(df.astype(np.int64)), pa.nulls(n, pa.binary()),
                                                  pa.array(token.view(np.int64))], names=["kind", "ord", "row_hash", "cls", "n", "point", "token"])
            held, texts = [], 0

        def work(batch):
            nonlocal texts
            first, h = shingles(batch.column(2))
            size = np.diff(first)
            held.append(h)
            texts += len(size)
            n = len(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.array(class_ids(first, h)), pa.array(size.astype(np.int64)),
                                              pa.array(packed(points(first, h)), pa.binary()), pa.nulls(n, pa.int64())],
                                             names=["kind", "ord", "row_hash", "cls", "n", "point", "token"])
            if sum(map(len, held)) > SEGMENT:
                yield from frequent()

        work.finish = frequent
        return work

    return map_batches(rows, build, ROW)


def _prefixes(rows: DataFrame, frequent: list[tuple[int, int]]) -> DataFrame:
    """(token, cls, n): the first shingles of every set, frequent ones last, the more so the more frequent."""
    table = np.array(sorted(frequent), np.int64).reshape(-1, 2)
    sent = rows.sparkSession.sparkContext.broadcast((table[:, 0], table[:, 1]))

    def build():
        token, often = sent.value

        def work(batch):
            first, h = shingles(batch.column(2))
            if not len(h):
                return None
            size = np.diff(first)
            doc = np.repeat(np.arange(len(size)), size)
            t = h.view(np.int64)
            rank = np.zeros(len(h), np.int64)
            if len(token):
                at = np.minimum(np.searchsorted(token, t), len(token) - 1)
                rank = np.where(token[at] == t, often[at], 0)
            order = np.lexsort((h, rank, doc))
            place = np.arange(len(h)) - first[doc]
            keep = order[place < prefix_size(size)[doc]]
            cls = class_ids(first, h)
            return pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(cls[doc[keep]]), pa.array(size[doc[keep]].astype(np.int64))], names=["token", "cls", "n"])

        return work

    return map_batches(rows, build, "token bigint, cls bigint, n bigint")


def _needed_sets(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(cls, body): the sorted shingles of the texts ``needed`` (ord, row_hash, cls). A bitmap of bounded size tells which
    texts may be needed, so that sets of others are not made; the join decides."""
    bit = F.pmod("row_hash", F.lit(MAP_BITS)).cast("int")

    def pack(table):
        bits = np.zeros(1 << 15, bool)
        bits[np.asarray(table.column("bit").combine_chunks()) & 0x7FFF] = True
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    packed_ = needed.select(bit.alias("bit")).distinct().withColumn("part", F.shiftright("bit", 15)).groupBy("part").applyInArrow(pack, "part int, bits binary")
    whole = np.zeros(MAP_BITS // 8, np.uint8)
    for r in packed_.collect():  # MAP_BITS / 32768 rows of 4 KB at most
        whole[r["part"] << 12:(r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(whole)

    def build():
        def work(batch):
            place = np.asarray(batch.column(1)) % MAP_BITS  # never negative, as pmod
            some = np.flatnonzero(sent.value[place >> 3] >> (7 - (place & 7)) & 1)
            if not len(some):
                return None
            batch = batch.take(pa.array(some))
            first, h = shingles(batch.column(2))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                                              names=["ord", "row_hash", "body"])

        return work

    made = map_batches(rows, build, "ord bigint, row_hash bigint, body binary")
    return made.join(needed, ["ord", "row_hash"]).dropDuplicates(["cls"]).select("cls", "body")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes whose sets really are that similar."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct().join(classes, "cls").select("ord", "row_hash", "cls")
    sets = stage(_needed_sets(rows, needed), "sets")
    both = (pairs.join(sets.withColumnsRenamed({"cls": "u", "body": "left"}), "u").join(sets.withColumnsRenamed({"cls": "v", "body": "right"}), "v")
            .select("u", "v", "left", "right"))

    def work(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                together = np.concatenate([x, y])
                together.sort()
                shared = int((together[1:] == together[:-1]).sum())
                good[i] = linked(shared, len(x), len(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

    return both.mapInArrow(work, "u bigint, v bigint")


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that the bound on their counts leaves."""
    p = classes.select("cls", "n", "point")
    both = (pairs.join(p.withColumnsRenamed({"cls": "u", "n": "n_u", "point": "p_u"}), "u").join(p.withColumnsRenamed({"cls": "v", "n": "n_v", "point": "p_v"}), "v"))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (unpacked(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("p_u", "p_v"))
                a, b = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("n_u", "n_v"))
                good = linked(np.minimum(x, y).sum(axis=1), a, b)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("u", "v")], names=["u", "v"]).filter(pa.array(good))

    return both.mapInArrow(work, "u bigint, v bigint")


def _across(buckets: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of one bucket and different components that the R-tree leaves; the pivot's pairs are known already.

    A pair that shares many buckets is left to the first of them: each row carries the first of its class's open buckets,
    and a bucket skips pairs whose lists have a smaller bucket in common."""
    rows = (buckets.where("cls <> pivot").join(labels, F.col("cls") == F.col("node"), "left")
            .select("token", "cls", "n", F.coalesce("root", "cls").alias("root")))
    # buckets with the same classes are compared once
    open_ = (rows.groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("cls") % 1_000_000_007).alias("mark"))
             .where("low <> high").groupBy("m", "low", "high", "mark").agg(F.min("token").alias("token")).select("token", "m"))
    rows = rows.join(open_, "token")
    known = rows.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("token")), 1, KNOWN_BUCKETS).alias("known"))  # of its first shingles
    rows = rows.join(known, "cls").join(classes.select("cls", "point"), "cls")
    cuts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), cuts).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    rows = rows.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cls", "n", "root", "known", "point")

    def compare(table):
        own, cls, n, root = (np.asarray(table.column(c).combine_chunks()) for c in ("own", "cls", "n", "root"))
        point = unpacked(table.column("point").to_pylist())
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(left) and len(right):
            q, at = Tree(point[right], n[right]).partners(point[left], n[left])
            q, at = left[q], right[at]
            good = (root[q] != root[at]) & ((cls[q] < cls[at]) if a == b else True)
            q, at = q[good], at[good]
            token = table.column("token")[0].as_py()
            known = [{t for t in x if t < token} for x in table.column("known").to_pylist()]
            here = np.array([known[i].isdisjoint(known[j]) for i, j in zip(q.tolist(), at.tolist(), strict=True)], bool)
            u, v = np.maximum(cls[q], cls[at])[here], np.minimum(cls[q], cls[at])[here]
        return pa.table([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.groupBy("token", "a", "b").applyInArrow(compare, "u bigint, v bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles (size of its set), component_id (smallest id of all rows that
    links lead to, the row's own included), row_hash (of id and text) and stays (true for the component's first row by id
    and row_hash; rows that share both are one).

    Sets hold the distinct 5-word shingles of the text with A-Z lower-cased; a shorter text's whole word sequence is its
    one shingle. Texts without words have an empty set, link with nothing and are their own component. Null ids come
    last: a component has one (null) only if none of its rows has an id. An empty table gives none.
    """
    rows = narrow(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    survey = stage(_survey(rows), "survey")
    sizes = survey.where("kind = 0").select("ord", "row_hash", "cls", "n", "point")
    classes = stage(sizes.where("n > 0").groupBy("cls").agg(F.min(F.struct("ord", "row_hash", "n", "point")).alias("r"))
                    .select("cls", "r.ord", "r.row_hash", "r.n", "r.point"), "classes")
    often = survey.where("kind = 1").groupBy("token").agg(F.sum("n").alias("df")).where(F.col("df") >= F.lit(sizes.count() * FREQUENT / 2))
    frequent = [(r["token"], r["df"]) for r in often.collect()]  # 2 / FREQUENT times the mean set size at most

    prefixes = _prefixes(rows, frequent)
    pivots = prefixes.groupBy("token").agg(F.min("cls").alias("pivot"), F.max("cls").alias("most")).where("pivot <> most").select("token", "pivot")
    buckets = stage(prefixes.join(pivots, "token").select("token", "cls", "n", "pivot").distinct(), "buckets")
    stars = buckets.where("cls <> pivot").select(F.greatest("cls", "pivot").alias("u"), F.least("cls", "pivot").alias("v")).distinct()
    links = stage(_verified(stage(_bounded(stars, classes), "stars"), rows, classes), "links")
    labels = stage(components(links), "labels")
    more = stage(_across(buckets, labels, classes), "across")
    if more.limit(1).count():
        links = links.unionByName(stage(_verified(more, rows, classes), "links"))
        labels = stage(components(links), "labels")

    known = (classes.select("cls", "ord", F.col("row_hash").alias("first_hash")).join(labels, F.col("cls") == F.col("node"), "left")
             .select("cls", "ord", "first_hash", F.coalesce("root", "cls").alias("root")))
    least = known.groupBy("root").agg(F.min(F.struct("ord", "first_hash")).alias("r")).select("root", F.col("r.ord").alias("component"), F.col("r.first_hash").alias("head"))
    found = known.join(least, "root").select("cls", "component", "head")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("ord"))
    null_last = lambda c: F.when(c != LAST, c)
    stays = (F.col("n") == 0) | ((F.col("ord") == F.col("component")) & (F.col("row_hash") == F.col("head")))
    return sizes.join(found, "cls", "left").select(null_last(F.col("ord")).alias("doc_id"), F.col("n").alias("n_shingles"), null_last(own).alias("component_id"), "row_hash",
                                                   stays.alias("stays"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each component: the first by id. Rows without words all stay."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    gone = stage(near_groups(docs, id_col, text_col).where(~F.col("stays")).select("doc_id", "row_hash").distinct(), "gone")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("bigint").alias("key"), text.alias("text"))
    rows = rows.select("row", "key", F.xxhash64("key", "text").alias("hash"))
    gone = gone.hint("shuffle_hash")
    return rows.join(gone, rows["key"].eqNullSafe(gone["doc_id"]) & (rows["hash"] == gone["row_hash"]), "left_anti").select("row.*")
