"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import (
    decontamination, divergence, exact_dedup, jaccard_join, language_id, language_model, license_scan, line_dedup, quality, resampling, sentencepiece,
    substring_dedup, token_counts)
from broadsheet.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public tokenizer files are; operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def id_remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op1_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     w AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
     p AS (SELECT doc_id, i, k, ls[i:i + k - 1] AS run FROM (SELECT doc_id, ls, k, unnest(range(1, len(ls) - k + 2)) AS i FROM d, (VALUES (1), (2), (3)) AS t(k))),
     r AS (SELECT doc_id, i, k, run, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS later FROM p),
     g AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i, true AS gone FROM r
           WHERE later AND (k = 3 OR len(regexp_extract_all(array_to_string(run, ' '), '[^\x20\x09-\x0D]+')) >= 20)),
     k AS (SELECT doc_id, count(gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL) AS kept FROM w LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ls) AS n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN k USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_repeated_lines(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("detections")


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), F.coalesce(id_remainder(4) == 2, F.lit(False))
    weights = quality.fit(docs, labels(spark, sf_dir), where=~held_out)
    return quality.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     w AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
     s AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1 AS gone FROM s),
     c AS (SELECT doc_id, i, word, coalesce(bool_or(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
           FROM w LEFT JOIN r USING (doc_id, i)),
     k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), F.coalesce(id_remainder(3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op7_language_model")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_remainder(10) == 0, F.lit(False))
    rows = language_model.fit_score(documents(spark, sf_dir), train=~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_exact_dedup", """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


@query("op9_jaccard_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
           UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
     r AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digests(sentencepiece.encode_decode(documents(spark, sf_dir), tokenizer_path()))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.within_budget(token_counts.prefix_table(documents(spark, sf_dir), tokenizer_path()), 4096)


@query("op12_source_divergence", r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term, rn
           FROM (SELECT *, row_number() OVER () AS rn FROM documents)),
     k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT rn) >= 3),
     c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
     v AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY lang),
     t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
     g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v, coalesce(lt, 0)::HUGEINT AS lt
           FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) LEFT JOIN t USING (lang, source) LEFT JOIN v USING (lang)),
     p AS (SELECT lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
                  1 + (1000000000::HUGEINT * (k.ln + 1)) // (g.lt + g.v) AS q
           FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
     s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
           UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 200""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


@query("op13_importance_resampling", r"""
WITH t256 AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
     x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
     b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
     d AS (SELECT word, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM (SELECT unnest(ws) AS word, 0 AS side FROM x UNION ALL SELECT unnest(ws), 1 FROM b) GROUP BY word),
     h AS (SELECT word, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i::INT + 1, 2))::BIGINT)),
                  lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d, t256),
     u AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM h GROUP BY bucket),
     g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM u) + 10000) / ((s + 1) * ((SELECT sum(t) FROM u) + 10000))))::BIGINT AS gain FROM u),
     f AS (SELECT word, gain FROM h JOIN g USING (bucket)),
     w AS (SELECT rn, sum(gain)::BIGINT AS weight FROM (SELECT rn, unnest(ws) AS word FROM (SELECT ws, row_number() OVER () AS rn FROM x)) JOIN f USING (word) GROUP BY rn),
     y AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM (SELECT *, row_number() OVER () AS rn FROM x) LEFT JOIN w USING (rn)),
     z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM y WHERE n_features >= 20) // 100 THEN place END AS rank FROM z""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), benchmark(spark, sf_dir))
