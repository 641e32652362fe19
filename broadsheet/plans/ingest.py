"""One ingestion batch, end to end: pages → articles → tags → vectors → new rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.dims import Dim
from broadsheet.operators.identity import STORE_KEY, assign_article_id, insert_new
from broadsheet.operators.search import embed
from broadsheet.operators.stats import ingest_report
from broadsheet.operators.tagging import categorize
from broadsheet.session import materialize
from broadsheet.sources.html import PageRules, extract_articles


@dataclass(frozen=True)
class IngestConfig:
    """Dimensions and settings of an ingestion. ``encoder`` None uses the bundled hashing encoder."""

    rules: dict[str, PageRules] | PageRules
    gaz: Dim
    lexicon: Dim
    speech: tuple = ()
    stance: tuple = ()
    source: str | None = None
    start: str | None = None
    end: str | None = None
    encoder: object = None
    dim: int = 384
    mode: str = "word"


def tag_articles(articles: DataFrame, config: IngestConfig) -> DataFrame:
    """Ids, tags and vectors of extracted articles. Narrow: no shuffle."""
    tagged = categorize(assign_article_id(articles), config.gaz, config.lexicon, list(config.speech) or None, list(config.stance) or None, config.mode)
    return embed(tagged, config.encoder, config.dim)


def prepare_batch(pages: DataFrame, config: IngestConfig) -> DataFrame:
    """Article rows of a batch of pages, tagged and embedded. Narrow: no shuffle."""
    return tag_articles(extract_articles(pages, config.rules, source=config.source, start=config.start, end=config.end), config)


def ingest_batch(pages: DataFrame, store: DataFrame | None, config: IngestConfig) -> DataFrame:
    """I01. The rows to append to the store. The prepared batch is staged once, so that pages are parsed and
    texts embedded once however often the next steps read them."""
    batch = materialize(prepare_batch(pages, config), "batch")
    known = store if store is not None else batch.where(F.lit(False))
    return insert_new(known.select(*[c for c in ("url", STORE_KEY) if c in known.columns]), batch)


def batch_report(pages_articles: DataFrame, stored: DataFrame) -> DataFrame:
    """A25 of a batch."""
    return ingest_report(pages_articles, stored)
