"""Streams: lines matched against trained templates, and batches parsed each on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ParserConfig
from ..operators.matcher import TemplateMatcher
from ..plans.parser import LogParser, ParseResult


def match_stream(stream: DataFrame, matcher: TemplateMatcher) -> DataFrame:
    """``stream`` (with a column msg) with template_id, -1 where none matches: no state, so rows come out as they come
    in. Each batch is looked up in the templates' index, however many there are."""
    return stream.withColumn("template_id", matcher.lookup()(F.col("msg")))


def parse_batches(stream: DataFrame, config: ParserConfig, use: Callable[[ParseResult, int], None], **options: str):
    """Starts a query that parses each micro-batch (idx, msg) as a corpus of its own: more lines change counts, so
    clusters of one batch say nothing of another's. What a batch's result wrote is deleted after ``use``."""

    def run(df: DataFrame, n: int) -> None:
        found = LogParser(config).parse(df, "msg", "idx")
        use(found, n)
        found.release()

    return stream.writeStream.options(**options).foreachBatch(run).start()
