"""Counts over a corpus: distinct lines, tokens, pairs of tokens, and which token depends on which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ParserConfig
from ..functions.tokens import of_kinds, of_shape, shape_of, slices, tokenize


def distinct_lines(messages: DataFrame) -> DataFrame:
    """msg, w (how often it stands) and first (its least idx); null messages are left out."""
    return messages.where("msg is not null").groupBy("msg").agg(F.count("*").alias("w"), F.min("idx").alias("first"))


def shapes(messages: DataFrame, config: ParserConfig) -> DataFrame:
    """The distinct shapes of messages, counted where the messages lie: shape, w (how many messages have it), first (the
    least idx of these), and tokens and kept as of a line."""
    found = messages.where("msg is not null").select("idx", shape_of(F.col("msg"), config).alias("shape")).groupBy("shape").agg(F.count("*").alias("w"), F.min("idx").alias("first"))
    return _with_kept(found.withColumn("tokens", of_shape(F.col("shape"), config.symbols)), config)


def _with_kept(lines: DataFrame, config: ParserConfig) -> DataFrame:
    return lines.withColumn("kept", F.sort_array(slices(of_kinds(F.col("tokens"), config.kept_kinds))))


def tokenized(lines: DataFrame, config: ParserConfig) -> DataFrame:
    """``lines`` with tokens, and kept: the distinct slices that count, sorted."""
    return _with_kept(lines.withColumn("tokens", tokenize(F.col("msg"), config)), config)


def occurrences(lines: DataFrame) -> DataFrame:
    """slice and occ: in how many lines, repeats counted, it stands as a token that counts."""
    return lines.select("w", F.explode("kept").alias("slice")).groupBy("slice").agg(F.sum("w").alias("occ"))


def _pairs(df: DataFrame, column: str, *others: str) -> DataFrame:
    """All pairs a < b of a sorted array, made row by row, so that memory follows the array's length."""
    first = df.select(*others, F.posexplode(column).alias("_i", "a"), F.col(column).alias("_all"))
    return first.select(*others, "a", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("b"))


def co_occurrences(lines: DataFrame) -> DataFrame:
    """a < b and co: in how many lines, repeats counted, both stand. Counts are combined before the shuffle."""
    return _pairs(lines, "kept", "w").groupBy("a", "b").agg(F.sum("w").alias("co"))


def dependencies(lines: DataFrame, threshold: float) -> DataFrame:
    """Pairs of which one depends on the other: ab (a on b) if both stand together in more than ``threshold`` of the
    lines of a, and ba likewise. Pairs without either are dropped before any line is joined with them."""
    occ = occurrences(lines)
    found = co_occurrences(lines)
    found = found.join(occ.select(F.col("slice").alias("a"), F.col("occ").alias("occ_a")), "a").join(occ.select(F.col("slice").alias("b"), F.col("occ").alias("occ_b")), "b")
    depends = lambda occ: F.col("co").cast("double") > F.col(occ) * F.lit(float(threshold))
    return found.select("a", "b", "co", "occ_a", "occ_b", depends("occ_a").alias("ab"), depends("occ_b").alias("ba")).where("ab or ba")
