"""Patterns of clusters: evenly spaced samples, common slices, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ParserConfig
from ..functions.templates import render
from ..functions.tokens import of_kinds, slices
from ..plans.ranking import numbered
from ..plans.tables import sent, stored


def is_sampled(position: Column, n: Column, sample: float) -> Column:
    """Whether a position of 0..n-1 is one of ceil(n * sample) evenly spaced ones, the first and the last among them."""
    k = F.ceil(n * F.lit(float(sample)))
    step = (n - 1).cast("double") / (k - 1)
    near = F.floor(position / step)
    hits = lambda i: (i >= 0) & (i < k) & (F.floor(i * step + 0.5) == position)
    some = hits(near - 1) | hits(near) | hits(near + 1)
    return F.when((n <= 1) | (k >= n), True).when(k == 1, position == 0).otherwise(some)


def pattern_shapes(assigned: DataFrame, messages: DataFrame, sample: float) -> DataFrame:
    """The shapes that patterns are made from, those of sampled messages: positions count messages (idx, cluster_id, and
    first of their shape) in order of idx. A position is a number in the order of clusters and idx, less the first of
    its cluster, so that no cluster is sorted in one task."""
    if sample >= 1:
        return assigned
    each = numbered(messages.select("cluster_id", "idx", "first"), [F.col("cluster_id"), F.col("idx")], "_i")
    of = stored(each.groupBy("cluster_id").agg(F.min("_i").alias("_first"), F.count("*").alias("_n")), "sizes")
    placed = each.join(sent(of, F.lit(64)), "cluster_id").withColumn("_p", F.col("_i") - F.col("_first"))
    chosen = placed.where(is_sampled(F.col("_p"), F.col("_n"), sample)).select("first").distinct()
    return assigned.join(chosen, "first", "left_semi")


def common_slices(lines: DataFrame, config: ParserConfig) -> DataFrame:
    """cluster_id and common: the slices that stand as literal candidates in every line of the cluster."""
    found = lines.select("cluster_id", slices(of_kinds(F.col("rich"), config.common_kinds)).alias("s"))
    n = found.groupBy("cluster_id").agg(F.count("*").alias("n"))
    held = found.select("cluster_id", F.explode("s").alias("slice")).groupBy("cluster_id", "slice").agg(F.count("*").alias("k"))
    every = held.join(n, "cluster_id").where("k = n").groupBy("cluster_id").agg(F.sort_array(F.collect_list("slice")).alias("common"))
    return n.select("cluster_id").join(every, "cluster_id", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))


def cluster_templates(lines: DataFrame, common: DataFrame) -> DataFrame:
    """cluster_id and templates: the distinct renderings of its lines, sorted by bytes."""
    shown = lines.join(common, "cluster_id").select("cluster_id", render(F.col("rich.slice"), F.col("common")).alias("template")).distinct()
    return shown.groupBy("cluster_id").agg(F.sort_array(F.collect_list("template")).alias("templates"))
