"""Parsing a table of messages: clusters, templates, masks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RICH_SYMBOLS, ParserConfig
from ..functions.templates import mask, render
from ..functions.tokens import of_shape, rich_slices, shape_of, tokenize
from ..operators.anchors import with_anchors
from ..operators.patterns import cluster_templates, common_slices, pattern_shapes
from ..operators.stats import distinct_lines, shapes
from .ranking import numbered
from .tables import bytes_of, release, sent, stored


@dataclass
class ParseResult:
    """What parsing gives; each table is made when it is asked for, and nothing that isn't. All but the masks follows from
    the shapes of lines, of which there are far fewer; messages meet them by their shape."""

    messages: DataFrame
    config: ParserConfig
    sent: list[DataFrame] = field(default_factory=list, init=False, repr=False)

    @cached_property
    def shapes(self) -> DataFrame:
        """The distinct shapes with anchors: shape, w, first, tokens, anchors. Written once."""
        lines = stored(shapes(self.messages, self.config), "shapes")
        found = stored(with_anchors(lines, self.config).select("shape", "w", "first", "tokens", "anchors"), "anchors")
        release(lines)
        return found

    def release(self) -> None:
        """Deletes what was written for this result, whose tables can't be read after that."""
        for name in ("shapes", "rich", "common"):
            if name in self.__dict__:
                release(self.__dict__.pop(name))
        while self.sent:
            release(self.sent.pop())

    def with_shapes(self, lines: DataFrame, known: DataFrame, how: str = "left") -> DataFrame:
        """``lines`` (with a column msg) with what is known of their shapes. Where the bytes of the shapes allow, lines don't
        move to them."""
        self.sent.append(stored(known, "known"))
        known = sent(self.sent[-1], bytes_of(F.col("shape")) * 4)
        return lines.withColumn("shape", shape_of(F.col("msg"), self.config)).join(known, "shape", how).drop("shape")

    @cached_property
    def lines(self) -> DataFrame:
        """The distinct lines: msg, w, first, tokens, anchors."""
        found = self.with_shapes(distinct_lines(self.messages), self.shapes.select("shape", "anchors"), "inner")
        return found.select("msg", "w", "first", tokenize(F.col("msg"), self.config).alias("tokens"), "anchors")

    @cached_property
    def assigned(self) -> DataFrame:
        """The clustered shapes: shape, first, anchors, cluster_id. Clusters are numbered by their sorted anchors."""
        found = self.shapes.where(F.size("anchors") > 0).select("shape", "first", "anchors")
        keys = numbered(found.select("anchors").distinct(), [F.col("anchors")], "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("int"))
        # A cluster may hold most shapes: where the keys' bytes allow, shapes don't move to them.
        return found.join(sent(keys, bytes_of(F.col("anchors"))), "anchors")

    @cached_property
    def rich(self) -> DataFrame:
        """The clustered shapes with rich tokens, all punctuation as symbols: shape, first, cluster_id, rich. Written once."""
        return stored(self.assigned.select("shape", "first", "cluster_id", of_shape(F.col("shape"), RICH_SYMBOLS).alias("rich")), "rich")

    @cached_property
    def chosen(self) -> DataFrame:
        """The shapes that patterns are made from."""
        if self.config.pattern_sample >= 1:
            return self.rich
        return pattern_shapes(self.rich, self.with_shapes(self.messages, self.rich.select("shape", "cluster_id", "first"), "inner"), self.config.pattern_sample)

    @cached_property
    def common(self) -> DataFrame:
        """cluster_id and common: what every line that patterns are made from has."""
        return stored(common_slices(self.chosen, self.config), "common")

    @cached_property
    def clusters(self) -> DataFrame:
        """idx and cluster_id; -1 for messages without anchors, and for null ones."""
        found = self.with_shapes(self.messages, self.assigned.select("shape", "cluster_id"))
        return found.select("idx", F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"))

    @cached_property
    def templates(self) -> DataFrame:
        """cluster_id and templates: sorted and distinct."""
        return cluster_templates(self.chosen, self.common)

    @cached_property
    def masks(self) -> DataFrame:
        """idx and mask; empty for messages without a cluster."""
        found = self.with_shapes(self.messages, self.rich.join(self.common, "cluster_id").select("shape", "common"))
        shown = F.when(F.col("common").isNotNull(), mask(rich_slices(F.col("msg"), self.config), F.col("common")))
        return found.select("idx", F.coalesce(shown, F.lit("")).alias("mask"))

    @cached_property
    def rendered(self) -> DataFrame:
        """The clustered shapes, each with its own template: shape, common, template."""
        return self.rich.join(self.common, "cluster_id").select("shape", "common", render(F.col("rich.slice"), F.col("common")).alias("template"))


class LogParser:
    """Mines templates from messages. ``parse`` takes a table with an id and a message; ids must differ."""

    def __init__(self, config: ParserConfig | None = None):
        self.config = config or ParserConfig()

    def parse(self, df: DataFrame, message: str = "msg", idx: str = "idx") -> ParseResult:
        return ParseResult(df.select(F.col(idx).alias("idx"), F.col(message).cast("string").alias("msg")), self.config)
