"""A codec of a corpus: each of its lines is a template's number and arguments, and can be had back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ParserConfig
from ..functions.templates import arguments, decode, normalize_template, template_parts
from ..functions.tokens import is_reducible, rich_slices
from ..plans.parser import LogParser, ParseResult
from ..plans.ranking import numbered
from ..plans.tables import sent, stored
from .stats import distinct_lines


class CorpusCodec:
    """``entries``: msg, template_id, args of each distinct line; ``templates``: template_id, template. The lines and the
    templates are written once; arguments follow from them where they are asked for.

    Templates of clusters come first, in order; lines that have no cluster, or that their tokens don't add up to, are
    templates of their own, in order of their first idx. A line that holds the placeholder itself isn't had back.
    """

    def __init__(self, entries: DataFrame, templates: DataFrame):
        self.entries, self.templates = entries, templates

    @classmethod
    def fit(cls, df: DataFrame, config: ParserConfig | None = None, message: str = "msg", idx: str = "idx") -> CorpusCodec:
        parsed: ParseResult = LogParser(config).parse(df, message, idx)
        lines = stored(distinct_lines(parsed.messages).select("msg", "first"), "codec-lines")
        each = parsed.with_shapes(lines, parsed.rendered)
        slices = rich_slices(F.col("msg"), parsed.config)
        whole = F.is_valid_utf8("msg") if is_reducible(parsed.config) else F.array_join(slices, "") == F.col("msg")
        each = each.withColumn("own", F.col("template").isNull() | ~whole).withColumn("template", F.when(F.col("own"), F.col("msg")).otherwise(F.col("template")))
        sets = parsed.templates.select("cluster_id", F.posexplode("templates").alias("pos", "template"))
        sets = sets.withColumn("template", normalize_template(F.col("template")))
        order = sets.groupBy("template").agg(F.min(F.struct(F.lit(0).alias("late"), F.col("cluster_id").cast("long").alias("at"), F.col("pos").cast("long").alias("pos"))).alias("o"))
        rest = each.groupBy("template").agg(F.min("first").alias("at")).select("template", F.struct(F.lit(1).alias("late"), "at", F.lit(0).cast("long").alias("pos")).alias("o"))
        both = order.union(rest).groupBy("template").agg(F.min("o").alias("o"))
        templates = numbered(both, [F.col("o")], "template_id").select(F.col("template_id").cast("int").alias("template_id"), "template")
        # A template may have most lines: where the templates' bytes allow, lines don't move to them.
        templates = sent(stored(templates, "codec-templates"), F.octet_length("template") + 64)
        none = F.array().cast("array<string>")
        entries = each.join(templates, "template").select("msg", "template_id", F.when(F.col("own"), none).otherwise(arguments(slices, F.col("common"), F.col("msg"))).alias("args"))
        return cls(entries, templates)

    def encode(self, messages: DataFrame) -> DataFrame:
        """``messages`` (with a column msg) with template_id and args; -1 and null for lines that aren't known."""
        return messages.join(self.entries, "msg", "left").withColumn("template_id", F.coalesce("template_id", F.lit(-1)))

    def encode_ids(self, messages: DataFrame) -> DataFrame:
        return self.encode(messages).drop("args")

    def decode(self, codes: DataFrame) -> DataFrame:
        """``codes`` (template_id, args) with msg; null for unknown numbers and wrong counts of arguments."""
        found = codes.join(self.templates, "template_id", "left")
        return found.withColumn("msg", decode(template_parts(F.col("template")), F.col("args"))).drop("template")
