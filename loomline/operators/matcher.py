"""Matching messages against templates: the best template of each message, and what stands for its placeholders."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PLACEHOLDER
from ..functions.templates import normalized, template_regex
from ..plans.tables import BROADCAST

SCHEMA = "template_id int, template string, n_ph int, literal_bytes int, min_len int, first string, last string, middle string, rank int, regex string"


@dataclass(frozen=True)
class Template:
    """A compiled template. ``rank``: more literal bytes first, then fewer placeholders, then the smaller id."""

    template_id: int
    template: str
    n_ph: int
    literal_bytes: int
    min_len: int
    first: str
    last: str
    middle: str
    rank: int
    regex: str


def compile_templates(templates) -> list[Template]:
    """Templates made normal and distinct, numbered in order of first appearance, and ranked."""
    distinct = list(dict.fromkeys(normalized(t) for t in templates))
    found = []
    for i, t in enumerate(distinct):
        parts = t.split(PLACEHOLDER)
        literal = sum(len(p.encode()) for p in parts)
        inner = parts[1:-1]
        middle = max(inner, key=lambda p: len(p.encode())) if inner else ""  # the first of the longest
        found.append((i, t, len(parts) - 1, literal, literal + len(parts) - 1, parts[0], parts[-1], middle))
    order = {f[0]: r for r, f in enumerate(sorted(found, key=lambda f: (-f[3], f[2], f[0])))}
    return [Template(*f, order[f[0]], template_regex(f[1])) for f in found]


class TemplateIndex:
    """Templates by what a message must have to match: the whole text, the first literal, the last one, or one between.
    A look-up costs as many steps as there are lengths of such literals, not as there are templates."""

    def __init__(self, compiled: list[Template]):
        self.exact = {t.template: t.template_id for t in compiled if t.n_ph == 0}
        self.first, self.last, self.middle = {}, {}, {}
        for t in sorted(compiled, key=lambda t: t.rank):
            if t.n_ph:
                way = self.first if t.first else self.last if t.last else self.middle
                if literal := t.first or t.last or t.middle:  # a lone placeholder matches nothing
                    way.setdefault(literal, []).append((t.rank, t.template_id, t.template.split(PLACEHOLDER)))
        self.lengths = [sorted({len(x) for x in way}) for way in (self.first, self.last, self.middle)]

    def contained(self, msg: str) -> set[str]:
        """The middle literals that stand in a message."""
        return {x for n in self.lengths[2] for i in range(len(msg) - n + 1) if (x := msg[i : i + n]) in self.middle}

    def candidates(self, msg: str) -> list[tuple[int, int, list[str]]]:
        lists = [self.first.get(msg[:n]) for n in self.lengths[0] if n <= len(msg)]
        lists += [self.last.get(msg[-n:]) for n in self.lengths[1] if n <= len(msg)]
        lists += [self.middle[x] for x in self.contained(msg)] if self.middle else []
        lists = [x for x in lists if x]
        return lists[0] if len(lists) == 1 else sorted((t for x in lists for t in x), key=lambda t: t[0])

    def best(self, msg: str | None) -> int:
        if msg is None:
            return -1
        if msg in self.exact:
            return self.exact[msg]
        return next((i for _, i, parts in self.candidates(msg) if fits(parts, msg)), -1)


def fits(parts: list[str], msg: str) -> bool:
    """Whether literals, with something between any two, make up a message. Each is sought once, from where the one
    before it ends."""
    at = len(parts[0])
    if not msg.startswith(parts[0]):
        return False
    for literal in parts[1:-1]:
        found = msg.find(literal, at)
        if found <= at:
            return False
        at = found + len(literal)
    return msg.endswith(parts[-1]) and len(msg) - len(parts[-1]) > at


class TemplateMatcher:
    """Templates are a small table: they are compiled on the driver. Messages stay distributed."""

    def __init__(self, spark: SparkSession, templates):
        self.spark, self.compiled = spark, compile_templates(templates)
        self.table = spark.createDataFrame([tuple(t.__dict__.values()) for t in self.compiled], SCHEMA)

    @classmethod
    def from_template_sets(cls, spark: SparkSession, sets) -> TemplateMatcher:
        """From lists of templates, one for each cluster in order, or a table of cluster_id and templates."""
        if isinstance(sets, DataFrame):
            sets = [r["templates"] for r in sets.orderBy("cluster_id").collect()]
        return cls(spark, [t for s in sets for t in s])

    @property
    def sent(self) -> DataFrame:
        """The table, broadcast where its bytes allow."""
        size = sum(2 * len(t.template) + 2 * len(t.regex) + 100 for t in self.compiled)
        return F.broadcast(self.table) if size <= BROADCAST else self.table

    def lookup(self):
        """A function of messages that gives the number of the best template; its index is made once in each worker."""
        sent, made = self.spark.sparkContext.broadcast(self.compiled), []

        @F.pandas_udf("int")
        def run(messages: pd.Series) -> pd.Series:
            if not made:
                made.append(TemplateIndex(sent.value))
            return messages.map(made[0].best, na_action=None).astype("int32")

        return run

    def templates(self) -> list[str]:
        return [t.template for t in self.compiled]

    def match_ids(self, messages: DataFrame) -> DataFrame:
        """``messages`` (with a column msg) with template_id; -1 where none matches. Messages are looked up where they lie:
        nothing moves, and a task holds a batch and the index."""
        return messages.withColumn("template_id", self.lookup()(F.make_valid_utf8("msg")))

    def match(self, messages: DataFrame) -> DataFrame:
        """``match_ids`` with args: what stands for each placeholder; null where none matches."""
        found = self.match_ids(messages)
        found = found.join(self.sent.select("template_id", "regex", "n_ph"), "template_id", "left")
        args = F.expr("transform(sequence(1, greatest(n_ph, 1)), i -> regexp_extract(msg, regex, cast(if(n_ph = 0, 0, i) as int)))")
        args = F.when(F.col("n_ph") == 0, F.array().cast("array<string>")).otherwise(args)
        return found.withColumn("args", F.when(F.col("template_id") >= 0, args)).drop("regex", "n_ph")
