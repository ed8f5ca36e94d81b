"""Templates and masks as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PLACEHOLDER
from .regexes import quote


def is_common(text: Column, common: Column) -> Column:
    return F.array_contains(common, text)


def render(slices: Column, common: Column) -> Column:
    """Common slices as they are; each run of others as one placeholder."""
    parts = F.transform(slices, lambda s, i: F.when(is_common(s, common), s).when((i == 0) | is_common(F.get(slices, i - 1), common), F.lit(PLACEHOLDER)))
    return F.array_join(parts, "")


def mask(slices: Column, common: Column) -> Column:
    """For each byte of the message, 0 where it is literal and 1 where it is a parameter."""
    return F.array_join(F.transform(slices, lambda s: F.repeat(F.when(is_common(s, common), "0").otherwise("1"), F.octet_length(s))), "")


#: Stands between arguments; a text that holds it is taken apart token by token.
_BETWEEN = "\uffff"


def arguments(slices: Column, common: Column, text: Column) -> Column:
    """The text behind each placeholder that ``render`` makes of the slices of ``text``."""
    joined = F.array_join(F.transform(slices, lambda s: F.when(is_common(s, common), _BETWEEN).otherwise(s)), "")
    return F.when(F.contains(text, F.lit(_BETWEEN)), _runs(slices, common)).otherwise(F.filter(F.split(joined, _BETWEEN, -1), lambda a: a != ""))


def _runs(slices: Column, common: Column) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, t: Column) -> Column:
        closed = F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        return F.when(is_common(t, common), F.struct(closed.alias("done"), F.lit(None).cast("string").alias("open"))).otherwise(F.struct(a["done"].alias("done"), F.concat(F.coalesce(a["open"], F.lit("")), t).alias("open")))

    end = F.aggregate(slices, start, step)
    return F.when(end["open"].isNull(), end["done"]).otherwise(F.concat(end["done"], F.array(end["open"])))


def normalize_template(template: Column) -> Column:
    """Placeholders that touch become one."""
    return F.regexp_replace(template, r"(?:<\*>){2,}", PLACEHOLDER)


def template_parts(template: Column) -> Column:
    """The literals before, between and after the placeholders."""
    return F.split(template, r"<\*>", -1)


def decode(parts: Column, args: Column) -> Column:
    """Literals and arguments in turn; null unless there is one argument for each placeholder."""
    args = F.coalesce(args, F.array().cast("array<string>"))
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(args, i), F.lit("")))), "")
    return F.when(F.size(args) == F.size(parts) - 1, text)


def normalized(template: str) -> str:
    return re.sub(r"(?:<\*>){2,}", PLACEHOLDER, template)


def template_regex(template: str) -> str:
    """A Java pattern that matches as the matcher does: a placeholder takes what comes before the first place of the
    next literal, at least one character, and isn't tried again; the last one takes all up to the end."""
    parts = template.split(PLACEHOLDER)
    if len(parts) == 1:
        return rf"(?s)\A{quote(template)}\z"
    out = [rf"(?s)\A{quote(parts[0])}"]
    for literal in parts[1:-1]:
        out.append(f"((?>(?:(?!{quote(literal)}).)+)){quote(literal)}")
    return "".join(out) + rf"(.+){quote(parts[-1])}\z"
