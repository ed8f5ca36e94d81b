"""SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import ParserConfig
from ..operators.matcher import TemplateMatcher
from .tokens import WHITE, char_class


def register(spark: SparkSession, matcher: TemplateMatcher | None = None, config: ParserConfig | None = None) -> None:
    """``log_template_args(template, mask_args)`` puts arguments into a template; with a matcher, ``log_match(msg)``
    gives the number of the best template. ``log_tokenize(msg)`` gives the slices of the tokens, for a configuration
    without special patterns."""

    @F.pandas_udf("string")
    def fill(template: pd.Series, args: pd.Series) -> pd.Series:
        def one(t, a):
            parts = t.split("<*>") if t is not None else []
            a = list(a) if a is not None else []
            return "".join(p + x for p, x in zip(parts, [*a, ""], strict=True)) if len(parts) == len(a) + 1 else None

        return pd.Series([one(t, a) for t, a in zip(template, args, strict=True)], dtype=object)

    spark.udf.register("log_template_args", fill)
    cfg = config or ParserConfig()
    plain = not (cfg.special_whites or cfg.special_blacks)
    edge = WHITE + char_class(cfg.symbols)
    if plain:  # one expression, in the JVM
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION log_tokenize(msg STRING) RETURNS ARRAY<STRING>
            RETURN regexp_extract_all(msg, r'[{edge}]|[^{edge}]+', 0)""")
    if matcher is not None:
        spark.udf.register("log_match", matcher.lookup())
