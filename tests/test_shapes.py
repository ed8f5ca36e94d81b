"""What moves with the number of lines, and what with the number of their shapes."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.config import ParserConfig
from loomline.functions.templates import _runs, arguments
from loomline.functions.tokens import is_reducible, rich_slices
from loomline.operators import anchors
from loomline.operators.codec import CorpusCodec
from loomline.operators.matcher import TemplateMatcher
from loomline.plans import tables
from loomline.plans.parser import LogParser
from tests.test_parser import parse, plain_parse

N = 1500
LINES = [f"order {i} cust={i * 7} status=O prio={i % 5}-LOW" if i % 3 else f"user {i} did click props {{k: x{i}}}" for i in range(N)]
PUMPS = [f"Pump p_{i} turns at {i}.{i % 97} in hall.north.p_{i % 13}" for i in range(N)]
SPECIAL = ParserConfig(symbols=".", special_whites=["Pump"], special_blacks=[r"\d+\.\d+"])
SAMPLED = ParserConfig(pattern_sample=0.03)


def table(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "idx long, msg string").repartition(3)


def coded(df):
    return CorpusCodec.fit(df).encode(df)


#: What each finding's query asks for, and how often all lines may be written for it.
ASKED = {
    "F1 encode_ids": (LINES, lambda df: CorpusCodec.fit(df).encode_ids(df), 1),
    "F2 codec_roundtrip": (LINES, lambda df: (c := CorpusCodec.fit(df)).decode(c.encode(df).drop("msg")), 1),
    "F3 special_templates": (PUMPS, lambda df: LogParser(SPECIAL).parse(df).templates, 0),
    "F4 sampled_masks": (LINES, lambda df: LogParser(SAMPLED).parse(df).masks, 1),
    "F5 codec_encode": (LINES, coded, 1),
    "F6 sampled_templates": (LINES, lambda df: LogParser(SAMPLED).parse(df).templates, 1),
    "F7 special_clusters": (PUMPS, lambda df: LogParser(SPECIAL).parse(df).clusters, 0),
    "F8 special_masks": (PUMPS, lambda df: LogParser(SPECIAL).parse(df).masks, 0),
    "F9 masks": (LINES, lambda df: LogParser().parse(df).masks, 0),
    "F10 template_compile_rank": (LINES, lambda df: TemplateMatcher.from_template_sets(df.sparkSession, LogParser().parse(df).templates).table, 0),
    "F11 common_slices": (LINES, lambda df: LogParser().parse(df).common, 0),
    "F12 anchors": (LINES, lambda df: LogParser().parse(df).lines.select("first", "anchors"), 0),
    "F13 templates": (LINES, lambda df: LogParser().parse(df).templates, 0),
}


@pytest.mark.parametrize("name", ASKED)
def test_rows_written_follow_the_shapes(spark, tmp_path, monkeypatch, name):
    lines, ask, times = ASKED[name]
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    assert ask(table(spark, lines)).count()
    assert sum(spark.read.parquet(str(d)).count() for d in tmp_path.glob("loomline-*")) <= times * N + N // 5


def test_messages_are_matched_where_they_lie(spark):
    """F14 match_ids"""
    found = TemplateMatcher(spark, ["order <*> cust=<*>", "<*>: <*>}"]).match_ids(table(spark, LINES).where("idx >= 0"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the table's own
    assert found.groupBy("template_id").count().count() == 2


CONFIGS = [
    ParserConfig(threshold=0.4, symbols="-", special_whites=["re", "0x"], special_blacks=["x+", r"\d+:", "=", "log", "é"]),
    ParserConfig(threshold=0.2, symbols="", filter_numeric=True, special_blacks=[r"\d\d", "in"], pattern_sample=0.3),
    ParserConfig(threshold=0.3, filter_alphabetic=False, special_whites=["user"], special_blacks=["-", r"7"]),
    ParserConfig(threshold=0.3, filter_alphabetic=False, filter_numeric=True, pattern_sample=0.5),
]


@pytest.mark.parametrize("at", range(len(CONFIGS)))
def test_shapes_lose_nothing(spark, at):
    """Special tokens whose text is a candidate elsewhere, words in place of others, and each kind of candidates."""
    assert is_reducible(CONFIGS[at])
    r = random.Random(at)
    words = ["user", "error", "in", "re", "login", "x", "xx", "x1", "7", "42", "é日", "a-b", "k=v", "(", ",", "re7", "10:20", "0x", "0xx", "log", "-"]
    messages = ["".join(r.choice(words) + r.choice([" ", " ", "  ", ":", ""]) for _ in range(r.randint(0, 7))) for _ in range(90)]
    messages += r.choices(messages, k=30)
    assert parse(spark, messages, CONFIGS[at]) == plain_parse(messages, CONFIGS[at])


def test_shapes_too_large_to_send(spark, monkeypatch):
    """Results don't depend on whether shapes are broadcast."""
    messages = [f"w{'abcdefghij'[i % 10]} on {i} at box{i % 4}" if i % 2 else f"mail {'klm'[i % 3]} to {i}" for i in range(120)] + ["", "77"]
    want = plain_parse(messages, ParserConfig())
    monkeypatch.setattr(tables, "BROADCAST", -1)
    monkeypatch.setattr(anchors, "BROADCAST", -1)
    assert parse(spark, messages, ParserConfig()) == want
    df = table(spark, messages)
    codec = CorpusCodec.fit(df)
    assert sorted(r.msg for r in codec.decode(codec.encode(df).drop("msg")).collect()) == sorted(messages)


def test_arguments_of_any_text(spark):
    df = spark.createDataFrame([("a 1 b 22",), ("a 1￿2 b 22",), ("a b",), ("7-8 x",), ("",)], "msg string")
    slices, common = rich_slices(F.col("msg"), ParserConfig()), F.array(*map(F.lit, ("a", "b", " ")))
    got = df.select(arguments(slices, common, F.col("msg")).alias("a"), _runs(slices, common).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [["1", "22"], ["1￿2", "22"], [], ["7-8", "x"], []]


def test_codec_of_invalid_bytes(spark):
    """Bytes that aren't UTF-8 can't be had back from tokens: such a line is a template of its own."""
    df = spark.createDataFrame([(i, f"user {i} left") for i in range(5)], "idx long, msg string")
    df = df.union(spark.sql("select 9L, cast(concat(binary('user '), X'FF', binary(' left')) as string)"))
    codec = CorpusCodec.fit(df)
    found = codec.encode(df).join(codec.templates, "template_id").where("not is_valid_utf8(msg)").select(F.hex("msg").alias("msg"), F.hex("template").alias("template"), "args").collect()
    assert len(found) == 1 and found[0].msg == found[0].template and found[0].args == []
