"""Matcher, codec, command line, sources, streams."""

import io
import json
import random

import pytest
import regex

from loomline.__main__ import run
from loomline.config import ParserConfig
from loomline.functions.regexes import compile_pattern, compile_patterns, union_pattern
from loomline.functions.sql import register
from loomline.functions.tokens import pre_tokens, split_loop, tokenize
from loomline.operators.codec import CorpusCodec
from loomline.operators.matcher import TemplateIndex, TemplateMatcher, compile_templates
from loomline.plans.parser import LogParser
from loomline.sources.text import read_lines, write_json
from loomline.streaming.stream import match_stream, parse_batches

from .test_parser import DEFAULT


def plain_match(compiled, msg):
    best = None
    for t in compiled:
        parts = t.template.split("<*>")
        if len(parts) == 1:
            if msg == t.template:
                return t.template_id, []
            continue
        if parts == ["", ""] or not msg.startswith(parts[0]):
            continue
        at, args = len(parts[0]), []
        for p in parts[1:-1]:
            nxt = msg.find(p, at)
            if nxt <= at:
                break
            args.append(msg[at:nxt])
            at = nxt + len(p)
        else:
            end = len(msg) - len(parts[-1])
            if msg.endswith(parts[-1]) and end > at:
                if best is None or t.rank < best[0]:
                    best = (t.rank, t.template_id, [*args, msg[at:end]])
    return best[1:] if best else (-1, None)


SHELVES = ["shelf <*> row <*>", "<*> is empty", "<*>", "closed today"]
CASES = [
    (["take <*> now", "put <*> back"], "put the lamp back", 1, ["the lamp"]),
    (["take <*> now", "put <*> back"], "take back", -1, None),
    (["take <*>", "take <*> now"], "take it now", 1, ["it"]),  # more literal bytes first
    (["<*> of <*>", "<*> of"], "a of", 1, ["a"]),
    (["<*>=<*>", "<*>=<*>;<*>"], "k=v;w", 1, ["k", "v", "w"]),
    (["up <*>", "<*> up"], "up up", 0, ["up"]),  # the smaller number last
    (SHELVES, "shelf 4 row 9", 0, ["4", "9"]),
    (SHELVES, "closed today", 3, []),
    (SHELVES, "shelf 4 is empty", 1, ["shelf 4"]),
    (SHELVES, "nothing else", -1, None),  # a lone placeholder is no template of anything
    (["<*>one<*>", "<*>tone<*>"], "a stone wall", 1, ["a s", " wall"]),
    (["x<*>y<*>z"], "xyayz", -1, None),  # nothing stands before the first y, and no other is tried
    (["x<*>y<*>z"], "xayyz", 0, ["a", "y"]),
    (["", "q<*>"], "", 0, []),
    (["q<*>"], "q", -1, None),
]


def test_cases(spark):
    for templates, msg, want, args in CASES:
        got = TemplateMatcher(spark, templates).match(spark.createDataFrame([(msg,)], "msg string")).collect()
        assert [(r.template_id, r.args) for r in got] == [(want, args)], (templates, msg)
    assert TemplateMatcher.from_template_sets(spark, [["on <*><*><*> at", "off"], ["off", "on <*> at"], []]).templates() == ["on <*> at", "off"]


def test_random_matches(spark):
    r = random.Random(7)
    piece = lambda: r.choice(["a", "b", "ab", "é", "\n", ".", "\\E", "c d"])
    templates = ["".join(r.choice(["<*>", piece(), piece()]) for _ in range(r.randint(1, 6))) for _ in range(60)]
    messages = ["".join(piece() for _ in range(r.randint(0, 8))) for _ in range(400)] + [None]
    m = TemplateMatcher(spark, templates)
    got = m.match(spark.createDataFrame(list(enumerate(messages)), "i long, msg string")).collect()
    assert len(got) == len(messages)
    for row in got:
        want = plain_match(m.compiled, row.msg) if row.msg is not None else (-1, None)
        assert (row.template_id, row.args) == tuple(want), row
    register(spark, m)
    spark.createDataFrame(list(enumerate(messages)), "i long, msg string").createOrReplaceTempView("lines")
    assert {(x.i, x.t) for x in spark.sql("select i, log_match(msg) t from lines").collect()} == {(x.i, x.template_id) for x in got}
    assert spark.sql("select log_template_args('a <*> b', array('x')) s").first().s == "a x b"


def test_codec(spark):
    lines = DEFAULT + ["no cluster of 1", "77_88", "", DEFAULT[0]]
    df = spark.createDataFrame(list(enumerate(lines)), "idx long, msg string")
    codec = CorpusCodec.fit(df)
    coded = codec.encode(df)
    assert sorted(r.msg for r in codec.decode(coded.drop("msg")).collect()) == sorted(lines)
    ids = {r.msg: (r.template_id, r.args) for r in coded.collect()}
    assert len({v[0] for v in ids.values()}) == 6 and ids["77_88"][1] == []
    ask = spark.createDataFrame([("never seen",)], "msg string")
    assert [(r.template_id, r.args) for r in codec.encode(ask).collect()] == [(-1, None)]
    bad = spark.createDataFrame([(-1, ["x"]), (4321, ["x"]), (ids["c x1 d"][0], []), (ids["c x1 d"][0], ["q"])], "template_id int, args array<string>")
    assert sorted(str(r.msg) for r in codec.decode(bad).collect()) == ["None", "None", "None", "c q d"]


def test_codec_of_odd_lines(spark):
    lines = ["id=7 é日 ok", "id=8 é日 ok", "x" * 50, "a  b", "id=7 é日 ok"]
    df = spark.createDataFrame(list(enumerate(lines)), "idx long, msg string")
    codec = CorpusCodec.fit(df, ParserConfig(special_blacks=[r"\d+"], special_whites=[r"\bok"]))
    assert sorted(r.msg for r in codec.decode(codec.encode(df).drop("msg")).collect()) == sorted(lines)


def test_tokens(spark):
    config = ParserConfig(symbols=".", special_whites=[r"bay_\d+"], special_blacks=[r"\d+,\d+"])
    df = spark.createDataFrame([("bay_7 holds 3,25 t at dock.bay_12.b", "n 8,5 and n 9 or 7,0")], "a string, b string")
    got = [(t.kind, t.slice) for t in df.select(tokenize(df.a, config).alias("t")).first().t]
    space = (3, " ")
    assert got == [(5, "bay_7"), space, (0, "holds"), space, (6, "3,25"), space, (0, "t"), space, (0, "at"), space, (0, "dock"), (2, "."), (5, "bay_12"), (2, "."), (0, "b")]
    config = ParserConfig(symbols="", special_whites=[r"\bn\b"], special_blacks=[r"\d+,\d+"])
    got = [(t.kind, t.slice) for t in df.select(pre_tokens(df.b, config).alias("t")).first().t]
    assert got == [(5, "n"), (-1, " "), (6, "8,5"), (-1, " and "), (5, "n"), (-1, " 9 or "), (6, "7,0")]


@pytest.mark.parametrize("pattern,text,want", [
    ("^x", "xxyx", [(5, "x"), (5, "x"), (-1, "yx")]),  # anchors hold anew in what is left
    ("x*", "abc", [(-1, "abc")]),  # only empty matches: the text stays whole
    ("x*", "abxxcd", [(5, "xx")]),  # what empty matches pass over is lost, before the match and after it
    ("x+|$", "axb", [(-1, "a"), (5, "x"), (-1, "b")]),
    (r"\bx", "x-x", [(5, "x"), (-1, "-"), (5, "x")]),
])
def test_searching_what_is_left(pattern, text, want):
    assert split_loop(text, regex.compile(pattern, regex.ASCII).search, 5) == want


def test_patterns(spark):
    p = union_pattern("[0-3]+", "[x-z]+")
    rows = spark.createDataFrame([("12",), ("zy",), ("ab",), ("9",), ("a1",)], "s string")
    assert sorted(r.s for r in rows.where(rows.s.rlike(p.java)).collect()) == ["12", "a1", "zy"]
    for bad in (r"(?=x)", r"(a)\1", "(", "a++", "(?>a)", "[[:nope:]]"):
        with pytest.raises(ValueError):
            compile_patterns(["ok", bad])
    assert compile_pattern("abc").literal and not compile_pattern("a.c").literal
    assert [compile_pattern(x).plain for x in ("a+", "a*", "^a", r"\bx", "a$", "[[:alpha:]]+")] == [True, False, False, False, False, True]
    assert compile_templates(["b", "a<*>", "abc <*> d"])[2].rank == 0


def test_command_line(spark, tmp_path):
    text = ("\n".join(DEFAULT) + "\r\n").encode()
    out = io.StringIO()
    run(["-templates", "-masks"], io.BytesIO(text), out, spark)
    got = json.loads(out.getvalue())
    assert got["clusters"] == [0] * 4 + [1] * 4 and len(got["masks"]) == 8 and got["templates"][1] == ["c <*> d"] and "<" not in out.getvalue()
    (tmp_path / "in").write_bytes(text)
    run(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "-filter-numeric=false"], spark=spark)
    assert json.loads((tmp_path / "out").read_text()) == {"clusters": got["clusters"]}
    for bad in (["-threshold", "1.2"], ["-pattern-sample", "0"], ["-special-white", "("]):
        with pytest.raises(ValueError):
            run(bad, io.BytesIO(b"x\n"), io.StringIO(), spark)


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.log").write_bytes(b"one\r\n\ntw\ro\r\r\n" + b"bad \xff\n" * 3)
    (tmp_path / "t/b.log").write_bytes(b"last")
    rows = read_lines(spark, str(tmp_path / "t")).orderBy("idx").collect()
    assert [r.msg for r in rows] == ["one", "", "tw\ro\r", "bad �", "bad �", "bad �", "last"] and [r.idx for r in rows] == list(range(7))
    df = spark.createDataFrame(list(enumerate(DEFAULT)), "idx long, msg string")
    write_json(LogParser().parse(df), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/messages")).count() == 8 and spark.read.json(str(tmp_path / "json/templates")).count() == 2


def test_many_templates(spark, monkeypatch):
    """5,000 templates that are found by whole texts and by each kind of literal: all ways of matching agree."""
    r = random.Random(3)
    templates = [t for i in range(1000) for t in (f"task {i} took <*> s", f"<*> left {i}", f"<*> of unit{i}- on <*>", f"done {i}", f"<*> k{i}= <*> end")]
    make = [lambda i: f"task {i} took {r.random()} s", lambda i: f"all left {i}", lambda i: f"half of unit{i}- on {i}", lambda i: f"done {i}", lambda i: f"a k{i}= b end", lambda i: f"none {i}"]
    df = spark.createDataFrame([(i, r.choice(make)(r.randrange(1100))) for i in range(600)] + [(600, None)], "idx long, msg string")
    m = TemplateMatcher(spark, templates)
    want = {x.idx: x.template_id for x in m.match_ids(df).collect()}
    assert len(want) == 601 and len(set(want.values())) > 300
    assert {x.idx: x.template_id for x in match_stream(df, m).collect()} == want
    import sys

    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    index = TemplateIndex(m.compiled)
    assert {x.idx: index.best(x.msg) for x in df.collect()} == want
    register(spark, m, ParserConfig(symbols="="))
    df.createOrReplaceTempView("many")
    assert {x.idx: x.t for x in spark.sql("select idx, log_match(msg) t from many").collect()} == want
    assert spark.sql("select log_tokenize('a  k1=b') t").first().t == ["a", " ", " ", "k1", "=", "b"]


def test_streams(spark, tmp_path):
    spark.createDataFrame(list(enumerate(DEFAULT + ["no match"])), "idx long, msg string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx long, msg string").json(str(tmp_path / "in"))
    m = TemplateMatcher(spark, ["a <*> b", "c <*> d", "<*>", "c x1 d"])
    q = match_stream(stream, m).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    got = {r.msg: r.template_id for r in spark.sql("select * from hits").collect()}
    assert got == {r.msg: r.template_id for r in m.match_ids(spark.read.json(str(tmp_path / "in"))).collect()} and got["no match"] == -1 and got["c x1 d"] == 3
    seen = []
    q = parse_batches(stream, ParserConfig(), lambda p, n: seen.extend(p.clusters.collect()), checkpointLocation=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 9
