"""The parser against the golden cases and a plain-Python version on random corpora."""

import math
import random
from collections import Counter, defaultdict

import pytest
import regex

from loomline.config import RICH_SYMBOLS, ParserConfig
from loomline.functions.tokens import split_loop
from loomline.functions.regexes import compile_pattern
from loomline.operators.anchors import largest_component
from loomline.plans.parser import LogParser

WHITE = regex.compile(r"[\t-\r\x85\p{Z}]")


def plain_tokens(msg, config, symbols):
    parts = [(-1, msg)]
    for patterns, kind in ((config.special_whites, 5), (config.special_blacks, 6)):
        for p in patterns:
            match = regex.compile(compile_pattern(p).python, regex.ASCII).search
            parts = [q for part in parts for q in (split_loop(part[1], match, kind) if part[0] == -1 else [part])]
    out = []
    for kind, text in parts:
        if kind != -1:
            out.append((kind, text))
            continue
        run = ""
        for c in [*text, None]:
            edge = c is None or WHITE.match(c) or c in symbols
            if not edge:
                run += c
                continue
            if run:
                out.append((0 if regex.fullmatch(r"\p{L}+", run) else 1 if regex.fullmatch(r"\p{Nd}+", run) else 4, run))
                run = ""
            if c is not None:
                out.append((3 if WHITE.match(c) else 2, c))
    return out


def plain_parse(messages, config):
    rows = {m: plain_tokens(m, config, config.symbols) for m in messages}
    w = Counter(messages)
    occ, co = Counter(), Counter()
    for m, toks in rows.items():
        kept = sorted({s for k, s in toks if k in config.kept_kinds})
        for i, a in enumerate(kept):
            occ[a] += w[m]
            for b in kept[i + 1 :]:
                co[a, b] += w[m]
    key = {}
    for m, toks in rows.items():
        nodes = list(dict.fromkeys(t for t in toks if occ[t[1]]))
        edges = []
        for i, (_, a) in enumerate(nodes):
            for j, (_, b) in enumerate(nodes):
                if i != j and co[min(a, b), max(a, b)] > occ[a] * config.threshold:
                    edges.append((i, j))
        anchors = {nodes[i] for i in largest_component(len(nodes), edges)}
        if nodes:
            anchors |= {t for t in toks if t[0] == 5}
            anchors -= {t for t in toks if t[0] == 6}
        key[m] = tuple(sorted(anchors, key=lambda t: (t[0], t[1].encode())))
    order = sorted({k for k in key.values() if k}, key=lambda k: [(t[0], t[1].encode()) for t in k])
    ids = [order.index(key[m]) if key[m] else -1 for m in messages]
    templates, masks = [], [""] * len(messages)
    for c in range(len(order)):
        at = [i for i, x in enumerate(ids) if x == c]
        n, k = len(at), math.ceil(len(at) * config.pattern_sample)
        if 1 < n and k < n:
            step = (n - 1) / (k - 1) if k > 1 else 0
            at = [at[int(i * step + 0.5)] for i in range(k)]
        rich = {i: plain_tokens(messages[i], config, RICH_SYMBOLS) for i in at}
        common = set.intersection(*({s for kd, s in t if kd in config.common_kinds} for t in rich.values()))
        shown = set()
        for t in rich.values():
            out = []
            for i, (_, s) in enumerate(t):
                if s in common:
                    out.append(s)
                elif not i or t[i - 1][1] in common:
                    out.append("<*>")
            shown.add("".join(out))
        templates.append(sorted(shown, key=str.encode))
        for i, x in enumerate(ids):
            if x == c:
                masks[i] = "".join(("0" if s in common else "1") * len(s.encode()) for _, s in plain_tokens(messages[i], config, RICH_SYMBOLS))
    return ids, templates, masks


def parse(spark, messages, config, partitions=3):
    df = spark.createDataFrame(list(enumerate(messages)), "idx long, msg string").repartition(partitions)
    got = LogParser(config).parse(df)
    ids = [r.cluster_id for r in got.clusters.orderBy("idx").collect()]
    templates = [r.templates for r in got.templates.orderBy("cluster_id").collect()]
    return ids, templates, [r["mask"] for r in got.masks.orderBy("idx").collect()]


# Corpora of two golden cases, and their answers below, which results must equal.
DEFAULT = ["a x1 x2 b", "a x2 b", "a x3 b", "a x4 b", "c x1 d", "c x2 d", "c x3 d", "c x4 d"]
SPECIAL = ["Fan fan_2 speed is set to 12.3114 on machine sys.node.fan_3 on node 12", "Fan fan_7 speed is set to 73.9901 on machine sys.node.fan_8 on node 12", "Temp sensor_1 is 99.4 C", "Temp sensor_2 is 88.3 C"]


@pytest.mark.parametrize("symbols", ["", "()[]{}=,*"])
def test_default(spark, symbols):
    ids, templates, masks = parse(spark, DEFAULT, ParserConfig(symbols=symbols))
    assert ids == [0] * 4 + [1] * 4
    assert templates == [["a <*> <*> b", "a <*> b"], ["c <*> d"]]
    assert masks == ["001101100"] + ["001100"] * 7


def test_special(spark):
    config = ParserConfig(symbols=".", special_whites=["Fan", "Temp"], special_blacks=[r"\d+\.\d+"])
    ids, templates, masks = parse(spark, SPECIAL, config)
    assert ids == [1, 1, 0, 0]
    assert templates == [["Temp sensor_<*> is <*> C"], ["Fan fan_<*> speed is set to <*> on machine sys.node.fan_<*> on node <*>"]]
    assert masks == ["0000000010000000000000000011111110000000000000000000000000100000000011"] * 2 + ["00000000000010000111100"] * 2


CONFIGS = [
    ParserConfig(),
    ParserConfig(threshold=0.3, symbols="-:", filter_numeric=True),
    ParserConfig(threshold=0.8, filter_impure=True, pattern_sample=0.4),
    ParserConfig(threshold=0, filter_alphabetic=False, filter_impure=True, special_whites=["user", r"err\w*"], special_blacks=[r"\d+", "re"]),
    ParserConfig(threshold=1, special_whites=[r"\bin\b", r"x*"], pattern_sample=0.25),
]


@pytest.mark.parametrize("at", range(len(CONFIGS)))
def test_random_corpora(spark, at):
    r = random.Random(at)
    words = ["user", "error", "in", "re", "login", "x", "xx", "x1", "7", "42", "é日", "a-b", "k=v", "(", ",", "re7", "　", "10:20"]
    messages = ["".join(r.choice(words) + r.choice([" ", " ", "  ", ":", ""]) for _ in range(r.randint(0, 7))) for _ in range(90)]
    messages += r.choices(messages, k=30)
    assert parse(spark, messages, CONFIGS[at]) == plain_parse(messages, CONFIGS[at])


def test_partitions_and_nulls_and_nothing(spark):
    lines = [f"mail {i} from box{i % 23} kept for {i % 7} days" if i % 3 == 0 else f"box{i % 23} is full at {i} [quota]" if i % 3 == 1 else f"bounced {i}x to list.{i % 11}" for i in range(300)]
    assert parse(spark, lines, ParserConfig(), 1) == parse(spark, lines, ParserConfig(), 8) == plain_parse(lines, ParserConfig())
    ids, templates, masks = parse(spark, [None, "a b", None, ""], ParserConfig())
    assert ids == [-1, 0, -1, -1] and templates == [["a b"]] and masks == ["", "000", "", ""]
    assert parse(spark, [], ParserConfig()) == ([], [], [])


def test_components_keep_the_order_of_ties():
    assert largest_component(3, []) == [2]
    assert largest_component(4, [(0, 1), (1, 0), (2, 3), (3, 2)]) == [2, 3]
    assert largest_component(3, [(0, 1), (1, 2), (2, 0)]) == [0, 1, 2]
    assert largest_component(2000, [(i, i + 1) for i in range(1999)]) == [0]


@pytest.mark.parametrize("bad", [{"threshold": 1.2}, {"threshold": math.nan}, {"pattern_sample": 0}, {"pattern_sample": -0.1}, {"pattern_sample": 1.1}, {"pattern_sample": math.inf}])
def test_validation(bad):
    with pytest.raises(ValueError):
        ParserConfig(**bad)
    assert ParserConfig(pattern_sample=0.01, threshold=1).threshold == 1
