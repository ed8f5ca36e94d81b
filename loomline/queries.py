"""A query for each operator over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT_SYMBOLS, RICH_SYMBOLS, ParserConfig
from .functions.regexes import union_pattern
from .functions.sql import register
from .functions.templates import decode, normalize_template, template_parts
from .functions.tokens import pre_tokens, tokenize
from .operators.anchors import row_nodes
from .operators.codec import CorpusCodec
from .operators.matcher import TemplateMatcher
from .operators.patterns import is_sampled
from .operators.stats import co_occurrences, dependencies, distinct_lines, occurrences, tokenized
from .plans.parser import LogParser
from .plans.tables import shared_dir
from .sources.text import read_lines
from .streaming.stream import match_stream

URL_SYMBOLS = ":/.?&=#-"
TEMPLATES = ["order <*> prio=<*>", "<*> prio=1-URGENT", "<*> did click<*>", "part <*><*> size=<*>", "<*>", "order <*> status=F prio=5-LOW", "user <*>"]
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of four shapes: idx and msg."""
    t = lambda n: _table(spark, sf, n)
    events = t("events").select(F.col("event_id").alias("idx"), F.concat_ws(" ", F.lit("user"), "user_id", F.lit("did"), "event_type", F.lit("props"), "props").alias("msg"))
    orders = t("orders").select((F.col("o_orderkey") + 10**12).alias("idx"), F.concat(F.lit("order "), "o_orderkey", F.lit(" cust="), "o_custkey", F.lit(" status="), "o_orderstatus", F.lit(" prio="), "o_orderpriority").alias("msg"))
    parts = t("part").select((F.col("p_partkey") + 2 * 10**12).alias("idx"), F.concat(F.lit("part "), "p_partkey", F.lit(" brand="), "p_brand", F.lit(" size="), "p_size").alias("msg"))
    blank = t("region").select((F.col("r_regionkey") + 3 * 10**12).alias("idx"), F.concat("r_regionkey", F.lit(" 42")).alias("msg"))
    return events.union(orders).union(parts).union(blank)


def short(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with many repeats."""
    return _table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.concat(F.lit("flag "), "l_returnflag", F.lit(" line "), "l_linenumber", F.lit(" is "), "l_linestatus").alias("msg"))


LOGS = """logs AS (
  SELECT event_id AS idx, concat_ws(' ', 'user', user_id, 'did', event_type, 'props', props) AS msg FROM events
  UNION ALL SELECT o_orderkey + 1000000000000, 'order ' || o_orderkey || ' cust=' || o_custkey || ' status=' || o_orderstatus || ' prio=' || o_orderpriority FROM orders
  UNION ALL SELECT p_partkey + 2000000000000, 'part ' || p_partkey || ' brand=' || p_brand || ' size=' || p_size FROM part
  UNION ALL SELECT r_regionkey + 3000000000000, r_regionkey || ' 42' FROM region)"""
SHORT = "short AS (SELECT l_orderkey * 10 + l_linenumber AS idx, 'flag ' || l_returnflag || ' line ' || l_linenumber || ' is ' || l_linestatus AS msg FROM lineitem)"


def _cls(symbols: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in sorted(symbols))


WHITE = r"\x09-\x0D\x{85}\p{Z}"


def _tokens_sql(source: str, columns: str, text: str, symbols: str) -> str:
    edge = WHITE + _cls(symbols)
    kind = f"CASE WHEN regexp_full_match(slice, '[{WHITE}]') THEN 3 WHEN regexp_full_match(slice, '[{_cls(symbols)}]') THEN 2 WHEN regexp_full_match(slice, '\\p{{L}}+') THEN 0 WHEN regexp_full_match(slice, '\\p{{Nd}}+') THEN 1 ELSE 4 END"
    inner = f"SELECT {columns}, unnest(arr) AS slice, generate_subscripts(arr, 1) - 1 AS pos FROM (SELECT {columns}, regexp_extract_all({text}, '[{edge}]|[^{edge}]+') AS arr FROM {source})"
    return f"SELECT {columns}, CAST(pos AS BIGINT) AS pos, CAST({kind} AS BIGINT) AS kind, slice FROM ({inner})"


def _uniq(source: str = LOGS, name: str = "logs", tokens=_tokens_sql, symbols: str = DEFAULT_SYMBOLS) -> str:
    return f"{source}, uniq AS (SELECT msg, count(*) AS w, min(idx) AS first FROM {name} GROUP BY msg), toks AS ({tokens('uniq', 'first, w', 'msg', symbols)})"


def _edges(uniq: str, kinds: str = "0", threshold: float = 0.5) -> str:
    return f"""{uniq}, kept AS (SELECT DISTINCT first, w, slice FROM toks WHERE kind IN ({kinds})),
  occ AS (SELECT slice, sum(w) AS occ FROM kept GROUP BY slice),
  co AS (SELECT x.slice AS a, y.slice AS b, sum(x.w) AS co FROM kept x JOIN kept y ON x.first = y.first AND x.slice < y.slice GROUP BY 1, 2),
  edges AS (SELECT a, b, co, oa.occ AS occ_a, ob.occ AS occ_b, co > oa.occ * {threshold} AS ab, co > ob.occ * {threshold} AS ba FROM co JOIN occ oa ON oa.slice = a JOIN occ ob ON ob.slice = b WHERE co > oa.occ * {threshold} OR co > ob.occ * {threshold})"""


def _scc(edges: str) -> str:
    """Components: what reaches one another along edges of a line."""
    return f"""{edges}, arcs AS (SELECT k.first, a AS src, b AS dst FROM edges JOIN kept k ON k.slice = a JOIN kept l ON l.first = k.first AND l.slice = b WHERE ab
    UNION ALL SELECT k.first, b, a FROM edges JOIN kept k ON k.slice = a JOIN kept l ON l.first = k.first AND l.slice = b WHERE ba),
  reach(first, src, dst) AS (SELECT first, src, dst FROM arcs UNION SELECT r.first, r.src, e.dst FROM reach r JOIN arcs e ON e.first = r.first AND e.src = r.dst),
  mates AS (SELECT first, slice AS node, slice AS mate FROM kept UNION SELECT r.first, r.src, r.dst FROM reach r JOIN reach q ON q.first = r.first AND q.src = r.dst AND q.dst = r.src),
  comp AS (SELECT first, node, count(*) AS n, min(mate) AS name FROM mates GROUP BY 1, 2),
  best AS (SELECT first, max(n) AS n FROM comp GROUP BY first)"""


def _clusters(scc: str, anchors: str) -> str:
    return f"""WITH RECURSIVE {scc}, anchors AS ({anchors}),
  keys AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS cluster_id FROM (SELECT DISTINCT key FROM anchors)),
  lines AS (SELECT u.msg, u.first, k.cluster_id FROM uniq u JOIN anchors a ON a.first = u.first JOIN keys k ON k.key = a.key)"""


def _rich(clusters: str, tokens=_tokens_sql, kinds: str = "0, 2, 3", chosen: str = "SELECT cluster_id, first FROM lines") -> str:
    """``chosen``: the lines that patterns are made from."""
    return f"""{clusters}, rich AS ({tokens('lines', 'first, cluster_id, msg', 'msg', RICH_SYMBOLS)}),
  chosen AS ({chosen}), sizes AS (SELECT cluster_id, count(*) AS n FROM chosen GROUP BY 1),
  common AS (SELECT cluster_id, slice FROM (SELECT DISTINCT cluster_id, first, slice FROM rich SEMI JOIN chosen USING (cluster_id, first) WHERE kind IN ({kinds})) JOIN sizes USING (cluster_id) GROUP BY cluster_id, slice, n HAVING count(*) = n),
  marked AS (SELECT r.*, c.slice IS NOT NULL AS lit, lag(c.slice IS NOT NULL, 1, true) OVER (PARTITION BY r.first ORDER BY r.pos) AS prev FROM rich r LEFT JOIN common c ON c.cluster_id = r.cluster_id AND c.slice = r.slice),
  shown AS (SELECT first, cluster_id, msg, string_agg(CASE WHEN lit THEN slice WHEN prev THEN '<*>' ELSE '' END, '' ORDER BY pos) AS template, string_agg(repeat(CASE WHEN lit THEN '0' ELSE '1' END, strlen(slice)), '' ORDER BY pos) AS mask FROM marked GROUP BY 1, 2, 3)"""


UNIQ = _uniq()
KEPT = OCC = CO = EDGES = _edges(UNIQ)
SCC = _scc(EDGES) + ", anchors AS (SELECT c.first, list(c.node ORDER BY c.node) AS key, max(c.n) AS n FROM comp c JOIN best b ON b.first = c.first AND b.n = c.n GROUP BY c.first)"
LARGEST = "SELECT c.first, list(c.node ORDER BY c.node) AS key FROM comp c JOIN best b ON b.first = c.first AND b.n = c.n GROUP BY c.first"
CLUSTERS = _clusters(_scc(EDGES), LARGEST)
RICH = _rich(CLUSTERS)

# Lines with special tokens, each a word of its own: machines, and what their sensors read.
SPECIAL = ParserConfig(symbols=".", special_whites=["Pump", "Valve"], special_blacks=[r"\d+\.\d+"])
MACHINES = """machines AS (
  SELECT o_orderkey AS idx, 'Pump p_' || o_custkey || ' turns at ' || o_orderkey || '.' || (o_custkey % 97) || ' in hall.north.p_' || (o_orderkey % 13) || ' row ' || (o_orderkey % 5) AS msg FROM orders
  UNION ALL SELECT p_partkey + 1000000000000, 'Valve v_' || p_size || ' reads ' || p_size || '.' || (p_partkey % 9) || ' bar' FROM part)"""


def machines(spark: SparkSession, sf: str) -> DataFrame:
    pumps = _table(spark, sf, "orders").selectExpr("o_orderkey AS idx", "concat('Pump p_', o_custkey, ' turns at ', o_orderkey, '.', o_custkey % 97, ' in hall.north.p_', o_orderkey % 13, ' row ', o_orderkey % 5) AS msg")
    return pumps.union(_table(spark, sf, "part").selectExpr("p_partkey + 1000000000000", "concat('Valve v_', p_size, ' reads ', p_size, '.', p_partkey % 9, ' bar')"))


def _special_tokens_sql(source: str, columns: str, text: str, symbols: str) -> str:
    """Tokens of lines whose special tokens are words of their own: they come before all others where both begin."""
    found = _tokens_sql(source, columns, text, symbols)
    for old, new in (("regexp_extract_all(" + text + ", '", "regexp_extract_all(" + text + ", '\\b(?:Pump|Valve)\\b|\\d+\\.\\d+|"), ("CAST(CASE WHEN", "CAST(CASE WHEN slice IN ('Pump', 'Valve') THEN 5 WHEN regexp_full_match(slice, '\\d+\\.\\d+') THEN 6 WHEN")):
        found = found.replace(old, new)
    return found


# The largest component and the white tokens; black ones count nowhere. Sorted by kind, then slice.
SPECIAL_ANCHORS = """SELECT first, list({'kind': CASE WHEN node IN ('Pump', 'Valve') THEN 5 ELSE 0 END, 'slice': node} ORDER BY CASE WHEN node IN ('Pump', 'Valve') THEN 5 ELSE 0 END, node) AS key FROM (
    SELECT c.first, c.node FROM comp c JOIN best b ON b.first = c.first AND b.n = c.n UNION SELECT first, slice FROM toks WHERE kind = 5) GROUP BY first"""
SPECIAL_RICH = _rich(_clusters(_scc(_edges(_uniq(MACHINES, "machines", _special_tokens_sql, "."), "0, 5")), SPECIAL_ANCHORS), _special_tokens_sql, "0, 2, 3, 5")
# Without edges every token is alone, and the one that comes last is the anchor.
LAST_ANCHOR = "SELECT first, [arg_max(slice, pos)] AS key FROM (SELECT first, slice, min(pos) AS pos FROM toks WHERE kind = 0 GROUP BY 1, 2) GROUP BY first"
NO_EDGES = _clusters(_edges(UNIQ, "0", 1.0), LAST_ANCHOR)
FLAGS = ParserConfig(threshold=0.8, filter_alphabetic=False, filter_numeric=True, filter_impure=True)
FLAG_LINES = "flags AS (SELECT p_partkey AS idx, 'part ' || p_size || ' of ' || p_brand || ' at ' || (p_partkey % 3) || ' brand-' || p_brand AS msg FROM part)"


def flag_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").selectExpr("p_partkey AS idx", "concat('part ', p_size, ' of ', p_brand, ' at ', p_partkey % 3, ' brand-', p_brand) AS msg")


# Sorted by kind, then slice.
FLAG_ANCHORS = """SELECT c.first, list({'kind': CASE WHEN regexp_full_match(c.node, '\\p{Nd}+') THEN 1 ELSE 4 END, 'slice': c.node} ORDER BY CASE WHEN regexp_full_match(c.node, '\\p{Nd}+') THEN 1 ELSE 4 END, c.node) AS key
    FROM comp c JOIN best b ON b.first = c.first AND b.n = c.n GROUP BY c.first"""
SAMPLE = 0.03
SAMPLED_LINES = f"""SELECT DISTINCT l.cluster_id, l.first FROM (
    SELECT g.msg, k.cluster_id, row_number() OVER (PARTITION BY k.cluster_id ORDER BY g.idx) - 1 AS pos, count(*) OVER (PARTITION BY k.cluster_id) AS n FROM logs g JOIN lines k ON k.msg = g.msg) p
    JOIN lines l ON l.msg = p.msg WHERE n <= 1 OR ceil(n * CAST({SAMPLE} AS DOUBLE)) >= n
      OR list_contains(list_transform(range(CAST(ceil(n * CAST({SAMPLE} AS DOUBLE)) AS BIGINT)), lambda i: CAST(floor(i * (CAST(n - 1 AS DOUBLE) / greatest(ceil(n * CAST({SAMPLE} AS DOUBLE)) - 1, 1)) + 0.5) AS BIGINT)), pos)"""


def _match_sql(msg: str, templates: list[str] | None = None) -> str:
    """A CASE that tries templates of up to three placeholders in the order of their ranks."""
    from .operators.matcher import compile_templates

    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = []
    for t in sorted(compile_templates(TEMPLATES if templates is None else templates), key=lambda t: (t.n_ph > 0, t.rank)):
        if t.template == "<*>":
            continue
        if not t.n_ph:
            out.append(f"WHEN {msg} = {q(t.template)} THEN {t.template_id}")
            continue
        first, *inner, last = t.template.split("<*>")
        rest, conds = f"substr({msg}, {len(first) + 1})", [f"starts_with({msg}, {q(first)})"]
        for p in inner:
            conds.append(f"strpos({rest}, {q(p)}) > 1")
            rest = f"substr({rest}, strpos({rest}, {q(p)}) + {len(p)})"
        conds += [f"ends_with({rest}, {q(last)})", f"length({rest}) > {len(last)}"]
        out.append(f"WHEN {' AND '.join(conds)} THEN {t.template_id}")
    return "CASE " + " ".join(out) + " ELSE -1 END"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return tokenized(distinct_lines(logs(spark, sf)), ParserConfig())


def _parsed(spark: SparkSession, sf: str):
    return LogParser().parse(logs(spark, sf))


def _exploded(df: DataFrame, tokens) -> DataFrame:
    return df.select("idx", F.posexplode(tokens).alias("pos", "t")).select("idx", F.col("pos").cast("long").alias("pos"), F.col("t.kind").cast("long").alias("kind"), "t.slice")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select(F.col("page_id").alias("idx"), F.col("url").alias("msg"))


def _special(pattern: str) -> Query:
    return lambda s, d: _exploded(logs(s, d), F.filter(pre_tokens(F.col("msg"), ParserConfig(special_blacks=[pattern])), lambda t: t["slice"] != ""))


def _special_sql(pattern: str) -> str:
    return f"""WITH {LOGS}, cut AS (SELECT idx, string_split_regex(msg, '{pattern}') AS s, regexp_extract_all(msg, '{pattern}') AS h FROM logs),
      pieces AS (SELECT idx, unnest(s) AS slice, generate_subscripts(s, 1) * 2 AS i, -1 AS kind FROM cut UNION ALL SELECT idx, unnest(h), generate_subscripts(h, 1) * 2 + 1, 6 FROM cut)
      SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY i) - 1 AS pos, CAST(kind AS BIGINT) AS kind, slice FROM pieces WHERE slice <> ''"""


def _flagged(spark: SparkSession, sf: str):
    return LogParser(FLAGS).parse(flag_lines(spark, sf))


def _by_way(templates: list[str]) -> Query:
    return lambda s, d: TemplateMatcher(s, templates).match_ids(logs(s, d)).select("idx", F.col("template_id").cast("long").alias("template_id"))


WAYS = {
    "match_exact": ["0 42", "order 1 cust=1 status=O prio=5-LOW", "4 42", "nothing"],
    "match_prefix": ["order <*>", "order 1<*>", "user <*> did click props <*>", "part <*> brand=<*>5<*>"],
    "match_suffix": ["<*>-URGENT", "<*>5-LOW", "<*> 42", "<*>=F prio=<*>-HIGH"],
    "match_middle": ["<*> did <*>", "<*> did click <*>", "<*>=O<*>", "<*> cust=<*> status=<*>"],
}


def _read_back(spark: SparkSession, sf: str) -> DataFrame:
    """A text file of this query's own, with blank lines and carriage returns, read line by line."""
    path = f"{shared_dir(spark)}/loomline-text-{uuid.uuid4().hex}"
    lines = _table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN concat(c_name, ' ', c_mktsegment, '\r') ELSE c_name END AS value")
    lines.repartitionByRange(1, "c_custkey").sortWithinPartitions("c_custkey").select("value").write.option("lineSep", "\n").text(path)
    return read_lines(spark, path)


def _tokenized_sql(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    return logs(spark, sf).select("idx", F.expr("log_tokenize(msg)").alias("t")).select("idx", F.posexplode("t").alias("pos", "slice")).withColumn("pos", F.col("pos").cast("long"))


def _encoded_ids(spark: SparkSession, sf: str) -> DataFrame:
    codec = CorpusCodec.fit(logs(spark, sf))
    more = logs(spark, sf).union(_table(spark, sf, "nation").select(F.col("n_nationkey") + 4 * 10**12, "n_name"))  # lines that no code is known of
    return codec.encode_ids(more).join(codec.templates, "template_id", "left").select("idx", "template")


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos")).where(is_sampled(F.col("pos"), F.col("n"), 0.3)).select("o_custkey", "pos")


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return TemplateMatcher(spark, TEMPLATES).match_ids(logs(spark, sf)).select("idx", F.col("template_id").cast("long").alias("template_id"))


def _matched_args(spark: SparkSession, sf: str) -> DataFrame:
    found = TemplateMatcher(spark, ["order <*> prio=<*>", "user <*> did <*>"]).match(logs(spark, sf)).where("template_id >= 0")
    return found.select("idx", F.col("template_id").cast("long").alias("template_id"), F.element_at("args", 1).alias("arg1"), F.element_at("args", 2).alias("arg2"))


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    codec = CorpusCodec.fit(logs(spark, sf))
    found = codec.encode(logs(spark, sf)).join(codec.templates, "template_id")
    return found.select("idx", "template", F.size("args").cast("long").alias("n_args"), F.array_join("args", "|").alias("args"))


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    codec = CorpusCodec.fit(logs(spark, sf))
    return codec.decode(codec.encode(logs(spark, sf)).drop("msg")).select("idx", "msg")


def _compiled(spark: SparkSession, sf: str) -> DataFrame:
    t = TemplateMatcher.from_template_sets(spark, LogParser().parse(logs(spark, sf)).templates).table
    return t.select("template", F.col("n_ph").cast("long").alias("n_ph"), F.col("literal_bytes").cast("long").alias("literal_bytes"), F.col("min_len").cast("long").alias("min_len"), F.col("rank").cast("long").alias("rank"))


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("p_name", F.repeat(F.lit("<*>"), F.col("p_size") % 4), "p_type", F.lit("<*><*>"))
    return _table(spark, sf, "part").select("p_partkey", normalize_template(text).alias("template"))


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "part").withColumn("args", F.filter(F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type"))), lambda x: x.isNotNull()))
    return t.select("p_partkey", decode(template_parts(F.lit("brand <*> of <*>.")), F.col("args")).alias("msg"))


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/loomline-stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(_table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    lines = source.select(F.col("event_id").alias("idx"), F.concat_ws(" ", F.lit("user"), "user_id", F.lit("did"), "event_type", F.lit("props"), "props").alias("msg"))
    q = match_stream(lines, TemplateMatcher(spark, TEMPLATES)).select("idx", F.col("template_id").cast("long").alias("template_id")).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def queries() -> dict[str, Query]:
    default, rich = ParserConfig(), ParserConfig(symbols=URL_SYMBOLS)
    long = lambda c: F.col(c).cast("long").alias(c)
    return {
        "dedup_weighted": lambda s, d: distinct_lines(short(s, d)),
        "tokenize_default": lambda s, d: _exploded(logs(s, d), tokenize(F.col("msg"), default)),
        "tokenize_rich": lambda s, d: _exploded(logs(s, d), tokenize(F.col("msg"), default, rich=True)),
        "tokenize_custom_symbols": lambda s, d: _exploded(_pages(s, d), tokenize(F.col("msg"), rich)),
        "token_kind_histogram": lambda s, d: _table(s, d, "documents").select(F.explode(tokenize(F.col("text"), default)).alias("t")).groupBy(F.col("t.kind").cast("long").alias("kind")).agg(F.count("*").alias("n")),
        "token_counts": lambda s, d: logs(s, d).select("idx", F.size(tokenize(F.col("msg"), default)).cast("long").alias("n")),
        "special_split_literal": _special("did"),
        "special_split_regex": _special("[0-9]+"),
        "token_occurrence": lambda s, d: occurrences(_lines(s, d)),
        "token_cooccurrence": lambda s, d: co_occurrences(_lines(s, d)),
        "dependency_edges": lambda s, d: dependencies(_lines(s, d), 0.5),
        "row_nodes": lambda s, d: row_nodes(_lines(s, d), default).select("first", F.explode("nodes").alias("t")).select("first", "t.slice"),
        "largest_scc_size": lambda s, d: _parsed(s, d).lines.where(F.size("anchors") > 0).select("first", F.size("anchors").cast("long").alias("n")),
        "anchors": lambda s, d: _parsed(s, d).lines.select("first", F.explode("anchors").alias("t")).select("first", "t.slice"),
        "cluster_assign": lambda s, d: _parsed(s, d).clusters.select("idx", long("cluster_id")),
        "cluster_sizes": lambda s, d: _parsed(s, d).clusters.groupBy(long("cluster_id")).agg(F.count("*").alias("n")),
        "unclustered": lambda s, d: _parsed(s, d).clusters.where("cluster_id = -1").select("idx"),
        "common_slices": lambda s, d: _parsed(s, d).common.select(long("cluster_id"), F.explode("common").alias("slice")),
        "templates": lambda s, d: _parsed(s, d).templates.select(long("cluster_id"), F.explode("templates").alias("template")),
        "masks": lambda s, d: _parsed(s, d).masks.select("idx", F.col("mask")),
        "sample_positions": _sampled,
        "template_normalize": _normalized,
        "template_compile_rank": _compiled,
        "match_ids": _matched,
        "match_args": _matched_args,
        "codec_encode": _coded,
        "codec_decode": _decoded,
        "codec_roundtrip": _round_trip,
        "regex_union_filter": lambda s, d: logs(s, d).where(F.col("msg").rlike(union_pattern("^order [0-9]+ cust=1", "click", "LOW$").java)),
        "stream_match": _streamed,
        **{name: _by_way(templates) for name, templates in WAYS.items()},
        "special_tokens": lambda s, d: _exploded(machines(s, d), tokenize(F.col("msg"), SPECIAL)),
        "special_clusters": lambda s, d: LogParser(SPECIAL).parse(machines(s, d)).clusters.select("idx", long("cluster_id")),
        "special_templates": lambda s, d: LogParser(SPECIAL).parse(machines(s, d)).templates.select(long("cluster_id"), F.explode("templates").alias("template")),
        "special_masks": lambda s, d: LogParser(SPECIAL).parse(machines(s, d)).masks.select("idx", "mask"),
        "flags_edges": lambda s, d: dependencies(tokenized(distinct_lines(flag_lines(s, d)), FLAGS), FLAGS.threshold),
        "flags_templates": lambda s, d: _flagged(s, d).templates.select(long("cluster_id"), F.explode("templates").alias("template")),
        "scc_tie": lambda s, d: LogParser(ParserConfig(threshold=1)).parse(logs(s, d)).clusters.select("idx", long("cluster_id")),
        "sampled_templates": lambda s, d: LogParser(ParserConfig(pattern_sample=SAMPLE)).parse(logs(s, d)).templates.select(long("cluster_id"), F.explode("templates").alias("template")),
        "sampled_masks": lambda s, d: LogParser(ParserConfig(pattern_sample=SAMPLE)).parse(logs(s, d)).masks.select("idx", "mask"),
        "encode_ids": _encoded_ids,
        "text_source": _read_back,
        "sql_tokenize": _tokenized_sql,
    }


def oracle_sql() -> dict[str, str]:
    idx_tokens = lambda src, symbols: f"WITH {LOGS} {_tokens_sql(src, 'idx', 'msg', symbols)}"
    return {
        "dedup_weighted": f"WITH {SHORT} SELECT msg, count(*) AS w, min(idx) AS first FROM short GROUP BY msg",
        "tokenize_default": idx_tokens("logs", DEFAULT_SYMBOLS),
        "tokenize_rich": idx_tokens("logs", RICH_SYMBOLS),
        "tokenize_custom_symbols": f"WITH p AS (SELECT page_id AS idx, url AS msg FROM pages) {_tokens_sql('p', 'idx', 'msg', URL_SYMBOLS)}",
        "token_kind_histogram": f"SELECT kind, count(*) AS n FROM ({_tokens_sql('documents', 'doc_id', 'text', DEFAULT_SYMBOLS)}) GROUP BY kind",
        "token_counts": f"WITH {LOGS} SELECT idx, CAST(len(regexp_extract_all(msg, '[{WHITE}{_cls(DEFAULT_SYMBOLS)}]|[^{WHITE}{_cls(DEFAULT_SYMBOLS)}]+')) AS BIGINT) AS n FROM logs",
        "special_split_literal": _special_sql("did"),
        "special_split_regex": _special_sql("[0-9]+"),
        "token_occurrence": f"WITH {OCC} SELECT slice, CAST(occ AS BIGINT) AS occ FROM occ",
        "token_cooccurrence": f"WITH {CO} SELECT a, b, CAST(co AS BIGINT) AS co FROM co",
        "dependency_edges": f"WITH {EDGES} SELECT a, b, CAST(co AS BIGINT) AS co, CAST(occ_a AS BIGINT) AS occ_a, CAST(occ_b AS BIGINT) AS occ_b, ab, ba FROM edges",
        "row_nodes": f"WITH {KEPT} SELECT first, slice FROM kept",
        "largest_scc_size": f"WITH RECURSIVE {SCC} SELECT first, CAST(n AS BIGINT) AS n FROM best",
        "anchors": f"WITH RECURSIVE {SCC} SELECT first, unnest(key) AS slice FROM anchors",
        "cluster_assign": f"{CLUSTERS} SELECT g.idx, CAST(coalesce(l.cluster_id, -1) AS BIGINT) AS cluster_id FROM logs g LEFT JOIN lines l ON l.msg = g.msg",
        "cluster_sizes": f"{CLUSTERS} SELECT CAST(coalesce(l.cluster_id, -1) AS BIGINT) AS cluster_id, count(*) AS n FROM logs g LEFT JOIN lines l ON l.msg = g.msg GROUP BY 1",
        "unclustered": f"{CLUSTERS} SELECT g.idx FROM logs g LEFT JOIN lines l ON l.msg = g.msg WHERE l.msg IS NULL",
        "common_slices": f"{RICH} SELECT CAST(cluster_id AS BIGINT) AS cluster_id, slice FROM common",
        "templates": f"{RICH} SELECT DISTINCT CAST(cluster_id AS BIGINT) AS cluster_id, template FROM shown",
        "masks": f"{RICH} SELECT g.idx, coalesce(s.mask, '') AS mask FROM logs g LEFT JOIN shown s ON s.msg = g.msg",
        "sample_positions": """WITH n AS (SELECT o_custkey, count(*) AS n, CAST(ceil(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS k FROM orders GROUP BY 1)
          SELECT DISTINCT o_custkey, CAST(CASE WHEN k >= n THEN i WHEN k = 1 THEN 0 ELSE floor(i * (CAST(n - 1 AS DOUBLE) / (k - 1)) + 0.5) END AS BIGINT) AS pos
          FROM (SELECT *, unnest(range(k)) AS i FROM n)""",
        "template_normalize": "SELECT p_partkey, regexp_replace(p_name || repeat('<*>', p_size % 4) || p_type || '<*><*>', '(<\\*>){2,}', '<*>', 'g') AS template FROM part",
        "template_compile_rank": f"""{RICH}, d AS (SELECT template, min(cluster_id) AS c FROM shown GROUP BY template), i AS (SELECT template, row_number() OVER (ORDER BY c, template) AS id FROM d),
          m AS (SELECT template, id, CAST(len(string_split(template, '<*>')) - 1 AS BIGINT) AS n_ph, CAST(strlen(replace(template, '<*>', '')) AS BIGINT) AS literal_bytes FROM i)
          SELECT template, n_ph, literal_bytes, n_ph + literal_bytes AS min_len, row_number() OVER (ORDER BY literal_bytes DESC, n_ph, id) - 1 AS rank FROM m""",
        "match_ids": f"WITH {LOGS} SELECT idx, CAST({_match_sql('msg')} AS BIGINT) AS template_id FROM logs",
        "match_args": f"""WITH {LOGS}, o AS (SELECT idx, 0 AS template_id, substr(msg, 7) AS r, ' prio=' AS l FROM logs WHERE starts_with(msg, 'order ') UNION ALL SELECT idx, 1, substr(msg, 6), ' did ' FROM logs WHERE starts_with(msg, 'user '))
          SELECT idx, CAST(template_id AS BIGINT) AS template_id, substr(r, 1, strpos(r, l) - 1) AS arg1, substr(r, strpos(r, l) + length(l)) AS arg2 FROM o WHERE strpos(r, l) > 1 AND length(r) >= strpos(r, l) + length(l)""",
        "codec_encode": f"""{RICH}, runs AS (SELECT *, sum(CASE WHEN NOT lit AND prev THEN 1 ELSE 0 END) OVER (PARTITION BY first ORDER BY pos) AS run FROM marked),
          args AS (SELECT first, msg, run, string_agg(slice, '' ORDER BY pos) AS arg FROM runs WHERE NOT lit GROUP BY 1, 2, 3),
          per AS (SELECT msg, count(*) AS n, string_agg(arg, '|' ORDER BY run) AS args FROM args GROUP BY msg)
          SELECT g.idx, coalesce(s.template, g.msg) AS template, CAST(coalesce(p.n, 0) AS BIGINT) AS n_args, coalesce(p.args, '') AS args FROM logs g LEFT JOIN shown s ON s.msg = g.msg LEFT JOIN per p ON p.msg = g.msg""",
        "codec_decode": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'brand ' || p_brand || ' of ' || p_type || '.' END AS msg FROM part",
        "codec_roundtrip": f"WITH {LOGS} SELECT idx, msg FROM logs",
        **{name: f"WITH {LOGS} SELECT idx, CAST({_match_sql('msg', templates)} AS BIGINT) AS template_id FROM logs" for name, templates in WAYS.items()},
        "stream_match": f"SELECT event_id AS idx, CAST({_match_sql('msg')} AS BIGINT) AS template_id FROM (SELECT event_id, concat_ws(' ', 'user', user_id, 'did', event_type, 'props', props) AS msg FROM events)",
        "special_tokens": f"WITH {MACHINES} {_special_tokens_sql('machines', 'idx', 'msg', '.')}",
        "special_clusters": f"{SPECIAL_RICH} SELECT g.idx, CAST(coalesce(l.cluster_id, -1) AS BIGINT) AS cluster_id FROM machines g LEFT JOIN lines l ON l.msg = g.msg",
        "special_templates": f"{SPECIAL_RICH} SELECT DISTINCT CAST(cluster_id AS BIGINT) AS cluster_id, template FROM shown",
        "special_masks": f"{SPECIAL_RICH} SELECT g.idx, coalesce(s.mask, '') AS mask FROM machines g LEFT JOIN shown s ON s.msg = g.msg",
        "flags_edges": f"WITH {_edges(_uniq(FLAG_LINES, 'flags'), '1, 4', 0.8)} SELECT a, b, CAST(co AS BIGINT) AS co, CAST(occ_a AS BIGINT) AS occ_a, CAST(occ_b AS BIGINT) AS occ_b, ab, ba FROM edges",
        "flags_templates": f"{_rich(_clusters(_scc(_edges(_uniq(FLAG_LINES, 'flags'), '1, 4', 0.8)), FLAG_ANCHORS), kinds='1, 2, 3, 4')} SELECT DISTINCT CAST(cluster_id AS BIGINT) AS cluster_id, template FROM shown",
        "scc_tie": f"{NO_EDGES} SELECT g.idx, CAST(coalesce(l.cluster_id, -1) AS BIGINT) AS cluster_id FROM logs g LEFT JOIN lines l ON l.msg = g.msg",
        "sampled_templates": f"{_rich(CLUSTERS, chosen=SAMPLED_LINES)} SELECT DISTINCT CAST(cluster_id AS BIGINT) AS cluster_id, template FROM shown SEMI JOIN chosen USING (cluster_id, first)",
        "sampled_masks": f"{_rich(CLUSTERS, chosen=SAMPLED_LINES)} SELECT g.idx, coalesce(s.mask, '') AS mask FROM logs g LEFT JOIN shown s ON s.msg = g.msg",
        "encode_ids": f"{RICH} SELECT g.idx, coalesce(s.template, g.msg) AS template FROM logs g LEFT JOIN shown s ON s.msg = g.msg UNION ALL SELECT n_nationkey + 4000000000000, NULL FROM nation",
        "text_source": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN c_name || ' ' || c_mktsegment ELSE c_name END AS msg FROM customer",
        "sql_tokenize": f"SELECT idx, pos, slice FROM ({idx_tokens('logs', DEFAULT_SYMBOLS)})",
        "regex_union_filter": f"WITH {LOGS} SELECT idx, msg FROM logs WHERE regexp_matches(msg, '(?:^order [0-9]+ cust=1)|(?:click)|(?:LOW$)')",
    }
