"""Anchors: the largest strongly connected component of a line's dependency graph."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SPECIAL_BLACK, SPECIAL_WHITE, ParserConfig
from ..functions.tokens import of_kinds, slices
from ..plans.tables import BROADCAST, sent, stored
from .stats import dependencies, occurrences


def _leaving_order(n: int, out: list[list[int]]) -> list[int]:
    """Nodes in order of when a depth-first walk leaves them: roots and neighbours in ascending order."""
    left: list[int] = []
    state = [0] * n  # the next neighbour to look at; -1 once left
    path: list[int] = []
    entered = [False] * n
    for root in range(n):
        if not entered[root]:
            entered[root] = True
            path.append(root)
        while path:
            node = path[-1]
            onward = next((k for k in range(state[node], len(out[node])) if not entered[out[node][k]]), None)
            if onward is None:
                left.append(path.pop())
            else:
                state[node] = onward + 1
                entered[out[node][onward]] = True
                path.append(out[node][onward])
    return left


def largest_component(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """Nodes of the largest strongly connected component of nodes 0..n-1; of several, the one that has the node which
    the walk leaves last. That node belongs to a component that is complete once all that reaches it is collected, so
    components come in that order."""
    out, back = [[] for _ in range(n)], [set() for _ in range(n)]
    for a, b in sorted(set(edges)):
        out[a].append(b)
        back[b].add(a)
    best: set[int] = set()
    free = set(range(n))
    for root in reversed(_leaving_order(n, out)):
        if root not in free:
            continue
        reach, fresh = {root}, {root}
        while fresh:
            fresh = set().union(*(back[x] for x in fresh)) & free - reach
            reach |= fresh
        free -= reach
        if len(reach) > len(best):
            best = reach
    return sorted(best)


@cache
def _component_udf():
    """``largest_component`` of rows with edges, each written as src * n + dst, in order; without any, every node is
    alone and the last one is first in order. Lines of one shape have one graph, so answers are kept for a while."""

    def run(n: pd.Series, edges: pd.Series) -> pd.Series:
        known: dict[tuple[int, bytes], list[int]] = {}

        def one(k: int, e) -> list[int]:
            if e is None or not len(e):
                return [k - 1]
            key = (k, e.tobytes())
            if key not in known:
                known[key] = largest_component(k, [divmod(x, k) for x in e.tolist()])
            return known[key]

        return pd.Series([one(k, e) for k, e in zip(n, edges, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<int>")


def row_nodes(lines: DataFrame, config: ParserConfig) -> DataFrame:
    """``lines`` with nodes: the distinct tokens, in order, whose slice counts somewhere in the corpus."""
    if not (config.special_whites or config.special_blacks):
        # The kind follows from the slice, so that what counts here counts everywhere.
        return lines.withColumn("nodes", F.array_distinct(of_kinds(F.col("tokens"), config.kept_kinds)))
    # What counts by its kind is there anyway; of the rest, only what counts elsewhere leaves its place.
    counted = sent(stored(occurrences(lines).select(F.col("slice").alias("s")), "counted"), F.octet_length("s") + 32)
    rest = lines.select("first", F.explode(slices(F.filter("tokens", lambda t: ~t["kind"].isin(*config.kept_kinds)))).alias("s"))
    hits = rest.join(counted, "s", "left_semi").groupBy("first").agg(F.collect_list("s").alias("_hits"))
    nodes = F.filter(F.array_distinct("tokens"), lambda t: t["kind"].isin(*config.kept_kinds) | F.coalesce(F.array_contains("_hits", t["slice"]), F.lit(False)))
    return lines.join(hits, "first", "left").withColumn("nodes", nodes).drop("_hits")


def with_anchors(lines: DataFrame, config: ParserConfig) -> DataFrame:
    """``lines`` (w, first, tokens, kept; a written table) with anchors: sorted structs of kind and slice, empty
    where none.

    Edges are written once. Where few tokens depend on others the edges are broadcast, and pairs of a line's nodes meet
    them without a shuffle; otherwise nodes that no edge has are dropped before pairs are made.
    """
    edges = stored(dependencies(lines, config.threshold).select("a", "b", "ab", "ba"), "edges")
    size = edges.agg(F.coalesce(F.sum(F.octet_length("a") + F.octet_length("b") + 64), F.lit(0))).first()[0]
    nodes = row_nodes(lines, config).select("first", "tokens", "nodes")
    each = nodes.select("first", F.posexplode("nodes").alias("i", "t"), "nodes").select("first", F.size("nodes").alias("n"), "i", F.col("t.slice").alias("s"), "nodes")
    if size <= BROADCAST:
        edges = F.broadcast(edges)
    else:
        live = edges.select(F.col("a").alias("s")).union(edges.select("b")).distinct()
        each = each.drop("nodes").join(live, "s", "left_semi")
        each = each.join(each.groupBy("first").agg(F.collect_list(F.struct("i", "s")).alias("rest")), "first")  # at most one line's
    if size <= BROADCAST:
        other = each.select("first", "n", "i", "s", F.posexplode("nodes").alias("j", "u")).select("first", "n", "i", "s", "j", F.col("u.slice").alias("u"))
    else:
        other = each.select("first", "n", "i", "s", F.explode("rest").alias("x")).select("first", "n", "i", "s", F.col("x.i").alias("j"), F.col("x.s").alias("u"))
    pairs = other.where("i < j").select("first", "n", "i", "j", F.least("s", "u").alias("a"), F.greatest("s", "u").alias("b"), (F.col("s") <= F.col("u")).alias("up"))
    hit = pairs.join(edges, ["a", "b"])
    forth, back = F.when(F.col("up"), F.col("ab")).otherwise(F.col("ba")), F.when(F.col("up"), F.col("ba")).otherwise(F.col("ab"))
    n = F.col("n").cast("long")
    ways = F.array(F.when(forth, F.col("i") * n + F.col("j")), F.when(back, F.col("j") * n + F.col("i")))
    graph = hit.select("first", F.explode(F.filter(ways, lambda e: e.isNotNull())).alias("e")).groupBy("first").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    found = nodes.join(graph, "first", "left").withColumn("_in", F.when(F.size("nodes") > 0, _component_udf()(F.size("nodes"), F.col("edges"))))
    own = F.coalesce(F.transform("_in", lambda i: F.get("nodes", i)), F.array().cast("array<struct<kind:tinyint,slice:string>>"))
    if config.special_whites or config.special_blacks:
        white, black = of_kinds(F.col("tokens"), (SPECIAL_WHITE,)), of_kinds(F.col("tokens"), (SPECIAL_BLACK,))
        own = F.when(F.size("nodes") > 0, F.array_except(F.array_union(own, white), black)).otherwise(own)
    return lines.join(found.select("first", "nodes", F.array_sort(own).alias("anchors")), "first")
