"""Tokens of a message as a column: an array of structs of kind and slice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALPHABETIC, IMPURE, NUMERIC, RICH_SYMBOLS, SPECIAL_BLACK, SPECIAL_WHITE, SYMBOLIC, WHITESPACE, ParserConfig
from .regexes import Pattern, compile_pattern

#: Unicode white space, inside brackets.
WHITE = r"\x09-\x0D\x{85}\p{Z}"
UNREFINED = -1
TOKENS = "array<struct<kind:tinyint,slice:string>>"


def char_class(symbols: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in sorted(set(symbols)))


def _token(kind: Column, text: Column) -> Column:
    return F.struct(kind.cast("tinyint").alias("kind"), text.alias("slice"))


def kind_of(text: Column, symbols: str) -> Column:
    """The kind of a slice that ``split_plain`` made."""
    out = F.when(text.rlike(rf"\A[{WHITE}]\z"), F.lit(WHITESPACE))
    if symbols:
        out = out.when(text.rlike(rf"\A[{char_class(symbols)}]\z"), F.lit(SYMBOLIC))
    return out.when(text.rlike(r"\A\p{L}+\z"), F.lit(ALPHABETIC)).when(text.rlike(r"\A\p{Nd}+\z"), F.lit(NUMERIC)).otherwise(F.lit(IMPURE))


def split_plain(text: Column, symbols: str) -> Column:
    """White space and symbols are tokens of one character; what lies between is one token."""
    edge = WHITE + char_class(symbols)
    found = F.regexp_extract_all(text, F.lit(f"[{edge}]|[^{edge}]+"), F.lit(0))
    return F.transform(found, lambda s: _token(kind_of(s, symbols), s))


def _split_by(text: Column, pattern: Pattern, kind: int) -> Column:
    """Matches of a plain pattern, and what lies between."""
    java = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in pattern.source) if pattern.literal else pattern.java
    hits = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    both = F.transform(F.split(text, java, -1), lambda s, i: F.array(_token(F.lit(UNREFINED), s), _token(F.lit(kind), F.get(hits, i))))
    return F.filter(F.flatten(both), lambda t: t["slice"] != "")


def _refine(pattern: Pattern, kind: int):
    return lambda t: F.when(t["kind"] == UNREFINED, _split_by(t["slice"], pattern, kind)).otherwise(F.array(t))


def _spans(text: str, match) -> Iterator[tuple[int, int, int]]:
    """Where each search begins, and the match it finds in what is left of the text from there. An empty match ends a
    search, and the next begins one character after it."""
    begin = 0
    while begin <= len(text) and (found := match(text[begin:])):
        a, b = (begin + x for x in found.span())
        if a < b:
            yield begin, a, b
        elif a == len(text):
            return
        begin = b if a < b else a + 1


def split_loop(text: str, match, kind: int) -> list[tuple[int, str]]:
    """Matches found in what is left, again and again, so that anchors hold anew after each. What the search that finds
    a match begins with is kept before it; what empty matches passed over is lost, unless no longer match follows."""
    spans = list(_spans(text, match))
    if not spans:
        return [(UNREFINED, text)]
    pieces = [piece for begin, a, b in spans for piece in ((UNREFINED, text[begin:a]), (kind, text[a:b]))]
    rest, end = len(text), spans[-1][2]
    while end <= rest and (found := match(text[end:])) and end + found.start() < rest:  # only empty ones are left
        end += found.start() + 1
    pieces.append((UNREFINED, text[end:]))
    return [p for p in pieces if p[1]]


def _loop_udf(stages: list[tuple[Pattern, int]]):
    """All special patterns by the loop, for those that look at their place or match nothing."""

    @F.pandas_udf("array<struct<kind:tinyint,slice:string>>")
    def run(texts: pd.Series) -> pd.Series:
        import regex

        matches = [(regex.compile(p.python, regex.ASCII | regex.VERSION0).search, k) for p, k in stages]

        def one(text):
            if text is None:
                return None
            parts = [(UNREFINED, text)]
            for match, kind in matches:
                parts = [q for p in parts for q in (split_loop(p[1], match, kind) if p[0] == UNREFINED else (p,))]
            return [{"kind": k, "slice": s} for k, s in parts]

        return texts.map(one)

    return run


def pre_tokens(text: Column, config: ParserConfig) -> Column:
    """Special tokens, and between them what isn't refined yet (kind -1). White patterns come before black ones, and
    earlier ones before later ones."""
    stages = [(compile_pattern(p), SPECIAL_WHITE) for p in config.special_whites] + [(compile_pattern(p), SPECIAL_BLACK) for p in config.special_blacks]
    if any(not p.plain for p, _ in stages):
        return _loop_udf(stages)(text)
    parts = F.array(_token(F.lit(UNREFINED), text))
    for pattern, kind in stages:
        parts = F.flatten(F.transform(parts, _refine(pattern, kind)))
    return parts


def tokenize(text: Column, config: ParserConfig, rich: bool = False) -> Column:
    """The tokens of a message; ``rich``: with all ASCII punctuation as symbols, whatever the configured ones. A null
    message gives null, an empty one no tokens."""
    symbols = RICH_SYMBOLS if rich else config.symbols
    if not (config.special_whites or config.special_blacks):
        return split_plain(text, symbols)
    return F.flatten(F.transform(pre_tokens(text, config), lambda t: F.when(t["kind"] == UNREFINED, split_plain(t["slice"], symbols)).otherwise(F.array(t))))


def rich_slices(text: Column, config: ParserConfig) -> Column:
    """The slices of the rich tokens, whose kinds aren't looked at."""
    edge = WHITE + char_class(RICH_SYMBOLS)
    cut = lambda s: F.regexp_extract_all(s, F.lit(f"[{edge}]|[^{edge}]+"), F.lit(0))
    if not (config.special_whites or config.special_blacks):
        return cut(text)
    return F.flatten(F.transform(pre_tokens(text, config), lambda t: F.when(t["kind"] == UNREFINED, cut(t["slice"])).otherwise(F.array(t["slice"]))))


def is_reducible(config: ParserConfig) -> bool:
    """Whether tokens that aren't candidates can be told from their own text. A literal white pattern leaves its text
    nowhere else; what other ones find may stand elsewhere as a token of another kind."""
    whites, blacks = map(compile_pattern, config.special_whites), map(compile_pattern, config.special_blacks)
    return not config.filter_impure and set(config.symbols) <= set(RICH_SYMBOLS) and all(p.literal for p in whites) and all(p.plain for p in blacks)


def shape_of(text: Column, config: ParserConfig) -> Column:
    """The line with one and the same word in place of each token that can be neither an anchor nor a literal: special
    tokens, and between them what isn't refined yet. Lines of one shape have the same anchors, and templates."""
    parts = pre_tokens(text, config)
    if is_reducible(config):
        edge, kept = WHITE + char_class(RICH_SYMBOLS), config.kept_kinds
        word = "|".join(c for kind, c in ((ALPHABETIC, r"\p{L}++"), (NUMERIC, r"\p{Nd}++")) if kind in kept) or "[^\\s\\S]"
        other = rf"(?<![^{edge}])(?!(?:{word})(?![^{edge}]))[^{edge}]++"
        instead = F.lit(next(x for n in range(len(config.special_whites) + 1) if (x := "0" + "x" * (n + 1)) not in config.special_whites))
        if not (config.special_whites or config.special_blacks):
            parts = F.array(_token(F.lit(UNREFINED), F.regexp_replace(text, F.lit(other), instead)))
        else:
            # A black token's text may be a candidate's elsewhere.
            same = lambda s: kind_of(s, config.symbols).isin(*config.common_kinds) | kind_of(s, RICH_SYMBOLS).isin(*config.common_kinds)
            short = lambda t: F.when(t["kind"] == UNREFINED, F.regexp_replace(t["slice"], F.lit(other), instead)).when((t["kind"] == SPECIAL_BLACK) & ~same(t["slice"]), instead).otherwise(t["slice"])
            parts = F.transform(parts, lambda t: _token(t["kind"], short(t)))
    return F.when(text.isNotNull(), parts)


def of_shape(shape: Column, symbols: str) -> Column:
    """The tokens of a shape."""
    return F.flatten(F.transform(shape, lambda t: F.when(t["kind"] == UNREFINED, split_plain(t["slice"], symbols)).otherwise(F.array(t))))


def of_kinds(tokens: Column, kinds: tuple[int, ...]) -> Column:
    return F.filter(tokens, lambda t: t["kind"].isin(*kinds))


def slices(tokens: Column) -> Column:
    """The distinct slices of tokens, in order of appearance."""
    return F.array_distinct(F.transform(tokens, lambda t: t["slice"]))
