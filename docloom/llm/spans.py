"""Regex spans with code-point offsets, from built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern gives the gaps between
them; running totals of both lengths are the offsets. Both functions drive the same matcher, so
matches and gaps always agree. Patterns must not match the empty string.

Running totals are summed in blocks of ``BLOCK`` items, whose totals are summed in blocks again, so the work for a text
grows in proportion to its matches; neighbours of a span are cut from pieces of ``PIECE`` characters, never from the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,hit:string>"
BLOCK = 128
PIECE = 1024


def quoted(pattern: str) -> str:
    """A raw SQL string literal (patterns hold both kinds of quotes, so escape rather than r'')."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_spans(df: DataFrame, text: str, found: dict[str, str]) -> DataFrame:
    """Add a column array<struct<start,end,hit>> for each name -> pattern; extra columns are prefixed __."""
    df = df.select("*", *(F.expr(f"regexp_extract_all({text}, {quoted(p)}, 0)").alias(f"__h_{n}") for n, p in found.items()))
    # The second scan of the text runs only for rows with a match.
    df = df.select("*", *(F.expr(f"CASE WHEN size(__h_{n}) > 0 THEN split({text}, {quoted(p)}, -1) END").alias(f"__g_{n}") for n, p in found.items()))
    # Item i is gap i with match i.
    df = df.select("*", *(F.expr(f"CASE WHEN size(__h_{n}) > 0 THEN transform(__h_{n}, (h, i) -> length(h) + length(__g_{n}[i])) END").alias(f"__l0_{n}") for n in found))
    for level in (1, 2):
        df = df.select("*", *(F.expr(_blocks(f"__l{level - 1}_{n}")).alias(f"__l{level}_{n}") for n in found))
    df = df.select("*", *(F.expr(f"transform(__l2_{n}, (x, i) -> aggregate(slice(__l2_{n}, 1, i), 0, (t, y) -> t + y))").alias(f"__t2_{n}") for n in found))
    for level in (1, 0):
        df = df.select("*", *(F.expr(_totals(f"__l{level}_{n}", f"__t{level + 1}_{n}")).alias(f"__t{level}_{n}") for n in found))
    df = df.select("*", *(F.expr(_offsets(n)).alias(n) for n in found))
    return df.drop(*(f"__{k}_{n}" for n in found for k in ("h", "g", "l0", "l1", "l2", "t0", "t1", "t2")))


def _blocks(items: str) -> str:
    """Sums of BLOCK items each."""
    return f"transform(sequence(0, (size({items}) - 1) div {BLOCK}), k -> aggregate(slice({items}, cast(k * {BLOCK} + 1 AS int), {BLOCK}), 0, (t, y) -> t + y))"


def _totals(items: str, starts: str) -> str:
    """The sum of the items before each; starts: the sums before each block."""
    return (
        f"flatten(transform({starts}, (s, k) -> transform(slice({items}, k * {BLOCK} + 1, {BLOCK}), "
        f"(x, i) -> s + aggregate(slice({items}, k * {BLOCK} + 1, i), 0, (t, y) -> t + y))))"
    )


def _offsets(n: str) -> str:
    start = f"__t0_{n}[i] + length(__g_{n}[i])"
    return (
        f"CASE WHEN size(__h_{n}) > 0 THEN transform(__h_{n}, (h, i) -> named_struct('start', {start}, 'end', {start} + length(h), 'hit', h)) "
        f"ELSE cast(array() as array<{SPAN}>) END"
    )


def pieces(text: str) -> str:
    """SQL: the text in pieces of PIECE characters; null for an empty one."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def around(pieces: str, start: str, end: str, reach: int) -> tuple[str, str]:
    """SQL for up to reach characters before start and after end (reach at most PIECE), from two neighbouring pieces each."""
    at = lambda k: f"coalesce(get({pieces}, {k}), '')"
    b, a = f"({start} div {PIECE})", f"({end} div {PIECE})"
    local = f"({start} % {PIECE} + length({at(f'{b} - 1')}))"
    before = f"substr(concat({at(f'{b} - 1')}, {at(b)}), greatest(1, cast({local} + 1 - {reach} AS int)), cast(least({local}, {reach}) AS int))"
    after = f"substr(concat({at(a)}, {at(f'{a} + 1')}), cast({end} % {PIECE} + 1 AS int), {reach})"
    return before, after


def listed(kinds: list[str]) -> str:
    """SQL for an array of struct<start,rank,end,kind> of all spans, by start, then kind as listed."""
    parts = ", ".join(
        f"transform({k}, s -> named_struct('start', s.start, 'rank', {r}, 'end', s.end, 'kind', '{k}'))" for r, k in enumerate(kinds)
    )
    return f"array_sort(concat({parts}))"


def joined(column: str) -> str:
    return f"array_join(transform({column}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
