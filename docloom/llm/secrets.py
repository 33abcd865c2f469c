"""Secret scan: fixed patterns plus a sliding-window entropy test per character class.

Every maximal run of token characters of at least ``WINDOW`` characters is a candidate. A window of
that length slides over it; the counts of its characters are kept in a string with one digit for
each symbol, and a step updates only the entering and the leaving symbol together with the running
sum of c*log2(c), in millionths, as integers. H = log2(W) - sum/W, so a window is suspicious when
the sum is at most a limit that depends on the candidate's character class. Suspicious windows that overlap or touch make one span.

Allow-listed parts (documented examples, UUIDs, given values) are masked within a candidate: no window over them counts, and what stands beside them is
scanned as before. Runs of digits have no limit that they could pass; runs of letters need more bits than words have.

Long candidates are scanned in pieces of ``PIECE`` windows, so work grows in proportion to their length.

Defined results: a null or empty text gives no spans and the hash of the empty string; null ids and
repeated rows pass through, one result row for each input row; an empty table gives an empty one; other input columns are ignored. Very long texts are scanned whole. Spans
of different kinds may overlap; of one kind they never do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.spans import joined, listed, quoted, with_spans

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in KEYWORDS)
ASSIGN = f"({ANY_CASE})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"  # runs are maximal, so the length rule can sit in the pattern
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]"
WINDOW = 20
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BASE = ["assign", "access", "hex"]

#: Bits of entropy a window needs, by the first class that holds all its candidate's characters (none: never suspicious).
CLASSES = (("^[0-9_=+/-]+$", None), ("^[A-Za-z_=+/-]+$", 4.05), ("^[0-9a-fA-F]+$", 3.0), ("^[A-Z0-9]+$", 3.4), ("^[a-z0-9]+$", 3.4), ("", 3.7))
#: Parts of candidates that are no secrets: strings that say so themselves, and UUIDs.
ALLOW = ("EXAMPLE", "example", "placeholder", "xxxxxxxx", "XXXXXXXX", "0123456789", "abcdefgh")
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
MASK = "~"  # no token character
PIECE = 256


def weights(window: int = WINDOW) -> list[int]:
    return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(window + 1)]


def limit(bits: float | None, window: int = WINDOW) -> int:
    return -1 if bits is None else math.floor(window * (math.log2(window) - bits) * 1e6)


def masked(hit: str, allow: tuple[str, ...]) -> str:
    out = f"regexp_replace({hit}, {quoted(UUID)}, {quoted(MASK * 36)})"
    for word in allow:
        out = f"replace({out}, {quoted(word)}, {quoted(MASK * len(word))})"
    return out


def _flags(chars: str, most: str, window: int) -> str:
    """SQL: a string of characters to a string with a 1 for each suspicious window, else 0, by the window's start."""
    f = weights(window)
    grow = f"array({', '.join(str(y - x) for x, y in zip(f, f[1:], strict=False))})"  # of c*log2(c), from c to c + 1
    count = lambda at: f"(ascii(substr(a.counts, {at}, 1)) - 48)"
    old = f"s[a.i - {window}]"
    full = f"a.since >= {window}"
    total = f"(a.total + CASE WHEN {full} AND {old} = x THEN 0 WHEN {full} THEN {grow}[{count('x')}] - {grow}[{count(old)} - 1] ELSE {grow}[{count('x')}] END)"
    put = lambda text, at, by: f"overlay({text} PLACING char(48 + {count(at)} {by}) FROM {at} FOR 1)"
    counts = f"CASE WHEN {full} AND {old} = x THEN a.counts WHEN {full} THEN {put(put('a.counts', old, '- 1'), 'x', '+ 1')} ELSE {put('a.counts', 'x', '+ 1')} END"
    empty = f"repeat('0', {len(SYMBOLS)})"
    step = (
        f"(a, x) -> CASE WHEN x = 0 THEN named_struct('counts', {empty}, 'total', 0, 'since', 0, 'i', a.i + 1, 'out', concat(a.out, '0')) "
        f"ELSE named_struct('counts', {counts}, 'total', {total}, 'since', a.since + 1, 'i', a.i + 1, "
        f"'out', concat(a.out, CASE WHEN a.since + 1 >= {window} AND {total} <= {most} THEN '1' ELSE '0' END)) END"
    )
    start = f"named_struct('counts', {empty}, 'total', 0, 'since', 0, 'i', 0, 'out', '')"
    # The array of one binds the symbols to a name.
    symbols = f"array(transform(split({chars}, ''), ch -> instr('{SYMBOLS}', ch)))"
    return f"get(transform({symbols}, s -> substr(aggregate(s, {start}, {step}, a -> a.out), {window})), 0)"


def _hot(candidate: str, window: int) -> str:
    """SQL: the starts of a candidate's suspicious windows, from 0."""
    more = f"concat(p, coalesce(substr(get({candidate}.parts, k + 1), 1, {window - 1}), ''))"
    starts = f"transform(filter(sequence(1, length(f)), i -> substr(f, i, 1) = '1'), i -> k * {PIECE} + i - 1)"
    one = f"transform(array({_flags(more, f'{candidate}.most', window)}), f -> CASE WHEN length(f) > 0 THEN {starts} ELSE cast(array() AS array<int>) END)"
    return f"flatten(flatten(transform({candidate}.parts, (p, k) -> {one})))"


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    classes: tuple[tuple[str, float | None], ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """doc_id and arrays ``assign access hex entropy`` of struct<start,end,hit>, offsets in code points, end exclusive. allow: strings that are no secrets, wherever they stand."""
    if not 1 < window <= PIECE:
        raise ValueError("window")
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    df = with_spans(df, "__text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "__runs": f"(?<!{TOKEN}){TOKEN}{{{window},}}"}).drop("__text")
    # The value is the match's tail of value characters after the first separator.
    df = df.withColumn("assign", F.expr(f"filter(assign, s -> length(regexp_extract(s.hit, {quoted('^' + ASSIGN)}, 2)) >= 8)"))
    most = "CASE " + " ".join(f"WHEN s.hit RLIKE {quoted(p)} THEN {limit(b, window)}" for p, b in classes) + " END"
    parts = f"regexp_extract_all({masked('s.hit', allow)}, '.{{1,{PIECE}}}', 0)"
    df = df.withColumn("__c", F.expr(f"filter(transform(__runs, s -> named_struct('start', s.start, 'hit', s.hit, 'most', {most}, 'parts', {parts})), c -> c.most >= 0)"))
    df = df.withColumn("__c", F.expr(f"filter(transform(__c, c -> named_struct('start', c.start, 'hit', c.hit, 'hot', {_hot('c', window)})), c -> size(c.hot) > 0)"))
    # Windows that overlap or touch: a span begins where no window came within its length before, and ends likewise.
    first = f"filter(c.hot, (h, i) -> i = 0 OR h - c.hot[i - 1] > {window})"
    last = f"filter(c.hot, (h, i) -> i = size(c.hot) - 1 OR c.hot[i + 1] - h > {window})"
    df = df.withColumn("__c", F.expr(f"transform(__c, c -> named_struct('start', c.start, 'pieces', regexp_extract_all(c.hit, '.{{1,{PIECE}}}', 0), 'first', {first}, 'last', {last}))"))
    # A span's text is cut from the pieces of the run that it touches, not from the whole run.
    cut = f"array_join(slice(c.pieces, h div {PIECE} + 1, (c.last[i] + {window}) div {PIECE} - h div {PIECE} + 1), '')"
    spans = f"transform(c.first, (h, i) -> named_struct('start', c.start + h, 'end', c.start + c.last[i] + {window}, 'hit', substr({cut}, cast(h % {PIECE} + 1 AS int), c.last[i] + {window} - h)))"
    return df.select(id_col, "assign", "access", "hex", F.expr(f"flatten(transform(__c, c -> {spans}))").alias("entropy"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    df = scan_secrets(docs).withColumn("__base", F.expr(listed(BASE))).withColumn("__all", F.expr(listed([*BASE, "entropy"])))
    return df.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.expr(f"sha2({joined('__base')}, 256)").alias("base_sha256"),
        F.expr(joined("__all")).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
