"""Length-adaptive chunks: short documents whole, others by a recursive character splitter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import estimated_tokens, strip

# Fixed values.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
MAX_INPUT_TOKENS = 8192
SIZE, OVERLAP, HINT = 1000, 150, 5500

#: Texts to their numbers of tokens, in order.
TokenCounter = Callable[[list[str]], list[int]]


def _pieces(text: str, sep: str) -> list[str]:
    """text cut before each separator, which stays at the start of the piece it opens."""
    if not sep:
        return list(text)
    head, *tail = text.split(sep)
    return [p for p in (head, *(sep + t for t in tail)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Runs of pieces of at most size characters; each run starts with up to overlap characters of the run before."""
    out, start, total = [], 0, 0
    for end, piece in enumerate(pieces):
        if total + len(piece) > size and start < end:
            out.append("".join(pieces[start:end]))
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(pieces[start])
                start += 1
        total += len(piece)
    if start < len(pieces):
        out.append("".join(pieces[start:]))
    return [c for c in (x.strip() for x in out) if c]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    rest = separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += _packed(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, rest) if rest else [piece]
    return out + _packed(small, size, overlap)


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP, hint: int = HINT, count_tokens: Callable[[str], int] | None = None) -> list[str]:
    text = text.strip()
    if not text:
        return []
    whole = count_tokens(text) <= MAX_INPUT_TOKENS if count_tokens else len(text) <= hint
    return [text] if whole else split_text(text, size, overlap)


def is_single(text: Column, hint: int = HINT) -> Column:
    return (F.length(text) > 0) & (F.length(text) <= hint)


def chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP, hint: int = HINT) -> Column:
    """array<string> of a stripped text; only texts that are split pass through Python: those longer than the hint."""
    whole = F.length(text) <= hint

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if not t else split_text(t, size, overlap))

    # Marked so, it is evaluated where it stands and not again in filters that the optimiser derives.
    split = split.asNondeterministic()
    long_only = F.when(~whole, text)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(whole, F.array(text)).otherwise(split(long_only))


def counted_chunks(text: Column, count_tokens: TokenCounter, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """struct<tokens:int,chunks:array<string>> of each stripped text by a batched counter; chunks are null of a text that stays whole.

    Where the counter fails for a batch, texts are tried one by one, and where it fails for a text, the heuristic stands in. Texts are counted and split in one
    pass: every further function of Python would take a worker of its own beside each task, with its own copy of the batch.
    """

    @F.pandas_udf("tokens int, chunks array<string>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(t: str) -> int | None:
            try:
                return count_tokens([t])[0]
            except Exception:
                return None

        def counts(texts: list[str]) -> list[int | None]:
            try:
                found = count_tokens(texts)
            except Exception:
                found = None
            return found if found is not None and len(found) == len(texts) else [one(t) for t in texts]

        for s, estimate in parts:
            texts = s.fillna("").tolist()
            tokens = [int(e) if n is None else n for n, e in zip(counts(texts), estimate, strict=True)]
            cut = [split_text(t, size, overlap) if t and n > MAX_INPUT_TOKENS else None for t, n in zip(texts, tokens, strict=True)]
            yield pd.DataFrame({"tokens": pd.Series(tokens, dtype="int32"), "chunks": pd.Series(cut, dtype=object)})

    return run.asNondeterministic()(text, F.coalesce(estimated_tokens(text), F.lit(1)))


def with_chunks(df: DataFrame, text: str = "text", count_tokens: TokenCounter | None = None, **sizes: int) -> DataFrame:
    """One row for each chunk: chunk_index from 0, n_chunks of the document, document; with a counter, n_tokens of the document before them. No text, no row.

    With a counter, a text is one chunk if it has at most MAX_INPUT_TOKENS tokens, however long it is, and is split if it has more, however short.
    """
    cut = df.withColumn("__text", strip(F.col(text)))
    if count_tokens is not None:
        sizes = {k: v for k, v in sizes.items() if k != "hint"}
        whole = F.when(F.length("__text") > 0, F.array("__text")).otherwise(F.array().cast("array<string>"))
        cut = cut.withColumn("__counted", counted_chunks(F.col("__text"), count_tokens, **sizes))
        cut = cut.withColumn("n_tokens", F.col("__counted.tokens")).withColumn("__chunks", F.coalesce(F.col("__counted.chunks"), whole)).drop("__counted")
    else:
        cut = cut.withColumn("__chunks", chunks(F.col("__text"), **sizes))
    return cut.withColumn("n_chunks", F.size("__chunks")).select("*", F.posexplode("__chunks").alias("chunk_index", "document")).drop("__chunks", "__text")


def with_page_chunks(df: DataFrame, pages: str = "pages", **sizes: int) -> DataFrame:
    """No chunk spans pages; index and count run over the whole document (array<struct<page,text>>)."""
    numbered = df.withColumn("__r", F.monotonically_increasing_id())  # before the explode: one number for each document
    cut = numbered.select(*[c for c in df.columns if c != pages], "__r", F.posexplode(pages).alias("__p", "__page"))
    cut = cut.withColumn("__text", strip(F.col("__page.text"))).withColumn("__chunks", chunks(F.col("__text"), **sizes))
    whole = cut.groupBy("__r", *[c for c in df.columns if c != pages]).agg(F.sort_array(F.collect_list(F.struct("__p", F.col("__page.page").alias("page"), "__chunks"))).alias("__all"))
    flat = F.flatten(F.transform("__all", lambda p: F.transform(p["__chunks"], lambda c: F.struct(p["page"].alias("page"), c.alias("document")))))
    out = whole.withColumn("__flat", flat).withColumn("n_chunks", F.size("__flat"))
    return out.select("*", F.posexplode("__flat").alias("chunk_index", "__c")).select("*", F.col("__c.page").alias("page"), F.col("__c.document").alias("document"), F.concat(F.lit("p."), F.col("__c.page").cast("string")).alias("anchor")).drop("__r", "__all", "__flat", "__c")
