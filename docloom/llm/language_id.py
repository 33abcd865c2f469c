"""Language identification by word-first backoff.

A known word scores its log frequency in every language. An unseen word is cut from the left into the
longest known character n-grams, from ``ORDER`` characters down to one, whose log frequencies add up. The language with
the highest sum wins, of tied ones the first by name; the score is its softmax over sums divided by the root of the number of words.

Learning reads the labelled rows: a hash of id, text and place picks about ``per_lang`` of each language, the one bound of the
model. All words and n-grams of the picked rows are counted in tasks, whatever their frequency, and reach the driver as flat Arrow columns; the
model is a few arrays, broadcast. Prediction reads whole texts in Arrow batches; words that were scored once are remembered up to a bound.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is any text if nothing could be
learned (an empty table, or no labels); null ids and repeated rows pass through, repeated labelled rows count each time; labels, ids and other columns never enter a prediction.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import discard, materialise
from docloom.shipping import ship

PER_LANG = 2000
ORDER = 4
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 200_000
ROWS = 500  # texts that are predicted together: the rest of an Arrow batch stays in Arrow
COUNTED = 500_000  # words and n-grams that a task counts before it sends them on


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Table:
    """Strings and the log frequencies of each, a row over languages; frequencies are smoothed by half an occurrence."""

    def __init__(self, counts: pa.Table, key: str, langs: list[str]):
        """counts: lang, key, n; each (lang, key) once."""
        coded = counts.column(key).combine_chunks().dictionary_encode()
        self.keys = coded.dictionary
        at = counts.column("lang").combine_chunks().dictionary_encode()
        lang = np.array([langs.index(x) for x in at.dictionary.to_pylist()], np.int64)[at.indices.to_numpy()] if len(at) else np.empty(0, np.int64)
        m = np.full((len(self.keys), max(1, len(langs))), 0.5)
        np.add.at(m, (coded.indices.to_numpy(), lang), counts.column("n").to_numpy())
        self.logs = (np.log(m) - np.log(np.maximum(m.sum(0), 0.5))).astype(np.float32)

    def rows(self) -> dict[str, int]:
        return dict(zip(self.keys.to_pylist(), range(len(self.keys)), strict=True))


class Model:
    """Scores of words and n-grams; every row is a vector over ``langs``."""

    def __init__(self, word_counts: pa.Table, gram_counts: pa.Table, order: int = ORDER):
        """word_counts: lang, word, n. gram_counts: lang, gram, n; n-grams of one length share a table, as their frequencies do."""
        self.langs = sorted(set(word_counts.column("lang").to_pylist()))
        self.order = order
        self.words = Table(word_counts, "word", self.langs)
        size = np.array([len(g) for g in gram_counts.column("gram").to_pylist()], np.int64)
        self.grams = [Table(gram_counts.filter(pa.array(size == k)), "gram", self.langs) for k in range(1, order + 1)]


def grams_of(word: str, order: int) -> Iterator[str]:
    padded = f" {word} "
    for size in range(1, order + 1):
        for i in range(len(padded) - size + 1):
            yield padded[i : i + size]


class Scorer:
    """A model with the rows of remembered words, for one task: kept longer, it would take memory from the stages that follow in the same worker."""

    def __init__(self, model: Model):
        self.langs, self.order = model.langs, model.order
        self.known = model.words.rows()
        self.grams = [g.rows() for g in model.grams]
        self.gram_logs = [g.logs for g in model.grams]
        self.n_known = len(self.known)
        self.row = self.known
        self.table = np.zeros((self.n_known + REMEMBERED, max(1, len(self.langs))), np.float32)
        self.table[: self.n_known] = model.words.logs

    def backoff(self, w: str) -> np.ndarray:
        padded, i, total = f" {w} ", 0, np.zeros(len(self.langs), np.float32)
        while i < len(padded):
            for size in range(min(self.order, len(padded) - i), 0, -1):
                k = self.grams[size - 1].get(padded[i : i + size])
                if k is not None:
                    total = total + self.gram_logs[size - 1][k]
                    break
            i += max(1, size)
        return total

    def word(self, w: str) -> np.ndarray:
        k = self.row.get(w)
        return self.table[k] if k is not None else self.backoff(w)

    def _forget(self) -> None:
        """Drop remembered words: rows after the known ones."""
        for w in [w for w, k in self.row.items() if k >= self.n_known]:
            del self.row[w]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.langs:
            return UNKNOWN, 0.0
        total, chunk = np.zeros(len(self.langs)), REMEMBERED
        for k in range(0, len(found), chunk):
            part = found[k : k + chunk]
            if len(self.row) + len(part) > len(self.table):
                self._forget()
            row = self.row
            for w in part:
                if w not in row:
                    self.table[len(row)] = self.backoff(w)
                    row[w] = len(row)
            total += self.table[[row[w] for w in part]].sum(0, dtype=np.float64)
        x = (total - total.max()) / math.sqrt(len(found))
        p = np.exp(x) / np.exp(x).sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _summed(key: str, pairs):
    """An Arrow function: pairs(batch) yields (lang, key, n), which are added up within the task as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", key, "n"])

        for b in batches:
            for lang, found in pairs(b):
                c = seen[lang]
                for w, n in found:
                    c[w] += n
                if sum(map(len, seen.values())) >= COUNTED:
                    yield flush()
        yield flush()

    return run


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, order: int = ORDER) -> Model:
    """From rows with a text and a language; about ``per_lang`` rows of each language, picked by a hash of id, text and place, so that repeated ids or rows are not picked together."""
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    ship(docs.sparkSession)
    there = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*(x for k, n in there.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n))))) if there else F.lit(None).cast("map<string,double>")
    picked = rows.filter(F.pmod(F.xxhash64(F.coalesce("i", F.lit("null")), "t", F.monotonically_increasing_id()), F.lit(1 << 30)) < F.element_at(share, F.col("l")) * (1 << 30))

    def text_words(b: pa.RecordBatch):
        for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield lang, Counter(words(t)).items()

    def word_grams(b: pa.RecordBatch):
        for lang, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield lang, ((g, n) for g in grams_of(w, order))

    def total(df: DataFrame, key: str, pairs) -> DataFrame:
        return df.mapInArrow(_summed(key, pairs), f"lang string, {key} string, n long").groupBy("lang", key).agg(F.sum("n").alias("n"))

    by_word = materialise(total(picked.select("t", "l"), "word", text_words), "words")
    model = Model(by_word.toArrow(), total(by_word, "gram", word_grams).toArrow(), order)
    discard(by_word)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added (they replace columns of these names)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            out = [scorer.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], [*b.schema.names, "lang_pred", "score"])
        del scorer
        pa.default_memory_pool().release_unused()

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predicted, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    model = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least min_score, with all their columns."""
    held = [c for c in docs.columns if c in ("lang_pred", "score")]
    kept = docs.select(*(F.col(c).alias(f"__{c}" if c in held else c) for c in docs.columns))
    out = identify(kept, learn(docs.filter(~held_out()))).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return out.select(*(F.col(f"__{c}").alias(c) if c in held else F.col(c) for c in docs.columns))
