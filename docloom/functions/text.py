"""Scalar expressions over document text, as Columns (NFC and canonical JSON need Arrow UDFs)."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MIN_DOC_CHARS = 50
SNIPPET_CHARS = 200
PUBLIC_ID_CHARS = 24
LFS_PREFIX = "version https://git-lfs.github.com/spec/v1"
MAIN_DOC = "작품설명서"
ADVISOR_DOC = "지도논문"
FILENAME = r"(?U)^(\d{4})-([^-]+)-([^-]+)-(.+)-\.md$"
ADVISOR_SUFFIX = r"(?U)\s*\(지도논문\)\s*$"
SLUG = r"^[a-z0-9][a-z0-9-]{1,30}$"
SPACE = r"[\s\x1c-\x1f]"
UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """UTF-8 with replacement and universal newlines."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))


@F.pandas_udf(T.StringType())
def canonical_checksum(kind: pd.Series, payload: pd.Series) -> pd.Series:
    """SHA-256 of the kind and the payload's JSON with sorted keys."""
    digest = lambda k, p: hashlib.sha256((k + json.dumps(json.loads(p), sort_keys=True, ensure_ascii=False)).encode()).hexdigest()
    return pd.Series([None if p is None else digest(k or "", p) for k, p in zip(kind, payload, strict=True)])


def strip(c: Column) -> Column:
    """Unicode white space off both ends (trim() knows the space only)."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def source_path(corpus: Column, filename: Column) -> Column:
    return F.concat_ws("/", corpus, filename)


def public_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, PUBLIC_ID_CHARS)


def snippet(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, f"(?U){SPACE}+", " ")), 1, SNIPPET_CHARS)


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("::"), index.cast("string"))


def classify(text: Column) -> Column:
    """lfs_pointer (tested first), short, or ok."""
    return F.when(F.startswith(text, F.lit(LFS_PREFIX)), "lfs_pointer").when(F.length(text) < MIN_DOC_CHARS, "short").otherwise("ok")


def parse_filename(name: Column) -> dict[str, Column]:
    """year, category, author, title, doc_type. The pattern sees the raw name; advisors' suffix leaves the title only if it matched."""
    hit = F.rlike(name, F.lit(FILENAME))
    part = lambda i: F.when(hit, F.regexp_extract(name, FILENAME, i)).otherwise("")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    title = F.when(hit, F.regexp_replace(F.regexp_extract(name, FILENAME, 4), ADVISOR_SUFFIX, "")).otherwise(stem)
    raw = F.when(hit, F.regexp_extract(name, FILENAME, 4)).otherwise(stem)
    return {
        "year": F.when(hit, F.regexp_extract(name, FILENAME, 1).try_cast("int")),
        "category": part(2),
        "author": part(3),
        "title": title,
        "doc_type": F.when(F.rlike(raw, F.lit(ADVISOR_SUFFIX)), ADVISOR_DOC).otherwise(MAIN_DOC),
    }


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


def round4(c: Column) -> Column:
    return F.floor(c * 10000 + 0.5) / 10000


def length_score(best: Column, n_chunks: Column, c: float) -> Column:
    return best - F.lit(c) * F.log(F.greatest(n_chunks, F.lit(1)).cast("double"))


def estimated_tokens(c: Column) -> Column:
    return (F.length(c) / 1.2).cast("int") + 1


def encode_year(c: Column) -> Column:
    return F.coalesce(c, F.lit(-1))


def decode_year(c: Column) -> Column:
    return F.nullif(c, F.lit(-1))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).otherwise(F.least(F.lit(100), F.floor(done * 100 / F.greatest(total, F.lit(1))))).cast("int")


def collection_version(name: Column) -> Column:
    v = F.regexp_extract(name, r"_v(\d+)$", 1)
    return F.when(v == "", 1).otherwise(v.try_cast("int"))


def collection_base(name: Column) -> Column:
    return F.regexp_replace(name, r"_v\d+$", "")


def next_collection(name: Column) -> Column:
    return F.concat(collection_base(name), F.lit("_v"), (collection_version(name) + 1).cast("string"))


def base_name(name: Column) -> Column:
    """The last component of a path in either slash style, stripped."""
    return strip(F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1))


def filename_problem(name: Column, extensions: tuple[str, ...] = (".md", ".txt")) -> Column:
    """Why an upload's name is refused; null if it is accepted. The suffix counts in lower case here."""
    n = base_name(name)
    suffix = F.regexp_extract(F.lower(n), r"(\.[^.]*)$", 1)
    return (
        F.when(n.isin("", ".", ".."), "empty")
        .when(F.startswith(n, F.lit(".")), "hidden")
        .when(F.contains(n, F.lit("\0")), "nul")
        .when(F.octet_length(n) > 255, "too_long")
        .when(~suffix.isin(*extensions), "extension")
    )


def page_problem(pages: Column) -> Column:
    """Of array<struct<page,text>>: duplicate or bad numbers, too many, too long; null if fine."""
    total = F.aggregate(pages, F.lit(0).cast("long"), lambda a, p: a + F.coalesce(F.octet_length(p["text"]), F.lit(0)))
    return (
        F.when(F.size(pages) == 0, "empty")
        .when(F.size(pages) > 2000, "too_many_pages")
        .when(F.exists(pages, lambda p: p["page"] < 1), "bad_page")
        .when(F.size(F.array_distinct(F.transform(pages, lambda p: p["page"]))) < F.size(pages), "duplicate_page")
        .when(F.exists(pages, lambda p: F.length(p["text"]) > 200_000), "page_too_long")
        .when(total > 5 * 1024 * 1024, "too_large")
    )


def pages_markdown(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("## p."), p["page"].cast("string"), F.lit("\n\n"), p["text"])), "\n\n")


REBUILD_FIELDS = ("doc_prefix", "embed_dim", "chunk_size", "chunk_overlap", "single_chunk_char_hint")


def changed_fields(old: str, new: str, fields: tuple[str, ...] = REBUILD_FIELDS) -> Column:
    """Of two struct columns, the names of fields that differ and call for a rebuild."""
    return F.array_compact(F.array(*(F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields)))


def chunk_config_problem(size: Column, overlap: Column, hint: Column, dim: Column) -> Column:
    return (
        F.when(size < 100, "chunk_size")
        .when((overlap < 0) | (overlap >= size), "chunk_overlap")
        .when(hint < size, "single_chunk_char_hint")
        .when((dim < 128) | (dim > 3072), "embed_dim")
    )
