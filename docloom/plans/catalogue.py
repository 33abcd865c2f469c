"""The retrieval engine's queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Bindings: ``documents`` is a corpus (source: corpus, doc_id: file), ``embeddings`` are chunks (label: document), ``events`` are request
logs and ledgers, ``conversations`` are paged documents. Every query reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.chunking import is_single, with_chunks, with_page_chunks
from docloom.functions.embedding import CharBucketEmbedder, embed_query, embedded
from docloom.operators import ann, index, ledger, managed, search
from docloom.operators.kinds import INVENTION, PLAIN, compile_where
from docloom.scratch import new_path
from docloom.shipping import ship
from docloom.sources import files, store, zips

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOP_K, HITS = 5, 25
DIM = 16


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- bindings -------------------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", "source", "text", "lang",
        X.source_path(F.col("source"), F.col("doc_id").cast("string")).alias("source_path"),
        F.when(F.col("doc_id") % 10 == 0, "advisor").otherwise("main").alias("doc_type"),
        (1979 + F.col("doc_id") % 39).cast("int").alias("year"),
    )


DOCS = "docs AS (SELECT *, source || '/' || doc_id AS source_path, CASE WHEN doc_id % 10 = 0 THEN 'advisor' ELSE 'main' END AS doc_type, (1979 + doc_id % 39)::INT AS year FROM documents)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks: vec_id in document label."""
    return table(spark, sf, "embeddings").withColumn("doc_type", F.when(F.col("vec_id") % 10 == 0, "advisor").otherwise("main"))


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    """The query: the vector with the smallest id."""
    row = table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0]


VECS = """q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
vecs AS (SELECT *, count(*) OVER (PARTITION BY label)::INT AS n_chunks, CASE WHEN vec_id % 10 = 0 THEN 'advisor' ELSE 'main' END AS doc_type FROM embeddings),
dist AS (SELECT vecs.*, 1 - list_cosine_similarity(embedding::DOUBLE[], qv) AS distance FROM vecs, q)"""
HIT = "hits AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM dist {where} QUALIFY rank <= 25)"
ROUND = "floor(({}) * 10000 + 0.5) / 10000"
SIM = "greatest(0, least(1, 1 - distance / 2))"


def _docs_sql(where: str = "", c: float = 0.0) -> str:
    score = ROUND.format(f"best - {c} * ln(greatest(n_chunks, 1))")
    return f"""WITH {VECS}, {HIT.format(where=where)},
    grouped AS (SELECT label, max({SIM}) AS best, avg({SIM}) AS mean, min(rank) AS first_rank, arg_min(n_chunks, rank) AS n_chunks, arg_min(vec_id, rank) AS vec_id FROM hits GROUP BY label),
    scored AS (SELECT *, {score} AS similarity FROM grouped)
    SELECT label, vec_id, similarity, {ROUND.format("mean")} AS mean, row_number() OVER (ORDER BY similarity DESC, mean DESC, first_rank)::INT AS position FROM scored QUALIFY position <= 5"""


def _ranked(hits: DataFrame, c: float = 0.0) -> DataFrame:
    docs = search.rank_documents(hits, TOP_K, doc_col="label", keep=("vec_id",), length_c=c)
    return docs.select("label", "vec_id", "similarity", X.round4(F.col("mean")).alias("mean"), "position")


def _hits(spark: SparkSession, sf: str, where=None) -> DataFrame:
    return search.top_chunks(vectors(spark, sf), search.literal_vector(first_vector(spark, sf)), HITS, "vec_id", where)


def _sized(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    """Hits with n_chunks of their documents: the few hits are ranked first, and their labels alone are counted."""
    mine = table(spark, sf, "embeddings").select("label").join(hits.select("label").distinct(), "label", "left_semi")
    return hits.join(mine.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("n_chunks")), "label")


# --- search ---------------------------------------------------------------------------------------


@query(f"WITH {VECS}, {HIT.format(where='')} SELECT vec_id, label, rank::INT AS rank, {ROUND.format(SIM)} AS similarity FROM hits")
def search_topk_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("vec_id", "label", "rank", X.round4(X.similarity(F.col("distance"))).alias("similarity"))


@query(_docs_sql())
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_hits(spark, sf).withColumn("n_chunks", F.lit(1)))  # without a length penalty, counts play no part


@query(_docs_sql("WHERE doc_type = 'main'"))
def search_documents_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_hits(spark, sf, compile_where({"$and": [{"doc_type": "main"}]})).withColumn("n_chunks", F.lit(1)))


@query(_docs_sql(c=0.05))
def search_documents_length_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_sized(spark, sf, _hits(spark, sf)), 0.05)


@query(f"""WITH qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
    hits AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], qv) AS distance,
      row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], qv), vec_id) AS rank FROM embeddings, qs QUALIFY rank <= 5)
    SELECT query_id, rank::INT AS rank, {ROUND.format(SIM)} AS similarity FROM hits""")
def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every id divisible by 50 is a query, against all rows. Copies tie within rounding errors, so ids are left out."""
    e = table(spark, sf, "embeddings")
    qs = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = search.top_chunks_batch(e, qs, 5)
    return hits.select("query_id", "rank", X.round4(X.similarity(F.col("distance"))).alias("similarity"))


@query()
def search_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """The same queries through an inverted-file index over all rows; a test holds its recall against search_batch."""
    e = table(spark, sf, "embeddings")
    index = ann.IvfIndex.build(e, new_path(spark, "ivf"), "vec_id")
    qs = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = index.search_batch(qs, 5, "vec_id")
    return hits.select("query_id", "rank", X.round4(X.similarity(F.col("distance"))).alias("similarity"))


QUERY_TEXT = "the of and to in"
BUCKETS = f"""chars AS (SELECT doc_id, ord(ch) % {DIM} AS b FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''),
counts AS (SELECT doc_id, b, count(*) AS c FROM chars GROUP BY doc_id, b)"""


@query(f"""WITH {BUCKETS}, norms AS (SELECT doc_id, sqrt(sum(c * c)) AS z FROM counts GROUP BY doc_id),
    grid AS (SELECT doc_id, b FROM documents, generate_series(0, {DIM - 1}) g(b))
    SELECT doc_id, b::INT AS bucket, floor(coalesce(c / z, 0) * 10000 + 0.5) / 10000 AS value FROM grid LEFT JOIN counts USING (doc_id, b) LEFT JOIN norms USING (doc_id)""")
def char_bucket_embed(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", embedded(F.col("text"), CharBucketEmbedder(DIM)).alias("v"))
    return d.select("doc_id", F.posexplode("v").alias("bucket", "value")).select("doc_id", "bucket", X.round4(F.col("value").cast("double")).alias("value"))


@query(f"""WITH {DOCS}, {BUCKETS}, qc AS (SELECT ord(ch) % {DIM} AS b, count(*) AS c FROM (SELECT unnest(string_split('{QUERY_TEXT}', '')) AS ch) WHERE ch <> '' GROUP BY 1),
    dots AS (SELECT doc_id, sum(counts.c * coalesce(qc.c, 0)) / (sqrt(sum(counts.c * counts.c)) * (SELECT sqrt(sum(c * c)) FROM qc)) AS cos FROM counts LEFT JOIN qc USING (b) GROUP BY doc_id),
    main AS (SELECT floor(least(1, greatest(0, 1 - (1 - cos) / 2)) * 1000 + 0.5) / 1000 AS similarity FROM dots JOIN docs USING (doc_id) WHERE doc_type = 'main')
    SELECT row_number() OVER (ORDER BY similarity DESC)::INT AS position, similarity FROM main QUALIFY position <= 5""")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Text to vectors to ranked documents, main documents only. Near-equal scores tie across float widths: ranks and rounded scores are returned."""
    d = documents(spark, sf).filter("doc_type = 'main'")
    chunks = d.select("source_path", F.lit(1).alias("n_chunks"), F.col("source_path").alias("chunk_id"), embedded(F.col("text"), CharBucketEmbedder(DIM)).alias("embedding"))
    hits = search.top_chunks(chunks, search.literal_vector(embed_query(CharBucketEmbedder(DIM), QUERY_TEXT)), HITS)
    docs = search.rank_documents(hits, TOP_K)
    return docs.select("position", (F.floor(F.col("best") * 1000 + 0.5) / 1000).alias("similarity"))


# --- documents ------------------------------------------------------------------------------------

STRIP_SQL = r"regexp_replace(text, '^[\s\x0b\x1c-\x1f\x85\xa0]+|[\s\x0b\x1c-\x1f\x85\xa0]+$', '', 'g')"


@query(f"""WITH c AS (SELECT source, CASE WHEN starts_with(text, '{X.LFS_PREFIX}') THEN 'lfs_pointer' WHEN length(text) < 50 THEN 'short' ELSE 'ok' END AS status FROM documents)
    SELECT source, count(*) FILTER (status = 'ok') AS indexed, count(*) FILTER (status <> 'ok') AS skipped, count(*) FILTER (status = 'lfs_pointer') AS lfs_pointer FROM c GROUP BY source""")
def doc_classify_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).withColumn("status", X.classify(F.col("text")))
    return d.groupBy("source").agg(F.count_if(F.col("status") == "ok").alias("indexed"), F.count_if(F.col("status") != "ok").alias("skipped"), F.count_if(F.col("status") == "lfs_pointer").alias("lfs_pointer"))


@query(f"WITH {DOCS} SELECT doc_id, source_path, sha256({STRIP_SQL}) AS content_hash FROM docs")
def doc_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "source_path", X.content_hash(X.strip(F.col("text"))).alias("content_hash"))


@query(f"WITH {DOCS} SELECT doc_id, substr(sha256(source_path), 1, 24) AS document_id FROM docs")
def doc_public_id(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", X.public_id(F.col("source_path")).alias("document_id"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g')), 1, 200) AS snippet FROM documents")
def doc_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))) AS text FROM documents")
def doc_nfc(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    return documents(spark, sf).select("doc_id", X.nfc(apart).alias("text"))


NAME = "CASE WHEN doc_id % 3 = 2 THEN 'note ' || doc_id || '.md' ELSE year || '-' || source || '-' || lang || '-title - ' || doc_id || CASE WHEN doc_type = 'advisor' THEN '(지도논문)' ELSE '' END || '-.md' END"


@query(f"""WITH {DOCS}, n AS (SELECT doc_id, {NAME} AS name FROM docs),
    p AS (SELECT doc_id, name, regexp_matches(name, '^\\d{{4}}-[^-]+-[^-]+-.+-\\.md$') AS hit, regexp_extract(name, '^(\\d{{4}})-([^-]+)-([^-]+)-(.+)-\\.md$', ['y', 'c', 'a', 't']) AS g FROM n)
    SELECT doc_id, try_cast(g.y AS INT) AS year, CASE WHEN hit THEN g.c ELSE '' END AS category, CASE WHEN hit THEN g.a ELSE '' END AS author,
      CASE WHEN hit THEN regexp_replace(g.t, '\\s*\\(지도논문\\)\\s*$', '') ELSE regexp_replace(name, '\\.[^.]*$', '') END AS title,
      CASE WHEN regexp_matches(CASE WHEN hit THEN g.t ELSE name END, '\\(지도논문\\)\\s*$') THEN '지도논문' ELSE '작품설명서' END AS doc_type FROM p""")
def filename_parse(spark: SparkSession, sf: str) -> DataFrame:
    named = documents(spark, sf).select("doc_id", F.expr(NAME).alias("name"))
    return named.select("doc_id", *(c.alias(n) for n, c in X.parse_filename(F.col("name")).items()))


@query(f"WITH s AS (SELECT doc_id, {STRIP_SQL} AS t FROM documents) SELECT doc_id, length(t) > 0 AND length(t) <= 5500 AS single, (trunc(length(t)::DOUBLE / 1.2::DOUBLE) + 1)::INT AS tokens FROM s")
def single_chunk_branch(spark: SparkSession, sf: str) -> DataFrame:
    t = X.strip(F.col("text"))
    return documents(spark, sf).select("doc_id", is_single(t).alias("single"), X.estimated_tokens(t).alias("tokens"))


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    c = with_chunks(documents(spark, sf).select("source_path", "text"))
    return c.select(X.chunk_id(F.col("source_path"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "n_chunks", X.content_hash(F.col("document")).alias("hash"))


def words_as_tokens(texts: list[str]) -> list[int]:
    """A counter for tests: 12 tokens for each word; texts that begin with Z fail."""
    if any(t.startswith("Z") for t in texts):
        raise RuntimeError("no count")
    return [12 * len(t.split()) for t in texts]


@query(f"""WITH s AS (SELECT doc_id, {STRIP_SQL} AS t FROM documents), n AS (SELECT doc_id, t, CASE WHEN starts_with(t, 'Z') THEN (trunc(length(t)::DOUBLE / 1.2::DOUBLE) + 1)::INT ELSE 12 * len(list_filter(string_split_regex(t, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+'), lambda x: x <> ''))::INT END AS tokens FROM s)
    SELECT doc_id, tokens, tokens <= 8192 AS whole, (tokens <= 8192) <> (length(t) <= 5500) AS overruled FROM n WHERE t <> ''""")
def chunk_by_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a token counter keeps whole, and whether it overrules their length."""
    ship(spark)
    d = documents(spark, sf).select("doc_id", X.strip(F.col("text")).alias("t"))
    cut = with_chunks(d, "t", count_tokens=words_as_tokens)
    first = cut.filter("chunk_index = 0").select("doc_id", F.col("n_tokens").alias("tokens"), (F.col("document") == F.col("t")).alias("whole"), "t")
    return first.select("doc_id", "tokens", "whole", (F.col("whole") != (F.length("t") <= 5500)).alias("overruled"))


def paged(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents of pages."""
    c = table(spark, sf, "conversations")
    page = F.struct((F.col("turn") + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))


@query()
def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return with_page_chunks(paged(spark, sf)).select("conv_id", "chunk_index", "n_chunks", "page", "anchor", X.content_hash(F.col("document")).alias("hash"))


@query("SELECT conv_id, CASE WHEN min(turn) + 1 < 1 THEN 'bad_page' WHEN count(DISTINCT turn) < count(*) THEN 'duplicate_page' WHEN max(length(text)) > 200000 THEN 'page_too_long' WHEN sum(strlen(text)) > 5242880 THEN 'too_large' ELSE 'ok' END AS problem, count(*)::INT AS pages FROM conversations GROUP BY conv_id")
def page_validation(spark: SparkSession, sf: str) -> DataFrame:
    return paged(spark, sf).select("conv_id", F.coalesce(X.page_problem(F.col("pages")), F.lit("ok")).alias("problem"), F.size("pages").alias("pages"))


@query("SELECT conv_id, sha256(string_agg('## p.' || (turn + 1) || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text)) AS hash FROM conversations GROUP BY conv_id")
def managed_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return paged(spark, sf).select("conv_id", X.content_hash(X.pages_markdown(F.col("pages"))).alias("hash"))


RAW = "CASE doc_id % 6 WHEN 0 THEN ' a\\b\\' || doc_id || '.md ' WHEN 1 THEN '../' || doc_id || '.TXT' WHEN 2 THEN '.hidden' WHEN 3 THEN doc_id || '.exe' WHEN 4 THEN 'x/' ELSE repeat('é', 130) || doc_id || '.md' END"


@query(f"""WITH n AS (SELECT doc_id, trim(string_split(replace({RAW}, chr(92), '/'), '/')[-1]) AS name FROM documents)
    SELECT doc_id, name, CASE WHEN name IN ('', '.', '..') THEN 'empty' WHEN starts_with(name, '.') THEN 'hidden' WHEN strlen(name) > 255 THEN 'too_long' WHEN lower(regexp_extract(name, '\\.[^.]*$')) NOT IN ('.md', '.txt') THEN 'extension' ELSE 'ok' END AS problem FROM n""")
def sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", F.expr(RAW.replace("\\", "\\\\")).alias("raw"))
    return d.select("doc_id", X.base_name(F.col("raw")).alias("name"), F.coalesce(X.filename_problem(F.col("raw")), F.lit("ok")).alias("problem"))


@query("SELECT doc_id || '-' || source || '.md' AS filename, length(text) AS length FROM documents WHERE contains(lower(doc_id || '-' || source || '.md'), 'src1') ORDER BY 1")
def list_documents_filter(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    d = documents(spark, sf).select(F.concat("doc_id", F.lit("-"), "source", F.lit(".md")).alias("filename"), F.length("text").cast("long").alias("length"), F.lit(0).alias("modificationTime"))
    return files.listing(d, "SRC1").select("filename", "length")


@query()
def zip_name_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as file names, as an archiver without the UTF-8 flag would garble them."""
    ship(spark)

    @F.pandas_udf("name string, encoding string")
    def detect(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([files.detect_zip_name(n.encode("utf-8").decode("cp437", "replace"), 0) for n in names], columns=["name", "encoding"])

    d = documents(spark, sf).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(".md")).alias("n"))
    return d.select("doc_id", detect("n").alias("d")).select("doc_id", "d.name", "d.encoding")


# --- index ----------------------------------------------------------------------------------------


def _snapshot(d: DataFrame) -> DataFrame:
    """A collection as an earlier run left it: every fifth document is new since, every seventh had another text; two files are gone now."""
    old = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.filter((F.col("doc_id") % 5 != 0) & (F.length("text") >= X.MIN_DOC_CHARS)).select("source_path", F.lit(0).alias("chunk_index"), X.content_hash(old).alias("content_hash"))


SNAP = "snap AS (SELECT source_path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS content_hash FROM docs WHERE doc_id % 5 <> 0 AND length(text) >= 50)"
DIFF = f"diff AS (SELECT docs.source_path, length(text) >= 50 AS ok, CASE WHEN length(text) < 50 THEN NULL WHEN snap.source_path IS NULL THEN 'new' WHEN snap.content_hash = sha256(text) THEN 'reuse' ELSE 'replace' END AS change FROM docs LEFT JOIN snap USING (source_path))"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    docs = d.select("source_path", "text", X.content_hash(F.col("text")).alias("content_hash"), X.classify(F.col("text")).alias("status"))
    return index.changes(docs, _snapshot(d))


@query(f"WITH {DOCS}, {SNAP}, {DIFF} SELECT source_path, coalesce(change, 'skip') AS change FROM diff")
def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("source_path", F.coalesce("change", F.lit("skip")).alias("change"))


@query(f"WITH {DOCS}, {SNAP}, {DIFF} SELECT count(*) FILTER (ok) AS indexed, count(*) FILTER (NOT ok) AS skipped, count(*) FILTER (change IS NOT NULL) AS total_chunks, count(*) FILTER (change IN ('new', 'replace')) AS embedded_chunks, count(*) FILTER (change = 'reuse') AS reused, (SELECT count(*) FROM docs WHERE starts_with(text, '{X.LFS_PREFIX}')) AS lfs_pointer FROM diff")
def index_statistics(spark: SparkSession, sf: str) -> DataFrame:
    changed = _changes(spark, sf)
    # Each document stands for one chunk here.
    return index.statistics(changed, changed.filter("change IN ('new', 'replace')")).select("indexed", "skipped", "total_chunks", "embedded_chunks", "reused", "lfs_pointer")


@query(f"WITH {DOCS}, {SNAP} SELECT source_path FROM snap WHERE source_path NOT IN (SELECT source_path FROM docs WHERE source <> 'src1')")
def orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return store.orphans(_snapshot(d), d.filter("source <> 'src1'")).select("source_path")


@query("SELECT vec_id FROM embeddings WHERE label <> (SELECT min(label) FROM embeddings)")
def remove_document(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    first = e.agg(F.min("label")).first()[0]
    return e.filter(~F.coalesce(F.col("label") == F.lit(first), F.lit(False))).select("vec_id")


@query("SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'new' ELSE 'old' END AS origin FROM embeddings")
def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return store.upserted(e.select("vec_id", F.lit("old").alias("origin")), e.filter("label % 2 = 0").select("vec_id", F.lit("new").alias("origin")), "vec_id")


@query("SELECT source || '_v' || (1 + (doc_id // 20) % 4) AS collection, count(*) AS chunks FROM documents GROUP BY 1")
def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _collections(spark, sf).groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))


def _collections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat("source", F.lit("_v"), (1 + F.floor(F.col("doc_id") / 20) % 4).cast("string")).alias("collection"))


@query("""WITH c AS (SELECT DISTINCT source AS base, 1 + (doc_id // 20) % 4 AS v FROM documents), k AS (SELECT *, max(v) OVER (PARTITION BY base) AS top FROM c)
    SELECT base || '_v' || v AS collection FROM k WHERE v < top QUALIFY row_number() OVER (PARTITION BY base ORDER BY v DESC) > 1""")
def prune_versions(spark: SparkSession, sf: str) -> DataFrame:
    c = _collections(spark, sf).distinct().select("collection", X.collection_base(F.col("collection")).alias("base"), X.collection_version(F.col("collection")).alias("v"))
    w = Window.partitionBy("base").orderBy(F.col("v").desc())
    return c.withColumn("n", F.row_number().over(w)).filter("n > 2").select("collection")  # the active version and one more stay


@query("SELECT DISTINCT source || '_v' || (1 + (doc_id // 20) % 4) AS collection, source || '_v' || (2 + (doc_id // 20) % 4) AS next FROM documents")
def next_versions(spark: SparkSession, sf: str) -> DataFrame:
    return _collections(spark, sf).distinct().select("collection", X.next_collection(F.col("collection")).alias("next"))


# --- ledger ---------------------------------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("""SELECT event_id, floor(epoch(ts) / 60)::BIGINT AS bucket, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 60) ORDER BY ts, event_id) > 1 AS rejected FROM events""")
def rate_limit_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.rate_limited(events(spark, sf), 1, "user_id", "ts", "event_id").select("event_id", "bucket", "rejected")


@query("SELECT user_id, floor(epoch(ts) / 60)::BIGINT AS bucket, count(*) AS requests FROM events GROUP BY 1, 2")
def usage_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.usage(events(spark, sf), "user_id")


@query("""SELECT event_id, count(*) OVER w AS recent, count(*) OVER w >= 8 AS locked FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""")
def lockout_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.lockouts(events(spark, sf), "event_type", seconds=3600).select("event_id", "recent", "locked")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type = 'signup' AS ok FROM events), s AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS seg FROM e),
    f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, seg ORDER BY us, event_id) AS upto FROM s),
    r AS (SELECT *, upto - coalesce(max(upto) OVER (PARTITION BY user_id, seg ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000000 PRECEDING), 0) AS recent FROM f) SELECT event_id, recent::BIGINT AS recent, recent >= 8 AS locked FROM r""")
def lockout_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of each user within a day since the last success (a signup)."""
    out = ledger.lockouts_cleared(events(spark, sf), "user_id", F.col("event_type") == "signup", "ts", "event_id", seconds=86_400)
    return out.select("event_id", "recent", "locked")


@query()
def queue_cap_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The protocol with each service's jobs under way counted over all its sources, in three services of at most 12 jobs; a test holds it against the plain rules."""
    return ledger.fold_capped(by_service(spark, sf), 12).groupBy("service_id", "kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def by_service(spark: SparkSession, sf: str) -> DataFrame:
    return every_kind(spark, sf).withColumn("service_id", F.concat(F.lit("svc"), (F.col("source_id").cast("long") % 3).cast("string")))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """events as requests: user_id is the source, the key comes from props, the revision from value."""
    k = F.get_json_object("props", "$.k")
    return events(spark, sf).select(
        F.col("event_id").alias("seq"), F.lit("svc").alias("service_id"), F.lit("easyflow").alias("corpus"), F.col("user_id").cast("string").alias("source_id"),
        F.lit("index").alias("kind"), F.floor("value").cast("long").alias("revision"), k.alias("idempotency_key"), F.col("event_type").alias("source_version_id"),
        F.sha2("props", 256).alias("checksum"), F.sha2(F.concat_ws("|", "event_type", k), 256).alias("content_hash"), F.lit(True).alias("enabled"),
    )


REQ = """req AS (SELECT event_id AS seq, user_id::VARCHAR AS source_id, floor(value)::BIGINT AS revision, props->>'$.k' AS idempotency_key, event_type AS source_version_id,
    sha256(props) AS checksum, sha256(event_type || '|' || (props->>'$.k')) AS content_hash FROM events)"""


@query(f"WITH {REQ} SELECT seq, first(seq) OVER w AS job_seq, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN checksum = first(checksum) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM req WINDOW w AS (PARTITION BY source_id, idempotency_key ORDER BY seq)")
def idempotent_submit(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.submissions(requests(spark, sf)).select("seq", "job_seq", "outcome")


@query(f"WITH {REQ}, c AS (SELECT *, max(revision) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM req) SELECT seq, coalesce(cur, -1) AS cur, cur IS NULL OR revision > cur AS accepted FROM c")
def revision_fence(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fence(requests(spark, sf)).select("seq", F.coalesce("current", F.lit(-1)).alias("cur"), "accepted")


@query(f"WITH {REQ} SELECT seq, content_hash <> first(content_hash) OVER (PARTITION BY source_id, source_version_id ORDER BY seq) AS conflict FROM req")
def version_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.version_conflicts(requests(spark, sf)).select("seq", "conflict")


@query()
def active_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The whole protocol over every request, then each source's state."""
    return ledger.latest_state(ledger.fold(every_kind(spark, sf), at_once=False))


@query()
def protocol_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fold(every_kind(spark, sf), at_once=False).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def every_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all kinds: event types decide them, revisions rise with time, a few are stale; every third event ends a job, some of them with an error."""
    at = F.row_number().over(Window.partitionBy("source_id").orderBy("seq"))
    kind = F.when(F.col("n") % 3 == 0, "finish").when(F.col("source_version_id") == "error", "delete").when(F.col("source_version_id").isin("view", "click"), "state").otherwise("index")
    before = F.lag("seq").over(Window.partitionBy("source_id").orderBy("seq"))
    r = requests(spark, sf).withColumn("n", at).withColumn("job", before).withColumn("kind", kind)
    return r.select(
        "seq", F.when(F.col("seq") % 41 == 0, "other").otherwise("svc").alias("service_id"), "corpus", "source_id", "kind", (F.col("n") - F.when(F.col("seq") % 13 == 0, 5).otherwise(0)).cast("long").alias("revision"),
        F.concat("idempotency_key", F.lit("-"), F.col("n") - F.col("n") % 7).alias("idempotency_key"), F.concat("source_version_id", F.lit("-"), (F.col("seq") % 17).cast("string")).alias("source_version_id"), "checksum", "content_hash",
        (F.col("source_version_id") == "click").alias("enabled"), (F.col("seq") % 29 == 0).alias("queue_full"), F.when(F.col("kind") == "finish", F.col("job")).alias("job"),
        F.when((F.col("kind") == "finish") & (F.col("seq") % 5 == 0), "TimeoutError").alias("error"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """events as jobs: event_type decides the status."""
    status = F.create_map(*map(F.lit, ("signup", "queued", "purchase", "succeeded", "error", "failed", "view", "running", "click", "succeeded")))
    e = events(spark, sf)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("corpus_id"), (F.col("user_id") % 7).alias("service_id"), F.element_at(status, F.col("event_type")).alias("status"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 300).alias("lease_until"))


JOBS = "jobs AS (SELECT event_id AS seq, user_id AS corpus_id, user_id % 7 AS service_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'succeeded' END AS status, epoch(ts)::BIGINT AS created_at, epoch(ts)::BIGINT + 300 AS lease_until FROM events)"
SOURCES = "sources AS (SELECT corpus_id, max(seq) FILTER (status = 'succeeded') AS active_job, count(*) FILTER (status = 'failed') % 2 = 1 AS deleted, count(*) % 3 > 0 AS enabled FROM jobs GROUP BY corpus_id)"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    j = jobs(spark, sf).groupBy("corpus_id")
    return j.agg(F.max(F.when(F.col("status") == "succeeded", F.col("seq"))).alias("active_job"), (F.count_if(F.col("status") == "failed") % 2 == 1).alias("deleted"), (F.count(F.lit(1)) % 3 > 0).alias("enabled"))


@query(f"WITH {JOBS}, {SOURCES} SELECT j.seq, j.corpus_id FROM jobs j JOIN sources s ON j.seq = s.active_job WHERE NOT s.deleted")
def rebuild_join(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.rebuild_jobs(jobs(spark, sf), sources(spark, sf)).select("seq", "corpus_id")


@query(f"WITH {JOBS}, {SOURCES} SELECT corpus_id, active_job FROM sources WHERE enabled AND NOT deleted AND active_job IS NOT NULL")
def active_sources(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.active_jobs(sources(spark, sf)).select("corpus_id", "active_job")


@query(f"WITH {JOBS} SELECT corpus_id, max(seq) AS seq, arg_max(status, seq) AS status FROM jobs GROUP BY corpus_id")
def job_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latest_by(jobs(spark, sf), "corpus_id").select("corpus_id", "seq", "status")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def audit_recent(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.recent(events(spark, sf), 50, "event_id").select("event_id", "event_type")


@query(f"WITH {JOBS} SELECT CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1")
def jobs_interrupted(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.interrupted(jobs(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JOBS} SELECT service_id, count(*) AS pending, count(*) >= 100 AS full_ FROM jobs WHERE status IN ('queued', 'running') GROUP BY 1")
def pending_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.pending_full(jobs(spark, sf)).withColumnRenamed("full", "full_")


@query(f"WITH {JOBS} SELECT seq, 'running' AS status FROM jobs WHERE status = 'queued' OR (status = 'running' AND lease_until < 1704672000) ORDER BY created_at, seq LIMIT 20")
def claim_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.claim(jobs(spark, sf), F.lit(1704672000), 20).select("seq", "status")


@query(f"WITH {REQ}, t AS (SELECT source_id, max(revision) AS top FROM req GROUP BY source_id) SELECT seq, CASE WHEN revision = top THEN 'succeeded' ELSE 'superseded' END AS status FROM req JOIN t USING (source_id)")
def commit_status(spark: SparkSession, sf: str) -> DataFrame:
    r = requests(spark, sf)
    top = r.groupBy("source_id").agg(F.max("revision").alias("top"))
    return r.join(top, "source_id").select("seq", ledger.finish(F.col("revision"), F.col("top")).alias("status"))


@query("""WITH c AS (SELECT c_custkey AS token_id, CASE WHEN c_custkey % 2 = 0 THEN 'easyflow' ELSE 'svc' END AS service_id, c_acctbal >= 0 AS active, n.n_name AS corpus_id, c_custkey % 3 > 0 AS can
    FROM customer JOIN nation n ON c_nationkey = n_nationkey), p AS (SELECT n_name AS corpus_id, CASE WHEN n_nationkey % 2 = 0 THEN 'easyflow' ELSE 'plain' END AS kind, n_regionkey < 3 AS published FROM nation)
    SELECT token_id, corpus_id FROM c JOIN p USING (corpus_id) WHERE active AND can AND published AND (kind = 'easyflow') = (service_id = 'easyflow')""")
def grants_visible_corpora(spark: SparkSession, sf: str) -> DataFrame:
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    ops = F.when(F.col("c_custkey") % 3 > 0, F.array(F.lit("search"))).otherwise(F.array(F.lit("write")))
    tokens = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("token_id"), F.when(F.col("c_custkey") % 2 == 0, "easyflow").otherwise("svc").alias("service_id"), (F.col("c_acctbal") >= 0).alias("active"), F.create_map("n_name", ops).alias("grants"))
    corpora = n.select(F.col("n_name").alias("corpus_id"), F.when(F.col("n_nationkey") % 2 == 0, "easyflow").otherwise("plain").alias("kind"), F.when(F.col("n_regionkey") < 3, "published").otherwise("draft").alias("status"))
    return ledger.allowed(tokens, corpora).select("token_id", "corpus_id")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'embed_dim' END, CASE WHEN p_size % 3 = 0 THEN 'chunk_size' END, CASE WHEN p_size % 5 = 0 THEN 'single_chunk_char_hint' END], lambda x: x IS NOT NULL), ',') AS changed FROM part""")
def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    moved = lambda n: F.when(F.col("p_size") % n == 0, 2).otherwise(1)
    old = F.struct(F.lit("p").alias("doc_prefix"), F.lit(1).alias("embed_dim"), F.lit(1).alias("chunk_size"), F.lit(None).cast("int").alias("chunk_overlap"), F.lit(1).alias("single_chunk_char_hint"))
    new = F.struct(F.lit("p").alias("doc_prefix"), moved(2).alias("embed_dim"), moved(3).alias("chunk_size"), F.lit(None).cast("int").alias("chunk_overlap"), moved(5).alias("single_chunk_char_hint"))
    both = p.select("p_partkey", old.alias("o"), new.alias("n"))
    return both.select("p_partkey", F.array_join(X.changed_fields("o", "n"), ",").alias("changed"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 0 ELSE least(100, floor(o_custkey * 100 / (o_orderkey + 1)))::INT END AS percent FROM orders")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", X.progress_percent(F.col("o_custkey"), F.col("o_orderkey") + 1).alias("percent"))


@query(f"""WITH {DOCS}, {JOBS}, d AS (SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM docs GROUP BY source),
    j AS (SELECT 'src' || (corpus_id % 20) AS source, max(seq) AS job FROM jobs WHERE status IN ('queued', 'running') GROUP BY 1)
    SELECT d.source, documents, chars, coalesce(job, -1) AS job FROM d LEFT JOIN j USING (source)""")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))
    j = jobs(spark, sf).filter("status IN ('queued', 'running')").groupBy(F.concat(F.lit("src"), (F.col("corpus_id") % 20).cast("string")).alias("source")).agg(F.max("seq").alias("job"))
    return d.join(j, "source", "left").select("source", "documents", "chars", F.coalesce("job", F.lit(-1)).alias("job"))


@query(f"WITH {DOCS} SELECT doc_id, year, sha256('제목: ' || doc_id || ' | 분야: ' || source || chr(10) || text) AS invention_sha256, sha256('제목: ' || doc_id || chr(10) || text) AS plain_sha256 FROM docs")
def embed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The strings to embed, of title and whole text, as hashes."""
    d = documents(spark, sf).select("doc_id", X.decode_year(X.encode_year(F.col("year"))).alias("year"), F.col("doc_id").cast("string").alias("title"), F.col("source").alias("category"), "text")
    return d.select("doc_id", "year", F.sha2(INVENTION.embed_text(F.col("text")), 256).alias("invention_sha256"), F.sha2(PLAIN.embed_text(F.col("text")), 256).alias("plain_sha256"))


@query("""WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE trim(coalesce(text, '')) <> ''), n AS (SELECT conv_id, count(*)::INT AS n FROM p GROUP BY conv_id)
    SELECT c.conv_id || '::' || (row_number() OVER (PARTITION BY c.conv_id ORDER BY turn, text) - 1) AS chunk_id, n.n AS n_chunks, (turn + 1)::INT AS page FROM p c JOIN n USING (conv_id)
    WHERE c.conv_id % 3 > 0 AND c.conv_id % 4 > 0""")
def rebuild_managed(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that a rebuild of managed sources embeds: those of active, undeleted versions. Pages here are short: one chunk each."""
    key = F.col("conv_id").cast("string")
    jobs = paged(spark, sf).select(key.alias("job"), key.alias("source_id"), F.lit("index").alias("kind"), F.lit(1).cast("long").alias("revision"), F.lit("v").alias("source_version_id"), key.alias("title"), F.lit("h").alias("payload_hash"), "pages", "conv_id")
    states = jobs.select(F.when(F.col("conv_id") % 3 > 0, F.col("job")).alias("active_job"), (F.col("conv_id") % 4 == 0).alias("deleted"))
    active = ledger.rebuild_jobs(jobs.drop("conv_id").withColumnRenamed("job", "seq"), states).withColumnRenamed("seq", "job")
    return managed.job_chunks(active, "easyflow", CharBucketEmbedder(DIM)).select("chunk_id", "n_chunks", "page")


REVISED = "r AS (SELECT doc_id, source, text, doc_id % 7 AS revision, 'o' || doc_id % 13 AS operation_id FROM documents)"


def _revised(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks, one for each."""
    d = documents(spark, sf)
    return d.select(
        "doc_id", "source_path", F.concat("source_path", F.lit("::0")).alias("chunk_id"), F.col("text").alias("document"), F.col("source").alias("source_id"),
        (F.col("doc_id") % 7).cast("long").alias("revision"), F.concat(F.lit("o"), (F.col("doc_id") % 13).cast("string")).alias("operation_id"),
    )


@query(f"WITH {REVISED} SELECT doc_id FROM r WHERE source IN ('src1', 'src2', 'src3') AND revision < 5 AND revision <= 3 AND operation_id <> 'o1' AND operation_id IN (SELECT 'o' || (2 * range) FROM range(7))")
def predicate_operators(spark: SparkSession, sf: str) -> DataFrame:
    """Every operator of the predicate language."""
    where = {"source_id": {"$in": ["src1", "src2", "src3"]}, "$and": [{"revision": {"$lt": 5}}, {"revision": {"$lte": 3}}, {"operation_id": {"$in": [f"o{2 * i}" for i in range(7)]}}]}
    return _revised(spark, sf).filter(compile_where(where)).select("doc_id")


@query(f"""WITH {REVISED}, u AS (SELECT doc_id, source, operation_id, revision, CASE WHEN doc_id % 50 = 0 THEN 'new' ELSE sha256(coalesce(text, '')) END AS document FROM r)
    SELECT doc_id, document FROM u WHERE NOT (operation_id = 'o3' AND doc_id % 50 <> 0) AND NOT (source = 'src1' AND revision < 3) ORDER BY doc_id""")
def store_merge_on_read(spark: SparkSession, sf: str) -> DataFrame:
    """A collection of all documents, one in fifty replaced, then an operation and a source's old revisions removed by predicate: what a reader sees. Replaced chunks belong to no operation."""
    made = store.ChunkStore(spark, new_path(spark, "merged"), buckets=16)
    chunks = _revised(spark, sf).withColumn("title", F.col("doc_id").cast("string")).withColumn("document", F.sha2(F.coalesce("document", F.lit("")), 256))
    made.write("documents_v1", chunks.drop("doc_id"))
    made.upsert("documents_v1", chunks.filter("doc_id % 50 = 0").drop("doc_id").withColumn("document", F.lit("new")).withColumn("operation_id", F.lit(None).cast("string")))
    made.discard_operation("documents_v1", "o3")
    made.purge_revisions("documents_v1", "src1", 3)
    return made.read("documents_v1").select(F.col("title").cast("long").alias("doc_id"), "document")


@query("""WITH p AS (SELECT *, octet_length(encode(coalesce(html, ''))) AS n FROM pages)
    SELECT page_id, CASE WHEN n > 20971520 THEN 'too_large' WHEN trim(coalesce(html, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank' ELSE 'ok' END AS status,
        CASE WHEN n <= 20971520 AND trim(coalesce(html, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN sha256(nfc_normalize(html)) END AS sha256 FROM p""")
def zip_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All pages written to ZIP archives of about 50 entries, and read back as a data source."""
    p, folder = table(spark, sf, "pages"), new_path(spark, "zips")
    zips.write_zips(p.select(F.concat(F.lit("p"), F.floor(F.col("page_id") / 50).cast("string")).alias("archive"), F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("name"), F.col("html").alias("text")), folder).count()
    back = zips.read_zips(spark, folder, unzipped_bytes=64 * files.UPLOAD_BYTES)
    return back.select(F.regexp_replace("name", r"\.md$", "").cast("long").alias("page_id"), F.coalesce("reason", F.lit("ok")).alias("status"), F.sha2("text", 256).alias("sha256"))
