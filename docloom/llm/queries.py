"""The operators' queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import pii, product_codes, secrets
from docloom.llm.bpe import encode_documents
from docloom.llm.chroma import align, fingerprints, rendered
from docloom.llm.exact_dedup import exact_groups
from docloom.llm.jaccard import near_groups
from docloom.llm.language_id import language_digest
from docloom.llm.mixing import mix
from docloom.llm.prefix_trie import trie_digest
from docloom.llm.sharding import shard_by_bytes
from docloom.llm.vector_dedup import near_vectors
from docloom.llm.warc import warc_digest

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: every embedding is rendered as a recording; ids divisible by 50 are the queries."""
    prints = fingerprints(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", rendered)
    return align(prints).withColumnRenamed("id", "vec_id")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), words=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


def op5_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), VOCABULARY, ids=False, pattern=public_tokenizers.PATTERN)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_digest(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.code_digest(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_digest(_table(spark, sf_dir, "conversations"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_secret_scan, op2_exact_dedup, op3_chroma_fingerprints, op4_ngram_jaccard_join, op5_virtual_slot_sharding, op6_language_id, op7_source_mixing, op8_byte_bpe, op9_warc, op10_pii,
        op11_yinyang_codes, op12_prefix_trie, op13_embedding_dedup,
    )
    return {f.__name__: f for f in ops}


SPACE = r"[\x20\x09-\x0D]+"
NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """CTE found(row, kind, rank, s, e, hit): matches with offsets, after each kind's filter on hit."""
    parts = []
    for rank, (kind, (pattern, keep)) in enumerate(kinds.items()):
        p = pattern.replace("'", "''")
        parts.append(
            f"""SELECT row, '{kind}' AS kind, {rank} AS rank, hits[i] AS hit,
                 coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
               FROM (SELECT row, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d), generate_series(1, len(hits)) g(i)
               WHERE {keep.format(hit="hits[i]")}"""
        )
    union = " UNION ALL ".join(parts)
    return f"d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), found AS (SELECT *, s + length(hit) AS e FROM ({union}))"


def _counts_sql(base: list[str], found: str) -> str:
    text = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    ranked = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""agg AS (SELECT row, {counts}, string_agg({text}, ',' ORDER BY s, rank) FILTER (kind IN ({ranked})) AS base, string_agg({text}, ',' ORDER BY s, rank) AS spans FROM {found} GROUP BY row)
      SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans"""


def _op1_sql() -> str:
    kinds = {
        "assign": (secrets.ASSIGN, "length(regexp_extract({hit}, '" + ("^" + secrets.ASSIGN).replace("'", "''") + "', 2)) >= 8"),
        "access": (secrets.ACCESS, "true"),
        "hex": (secrets.HEX, "true"),
        "run": (f"{secrets.TOKEN}{{{secrets.WINDOW},}}", "true"),
    }
    most = "CASE " + " ".join(f"WHEN regexp_matches(hit, '{p}') THEN {secrets.limit(b)}" for p, b in secrets.CLASSES) + " END"
    w, mask = secrets.WINDOW, f"regexp_replace(hit, '{secrets.UUID}', '{secrets.MASK * 36}', 'g')"
    for word in secrets.ALLOW:
        mask = f"replace({mask}, '{word}', '{secrets.MASK * len(word)}')"
    return f"""WITH {_spans_sql(kinds)},
      runs AS (SELECT row, s, {most} AS most, {mask} AS hit FROM found WHERE kind = 'run'),
      windows AS (SELECT row, s, i, most, substr(hit, i, {w}) AS win FROM runs, generate_series(1, length(hit) - {w - 1}) g(i) WHERE most >= 0 AND NOT contains(substr(hit, i, {w}), '{secrets.MASK}')),
      chars AS (SELECT row, s, i, any_value(most) AS most, ch, count(*) AS c FROM (SELECT row, s, i, most, unnest(string_split(win, '')) AS ch FROM windows) GROUP BY row, s, i, ch),
      hot AS (SELECT row, s, i FROM chars GROUP BY row, s, i HAVING sum({secrets.weights()}[c + 1]) <= any_value(most)),
      edges AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY row, s ORDER BY i) > {w}, true) AS opens FROM hot),
      islands AS (SELECT *, sum(opens::INT) OVER (PARTITION BY row, s ORDER BY i) AS island FROM edges),
      every AS (SELECT row, kind, rank, s, e FROM found WHERE kind <> 'run' UNION ALL SELECT row, 'entropy', 3, s + min(i) - 1, s + max(i) + {w - 1} FROM islands GROUP BY row, s, island),
      {_counts_sql(secrets.BASE, "every")}, coalesce(n_entropy, 0)::BIGINT AS n_entropy FROM d LEFT JOIN agg USING (row) LEFT JOIN (SELECT row, count(*) AS n_entropy FROM every WHERE kind = 'entropy' GROUP BY row) USING (row)"""


def _iban_sql() -> str:
    """RE2 knows no lookahead: codes that are not registered are spelt by their first letter and the second letters left to it."""
    codes = " ".join(pii.IBAN_LENGTHS.values()).split()
    rest = r"[0-9]{2}(?:\x20?[A-Z0-9])"
    fixed = [f"(?:{c.replace(' ', '|')}){rest}{{{n - 4}}}" for n, c in pii.IBAN_LENGTHS.items()]
    letters = [chr(c) for c in range(65, 91)]
    free = "|".join(f"{a}[{''.join(b for b in letters if a + b not in codes)}]" for a in letters)
    return rf"\b(?:{'|'.join(fixed)}|(?:{free}){rest}{{11,30}})\b"


def _op10_sql() -> str:
    digits = "regexp_replace({hit}, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0"
    byte = pii.BYTE.replace("{", "{{").replace("}", "}}")
    compact = "replace({hit}, ' ', '')"
    moved = f"string_split(substr({compact}, 5) || substr({compact}, 1, 4), '')"
    value = "(CASE WHEN x BETWEEN '0' AND '9' THEN ord(x) - 48 ELSE ord(x) - 55 END)"
    mod97 = f"list_reduce(list_transform({moved}, lambda x: {value}), lambda t, v: (t * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", f"regexp_matches({{hit}}, '^{byte}\\.{byte}\\.{byte}\\.{byte}$')"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END"),
        "phone": (pii.PHONE, f"length({digits}) BETWEEN 10 AND 15"),
        "iban": (_iban_sql(), f"length({compact}) <= 34 AND {mod97}"),
        "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true"),
    }
    before, after = "substr(t, greatest(1, s::BIGINT + 1 - 40), least(s::BIGINT, 40))", "substr(t, e::BIGINT + 1, 40)"
    said = lambda k, words: " OR ".join(f"regexp_matches(lower({x}), '{words}')" for x in ([before] if k in pii.BASE else [before, after]))
    score = "CASE kind " + " ".join(
        f"WHEN '{k}' THEN {p + (c if k in ('card', 'iban') else 0)} + CASE WHEN {said(k, words)} THEN {near} ELSE 0 END"
        for k, (p, c, near, words) in pii.SCORES.items()
    ) + " END"
    return f"""WITH {_spans_sql(kinds)}, scores AS (SELECT found.*, {score} AS score FROM found JOIN d USING (row)),
      every AS (SELECT scores.* FROM scores JOIN d USING (row) WHERE rank < 4 OR score >= 60 AND (kind <> 'ssn' OR NOT contains(substr(t, s::BIGINT, least(s::BIGINT, 1)) || substr(t, e::BIGINT + 1, 1), '-'))),
      scored AS (SELECT row, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT || ':' || score, ',' ORDER BY rank, s) AS scored FROM every GROUP BY row),
      {_counts_sql(pii.BASE, "every")}, coalesce(scored, '') AS scored FROM d LEFT JOIN agg USING (row) LEFT JOIN scored USING (row)"""


OP2_SQL = f"""WITH d AS (SELECT doc_id, {NORMAL} AS t, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  r = max(r) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""

OP4_SQL = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex({NORMAL}, '{SPACE}'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
tok AS (SELECT row, len(s) AS n, unnest(s) AS k FROM sets),
near AS (SELECT a.row AS a, b.row AS b FROM tok a JOIN tok b ON a.k = b.k AND a.row <> b.row GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT row, row AS other FROM sets UNION SELECT r.row, b.b FROM reach r JOIN near b ON r.other = b.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach r ON s.row = r.row JOIN sets o ON o.row = r.other GROUP BY s.row, s.doc_id, len(s.s)"""

#: Filling up to a common level, and documents by rising hash up to the budget.
OP7_SQL = rf"""WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> ''))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open FROM w),
f AS (SELECT *, cap::HUGEINT * open < (total - capped) * w AS full_ FROM c),
l AS (SELECT *, (total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ())::DOUBLE / (sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ())::DOUBLE AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE w::DOUBLE * level END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM p),
h AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
u AS (SELECT h.source, h.h, words, sum(words) OVER (PARTITION BY h.source ORDER BY h.h)::BIGINT AS upto, budget FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
x AS (SELECT source, h, upto <= budget OR (upto - words < budget AND upto - budget < budget - (upto - words)) AS more FROM u)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.whole + CASE WHEN x.more AND b.whole < 3 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h"""

OP9_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep IS DISTINCT FROM page_id AND keep IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to FROM k"""


SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11_sql() -> str:
    """Lloyd rounds in plain form: all distances of every part to its codebook, as exact integers in doubles."""
    parts, entries, rounds, limit = product_codes.PARTS, product_codes.ENTRIES, product_codes.ROUNDS, product_codes.LIMIT
    assigned = lambda r: f"""a{r} AS MATERIALIZED (SELECT row, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT row, p.part, entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{r} c ON p.part = c.part) GROUP BY row, part)"""  # noqa: E731
    moved = lambda r: f"""m{r} AS (SELECT part, entry, i, floor(sum(x) / count(*)) AS x FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p JOIN a{r} USING (row, part)) GROUP BY part, entry, i),
      c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM m{r} GROUP BY part, entry) n USING (part, entry))"""  # noqa: E731
    steps = ", ".join(f"{assigned(r)}, {moved(r)}" for r in range(rounds)) + f", {assigned(rounds)}"
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: greatest(-{limit}, least({limit}, floor({product_codes.SCALE} * x::DOUBLE)))) AS v FROM embeddings WHERE {SOUND}),
      p AS MATERIALIZED (SELECT row, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM k, generate_series(0, {parts - 1}) g(part)),
      c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM p WHERE row <= {entries}), {steps},
      books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c{rounds})),
      coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN coded USING (row), books"""


#: crc32 by bytes and bits: 256 + byte is xored in, and followed by eight shifts (-1).
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_concat([256 + ord(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
  lambda c, op: CASE WHEN op >= 256 THEN xor(c, op - 256) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""

#: Prefixes are spelt out; sums over a subtree go from each node to all of its prefixes.
OP12_SQL = f"""WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
r AS (SELECT c.conv_id, place, role, text FROM c JOIN own ON own.conv_id = base AND place < h UNION ALL SELECT c.conv_id, place + 1000000, role, text FROM c JOIN own ON own.conv_id = c.conv_id AND place >= h),
s AS (SELECT conv_id, text, row_number() OVER w AS depth, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
e AS (SELECT conv_id, 0 AS depth, '' AS key, '' AS text FROM c UNION ALL SELECT conv_id, depth, key, text FROM s),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(key, depth) AS key FROM e GROUP BY conv_id) GROUP BY key),
n AS (SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS saved FROM e GROUP BY key),
p AS (SELECT n.*, up.key AS parent FROM n LEFT JOIN e up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
k AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN (SELECT parent AS key, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent) USING (key)),
sums AS (SELECT up.key, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM k JOIN e up ON up.conv_id = k.conv_id AND up.depth <= k.depth GROUP BY up.key)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM k JOIN sums USING (key) LEFT JOIN ends USING (key) LEFT JOIN n q ON q.key = k.parent"""

OP13_SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, vec_id, label, CASE WHEN {SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings),
near AS MATERIALIZED (SELECT a.row AS a, b.row AS b FROM d a JOIN d b ON a.label = b.label AND a.row <> b.row AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT row, row AS other FROM d UNION SELECT r.row, b FROM reach r JOIN near ON r.other = a),
c AS (SELECT r.row, min(o.vec_id) AS component_id FROM reach r JOIN d o ON o.row = r.other GROUP BY r.row)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (row) LEFT JOIN (SELECT a AS row, count(*) AS n FROM near GROUP BY a) USING (row)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": _op1_sql(), "op2_exact_dedup": OP2_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op7_source_mixing": OP7_SQL, "op9_warc": OP9_SQL, "op10_pii": _op10_sql(),
        "op11_yinyang_codes": _op11_sql(), "op12_prefix_trie": OP12_SQL, "op13_embedding_dedup": OP13_SQL,
    }
