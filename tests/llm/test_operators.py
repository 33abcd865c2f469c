import base64
import collections
import hashlib
import io
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docloom.llm import bpe, chroma, exact_dedup, jaccard, language_id, mixing, queries, secrets, sharding, warc
from docloom.llm.components import components
from docloom.llm.pii import pii_digest

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, sig string"


def table(spark, rows):
    """Rows (doc_id, text[, lang[, source]]); two extra columns clash with names that operators use."""
    full = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, lang, s, 0, "k", "g") for i, t, lang, s in full], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Straße", "ünï", "x1"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50 ", "other ")
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "ONE two"), (6, base), (7, near), (8, base.upper()), (9, long), (10, long + " end"), (None, base), (11, "a b c a b c"), (12, "日本 語 🙂"), (13, "!!!"), (4, "other text here now", None, None)]
    return table(spark, rows)


OPERATORS = [
    secrets.secrets_digest, exact_dedup.exact_groups, jaccard.near_groups, sharding.shard_by_bytes, language_id.language_digest, mixing.mix,
    lambda d: bpe.encode_documents(d, queries.VOCABULARY), pii_digest,
]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    """A written file without rows: its plan stays a scan, so that Python stages run over it."""
    path = str(tmp_path_factory.mktemp("empty") / "d")
    table(spark, []).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("f", OPERATORS)
def test_odd_rows_and_empty_tables(odd, empty, f):
    assert f(odd).count() == odd.count()
    assert f(empty).count() == 0


def test_language_without_labels_or_ids(spark, tmp_path):
    rows = [(1, "some words here", None, "s"), (2, "more words", None, "s"), (None, None, None, "s")]
    spark.createDataFrame([(*r, 0, "k", "g") for r in rows], DOC).write.parquet(f"{tmp_path}/u")
    got = language_id.language_digest(spark.read.parquet(f"{tmp_path}/u")).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == 3
    assert language_id.keep_identified(spark.read.parquet(f"{tmp_path}/u")).count() == 0
    table(spark, [(None, t, lang, "s") for t, lang in [("the cat", "en"), ("der hund", "de")] * 50]).write.parquet(f"{tmp_path}/n")
    got = language_id.language_digest(spark.read.parquet(f"{tmp_path}/n")).collect()
    assert {r.lang_pred for r in got} <= {"en", "de"} and len(got) == 100


def test_sampling_is_bounded_under_one_id(spark):
    rows = [(7, f"w{i % 50} common", "en", "s") for i in range(6000)] + [(8, "w1 common", "en", "s")] * 3000
    model = language_id.learn(table(spark, rows), per_lang=500)
    n = float(np.exp(model.words.logs[model.words.rows()["common"], 0]))
    assert model.langs == ["en"] and 0.3 < n < 0.7  # half of the sampled words, however the rows were picked
    held = []

    class Seen(language_id.Model):
        def __init__(self, words, grams, order):
            held.append(sum(words.column("n").to_pylist()))
            super().__init__(words, grams, order)

    real, language_id.Model = language_id.Model, Seen
    try:
        language_id.learn(table(spark, rows), per_lang=500)
    finally:
        language_id.Model = real
    assert 2 * 350 < held[0] < 2 * 700


@pytest.mark.parametrize("one", [None, 7])
def test_mix_of_rows_under_one_id(spark, one):
    rng = random.Random(5)
    rows = [(one, " ".join(f"w{rng.random()}" for _ in range(10)), "en", s) for s in "aabc" for _ in range(100)]
    got = mixing.mix(table(spark, rows)).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5.01 and max(r.taken for r in mine) <= 30


def test_one_row_of_each_group_stays_under_any_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base), (1, base.replace("w3 ", "x ")), (2, base + " end"), (None, base), (None, None), (None, None), (3, "a b c d e f"), (3, "g h i j k l")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard.keep_one_of_each_group(table(spark, rows)).collect()))
    assert [g[:2] for g in got] == [(False, 1), (False, 3), (False, 3), (True, 0), (True, 0)]
    only = [(None, base)] * 5
    assert jaccard.keep_one_of_each_group(table(spark, only)).count() == 1


def test_many_secrets_in_one_run_take_seconds(spark):
    rng = random.Random(4)
    run = ("".join(rng.choice(secrets.SYMBOLS) for _ in range(24)) + "a" * 46)
    text = "".join("".join(rng.choice(secrets.SYMBOLS) for _ in range(24)) + "a" * 46 for _ in range(30_000))
    few = run * 3
    began = time.time()
    got = {r.doc_id: r.entropy for r in secrets.scan_secrets(table(spark, [(1, text), (2, few)])).collect()}
    assert len(got[1]) > 25_000 and all(text[s.start : s.end] == s.hit for s in got[1][::997])
    assert [(s.start, s.end) for s in got[2]] == entropy_spans(few) and all(few[s.start : s.end] == s.hit for s in got[2])
    assert time.time() - began < 60


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = db.sql(queries.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def entropy_spans(text, allow=secrets.ALLOW):
    """By fresh counts in every window, marking characters."""
    out = []
    for m in re.finditer(secrets.TOKEN + "{20,}", text):
        hit = m[0]
        bits = next(b for p, b in secrets.CLASSES if re.search(p, hit))
        barred = {i for w in map(re.escape, allow) for x in re.finditer(w, hit) for i in range(*x.span())} | {i for x in re.finditer(secrets.UUID, hit) for i in range(*x.span())}
        marked = set()
        for i in range(len(hit) - 19):
            c = collections.Counter(hit[i : i + 20])
            if bits is not None and not barred & set(range(i, i + 20)) and -sum(n / 20 * math.log2(n / 20) for n in c.values()) >= bits - 1e-9:
                marked |= set(range(i, i + 20))
        starts = sorted(i for i in marked if i - 1 not in marked)
        ends = sorted(i + 1 for i in marked if i + 1 not in marked)
        out += [(m.start() + a, m.start() + b) for a, b in zip(starts, ends, strict=True)]
    return out


def found_entropy(spark, texts, **kw):
    return {r.doc_id: [(s.start, s.end) for s in r.entropy] for r in secrets.scan_secrets(table(spark, list(enumerate(texts))), **kw).collect()}


def test_entropy_windows(spark):
    rng = random.Random(1)
    alphabets = ["abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", secrets.SYMBOLS, "a1", "abcdefgh", "0123456789", secrets.SYMBOLS[:52], "x"]
    spell = lambda: "".join(rng.choice(alphabets[k]) for k in rng.choices(range(8), k=3) for _ in range(rng.randint(1, 60)))
    texts = [" é ".join("".join(rng.choice(a) for _ in range(rng.randint(15, 60))) for a in rng.choices(alphabets, k=6)) for _ in range(60)]
    texts += [rng.choice(["", "example", "x" * 8, "12345678-abcd-abcd-abcd-1234567890ab"]).join(spell() for _ in range(12)) for _ in range(30)]
    assert max(map(len, texts)) > 3 * secrets.PIECE
    got = found_entropy(spark, texts)
    assert got == {i: entropy_spans(t) for i, t in enumerate(texts)} and any(got.values())


def test_allow_list_and_separate_secrets(spark):
    key, other = "q7Gz9LmX2vTb4RkY8wNc6P", "Zt5Wq8Hs1Jd4Fn7Bv0KxMy"
    texts = [key, f"key/{key}/example/{other}", key + "a" * 500 + other, "kQzWvXjPbLmRtYcHgNfDsUoEaIqZxJ"]
    got = found_entropy(spark, texts)
    assert len(got[0]) == 1 and len(got[1]) == 2 and len(got[2]) == 2 and got[2][0][1] < 60 and len(got[3]) == 1
    assert found_entropy(spark, texts[:2], allow=(*secrets.ALLOW, key)) == {0: [], 1: entropy_spans(texts[1], (*secrets.ALLOW, key))}


def test_long_runs_and_many_matches_take_seconds(spark):
    rng = random.Random(11)
    blob = base64.b64encode(rng.randbytes(1_500_000)).decode()
    began = time.time()
    got = found_entropy(spark, [blob, "token=abcdefgh12 " * 100_000])
    assert sum(b - a for a, b in got[0]) > 0.99 * len(blob) and not got[1]
    r = pii_digest(table(spark, [(1, "é a.b@c.de " * 100_000)])).first()
    assert r.n_email == 100_000 and r.spans.endswith(f"email:{11 * 99_999 + 2}:{11 * 99_999 + 10}")
    assert time.time() - began < 120


def test_linear_and_deep_matches(spark):
    r = pii_digest(table(spark, [(1, "1" * 200_000), (2, "a." * 100_000 + "@x.y"), (3, "GB82 WEST 1234 5698 7654 32"), (4, "my ssn is 123-45-6789, not 987-65-4321x")])).orderBy("doc_id").collect()
    assert r[1].n_email == 1 and r[2].spans.startswith("iban:0:27") and r[3].spans == "ssn:10:21"


def test_ibans_end_at_their_length_and_context_may_follow(spark):
    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 2024-01-01", "123-45-6789 (SSN)", "DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "DE89370400440532013001 x", "TR33 0006 1005 1978 6457 8413 26 IBAN"]
    got = {r.doc_id: [x for x in r.scored.split(",") if x[:4] in ("iban", "ssn:")] for r in pii_digest(table(spark, list(enumerate(texts)))).collect()}
    assert got == {0: ["iban:0:27:80"], 1: ["iban:0:22:80"], 2: ["ssn:0:11:80"], 3: ["iban:0:22:80", "iban:23:50:80"], 4: [], 5: ["iban:0:32:100"]}


def test_pii_sql_on_ibans_and_security_numbers(spark, tmp_path):
    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 2024-01-01", "123-45-6789 (SSN)", "DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "DE89370400440532013001 x", "TR33 0006 1005 1978 6457 8413 26 IBAN", "ssn -123-45-6789",
             "ssn 123-45-6789-1", "ssn 123-45-6789", "", None, "XX89 3704 0044 0532 0130 00", "é GB82 WEST 1234 5698 7654 32. " * 3, "social security 111-22-3333 444-55-6666"]
    docs = table(spark, list(enumerate(texts)))
    docs.write.parquet(f"{tmp_path}/d")
    want = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/d/*.parquet') SELECT doc_id, spans, scored, base_sha256 FROM ({queries.oracle_sql()['op10_pii']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in pii_digest(docs).select("doc_id", "spans", "scored", "base_sha256").collect())


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 32}, {"block_bytes": 32, "fingerprint": lambda c: F.pmod(F.xxhash64(c), F.lit(3))}])
def test_block_naming(spark, kw):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abÄ") for _ in range(n)) for n in (0, 5, 31, 32, 33, 64, 65, 100, 100)]
    rows = [(i, rng.choice([t, t.upper(), t.swapcase()])) for i, t in enumerate(texts * 4)] + [(1, texts[1]), (99, None)]
    lower = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    got = exact_dedup.exact_groups(table(spark, rows), **kw).collect()
    want = sorted((i, max(g), len(g)) for g in groups.values() for i in g)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def brute_components(texts, words, num, den):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and common * (num + den) >= num * (len(sets[a]) + len(sets[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("k", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_equals_all_pairs(spark, k):
    rng = random.Random(4)
    shared = [f"p{i}" for i in range(40)]
    texts = ["", "a", "a b", "A B"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([4, 12, 60, 200]))] + shared * rng.randint(0, 1)
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    got = jaccard.near_groups(table(spark, list(enumerate(texts))), words=k[0], num=k[1], den=k[2]).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts, *k)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_shards(spark, sf):
    r = sharding.shard_by_bytes(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")).toPandas()
    sums = r.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() - sums.min() < 0.05 * sums.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in r.groupby("shard")["slot"])
    old = sharding.initial_map(64, 8)
    new = sharding.rebalance(old, [100] * 64, 8)
    assert new == old  # nothing to move


def test_stored_map_is_edited(spark, tmp_path):
    """Two rebalances edit the same map and move few slots; columns against plain sums."""
    rng = random.Random(12)
    rows = [(i, "é" * rng.randint(0, 300)) for i in range(3000)] + [(None, None), (5, "again")]
    path = f"file://{tmp_path}/map"
    stored = sharding.SlotMap(spark, path)
    shard_of = lambda v: [r.shard for r in stored.read(v).orderBy("slot").collect()]
    r = sharding.shard_by_bytes(table(spark, rows), 8, slots=256, map_path=path).collect()
    assert stored.version() == 2 and shard_of(1) == sharding.initial_map(256, 8) and {x.map_version for x in r} == {2}
    text = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((x.doc_id, x.size, x.text_crc32) for x in r) == text
    second = shard_of(2)
    assert all(second[x.virtual_slot] == x.shard for x in r)
    assert sorted((x.shard, x.slot) for x in r) == [(k, i) for k, n in sorted(collections.Counter(x.shard for x in r).items()) for i in range(n)]
    more = [*rows, *((i, "x" * 2000) for i in range(5000, 5040))]
    r = sharding.shard_by_bytes(table(spark, more), 8, slots=256, map_path=path).toPandas()
    moved = sum(a != b for a, b in zip(shard_of(2), shard_of(3), strict=True))
    sums = r.groupby("shard")["size"].sum()
    assert stored.version() == 3 and 0 < moved < 60 and sums.max() - sums.min() < 0.05 * sums.mean()
    grown = sharding.shard_by_bytes(table(spark, more), 9, slots=256, map_path=path).toPandas()
    assert stored.version() == 4 and set(grown["shard"]) == set(range(9))


def test_rebalance_goes_on_beside_a_heavy_slot():
    sizes = [10_000] + [1 + i % 7 for i in range(1, 64)]
    new = sharding.rebalance(sharding.initial_map(64, 8), sizes, 8)
    load = [sum(b for b, k in zip(sizes, new, strict=True) if k == s) for s in range(8)]
    others = sorted(load)[:-1]
    assert sorted(load)[-1] == 10_000 and others[-1] - others[0] <= 1


def test_hot_ids_are_spread(spark):
    rows = [(None, f"text {i:04d}") for i in range(2000)] + [(7, f"more {i:04d}") for i in range(2000)] + [(100 + i, f"rest {i:04d}") for i in range(2000)]
    r = sharding.shard_by_bytes(table(spark, rows)).toPandas()
    sums = r.groupby("shard")["size"].sum()
    assert len(r) == 6000 and len(sums) == 40 and sums.max() - sums.min() < 0.1 * sums.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in r.groupby("shard")["slot"])


def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    r = language_id.language_digest(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in r) >= 0.95 * len(r)


def brute_language(text, labelled, order=4):
    """Fresh counts in dictionaries, and one word at a time."""
    langs = sorted({lang for _, lang in labelled})
    by_word = {lang: collections.Counter(w for t, x in labelled if x == lang for w in language_id.words(t)) for lang in langs}
    by_gram = [{lang: collections.Counter() for lang in langs} for _ in range(order)]
    for lang in langs:
        for w, n in by_word[lang].items():
            for k in range(1, order + 1):
                for i in range(len(w) + 3 - k):
                    by_gram[k - 1][lang][f" {w} "[i : i + k]] += n

    def log(table, x):
        size = len(set().union(*table.values()))
        return [math.log(table[lang][x] + 0.5) - math.log(sum(table[lang].values()) + 0.5 * size) for lang in langs]

    sums, found = [0.0] * len(langs), language_id.words(text)
    for w in found:
        if any(by_word[lang][w] for lang in langs):
            parts = [log(by_word, w)]
        else:
            parts, rest = [], f" {w} "
            while rest:
                size = next((k for k in range(min(order, len(rest)), 0, -1) if any(by_gram[k - 1][lang][rest[:k]] for lang in langs)), 0)
                parts += [log(by_gram[size - 1], rest[:size])] if size else []
                rest = rest[max(1, size) :]
        sums = [a + sum(p[i] for p in parts) for i, a in enumerate(sums)]
    if not found:
        return "und", 0.0
    x = [math.exp((s - max(sums)) / math.sqrt(len(found))) for s in sums]
    return langs[x.index(max(x))], max(x) / sum(x)


def test_language_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "REMEMBERED", 40)
    rng = random.Random(9)
    spell = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 6)))
    letters = {"aa": "abcdeé", "bb": "defgh", "cc": "ghijkß"}
    words = {lang: [spell(a) for _ in range(30)] for lang, a in letters.items()}
    labelled = [(" ".join(rng.choice(words[lang]) for _ in range(12)), lang) for lang in letters for _ in range(20)]
    texts = [t for t, _ in labelled] + [" ".join(spell(letters[rng.choice("abc") * 2]) for _ in range(rng.randint(1, 20))) for _ in range(40)] + ["", None, "12 !", "zzz", "abc1def"]
    model = language_id.learn(table(spark, [(i, *x) for i, x in enumerate(labelled)]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(table(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        want = brute_language(t or "", labelled)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-4


def test_language_with_few_words_stays(spark):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(50)).translate(str.maketrans("0123456789", "abcdefghij")), "big") for i in range(60)] + [(100, "zwölf böse möwen", "small")]
    model = language_id.learn(table(spark, rows))
    got = language_id.identify(table(spark, [(1, "böse möwen"), (2, "wordaxb")]), model).collect()
    assert model.langs == ["big", "small"] and [r.lang_pred for r in got] == ["small", "big"]


def test_mixing_targets(spark, odd):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", s) for i, s in enumerate("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaabbbc" * 20)] + [(9999, "x y", "en", None)]
    r = mixing.mix(table(spark, rows)).toPandas()
    s = r.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(s.target.sum() - r["size"].sum()) < 1e-6 and (s.target <= 3 * s["size"] + 1e-9).all()
    assert (abs(s.taken - s.target) <= 7).all() and (r.taken <= 3 * r["size"]).all()
    times = collections.Counter(dict(zip(r.doc_id, r.repeats, strict=True)))
    mixed = mixing.mixed_documents(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns and collections.Counter(x.doc_id for x in mixed.collect()) == +times


def test_bpe_equals_tiktoken(spark):
    codec = bpe.Codec(queries.VOCABULARY)
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    chars = "aAeb 's\n\t\x1c\x85 　éßñ²½Ⅷ日本語한국🙂𝒳'1290.,"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, " " * 500 + "x"]
    assert list(bpe.Encoder(codec).encode(texts)) == [lib.encode_ordinary(t) for t in texts]
    rows = bpe.encode_documents(table(spark, list(enumerate(texts))), queries.VOCABULARY).collect()
    assert all(r.ids == lib.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_replay_handles_low_ranks_from_merges(tmp_path):
    """A merge may open a pair of lower rank; the library then takes that first."""
    import base64

    ranks = {bytes([i]): i for i in range(256)}
    for i, t in enumerate([b"abab", b"ab", b"aba", b"bab", b"aab", b"aabab"]):
        ranks[t] = 256 + i
    path = tmp_path / "r"
    path.write_text("".join(f"{base64.b64encode(b).decode()} {r}\n" for b, r in ranks.items()))
    lib = tiktoken.Encoding("t2", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(w) for n in range(1, 11) for w in itertools.product("ab", repeat=n)]
    assert bpe.Codec(str(path)).replay([w.encode() for w in words]) == [tuple(lib.encode_ordinary(w)) for w in words]


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u\r\n", big, 1), (2, "u", big, 1), (3, None, "small", 1), (4, "v", "small", 1), (None, "w", None, 1), (5, "x", big + "1", 1), (2, "u", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, keep int")
    folder = f"file://{tmp_path}/w"
    m = warc.write_warc(pages, folder)
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read_warc(m, folder).collect())
    assert got == [(0, "response", None, 0, ""), (1, "revisit", 2, 1200, None), (2, "response", None, 1200, big), (2, "response", None, 1200, big), (3, "response", None, 5, "small"), (4, "response", None, 5, "small"), (5, "response", None, 1201, big + "1")]
    assert warc.warc_digest(pages.limit(0)).count() == 0
    files = [p.read_bytes() for p in (tmp_path / "w").iterdir()]
    found = []
    for rest in files:  # by zlib alone: each member is one record
        while rest:
            one = zlib.decompressobj(wbits=31)
            found.append(one.decompress(rest) + one.flush())
            rest = one.unused_data
    assert len(found) == len(rows) and all(f.startswith(b"WARC/1.1\r\n") and f.endswith(b"\r\n\r\n") for f in found)
    data = files[0]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-9])))
    whole = next(m for m in warc.members(io.BytesIO(data)))
    assert warc.parse(whole)["record_type"] in ("response", "revisit")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(whole.replace(b"HTTP/1.1 200", b"HTTP/1.1 201"))


def test_foreign_records():
    """Other writers leave out block digests, name records as they like, and write records that are no responses."""
    rec = lambda kind, block, *more: b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:1>", *more, b"Content-Length: %d" % len(block), b"", block, b"", b""])
    info = warc.parse(rec(b"warcinfo", b"software: x\r\n"))
    assert (info["record_type"], info["page_id"], info["payload_bytes"], info["url"]) == ("warcinfo", None, 13, None)
    http = b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n<p>"
    got = warc.parse(rec(b"response", http, b"WARC-Target-URI: http://a"))
    assert (got["payload"], got["payload_bytes"], got["payload_digest"]) == (b"<p>", 3, hashlib.sha1(b"<p>").hexdigest())
    assert warc.parse(rec(b"request", b"GET / HTTP/1.1\r\n\r\n"))["payload_bytes"] == 0
    with pytest.raises(ValueError):
        warc.parse(rec(b"response", http, b"WARC-Block-Digest: sha1:" + b"A" * 32))


def test_recordings_align():
    v = list(np.random.default_rng(1).normal(0, 0.3, 64))
    x = chroma.sonify(v)
    noise = np.random.default_rng(2).normal(0, 0.01, len(x))
    whole, late = chroma.fingerprint(chroma.chroma(x)), chroma.fingerprint(chroma.chroma((x + noise)[2560:]))
    errors = [bin(int(a) ^ int(b)).count("1") for a, b in zip(whole[10:], late, strict=True)]
    assert np.mean(errors) < 2


def test_alignment_finds_offsets(spark):
    rng = np.random.default_rng(3)
    v = [float(x) for x in rng.normal(0, 0.3, 64)]
    others = [[float(x) for x in rng.normal(0, 0.3, 64)] for _ in range(3)]
    rows = [(50, v), (1, v[8:]), (2, v), (3, others[0]), (4, None), (5, []), (None, others[1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.class_id, r.best_query, r.offset) for r in chroma.align(chroma.fingerprints(d, "vec_id", "embedding", chroma.rendered)).collect()}
    assert got[2] == (2, 50, 0) and got[50] == (2, 50, 0) and got[1] == (1, 50, -16) and got[3] == (3, None, None) and got[4] == (None, None, None)


def test_alignments_keep_all_partners(spark):
    rng = np.random.default_rng(7)
    v = [float(x) for x in rng.normal(0, 0.3, 64)]
    rows = [(50, v), (100, v[4:]), (1, v[8:]), (2, v), (3, v[:48])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: r for r in chroma.align(chroma.fingerprints(d, "vec_id", "embedding", chroma.rendered)).collect()}
    full = lambda i: {(a.query, a.offset) for a in got[i].alignments if a.bit_error < 0.1}
    assert got[50].class_id == 2 and got[50].alignments is None
    assert full(2) == {(100, 8)} and full(100) == {(50, -8)} and full(1) == {(50, -16), (100, -8)} and full(3) == {(50, 0), (100, 8)}


def test_query_blocks_equal_brute_force(monkeypatch):
    monkeypatch.setattr(chroma, "EXPANDED", 50)
    rng = np.random.default_rng(4)
    prints = [rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint32) << np.uint32(8) for _ in range(30)]
    prints += [prints[0][5:], np.zeros(30, np.uint32), np.zeros(25, np.uint32)]
    queries = range(0, len(prints), 3)
    got = chroma.QueryBlock(np.array(list(queries)), [prints[i].view(np.int32) for i in queries]).best([p.view(np.int32) for p in prints], 4, 0.25)
    for p, g in zip(prints, got, strict=True):
        found = []
        for k in queries:
            votes = collections.Counter(i - j for i, x in enumerate(p) for j, y in enumerate(prints[k]) if x >> 8 == y >> 8)
            at = max(votes, key=lambda o: (votes[o], -abs(o), o), default=None)
            if at is not None and votes[at] >= 4:
                both = [(int(p[i]), int(prints[k][i - at])) for i in range(len(p)) if 0 <= i - at < len(prints[k])]
                found.append((sum((x ^ y).bit_count() for x, y in both) / (32 * len(both)), k, at))
        assert g == min((f for f in found if f[0] <= 0.25), default=None)


@pytest.mark.parametrize("expanded", [50, 2_000_000])
def test_alignments_equal_all_offsets(monkeypatch, expanded):
    """Without keys or votes: noisy and shifted copies up to the limit, and recordings of one to three integers."""
    monkeypatch.setattr(chroma, "EXPANDED", expanded)
    monkeypatch.setattr(chroma, "TILE", expanded)
    rng = np.random.default_rng(8)
    prints = [rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) for n in (118, 118, 1, 2, 3, 40, 200)]
    for share in (0.05, 0.15, 0.2, 0.23, 0.3):
        flips = (rng.random((118, 32)) < share) @ (1 << np.arange(32, dtype=np.uint64))
        prints += [prints[0] ^ flips.astype(np.uint32), (prints[0] ^ flips.astype(np.uint32))[30:]]
    prints += [prints[0][7:8], prints[0][9:12]]
    queries = [0, 2, 4, 6, 8]
    block = chroma.QueryBlock(np.array(queries), [prints[i].view(np.int32) for i in queries])
    got = block.others([p.view(np.int32) for p in prints], 4, 0.25)
    for p, g in zip(prints, got, strict=True):
        want = []
        for k in queries:
            for o in range(1 - len(prints[k]), len(p)) if not np.array_equal(p, prints[k]) else []:
                lo, hi = max(0, o), min(len(p), len(prints[k]) + o)
                e = int(np.bitwise_count(p[lo:hi] ^ prints[k][lo - o : hi - o]).sum()) / (32 * (hi - lo))
                if hi - lo >= min(4, len(p), len(prints[k])) and e <= 0.25:
                    want.append((e, k, o))
        assert sorted(g) == sorted(want)
    assert {(k, o) for _, k, o in got[13]} >= {(0, 0)} and {(k, o) for _, k, o in got[18]} >= {(0, -9)}


@pytest.mark.parametrize(("longest", "lanes"), [(124, 4), (125, 4), (126, 3), (999, 3), (1000, 3), (1001, 1)])
def test_recordings_share_sums_and_keep_alignments(monkeypatch, longest, lanes):
    """Equal, opposite and random neighbours in one sum, to the longest that fit and beyond; a sum for each pair only where they do not fit."""
    sums, way_back = [0], np.fft.irfft

    def counted(both, n, axis, out):
        sums[0] += both[0].size
        return way_back(both, n, axis=axis, out=out)

    monkeypatch.setattr(np.fft, "irfft", counted)
    rng = np.random.default_rng(9)
    one = rng.integers(0, 2**32, longest, dtype=np.uint64).astype(np.uint32)
    near = one ^ ((rng.random((longest, 32)) < 0.24) @ (1 << np.arange(32, dtype=np.uint64))).astype(np.uint32)
    other = rng.integers(0, 2**32, longest - 1, dtype=np.uint64).astype(np.uint32)
    prints = [one, ~one, near, ~near, near, ~one, ~one, other, one[1:], near, near, near, one[: -longest // 3], ~one[: -longest // 3]]
    queries = [0, 1, 7]
    block = chroma.QueryBlock(np.array(queries), [prints[i].view(np.int32) for i in queries])
    rec, query, offset, error = block.links([p.view(np.int32) for p in prints], 4, 0.25)
    want = []
    for r, p in enumerate(prints):
        for k in (0, 1, 2):
            q = prints[queries[k]]
            for o in range(4 - len(q), len(p) - 3) if not np.array_equal(p, q) else []:
                lo, hi = max(0, o), min(len(p), len(q) + o)
                e = int(np.bitwise_count(p[lo:hi] ^ q[lo - o : hi - o]).sum()) / (32 * (hi - lo))
                if e <= 0.25:
                    want.append((r, e, k, o))
    assert list(zip(rec.tolist(), error.tolist(), query.tolist(), offset.tolist(), strict=True)) == sorted(want)
    assert {(2, 0, 0), (8, 0, -1), (12, 0, 0), (13, 1, 0)} <= set(zip(rec.tolist(), query.tolist(), offset.tolist(), strict=True))
    assert sums[0] == len(queries) * -(-len(prints) // lanes)


@pytest.mark.parametrize("bins", [1, 2**22])
def test_votes_are_counted_for_pairs_with_alignments_only(monkeypatch, bins):
    """The same best queries as from votes of all pairs, of which few are counted; unrelated recordings share keys, but no alignment."""
    monkeypatch.setattr(chroma, "BINS", bins)
    monkeypatch.setattr(chroma, "EXPANDED", 500)
    rng = np.random.default_rng(12)
    prints = [rng.integers(0, 2**32, 60, dtype=np.uint64).astype(np.uint32) for _ in range(40)]
    for p in prints:
        p[20:24] = [1 << 8, 2 << 8, 3 << 8, 4 << 8]
    prints += [prints[0][8:], prints[5] ^ np.uint32(3), prints[10][:30], prints[0]]
    queries = list(range(0, 40, 5))
    block = chroma.QueryBlock(np.array(queries), [prints[i].view(np.int32) for i in queries])
    prints = [p.view(np.int32) for p in prints]
    counted, unique = [0], np.unique

    def counting(codes, **kw):
        counted[0] += len(codes)
        return unique(codes, **kw)

    best, links = block.best(prints, 4, 0.25), block.links(prints, 4, 0.25)
    monkeypatch.setattr(np, "unique", counting)
    found, others = block.best_and_links(prints, 4, 4, 0.25)
    assert found == best and all(np.array_equal(x, y) for x, y in zip(others, links, strict=True))
    assert found[40][1:] == (0, -8) and found[41][1:] == (5, 0) and found[42][1:] == (10, 0) and found[1] is None
    if bins > 1:
        some, counted[0] = counted[0], 0
        block.best(prints, 4, 0.25)
        assert some < counted[0] / 2
    assert block.best_and_links(prints, 3, 4, 0.25)[0] == block.best(prints, 3, 0.25)


def test_queries_spectra_serve_a_batch(monkeypatch):
    """A task's 5,000 recordings meet a few queries in one run: the queries' spectra are made once. With many queries a run stays bounded."""
    made, spectra = [0], chroma._spectra

    def counting(prints, n, real, lane_bits=0):
        made[0] += 0 if lane_bits else len(prints)
        return spectra(prints, n, real, lane_bits)

    monkeypatch.setattr(chroma, "_spectra", counting)
    prints = [np.full(20, i, np.int32) for i in range(5000)]
    block = chroma.QueryBlock(np.arange(3), prints[:3])
    assert list(chroma._spans(np.full(5000, 20), 20_000)) == [(0, 2000), (2000, 4000), (4000, 5000)]
    for i, j in chroma._spans(np.full(5000, 20), len(block.ids)):
        block.best_and_links(prints[i:j], 4, 4, 0.01)
    assert made[0] == 3


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(6)
    words = {"en": "the house of water and light was near them".split(), "de": "das haus und der weg war nicht weit von".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "n"]) for _ in range(80)), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de"] * 30)]
    near = rows[0][1].split()
    near[40] = "changed"
    extra = [(100, rows[0][1].upper(), "en", "s0"), (101, " ".join(near), "en", "s1"), (102, "12345 !!", "en", "s2"), (103, None, None, None)]
    d = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs, ids = d, {}
    for name, stage in p.STAGES[:-1]:
        docs = p.materialise(stage(spark, docs, ""), name)
        assert docs.columns == d.columns
        ids[name] = collections.Counter(r.doc_id for r in docs.collect())
    assert set(ids["language_id"]) == set(range(60)) | {100, 101}
    assert set(ids["exact_dedup"]) == set(range(1, 60)) | {100, 101}
    assert set(ids["ngram_jaccard_join"]) == set(range(1, 60)) | {100}
    assert set(ids["source_mixing"]) <= set(ids["ngram_jaccard_join"])
    assert p.STAGES[-1][1](spark, docs, "").count() == sum(ids["source_mixing"].values())


def test_pipeline_of_empty_unlabelled_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    run = lambda name: p.run(spark, f"{tmp_path}/{name}")
    write = lambda name, rows: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    write("empty", [])
    assert run("empty").count() == 0
    write("unlabelled", [(i, "some text of words", None, "s", 0) for i in range(9)])
    assert run("unlabelled").count() == 0
    rng = random.Random(8)
    texts = [" ".join(rng.choice("the house of water and light was near them".split()) + rng.choice("abcdef") for _ in range(40)) for _ in range(20)]
    write("repeated", [(None, t, "en", "s", 0) for t in texts] * 3 + [(None, texts[0] + " more", "en", "s", 0), (7, None, "en", "s", 0)])
    got = run("repeated").collect()
    assert len({r.ids_sha256 for r in got}) == len(got) == 20
