import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from docloom.llm import prefix_trie, product_codes, queries, running, vector_dedup
from docloom.llm.shared import materialise

VEC = "vec_id long, embedding array<float>, label int, v string, cls string"
TURN = "conv_id long, turn long, role string, text string, digest string, key string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VEC)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURN)


def written(spark, df, path):
    """As a table of files: an empty one stays a scan, where a plan over no rows would be cut short."""
    df.write.parquet(path)
    return spark.read.parquet(path)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd rounds over Python integers."""
    kept = [(i, e, lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(e) for _, e, _ in kept if e and len(e) % parts == 0), None)
    fit = [(i, [max(-(1 << 26), min(1 << 26, math.floor(x * 1024))) for x in e], lab) for i, e, lab in kept if len(e) == size]
    w = size // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for _, v, _ in fit]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda: [[min((dist(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = best()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    at = best()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in a) for a in at]
    by = {}
    for (_, _, lab), e in zip(fit, errors, strict=True):
        by[lab] = by.get(lab, 0) + e
    out = [(i, "".join(f"{k:02x}" for _, k in a), e, by[lab], sha) for (i, _, lab), a, e in zip(fit, at, errors, strict=True)]
    return out + [(i, None, None, by.get(lab), sha) for i, e, lab in kept if len(e) != size]


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def odd_vectors(rng, n, dim, scale):
    rows = [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(dim)], rng.choice([1, 1, 2, None])) for i in range(n)]
    zero, nan = [0.0] * dim, [float("nan"), *[1.0] * (dim - 1)]
    return rows + [(None, rows[3][1], 1), (5, rows[5][1], 2), (5, rows[6][1], 2), (n, None, 1), (n + 1, nan, 1), (n + 2, [None, *rows[0][1][1:]], 1), (n + 3, [float("inf"), *zero[1:]], 1), (n + 4, [], 1), (n + 5, [1.0] * (dim + 1), None), (n + 6, zero, 7), (n + 7, [-0.0, *zero[1:]], 7)]


@pytest.mark.parametrize(("n", "dim", "scale"), [(40, 8, 0.2), (700, 8, 0.05), (320, 12, 2.0), (330, 4, 1e5), (300, 8, 3e4), (600, 4, 0.001)])
def test_codes_equal_plain_lloyd(spark, n, dim, scale):
    """Small scales tie in most places; large ones leave the range in which doubles are exact, and the bound."""
    rows = odd_vectors(random.Random(n), n, dim, scale)
    same(product_codes.code_digest(vectors(spark, rows)).collect(), plain_codes(rows))


def test_bounds_skip_groups_and_stay_below(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (8, 16))
    x = np.floor(centres[rng.integers(0, 8, 4000)] + rng.normal(0, 20, (4000, 16))).astype(np.int64)
    book = product_codes.Codebook.start(x[:256], 4)
    codes, error, low = product_codes.assign(x, book)
    scanned, real = [0], product_codes.nearest

    def counted(a, c):
        scanned[0] += len(a)
        return real(a, c)

    product_codes.nearest = counted
    try:
        for _ in range(4):
            sums = {(p, k): (int((codes[:, p] == k).sum()), x[codes[:, p] == k, 4 * p : 4 * p + 4].sum(0).tolist()) for p in range(4) for k in range(256) if (codes[:, p] == k).any()}
            book = book.moved(sums)
            codes, error, low = product_codes.assign(x, book, codes, product_codes._unpacked(product_codes._packed(low)))
            for p in range(4):
                d = ((x[:, None, 4 * p : 4 * p + 4] - book.entries[p]) ** 2).sum(-1)
                assert (d.argmin(1) == codes[:, p]).all() and (d.min(1) == error[:, p]).all()
                d = np.sqrt(d.astype(float))
                d[np.arange(len(x)), codes[:, p]] = np.inf
                for g in np.unique(book.groups[p]):
                    assert (low[:, p, g] <= d[:, book.groups[p] == g].min(1) * (1 + 1e-9)).all()
    finally:
        product_codes.nearest = real
    assert scanned[0] < 0.5 * 4 * 4 * len(x) * 16  # of all rows, rounds, parts and groups


def test_codes_of_nothing(spark, tmp_path):
    empty = written(spark, vectors(spark, []), f"{tmp_path}/e")
    assert product_codes.code_digest(empty).collect() == []
    got = product_codes.code_digest(vectors(spark, [(1, None, 1), (2, [1.0], 1), (3, [], 2)])).collect()
    same(got, [(2, None, None, None, None), (3, None, None, None, None)])


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves[k], saved[k], sha))
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(9)
    say = ["hi", "Ünï 🙂", "", None, "tell me", "a" * 5000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(say)) for c in rng.sample(range(450), 120) for t in range(rng.randint(1, 7))]
    rows += [(500, t, "user", f"turn {t}") for t in range(900)] + [(501, t, "user", f"turn {t}") for t in range(400)]  # deep
    rows += [(600, None, "user", "b"), (600, None, "user", "a"), (600, 3, "user", "c"), (600, 3, "user", "c"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", "same") for c in range(700, 1000) for t in range(6)]  # copies
    rng.shuffle(rows)
    return rows


def test_trie_equals_plain(spark, talk):
    got = prefix_trie.trie_digest(conversations(spark, talk).repartition(7)).collect()
    same(got, plain_trie(talk))
    assert max(r.depth for r in got) > 890


def test_pieces_of_ids_and_hot_conversations_spread(spark, talk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        same(prefix_trie.trie_digest(conversations(spark, talk)).collect(), plain_trie(talk))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_numbers_split_hot_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, rng.randint(-5, 5)) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = running.running(materialise(spark.createDataFrame(rows, "k int, o int, x long"), "t"), "k", ["o"], ["x"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want, seen = [], {}
    for k, o, x in sorted(rows, key=lambda r: r[1]):
        n, total = seen.get(k, (0, 0))
        seen[k] = (n + 1, total + x)
        if k is not None:
            want.append((k, o, x, n, total + x))
    assert sorted(tuple(r) for r in got if r.k is not None) == sorted(want) and len(got) == len(rows)


def test_trie_of_nothing_and_turnless(spark, tmp_path):
    assert prefix_trie.trie_digest(written(spark, conversations(spark, []), f"{tmp_path}/e")).collect() == []
    only = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    got = prefix_trie.trie_digest(conversations(spark, [(only, 0, "user", "x")])).collect()
    same(got, plain_trie([(only, 0, "user", "x")]))
    assert len(got) == 1 and got[0].n_leaves == 1


def plain_near(rows, least=0.98):
    ok = [e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) and lab is not None for _, e, lab in rows]
    unit = [np.array(e) / np.linalg.norm(np.array(e, float)) if k else None for (_, e, _), k in zip(rows, ok, strict=True)]
    n, low = len(rows), list(range(len(rows)))
    links = [0] * n

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                low[root(a)] = root(b)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root(i), []).append(r[0])
    first = [min((x for x in ids[root(i)] if x is not None), default=None) for i in range(n)]
    return [(r[0], links[i], first[i], r[0] == first[i]) for i, r in enumerate(rows)]


def near_rows(seed, dim, groups, size, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        rows += [([float(np.float32(x)) for x in c + rng.normal(size=dim) * noise / math.sqrt(dim)], g % 3) for _ in range(size)]
    rows += [([float(np.float32(x)) for x in rng.normal(size=dim)], i % 3) for i in range(200)]
    order = rng.permutation(len(rows))
    return [(int(i), *rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors_equal_all_pairs(spark, block):
    rows = near_rows(1, 24, 12, 12, 0.14) + [(10_000 + i, e, lab) for i, e, lab in near_rows(2, 24, 2, 90, 0.11)]
    rows += odd_vectors(random.Random(4), 20, 24, 0.2) + [(20_000, [2.0 * x for x in rows[0][1]], rows[0][2]), (20_001, [math.copysign(1e38, x) for x in rows[1][1]], 1), (20_002, [math.copysign(1e38, x) for x in rows[1][1]], 1), (None, rows[2][1], rows[2][2]), (20_003, rows[0][1], None)]
    want = plain_near(rows)
    assert sum(w[1] for w in want) > 5000
    same(vector_dedup.near_vectors(vectors(spark, rows), block=block).collect(), want)


def test_copies_cost_nothing_and_all_rows_of_one_id(spark, tmp_path):
    e = [1.0, 2.0, 3.0]
    got = vector_dedup.near_vectors(vectors(spark, [(7, e, 1)] * 5000 + [(None, [-x for x in e], 1)] * 3)).collect()
    assert {tuple(r) for r in got} == {(7, 4999, 7, True), (None, 2, None, True)} and len(got) == 5003
    empty = written(spark, vectors(spark, []), f"{tmp_path}/e")
    assert vector_dedup.near_vectors(empty).collect() == []
    assert [tuple(r) for r in vector_dedup.near_vectors(vectors(spark, [(1, None, None)])).collect()] == [(1, 0, 1, True)]


def test_recall_is_planned_alike_at_every_size():
    for n in (10, 10**4, 10**7, 10**11):
        bits, tables = vector_dedup.plan(n, 0.98)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= 1.01e-5 and 2**bits >= 4 * n


def test_sql_of_vectors_and_tries_on_odd_rows(spark, tmp_path, talk):
    rows = odd_vectors(random.Random(8), 300, 8, 0.1)
    rows = [r for r in rows if r[1] is None or len(r[1]) == 8]
    vectors(spark, rows).write.parquet(f"{tmp_path}/v")
    same_turns = {(c, t) for c, t, *_ in talk}
    once = [next(r for r in talk if r[:2] == k) for k in same_turns]
    conversations(spark, once).write.parquet(f"{tmp_path}/c")
    db = duckdb.connect()
    db.sql(f"create view embeddings as from '{tmp_path}/v/*.parquet'")
    db.sql(f"create view conversations as from '{tmp_path}/c/*.parquet'")
    read = lambda p: spark.read.parquet(f"{tmp_path}/{p}")
    for name, got in (("op11_yinyang_codes", product_codes.code_digest(read("v"))), ("op12_prefix_trie", prefix_trie.trie_digest(read("c"))), ("op13_embedding_dedup", vector_dedup.near_vectors(read("v")))):
        want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        same(got.collect(), want)
