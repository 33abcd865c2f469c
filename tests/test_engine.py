import collections
import hashlib
import io
import json
import unicodedata
import zipfile

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.chunking import chunk_text, split_text, with_page_chunks
from docloom.functions.embedding import CharBucketEmbedder, EmbeddingUnavailable, embed_all
from docloom.operators import index, ledger, managed, search
from docloom.operators.kinds import INVENTION, PLAIN
from docloom.operators.registry import Corpus, Registry, RegistryError
from docloom.plans import catalogue
from docloom.sources import files
from docloom.sources.store import ChunkStore


def value(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("nation customer part orders events documents embeddings conversations").split():
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalogue.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(value(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())


def test_batch_search_runs_every_query_in_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(search, "MAX_QUERIES", 3)
    monkeypatch.setattr(search, "ROWS", 7)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = catalogue.queries()["search_batch"](spark, sf).orderBy("query_id", "rank").collect()
    asked = sorted(i for i in ids.tolist() if i % 50 == 0)
    assert len(asked) > 3 and [r.query_id for r in got] == [i for i in asked for _ in range(5)]
    want = [x for i in asked for x in np.sort(m @ m[ids == i][0])[::-1][:5] / 2 + 0.5]
    assert np.allclose([r.similarity for r in got], want, atol=1e-4)


def test_whole_texts_are_embedded_and_detected(spark, tmp_path):
    rows = [(1, "s", "x" * 30 + "한글 end"), (2, "s", "x" * 30 + "other")]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    names = {r.doc_id: (r.name, r.encoding) for r in catalogue.queries()["zip_name_detect"](spark, str(tmp_path)).collect()}
    assert names == {1: (rows[0][2] + ".md", "utf-8"), 2: (rows[1][2] + ".md", "cp437")}
    got = {r.doc_id: r.plain_sha256 for r in catalogue.queries()["embed_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(f"제목: {i}\n{t}".encode()).hexdigest() for i, _, t in rows}


def test_chunk_limits():
    """One chunk up to the hint, several beyond it; a token count decides instead if there is one."""
    for n in (1, 99, 5499, 5500):
        assert chunk_text("\n" + "q" * n + " ") == ["q" * n]
    assert [len(c) for c in chunk_text("q" * 5501)] == [1000, 1000, 1000, 1000, 1000, 1000, 401]
    assert chunk_text("\t\n\u3000") == []
    assert [len(chunk_text("r" * 9000, count_tokens=lambda t, n=n: n)) for n in (8191, 8192, 8193)] == [1, 1, 11]
    letters = "".join(chr(0x3400 + i) for i in range(2500))
    parts = split_text(letters, 800, 100)
    assert [len(p) for p in parts] == [800, 800, 800, 400]
    assert parts[0] + "".join(p[100:] for p in parts[1:]) == letters


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=600), st.integers(20, 80))
def test_chunks_hold_all_words(text, size):
    parts = split_text(text, size, size // 5) if text else []
    assert all(0 < len(p) <= size and p == p.strip() for p in parts)
    assert set("".join(text.split())) == set("".join("".join(p.split()) for p in parts))


def test_pages_do_not_mix(spark):
    pages = [(1, "a" * 6000), (2, "b"), (3, " ")]
    df = spark.createDataFrame([("s", pages)], "id string, pages array<struct<page:int,text:string>>")
    rows = with_page_chunks(df).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and {r.n_chunks for r in rows} == {len(rows)}
    assert rows[-1].document == "b" and rows[-1].anchor == "p.2" and all(set(r.document) == {"a"} for r in rows[:-1])


def test_filename_fields(spark):
    cases = {
        "2021-plants-Kim-Growing moss-.md": (2021, "plants", "Kim", "Growing moss", X.MAIN_DOC),
        "1999-a b-c.d-one - two - three-.md": (1999, "a b", "c.d", "one - two - three", X.MAIN_DOC),
        "2005-water-Lee-Pumps (지도논문)-.md": (2005, "water", "Lee", "Pumps", X.ADVISOR_DOC),
        "2005-water-Lee-Pumps.md": (None, "", "", "2005-water-Lee-Pumps", X.MAIN_DOC),
        "notes(지도논문) .txt": (None, "", "", "notes(지도논문) ", X.ADVISOR_DOC),
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    rows = df.select("n", *(c.alias(k) for k, c in X.parse_filename(F.col("n")).items())).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == cases


def test_strip_and_snippet_are_unicode(spark):
    s = "　\x1c a b \x85"
    r = spark.createDataFrame([(s,)], "t string").select(X.strip(F.col("t")), X.snippet(F.col("t"))).first()
    assert r[0] == s.strip() and r[1] == "a b"


def test_nfc(spark):
    s = "é 한"
    assert spark.createDataFrame([(s,), (None,)], "t string").select(X.nfc("t")).collect() == [(unicodedata.normalize("NFC", s),), (None,)]


def hits(spark, rows):
    return spark.createDataFrame([(p, d, i + 1, 1, f"{p}{i}") for i, (p, d) in enumerate(rows)], "source_path string, distance double, rank int, n_chunks int, document string")


def test_ranking(spark):
    r = search.rank_documents(hits(spark, [("b", 0.3), ("a", 0.4), ("a", 0.6)]), 5, keep=("document",)).orderBy("position").collect()
    assert [(x.source_path, x.similarity, x.document) for x in r] == [("b", 0.85, "b0"), ("a", 0.8, "a1")]
    r = search.rank_documents(hits(spark, [("x", 0.0), ("z", 1.0), ("y", 2.0)]), 5).orderBy("position").collect()
    assert [x.similarity for x in r] == [1.0, 0.5, 0.0]


def docs_of(spark, rows):
    df = spark.createDataFrame([(f"c/{n}", n.rsplit(".", 1)[0], t) for n, t in rows], "source_path string, title string, text string")
    return df.select("*", X.content_hash(F.col("text")).alias("content_hash"), X.classify(F.col("text")).alias("status"))


def test_index_is_incremental_and_rebuild_swaps(spark, tmp_path):
    store, e = ChunkStore(spark, f"file://{tmp_path}/s"), CharBucketEmbedder(16)
    first = [("a.md", "first text " * 10), ("b.md", "other words " * 10), ("c.md", ""), ("p.md", X.LFS_PREFIX + "\noid\n")]
    s = index.build_index(docs_of(spark, first), store, "c_v1", PLAIN, e)
    assert (s["indexed"], s["skipped"], s["embedded_chunks"], s["lfs_pointer"]) == (2, 2, 2, 1)
    s = index.build_index(docs_of(spark, first), store, "c_v1", PLAIN, e)
    assert (s["reused"], s["embedded_chunks"], s["total_chunks"]) == (2, 0, 2)
    long = [("a.md", "a longer text. " * 500), first[1]]
    index.build_index(docs_of(spark, long), store, "c_v1", PLAIN, e)
    grown = store.read("c_v1").filter("source_path = 'c/a.md'").collect()
    assert len(grown) > 1 and sorted(r.chunk_index for r in grown) == list(range(len(grown)))
    index.build_index(docs_of(spark, first), store, "c_v1", PLAIN, e)
    assert store.count("c_v1") == 2
    found = search.search(store.read("c_v1"), PLAIN, e, "first text").collect()
    assert found[0].title == "a" and found[0].metadata.asDict() == {"title": "a"} and len(found) == 2
    active, _ = index.rebuild(docs_of(spark, first), store, "c_v1", PLAIN, e)
    assert active == "c_v2" and store.names() == ["c_v1", "c_v2"]
    with pytest.raises(index.RebuildError):
        index.rebuild(docs_of(spark, [("x.md", "")]), store, active, PLAIN, e)
    assert store.names() == ["c_v1", "c_v2"]
    active, _ = index.rebuild(docs_of(spark, first), store, active, PLAIN, e)
    assert store.names() == ["c_v2", "c_v3"]
    assert store.remove_document("c_v3", "c/a.md") == 1 and store.count("c_v3") == 1 and store.count("none") == 0


def test_changes_write_only_the_buckets_they_touch(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s", buckets=8)
    rows = [(f"c/{i}.md::0", f"c/{i}.md", "old") for i in range(40)]
    schema = "chunk_id string, source_path string, document string"
    store.upsert("c_v1", spark.createDataFrame(rows[:30], schema))
    store.upsert("c_v1", spark.createDataFrame(rows[30:], schema))
    content = lambda: {r.chunk_id: r.document for r in store.read("c_v1").collect()}
    assert content() == {c: d for c, _, d in rows}
    files_of = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    before, under_way = files_of(), store.read("c_v1")
    store.upsert("c_v1", spark.createDataFrame([("c/7.md::0", "c/7.md", "new")], schema))
    after = files_of()
    assert len({f.rsplit("/", 1)[0] for f in after.keys() - before.keys()}) == 1 and all(after[f] == before[f] for f in after.keys() & before.keys())
    assert content() == {c: "new" if p == "c/7.md" else d for c, p, d in rows} and under_way.filter("document = 'new'").count() == 0
    assert store.remove_document("c_v1", "c/7.md") == 1 and store.remove_document("c_v1", "c/7.md") == 0 and store.count("c_v1") == 39
    with pytest.raises(ValueError):
        store.write("c_v1", spark.createDataFrame(rows, schema), [0])
    assert store.count("c_v1") == 39 and ChunkStore(spark, f"file://{tmp_path}/s", buckets=3).remove_document("c_v1", "c/8.md") == 1
    assert store.delete_where("c_v1", F.lit(True)) == 38 and store.count("c_v1") == 0 and store.exists("c_v1")
    store.reset("c_v1")
    store.upsert("c_v1", spark.createDataFrame([(None, None, None)], schema))
    assert store.count("c_v1") == 1


def test_advisors_and_privacy(spark):
    rows = [("p1", "c1", 1, [1.0, 0.0], "t", 1990, "cat", "author", X.MAIN_DOC, "d"), ("p2", "c2", 1, [1.0, 0.0], "u", None, "cat", "author", X.ADVISOR_DOC, "d")]
    c = spark.createDataFrame(rows, "source_path string, chunk_id string, n_chunks int, embedding array<double>, title string, year int, category string, author string, doc_type string, document string")
    e = CharBucketEmbedder(2)
    assert [r.title for r in search.search(c, INVENTION, e, "b").collect()] == ["t"]
    both = search.search(c, INVENTION, e, "b", options={"include_advisor_docs": True}).collect()
    assert len(both) == 2 and "author" not in both[0].metadata.asDict()
    with pytest.raises(ValueError):
        search.search(c, INVENTION, e, " ")
    managed = c.withColumn("operation_id", F.lit("o1"))
    assert search.search(managed, PLAIN, e, "b", active_operations=[]).count() == 0
    assert search.search(managed, PLAIN, e, "b", active_operations=["o1"]).count() == 2
    active = lambda *names: spark.createDataFrame([(n,) for n in names], "operation_id string")
    assert [search.search(managed, PLAIN, e, "b", active_operations=active(*names)).count() for names in ((), ("o2",), ("o1", "o2"))] == [0, 0, 2]
    two = c.withColumn("operation_id", F.when(F.col("chunk_id") == "c1", "o1").otherwise("o2"))
    left = search.search(two, PLAIN, e, "b", active_operations=active("o1", "o2"), still_active=lambda: active("o2")).collect()
    assert [r.source_path for r in left] == ["p2"]


def test_retries_and_alignment():
    class Flaky:
        dim, calls = 2, 0

        def embed(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise TimeoutError
            return [[0.0, 1.0]] * len(texts)

    assert len(embed_all(Flaky(), ["a"] * 250, sleep=lambda s: None)) == 250

    class Short:
        dim = 2

        def embed(self, texts):
            return []

    with pytest.raises(EmbeddingUnavailable):
        embed_all(Short(), ["a"])


BASIC = ", ".join(ledger.REQUEST.split(", ")[:11])


def request(seq, kind="index", revision=1, key=None, version="v1", content="h", service="s", enabled=True):
    return (seq, service, "c", "src", kind, revision, key or f"k{seq}", version, f"{kind}{revision}{content}", content, enabled)


def fold(spark, rows):
    return [r.outcome for r in ledger.fold(spark.createDataFrame(rows, BASIC)).orderBy("seq").collect()]


def test_protocol(spark):
    assert fold(spark, [request(1, key="k"), request(2, key="k"), request(3, key="k", revision=9, content="x")]) == ["accepted", "replay", "key_conflict"]
    assert fold(spark, [request(1, revision=2), request(2, revision=2, version="v2"), request(3, revision=3, version="v1", content="z"), request(4, revision=3, version="v2")]) == ["accepted", "stale", "version_conflict", "accepted"]
    rows = [request(1), request(2, "delete", 2), request(3, "state", 3), request(4, revision=3, service="other"), request(5, "state", 3, enabled=False)]
    assert fold(spark, rows) == ["accepted", "accepted", "no_active_version", "not_found", "accepted"]
    assert fold(spark, [request(1, "delete"), request(2, "state", 2, enabled=False), request(3, "state", 3)]) == ["accepted", "accepted", "no_active_version"]


def test_indexing_again_makes_a_source_visible(spark):
    rows = [request(1), request(2, "delete", 2), request(3, revision=3, version="v2")]
    last = ledger.latest_state(ledger.fold(spark.createDataFrame(rows, BASIC))).first()
    assert (last.revision_after, last.enabled_after, last.deleted_after, last.active_job_after) == (3, True, False, 3)


def test_jobs_end_later(spark):
    """A job that a newer request overtook is superseded; a failed one leaves the version before in place; a full queue refuses."""
    end = lambda seq, job, error=None: (seq, None, "c", "src", "finish", None, None, None, None, None, None, None, job, error)
    more = lambda r, full=False: (*r, full, None, None)
    rows = [more(request(1)), end(2, 1), more(request(3, revision=2, version="v2")), more(request(4, revision=3, version="v3")), end(5, 3), end(6, 4, "ValueError"), end(7, 9), more(request(8, revision=4, version="v4"), True)]
    got = ledger.fold(spark.createDataFrame(rows, ledger.REQUEST), at_once=False).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["accepted", "succeeded", "accepted", "accepted", "superseded", "failed", "unknown", "rate_limited"]
    assert [r.active_job_after for r in got] == [None, 1, 1, 1, 1, 1, 1, 1] and got[-1].enabled_after


def plain_protocol(rows):
    """The rules as tables of rows, looked up anew for each request."""
    jobs, out = [], []
    state = {"owner": None, "rev": None, "on": False, "gone": False, "job": None}
    for r in sorted(rows, key=lambda r: r["seq"]):
        answer = "accepted"
        if r["kind"] == "finish":
            mine = [j for j in jobs if j["seq"] == r["job"] and j["state"] == "queued"]
            answer = "unknown"
            for j in mine:
                answer = j["state"] = "failed" if r["error"] else "succeeded" if j["revision"] == state["rev"] else "superseded"
                if answer == "succeeded" and j["kind"] == "index":
                    state |= {"job": j["seq"], "on": True, "gone": False}
        else:
            same_key = [j for j in jobs if (j["service_id"], j["idempotency_key"]) == (r["service_id"], r["idempotency_key"])]
            same_version = [j for j in jobs if j["kind"] == "index" and j["source_version_id"] == r["source_version_id"]]
            if same_key:
                answer = "replay" if same_key[0]["checksum"] == r["checksum"] else "key_conflict"
            elif state["owner"] not in (None, r["service_id"]):
                answer = "not_found"
            elif state["rev"] is not None and r["revision"] <= state["rev"]:
                answer = "stale"
            elif r["queue_full"]:
                answer = "rate_limited"
            elif r["kind"] == "index" and any(j["content_hash"] != r["content_hash"] for j in same_version):
                answer = "version_conflict"
            elif r["kind"] == "state" and r["enabled"] and (state["job"] is None or state["gone"]):
                answer = "no_active_version"
            else:
                jobs.append(dict(r, state="queued"))
                state |= {"owner": r["service_id"], "rev": r["revision"]}
                if r["kind"] != "index":
                    state |= {"on": r["kind"] == "state" and r["enabled"], "gone": r["kind"] == "delete"}
        out.append((r["kind"], answer))
    return out, (state["owner"], state["rev"], state["on"], state["gone"], state["job"])


def test_protocol_queries_equal_plain_rules(spark, sf):
    by_source = collections.defaultdict(list)
    for r in catalogue.every_kind(spark, sf).collect():
        by_source[r.source_id].append(r.asDict())
    plain = {s: plain_protocol(rows) for s, rows in by_source.items()}
    counts = collections.Counter(x for out, _ in plain.values() for x in out)
    assert {(r.kind, r.outcome): r.n for r in catalogue.queries()["protocol_outcomes"](spark, sf).collect()} == counts and len(counts) > 10
    states = {r.source_id: (r.service_id, r.revision_after, r.enabled_after, r.deleted_after, r.active_job_after) for r in catalogue.queries()["active_versions"](spark, sf).collect()}
    assert {s: x[1:] for s, x in states.items()} == {s: x[1:] for s, (_, x) in plain.items()}


def test_chunk_queries_equal_the_splitter(spark, sf):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((f"{d.source}/{d.doc_id}::{i}", i, len(c), sha(x)) for d in catalogue.table(spark, sf, "documents").collect() for c in [chunk_text(d.text or "")] for i, x in enumerate(c))
    got = catalogue.queries()["chunk_documents"](spark, sf)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in got.collect()) == want
    pages = collections.defaultdict(list)
    for r in catalogue.table(spark, sf, "conversations").collect():
        pages[r.conv_id].append((r.turn + 1, r.text or ""))
    want = []
    for conv, ps in pages.items():
        parts = [(p, c) for p, t in sorted(ps) for c in chunk_text(t)]
        want += [(conv, i, len(parts), p, f"p.{p}", sha(c)) for i, (p, c) in enumerate(parts)]
    assert sorted(tuple(r) for r in catalogue.queries()["chunk_pages"](spark, sf).collect()) == sorted(want)


def test_zip_name_query(spark, sf):
    nfc = lambda t: unicodedata.normalize("NFC", t)
    for d, r in zip(*(x.orderBy("doc_id").collect() for x in (catalogue.table(spark, sf, "documents"), catalogue.queries()["zip_name_detect"](spark, sf))), strict=True):
        name = (d.text or "") + ".md"
        assert (r.name, r.encoding) == ((name, "cp437") if name.isascii() else (nfc(name), "utf-8"))


def test_stream_equals_batch(spark, tmp_path):
    from docloom.streaming import ingest

    rows = [request(1), request(2, revision=2, version="v2"), request(3, "state", 3, enabled=False)]
    for i, r in enumerate(rows):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.json").write_text(json.dumps(dict(zip([x.split()[0] for x in BASIC.split(", ")], r, strict=True))))
        ingest.ingest(ingest.request_stream(spark, str(folder)), str(tmp_path / "l"), str(tmp_path / "cp")).awaitTermination(120)
    state = ingest.current_states(spark, str(tmp_path / "l")).collect()
    assert [(s.revision_after, s.enabled_after, s.active_job_after) for s in state] == [(3, False, 2)]


def test_stream_goes_on_from_kept_states(spark, tmp_path):
    """Replays, fences, versions and open jobs of earlier batches hold in later ones, and no batch reads another's requests."""
    from docloom.streaming import ingest

    end = lambda seq, job, error=None: (seq, None, "c", "src", "finish", None, None, None, None, None, None, None, job, error)
    more = lambda r: (*r, False, None, None)
    batches = [
        [more(request(1, key="k")), more(request(2, key="k"))],
        [more(request(3, key="k")), end(4, 1), more(request(5, revision=2, version="v1", content="other")), more(request(6, revision=3, version="v2"))],
        [more(request(7, revision=3, version="v3")), more(request(8, "state", 4, enabled=False)), end(9, 6), end(10, 8)],
        [more(request(11, revision=5, service="stranger"))],
    ]
    names = [x.split()[0] for x in ledger.REQUEST.split(", ")]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        ingest.ingest(ingest.request_stream(spark, str(folder)), str(tmp_path / "l"), str(tmp_path / "cp"), at_once=False).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "l" / "outcomes")).orderBy("seq").collect()
    want = ledger.fold(spark.createDataFrame([r for b in batches for r in b], ledger.REQUEST), at_once=False).orderBy("seq").collect()
    assert [tuple(g[c] for c in want[0].asDict()) for g in got] == [tuple(w) for w in want]
    assert [g.outcome for g in got] == ["accepted", "replay", "replay", "succeeded", "version_conflict", "accepted", "stale", "accepted", "superseded", "succeeded", "not_found"]
    assert {r["batch"]: r["count"] for r in spark.read.parquet(str(tmp_path / "l" / "outcomes")).groupBy("batch").count().collect()} == {0: 2, 1: 4, 2: 4, 3: 1}


def test_managed_jobs(spark, tmp_path):
    """Index, supersede, fail, delete; files appear and vanish with their versions."""

    class Fails(CharBucketEmbedder):
        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("details stay out")
            return super().embed(texts)

    store, e, folder = ChunkStore(spark, f"file://{tmp_path}/s"), Fails(8), f"file://{tmp_path}/docs"

    def run(rows, revisions):
        jobs = spark.createDataFrame([(j, s, k, r, f"v{r}", s, f"h{r}", [(i + 1, t) for i, t in enumerate(pages)]) for j, s, k, r, pages in rows], managed.JOB)
        states = spark.createDataFrame(list(revisions.items()), "source_id string, revision long")
        return {r.job: (r.state, r.error) for r in managed.process(jobs, states, store, "m_v1", "m", e, folder=folder).collect()}

    chunks = lambda: sorted((r.source_id, r.revision, r.page, r.document) for r in store.read("m_v1").collect())
    assert run([("j1", "a", "index", 1, ["one", "two"]), ("j2", "b", "index", 1, ["x"]), ("j3", "c", "index", 1, [" ", ""]), ("j4", "d", "index", 1, ["poison"])], {"a": 1, "b": 2, "c": 1, "d": 1}) == {
        "j1": ("succeeded", None), "j2": ("superseded", None), "j3": ("failed", "ValueError"), "j4": ("failed", "EmbeddingUnavailable")}
    assert chunks() == [("a", 1, 1, "one"), ("a", 1, 2, "two")] and (tmp_path / "docs/a.md").read_text() == "## p.1\n\none\n\n## p.2\n\ntwo"
    assert not (tmp_path / "docs/b.md").exists() and json.loads((tmp_path / "docs/a.json").read_text())["operation_id"] == "j1"
    assert run([("j5", "a", "index", 2, ["poison"]), ("j6", "b", "index", 2, ["y"])], {"a": 2, "b": 2})["j5"] == ("failed", "EmbeddingUnavailable")
    assert [c[:3] for c in chunks()] == [("a", 1, 1), ("a", 1, 2), ("b", 2, 1)]
    run([("j7", "a", "index", 3, ["new"])], {"a": 3})
    assert run([("j7", "a", "index", 3, ["new"])], {"a": 3})["j7"][0] == "succeeded"
    assert chunks() == [("a", 3, 1, "new"), ("b", 2, 1, "y")]
    assert run([("j8", "b", "delete", 3, [])], {"b": 3}) == {"j8": ("succeeded", None)}
    assert chunks() == [("a", 3, 1, "new")] and not (tmp_path / "docs/b.md").exists()
    jobs = spark.createDataFrame([("j7", "a", "index", 3, "v3", "a", "h3", [(1, "new")]), ("j6", "b", "index", 2, "v2", "b", "h2", [(1, "y")])], managed.JOB)
    states = spark.createDataFrame([("j7", False), ("j6", True)], "active_job string, deleted boolean")
    assert managed.rebuild(jobs, states, store, "m_v2", "m", e)["total_chunks"] == 1 and store.read("m_v2").first().operation_id == "j7"


def test_version_hash(spark):
    pages = [(1, "é"), (2, "b")]
    got = spark.createDataFrame([("t", pages)], "title string, pages array<struct<page:int,text:string>>").select(managed.version_hash(F.col("title"), F.col("pages"))).first()[0]
    text = '{"pages": [{"page": 1, "text": "é"}, {"page": 2, "text": "b"}], "title": "t"}'
    assert got == hashlib.sha256(text.encode()).hexdigest()


def test_job_runner(spark, tmp_path):
    from docloom.operators.jobs import JobError, Jobs

    def work(corpus, kind, progress):
        for i in range(1, 26):
            progress(i, 25)
        if kind == "rebuild":
            raise RuntimeError("no chunks")
        return {"indexed": 25}

    jobs = Jobs(spark, f"file://{tmp_path}", work)
    first = jobs.submit("c", "incremental", "ann")
    with pytest.raises(JobError):
        jobs.submit("c", "rebuild")
    assert jobs.run(first) == "succeeded" and jobs.run(jobs.submit("c", "rebuild")) == "failed"
    assert [r.done for r in jobs.log.table().filter(f"job_id = {first} AND status = 'running'").orderBy("seq").collect()] == [0, 9, 19, 25]
    actions = [(r.action, r.actor) for r in jobs.audit.recent(10).orderBy("seq").collect()]
    assert actions == [("job.incremental.started", "ann"), ("job.incremental.succeeded", "ann"), ("job.rebuild.started", None), ("job.rebuild.failed", None)]
    jobs.submit("d", "rebuild")
    assert jobs.interrupt() == 1 and jobs.interrupt() == 0


def test_tokens(spark, tmp_path):
    from docloom.operators.tokens import Tokens

    t, secret = Tokens(spark, f"file://{tmp_path}", {"rules": "plain", "easyflow": "easyflow"}), "k" * 40
    t.register("web", "web-read", secret, {"Rules ": ["search", "search"]})
    for service, token, grants in (("web", "short", {"rules": ["search"]}), ("web", secret, {}), ("web", secret, {"rules": ["admin"]}), ("web", secret, {"easyflow": ["search"]}), ("easyflow", secret, {"rules": ["search"]}), ("W", secret, {"rules": ["search"]})):
        with pytest.raises(ValueError):
            t.register(service, "bad-one", token, grants)
    assert t.service_of(secret) == "web" and t.table().first().grants == {"rules": ["search"]}
    assert t.revoke("web-read") and not t.revoke("none") and t.service_of(secret) is None
    t.register("web", "web-read", secret, {"rules": ["search"]}, 5)
    assert t.service_of(secret) == "web" and [tuple(r) for r in t.listed().collect()] == [("web", "web-read", 5, True)]


def test_folder_guards_and_writes(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    f = files.Folder(spark, f"file://{tmp_path}/docs", "c")
    for bad in ("../x.md", "a/b.md", "..", "", "/etc/passwd"):
        with pytest.raises(ValueError):
            f.target(bad)
    up = files.uploads(spark.createDataFrame([("a.md", bytearray(b"text")), ("b.exe", bytearray(b"x"))], "filename string, content binary"))
    assert f.save(up) == (["a.md"], [("b.exe", "extension")]) and (tmp_path / "docs/c/a.md").read_text() == "text"
    other = tmp_path / "in"
    other.mkdir()
    (other / "a.md").write_text("text")
    (other / "n.md").write_text("new one")
    source = files.scan(spark, str(other))
    assert f.copy(source, dry_run=True)["copied"] == 1 and files.count_documents(f.scan()) == 1
    assert f.copy(source) == {"copied": 1, "bytes": 7, "skipped": 1} and files.count_documents(f.scan()) == 2
    garbled = "각하.md".encode("cp949").decode("cp437")
    (tmp_path / "docs/c" / garbled).write_text("k")
    assert files.repairable(f.scan()) == 1 and f.rename(files.repairs(f.scan())) == ([(garbled, "각하.md")], [])
    store.write("c_v1", spark.createDataFrame([("c/a.md::0", "c/a.md"), ("c/z.md::0", "c/z.md")], "chunk_id string, source_path string"))
    assert f.delete(["a.md", "z.md", "../q.md"], store, "c_v1", "c") == (["a.md", "z.md"], ["../q.md"]) and store.count("c_v1") == 0
    assert [tuple(r) for r in store.counts().collect()] == [("c_v1", 0)]
    with pytest.raises(ValueError):
        files.Folder(spark, f"file://{tmp_path}/docs", "..").purge()
    assert f.purge() == 2 and not (tmp_path / "docs/c").exists() and files.count_documents(f.scan()) == 0


def test_registry(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    r = Registry(spark, f"file://{tmp_path}/r", store)
    r.seed(Corpus("inventions", "invention", "Seed", "", ""))
    assert r.create("managed", "easyflow", "M").kind == "easyflow"
    r.delete("managed", "managed")
    with pytest.raises(RegistryError):
        r.create("more", "invention", "x")
    c = r.create(" Rules ", "plain", "Rules", "prefix")
    assert (c.id, c.active_collection, c.index_version, c.doc_prefix) == ("rules", "rules_v1", "rules:gemini-embedding-2:1536:v1", "prefix\n")
    for bad in ("inventions", "rules", "q", "two words", "dot.dot", "a/b", "9_9", "-x1", "x" * 32, "é1"):
        with pytest.raises(RegistryError):
            r.create(bad, "plain", "x")
    with pytest.raises(RegistryError):
        r.set_status("rules", "published")
    assert r.update("rules", chunk_size=500).needs_rebuild
    assert r.set_active("rules", "rules_v2").index_version == "rules:1536:v2"
    assert [c.id for c in r.all()] == ["inventions", "rules"]
    with pytest.raises(RegistryError):
        r.delete("inventions", "inventions")
    r.delete("rules", "rules")
    assert [c.id for c in r.all()] == ["inventions"]


def test_zip_names_and_entries(spark):
    garbled = lambda s, code: s.encode(code).decode("cp437")
    for name, code, want in (("보고서 둘.md", "cp949", "cp949"), ("ㄱㄴ.md", "cp949", "cp949"), ("ñandú.md", "utf-8", "utf-8"), ("표.md", "utf-8", "utf-8"), ("list.md", "ascii", "cp437")):
        assert files.detect_zip_name(garbled(name, code), 0) == (name, want)
    assert files.detect_zip_name("다.md", 0x800) == ("다.md", "utf-8") and files.detect_zip_name("다.md", 0) == ("다.md", "utf-8")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in {"a/b.md": b"text", "c.exe": b"x", "d.md": b"\xff", "e.txt": b"  ", ".f.md": b"x"}.items():
            z.writestr(n, t)
    df = spark.createDataFrame([("p", bytearray(out.getvalue())), ("q", bytearray(b"no zip"))], "path string, content binary")
    got = {(r.path, r.name): r.reason for r in files.unzip(df).collect()}
    assert got == {("p", "b.md"): None, ("p", "c.exe"): "extension", ("p", "d.md"): "not_utf8", ("p", "e.txt"): "blank", ("p", ".f.md"): "name", ("q", None): "corrupt"}


def test_scan_parses_files(spark, tmp_path):
    (tmp_path / "x.md").write_bytes(b"line\r\nline two " + b"w" * 60)
    (tmp_path / "y.MD").write_bytes(b"ignored")
    got = files.parsed(files.scan(spark, str(tmp_path)), "corp", PLAIN.fields(F.col("filename"))).collect()
    assert [(r.source_path, r.title, r.status, r.text[:9]) for r in got] == [("corp/x.md", "x", "ok", "line\nline")]
    assert [r.filename for r in files.listing(files.scan(spark, str(tmp_path)), "X").collect()] == ["x.md"]


def test_uploads(spark):
    rows = [("a\\b.md", bytearray(b"text")), ("c.md", bytearray(b"\xff")), ("d.exe", bytearray(b"x"))]
    got = {r.name: (r.text, r.reason) for r in files.uploads(spark.createDataFrame(rows, "filename string, content binary")).collect()}
    assert got == {"b.md": ("text", None), "c.md": (None, "not_utf8"), "d.exe": (None, "extension")}


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
