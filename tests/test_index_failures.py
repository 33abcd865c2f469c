"""Documents that cannot be embedded: counted, left out, and tried again; the others are published."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.embedding import CharBucketEmbedder, EmbeddingUnavailable
from docloom.operators import index
from docloom.operators.kinds import PLAIN
from docloom.sources.store import ChunkStore


def logs(folder, bad=()):
    class Logs(CharBucketEmbedder):  # local, so that workers need not import this module
        """Writes what it embeds to a folder, and fails on some texts."""

        def embed(self, texts):
            import pathlib
            import uuid

            if any(b in t for b in bad for t in texts):
                raise ValueError("refused")
            pathlib.Path(folder, uuid.uuid4().hex).write_text("\n---\n".join(texts))
            return super().embed(texts)

    folder = str(folder)
    return Logs(8)


def docs_of(spark, rows):
    df = spark.createDataFrame([(f"c/{n}", n, (t + " ") * 3) for n, t in rows],  # long enough to be indexed
        "source_path string, title string, text string")
    return df.select("*", X.content_hash(F.col("text")).alias("content_hash"), X.classify(F.col("text")).alias("status"))


def test_one_bad_document_fails_alone(spark, tmp_path):
    store, log = ChunkStore(spark, f"file://{tmp_path}/s", buckets=4), tmp_path / "log"
    log.mkdir()
    good = [(f"g{i}", f"plain words number {i} and more of them") for i in range(20)]
    bad = [("poison", "these words are poison to the service"), ("long", "a sentence of words. " * 400 + "poison.")]
    s = index.build_index(docs_of(spark, good + bad + [("e", "")]), store, "c", PLAIN, logs(log, ["poison"]))
    assert (s["indexed"], s["failed"], s["skipped"], s["embedded_chunks"], s["total_chunks"], s["reused"]) == (20, 2, 1, 20, 20, 0)
    before = {r.title for r in store.read("c").collect()}
    assert before == {n for n, _ in good}  # nothing of the long one, although most of its chunks were embedded
    s = index.build_index(docs_of(spark, good[:1] + bad), store, "c", PLAIN, logs(log, ["poison"]))
    assert (s["reused"], s["failed"], s["embedded_chunks"]) == (1, 2, 0) and store.count("c") == 20
    for f in log.iterdir():
        f.unlink()
    s = index.build_index(docs_of(spark, good + bad), store, "c", PLAIN, logs(log))
    assert (s["indexed"], s["failed"], s["reused"]) == (22, 0, 20) and s["total_chunks"] == store.count("c") == s["embedded_chunks"] + 20
    seen = "\n---\n".join(f.read_text() for f in log.iterdir()).split("\n---\n")
    assert len(seen) == s["embedded_chunks"] and not any("number" in t for t in seen)  # only what was missing, each chunk once


def test_a_failed_change_leaves_the_older_chunks(spark, tmp_path):
    store, log = ChunkStore(spark, f"file://{tmp_path}/s", buckets=4), tmp_path / "log"
    log.mkdir()
    index.build_index(docs_of(spark, [("a", "the first words of a document"), ("b", "another document of words")]), store, "c", PLAIN, logs(log))
    s = index.build_index(docs_of(spark, [("a", "poison in the second words of it"), ("b", "another document, changed in words")]), store, "c", PLAIN, logs(log, ["poison"]))
    assert (s["indexed"], s["failed"], s["reused"]) == (1, 1, 0)
    assert {r.title: r.document.strip() for r in store.read("c").collect()} == {
        "a": ("the first words of a document " * 3).strip(), "b": ("another document, changed in words " * 3).strip()}


def test_an_outage_publishes_nothing(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s", buckets=4)
    (tmp_path / "log").mkdir()
    docs = docs_of(spark, [("a", "words of a document here"), ("b", "another document of words")])
    with pytest.raises(EmbeddingUnavailable):
        index.build_index(docs, store, "c", PLAIN, logs(tmp_path / "log", ["words"]))
    assert not store.exists("c")
    s = index.build_index(docs.limit(0), store, "c", PLAIN, logs(tmp_path / "log"))
    assert s["failed"] == s["indexed"] == 0 and store.exists("c") and store.count("c") == 0
