"""Corpora and their life cycle: an append-only table of versions, the last of each corpus being the current one."""

from __future__ import annotations

import re
import uuid
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.kinds import KINDS
from docloom.sources.store import ChunkStore, Files

# Fixed values.
MODEL = "gemini-embedding-2"
SEED_ID = "inventions"
DIMS = (128, 3072)
STATUSES = ("draft", "published", "unpublished")


@dataclass(frozen=True)
class Corpus:
    id: str
    kind: str
    name: str
    doc_prefix: str
    query_prefix: str
    embed_dim: int = 1536
    chunk_size: int = 1000
    chunk_overlap: int = 150
    single_chunk_char_hint: int = 5500
    status: str = "draft"
    active_collection: str = ""
    index_version: str = ""
    is_seed: bool = False
    needs_rebuild: bool = False
    deleted: bool = False
    seq: int = 0


class RegistryError(ValueError):
    pass


def check_sizes(c: Corpus) -> None:
    if c.chunk_size < 100 or not 0 <= c.chunk_overlap < c.chunk_size or c.single_chunk_char_hint < c.chunk_size:
        raise RegistryError("chunk sizes")
    if not DIMS[0] <= c.embed_dim <= DIMS[1]:
        raise RegistryError("embed_dim")


class Registry:
    """One writer on the driver; each change appends a row."""

    def __init__(self, spark: SparkSession, root: str, store: ChunkStore):
        self.spark, self.root, self.store = spark, f"{root.rstrip('/')}/corpora", store
        self.files = Files(spark, root)
        self._cache: dict[str, Corpus] | None = None

    def table(self) -> DataFrame:
        kinds = {"int": "int", "bool": "boolean", "str": "string"}
        schema = ", ".join(f"{f.name} {'long' if f.name == 'seq' else kinds[f.type]}" for f in fields(Corpus))
        if not self.files.names(self.root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.root)

    def _load(self) -> dict[str, Corpus]:
        if self._cache is None:
            rows = self.table().groupBy("id").agg(F.max_by(F.struct("*"), "seq").alias("c")).select("c.*").filter("NOT deleted").collect()
            self._cache = {r["id"]: Corpus(**r.asDict()) for r in rows}
        return self._cache

    def _append(self, c: Corpus) -> Corpus:
        top = self.table().agg(F.max("seq")).first()[0] or 0
        c = replace(c, seq=top + 1)
        self.spark.createDataFrame([asdict(c)], self.table().schema).coalesce(1).write.mode("append").parquet(self.root)
        self._cache = None
        return c

    def all(self) -> list[Corpus]:
        return sorted(self._load().values(), key=lambda c: (not c.is_seed, c.id))

    def published(self) -> list[Corpus]:
        return [c for c in self.all() if c.status == "published"]

    def get(self, corpus_id: str) -> Corpus:
        found = self._load().get(corpus_id)
        if found is None:
            raise RegistryError("no such corpus")
        return found

    def seed(self, c: Corpus) -> None:
        if not self._load():
            self._append(replace(c, is_seed=True))

    def create(self, slug: str, kind: str, name: str, doc_prefix: str = "", query_prefix: str = "", **sizes: int) -> Corpus:
        slug = slug.strip().lower()
        if not re.fullmatch(X.SLUG[1:-1], slug) or slug == SEED_ID or slug in self._load():
            raise RegistryError("slug")
        if kind not in KINDS or not KINDS[kind].creatable:
            raise RegistryError("kind")
        if not name.strip():
            raise RegistryError("name")
        line = lambda p: p.strip() + "\n" if p.strip() else ""
        c = Corpus(slug, kind, name.strip(), line(doc_prefix), line(query_prefix), **sizes)
        check_sizes(c)
        return self._append(replace(c, active_collection=f"{slug}_v1", index_version=f"{slug}:{MODEL}:{c.embed_dim}:v1"))

    def update(self, corpus_id: str, **changes) -> Corpus:
        """A change of a field that shapes chunks or vectors marks the corpus for a rebuild."""
        old = self.get(corpus_id)
        new = replace(old, **changes)
        check_sizes(new)
        stale = any(getattr(old, f) != getattr(new, f) for f in X.REBUILD_FIELDS)
        return self._append(replace(new, needs_rebuild=old.needs_rebuild or stale))

    def set_active(self, corpus_id: str, collection: str) -> Corpus:
        c = self.get(corpus_id)
        base, _, version = collection.rpartition("_v")
        return self._append(replace(c, active_collection=collection, index_version=f"{base}:{c.embed_dim}:v{version}", needs_rebuild=False))

    def set_status(self, corpus_id: str, status: str) -> Corpus:
        c = self.get(corpus_id)
        if status not in STATUSES:
            raise RegistryError("status")
        if (c.status, status) == ("draft", "published") and not self.store.count(c.active_collection):
            raise RegistryError("nothing is indexed")
        return self._append(replace(c, status=status))

    def delete(self, corpus_id: str, confirm: str) -> tuple[int, list[str]]:
        """The row first, then all versions of its collection."""
        c = self.get(corpus_id)
        if c.is_seed or c.status == "published" or confirm != corpus_id:
            raise RegistryError("not deletable")
        self._append(replace(c, deleted=True))
        return self.store.purge(c.active_collection.rpartition("_v")[0])


def new_operation() -> str:
    return uuid.uuid4().hex
