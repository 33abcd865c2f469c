"""Collections of chunks: immutable Parquet files in buckets, and a pointer file that names the current ones.

A collection is a folder ``<root>/<name>``. Its chunks lie in buckets by a hash of their source_path. A change never touches files that are there:

- added rows are a delta, ``snapshot=<n>/bucket=<b>``,
- removed rows are a deletion vector, ``gone=<n>/bucket=<b>``: the file and the row's number in it (part, row),
- and the pointer, which names the base snapshot, the deltas and the deletion vectors of every bucket, is moved by a rename.

So a change writes what it adds and twelve bytes or so for each row that it removes, and a reader sees all of it or nothing. Readers merge: rows named in a deletion vector are
left out by an anti join, which is in the plan only where a bucket read has such rows. A bucket with more than ``max_deltas`` deltas, or with many removed rows (``dead_share``), is written anew by
the change that crosses the line (``compact``), as a change of its own. Chunks are Parquet, deletion vectors and keys are ORC (with Bloom filters of the keys' values).

What can be pruned without reading chunks (``candidates``): source_path names buckets by its hash; ``keys=<n>``, written with each delta, lists the buckets of each source_id and operation_id; the pointer
has the smallest and largest revision of each bucket. It has the number of rows of each bucket, too, so counts read no chunks.

Of two writers that start from the same pointer the first to publish wins, and the other's change fails with ConcurrentChange: the right to follow a snapshot is a file that only
one can create. A writer that is killed between that file and the pointer's rename blocks later changes until ``release`` is called.
All file access goes through Hadoop's file system, so the root may be on any store that Spark reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.kinds import compile_where

CHUNK_SCHEMA = (
    "chunk_id string, source_path string, chunk_index int, n_chunks int, content_hash string, document string, embedding array<float>, title string, year int, "
    "category string, author string, doc_type string, source_id string, source_version_id string, operation_id string, revision long, page int, anchor string"
)


#: Columns whose values are listed by bucket.
KEYS = ("source_id", "operation_id")


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def read(self, p: str) -> str | None:
        if not self.exists(p):
            return None
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def absolute(self, p: str) -> str:
        """The path without . and .., links resolved where the file system knows them."""
        full = self.fs.makeQualified(self.path(p))
        return self.jvm.org.apache.hadoop.fs.Path(full.toUri().normalize()).toString()

    def replace(self, p: str, text: str) -> None:
        """Write aside, then rename over in one step: a reader sees the old file or the new one."""
        new = self.path(p + ".new")
        out = self.fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        over = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        over[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(new, self.path(p), over)

    def create_new(self, p: str) -> bool:
        """Make an empty file, unless it is there: of several writers, one alone gets True."""
        try:
            self.fs.create(self.path(p), False).close()
            return True
        except Exception as e:
            if self.exists(p):
                return False
            raise e

    def move(self, old: str, new: str) -> bool:
        return self.fs.rename(self.path(old), self.path(new))

    def copy(self, old: str, new: str) -> None:
        source = self.path(old)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(self.conf), source, self.fs, self.path(new), False, True, self.conf)


class ConcurrentChange(RuntimeError):
    """Another writer published a change first; nothing of this one is visible. Read again and retry."""


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, max_deltas: int = 8, dead_share: float = 0.25, dead_rows: int = 1000):
        """buckets: of collections made from now on; the pointer keeps a collection's own number. Choose it so that a bucket holds a few GB.

        A change compacts the buckets in which it leaves more than max_deltas deltas, or at least dead_rows removed rows that are more than dead_share of all.
        """
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.max_deltas, self.dead_share, self.dead_rows = max_deltas, dead_share, dead_rows
        self.files = Files(spark, self.root)

    # --- pointer ---

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/CURRENT"

    def current(self, name: str) -> dict | None:
        """By bucket: buckets, the base snapshot; deltas and gone, the snapshots of later additions and removals; rows and dead; revisions, [least, greatest]. Empty buckets are left out."""
        text = self.files.read(self._pointer(name))
        return self._blank() | json.loads(text) if text else None

    def _blank(self) -> dict:
        return {"snapshot": 0, "of": self.buckets, "buckets": {}, "deltas": {}, "gone": {}, "dead": {}, "revisions": {}, "keyed": []}

    def _bucket(self, of: int) -> Column:
        return F.pmod(F.xxhash64("source_path"), F.lit(of)).cast("int")

    @staticmethod
    def _files_of(now: dict, b: str) -> list[str]:
        """The folders that make up a bucket."""
        snapshots = ([now["buckets"][b]] if b in now["buckets"] else []) + now["deltas"].get(b, [])
        return [f"snapshot={n}/bucket={b}" for n in snapshots] + [f"gone={n}/bucket={b}" for n in now["gone"].get(b, [])]

    @staticmethod
    def _live(now: dict) -> set[int]:
        return {*now["buckets"].values(), *(n for d in now["deltas"].values() for n in d)}

    def exists(self, name: str) -> bool:
        return self.current(name) is not None

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.exists(n)]

    # --- reading ---

    def located(self, name: str, now: dict | None, buckets: list[int] | None) -> DataFrame:
        """The chunks with bucket, part and row, which say where each lies."""
        now = now or self._blank()
        wanted = [b for b in {**now["buckets"], **now["deltas"]} if buckets is None or int(b) in buckets]
        paths = [f"{self.root}/{name}/{f}" for b in wanted for f in self._files_of(now, b)]
        parts, gone = ([p for p in paths if f"/{kind}=" in p[len(self.root) + len(name) + 1 :]] for kind in ("snapshot", "gone"))
        if not parts:
            return self.spark.createDataFrame([], CHUNK_SCHEMA + ", bucket int, part string, row long")
        part = F.regexp_extract("_metadata.file_path", r"(snapshot=\d+/bucket=\d+/[^/]+)$", 1)
        df = self.spark.read.schema(CHUNK_SCHEMA).parquet(*parts)
        df = df.select("*", F.regexp_extract("_metadata.file_path", r"/bucket=(\d+)/[^/]+$", 1).cast("int").alias("bucket"), part.alias("part"), F.col("_metadata.row_index").alias("row"))
        return df.join(self.spark.read.schema("part string, row long").orc(list(gone)), ["part", "row"], "left_anti") if gone else df

    def read(self, name: str, buckets: list[int] | None = None, where: dict | None = None) -> DataFrame:
        """The chunks, of some buckets or of all; empty, and nothing created, if the collection does not exist. where: in the predicate language, read from the buckets that can match."""
        now = self.current(name)
        if where:
            can = self._candidates(name, now, where)
            buckets = buckets if can is None else sorted(can if buckets is None else can & set(buckets))
        return self.located(name, now, buckets).drop("bucket", "part", "row").filter(compile_where(where))

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that rows' source_path fall into."""
        return sorted(r[0] for r in rows.select(self._bucket((self.current(name) or self._blank())["of"]).alias("b")).distinct().collect())

    def candidates(self, name: str, where: dict) -> list[int] | None:
        """The buckets that can hold rows that match; None: all. No chunk is read."""
        can = self._candidates(name, self.current(name), where)
        return None if can is None else sorted(can)

    def _candidates(self, name: str, now: dict | None, where: dict) -> set[int] | None:
        found = None
        for key, value in where.items():
            if key == "$and":
                sets = [self._candidates(name, now, w) for w in value]
            else:
                tests = value.items() if isinstance(value, dict) else [("$eq", value)]
                sets = [self._buckets_for(name, now or self._blank(), key, op, v) for op, v in tests]
            for s in sets:
                found = s if found is None else found if s is None else found & s
        return found

    def _buckets_for(self, name: str, now: dict, key: str, op: str, value) -> set[int] | None:
        values = {"$eq": lambda: [value], "$in": lambda: list(value)}.get(op, list)()
        if key == "source_path" and op in ("$eq", "$in"):
            rows = self.spark.createDataFrame([(v,) for v in values if v is not None], "source_path string")
            return {r["b"] for r in rows.select(self._bucket(now["of"]).alias("b")).distinct().collect()}
        if key == "revision":
            test = {"$lt": lambda lo, hi: lo < value, "$lte": lambda lo, hi: lo <= value}.get(op, lambda lo, hi: any(v is not None and lo <= v <= hi for v in values))
            # A bucket whose revisions are not known may hold anything; one that has none but null matches nothing.
            return {int(b) for b in {**now["buckets"], **now["deltas"]} if b not in now["revisions"] or (now["revisions"][b] and test(*now["revisions"][b]))}
        if key in KEYS and op in ("$eq", "$in") and self._live(now) <= set(now["keyed"]):
            tables = [f"{self.root}/{name}/keys={n}" for n in sorted(self._live(now))]
            if not tables:
                return set()
            mine = self.spark.read.schema("key string, value string, bucket int").orc(tables).filter((F.col("key") == key) & F.col("value").isin([str(v) for v in values if v is not None]))
            return {r["bucket"] for r in mine.select("bucket").distinct().collect()}
        return None

    def count(self, name: str) -> int:
        """From the pointer; chunks are read only where a pointer of an earlier version has no counts."""
        now = self.current(name) or {"rows": {}}
        return sum(now["rows"].values()) if "rows" in now else self.read(name).count()

    def counts(self) -> DataFrame:
        """collection, chunks: from the pointers, one small file for each collection."""
        return self.spark.createDataFrame([(n, self.count(n)) for n in self.names()], "collection string, chunks long")

    # --- changes ---

    def release(self, name: str) -> None:
        """Let changes go on after a writer was killed while it published."""
        self.files.delete(f"{self.root}/{name}/commits/{(self.current(name) or {'snapshot': 0})['snapshot']}")

    def _number(self, name: str, after: int) -> int:
        n = after + 1
        while not self.files.create_new(f"{self.root}/{name}/numbers/{n}"):
            n += 1
        return n

    def _stage(self, name: str, chunks: DataFrame, old: dict, n: int) -> list[dict]:
        """Write rows where no pointer names them yet, and their keys; bucket, n, lo and hi (of revision) for each bucket, read from what was written."""
        have = set(chunks.columns)
        fields = self.spark.createDataFrame([], CHUNK_SCHEMA).schema.fields
        chunks = chunks.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        path = f"{self.root}/{name}/snapshot={n}"
        # Rows of a bucket meet in one task; a bucket too large for one is split, and small ones share one.
        dealt = chunks.withColumn("bucket", self._bucket(old["of"])).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)
        if not any(f.startswith("bucket=") for f in self.files.names(path)):
            return []
        made = self.spark.read.schema(CHUNK_SCHEMA + ", bucket int").parquet(path)
        keys = made.select("bucket", F.explode(F.create_map(*(c for k in KEYS for c in (F.lit(k), F.col(k)))))).filter("value IS NOT NULL").distinct()
        keys.select("key", "value", "bucket").sortWithinPartitions("key", "value").write.mode("overwrite").option("orc.bloom.filter.columns", "value").orc(f"{self.root}/{name}/keys={n}")
        return made.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("revision").alias("lo"), F.max("revision").alias("hi")).collect()

    def _abandon(self, name: str, n: int) -> None:
        for kind in ("snapshot", "gone", "keys"):
            self.files.delete(f"{self.root}/{name}/{kind}={n}")

    def _publish(self, name: str, old: dict, after: dict) -> None:
        """Move the pointer from old to after, unless someone else moved it."""
        n, was = after["snapshot"], {f for b in {**old["buckets"], **old["deltas"]} for f in self._files_of(old, b)}
        kept = {f for b in {**after["buckets"], **after["deltas"]} for f in self._files_of(after, b)}
        after["spent"] = sorted(was - kept) + [f"keys={k}" for k in sorted(self._live(old) - self._live(after))]
        after["keyed"] = sorted(set(after["keyed"]) & self._live(after))
        now = (self.current(name) or {"snapshot": 0})["snapshot"]
        if now != old["snapshot"] or not self.files.create_new(f"{self.root}/{name}/commits/{old['snapshot']}"):
            self._abandon(name, n)
            raise ConcurrentChange(name)
        self.files.replace(self._pointer(name), json.dumps(after))
        for f in old.get("spent", ()):  # what this change replaced stays for readers under way, what the one before replaced goes
            self.files.delete(f"{self.root}/{name}/" + (f if isinstance(f, str) else f"snapshot={f[1]}/bucket={f[0]}"))

    def write(self, name: str, chunks: DataFrame, buckets: list[int] | None = None, since: dict | None = None) -> None:
        """Replace the collection's contents, or those of the buckets given, in which all chunks must lie. since: the pointer that chunks were read at, if any were."""
        old = since or self.current(name) or self._blank() | {"rows": {}}
        n = self._number(name, old["snapshot"])
        made = {str(r["bucket"]): r for r in self._stage(name, chunks, old, n)}
        stays = lambda b: buckets is not None and int(b) not in buckets
        if any(stays(b) and (b in old["buckets"] or b in old["deltas"]) for b in made):
            self._abandon(name, n)
            raise ValueError("chunks lie outside the buckets to be replaced")
        after = old | {"snapshot": n, "keyed": [*old["keyed"], n]} | {k: {b: v for b, v in old[k].items() if stays(b)} for k in ("buckets", "deltas", "gone", "dead", "revisions")}
        after["buckets"] |= dict.fromkeys(made, n)
        after["revisions"] |= {b: _span(r) for b, r in made.items()}
        if "rows" in old:
            after["rows"] = {b: r for b, r in old["rows"].items() if stays(b)} | {b: r["n"] for b, r in made.items()}
        self._publish(name, old, after)

    def change(self, name: str, new: DataFrame | None = None, gone: Callable[[DataFrame | None], DataFrame] | None = None, since: dict | None = None) -> tuple[int, int]:
        """Add rows and remove others in one step: rows added, rows removed. Only what changes is written.

        new is written first and evaluated once; gone is called with the rows as written (None without any) and returns located rows that shall go.
        """
        old = since or self.current(name) or self._blank() | {"rows": {}}
        n = self._number(name, old["snapshot"])
        made = {} if new is None else {str(r["bucket"]): r for r in self._stage(name, new, old, n)}
        dead = {}
        if gone is not None:
            fresh = self.spark.read.schema(CHUNK_SCHEMA + ", bucket int").parquet(f"{self.root}/{name}/snapshot={n}") if made else None
            path = f"{self.root}/{name}/gone={n}"
            gone(fresh).select("bucket", "part", "row").distinct().hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").orc(path)
            if any(f.startswith("bucket=") for f in self.files.names(path)):
                dead = {str(r["bucket"]): r["n"] for r in self.spark.read.schema("part string, row long, bucket int").orc(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not made and not dead and self.exists(name):
            self._abandon(name, n)
            return 0, 0
        after = old | {"snapshot": n, "keyed": [*old["keyed"], n]} | {k: dict(old[k]) for k in ("buckets", "deltas", "gone", "dead", "revisions")}
        if "rows" not in old:
            old_rows = {str(r["bucket"]): r["count"] for r in self.located(name, old, None).groupBy("bucket").count().collect()}
        else:
            old_rows = old["rows"]
        after["rows"] = dict(old_rows)
        for b, r in made.items():
            if b not in old["buckets"] and b not in old["deltas"]:
                after["buckets"][b], after["revisions"][b] = n, _span(r)
            else:
                after["deltas"][b] = [*old["deltas"].get(b, []), n]
                if b in old["revisions"]:
                    ends = [*old["revisions"][b], *_span(r)]
                    after["revisions"][b] = [min(ends), max(ends)] if ends else []
            after["rows"][b] = after["rows"].get(b, 0) + r["n"]
        for b, d in dead.items():
            after["gone"][b] = [*old["gone"].get(b, []), n]
            after["dead"][b] = old["dead"].get(b, 0) + d
            after["rows"][b] -= d
            if not after["rows"][b]:
                for k in ("buckets", "deltas", "gone", "dead", "revisions", "rows"):
                    after[k].pop(b, None)
        self._publish(name, old, after)
        crossed = [int(b) for b in {*made, *dead} if len(after["deltas"].get(b, [])) > self.max_deltas or self._stale(after["dead"].get(b, 0), after["rows"].get(b, 0))]
        if crossed:
            try:
                self.compact(name, crossed)
            except ConcurrentChange:  # another change came first; the next one that crosses the line compacts
                pass
        return sum(r["n"] for r in made.values()), sum(dead.values())

    def _stale(self, dead: int, live: int) -> bool:
        return dead >= self.dead_rows and dead > self.dead_share * (dead + live)

    def compact(self, name: str, buckets: list[int] | None = None) -> None:
        """Write buckets anew, without deltas and removed rows."""
        since = self.current(name)
        if since:
            self.write(name, self.located(name, since, buckets), buckets, since)

    def reset(self, name: str) -> None:
        self.write(name, self.spark.createDataFrame([], CHUNK_SCHEMA))

    def drop(self, name: str) -> None:
        self.files.delete(f"{self.root}/{name}")

    def upsert(self, name: str, new: DataFrame) -> None:
        """Put chunks in the place of those with their ids. A chunk id always belongs to the same source_path."""
        since = self.current(name)

        def replaced(fresh: DataFrame | None) -> DataFrame:
            mine = [] if fresh is None else [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
            old = self.located(name, since, mine)
            return old if fresh is None else old.join(fresh.select("chunk_id"), "chunk_id", "left_semi")

        self.change(name, new, replaced, since)

    def replace_documents(self, name: str, paths: DataFrame, new: DataFrame, since: dict | None = None) -> tuple[int, int]:
        """Put new in the place of all chunks of the documents in paths (source_path): rows added and removed."""
        since = since or self.current(name)
        mine = self.touched(name, paths)
        return self.change(name, new, lambda fresh: self.located(name, since, mine).join(paths.select("source_path"), "source_path", "left_semi"), since)

    def delete_where(self, name: str, condition: Column | dict) -> int:
        """Rows removed. A predicate (dict) reads only the buckets that can match, a Column all."""
        since = self.current(name)
        if since is None:
            return 0
        can = self._candidates(name, since, condition) if isinstance(condition, dict) else None
        test = compile_where(condition) if isinstance(condition, dict) else condition
        return self.change(name, None, lambda fresh: self.located(name, since, None if can is None else sorted(can)).filter(test), since)[1]

    def remove_document(self, name: str, path: str) -> int:
        """Only the bucket that the path names is read."""
        return self.delete_where(name, {"source_path": path})

    def discard_operation(self, name: str, operation: str) -> int:
        return self.delete_where(name, {"operation_id": operation})

    def purge_revisions(self, name: str, source_id: str, revision: int, inclusive: bool = False) -> int:
        return self.delete_where(name, {"source_id": source_id, "revision": {"$lte" if inclusive else "$lt": revision}})

    def prune(self, base: str, active: str, keep: int = 1) -> list[str]:
        """Drop all but the active version and the ``keep`` newest older ones."""
        mine = [(int(n.rsplit("_v", 1)[1]), n) for n in self.names() if n.rsplit("_v", 1)[0] == base and "_v" in n and n != active]
        gone = [n for _, n in sorted(mine, reverse=True)[keep:]]
        for n in gone:
            self.drop(n)
        return gone

    def purge(self, base: str) -> tuple[int, list[str]]:
        """Drop the base collection and all its versions: chunks removed, names."""
        mine = [n for n in self.names() if n == base or n.startswith(f"{base}_v")]
        total = sum(self.count(n) for n in mine)
        for n in mine:
            self.drop(n)
        return total, mine


def _span(r) -> list[int]:
    return [] if r["lo"] is None else [r["lo"], r["hi"]]


def upserted(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of documents whose file is gone."""
    return chunks.join(files.select("source_path").distinct(), "source_path", "left_anti")
