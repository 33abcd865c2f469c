"""Exact n-gram Jaccard join of documents, by a token-group matrix.

A document's tokens are its distinct word shingles, hashed to 64 bits. Rows with equal token sets are one node (128-bit
identity of the sorted tokens). Similar nodes are put into groups, a matrix holds the union of each group's prefix tokens,
a query's overlap with every group is bounded by its row in that matrix, and only groups whose bound reaches the need are opened.

All tokens have one global order: common ones last, so prefixes hold rare tokens. For a similarity of num/den a partner shares at
least need = ceil(num*n/den) of n tokens; so among the first n - need + EXTRA tokens of both, at least min(EXTRA, need) are
shared. Counting shared prefix tokens therefore bounds the overlap, of a node or of a group's union, and loses no link. A second bound adds up, over
classes of tokens, the smaller of two nodes' counts: sets that share a passage only fall well below the need. A third bound needs no
pair: where the parities of two counts differ, so do the sets, in one token at least; a matrix cell keeps the conjunction and disjunction of its
members' parities, and classes in which a query differs from all of them are counted against the largest difference that a link allows.

Steps: (1) common tokens, counted over all documents, give the order (a bounded list: it changes costs only, never
results); (2) prefixes of all documents; tokens drop out unless two nodes have them whose sizes allow a link; (3) each token's smallest and largest node lead it; nodes that
share enough tokens with a leader are compared with it, and components of these links form groups; (4) the matrix of tokens and groups;
each node of a smaller group queries larger ones, and is compared with the members of those that its bounds open; (5) components of all links. Pairs inside a group are not listed. Every set is compared exactly.

Defined results: null, empty and blank texts have no tokens, n 0, and are their own component; of fewer words than ``words``
the whole sequence is one token; null ids and repeated rows each have a result row (a null id is never the smallest unless alone); rows with equal ids but
different texts are different nodes; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.shared import discard, join_each, materialise
from docloom.shipping import ship

EXTRA = 3
COMMON = 1 << 18  # tokens in the list of common ones: 2 MB
COUNTED = 4_000_000  # tokens counted together before they leave a task
COMMON_IN_TASK = 4
PARTS = 256  # classes of tokens that are counted for each node
ODD = [f"o{i}" for i in range(PARTS // 64)]  # columns that hold the parities of these counts, one bit for each class


def tokens_of(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words end at ASCII white space, as bytes.split() does."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    acc = h[: n - words + 1].copy()
    for j in range(1, words):
        acc ^= acc >> np.uint64(32)
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[j : n - words + 1 + j]
    acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def need(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _need(n: Column, num: int, den: int) -> Column:
    return F.ceil(n * num / den) if den == 1 else F.floor((n * num + den - 1) / den)


def _size_class(num: int, den: int) -> Column:
    """A bit for n: sizes of a link are in the same class or in neighbouring ones. Classes are numbered around 64; that only lets more pass."""
    width = math.log(den / num) * (1 + 1e-6)
    return F.expr(f"shiftleft(1L, cast(pmod(floor(ln(greatest(n, 1)) / {width!r}D), 64) AS int))")


def _next_class(bits: Column | str) -> Column:
    return F.shiftleft(bits, 1).bitwiseOR(F.shiftrightunsigned(bits, 63))


def _previous_class(bits: Column | str) -> Column:
    return F.shiftrightunsigned(bits, 1).bitwiseOR(F.shiftleft(bits, 63))


def identity(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _common_tokens(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """The most common tokens, rarest of them first. Tasks report tokens that several documents of a few thousand share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            keep = n >= COMMON_IN_TASK
            return pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(tokens_of(text, words))
                size += len(held[-1])
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        yield flush()

    counts = docs.select(text_col).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "token").limit(COMMON).toPandas()
    return top.sort_values(["n", "token"], kind="stable")["token"].to_numpy(np.int64).view(np.uint64)


def _prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rank = shared.value
        for b in batches:
            n, sig, prefix, parts = [], [], [], []
            for text in b.column(1).to_pylist():
                t = tokens_of(text, words)
                n.append(len(t))
                sig.append(identity(t))
                size = min(len(t), len(t) - need(len(t), num, den) + EXTRA)
                if len(table):
                    at = np.minimum(np.searchsorted(table, t), len(table) - 1)
                    is_common = table[at] == t
                    own = t[~is_common][:size]
                    if len(own) < size:
                        late = t[is_common]
                        own = np.concatenate([own, late[np.argsort(rank[at[is_common]])][: size - len(own)]])
                else:
                    own = t[:size]
                prefix.append(own.view(np.int64))
                parts.append(np.bincount((t & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32))
            odd = np.packbits(np.array(parts, np.int32).reshape(-1, PARTS) & 1, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))]
                + [pa.array(odd[:, i]) for i in range(len(ODD))],
                ["doc_id", "n", "sig", "prefix", "parts", *ODD],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, sig binary, prefix array<long>, parts array<int>, " + ", ".join(f"{x} long" for x in ODD))


def _token_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                sets = [tokens_of(t, words) for t in b.column(0).slice(i, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([identity(t) for t in sets], pa.binary()), pa.array([t.view(np.int64) for t in sets], pa.list_(pa.int64()))], ["sig", "tokens"])

    return docs.select(text_col).mapInArrow(run, "sig binary, tokens array<long>")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 9, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id, n, sig of every row; node, root of every node that is linked and not its component's smallest."""
    ship(docs.sparkSession)
    common = _common_tokens(docs, text_col, words)
    first = materialise(_prefixes(docs, id_col, text_col, words, num, den, common), "prefixes")
    rows = materialise(first.select("doc_id", "n", "sig"), "rows")
    each = first.select(F.explode("prefix").alias("token"), "sig", "n")
    # Tokens of two nodes whose sizes allow a link, with a bit for each class of sizes among their holders.
    code = F.xxhash64("sig")
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_or(_size_class(num, den)).alias("classes"), F.min(code).alias("lo"), F.max(code).alias("hi"))
    crowded = F.col("c") > F.bit_count("classes")  # a class of sizes has several holders
    shared = held.filter("lo <> hi").filter(crowded | (F.col("classes").bitwiseAND(_next_class("classes")) != 0))
    shared = materialise(shared.select("token", "classes", crowded.alias("crowded")), "shared")
    own = _size_class(num, den)
    beside = F.col("classes").bitwiseAND(_next_class(own).bitwiseOR(_previous_class(own))) != 0
    spots = materialise(each.join(shared, "token").filter(F.col("crowded") | beside).select("token", "sig", "n").distinct(), "spots")
    discard(shared)
    least = lambda n: F.least(F.lit(EXTRA), _need(n, num, den))

    lead = materialise(spots.groupBy("token").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi"), "lead")
    stars = spots.join(lead, "token").select("sig", "n", F.explode(F.array("lo", "hi")).alias("lead")).filter("sig <> lead")
    stars = stars.groupBy("sig", "lead").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).filter(F.col("c") >= least(F.col("n")))
    pairs = materialise(stars.select(F.greatest("sig", "lead").alias("a"), F.least("sig", "lead").alias("b")), "pairs")
    discard(lead)
    parts = materialise(first.select("sig", "n", "parts", *ODD).join(spots.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"]), "parts")
    discard(first)
    sets: list[DataFrame] = []

    def enough(common: Column, na: Column, nb: Column) -> Column:
        return common * (num + den) >= (na + nb) * num

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs whose overlap can be large enough: no class of tokens shares more than the smaller of its two counts."""
        side = lambda x: parts.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("parts").alias(f"p{x}"))
        most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
        sizes = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
        both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").filter(sizes)
        return materialise(both.filter(enough(most, F.col("na"), F.col("nb"))).select("a", "b"), "bounded")

    def token_sets(pairs: DataFrame) -> DataFrame:
        """The whole sets of all nodes in pairs; texts are read only for those not at hand."""
        nodes = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        for have in sets:
            nodes = nodes.join(have.select("sig"), "sig", "left_anti")
        one = materialise(rows.join(nodes, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("__i")), "one")
        if one.limit(1).count():
            texts = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__t"))
            texts = texts.join(one, texts["__d"].eqNullSafe(one["__i"]), "left_semi")
            found = _token_sets(texts, "__d", "__t", words).join(one, "sig", "left_semi").dropDuplicates(["sig"])
            sets.append(materialise(found, "sets"))
        out = sets[0]
        for more in sets[1:]:
            out = out.unionByName(more)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that are links, by their whole sets."""
        pairs = bounded(pairs)
        if not pairs.limit(1).count():
            return pairs
        whole = token_sets(pairs)
        side = lambda x: whole.select(F.col("sig").alias(x), F.col("tokens").alias(f"t{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("ta", "tb"))
        return materialise(both.filter(enough(common, F.size("ta"), F.size("tb"))).select("a", "b"), "links")

    edges = linked(pairs)
    roots = components(edges)
    sizes = materialise(roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("members")), "sizes")
    nodes = parts.select("sig", "n", *ODD).join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    nodes = materialise(nodes.join(sizes, "root", "left").withColumn("members", F.coalesce("members", F.lit(1))), "nodes")
    query = materialise(spots.drop("n").join(nodes, "sig"), "query")
    discard(spots)
    both = [f(x).alias(f"{x}_{k}") for x in ODD for k, f in (("and", F.bit_and), ("or", F.bit_or))]
    matrix = query.groupBy("token", "root", "members").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), *both)
    matrix = materialise(matrix.withColumnsRenamed({"root": "g", "members": "gm"}), "matrix")

    def near(differ: list[Column], most: Column) -> Column:
        """No more classes differ than the sets of a link with a node of at most that many tokens."""
        return reduce(add, map(F.bit_count, differ)) * (num + den) <= (F.col("n") + most) * (den - num)

    fits = (F.col("lo") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("hi") * den)
    fits &= near([F.col(x).bitwiseAND(F.bitwise_not(f"{x}_or")).bitwiseOR(F.bitwise_not(x).bitwiseAND(F.col(f"{x}_and"))) for x in ODD], F.col("hi"))
    smaller = (F.col("members") < F.col("gm")) | ((F.col("members") == F.col("gm")) & (F.col("root") < F.col("g")))
    bound = query.join(matrix, "token").filter(fits & smaller).groupBy("sig", "g").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), *(F.first(x).alias(x) for x in ODD))
    opened = materialise(bound.filter(F.col("c") >= least(F.col("n"))).drop("c"), "open")
    for t in (query, matrix):
        discard(t)
    inside = nodes.select(F.col("root").alias("g"), F.col("sig").alias("b"), F.col("n").alias("m"), *(F.col(x).alias(f"{x}_b") for x in ODD))
    close = (F.col("m") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("m") * den)
    close &= near([F.col(x).bitwiseXOR(F.col(f"{x}_b")) for x in ODD], F.col("m"))
    more = linked(opened.join(inside, "g").filter(close).select(F.col("sig").alias("a"), "b"))
    for t in (sizes, nodes, opened):
        discard(t)
    if more.limit(1).count():
        roots = components(edges.unionByName(more))
    for t in (parts, *sets):
        discard(t)
    return rows, roots


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, sig of every row."""
    rows, roots = links(docs, id_col, text_col, words, num, den)
    # Equal sets meet once: the smallest id of each node, then of each component.
    nodes = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("low"))
    nodes = materialise(nodes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "nodes")
    lowest = materialise(nodes.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = materialise(join_each(nodes, lowest, "root").select("sig", "component_id"), "named")
    full = join_each(rows, named, "sig")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "sig")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest id, null ids last, of equal ids the first in the table. Documents without tokens all stay.

    Rows are numbered in a written table, so that ids may be null or repeat.
    """
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = near_groups(numbered, "__row", text_col, words, num, den).select(F.col("doc_id").alias("__row"), "component_id")
    alike = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = materialise(groups.join(alike, "component_id"), "members")
    named = members.join(numbered.select("__row", F.col(id_col).alias("__i")), "__row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("__i").isNull(), "__i", "__row")).alias("best"))
    stay = materialise(best.select(F.col("best.__row").alias("__row")), "stay")
    gone = materialise(members.select("__row").join(stay, "__row", "left_anti"), "gone")
    for t in (members, stay):
        discard(t)
    return numbered.join(gone, "__row", "left_anti").select(*docs.columns)
