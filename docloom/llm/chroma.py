"""Audio fingerprints from chroma, and alignment of recordings.

A recording (16-bit mono WAV) becomes frames of energy by pitch class. An integral image over frames and classes gives any
rectangle's sum in four look-ups; sixteen filters, each the log ratio of two halves of a rectangle, are quantised to two bits (Gray code) and packed into one 32-bit
integer for each frame. Equal fingerprints form a class, which one recording stands for. Queries meet every recording at every offset: correlations
count the bits that agree, and bit errors over an overlap of at least ``OVERLAP`` positions (or the shorter recording) judge it. For the best query alone,
a histogram of offsets of integers that have their leading bits in common must find the alignment as well, so that chance over a few positions does not.
The queries' integers go out in blocks of at most about ``BLOCK`` integers, sorted by their keys; each task runs its recordings against
a block and returns the alignments of each class, so no votes are shuffled or written.

Defined results: null, empty or unreadable audio, or audio shorter than a window, has no integers, a class of its own kind (the empty one) and no match; null ids
and repeated rows each have a result row; other input columns are ignored. The class id is the smallest id with that fingerprint.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import materialise
from docloom.shipping import ship

RATE, FRAME, HOP = 4000, 1024, 256
SPAN = 8  # frames that a filter may cover
CUTS = (-0.3, 0.0, 0.3)  # of the log ratio, between the four levels
KEY_BITS = 24  # of an integer, that a query and a recording must have in common to meet
MIN_VOTES = 4
MAX_BIT_ERROR = 0.25
OVERLAP = 4  # positions that an alignment covers at least, or all of a shorter recording
BLOCK = 2_000_000  # integers of queries that a task holds at a time: about 40 MB with their index
EXPANDED = 2_000_000  # meetings or positions that a task counts together
BATCH = 2000  # recordings that meet a block together, of at most about BLOCK integers
PAIRS = 8_250_000  # or as many recordings as make so many pairs with the block's queries, if that is more: the queries' spectra are made once for all of them
BINS = 2**22  # that tell pairs with an alignment, a power of two
TILE = 900_000  # sums that are made together: they and their spectra stay in a core's caches
HELD = 128_000_000  # bytes of recordings' spectra that are kept from one tile of queries to the next
#: (positions, lanes, bits): up to so many positions, so many recordings' correlations share a double, in so many bits each. Half a correlation is 16 a position; less its limit,
#: it stays within half a lane, and the sums' rounding errors stay within ROUNDING.
LANES = ((125, 4, 13), (1000, 3, 16))
ROUNDING = 4
A4 = 440.0


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters, spread by rule: halves split by class (0), by time (1), or into a chequer (2)."""
    return [(i % 3, (5 * i) % 9, 3 + i % 2, 2 + (3 * i) % (SPAN - 1)) for i in range(16)]


def read_wav(data: bytes | None) -> np.ndarray:
    if not data:
        return np.empty(0)
    try:
        with wave.open(io.BytesIO(data)) as w:
            x = np.frombuffer(w.readframes(w.getnframes()), np.int16).astype(float)
            return x.reshape(-1, w.getnchannels()).mean(1) / 32768
    except (wave.Error, EOFError, ValueError):
        return np.empty(0)


def write_wav(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype(np.int16).tobytes())
    return out.getvalue()


_freq = np.fft.rfftfreq(FRAME, 1 / RATE)
_heard = (_freq > 50) & (_freq < 1900)
_class = (np.round(12 * np.log2(np.maximum(_freq, 1) / A4)).astype(int)) % 12
_fold = np.zeros((len(_freq), 12))
_fold[np.nonzero(_heard)[0], _class[_heard]] = 1
_window = np.hanning(FRAME)


def chroma(x: np.ndarray) -> np.ndarray:
    """frames x 12, each frame of unit length unless silent."""
    if len(x) < FRAME:
        return np.empty((0, 12))
    f = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _window, axis=1)
    c = (f.real**2 + f.imag**2) @ _fold
    size = np.linalg.norm(c, axis=1, keepdims=True)
    return np.divide(c, size, out=np.zeros(c.shape), where=size > 1e-9)


def _prints(c: np.ndarray) -> np.ndarray:
    """recordings x frames x 12 to recordings x positions."""
    r, frames, _ = c.shape
    n = frames - SPAN + 1
    if n <= 0:
        return np.empty((r, 0), np.uint32)
    image = np.zeros((13, r, frames + 1))
    image[1:, :, 1:] = c.cumsum(1).cumsum(2).transpose(2, 0, 1)

    def area(t0, t1, y0, y1):
        return image[y1, :, t1 : t1 + n] - image[y1, :, t0 : t0 + n] - image[y0, :, t1 : t1 + n] + image[y0, :, t0 : t0 + n]

    out = np.zeros((r, n), np.uint32)
    for kind, y, h, w in filters():
        mid_y, mid_t = y + h // 2, w // 2
        whole = area(0, w, y, y + h)
        if kind == 0:
            a = area(0, w, y, mid_y)
        elif kind == 1:
            a = area(0, mid_t, y, y + h)
        else:
            a = area(0, mid_t, y, mid_y) + area(mid_t, w, mid_y, y + h)
        level = np.searchsorted(CUTS, np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(whole - a, 0)))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def fingerprint(c: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each position at which all filters fit."""
    return _prints(c[None])[0]


def fingerprint_all(chromas: list[np.ndarray]) -> list[np.ndarray]:
    """fingerprint() of each; recordings of one length go through the filters together."""
    found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(chromas)
    lengths = np.array([len(c) for c in chromas], dtype=int)
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        for i in where if n > 5000 else np.array_split(where, -(-len(where) // 100)):
            at = np.atleast_1d(i)
            for k, p in zip(at, _prints(np.stack([chromas[k] for k in at])), strict=True):
                found[k] = p
    return found


def fingerprints(table: DataFrame, id_col: str, media_col: str, decode: Callable[[object], np.ndarray] = read_wav) -> DataFrame:
    """id, prints (array<int>), of every row. decode: a cell of the media column to samples."""
    ship(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                prints = [p.view(np.int32) for p in fingerprint_all([chroma(decode(m)) for m in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.list_(pa.int32()))], ["id", "prints"])

    return table.select(id_col, media_col).mapInArrow(run, f"id {table.schema[id_col].dataType.simpleString()}, prints array<int>")


class QueryBlock:
    """Queries' integers, sorted by key."""

    def __init__(self, ids: np.ndarray, prints: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        prints = [prints[i] for i in order]
        self.size = np.array([len(p) for p in prints], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(prints).view(np.uint32)
        keys = self.flat >> np.uint32(32 - KEY_BITS)
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.first, self.times = np.unique(keys[by_key], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(prints), dtype=np.int32), self.size)[by_key]
        self.pos = (np.arange(len(keys)) - np.repeat(self.start, self.size))[by_key]

    def candidates(self, flat: np.ndarray, size: np.ndarray, min_votes: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(recording, query, offset): the offset with most votes, and of those the smallest, of each pair with enough votes; of all pairs, or at least of those that ``bins`` gave ``among``."""
        keys = flat >> np.uint32(32 - KEY_BITS)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        lo, met = self.first[place], np.where(self.keys[place] == keys, self.times[place], 0)
        rec = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        longest = int(self.size.max())
        span, n_queries = longest + int(size.max()), len(self.ids)
        ends, codes, counts, i = np.cumsum(met), np.empty(0, np.int64), np.empty(0, np.int64), 0
        while i < len(flat):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + EXPANDED, "right")))
            m = met[i:j]
            at = np.repeat(lo[i:j] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            pair, here = np.repeat(rec[i:j] * n_queries, m) + self.owner[at], np.repeat(pos[i:j], m)
            if among is not None:
                kept = np.flatnonzero(among[pair & (BINS - 1)])
                pair, here, at = pair[kept], here[kept], at[kept]
            code = pair * span + here - self.pos[at] + longest
            code, n = np.unique(code, return_counts=True)
            if len(codes):
                code, back = np.unique(np.concatenate([codes, code]), return_inverse=True)
                n = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
            codes, counts, i = code, n, j
        codes, counts = codes[counts >= min_votes], counts[counts >= min_votes]
        pair, offset = codes // span, codes % span - longest
        order = np.lexsort((-offset, np.abs(offset), -counts, pair))
        pair, offset = pair[order], offset[order]
        first = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.empty(0, bool)
        return pair[first] // n_queries, pair[first] % n_queries, offset[first]

    def judged(self, prints: list[np.ndarray], rec: np.ndarray, query: np.ndarray, offset: np.ndarray, max_bit_error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(recording, query, offset, bit error) of the alignments within max_bit_error."""
        size = np.array([len(p) for p in prints], dtype=np.int64)
        flat = np.concatenate(prints).view(np.uint32)
        begin = np.cumsum(size) - size
        lo = np.maximum(0, offset)
        n = np.minimum(size[rec], self.size[query] + offset) - lo
        step, i, ends = np.cumsum(n), 0, [np.empty(0, np.int64)]
        while i < len(rec):
            j = max(i + 1, int(np.searchsorted(step, (step[i - 1] if i else 0) + EXPANDED, "right")))
            m = n[i:j]
            along = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            a, b = np.repeat(begin[rec[i:j]] + lo[i:j], m) + along, np.repeat(self.start[query[i:j]] + lo[i:j] - offset[i:j], m) + along
            ends.append(np.add.reduceat(np.bitwise_count(flat[a] ^ self.flat[b]).astype(np.int64), np.cumsum(m) - m))
            i = j
        error = np.concatenate(ends) / (32 * n)
        near = error <= max_bit_error
        return rec[near], query[near], offset[near], error[near]

    def bins(self, rec: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whether pairs are among these, by bins that pairs may share."""
        among = np.zeros(BINS, bool)
        among[(rec * len(self.ids) + query) & (BINS - 1)] = True
        return among

    def best(self, prints: list[np.ndarray], min_votes: int, max_bit_error: float, among: np.ndarray | None = None) -> list[tuple[float, object, int] | None]:
        """(bit error, query, offset) of each recording's best voted alignment, or None; pairs that are not ``among`` have none."""
        found = [None] * len(prints)
        size = np.array([len(p) for p in prints], dtype=np.int64)
        rec, query, offset, error = self.judged(prints, *self.candidates(np.concatenate(prints).view(np.uint32), size, min_votes, among), max_bit_error)
        for e, r, q, o in sorted(zip(error, rec, query, offset, strict=True), reverse=True):
            found[r] = (float(e), self.ids[q], int(o))
        return found

    def near(self, prints: list[np.ndarray], overlap: int, max_bit_error: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(recording, query, offset, bit error) of all alignments within max_bit_error over at least ``overlap`` positions, or all of a shorter recording.

        Bits as signs are correlated at every offset by Fourier transforms, 32 channels summed before the way back; bits are counted exactly afterwards.
        Recordings and queries are grouped by powers of two and go in tiles of about TILE sums. The queries' spectra serve all recordings of
        a call, and the recordings' spectra all queries if they fit in HELD. Products of spectra are real matrix products over parts, which run faster.
        Halves of correlations are whole numbers, so recordings are added up as digits of one signal of doubles (LANES), and each sum holds their correlations side by side;
        recordings or queries too long for that go one by one, in single precision.
        """
        size = np.array([len(p) for p in prints], dtype=np.int64)
        room, query_room = _padded(size), _padded(self.size)
        for q_len in np.unique(query_room):
            for r_len in np.unique(room):
                longest = int(max(1, self.size[query_room == q_len].max(), size[room == r_len].max()))
                n = _smooth(2 * longest)
                lanes, bits, real = next(((lanes, bits, np.float64) for most, lanes, bits in LANES if longest <= most), (1, 0, np.float32))
                whole = np.result_type(real, np.complex64)
                offset = np.arange(n)
                offset[n // 2 :] -= n
                offset = offset[:, None, None, None]
                side = math.isqrt(max(1, TILE // (2 * n)))
                queries, mine = _tiles(np.flatnonzero(query_room == q_len), 2 * side | 1), np.flatnonzero(room == r_len)
                parts = _tiles(np.r_[mine, np.full(-len(mine) % lanes, -1)].reshape(-1, lanes), side | 1)
                product, sums = (np.empty(shape * len(parts[0]) * len(queries[0]), real) for shape in (4 * (n // 2 + 1), n))
                spectra = lambda rec: _spectra([[prints[k].view(np.uint32) for k in row if k >= 0] for row in rec], n, real, bits).view(real)
                held = [spectra(rec) for rec in parts] if 32 * (n // 2 + 1) * sum(map(len, parts)) * whole.itemsize <= HELD else None
                waiting, found = [], 0
                for query in queries:
                    theirs = _facing(_spectra([[self.flat[self.start[k] : self.start[k] + self.size[k]]] for k in query], n, real))
                    for at_part, rec in enumerate(parts):
                        pairs = len(rec) * len(query)
                        both = np.matmul(held[at_part] if held else spectra(rec), theirs, out=product[: 2 * (n // 2 + 1) * pairs].reshape(n // 2 + 1, len(rec), -1))
                        agree = np.fft.irfft(both.view(whole), n, axis=0, out=sums[: n * pairs].reshape(n, len(rec), -1))
                        own = size[np.where(rec < 0, rec[0, 0], rec)]
                        r, q = own[:1, None, :1] if (own == own[0, 0]).all() else own[:, None, :], _one(self.size[query])[:, None]
                        common = np.minimum(r, q + offset) - np.maximum(0, offset)
                        least = 32 * common * (1 - 2 * max_bit_error) - (1 + 1e-6 * 32 * n)
                        far = common < np.minimum(overlap, np.minimum(r, q))
                        if lanes > 1:
                            hits, lane = _reached(agree, np.where(far, 16 * longest + 2 * ROUNDING, np.floor(least / 2) - ROUNDING), bits, lanes)
                        else:
                            hits = np.flatnonzero(agree >= np.where(far, np.inf, least)[..., 0].astype(real))
                            lane = np.zeros(len(hits), np.int64)
                        if len(hits):
                            at, i, k = np.unravel_index(hits, agree.shape)
                            one = rec[i, lane]
                            waiting.append((one[one >= 0], query[k[one >= 0]], offset[at[one >= 0], 0, 0, 0]))
                            found += len(hits)
                        if found > EXPANDED // 100:
                            yield self.judged(prints, *map(np.concatenate, zip(*waiting, strict=True)), max_bit_error)
                            waiting, found = [], 0
                if waiting:
                    yield self.judged(prints, *map(np.concatenate, zip(*waiting, strict=True)), max_bit_error)

    def met(self, prints: list[np.ndarray], overlap: int, max_bit_error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``near`` finds, together."""
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0),)
        return tuple(map(np.concatenate, zip(none, *self.near(prints, overlap, max_bit_error), strict=True)))

    def foreign(self, prints: list[np.ndarray], rec: np.ndarray, query: np.ndarray, offset: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Those of the alignments with queries of other fingerprints, by recording, then bit error, query and offset."""
        named: dict[bytes, int] = {}
        name = np.array([named.setdefault(self.flat[b : b + n].tobytes(), len(named)) for b, n in zip(self.start, self.size, strict=True)])
        own = np.array([named.get(p.tobytes(), -1) for p in prints])
        kept = np.flatnonzero(own[rec] != name[query])
        kept = kept[np.lexsort((offset[kept], query[kept], error[kept], rec[kept]))]
        return rec[kept], query[kept], offset[kept], error[kept]

    def links(self, prints: list[np.ndarray], overlap: int, max_bit_error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(recording, query, offset, bit error) of all alignments of recordings with queries of other fingerprints, by recording, then bit error, query and offset."""
        return self.foreign(prints, *self.met(prints, overlap, max_bit_error))

    def best_and_links(self, prints: list[np.ndarray], min_votes: int, overlap: int, max_bit_error: float) -> tuple[list[tuple[float, object, int] | None], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``best`` and ``links``. An alignment with votes at ``overlap`` positions or more is among all alignments, so only pairs that have any need a count of votes."""
        met = self.met(prints, overlap, max_bit_error)
        return self.best(prints, min_votes, max_bit_error, self.bins(*met[:2]) if min_votes >= overlap else None), self.foreign(prints, *met)

    def others(self, prints: list[np.ndarray], overlap: int, max_bit_error: float) -> list[list[tuple[float, object, int]]]:
        """(bit error, query, offset) of the links of each recording."""
        found: list[list[tuple[float, object, int]]] = [[] for _ in prints]
        for r, q, o, e in zip(*(x.tolist() for x in self.links(prints, overlap, max_bit_error)), strict=True):
            found[r].append((e, self.ids[q], o))
        return found


def _padded(size: np.ndarray) -> np.ndarray:
    """The next power of two, 16 at least."""
    return 2 ** np.ceil(np.log2(np.maximum(size, 16))).astype(np.int64)


def _smooth(n: int) -> int:
    """The next even number without prime factors above 5."""
    while n % 2 or 30 ** n.bit_length() % n:
        n += 1
    return n


def _tiles(at: np.ndarray, most: int) -> list[np.ndarray]:
    return np.array_split(at, -(-len(at) // most))


def _one(size: np.ndarray) -> np.ndarray:
    """A single size if all are equal."""
    return size[:1] if (size == size[0]).all() else size


def _spectra(prints: list[list[np.ndarray]], n: int, real: type, lane_bits: int = 0) -> np.ndarray:
    """frequencies x rows x 32, of the bits as signs, or as half signs if a row's prints are added up as digits of lane_bits, the first one the lowest."""
    signs = np.zeros((len(prints), 32, n), real)
    for k, row in enumerate(prints):
        for lane, p in enumerate(row):
            signs[k, :, : len(p)] += (np.unpackbits(p.astype(">u4").view(np.uint8)).reshape(-1, 32).T * real(2) - 1) * real(2 ** (lane_bits * lane) / (2 if lane_bits else 1))
    return np.ascontiguousarray(np.fft.rfft(signs, axis=2).transpose(2, 0, 1))


def _facing(spectra: np.ndarray) -> np.ndarray:
    """A real matrix for each frequency: parts of a recording's spectrum times it are parts of the products with these, conjugated, summed over channels."""
    turned = spectra.conj().transpose(0, 2, 1)
    both = np.empty((len(spectra), 32, 2, spectra.shape[1]), spectra.dtype)
    both[:, :, 0], both[:, :, 1] = turned, 1j * turned
    return both.reshape(len(spectra), 64, -1).view(spectra.real.dtype)


def _reached(sums: np.ndarray, least: np.ndarray, bits: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lane) where a lane of the sums, which are overwritten, is at least ``least`` (whole numbers, their last axis the lanes).

    Each lane gets half its range less its limit, so that its highest bit tells; added to 2^52, a double's low bits are the nearest whole number."""
    units = 2.0 ** (bits * np.arange(lanes))
    sums += 2.0**52 + ((2.0 ** (bits - 1) - least) * units).sum(-1)
    tops = np.uint64(sum(2 ** (bits * lane + bits - 1) for lane in range(lanes)))
    told = sums.view(np.uint64).reshape(-1)
    told &= tops
    some = np.flatnonzero(told != 0)
    at, lane = np.nonzero(told[some, None] >> (bits * np.arange(lanes) + bits - 1).astype(np.uint64) & np.uint64(1))
    return some[at], lane


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()[:-1])


def _spans(size: np.ndarray, queries: int) -> Iterator[tuple[int, int]]:
    """Runs of at most BATCH recordings, or PAIRS pairs, and about BLOCK integers."""
    ends, most, i = np.cumsum(size), max(BATCH, PAIRS // queries), 0
    while i < len(size):
        j = min(i + most, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, "right"))))
        yield i, j
        i = j


def _query_blocks(queries: DataFrame) -> Iterator[QueryBlock]:
    """All rows (query, prints) in blocks by a hash of the query."""
    total = queries.agg(F.sum(F.size("prints")).alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK)
    for k in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).toArrow()
        if rows.num_rows:
            ids = np.array(rows.column("query").to_pylist(), dtype=object if pa.types.is_string(rows.schema.field("query").type) else None)
            yield QueryBlock(ids, _arrays(rows.column("prints").combine_chunks()))


def align(prints: DataFrame, query_condition: str = "id % 50 = 0", min_votes: int = MIN_VOTES, max_bit_error: float = MAX_BIT_ERROR) -> DataFrame:
    """id, n_prints, prints_sha256, class_id, best_query, offset, bit_error, alignments of every row; the best query is another class's or the row's own class.

    alignments: every (bit_error, query, offset) within max_bit_error of the class with queries of other classes, without votes. Pairs are of class representatives: the row whose id is
    class_id holds them for all members, others hold null, and a query stands for all rows of its class.
    """
    spark = prints.sparkSession
    ship(spark)
    text = F.array_join(F.transform("prints", lambda x: x.cast("string")), ",")
    rows = materialise(prints.select("id", "prints", F.sha2(text, 256).alias("sha")), "prints")
    # A class may be large; it is one row from here on.
    classes = materialise(rows.filter("size(prints) > 0").groupBy("sha").agg(F.min("id").alias("class_id"), F.min(F.when(F.expr(query_condition), F.col("id"))).alias("query"), F.first("prints").alias("prints")), "classes")
    id_type = classes.schema["query"].dataType.simpleString()
    one = f"struct<bit_error:double,query:{id_type},offset:int>"
    schema = f"sha string, m {one}, others array<{one}>"
    arrow = pa.struct([("bit_error", pa.float64()), ("query", pa.string() if id_type == "string" else pa.int64()), ("offset", pa.int32())])
    found = spark.createDataFrame([], schema)
    for block in _query_blocks(classes.filter("query IS NOT NULL").select("query", "prints")):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j in _spans(b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), len(shared.value.ids)):
                    part = b.slice(i, j - i)
                    prints = _arrays(part.column(1))
                    best, (rec, query, offset, error) = shared.value.best_and_links(prints, min_votes, OVERLAP, max_bit_error)
                    ends = np.searchsorted(rec, np.arange(len(prints) + 1)).astype(np.int32)
                    named = pa.array(shared.value.ids, arrow.field("query").type).take(pa.array(query))
                    others = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(error), named, pa.array(offset.astype(np.int32))], fields=list(arrow)))
                    told = pa.array([m and dict(zip(arrow.names, m, strict=True)) for m in best], arrow)
                    rows = pa.RecordBatch.from_arrays([part.column(0), told, others], ["sha", "m", "others"])
                    yield rows.take(pa.array(np.flatnonzero([m is not None for m in best] | (np.diff(ends) > 0))))

        found = found.unionByName(materialise(classes.select("sha", "prints").mapInArrow(run, schema), "alignments"))
        shared.unpersist()
    found = found.groupBy("sha").agg(F.min("m").alias("m"), F.array_sort(F.flatten(F.collect_list("others"))).alias("others"))
    named = materialise(classes.select("sha", "class_id").join(found, "sha", "left").select("sha", "class_id", F.col("m.query").alias("best_query"), F.col("m.offset").alias("offset"), F.col("m.bit_error").alias("bit_error"), F.coalesce("others", F.array().cast(f"array<{one}>")).alias("others")), "named")
    told = F.when(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("n_prints") > 0), F.col("others"))
    joined = rows.select("id", F.size("prints").cast("long").alias("n_prints"), "sha").join(named, "sha", "left")
    return joined.select("id", "n_prints", F.col("sha").alias("prints_sha256"), "class_id", "best_query", "offset", "bit_error", told.alias("alignments"))


_pitch = 2 * np.pi * A4 / 2 * (2 ** (np.arange(25) / 12))[:, None] * np.arange(HOP * 2) / RATE
_notes = 0.5 * np.sin(_pitch) + 0.25 * np.sin(2 * _pitch)


def sonify(vector: list[float] | None) -> np.ndarray:
    """A vector as a recording: a note for each component, its pitch by the component's size, with an overtone."""
    if not vector:
        return np.empty(0)
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], dtype=float))
    step = np.round(12 * (np.tanh(v * 4) + 1)).astype(int)
    return _notes[step].ravel()


def rendered(vector: list[float] | None) -> np.ndarray:
    """Through WAV bytes and back, as a media column would hold it."""
    x = sonify(vector)
    return read_wav(write_wav(x)) if len(x) else x
