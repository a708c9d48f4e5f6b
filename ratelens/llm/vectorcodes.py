"""Product codes of vectors: each of several parts is named by the nearest entry of a codebook that Lloyd's rounds train.

The method is Lloyd with heaps. Vectors lie in blocks of some thousand rows, and a block keeps, for each part and
entry, a heap of the vectors that the entry holds. A vector's key is the slack between its bounds, the distance to the
second nearest entry less the distance to its own, plus what the entry's drift has summed up to when it was scanned. When
entries move, the sum of an entry's drift grows by its own step and the longest step of any other; only vectors at the top
of a heap whose key that sum has reached can be nearer to another entry. These are popped, scanned against all entries
exactly, and pushed again; a heap whose top holds is left as it is, whatever its size.

Components are integers, and distances and sums are exact: in doubles while all terms stay below 2**53, else in integers
of any size. Bounds are doubles with a margin, so that they only ever ask for a scan too many.

On a cluster a round is one pass over the blocks: tasks add up what vectors that changed their entry take from one and
bring to another, and Spark sums these over tasks; the driver holds the codebooks (entries x components) and
nothing else. Blocks are a work table written anew each round, in which a heap is stored as it stands; the round before's
is deleted. Executors that get lost cost their running tasks only.

Defined results: rows whose vector is null or holds a null, a NaN or an infinity are dropped (also one whose scaled
component is infinite). The first rows by id, ties by vector, nulls last, begin the codebooks; with fewer rows than entries, there
are as many entries as rows. A vector whose length is not that of the first, or isn't a multiple of the parts, is kept with null
code and error, and takes part in nothing. Rows that repeat are vectors of their own. Errors beyond a long are the
greatest long. An empty table gives no rows. Columns besides id, vector and label don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm.common import discard, small_batches, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK = 4096
#: Sums of labels are broadcast up to so many rows; beyond, rows and sums meet in a salted join.
BROADCAST_LABELS, SALTS = 100_000, 32
EXACT = float(1 << 53)
LIMB = 48
MOST = (1 << 63) - 1


@dataclass
class Books:
    """Entries of each part as integers, and what each entry's drift has summed up to."""

    entries: np.ndarray  # parts x entries x width, integers of any size
    drift: np.ndarray  # parts x entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def exactly(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether squared distances between rows of the two can be summed in doubles without rounding."""
    top = max((float(np.max(np.abs(x))) if x.size else 0.0) for x in (a, b))
    return 4 * top * top * max(1, a.shape[-1]) < EXACT


def integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries: doubles that hold integers, or integers of any size."""
    if exactly(x, book):
        a, b = x.astype(float), book.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    a, b = integers(x), integers(book)
    return np.array([((b - row) ** 2).sum(1) for row in a], object).reshape(len(a), len(b))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lowest of equal ones, and the slack to the second nearest."""
    d = squares(x, book)
    code = np.array([int(np.argmin(r)) for r in d]) if d.dtype == object else d.argmin(1)
    at = np.arange(len(x))
    own = np.sqrt(d[at, code].astype(float))
    if d.shape[1] == 1:
        return code, np.full(len(x), np.inf)
    d[at, code] = float("inf")
    second = np.sqrt(d.min(1).astype(float))
    return code, second - own


def reached(key: np.ndarray | float, drift: np.ndarray | float):
    """Whether drift has used the slack up, with a margin for the rounding of square roots and sums."""
    return key - drift <= 1e-9 * (1 + abs(drift) + abs(key))


class Heaps:
    """One part's heaps of a block: for each entry its rows by key, stored one heap after the other."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> None:
        self.rows, self.keys, self.sizes = rows, keys, sizes

    @staticmethod
    def of(code: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, code))  # sorted rows are a heap
        return Heaps(order.astype(np.int32), keys[order], np.bincount(code, minlength=entries).astype(np.int32))

    def codes(self) -> np.ndarray:
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out

    def moved(self, x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pop and scan what drift has reached; (rows, entry before, entry now) of those that changed it."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        held = np.flatnonzero(self.sizes)
        touched = held[reached(self.keys[starts[held]], drift[held])]
        heaps: dict[int, list[tuple[float, int]]] = {}
        popped, was = [], []

        def heap(e: int) -> list[tuple[float, int]]:
            if e not in heaps:
                a, b = starts[e], ends[e]
                heaps[e] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))
            return heaps[e]

        for e in touched.tolist():
            h, limit = heap(e), float(drift[e])
            while h and reached(h[0][0], limit):
                popped.append(heappop(h)[1])
                was.append(e)
        if not popped:
            none = np.zeros(0, np.int64)
            return none, none, none
        rows, before = np.array(popped), np.array(was)
        now, slack = nearest(x[rows], book)
        for r, e, k in zip(popped, now.tolist(), (slack + drift[now]).tolist(), strict=True):
            heappush(heap(e), (k, r))
        lists = [(self.rows[a:b], self.keys[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for e, h in heaps.items():
            lists[e] = (np.array([r for _, r in h], np.int32), np.array([k for k, _ in h], float))
        self.rows, self.keys = np.concatenate([r for r, _ in lists]), np.concatenate([k for _, k in lists])
        self.sizes = np.array([len(r) for r, _ in lists], np.int32)
        changed = now != before
        return rows[changed], before[changed], now[changed]


class Sums:
    """What a task's vectors bring to entries and take from them: totals of components, and counts after them."""

    def __init__(self, parts: int, entries: int, width: int) -> None:
        self.shape = (parts, entries, width + 1)
        self.small, self.large, self.top = np.zeros(self.shape, np.int64), {}, 0

    def add(self, part: int, entry: np.ndarray, x: np.ndarray, sign: int) -> None:
        if not len(entry):
            return
        self.top += len(x) * int(min(np.max(np.abs(x)), 2.0**63))
        if self.top < 1 << 60:
            np.add.at(self.small[part], entry, sign * np.column_stack([x.astype(np.int64), np.ones(len(x), np.int64)]))
            return
        self.top -= len(x) * int(min(np.max(np.abs(x)), 2.0**63))
        for e, row in zip(entry.tolist(), integers(x), strict=True):
            for i, v in enumerate([*row, 1]):
                slot = (part * self.shape[1] + e) * self.shape[2] + i
                self.large[slot] = self.large.get(slot, 0) + sign * v

    def limbs(self) -> tuple[list[int], list[int], list[int]]:
        """(slot, limb, value): a number is the sum of its limbs' values times 2 ** (48 * limb)."""
        flat = self.small.ravel()
        at = np.flatnonzero(flat)
        slot, limb, value = at.tolist(), [0] * len(at), flat[at].tolist()
        for s, v in self.large.items():
            k = 0
            while v and v != -1:
                slot.append(s), limb.append(k), value.append(v & ((1 << LIMB) - 1))
                v, k = v >> LIMB, k + 1
            if v:
                slot.append(s), limb.append(k), value.append(-1)
        return slot, limb, value


def packed(x: np.ndarray) -> tuple[bytes, int]:
    """The integers of a block in as few bytes as hold them all: 2, 4, or doubles."""
    top = np.max(np.abs(x)) if x.size else 0
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64
    return x.astype(kind).tobytes(), np.dtype(kind).itemsize


def unpacked(raw: bytes, size: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.float64}[size]).astype(float).reshape(-1, dim)


_BINARY = ("comps", "rows", "keys", "sizes")
_SUMS = ("slots", "limbs", "amounts")


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: list[Heaps]) -> pa.RecordBatch:
    raw, size = packed(x)
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    arrays = [one(ids), one(labels), pa.array([size], pa.int32()), pa.array([raw], pa.binary())]
    arrays += [pa.array([b"".join(np.ascontiguousarray(getattr(h, n)).tobytes() for h in heaps)], pa.binary()) for n in ("rows", "keys", "sizes")]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([None], pa.list_(pa.int64())) for _ in _SUMS)], ["ids", "labels", "size", *_BINARY, *_SUMS])


def _total(sums: Sums, ids: pa.DataType, labels: pa.DataType) -> pa.RecordBatch:
    arrays = [pa.array([None], pa.list_(ids)), pa.array([None], pa.list_(labels)), pa.array([None], pa.int32())] + [pa.array([None], pa.binary()) for _ in _BINARY]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([v], pa.list_(pa.int64())) for v in sums.limbs())], ["ids", "labels", "size", *_BINARY, *_SUMS])


def _heaps(batch: pa.RecordBatch, i: int, parts: int, entries: int) -> list[Heaps]:
    rows, keys = np.frombuffer(batch.column("rows")[i].as_py(), np.int32).reshape(parts, -1), np.frombuffer(batch.column("keys")[i].as_py(), float).reshape(parts, -1)
    sizes = np.frombuffer(batch.column("sizes")[i].as_py(), np.int32).reshape(parts, entries)
    return [Heaps(rows[p], keys[p], sizes[p]) for p in range(parts)]


def _schema(ids: str, labels: str) -> str:
    return f"ids array<{ids}>, labels array<{labels}>, size int, comps binary, rows binary, keys binary, sizes binary, slots array<long>, limbs array<long>, amounts array<long>"


def _first_blocks(rows: DataFrame, books: Books, schema: str, scale: int) -> DataFrame:
    """Blocks whose vectors are all scanned against all entries, and their sums."""
    parts, entries, width = books.entries.shape

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, last = Sums(parts, entries, width), None
        for whole in it:
            for a in range(0, len(whole), BLOCK):
                last = batch = whole.slice(a, BLOCK)
                v = batch.column("v")
                x = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(float) * scale).reshape(len(batch), -1)
                heaps = []
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    code, slack = nearest(own, books.entries[p])
                    sums.add(p, code, own, 1)
                    heaps.append(Heaps.of(code, slack + books.drift[p][code], entries))
                yield _block(batch.column("id"), batch.column("label"), x, heaps)
        if last is not None:
            yield _total(sums, last.column("id").type, last.column("label").type)

    return rows.mapInArrow(work, schema)


def _next_blocks(blocks: DataFrame, books: Books, schema: str) -> DataFrame:
    """Blocks of which only vectors whose bounds drift has reached are scanned again, and the changes of the sums."""
    parts, entries, width = books.entries.shape

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = Sums(parts, entries, width), None
        for batch in it:
            kinds = batch.column("ids").type.value_type, batch.column("labels").type.value_type
            for i in range(len(batch)):
                x = unpacked(batch.column("comps")[i].as_py(), batch.column("size")[i].as_py(), parts * width)
                heaps = _heaps(batch, i, parts, entries)
                for p, h in enumerate(heaps):
                    own = x[:, p * width : (p + 1) * width]
                    rows, before, now = h.moved(own, books.entries[p], books.drift[p])
                    sums.add(p, before, own[rows], -1)
                    sums.add(p, now, own[rows], 1)
                yield _block(batch.column("ids")[i].values, batch.column("labels")[i].values, x, heaps)
        if kinds is not None:
            yield _total(sums, *kinds)

    return blocks.filter("ids is not null").mapInArrow(work, schema)


def _coded(blocks: DataFrame, books: Books, ids: str, labels: str) -> DataFrame:
    """id, label, code and error of each row of the blocks."""
    parts, entries, width = books.entries.shape

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(len(batch)):
                x = unpacked(batch.column("comps")[i].as_py(), batch.column("size")[i].as_py(), parts * width)
                codes = np.column_stack([h.codes() for h in _heaps(batch, i, parts, entries)])
                error = np.zeros(len(x), object)
                for p in range(parts):
                    own, to = x[:, p * width : (p + 1) * width], books.entries[p][codes[:, p]]
                    if exactly(own, to):
                        error = error + ((own - to.astype(float)) ** 2).sum(1).astype(np.int64).astype(object)
                    else:
                        error = error + ((integers(own) - integers(to)) ** 2).sum(1)
                text = codes.astype(np.uint8).tobytes().hex()
                step = 2 * parts
                code = pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, code, pa.array([min(e, MOST) for e in error.tolist()], pa.int64())], ["id", "label", "code", "error"])

    return blocks.filter("ids is not null").select("ids", "labels", "size", *_BINARY).mapInArrow(work, f"id {ids}, label {labels}, code string, error long")


def _changes(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The sums over all tasks: at most entries x (components + parts) numbers, of a few limbs each."""
    rows = blocks.filter("slots is not null").select(F.explode(F.arrays_zip(*_SUMS)).alias("z")).select("z.*")
    out = np.zeros(shape[0] * shape[1] * (shape[2] + 1), object)
    for slot, limb, value in rows.groupBy("slots", "limbs").agg(F.sum(F.col("amounts").cast("decimal(20,0)"))).collect():
        out[slot] += int(value) << (LIMB * limb)
    return out.reshape(shape[0], shape[1], shape[2] + 1)


def _moved(books: Books, sums: np.ndarray) -> Books:
    """Each entry at the floored mean of its parts, unused ones where they were, and drift carried on."""
    entries, drift = books.entries.copy(), books.drift.copy()
    for p, e in zip(*np.nonzero(sums[:, :, -1]), strict=True):
        entries[p, e] = [int(s) // int(sums[p, e, -1]) for s in sums[p, e, :-1]]
    steps = np.sqrt(((entries - books.entries) ** 2).sum(2).astype(float))
    for p in range(len(steps)):
        order = np.argsort(steps[p])
        most, next_most = steps[p][order[-1]], steps[p][order[-2]] if len(order) > 1 else 0.0
        others = np.full(len(order), most)
        others[order[-1]] = next_most
        drift[p] += (steps[p] + others) * (1 + 1e-12)
    return Books(entries, drift)


def usable(vector: str, scale: int = SCALE):
    """Whether the vector is there and all its components are, and finite once scaled."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def coded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """The key, label, code, error, label_error and codebooks_sha256 of each usable row."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits, so there are 1 to 256 entries")
    spark = vectors.sparkSession
    small_batches(spark, BLOCK)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(usable("v", scale))
    ids, labels = (rows.schema[n].dataType.simpleString() for n in ("id", "label"))
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").first()
    dim = len(first["v"]) if first else 0
    fits = F.size("v") == dim if dim and dim % parts == 0 else F.lit(False)
    begin = rows.filter(fits).select("v", "id").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if begin:
        out, books = _trained(spark, rows.filter(fits), _begun([r["v"] for r in begin], parts, scale), rounds, ids, labels, scale)
        digest = books.digest()
        out = out.unionByName(_uncoded(rows.filter(~fits)))
    else:
        out, digest = _uncoded(rows), hashlib.sha256(b"").hexdigest()
    return _with_label_errors(out).select(F.col("id").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _uncoded(rows: DataFrame) -> DataFrame:
    return rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))


def _begun(vectors: list[list[float]], parts: int, scale: int) -> Books:
    x = integers(np.floor(np.array(vectors, float) * scale)).reshape(len(vectors), parts, -1)
    return Books(x.transpose(1, 0, 2).copy(), np.zeros((parts, len(vectors))))


def _trained(spark: SparkSession, rows: DataFrame, books: Books, rounds: int, ids: str, labels: str, scale: int) -> tuple[DataFrame, Books]:
    schema = _schema(ids, labels)
    blocks = written(_first_blocks(rows, books, schema, scale), "codes")
    sums = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), object)
    for _ in range(rounds):
        sums = sums + _changes(blocks, books.entries.shape)
        books = _moved(books, sums)
        after = written(_next_blocks(blocks, books, schema), "codes")
        discard(blocks)
        blocks = after
    return _coded(blocks, books, ids, labels), books


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """The sum of errors over each row's label, nulls together."""
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    total = F.when(total < MOST, total.cast("long")).when(total.isNotNull(), F.lit(MOST))
    per = written(rows.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "own")
    if per.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(per), F.col("label").eqNullSafe(F.col("own"))).drop("own")
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("own_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("label").eqNullSafe(F.col("own")) & (F.col("own_salt") == F.col("salt"))).drop("own", "salt", "own_salt")
