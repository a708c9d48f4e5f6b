"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of ``window`` words (a shorter item is one window). A window's set is
its word shingles of ``shingle`` words; it occurs in a document only if all of them do, so one is a
sufficient prefix, and the rarest is taken: one pass over all documents counts the shingles that windows
hold. A second pass looks only for these prefix shingles. Where one stands, the window's place follows
from the shingle's position in it; length and positional bounds drop windows that would begin before or
end after the document, and what is left is verified word by word.

Items are read in blocks of at most ``block_words`` words, so what is broadcast has a fixed bound; each
block has its two passes over the documents and adds to the hits that the last one left with the row. No
row is shuffled.

Defined results: null and empty texts have no words and aren't contaminated; items with a null id, a null
text or no word are skipped. Words of items and documents that repeat count at each place. Rows that
repeat are judged alike. Very long texts are held one at a time. Other columns pass through; one of the result's name is
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import ALNUM, apart, as_bytes, free_name, gathered, shingles, slices, small_batches, words_of

WINDOW, SHINGLE = 13, 4
BLOCK_WORDS = 500_000
STEP = 4 << 20
STATE = "struct<n_words:long,n_hit:long,items:array<string>,hit:array<long>>"


def words(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    s, e, _ = words_of(raw, ALNUM)
    data = raw.tobytes().lower()
    return [data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def hashed(raw: list[bytes]) -> np.ndarray:
    return words_of(np.frombuffer(b" ".join(raw), np.uint8), ALNUM)[2]


class Seen:
    """A set of hashes with a bitmap before the search."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that are in the set, and their numbers in it."""
        at = np.flatnonzero(self.bits[h >> np.uint64(44)])
        k = np.searchsorted(self.keys, h[at])
        ok = self.keys[np.minimum(k, len(self.keys) - 1)] == h[at] if len(self.keys) else np.zeros(0, bool)
        return at[ok], k[ok]


@dataclass
class Windows:
    """Distinct windows of a block of items."""

    text: list[list[bytes]]  # the words of each
    items: list[list[str]]  # the items that hold it
    shingle: int
    prefix: np.ndarray | None = None  # the hash of each window's rarest shingle
    offset: np.ndarray | None = None  # and its first place in the window

    def __post_init__(self) -> None:
        self.hash = [hashed(w) for w in self.text]
        self.size = np.array([len(w) for w in self.text], np.int64)
        self.k = np.minimum(self.size, self.shingle)

    def all_shingles(self) -> np.ndarray:
        return np.unique(np.concatenate([shingles(h, int(k)) for h, k in zip(self.hash, self.k, strict=True)] or [np.zeros(0, np.uint64)]))

    def order(self, counts: dict[int, int]) -> None:
        """Take each window's rarest shingle as its prefix; of equals the first by hash."""
        prefix, offset = [], []
        for h, k in zip(self.hash, self.k, strict=True):
            own = shingles(h, int(k)).tolist()
            best = min(range(len(own)), key=lambda i: (counts.get(own[i], 0), own[i], i))
            prefix.append(own[best])
            offset.append(best)
        self.prefix, self.offset = np.array(prefix, np.uint64), np.array(offset, np.int64)
        self.by = np.argsort(self.prefix, kind="stable")
        self.seen = Seen(self.prefix)
        self.first = np.searchsorted(self.prefix[self.by], self.seen.keys, "left")
        self.last = np.searchsorted(self.prefix[self.by], self.seen.keys, "right")

    def occurrences(self, data: bytes, s: np.ndarray, e: np.ndarray, h: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and windows of all occurrences; doc and ends say which words belong to which text."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.unique(self.k).tolist():
            at, number = self.seen.find(shingles(h, k))
            n = self.last[number] - self.first[number]
            at, number = np.repeat(at, n), np.repeat(number, n)
            w = self.by[self.first[number] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
            begin = at - self.offset[w]
            ok = (self.k[w] == k) & (begin >= ends[doc[at]]) & (begin + self.size[w] <= ends[doc[at] + 1])  # positional and length bounds
            begin, w = begin[ok], w[ok]
            for a, x in zip(begin.tolist(), w.tolist(), strict=True):
                n = int(self.size[x])
                if np.array_equal(h[a : a + n], self.hash[x]) and all(data[i:j] == y for i, j, y in zip(s[a : a + n].tolist(), e[a : a + n].tolist(), self.text[x], strict=True)):
                    starts.append(np.array([a]))
                    found.append(np.array([x]))
        return np.concatenate(starts), np.concatenate(found)


def windows_of(items: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE) -> Windows:
    by: dict[tuple[bytes, ...], list[str]] = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            held = by.setdefault(tuple(own[i : i + window]), [])
            if not held or held[-1] != item:
                held.append(item)
    return Windows([list(w) for w in by], list(by.values()), shingle)


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most so many bytes of text, or of one longer item, read a partition at a time."""
    held: list[tuple[str, str]] = []
    size = 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null").toLocalIterator():
        if held and size + len(r["t"]) > most:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"])
    if held:
        yield held


def counted(docs: DataFrame, text: str, keys: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """How often each of a block's shingles occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(shared.value)
        n = np.zeros(len(seen.keys), np.int64)
        for batch in gathered(it):
            raw, offsets = apart(*as_bytes(batch.column("t")))
            s, _, h = words_of(raw, ALNUM)
            doc = np.searchsorted(offsets, s, "right")
            for k in sizes:
                at, number = seen.find(shingles(h, k))
                n += np.bincount(number[doc[at] == doc[at + k - 1]], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys[some].view(np.int64)), pa.array(n[some])], ["key", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # a block's shingles at most
    return {r["key"] & (1 << 64) - 1: r["n"] for r in rows}


def judged(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, column: str = "decontam") -> DataFrame:
    """The rows with a struct column of n_words, n_hit and items, the ids of items with occurring windows."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    out = docs.withColumn(column, F.lit(None).cast(STATE))
    none = True
    for block in blocks(benchmark, item, item_text, block_words * 4):
        index = windows_of(block, window, shingle)
        if not index.text:
            continue
        index.order(counted(docs, text, index.all_shingles(), np.unique(index.k).tolist()))
        out = out.withColumn(column, _finder(spark, index)(F.col(text), F.col(column)))
        none = False
    if none:
        out = out.withColumn(column, _finder(spark, None)(F.col(text), F.col(column)))
    return out


def _finder(spark, index: Windows | None):
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(STATE)
    def find(texts: pa.Array, before: pa.Array) -> pa.Array:
        index, old = shared.value, before.to_pylist()
        out: list[dict] = []
        raw, offsets = as_bytes(texts)
        for i, j in slices(np.diff(offsets), STEP):
            part, ends = apart(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            s, e, h = words_of(part, ALNUM)
            bound = np.searchsorted(s, ends)
            doc = np.searchsorted(bound, np.arange(len(s)), "right") - 1
            hit = np.zeros(len(s) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(j - i)]
            if index is not None and len(s):
                first, found = index.occurrences(part.tobytes().lower(), s, e, h, doc, bound)
                np.add.at(hit, first, 1)
                np.add.at(hit, first + index.size[found], -1)
                for a, w in zip(doc[first].tolist(), found.tolist(), strict=True):
                    items[a].update(index.items[w])
            for a in range(j - i):
                for x, y in zip(*[iter((old[i + a] or {}).get("hit") or [])] * 2, strict=True):
                    hit[bound[a] + x] += 1
                    hit[bound[a] + y] -= 1
            on = np.cumsum(hit)[:-1] > 0
            for a in range(j - i):
                own = on[bound[a] : bound[a + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))  # starts and ends in turn
                out.append({"n_words": len(own), "n_hit": int(own.sum()), "items": sorted(items[a] | set((old[i + a] or {}).get("items") or [])), "hit": edge.tolist()})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit", pa.list_(pa.int64()))]))

    return find.asNondeterministic()


def contaminated(column: str = "decontam"):
    """At least one word in twenty is hit."""
    return (F.col(f"{column}.n_hit") > 0) & (20 * F.col(f"{column}.n_hit") >= F.col(f"{column}.n_words"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows that aren't contaminated, with their own columns only."""
    mark = free_name(docs, "_ratelens_decontam")
    return judged(docs, benchmark, text, column=mark).filter(~contaminated(mark)).select(*[F.col(f"`{c}`") for c in docs.columns])
