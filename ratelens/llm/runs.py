"""Periodic runs of words: every stretch that repeats with a period and that no neighbour extends.

The method is Kolpakov and Kucherov's. A suffix automaton of a document's words, whose states know the first place
where their words end, cuts the document into Lempel-Ziv factors: the longest that have begun before, or one new
word. At each border between factors Main's algorithm finds the runs that touch it: common extensions to both
sides of the border, for every period at once, come from four prefix functions over the factor and a stretch before
it no longer than it and twice the factor before. A run that touches no border lies within one factor, so it is a
copy of one in that factor's earlier occurrence, and is copied from there. All is linear in the words but for the sorted
list of found runs.

Two exact bounds come before. A run of ``least`` words or more repeats a stretch of half that, so words that no
repeated gram of ``least / 2`` words covers lie in no run; grams are counted over a batch of documents at once, and each
stretch of covered words is worked on by itself. And borders whose two factors are too short to carry a run of
``least`` words are passed over. Both only leave out what has no run.

A document is worked on whole by one task, in memory linear in its words; documents don't meet, so there is no
shuffle, and a lost executor costs only the tasks it was running.

Defined results: a null or empty text has no words, no runs, and the digest of an empty text twice. A null id counts
as an empty text in the checksum. Empty tables give no rows. Rows that repeat give a row each. Of several longest
runs the one that starts first counts, of those the one of the smallest period. Very long texts are read whole.
Columns besides the key and the text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import distinct, gathered, mix, small_batches

LEAST = 12
Run = tuple[int, int, int]  # start, end (exclusive), period


class Automaton:
    """The suffix automaton of a list of numbers, with the first place where each state's words end.

    Most states lead on by one word only: that word and its target lie in arrays, further ones in dicts.
    """

    def __init__(self, words: list[int]) -> None:
        n = len(words)
        self.sym, self.to = array("q", [-1]) * (2 * n + 2), array("i", [0]) * (2 * n + 2)
        self.more: dict[int, dict[int, int]] = {}
        self.size, self.link, self.first = array("i", [0]) * (2 * n + 2), array("i", [-1]) * (2 * n + 2), array("i", [-1]) * (2 * n + 2)
        self.states, self.last = 1, 0
        for place, c in enumerate(words):
            self._extend(c, place)

    def step(self, s: int, c: int) -> int:
        """Where the word leads from a state, or -1."""
        if self.sym[s] == c:
            return self.to[s]
        m = self.more.get(s)
        return -1 if m is None else m.get(c, -1)

    def _lead(self, s: int, c: int, to: int) -> None:
        if self.sym[s] == c or self.sym[s] < 0:
            self.sym[s], self.to[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _extend(self, c: int, place: int) -> None:
        size, link, step, lead = self.size, self.link, self.step, self._lead
        cur = self.states
        self.states += 1
        size[cur], self.first[cur] = size[self.last] + 1, place
        p = self.last
        while p >= 0 and step(p, c) < 0:
            lead(p, c, cur)
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = step(p, c)
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = self.states
                self.states += 1
                size[twin], link[twin], self.first[twin] = size[p] + 1, link[q], self.first[q]
                self.sym[twin], self.to[twin] = self.sym[q], self.to[q]
                if q in self.more:
                    self.more[twin] = dict(self.more[q])
                while p >= 0 and step(p, c) == q:
                    lead(p, c, twin)
                    p = link[p]
                link[q] = link[cur] = twin
        self.last = cur


def factors(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1) of each factor: the longest that has begun before, or one new word."""
    held, i, n = Automaton(words), 0, len(words)
    first, step = held.first, held.step
    while i < n:
        s, j = 0, i
        while j < n:
            t = step(s, words[j])
            if t < 0 or first[t] >= j:  # its first occurrence is this one
                break
            s, j = t, j + 1
        if j == i:
            yield i, i + 1, -1
            i += 1
        else:
            yield i, j, first[s] - (j - i) + 1
            i = j


def prefixes(x: list[int]) -> list[int]:
    """For each place, how many words from there on equal the list's own beginning."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    a = b = 0
    for i in range(1, n):
        k = min(z[i - a], b - i) if i < b else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def touching(words: list[int], low: int, at: int, high: int) -> Iterator[Run]:
    """Repetitions within words[low:high] that touch the border before words[at]; those that go on beyond are given cut off."""
    left, right = words[low:at], words[at:high]
    m, n = len(left), len(right)
    back = left[::-1]
    # to the right: words[at:] against themselves a period later
    ahead = prefixes(right)
    behind = prefixes([*back, -1, *right[::-1], *back])  # at m + 1 + n - q: what ends before the border against what ends a period after it
    for q in range(1, n + 1):
        f, b = ahead[q] if q < n else 0, min(behind[m + 1 + n - q], m)
        if f + b >= q:
            yield at - b, at + q + f, q
    # to the left: what ends before the border against itself a period earlier
    ahead = prefixes([*right, -1, *left, *right])
    behind = prefixes(back)
    for q in range(1, m + 1):
        f, b = min(ahead[n + 1 + m - q], n), behind[q] if q < m else 0
        if f + b >= q:
            yield at - q - b, at + f, q


def maximal_runs(words: list[int], least: int = LEAST) -> list[Run]:
    """All runs of at least so many words and two periods, in order of start and period; words are numbers from 0."""
    n = len(words)
    found: list[tuple[int, int, int]] = []
    ends: set[tuple[int, int]] = set()
    before = 0  # start of the factor before

    def border(at: int, a: int, high: int) -> None:
        """Runs that touch the border before words[at], with the factor before it starting at a."""
        right = high - at
        if 2 * (at - a) + 2 * right < least:
            return
        own: dict[tuple[int, int], int] = {}
        for s, e, q in touching(words, max(0, at - 2 * (at - a) - right), at, high):
            if e - s >= least and (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == n or words[e] != words[e - q]):
                own[s, e] = min(q, own.get((s, e), q))
        for (s, e), q in own.items():
            if (s, e) not in ends:
                ends.add((s, e))
                insort(found, (s, e, q))

    for start, end, source in factors(words):
        if start:
            border(start, before, end)
        if source >= 0 and end - start > least:
            # runs strictly inside: those strictly inside the earlier occurrence, also where it reaches into this factor
            shift = start - source
            i = bisect_left(found, (source + 1,))
            while i < len(found) and found[i][0] < end - shift - least:
                s, e, q = found[i]
                if e < end - shift and (s + shift, e + shift) not in ends:
                    ends.add((s + shift, e + shift))
                    insort(found, (s + shift, e + shift, q))
                i += 1
        before = start
    if n:
        border(n, before, n)
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """[i, j) of words that grams repeated within their document cover, of at least so many words, never across documents."""
    k = least // 2
    n = len(ids) - k + 1
    if n < 2:
        return
    h = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        h = mix(h + ids[j : j + n].astype(np.uint64))
    h[doc[:n] != doc[k - 1 :]] = 0
    keys, _, number = distinct(h)
    more = (np.bincount(number, minlength=len(keys)) > 1)[number] & (doc[:n] == doc[k - 1 :])
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += more
    edge[k : k + n] -= more
    inside = np.cumsum(edge)[:-1] > 0
    new = np.concatenate([[True], (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(ids))
    keep = inside[at] & (to - at >= least)
    yield from zip(at[keep].tolist(), to[keep].tolist(), strict=True)


def batch_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each list of words."""
    number: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    total = sum(sizes)
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    out: list[list[Run]] = [[] for _ in texts]
    for i, j in stretches(ids, doc, least):
        own = int(doc[i])
        shift = i - int(first[own])
        out[own] += [(s + shift, e + shift, q) for s, e, q in maximal_runs(ids[i:j].tolist(), least)]
    return out


def repeated(words: list[bytes], h: int) -> list[bytes]:
    """The words of a document whose checksum asks for it, with all words from a place on repeated with a period."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    base = words[a : a + p]
    return words[:a] + (base * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        edge[s + q] += 1
        edge[e] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, perturb: bool = True, keep_text: bool = False) -> DataFrame:
    """The key and, of each whole text, its runs: count, the longest one, and digests of all runs and of the collapsed text.

    ``perturb`` repeats words of one document in ten first, by its id's checksum. ``keep_text`` adds the
    collapsed text itself.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).alias("t"), F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("h"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, {SCHEMA}" + (", collapsed string" if keep_text else "")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(it):
            texts = [(t or "").encode("utf-8", "replace").split() for t in batch.column("t").to_pylist()]
            if perturb:
                texts = [repeated(w, h) for w, h in zip(texts, batch.column("h").to_pylist(), strict=True)]
            out: list[tuple] = []
            for words, runs in zip(texts, batch_runs(texts, least), strict=True):
                longest = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
                s, e, q = longest or (None, None, None)
                size = None if longest is None else e - s
                left = b" ".join(collapsed(words, runs))
                listed = "".join(f"{a},{b - a},{p}\n" for a, b, p in runs)
                row = (len(runs), s, size, q, None if longest is None else 1000 * size // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
                out.append((*row, left.decode("utf-8", "replace")) if keep_text else row)
            kinds = [pa.int64()] * 5 + [pa.string()] * (3 if keep_text else 2)
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, *(c.split()[0] for c in schema.split(", ")[1:])])

    return rows.mapInArrow(work, schema)
