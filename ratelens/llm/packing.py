"""Cost-balanced packing of documents into token sequences of bounded length.

A document's cost in a sequence is estimated as ``linear * tokens + quadratic * tokens ** 2``: the layers
that grow with its tokens, and attention within it. Whole pieces of ``capacity`` tokens fill a sequence
each and are numbered where they are; what remains of every document is dealt, by a hash of document, place
and row, into shards of about ``shard_tokens`` tokens, so that a row that repeats makes no hot shard, and
every shard is packed by itself: pieces in descending order of cost, each to the sequence of lowest cost
among those with room for it. A shard starts with as many sequences as its tokens need; a piece for which
none has room opens another. Pieces of a shard are ordered by cost, id and start.

Tokens are counted where the text is: only (id, start, length, checksum) leave the tokenizer. Shards are
of bounded size at any scale; packing them takes one shuffle of these few numbers.

Tokenization is exact but remembered: each distinct run between white space is encoded once by a worker. Runs
are found by a 64-bit hash, and their bytes compared; a text with a run that only shares its hash with another
is encoded whole.

Defined results: a null or empty text has the end token only, one piece of length 1. Rows that repeat a
doc_id are packed as separate documents with pieces of their own. Very long texts are cut into as many
pieces as they need. Other columns don't matter.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import NONSPACE, apart, as_bytes, distinct, gathered, same_bytes, small_batches, words_of, written

CAPACITY = 4096
SHARD_TOKENS = 2_000_000
END = 2
#: Sequences of whole pieces are numbered from here, above those of all shards.
WHOLE = 1 << 62


class WordTokenizer:
    """ids of whole texts by a tokenizers file that drops white space and lower-cases.

    Text is cut at ASCII white space, at which such a tokenizer always cuts, and A-Z lower-cased; each
    distinct run is encoded once and remembered, with its bytes, while there is room. A run of plain
    letters, with or without signs after it, is encoded by the tokenizer's model alone, any other run by the
    whole tokenizer. A text that may hold special tokens goes whole to the tokenizer.
    """

    #: Lower-case letters that the tokenizer's normaliser leaves as they are, and then signs.
    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,:;!?|%&$#*]*)")

    def __init__(self, path: str, room: int = 3_000_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.signs: dict[str, list[int]] = {"": []}
        self.room = room
        self.forget()
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = str.maketrans({chr(b): chr(c) for b, c in [*zip(plain, plain, strict=True), *((b, 256 + i) for i, b in enumerate(rest))]})

    def forget(self) -> None:
        self.keys, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.from_, self.to, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def run(self, raw: bytes) -> list[int]:
        if raw.isalpha():  # ASCII letters only
            return [t.id for t in self.model.tokenize(raw.decode())]
        text = raw.decode("utf-8", "replace")
        m = self.PLAIN.fullmatch(text)
        if m is None:
            return self.whole(text)
        word = m[1] if m[1].isascii() else m[1].encode().decode("latin-1").translate(self.alphabet)
        signs = self.signs.get(m[2])
        if signs is None:
            signs = self.whole(m[2])
            if len(self.signs) < 10_000:
                self.signs[m[2]] = signs
        return [t.id for t in self.model.tokenize(word)] + signs

    def remember(self, keys: np.ndarray, runs: list[bytes]) -> None:
        ids = [self.run(r) for r in runs]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        start = (len(self.flat) + np.cumsum(size) - size).astype(np.int32)
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size)
        to = len(self.bytes) + np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        self.from_, self.to = np.insert(self.from_, at, to - [len(r) for r in runs]), np.insert(self.to, at, to)
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(runs), np.uint8)])

    def encode_all(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit numbers."""
        spaced, ends = apart(raw, offsets)
        n = len(offsets) - 1
        data = spaced.tobytes()
        s, e, h = words_of(spaced, NONSPACE)
        keys, first, number = distinct(h)
        if len(self.keys) + len(keys) > self.room:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(at == len(self.keys)) if not len(self.keys) else np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys)
        if len(new):
            self.remember(keys[new], [data[a:b].lower() for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        # bytes of runs against those remembered, and against the first of their hash in this text
        low = LOWER_BYTES[spaced]
        s1, e1 = s[first], e[first]
        same = same_bytes(low, s1, e1, self.bytes, self.from_[at], self.to[at])[number]
        for a in range(0, len(s), 1 << 16):
            part = slice(a, a + (1 << 16))
            same[part] &= same_bytes(low, s[part], e[part], low, s1[number[part]], e1[number[part]])
        size, start = self.size[at][number].astype(np.int64), self.start[at][number].astype(np.int64)
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
        word = np.searchsorted(s, ends)  # the first word of each text
        out = [ids[to[a] : to[b]] for a, b in zip(word[:-1].tolist(), word[1:].tolist(), strict=True)]
        unlike = np.bincount(np.searchsorted(ends, s[~same], "right") - 1, minlength=n) > 0
        if b"<|" in data or unlike.any():
            for i in range(n):
                text = data[ends[i] : ends[i + 1] - 1]
                if b"<|" in text or unlike[i]:
                    out[i] = np.array(self.whole(text.decode("utf-8", "replace")), np.uint32)
        return out

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0]


#: Bytes with A-Z in lower case.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One a worker, kept from task to task with what it remembers."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, part, start, length, ids_crc32, doc_tokens of each document's pieces of at most capacity tokens."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        for batch in gathered(it):
            out: list[tuple] = []
            for k, ids in zip(batch.column("k").to_pylist(), tok.encode_all(*as_bytes(batch.column("t"))), strict=True):
                raw, n = ids.astype("<u4").tobytes() + END.to_bytes(4, "little"), len(ids) + 1
                out += [(k, a, min(capacity, n - a), zlib.crc32(raw[4 * a : 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(cut, schema)


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces in descending order of length.

    Open sequences lie in a heap by cost. Those without room for a piece are set aside: later pieces are
    no longer than this one, so they go back only when the length falls to their room.
    """
    n = max(1, -(-int(lengths.sum()) // capacity))
    heap = [(0.0, s) for s in range(n)]
    used = [0] * n
    aside: list[tuple[int, int, float]] = []  # by most room first
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        while aside and -aside[0][0] >= size:
            _, s, c = heapq.heappop(aside)
            heapq.heappush(heap, (c, s))
        while heap and capacity - used[heap[0][1]] < size:
            c, s = heapq.heappop(heap)
            if used[s] < capacity:
                heapq.heappush(aside, (used[s] - capacity, s, c))
        if heap:
            c, s = heapq.heappop(heap)
        else:
            c, s = 0.0, len(used)
            used.append(0)
        seq[i], off[i] = s, used[s]
        used[s] += size
        heapq.heappush(heap, (c + linear * size + quadratic * size * size, s))
    return seq, off


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 4096, shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost."""
    parts = pieces(docs, key, text, capacity, tokenizer).withColumn("piece", F.monotonically_increasing_id())
    parts = written(parts, "pieces")
    rest = parts.filter(F.col("length") < capacity)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        seq, off = assign(rows["length"].to_numpy(np.int64), capacity, linear, quadratic)
        return rows.assign(sequence_id=rows["shard"] * (1 << 32) + seq, offset=off)[[c.split()[0] for c in schema.split(", ")]]

    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "piece"), F.lit(shards))).drop("piece")
    whole = parts.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("piece") + F.lit(WHOLE), "offset": F.lit(0).cast("long")}).drop("piece")
    out = dealt.groupBy("shard").applyInPandas(pack, schema).unionByName(whole)
    cost = F.lit(linear) * F.col("length") + F.lit(quadratic) * F.col("length") * F.col("length")
    return out.withColumn("cost", cost.cast("double"))
