"""Token counts of whole texts under a byte-pair vocabulary, without making identifiers.

A word of the vocabulary's own splitting is a linked list of symbols, and a heap holds its adjacent pairs that
the vocabulary merges, by rank and then place. The lowest pair is popped, its right symbol unlinked, and the
two pairs that the merged symbol makes are pushed; pairs whose symbols have changed since are passed over. Each
merge takes one symbol away, so a word counts its symbols minus its merges. That is n log n for a word of n
bytes, also for one of millions of letters.

Text is cut at ASCII white space, at which such a vocabulary always cuts, in slices of about a megabyte; a
worker remembers the count of each short run between, in a table of bounded size. Normalising and splitting a run
that isn't plain ASCII letters is left to the library's normaliser and splitter, so that Unicode rules agree.
Special tokens count one each where their exact strings stand, as the library does by default.

Every row is counted by itself, without a shuffle, so a lost executor costs only the tasks it was running.

Defined results: a null text counts as empty, with no bytes and no tokens. Empty tables give no rows. Rows that
repeat give a row each, in any order. Very long texts are read whole, slice by slice. Columns besides the key
and the text don't matter, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import small_batches

#: Runs up to so many bytes are remembered, and so many runs.
MEMO_BYTES, MEMO_RUNS = 64, 1_000_000
SLICE = 1 << 20
#: Bits of a place within a word, below the rank in a heap's entries.
PLACE = 40


class MergeCounter:
    """Counts tokens with the merges of a tokenizers file of kind BPE."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = held["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        if model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("only vocabularies whose symbols are all known, and whose words are always merged, can be counted")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left << 20 | right) to (rank << 20 | merged).
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in held["added_tokens"]]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)).encode()) if special else None
        self.memo: dict[bytes, int] = {}

    def word(self, chars: str) -> int:
        """Tokens of one word of the byte alphabet: its symbols minus the merges among them."""
        ids = [self.vocab[c] for c in chars[:-1]] + [self.vocab[chars[-1] + self.end]]
        n = len(ids)
        merges = self.merges
        heap = []
        for i in range(n - 1):
            m = merges.get(ids[i] << 20 | ids[i + 1])
            if m is not None:
                heap.append(m >> 20 << PLACE | i)
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = heappop(heap)
            i = top & ((1 << PLACE) - 1)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = merges.get(ids[i] << 20 | ids[j])
            if m is None or m >> 20 != top >> PLACE:  # one of the two symbols has changed since
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get(ids[i] << 20 | ids[k])
                if m is not None:
                    heappush(heap, m >> 20 << PLACE | i)
            h = before[i]
            if h >= 0:
                m = merges.get(ids[h] << 20 | ids[i])
                if m is not None:
                    heappush(heap, m >> 20 << PLACE | h)
        return left

    def run(self, raw: bytes) -> int:
        """Tokens of a run between white space, its A-Z in lower case already."""
        if raw.isalpha():  # ASCII letters only
            return self.word(raw.decode())
        return sum(self.word(w) for w, _ in self.split(self.normal(raw.decode("utf-8", "replace"))))

    def plain(self, raw: bytes) -> int:
        """Tokens of text in which special tokens are text like any other."""
        total, memo = 0, self.memo
        for part in sliced(raw):
            for r, k in Counter(part.lower().split()).items():
                n = memo.get(r)
                if n is None:
                    n = self.run(r)
                    if len(r) <= MEMO_BYTES:
                        if len(memo) >= MEMO_RUNS:
                            memo.clear()
                        memo[r] = n
                total += n * k
        return total

    def count(self, text: str | None) -> int:
        raw = (text or "").encode("utf-8", "replace")
        if self.special is None or self.special.search(raw) is None:
            return self.plain(raw)
        total, at = 0, 0
        for m in self.special.finditer(raw):
            total += self.plain(raw[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(raw[at:])


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def sliced(raw: bytes, step: int = SLICE) -> Iterator[bytes]:
    """Slices of about so many bytes, cut at white space; a longer run stays whole."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + step)
        to = gap.start() if gap else len(raw)
        yield raw[at:to]
        at = to


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One a worker, kept from task to task with what it remembers."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_count(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> Column:
    """A column of the number of tokens of each text."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    @F.arrow_udf("long")
    def count(t: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array([own.count(x.as_py()) for x in t], pa.int64())

    return count.asNondeterministic()(F.col(text))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """The key, n_bytes, n_tokens and over_limit (more tokens than the limit) of each row."""
    rows = docs.select(F.col(key), F.col(text).alias("t"))
    rows = rows.select(key, F.octet_length(F.coalesce("t", F.lit(""))).cast("long").alias("n_bytes"), token_count(rows, "t", tokenizer).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
