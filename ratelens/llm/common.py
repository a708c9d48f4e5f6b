"""Pieces shared by the operators: work tables, samples, and the byte-level word kernel.

Work tables cut lineage: they are Parquet files under ``spark.checkpoint.dir``, which every
executor and the driver can read, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


# --- work tables ------------------------------------------------------------------------


def work_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where it is unset, as in tests, a folder of our own in a local session; an error on a cluster, whose executors couldn't read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/ratelens-work"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/ratelens-{spark.sparkContext.applicationId}"


#: For tables of few large values that are compressed already. Parquet looks at the size of a page after each hundred rows
#: only, and a codec keeps direct buffers of the largest page, in and out, until a full collection.
LARGE_VALUES = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet work table, read back with its known schema."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_work_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch of whole texts holds, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


# --- columns ----------------------------------------------------------------------------


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def fold(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the contract's folds. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def sample_at_most(df: DataFrame, key: str, n: int, total: int, seed: int = 7) -> DataFrame:
    """About n of total rows, chosen by a hash of the key, so that partitioning doesn't matter.

    Everything is taken where total <= n. The expectation is 0.9 n; the chance of more than n rows
    falls exponentially in n, and callers cut the rest off after collecting.
    """
    if total <= n:
        return df
    cut = int(0.9 * n / total * (1 << 32))
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 32))
    return df.filter(h < cut)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores after it where the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- bytes of Arrow strings -------------------------------------------------------------


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and n + 1 offsets; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of consecutive texts with at most so many bytes, or of one longer text."""
    i, n = 0, len(lengths)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, j
        i = j


# --- numbers in rows --------------------------------------------------------------------


def pack(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, kind: str = "<u8") -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], size * n, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


# --- hashes -----------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _drawn(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A number for each byte at each place of a word, drawn as if at random."""
    return mix(mix(place.astype(np.uint64) * np.uint64(_P) + np.uint64(1)) + byte.astype(np.uint64) * _M1)


#: The numbers of a word's first places, looked up instead of drawn again.
_PLACES = 64
_FIRST = _drawn(np.arange(_PLACES * 256) >> 8, np.arange(_PLACES * 256) & 255)


def word_table(pattern_bytes: bytes, lower: bool = True) -> np.ndarray:
    """A map of bytes: 0 for what separates words, else the byte, A-Z lower-cased."""
    table = np.zeros(256, np.uint8)
    for b in pattern_bytes:
        table[b] = b + 32 if lower and 65 <= b <= 90 else b
    return table


#: Words of letters and digits: [0-9a-zA-Z] and every byte of a character past ASCII.
ALNUM = word_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: Words between ASCII white space: all bytes but \x20 and \x09-\x0D. A zero byte becomes 0xFF, which UTF-8 never holds.
NONSPACE = word_table(bytes(b for b in range(256) if b != 32 and not 9 <= b <= 13))
NONSPACE[0] = 255


def words_of(raw: np.ndarray, table: np.ndarray, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word among raw bytes, in order.

    The caller puts a separator between texts. A word's hash depends on its mapped bytes only: it is the
    sum of numbers drawn for each byte at its place, so no repetition or symmetry of a word makes hashes
    meet, as it does for powers of a base. Work arrays hold one step, cut between words.
    """
    starts, ends, hashes = [], [], []
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + step)
        part = table[raw[at:to]]
        if to < n:
            gaps = np.flatnonzero(part == 0)
            if len(gaps) and gaps[-1] > 0:
                to = at + int(gaps[-1])
                part = part[: to - at]
            else:  # one word fills the step
                step *= 2
                continue
        inside = np.concatenate([[0], (part != 0).view(np.int8), [0]])
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            size = e - s
            own = part[part != 0]
            first = np.cumsum(size) - size
            place = np.arange(len(own)) - np.repeat(first, size)
            number = _FIRST[(np.minimum(place, _PLACES - 1) << 8) + own]
            late = np.flatnonzero(place >= _PLACES)
            number[late] = _drawn(place[late], own[late])
            hashes.append(mix(np.add.reduceat(number, first) + size.astype(np.uint64) * _M2))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def same_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether the bytes raw[start:end] of each word are other[at:to], whole."""
    size = end - start
    ok = size == to - at
    live = np.flatnonzero(ok)
    if len(live):
        n = size[live]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = raw[np.repeat(start[live], n) + step] == other[np.repeat(at[live], n) + step]
        ok[live] = np.logical_and.reduceat(np.append(equal, True), first) & (n > 0) | (n == 0)
    return ok


def apart(raw: np.ndarray, offsets: np.ndarray, gap: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of several texts with one separator after each, and their new offsets."""
    n = len(offsets) - 1
    ends = offsets + np.arange(n + 1)
    out, own = np.full(len(raw) + n, gap, np.uint8), np.ones(len(raw) + n, bool)
    own[ends[1:] - 1] = False
    out[own] = raw
    return out, ends


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes, a place of each, and each element's number among them.

    One sort of the hashes' upper bits with the place in the lower ones; np.unique where upper bits clash.
    """
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << n.bit_length()) - 1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    key.sort()
    at = (key & low).astype(np.int64)
    hs = h[at]
    new = np.concatenate([[True], hs[1:] != hs[:-1]])
    top = key & ~low
    if np.any(new[1:] & (top[1:] == top[:-1])):
        u, first, number = np.unique(h, return_index=True, return_inverse=True)
        return u, first.astype(np.int64), number.astype(np.int64)
    number = np.empty(n, np.int64)
    number[at] = np.cumsum(new) - 1
    return hs[new], at[new], number


def gathered(batches: Iterator[pa.RecordBatch], column: str = "t", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of the text column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_P) + h[j : j + n]
    return mix(out + np.uint64(k))
