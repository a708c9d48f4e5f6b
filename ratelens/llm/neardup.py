"""MinHash near-dedup with ProbMinHash signatures, banding and verification.

A document is the weighted set of its shingles of five words (a text of fewer words is one shingle). In a
ProbMinHash signature every shingle is a Poisson process whose rate is its weight: its arrivals, made from
the shingle's hash alone, each fall on one of the signature's components, which keeps the first arrival of
all. Two documents agree in a component with a probability equal to the probability Jaccard similarity of
their weighted sets. Shingles whose next arrival comes later than every component's first are done, so few
arrivals are made. With weights of one, the default, probability Jaccard is plain Jaccard, which is what is
verified; by counts, texts that differ in how often they repeat a passage would seldom share a band.

Rows are numbered and written with their sketches; nothing is looked up by doc_id. Texts with equal words, by a
128-bit digest of them, are one class member before anything else. Signatures are banded; in each bucket
every member is compared with the bucket's least member, and links of similarity ``threshold`` or more
are verified on the exact shingle sets. Classes are the connected components of the links. Buckets that
still hold several components are taken further, so that no link in a bucket is lost. One of up to ``BLOCK``
members is compared by a product of its shingle matrix with itself, which gives one link for any two components that
have one. Members of larger ones are dealt into finer buckets by their rarer shingles, of which two members with
a link have one in common, and compared with each finer bucket's least member; what shares wording that many have is
parted so. A finer bucket that still holds several components is dealt by a hash into blocks, which are compared with each
other: (n / BLOCK) squared products of n members that share a rare shingle. Pairs are never emitted.

Every group is handled by shuffle joins between tables that have been written, so that Spark can split hot
keys; no bucket is collected, capped or expanded into all pairs. Components are found by alternating
large-star and small-star steps over tables.

Defined results: texts without a word, null ones included, are alone, as are rows with a null doc_id.
A class holds rows, not ids: rows that repeat a doc_id are classed by their own texts. The member with the
smallest doc_id stays; of rows that repeat it, one. Very long texts are shingled whole. An empty table gives
no rows. Other columns, whatever their names, pass through ``distinct_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import ALNUM, apart, as_bytes, discard, distinct, gathered, mix, pack, pack_sorted, shingles, small_batches, unpack, unpack_sorted, words_of, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each text's distinct shingles, and the texts' numbers of words."""
    part, ends = apart(raw, offsets)
    s, _, h = words_of(part, ALNUM)
    bound = np.searchsorted(s, ends)
    n = np.diff(bound)
    doc = np.repeat(np.arange(len(n)), n)
    key = shingles(h, k)
    keep = doc[: len(key)] == doc[k - 1 : k - 1 + len(key)] if len(key) else np.zeros(0, bool)
    docs, keys = [doc[: len(key)][keep]], [key[keep]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        docs.append(np.array([i]))
        keys.append(shingles(h[bound[i] : bound[i + 1]], int(n[i])))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    both = mix(key ^ mix((doc.astype(np.uint64) + np.uint64(1)) * _GOLD))
    _, first, number = distinct(both)
    count = np.bincount(number, minlength=len(first))
    order = np.argsort(doc[first], kind="stable")
    return doc[first][order], key[first][order], count[order], n


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash signatures of n weighted sets: for each component the shingle that arrives first."""
    first = np.full(n * size, np.inf)
    winner = np.zeros(n * size, np.uint64)
    live = np.arange(len(doc))
    time = np.zeros(len(doc))
    turn = 0
    while len(live):
        turn += 1
        r = mix(key[live] + np.uint64(turn * int(_GOLD) % (1 << 64)))
        time[live] += -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[live]
        at = doc[live] * size + (mix(r) % np.uint64(size)).astype(np.int64)
        better = time[live] < first[at]
        at, own = at[better], live[better]
        np.minimum.at(first, at, time[own])
        won = first[at] == time[own]
        winner[at[won]] = key[own[won]]
        latest = first.reshape(n, size).max(1)
        live = live[time[live] < latest[doc[live]]]
    return winner.reshape(n, size)


def digests(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits of each text's words in order, one separator between them."""
    out = []
    for i in range(len(offsets) - 1):
        own = ALNUM[raw[offsets[i] : offsets[i + 1]]]
        keep = own != 0
        keep[1:] |= keep[:-1]  # a word's bytes and the one after it
        end = b"\0" if len(own) and own[-1] else b""
        out.append(blake2b(own[keep].tobytes() + end, digest_size=16).digest())
    return out


def sketched(docs: DataFrame, key: str, text: str, weights: str, bands: int, rows: int, k: int) -> DataFrame:
    """rid, doc_id, the row itself, words, a digest of the words, and the hash of each band: a written table."""
    number = docs.columns.index(text)
    whole = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    schema = T.StructType([*whole.schema.fields, T.StructField("words", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(it, column="row", most=2 << 20):
            raw, offsets = as_bytes(batch.column("row").field(number))
            n = len(offsets) - 1
            doc, key_, count, words = shingle_sets(raw, offsets, k)
            w = count.astype(np.float64) if weights == "count" else np.ones(len(count))
            sig = signatures(doc, key_, w, n, bands * rows).reshape(n, bands, rows)
            hashes = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                hashes = mix(hashes * _GOLD + sig[:, :, r])
            hashes = mix(hashes + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLD)
            flat = pa.array(hashes.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(words.astype(np.int64)), pa.array(digests(raw, offsets), pa.binary()), lists], ["doc_id", "row", "words", "digest", "bands"])

    return written(whole.mapInArrow(sketch, schema).withColumn("rid", F.monotonically_increasing_id()), "sketches")


def compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b and the exact Jaccard similarity of the shingle sets of each pair (a, b)."""

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in it:
            out = np.zeros(batch.num_rows)
            doc, key, _, _ = shingle_sets(*as_bytes(batch.column("ta")), k)
            bound = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            b_ids, b_texts = batch.column("b").to_pylist(), batch.column("tb")
            for i in range(batch.num_rows):
                if last[0] != b_ids[i] or i == 0:
                    last = (b_ids[i], np.sort(shingle_sets(*as_bytes(b_texts.slice(i, 1)), k)[1]))
                x, y = key[bound[i] : bound[i + 1]], last[1]
                if len(x) and len(y):
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    out[i] = both / (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "similarity"])

    one = texts.select(F.col("k").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("k").alias("b"), F.col("t").alias("tb"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of the connected component of each node of the links (a, b)."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large-star")
        discard(edges, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        edges = written(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large, least)
        n = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
        # stars: every node has one root, and no root has one itself
        if n["n"] == n["u"] and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classed(docs: DataFrame, key: str, text: str, threshold: float, weights: str, bands: int, rows: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The written rows, and rid, class_id and keep_rid of all that have words and an id."""
    small_batches(docs.sparkSession, 1024)
    sketch = sketched(docs, key, text, weights, bands, rows, k)
    able = sketch.filter("words > 0 and doc_id is not null")
    # of equal texts one row stands for all: the first by id
    first = able.groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("first")).select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("rep"))
    members = written(able.select("rid", "digest", "bands").join(first, "digest").select("rid", "rep", "first_id", F.when(F.col("rid") == F.col("rep"), F.col("bands")).alias("bands")), "represented")
    reps = members.filter("bands is not null")
    roots = rooted(reps.select("rep", "bands"), sketch.select(F.col("rid").alias("k"), F.col(f"row.c{docs.columns.index(text)}").alias("t")), threshold, k)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # with the roots themselves
    of = reps.join(roots.withColumnRenamed("node", "rep"), "rep").groupBy("root").agg(F.min(F.struct("first_id", "rep")).alias("keep"))
    of = roots.join(of, "root").select(F.col("node").alias("rep"), F.col("keep.first_id").alias("class_id"), F.col("keep.rep").alias("keep_rid"))
    out = members.select("rid", "rep", "first_id").join(of, "rep", "left").select("rid", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("keep_rid", "rep").alias("keep_rid"))
    return sketch, out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, weights: str = "binary", bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """doc_id, class_id and kept of each row: class_id is the least doc_id of its class, of which one row is kept."""
    sketch, out = _classed(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)) if key != text else docs.select(key), key, text, threshold, weights, bands, rows, k)
    found = sketch.select("rid", "doc_id").join(out, "rid", "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept"))


def rooted(members: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """node, root of representatives in classes of several, by verified links between those that share a band."""
    buckets = members.filter("bands is not null").select("rep", F.explode(F.array_distinct("bands")).alias("bucket"))  # a rep is one row
    centres = written(buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "centres")
    held = written(buckets.join(centres.hint("merge"), "bucket"), "buckets")  # joins with texts and bands have one plan at every size
    discard(centres)
    # texts are moved once; later joins read those that share a bucket
    texts = written(texts.join(held.select(F.col("rep").alias("k")).distinct().hint("merge"), "k", "left_semi"), "texts")
    first = written(held.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    seen = written(compared(first, texts, k), "compared")
    discard(first)
    links = seen.filter(F.col("similarity") >= threshold).select("a", "b")
    roots = components(links)
    placed = written(held.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root")), "placed")
    discard(held)
    # buckets of several components; of those with the same members, one
    of = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"), F.min("rep").alias("p"), F.max("rep").alias("q"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"))
    open_ = written(of.filter("x < y and n > 2").groupBy("n", "p", "q", "s").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("n").alias("n")), "open-buckets")
    large = open_.filter(F.col("n") > BLOCK)
    split = None if large.isEmpty() else _split(placed.join(large.select("bucket"), "bucket", "left_semi").select("rep", "root").distinct(), texts, threshold, k)
    rest = placed.join(open_.filter(F.col("n") <= BLOCK), "bucket").select("bucket", "rep", "root", F.lit(1).cast("long").alias("blocks"))
    rest = written(rest if split is None else rest.unionByName(split[1]), "open-members")
    discard(placed, open_)
    again = written(rest.join(texts.withColumnRenamed("k", "rep").hint("merge"), "rep").select("bucket", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), "rep", "root", "t"), "open-texts")
    shards = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocked = written(again.repartition(shards, "bucket", "block").sortWithinPartitions("bucket", "block", "rep").mapInArrow(_blocks(k, threshold), BLOCK_SCHEMA), "blocks")
    discard(rest, again, texts)
    own = blocked.filter("a is not null").select("a", "b")
    across = _block_pairs(blocked.filter("a is null").select("bucket", "block", "payload")).mapInArrow(_across(threshold), "a long, b long")
    more = written((own.unionByName(across) if split is None else own.unionByName(across).unionByName(split[0])).distinct(), "more-links")  # between roots
    discard(blocked, *(split or ()))
    if more.isEmpty():
        return roots
    upper = components(more)
    lower = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return lower.unionByName(upper)


#: Counters of how often shingles occur, by the upper bits of their hashes.
SLOT_BITS = 16


def _frequencies(members: DataFrame, texts: DataFrame, k: int) -> np.ndarray:
    """For each slot the bits of how many shingles of members fall on it: 2 ** SLOT_BITS numbers, whatever the members.

    Wording that many members share stands out of what falls on a slot by chance.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in it:
            key = shingle_sets(*as_bytes(batch.column("t")), k)[1]
            n += np.bincount((key >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    rows = members.join(texts.withColumnRenamed("k", "rep"), "rep").select("t").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for r in rows:
        out[r["slot"]] = int(r["n"]).bit_length()
    return out


def _prefixes(members: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """rep, root, key, early: of each member the first shingles, of which two members with a link have one in common.

    Of n shingles these are n - ceil(t n) + 1, in one order for all: by how often shingles of their slot occur, then by hash.
    The first that two have in common is early, among the first n - ceil(2 t n / (1 + t)) + 1, for the smaller of the two sets.
    """
    often = _frequencies(members, texts, k)

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            doc, key, _, _ = shingle_sets(*as_bytes(batch.column("t")), k)
            order = np.lexsort((key, often[(key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], doc))
            size = np.bincount(doc, minlength=batch.num_rows)
            own = doc[order]
            place = np.arange(len(own)) - (np.cumsum(size) - size)[own]
            upto = lambda share: size - np.ceil(size * share - 1e-9).astype(np.int64) + 1
            keep = place < upto(threshold)[own]
            early = place[keep] < upto(2 * threshold / (1 + threshold))[own[keep]]
            who = pa.array(own[keep])
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(who), batch.column("root").take(who), pa.array(key[order][keep].view(np.int64)), pa.array(early)], ["rep", "root", "key", "early"])

    whole = members.join(texts.withColumnRenamed("k", "rep"), "rep").select("rep", "root", "t")
    return written(whole.mapInArrow(keys, "rep long, root long, key long, early boolean"), "prefixes")


def _split(members: DataFrame, texts: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Large open buckets by rare shingles: links (a, b) between roots, and bucket, rep, root, blocks of what is open still.

    Every link of two members is between some that hold one of both's rarest shingles, so members are dealt into a
    bucket for each of these; its members are compared with the least of them, and only buckets that hold several
    components after that go on to be compared by blocks.
    """
    members = written(members, "large-members")
    # their texts are moved once; what follows joins no other texts
    texts = written(texts.join(members.select(F.col("rep").alias("k")).distinct(), "k", "left_semi"), "large-texts")
    prefix = _prefixes(members, texts, threshold, k)
    heads = prefix.groupBy("key").agg(F.min("rep").alias("centre"), F.min("root").alias("x"), F.max("root").alias("y"), F.max("early").alias("early")).filter("x < y and early").select("key", "centre")
    sub = written(prefix.drop("early").join(heads, "key"), "rare-buckets")
    discard(prefix)
    pairs = written(sub.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), "rare-pairs")
    hits = compared(pairs, texts, k).filter(F.col("similarity") >= threshold).select("a", "b")
    of = lambda c: members.select(F.col("rep").alias(c), F.col("root").alias(f"{c}_root"))
    links = hits.join(of("a"), "a").join(of("b"), "b").filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    links = written(links, "rare-links")
    discard(pairs, members, texts)
    if not links.isEmpty():
        tops = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = written(sub.join(tops, "root", "left").select("key", "rep", F.coalesce("top", "root").alias("root")), "rare-placed")
        discard(sub)
        sub = now
    of = sub.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"), F.min("rep").alias("p"), F.max("rep").alias("q"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"))
    open_ = of.filter("x < y and n > 2").groupBy("n", "p", "q", "s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    rest = written(sub.join(open_, "key").select(F.col("key").alias("bucket"), "rep", "root", "blocks"), "rare-open")
    discard(sub)
    return links, rest


#: Documents compared at once in a bucket with several components, and columns of one product of matrices.
BLOCK, COLUMNS = 256, 16_384
BLOCK_SCHEMA = "bucket long, block long, payload binary, a long, b long"


class Sets:
    """Shingle sets of some documents, with the component each is in."""

    def __init__(self, ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> None:
        self.ids, self.roots, self.sizes, self.keys = ids, roots, sizes, keys
        self.doc = np.repeat(np.arange(len(ids)), sizes)

    def pack(self) -> bytes:
        """Each distinct shingle once, and the documents' shingles as places among these: members of a bucket share many."""
        names, place = np.unique(self.keys, return_inverse=True)
        place = place[np.lexsort((place, self.doc))]
        parts = pack(np.concatenate([self.ids, self.roots, self.sizes]).view(np.uint64)), pack_sorted(names), pack(np.diff(place, prepend=0), "<i4")
        return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)

    @classmethod
    def unpack(cls, raw: bytes) -> Sets:
        ends = 24 + np.cumsum(np.frombuffer(raw, np.int64, 3))
        ids, roots, sizes = unpack(raw[24 : ends[0]]).view(np.int64).reshape(3, -1)
        place = np.cumsum(unpack(raw[ends[1] : ends[2]], "<i4"), dtype=np.int64)
        return cls(ids, roots, sizes, unpack_sorted(raw[ends[0] : ends[1]])[place])


def cross_links(one: Sets, two: Sets, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots (a, b) of each two components that have a link between a document of one and one of two."""
    if one.roots.min() == one.roots.max() == two.roots.min() == two.roots.max():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.intersect1d(one.keys, two.keys)
    both = np.zeros((len(one.ids), len(two.ids)), np.float64)
    x, y = np.searchsorted(known, one.keys), np.searchsorted(known, two.keys)
    in_x, in_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
    if len(known):
        in_x, in_y = known[np.minimum(x, len(known) - 1)] == one.keys, known[np.minimum(y, len(known) - 1)] == two.keys
    for c in range(0, len(known), COLUMNS):
        left, right = (np.zeros((len(s.ids), min(COLUMNS, len(known) - c)), np.float32) for s in (one, two))
        for m, at, ok, s in ((left, x, in_x, one), (right, y, in_y, two)):
            now = ok & (at >= c) & (at < c + COLUMNS)
            m[s.doc[now], at[now] - c] = 1
        both += left @ right.T
    union = one.sizes[:, None] + two.sizes[None, :] - both
    i, j = np.nonzero((both >= threshold * union - 1e-9) & (one.roots[:, None] != two.roots[None, :]))
    pair = np.unique(np.stack([one.roots[i], two.roots[j]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
    return pair[:, 0], pair[:, 1]


def _blocks(k: int, threshold: float):
    """Links within each block of a bucket, and the blocks themselves where the bucket has several."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.concat_batches(rows)
            doc, key, _, _ = shingle_sets(*as_bytes(part.column("t")), k)
            ids, roots = (part.column(c).to_numpy() for c in ("rep", "root"))
            own = Sets(ids, roots, np.bincount(doc, minlength=len(ids)), key)
            a, b = cross_links(own, own, threshold)
            n = len(a) + (part.column("blocks")[0].as_py() > 1)
            bucket, block = part.column("bucket")[0].as_py(), part.column("block")[0].as_py()
            pad = [None] * (n - len(a))
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array([None] * len(a) + ([own.pack()] if pad else []), pa.binary()), pa.array(a.tolist() + pad, pa.int64()), pa.array(b.tolist() + pad, pa.int64())], ["bucket", "block", "payload", "a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in it:
            keys = list(zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True))
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != (keys[i - 1] if i else last):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if i < len(keys) and held:
                        yield from done(held)
                        held = []
                    start = i
            last = keys[-1] if keys else last
        if held:
            yield from done(held)

    return work


def _block_pairs(many: DataFrame) -> DataFrame:
    """payload, payload2 of each two blocks of a bucket. Columns are named after the join only, so that one exchange serves both sides."""
    x, y = many.alias("x"), many.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") < F.col("y.block")))
    return pairs.select(F.col("x.payload").alias("payload"), F.col("y.payload").alias("payload2"))


def _across(threshold: float):
    """Links between two blocks of a bucket."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for x, y in zip(batch.column("payload"), batch.column("payload2"), strict=True):
                a, b = cross_links(Sets.unpack(x.as_py()), Sets.unpack(y.as_py()), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work


def distinct_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, weights: str = "binary", bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """One row of each class, with its own columns only."""
    sketch, out = _classed(docs, key, text, threshold, weights, bands, rows, k)
    gone = out.filter("rid <> keep_rid").select("rid")
    left = sketch.select("rid", "row").join(gone.hint("merge"), "rid", "left_anti")
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
