"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Every byte is eight binary decisions; each has a tree of contexts, the preceding 0 to ``DEPTH`` bytes, and
every node holds Krichevsky-Trofimov counts of zeros and ones. A node's weighted probability is half its
own estimate of all its data and half the product of its children's; the posterior share of its own
estimate follows bottom-up from the counts alone, so counts can be gathered in any order by any number of
tasks. A bit's probability is the sum over the nodes of its path of their estimates, mixed by these shares;
a node never seen in training has the estimate one half, as the method has it. Text ends with an end byte
(0xFF, which UTF-8 never holds), and begins after ``DEPTH`` of them. The score is the log10 probability of
the whole text, with its end; ``bits_per_byte`` is its code length.

Nothing holds the whole model, and all contexts are in it:

* A task cuts texts into chunks of about ``CHUNK`` bytes. Of each chunk's distinct grams (context and byte)
  and distinct words it writes the keys with their training counts, dealt by hash into shards, as rows of
  packed numbers. A shard is asked by a chunk at most once, a frequent gram or word is one entry of a chunk
  however often it occurs, and only shards that a chunk has keys for get a row, so rows grow with the input.
* A shard sums its grams' counts. Grams that share their last ``SPLIT`` context bytes then meet, at most
  256 ** 3 by the lengths of the keys, and work out their subtrees; the nodes of ``SPLIT`` bytes are summed
  over the nodes of two, and those over the at most 65,280 nodes of one byte, which the driver mixes with the
  root. Mixtures go down the same way, and each gram gets its probability: also grams seen outside training
  only, whose counts are zero.
* Probabilities and word counts return to the chunks that asked, where texts are read again and summed.

The base score needs the count of every word. Words are 64-bit hashes.

Defined results: a null text counts as empty: its score is the end's alone. Rows that repeat a doc_id are
scored one by one; a null doc_id stays null. Without training rows every byte has probability 1/256, and a
word's base score is 0. Very long texts are chunks of their own. An empty table gives no rows. Other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import LARGE_VALUES, NONSPACE, apart, as_bytes, discard, distinct, fold, gathered, mix, pack, pack_sorted, slices, small_batches, unpack, unpack_sorted, words_of, written

DEPTH, SPLIT = 5, 3
END = 255
CHUNK, STEP = 8 << 20, 1 << 19
#: Bytes of text for each shard, and distinct grams for each task that works out subtrees.
SHARD_BYTES, PART_GRAMS = 32 << 20, 500_000
#: The end of a text, as a word.
END_WORD = np.uint64(0xE0D0E0D0E0D0E0D1)


# --- grams and words of a chunk ---------------------------------------------------------


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with DEPTH ends before and one after each; and which bytes are a text's or its last end."""
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets) + DEPTH + 1)])
    out, own = np.full(ends[-1], END, np.uint8), np.ones(ends[-1], bool)
    own[(ends[:-1, None] + np.arange(DEPTH)).reshape(-1)] = False
    own[ends[1:] - 1] = False
    out[own] = raw
    own[ends[1:] - 1] = True
    return out, own


def gram_steps(raw: np.ndarray, offsets: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys, in order, of all bytes and ends: the DEPTH bytes before and the byte itself as one number; and the text of each."""
    for i, j in slices(np.diff(offsets), step):
        out, own = padded(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        bounds = np.cumsum(np.diff(offsets[i : j + 1]) + DEPTH + 1)
        for a in range(DEPTH, len(out), step):
            b = min(a + step, len(out))
            x = out[a - DEPTH : b].astype(np.uint64)
            key = np.zeros(b - a, np.uint64)
            for k in range(DEPTH + 1):
                key = (key << np.uint64(8)) | x[k : k + b - a]
            del x
            at = np.flatnonzero(own[a:b])
            yield key[at], i + np.searchsorted(bounds, at + a, "right")


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of n."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(n[order], new) if len(new) else n[:0]


def grams_of(raw: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of all texts, and their counts in texts of which train is true."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for key, text in gram_steps(raw, offsets):
        key = (key << np.uint64(1)) | train[text].astype(np.uint64)
        key.sort()
        one = key & np.uint64(1)
        key >>= np.uint64(1)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        keys.append(key[new])
        counts.append(np.add.reduceat(one, new) if len(new) else key[:0])
        if len(keys) == 4:
            keys, counts = ([x] for x in summed(np.concatenate(keys), np.concatenate(counts)))
    return summed(np.concatenate(keys), np.concatenate(counts))


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text's end after its words; and the texts' bounds among them."""
    tokens, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in slices(np.diff(offsets), STEP):  # places of words are of a few texts only
        part, ends = apart(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        s, _, h = words_of(part, NONSPACE)
        bound = np.searchsorted(s, ends) + np.arange(j - i + 1)
        out, word = np.full(len(h) + j - i, END_WORD, np.uint64), np.ones(len(h) + j - i, bool)
        word[bound[1:] - 1] = False
        out[word] = h
        tokens.append(out)
        sizes.append(np.diff(bound))
    return np.concatenate(tokens), np.cumsum(np.concatenate(sizes))


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys by shard, the shards that have any, and their bounds in that order."""
    shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    some, first = np.unique(shard[order], return_index=True)
    return order, some, np.append(first, len(keys))


CHUNKS = "chunk long, kind string, shard int, tokens long, a binary, b binary"
_CHUNKS = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("shard", pa.int32()), ("tokens", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def chunks(docs: DataFrame, shards: int, key: str, text: str, folds: int, held: int) -> DataFrame:
    """Rows of CHUNKS: of kind t a chunk's texts, of g and w its grams and words of a shard with their training counts."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for batch in gathered(it, most=CHUNK):
            whole, all_offsets = as_bytes(batch.column("t"))
            for i, j in slices(np.diff(all_offsets), 2 * CHUNK):
                raw, offsets = whole[all_offsets[i] : all_offsets[j]], all_offsets[i : j + 1] - all_offsets[i]
                chunk = (task << 32) | turn
                turn += 1
                ids = batch.column("k").slice(i, j - i)
                is_held = np.array(batch.column("h").slice(i, j - i).to_pylist(), bool)
                tokens, bound = tokens_of(raw, offsets)
                train = np.repeat(~is_held, np.diff(bound))
                info = [offsets, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.array(ids.is_valid().to_pylist(), np.int64), is_held.astype(np.int64)]
                out = [(chunk, "t", -1, int(train.sum()), pa.compress(raw.tobytes(), "zstd", asbytes=True) if len(raw) else b"", pack(np.concatenate(info).view(np.uint64)))]
                words, _, number = distinct(tokens)
                counts = np.bincount(number, train, len(words)).astype(np.uint64)
                del tokens, number
                for kind, (keys, n) in (("w", (words, counts)), ("g", grams_of(raw, offsets, ~is_held))):
                    order, some, first = by_shard(keys, shards)
                    out += [(chunk, kind, int(s), 0, pack_sorted(keys[order[a:b]]), pack(n[order[a:b]])) for s, a, b in zip(some, first, first[1:], strict=False)]
                del words, counts, keys, n, order
                while out:  # a few rows at a time, so that neither side holds a second copy of all
                    some_rows, out = out[:16], out[16:]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some_rows, strict=True), _CHUNKS.types, strict=True)], schema=_CHUNKS)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), (fold(key, folds) == held).alias("h"))
    return rows.mapInArrow(work, CHUNKS)


# --- the model --------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


_FEW = 4096
_HALF, _WHOLE = log_gamma(np.arange(_FEW) + 0.5), log_gamma(np.arange(_FEW) + 1.0)
_LOG_HALF = float(np.log(0.5))


def _looked_up(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(n, _FEW - 1).astype(np.int64)]
    many = np.flatnonzero(n >= _FEW)
    out[many] = log_gamma(n[many] + add)
    return out


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a zeros and b ones."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return _looked_up(a, _HALF, 0.5) + _looked_up(b, _HALF, 0.5) - _looked_up(a + b, _WHOLE, 1.0) - 1.1447298858494002


def weighted(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Log of the weighted probability of nodes whose children's product has log ``below``."""
    return _LOG_HALF + np.logaddexp(kt_block(a, b), below)


def mixed(m0: np.ndarray, m1: np.ndarray, over: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mixture of nodes above, m0 and m1 for either bit with ``over`` left, with these nodes' own estimates."""
    own = kt_block(a, b)
    both = np.logaddexp(own, below)
    part = over * np.exp(own - both) / (a.astype(np.float64) + b + 1)
    return m0 + part * (a + 0.5), m1 + part * (b + 0.5), over * np.exp(below - both)


class Subtrees:
    """The contexts of SPLIT to DEPTH bytes of some grams, whole below every context of SPLIT bytes they have."""

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        self.levels = [summed(key, n.astype(np.int64))]  # from SPLIT bytes to DEPTH
        self.up: list[np.ndarray] = []
        for d in range(DEPTH - 1, SPLIT - 1, -1):
            keys, counts = self.levels[0]
            short, parent = np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            total = np.zeros(len(short), np.int64)
            np.add.at(total, parent, counts)
            self.levels.insert(0, (short, total))
            self.up.insert(0, parent)

    def nodes(self, bit: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: each gram's node, a place of a gram of each node, and the nodes' a, b and log of their children's product."""
        out: list[tuple] = []
        for d in range(len(self.levels) - 1, -1, -1):
            key, n = self.levels[d]
            node = key >> np.uint64(8 - bit)
            new = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
            at, first = np.cumsum(new) - 1, np.flatnonzero(new)
            one = ((key >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            a, b = (np.add.reduceat(np.where(x, n, 0), first) if len(first) else n[:0] for x in (~one, one))
            if out:
                _, below_first, *of = out[0]
                below = np.bincount(at[self.up[d][below_first]], weighted(*of), len(first)).astype(np.float64)
            else:
                below = kt_block(a, b)  # leaves: their own estimate alone
            out.insert(0, (at, first, a, b, below))
        return out

    def top(self) -> dict[str, np.ndarray]:
        """node, a, b and log of the weighted probability of all nodes of SPLIT bytes."""
        held: list[tuple] = []
        for bit in range(8):
            _, first, a, b, below = self.nodes(bit)[0]
            key = self.levels[0][0][first]
            held.append((node_of(key, bit), a, b, weighted(a, b, below)))
        return dict(zip(("node", "a", "b", "lw"), map(np.concatenate, zip(*held, strict=True)), strict=True))

    def log_p(self, node: np.ndarray, m0: np.ndarray, m1: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams and the natural log of their probabilities, given the mixtures above every node of SPLIT bytes."""
        order = np.argsort(node)
        node, m0, m1, over = node[order], m0[order], m1[order], over[order]
        out = np.zeros(len(self.levels[-1][0]))
        for bit in range(8):
            state: tuple = ()
            for d, (at, first, a, b, below) in enumerate(self.nodes(bit)):
                key = self.levels[d][0]
                if d == 0:
                    place = np.searchsorted(node, node_of(key[first], bit))
                    state = m0[place], m1[place], over[place]
                else:
                    parent = last[self.up[d - 1][first]]
                    state = tuple(x[parent] for x in state)
                state = mixed(*state, a, b, below) if d < DEPTH - SPLIT else leaves(*state, a, b)
                last = at
            one = ((self.levels[-1][0] >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            out += np.log(np.where(one, state[1][last], state[0][last]))
        return self.levels[-1][0], out


def leaves(m0: np.ndarray, m1: np.ndarray, over: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mixture with the deepest nodes, which take all that is left."""
    part = over / (a.astype(np.float64) + b + 1)
    return m0 + part * (a + 0.5), m1 + part * (b + 0.5), np.zeros(len(a))


def node_of(key: np.ndarray, bit: int) -> np.ndarray:
    """The node of a gram at a bit: its context, then a one and the bits before."""
    sym = key & np.uint64(255)
    return ((key & ~np.uint64(255)) | np.uint64(1 << bit) | (sym >> np.uint64(8 - bit))).astype(np.int64)


def shorter(node: str, context: int):
    """The same node with that many bytes of context."""
    return F.col(node).bitwiseAND(F.lit((1 << 8 * (context + 1)) - 1))


def root_mixtures(rows: pa.Table) -> pa.Table:
    """node, m0, m1, over of every node of one byte, from its a, b and log of its children's product."""
    node, a, b, below = (rows[c].to_numpy() for c in ("node", "a", "b", "below"))
    last = node & 255
    a0, b0, below0 = (np.bincount(last, x, 256).astype(np.float64) for x in (a, b, weighted(a, b, below)))
    top = mixed(np.zeros(256), np.zeros(256), np.ones(256), a0, b0, below0)
    m0, m1, over = mixed(*(x[last] for x in top), a, b, below)
    return pa.table({"node": node, "m0": m0, "m1": m1, "over": over})


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def probabilities(counts: DataFrame) -> DataFrame:
    """key, shard and log_p of each row (key, n, shard), by the tree of the counts n."""
    spark = counts.sparkSession
    grams = counts.agg(F.count(F.lit(1))).first()[0]
    parts = max(1, -(-grams // PART_GRAMS))
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SPLIT) - 1))
    counts = counts.withColumn("part", F.pmod(F.xxhash64(context), F.lit(parts)))

    def up(rows: pa.Table) -> pa.Table:
        top = Subtrees(rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()).top()
        return pa.table({"part": pa.array(np.full(len(top["node"]), rows["part"][0].as_py(), np.int64)), **top})

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weighted(*_numbers(batch, "a", "b", "below")))], [*batch.schema.names, "lw"])

    def down(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = mixed(*_numbers(batch, "m0", "m1", "over", "a", "b", "below"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), *map(pa.array, out)], ["node", "m0", "m1", "over"])

    def finish(grams: pa.Table, states: pa.Table) -> pa.Table:
        key = grams["key"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        _, log_p = Subtrees(key, grams["n"].to_numpy()).log_p(*(states[c].to_numpy() for c in ("node", "m0", "m1", "over")))
        return pa.table({"key": key[order].view(np.int64), "shard": grams["shard"].to_numpy()[order], "log_p": log_p})

    sums = (F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below"))
    three = written(counts.groupBy("part").applyInArrow(up, "part long, node long, a long, b long, lw double"), "nodes-3")
    two = three.groupBy(shorter("node", 2).alias("node")).agg(*sums)
    two = written(two.mapInArrow(weigh, "node long, a long, b long, below double, lw double"), "nodes-2")
    one = two.groupBy(shorter("node", 1).alias("node")).agg(*sums).toArrow()  # 256 contexts of 255 nodes at most
    root = spark.createDataFrame(root_mixtures(one))  # from Arrow: no task of pickled rows, whose Python workers would stay
    states = two.join(F.broadcast(root.withColumnRenamed("node", "parent")), shorter("node", 1) == F.col("parent")).drop("parent", "lw")
    states = written(states.mapInArrow(down, "node long, m0 double, m1 double, over double"), "states-2")
    above = three.select("part", "node").join(states.withColumnRenamed("node", "parent"), shorter("node", 2) == F.col("parent")).drop("parent")
    out = written(counts.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(finish, "key long, shard int, log_p double"), "probabilities")
    discard(three, two, states)
    return out


# --- scores -----------------------------------------------------------------------------

REPLIES = "chunk long, kind string, shard int, known long, values binary"


#: Keys unpacked before they are summed.
MERGED = 1 << 19


def merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a shard's rows with the sums of their counts; holds its distinct keys and MERGED more, however many rows repeat them."""
    keys, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for a, b in zip(rows["a"], rows["b"], strict=True):
        keys.append(unpack_sorted(a.as_py()))
        counts.append(unpack(b.as_py()))
        size += len(keys[-1])
        if size >= max(MERGED, len(keys[0])):
            keys, counts = ([x] for x in summed(np.concatenate(keys), np.concatenate(counts)))
            size = 0
    return summed(np.concatenate(keys), np.concatenate(counts))


def gram_counts(rows: pa.Table) -> pa.Table:
    """One shard's distinct grams with the sums of their counts."""
    key, total = merged(rows)
    return pa.table({"key": key.view(np.int64), "n": total.view(np.int64), "shard": pa.array(np.full(len(key), rows["shard"][0].as_py(), np.int32))})


def _replies(rows: pa.Table, kind: str, known: int, values: Iterator[bytes]) -> pa.Table:
    n = rows.num_rows
    return pa.table({"chunk": rows["chunk"].combine_chunks(), "kind": pa.array([kind] * n), "shard": rows["shard"].combine_chunks(), "known": pa.array([known, *[0] * (n - 1)], pa.int64()), "values": pa.array(list(values), pa.binary())})


def gram_replies(rows: pa.Table, model: pa.Table) -> pa.Table:
    """One shard: to each chunk the log probabilities of its grams, in the order of its keys."""
    key, log_p = model["key"].to_numpy().view(np.uint64), model["log_p"].to_numpy()
    order = np.argsort(key)
    key, log_p = key[order], log_p[order].astype("<f4")
    return _replies(rows, "g", 0, (pack(log_p[np.searchsorted(key, unpack_sorted(x.as_py()))], "<f4") for x in rows["a"]))


def word_replies(rows: pa.Table) -> pa.Table:
    """One shard: to each chunk the training counts of its words; the first row tells how many words have one."""
    key, total = merged(rows)
    return _replies(rows, "w", int((total > 0).sum()), (pack(total[np.searchsorted(key, unpack_sorted(x.as_py()))]) for x in rows["a"]))


def values_of(keys: np.ndarray, shards: int, replies: dict[int, pa.Scalar], read) -> np.ndarray:
    """The replies' values, in the order of the keys."""
    order, some, first = by_shard(keys, shards)
    if not len(some):
        return read(pack(keys[:0]))
    out = None
    for s, a, b in zip(some, first, first[1:], strict=False):
        got = read(replies[int(s)].as_py())
        out = np.empty(len(keys), got.dtype) if out is None else out
        out[order[a:b]] = got
    return out


RESULTS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """RESULTS of each row, by a model of the rows outside the held-out fold: those whose crc32 of the key, modulo folds, isn't held."""
    small_batches(docs.sparkSession, 1024, 2 << 20)
    whole = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = int(max(1, -(-whole // shard_bytes)))
    parts = written(chunks(docs, shards, key, text, folds, held), "chunks", LARGE_VALUES)
    asked = parts.filter("kind = 'g'").select("chunk", "shard", "a", "b")
    counts = written(asked.groupBy("shard").applyInArrow(gram_counts, "key long, n long, shard int"), "gram-counts")
    model = probabilities(counts)
    grams = asked.select("chunk", "shard", "a").groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(gram_replies, REPLIES)
    words = parts.filter("kind = 'w'").select("chunk", "shard", "a", "b").groupBy("shard").applyInArrow(word_replies, REPLIES)
    replies = written(grams.unionByName(words), "replies", LARGE_VALUES)
    discard(counts, model)
    n_train = parts.filter("kind = 't'").agg(F.sum("tokens")).first()[0] or 0
    distinct_words = replies.agg(F.sum("known")).first()[0] or 0
    log_all = float(np.log10(n_train + distinct_words + 1))

    def results(rows: pa.Table) -> pa.Table:
        got: dict[str, dict[int, pa.Scalar]] = {"g": {}, "w": {}}  # of the table, not copied
        for i, (kind, shard) in enumerate(zip(rows["kind"].to_pylist(), rows["shard"].to_pylist(), strict=True)):
            if kind == "t":
                text, meta = rows["a"][i].as_py(), unpack(rows["b"][i].as_py()).view(np.int64)
            else:
                got[kind][shard] = rows["values"][i]
        n = (len(meta) - 1) // 4
        offsets, ids, valid, is_held = meta[: n + 1], *meta[n + 1 :].reshape(3, n)
        size = int(offsets[-1])
        raw = np.frombuffer(pa.decompress(text, size, "zstd", asbytes=True) if size else b"", np.uint8)
        keys, _ = grams_of(raw, offsets, np.zeros(n, bool))
        log_p = values_of(keys, shards, got["g"], lambda x: unpack(x, "<f4"))
        score = np.zeros(n)
        for key, who in gram_steps(raw, offsets, 1 << 15):  # a place of 16 bits beside a key of 48
            both = (key << np.uint64(16)) | np.arange(len(key), dtype=np.uint64)
            both.sort()
            p = np.empty(len(key))
            p[(both & np.uint64(0xFFFF)).astype(np.int64)] = log_p[np.searchsorted(keys, both >> np.uint64(16))]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            score[who[first]] += np.add.reduceat(p, first)
        del keys, log_p
        tokens, bound = tokens_of(raw, offsets)
        words, _, number = distinct(tokens)
        del tokens
        own = values_of(words, shards, got["w"], unpack).astype(np.int64)[number]
        who = np.repeat(np.arange(n), np.diff(bound))
        base = np.bincount(who, np.log10(own + 1.0), n) - np.diff(bound) * log_all
        score /= np.log(10)
        known = np.bincount(who, own > 0, n).astype(np.int64)
        columns = [pa.array(ids, mask=valid == 0), pa.array(is_held.astype(bool)), pa.array(np.diff(bound)), pa.array(known), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(score), pa.array(-score * np.log2(10) / (np.diff(offsets) + 1))]
        return pa.table(columns, [c.split()[0] for c in RESULTS.split(", ")])

    texts = parts.filter("kind = 't'").select("chunk", "kind", "shard", "a", "b")
    back = replies.select("chunk", "kind", "shard", "values")
    return texts.unionByName(back, allowMissingColumns=True).groupBy("chunk").applyInArrow(results, RESULTS)
