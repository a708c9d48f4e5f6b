"""Context-tree weighting against a plain tree kept bit by bit."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratelens.llm import common, lmscore

LOW = str.maketrans(common.UPPER, common.LOWER)


def held(i):
    return zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2


@pytest.fixture(scope="module")
def small_corpus(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice(["tha", "ing", "É", "on", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))) for _ in range(80)] + [None, "", " \x0b\x1c x\x00y ", "tha", "unheard ~ of", "THA Ing tha"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "tha")]
    return spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, chunk string"), rows


class Tree:
    """Zeros and ones of every node, seen bit by bit; weighted probabilities by the definition."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.memo = {}
        for data in texts:
            data = b"\xff" * 5 + data + b"\xff"
            for i in range(5, len(data)):
                for bit in range(8):
                    for d in range(6):
                        node = (data[i - d : i], bit, data[i] >> (8 - bit))
                        self.n[node][data[i] >> (7 - bit) & 1] += 1
                        if d < 5:
                            self.children[node].add((data[i - d - 1 : i], bit, data[i] >> (8 - bit)))

    def weighted(self, node, more=None):
        """Log of the weighted probability, with one more bit after the context ``more`` if given."""
        a, b = self.n.get(node, (0, 0))
        if more:
            context, bit = more
            a, b = a + (bit == 0), b + bit
        elif node in self.memo:
            return self.memo[node]
        out = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        d = len(node[0])
        if d < 5:
            on = (more[0][4 - d :], *node[1:]) if more else None
            below = sum(self.weighted(c) for c in self.children.get(node, ()) if c != on)
            if on:
                below += self.weighted(on, more)
            out = math.log(0.5) + np.logaddexp(out, below)
        if not more:
            self.memo[node] = out
        return out

    def log_p(self, context, byte):
        """A byte's probability is the ratio of the root's weighted probabilities with and without each of its bits."""
        out = 0.0
        for bit in range(8):
            root = (b"", bit, byte >> (8 - bit))
            out += self.weighted(root, (context, byte >> (7 - bit) & 1)) - self.weighted(root)
        return out


def test_probabilities_equal_a_plain_tree_for_every_byte(spark, small_corpus, monkeypatch):
    _, rows = small_corpus
    texts = [(t or "").encode() for _, t in rows]
    tree = Tree(texts)
    contexts = [b"\xff" * 5, b"tha o", b"zzzzz", b"ingre", b"xxtha", b"\xc3\x89\xc3\x89r"]
    asked = {int.from_bytes(c + bytes([b]), "big"): 0 for c in contexts for b in range(256)}
    for data in texts:
        data = b"\xff" * 5 + data + b"\xff"
        for i in range(5, len(data)):
            k = int.from_bytes(data[i - 5 : i + 1], "big")
            asked[k] = asked.get(k, 0) + 1
    counts = spark.createDataFrame([(k, n, 0) for k, n in asked.items()], "key long, n long, shard int")
    monkeypatch.setattr(lmscore, "PART_GRAMS", 200)  # many tasks
    got = {r["key"]: r["log_p"] for r in lmscore.probabilities(counts).collect()}
    assert got.keys() == asked.keys()
    for c in contexts:
        own = [got[int.from_bytes(c + bytes([b]), "big")] for b in range(256)]
        assert np.exp(own).sum() == pytest.approx(1, abs=1e-9)
        for b in range(0, 256, 3):
            assert own[b] == pytest.approx(tree.log_p(c, b), rel=1e-6)


def test_base_score_and_scores(spark, small_corpus, monkeypatch):
    df, rows = small_corpus
    monkeypatch.setattr(lmscore, "CHUNK", 3000)
    monkeypatch.setattr(lmscore, "STEP", 700)
    got = lmscore.scored(df, shard_bytes=900).collect()
    words = lambda t: (t or "").translate(LOW).encode().split()
    c, n, ends = Counter(), 0, 0
    for i, t in rows:
        if not held(i):
            c.update(words(t))
            n += len(words(t)) + 1
            ends += 1
    v = len(c) + 1
    known = dict(rows)
    tree = Tree([(t or "").encode() for i, t in rows if not held(i)])
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        t = known[r["doc_id"]]
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["train_tokens"] == n and r["n_tokens"] == len(w) + 1
        assert r["n_known"] == sum(x in c for x in w) + 1 and r["held_out"] == held(r["doc_id"])
        if len(t or "") < 60 or r["doc_id"] == 0:
            data = b"\xff" * 5 + (t or "").encode() + b"\xff"
            score = sum(tree.log_p(data[i - 5 : i], data[i]) for i in range(5, len(data))) / math.log(10)
            assert r["score"] == pytest.approx(score, rel=1e-5)
            assert r["bits_per_byte"] == pytest.approx(-score * math.log2(10) / (len(data) - 5), rel=1e-5)
    size = sum(len((known[r["doc_id"]] or "").encode()) + 1 for r in got if r["held_out"])
    assert -sum(r["score"] for r in got if r["held_out"]) * math.log2(10) < 4 * size  # half of a flat code


def test_scores_dont_depend_on_partitions(spark, small_corpus):
    df, _ = small_corpus
    one = {(r["doc_id"], r["base_score"], round(r["score"], 3)) for r in lmscore.scored(df.coalesce(1)).collect()}
    many = {(r["doc_id"], r["base_score"], round(r["score"], 3)) for r in lmscore.scored(df.repartition(7), shard_bytes=300).collect()}
    assert one == many


def test_scores_without_training_rows(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = lmscore.scored(df, held=zlib.crc32(b"1") % 7).first()
    assert r["score"] == pytest.approx(-3 * math.log10(256)) and (r["base_score"], r["train_tokens"], r["n_known"]) == (0.0, 0, 0)
    assert lmscore.scored(df.filter("false")).count() == 0
    nothing = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert lmscore.scored(nothing).first()["n_tokens"] == 1


def test_very_long_text(spark):
    text = "the quick brown fox " * 60_000
    a, b = [i for i in range(20) if not held(i)][:2]
    df = spark.createDataFrame([(a, text), (b, "the quick brown fox")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lmscore.scored(df).collect()}
    assert got[a]["n_tokens"] == 240_001 and got[a]["bits_per_byte"] < 0.1 and got[a]["score"] < 0


def test_words_of_equal_hash_are_equal(spark):
    """Strings that any power-of-two polynomial hash confuses."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    a, b, c = [i for i in range(20) if not held(i)][:3]
    df = spark.createDataFrame([(a, one), (b, two), (c, one)], "doc_id long, text string")
    base = {r["doc_id"]: r["base_score"] for r in lmscore.scored(df).collect()}
    assert base[a] == base[c] > base[b]


def test_a_shard_holds_its_distinct_keys_not_all_rows():
    """Counts of many small chunks that repeat the same keys are summed as they come."""
    import tracemalloc

    import pyarrow as pa

    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 48, 20_000).astype(np.uint64))
    a, b = lmscore.pack_sorted(keys), lmscore.pack(np.ones(len(keys), np.uint64))
    rows = pa.table({"chunk": list(range(300)), "shard": pa.array([0] * 300, pa.int32()), "a": pa.array([a] * 300, pa.binary()), "b": pa.array([b] * 300, pa.binary())})
    tracemalloc.start()
    got = lmscore.gram_counts(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n"].to_pylist() == [300] * 20_000 and got["key"].to_pylist() == keys.tolist()
    assert most < 60_000_000  # 6,000,000 keys and counts alone are 96 MB
    tracemalloc.start()
    back = lmscore.word_replies(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(lmscore.unpack(x).tolist() == [300] * 20_000 for x in back["values"].to_pylist()[::99])
    assert most < 60_000_000


def test_words_of_a_chunk_are_looked_up_a_few_texts_at_a_time():
    """Of all words only the hashes are held, not their places."""
    import tracemalloc

    raw = np.frombuffer(b"ab cd " * 1_000_000, np.uint8)
    offsets = np.arange(0, len(raw) + 1, 6000)
    tracemalloc.start()
    tokens, bound = lmscore.tokens_of(raw, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bound.tolist() == [2001 * i for i in range(1001)] and len(set(tokens.tolist())) == 3 and (tokens[bound[1:] - 1] == lmscore.END_WORD).all()
    assert most < 80_000_000  # starts, ends and hashes of 2,000,000 words, held twice, are 96 MB


def test_tables_of_packed_values_have_no_codec(spark, tmp_path, monkeypatch):
    """A codec keeps direct buffers as large as the largest page, which an executor's heap doesn't bound."""
    import pyarrow.parquet as pq

    kept = []
    monkeypatch.setattr(lmscore, "written", lambda *a: kept.append((a[1], common.written(*a))) or kept[-1][1])
    words = np.random.default_rng(5).integers(0, 1 << 40, (60, 4000))
    df = spark.createDataFrame([(i, " ".join(map(str, w))) for i, w in enumerate(words.tolist())], "doc_id long, text string").coalesce(1)
    lmscore.scored(df, shard_bytes=20_000)
    for tag in ("chunks", "replies"):
        (table,) = (t for name, t in kept if name == tag)
        files = [pq.ParquetFile(f.removeprefix("file://")) for f in table.inputFiles()]
        columns = [f.metadata.row_group(0).column(i) for f in files for i in range(f.metadata.num_columns) if f.metadata.num_row_groups]
        assert columns and {c.compression for c in columns} == {"UNCOMPRESSED"}
