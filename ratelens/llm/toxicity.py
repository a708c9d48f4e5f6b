"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon has two parts: fixed insults, and word beginnings learned from one half of the sample of
labelled rows: of those that toxic texts hold and clean texts hardly do, a greedy cover of the toxic
texts. The other half trains the trees, so that they see what the learned part is worth on new texts.

Features of a whole text: how many words of either part it holds (plain, and insults spelt with
look-alike signs, stretched letters or signs between letters), their density, how near second-person
words stand to them, and rates of capitals, capitalised words, punctuation, exclamation, digits and
obfuscating signs. Trees are grown in numpy on histograms of at most ``BINS`` bins, with the logistic loss, from a
bounded sample of at most ``max_rows`` labelled rows; a fifth of the sample is kept from the trees for
isotonic calibration by pooled adjacent violators.

Defined results: null and empty texts have all features 0 and get the score the model gives to that.
Rows without a label teach nothing; without any labelled row, or with one class only, every score is
that class's share (0 without rows). Repeated rows are scored alike. Other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import discard, fold, sample_at_most, small_batches, written

#: Common insults, by language.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "loser", "losers", "pathetic", "worthless", "disgusting", "scum", "trash", "garbage", "clown", "clowns", "fool", "jerk", "creep", "freak", "coward", "vermin", "scumbag", "dumbass", "asshole", "bastard", "bitch",
    "dummkopf", "trottel", "abschaum", "versager", "widerlich", "erbärmlich",
    "imbécil", "estúpido", "estúpida", "basura", "asqueroso", "patético", "inútil",
    "imbécile", "abruti", "crétin", "minable", "ordure", "dégoûtant",
)
#: Words that address the reader.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr tú tu ti te usted vosotros toi ton ta tes vous votre".split())
NEAR = 6
#: Lengths of learned word beginnings; "$" ends a whole word.
STEMS = (4, 5, 6, 7, 8)
BINS = 32
FEATURES = ("hits", "kinds", "density", "learned", "learned_kinds", "learned_density", "hidden", "hidden_density", "near_second", "second_gap", "second_rate", "capitals", "capital_words", "punctuation", "exclamations", "repeated_marks", "digits", "signs", "words_log", "mean_word")

_LOOK = bytes.maketrans(b"013457@$!|ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"oieastasiiabcdefghijklmnopqrstuvwxyz")
_SIGNS = b"*._-+~^#%&'\"`"
_WORD = re.compile(r"[^\W_]+")
_STRETCH = re.compile(r"(.)\1{2,}")
_REPEATED = re.compile(r"[!?*#$%&]{2,}")
_HIST = {k: np.array([ord(c) for c in v]) for k, v in {"punct": ".,;:!?'\"()[]{}-", "signs": "@#$%&*+=<>^~|\\/_", "digits": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}.items()}


def stems(word: str) -> list[str]:
    return [word[:n] for n in STEMS if n <= len(word)] + [f"{word}$"]


class Extractor:
    def __init__(self, lexicon: tuple[str, ...] = LEXICON, learned: tuple[str, ...] = ()) -> None:
        self.lexicon = frozenset(lexicon)
        self.plain = [w.encode() for w in sorted(self.lexicon)]
        self.begin = re.compile("|".join(re.escape(x) for x in sorted(x for x in learned if x[-1] != "$")) or r"(?!)")
        self.first = frozenset(x[: STEMS[0]] for x in learned if x[-1] != "$")
        self.whole = frozenset(x[:-1] for x in learned if x[-1] == "$")

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        low = text.lower()
        raw, low_raw = text.encode("utf-8", "surrogatepass"), low.encode("utf-8", "surrogatepass")
        parts, words = text.split(), _WORD.findall(low)
        n_words, size, cut = max(len(words), 1), len(raw), STEMS[0]
        hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        known, own = self.lexicon, []
        first, whole, begin = self.first, self.whole, self.begin
        at = [i for i, w in enumerate(words) if w in known] if any(w in low_raw for w in self.plain) else []
        hits, kinds = len(at), len({words[i] for i in at})
        if first or whole:
            own = [i for i, w in enumerate(words) if (w[:cut] in first and begin.match(w)) or w in whole]
        near, gap, second = 0, float(NEAR * 4), 0
        if at or own:
            you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            second = len(you)
            for i in {*at, *own}:
                k = bisect_left(you, i)
                d = min((abs(i - you[j]) for j in (k - 1, k) if 0 <= j < second), default=NEAR * 4)
                near += d <= NEAR
                gap = min(gap, float(d))
        hidden = 0
        open_raw = raw.translate(_LOOK, _SIGNS)
        if any(w in open_raw for w in self.plain) or _STRETCH.search(low):
            for w in _WORD.findall(open_raw.decode("utf-8", "replace")):
                hidden += w in known or (len(w) > 5 and _STRETCH.sub(r"\1", w) in known)
            hidden = max(0, hidden - hits)
        caps = sum(map(str.isupper, parts))
        return [
            float(hits), float(kinds), 100 * hits / n_words, float(len(own)), float(len({words[i] for i in own})), 100 * len(own) / n_words, float(hidden), 100 * hidden / n_words, float(near), gap, 100 * second / n_words,
            hist[_HIST["upper"]].sum() / size, caps / n_words, hist[_HIST["punct"]].sum() / size, hist[33] / size, len(_REPEATED.findall(text)) / n_words, hist[_HIST["digits"]].sum() / size, hist[_HIST["signs"]].sum() / size, float(np.log1p(len(words))), size / n_words,
        ]

    def matrix(self, texts: pa.Array) -> np.ndarray:
        return np.array([self(t) for t in texts.to_pylist()], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Trees of equal depth as arrays: at node k of a tree go to 2k+1 where x <= cut, else to 2k+2."""

    prior: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    knots: np.ndarray
    values: np.ndarray
    lexicon: tuple[str, ...] = LEXICON
    learned: tuple[str, ...] = ()

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.prior), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            k = np.zeros(len(x), np.int64)
            while inner and k[:1].size and k[0] < inner:
                k = 2 * k + 1 + (x[row, f[k]] > c[k])
            out += leaf[k - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margin(x), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over y by x: knots and non-decreasing values. Equal x are pooled first."""
    ux, where = np.unique(x, return_inverse=True)
    w = np.bincount(where).astype(float)
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, m, n in zip(ux, np.bincount(where, y) / w, w, strict=True):
        blocks.append([m, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, n2, _, last = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m2 * n2) / (blocks[-1][1] + n2), blocks[-1][1] + n2, blocks[-1][2], last]
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    return knots, np.array([v for b in blocks for v in (b[0], b[0])])


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, leaf_rows: int = 5, l2: float = 1.0, seed: int = 1, lexicon: tuple[str, ...] = LEXICON, learned: tuple[str, ...] = ()) -> Model:
    """Newton boosting of the logistic loss on histograms."""
    inner = 2**depth - 1
    none = (np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(0.0, *none, np.array([0.0]), np.array([share]), lexicon, learned)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, learn = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    if y[learn].min() == y[learn].max() or y[held].min() == y[held].max():
        held = learn = order
    xl, yl = x[learn], y[learn].astype(float)
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(xl[:, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) < BINS else np.unique(np.quantile(mid, np.linspace(0, 1, BINS - 1))))
    binned = np.stack([np.searchsorted(c, xl[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = yl.mean()
    prior = float(np.log(share / (1 - share)))
    z = np.full(len(yl), prior)
    features, values, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - yl, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(yl), np.int64)
        f_of, c_of, b_of = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS + 1)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            local = node - first
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * (BINS + 1) + binned[:, f]
                G, H, N = (np.bincount(key, w, n * (BINS + 1)).reshape(n, BINS + 1).cumsum(1) for w in (g, h, None))
                gt, ht, nt = G[:, -1:], H[:, -1:], N[:, -1:]
                gain = G**2 / (H + l2) + (gt - G) ** 2 / (ht - H + l2) - gt**2 / (ht + l2)
                gain[(leaf_rows > N) | (leaf_rows > nt - N)] = 0
                gain = gain[:, : len(c)]
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(n), at] > best):
                    best[k], f_of[first + k], b_of[first + k], c_of[first + k] = gain[k, at[k]], f, at[k], c[at[k]]
            node = 2 * node + 1 + (binned[np.arange(len(yl)), f_of[node]] > b_of[node])
        at = node - inner
        G, H = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = -rate * G / (H + l2)
        z += leaf[at]
        features.append(f_of)
        values.append(c_of)
        leaves.append(leaf)
    model = Model(prior, np.array(features), np.array(values), np.array(leaves), np.array([0.0]), np.array([0.0]), lexicon, learned)
    model.knots, model.values = isotonic(model.margin(x[held]), y[held].astype(float))
    return model


def learn_stems(rows: DataFrame, candidates: int = 20_000, most: int = 150, least: int = 3, precision: float = 0.9) -> tuple[str, ...]:
    """Word beginnings that tell toxic rows (y > 0) of a bounded sample (t, y) from clean ones.

    A candidate is held by at least ``least`` toxic texts; kept are those whose rate among toxic texts
    outweighs that among clean ones by precision to 1 - precision, with half a text added to clean ones.
    A greedy cover takes the one that most uncovered toxic texts hold, the shortest of equals.
    """

    def holding(only: frozenset | None):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                n: Counter[str] = Counter()
                for t in batch.column("t").to_pylist():
                    own = {x for w in set(_WORD.findall(t.lower())) for x in stems(w)} if t else set()
                    n.update(own if only is None else own & only)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["stem", "n"])

        return batches

    toxic, clean = rows.filter("y > 0").select("t"), rows.filter("y <= 0").select("t")
    count = lambda df, only=None: df.mapInArrow(holding(only), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    pos = {r["stem"]: r["n"] for r in count(toxic).filter(F.col("n") >= least).orderBy(F.desc("n"), "stem").limit(candidates).collect()}
    if not pos:
        return ()
    neg = {r["stem"]: r["n"] for r in count(clean, frozenset(pos)).collect()}
    n_pos, n_neg = toxic.count(), max(clean.count(), 1)
    good = frozenset(x for x, n in pos.items() if n / n_pos * (1 - precision) >= precision * (neg.get(x, 0) + 0.5) / n_neg)

    @F.arrow_udf("array<string>")
    def held(t: pa.Array) -> pa.Array:
        return pa.array([sorted({x for w in set(_WORD.findall(v.lower())) for x in stems(w)} & good) if v else [] for v in t.to_pylist()], pa.list_(pa.string()))

    left = [set(r["s"]) for r in toxic.select(held("t").alias("s")).collect()]
    out: list[str] = []
    while len(out) < most:
        gain = Counter(x for s in left for x in s)
        if not gain:
            break
        best = min(gain, key=lambda x: (-gain[x], len(x), x))
        if gain[best] < least:
            break
        out.append(best)
        left = [s for s in left if best not in s]
    return tuple(sorted(out))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_rows: int = 20_000, lexicon: tuple[str, ...] = LEXICON) -> Model:
    """A model from at most max_rows labelled rows; labels may be restricted by the caller."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("y is not null and k is not null").groupBy("k").agg(F.max("y").alias("y"))
    some = sample_at_most(known, "k", max_rows, known.count())
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k")  # max_rows pairs of numbers
    rows = written(found.groupBy("k").agg(F.max("t").alias("t"), F.max("y").alias("y")).repartition(12, "k"), "toxic-sample")  # one text of each key
    half = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(2))
    learned = learn_stems(rows.filter(half == 0))

    @F.arrow_udf("array<double>")
    def features(t: pa.Array) -> pa.Array:
        return pa.array(list(Extractor(lexicon, learned).matrix(t)), pa.list_(pa.float64()))

    got = rows.filter(half == 1).select("k", "y", features("t").alias("x")).toPandas().sort_values(["k", "y"], kind="stable").head(max_rows)
    discard(rows)
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return train(x, (got["y"].to_numpy(np.int64) > 0).astype(np.int64), lexicon=lexicon, learned=learned)


def scorer(docs: DataFrame, model: Model):
    """A function of a text column that gives the score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees x depth: of fixed size

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array(m.score(Extractor(m.lexicon, m.learned).matrix(t)), pa.float64())

    return score.asNondeterministic()


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> Column:
    return scorer(docs, model)(F.col(text))


def training_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.filter(fold(key, 5) != 0)
