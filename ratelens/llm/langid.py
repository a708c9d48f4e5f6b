"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed character n-grams (1 to 4 bytes of lower-cased
letters, word ends marked by a blank); a linear layer and a softmax give a probability for each
language. Embeddings and layer are trained together by stochastic gradient descent in numpy, on the
driver, from a bounded sample: at most ``per_lang`` texts of each language, each reduced on the
executors to counts of at most ``BUCKETS`` hashed n-grams, and of all languages together at most
``max_bytes`` of such counts, so that neither many rows, many languages nor long texts grow what the driver holds. A tenth of the sample calibrates: it sets the softmax temperature, and the
least score, from one half up, at which accepted texts are wrong at most ``max_error`` of the time.
Texts below it are rejected.

The average is linear, so embedding and layer fold into one table (n-gram, language) for prediction;
whole texts are scored in numpy over their bytes.

Defined results: a null text, an empty one or one with no letter is ``und`` with score 0 and is
rejected. Rows with a null language teach nothing. With no labelled row at all every text is ``und``.
Of equal scores the language first by name wins. An empty table gives no rows. Repeated rows are scored alike. Other columns pass through untouched; text and language columns are
taken by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import apart, as_bytes, discard, fold, free_name, mix, slices, small_batches, written

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
STEP = 1 << 19
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint8)
for _b in [*range(65, 91), *range(97, 123), *range(128, 256)]:
    _LETTERS[_b] = _b + 32 if 65 <= _b <= 90 else _b


def gram_buckets(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and buckets of the n-grams of each order; none spans a blank except at its ends."""
    x = _LETTERS[raw].astype(np.uint64)
    blank = x == 32
    for n in GRAMS:
        if len(x) < n:
            return
        key = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | x[k : len(x) - n + 1 + k]
        ok = ~blank[: len(key)] if n == 1 else np.ones(len(key), bool)
        for k in range(1, n - 1):
            ok &= ~blank[k : k + len(key)]
        if n == 2:
            ok &= ~(blank[: len(key)] & blank[1 : 1 + len(key)])
        at = np.flatnonzero(ok)
        yield at, (mix(key[at]) >> np.uint64(64 - 15)).astype(np.int64)


def _spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank before and after each; a text's n-grams start at its first blank."""
    out, ends = apart(raw, offsets)
    return np.concatenate([np.full(1, 32, np.uint8), out]), ends


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) if t else False for t in texts.to_pylist()], bool)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages), temperature included
    bias: np.ndarray
    threshold: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probabilities, a row for each text."""
        raw, offsets = as_bytes(texts)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        n = np.zeros(len(offsets) - 1)
        for i, j in slices(np.diff(offsets), STEP):
            for a in range(offsets[i], max(offsets[j], offsets[i] + 1), 8 * STEP):  # one long text goes in parts
                b = min(offsets[j], a + 8 * STEP)
                own = np.clip(offsets[i : j + 1], a, b)
                part, at = _spaced(raw[a:b], own - own[0])
                for place, bucket in gram_buckets(part):
                    who = np.minimum(np.searchsorted(at, place, "right") - 1, j - i - 1)
                    n[i:j] += np.bincount(who, minlength=j - i)
                    for c in range(len(self.langs)):
                        out[i:j, c] += np.bincount(who, self.table[bucket, c], j - i)
        z = out / np.maximum(n, 1)[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True)) if len(self.langs) else z
        return z / z.sum(1, keepdims=True) if len(self.langs) else z

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected."""
        known = has_letter(texts)
        if not self.langs:
            known[:] = False
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), ~known
        p = self.scores(texts)
        best = p.argmax(1)
        score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, ~known | (score < self.threshold)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], dim: int = 12, epochs: int = 3, rate: float = 0.5, max_error: float = 0.02, seed: int = 1) -> Model:
    """SGD with a linearly falling rate over (buckets, counts) and label numbers; every tenth text calibrates."""
    k = len(langs)
    if not len(labels) or k == 0:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1, 1, (BUCKETS, dim)).astype(np.float32) / dim
    W, b = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    order = rng.permutation(len(labels))
    held = order[: len(order) // 10] if len(order) >= 40 else order
    learn = order[len(order) // 10 :] if len(order) >= 40 else order
    weight = len(labels) / (k * np.maximum(np.bincount(labels, minlength=k), 1))  # rare languages count as much
    size, done, steps = 16, 0, max(1, epochs * -(-len(learn) // 16))
    for _ in range(epochs):
        for s in range(0, len(learn), size):
            batch = rng.permutation(learn)[:size] if len(learn) < size else learn[s : s + size]
            step = rate * (1 - done / steps)
            done += 1
            idx = np.concatenate([features[i][0] for i in batch])
            n = np.array([len(features[i][0]) for i in batch])
            who = np.repeat(np.arange(len(batch)), n)
            share = np.concatenate([features[i][1] / max(features[i][1].sum(), 1) for i in batch]).astype(np.float32)
            mean = np.zeros((len(batch), dim), np.float32)
            full = np.flatnonzero(n)
            if len(full):
                mean[full] = np.add.reduceat(E[idx] * share[:, None], (np.cumsum(n) - n)[full], axis=0)
            z = mean @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p *= weight[labels[batch], None]
            down = p @ W.T
            W -= step * mean.T @ p
            b -= step * 0.1 * p.mean(0)
            np.add.at(E, idx, -step * 20 * share[:, None] * down[who])
        rng.shuffle(learn)
    table = E @ W

    z = np.array([(table[i] * (c / max(c.sum(), 1))[:, None]).sum(0) + b for i, c in (features[j] for j in held)])
    y = labels[held]
    scales = np.geomspace(0.25, 16, 49)

    def loss(s: float) -> float:
        t = z * s
        t -= t.max(1, keepdims=True)
        return float((np.log(np.exp(t).sum(1)) - t[np.arange(len(y)), y]).mean())

    scale = float(min(scales, key=loss))
    p = np.exp(z * scale - (z * scale).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    score, wrong = p.max(1), p.argmax(1) != y
    down = np.argsort(-score, kind="stable")
    ok = np.flatnonzero(np.cumsum(wrong[down]) <= max_error * np.arange(1, len(down) + 1))
    all_ok = len(ok) and ok[-1] == len(down) - 1
    threshold = 0.0 if all_ok or not len(ok) else float(score[down[ok[-1]]])
    return Model(langs, (table * scale).astype(np.float32), (b * scale).astype(np.float64), min(max(threshold, 0.5), 0.999) if k > 1 else 0.0)


def counted(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct buckets and their counts."""
    raw, offsets = as_bytes(texts)
    out = []
    for i in range(len(offsets) - 1):
        n = np.zeros(BUCKETS, np.int64)
        for a in range(offsets[i], offsets[i + 1], 8 * STEP):
            part, _ = _spaced(raw[a : min(offsets[i + 1], a + 8 * STEP)], np.array([0, min(offsets[i + 1], a + 8 * STEP) - a]))
            for _, bucket in gram_buckets(part):
                n += np.bincount(bucket, minlength=BUCKETS)
        k = np.flatnonzero(n)
        out.append((k.astype(np.uint16), n[k].astype(np.float32)))
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1200, max_langs: int = 500, max_error: float = 0.02, max_bytes: int = 192 << 20) -> Model:
    """A model from at most per_lang rows of each of the max_langs most frequent languages, and max_bytes of their counts."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("l is not null and t is not null")
    totals = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_langs).collect()
    if not totals:
        return train([], np.zeros(0, np.int64), [])
    # one scan: each language has its own rate
    rate = F.lit(0)
    for r in totals:
        rate = F.when(F.col("l") == r["l"], F.lit(int(min(1.0, 0.9 * per_lang / r["count"] if r["count"] > per_lang else 1.0) * (1 << 32)))).otherwise(rate)
    rows = rows.filter(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 32)) < rate)

    @F.arrow_udf("struct<idx:binary,n:binary>")
    def grams(t: pa.Array) -> pa.Array:
        got = counted(t)
        return pa.StructArray.from_arrays([pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([n.tobytes() for _, n in got], pa.binary())], ["idx", "n"])

    sample = written(rows.select("k", "l", grams("t").alias("g")).select("k", "l", "g.idx", "g.n"), "language-sample")
    got = _within(sample, max_bytes).select("k", "l", "idx", "n").toArrow().to_pandas().sort_values(["l", "k"], kind="stable")
    discard(sample)
    got = got.groupby("l", sort=True).head(per_lang)
    langs = sorted(got["l"].unique())
    number = {x: i for i, x in enumerate(langs)}
    features = [(np.frombuffer(i, np.uint16), np.frombuffer(n, np.float32)) for i, n in zip(got["idx"], got["n"], strict=True)]
    return train(features, got["l"].map(number).to_numpy(np.int64), langs, max_error=max_error)


#: Parts of a language's sample, by hash, of which as many are taken as fit.
PARTS = 4096


def _within(sample: DataFrame, max_bytes: int) -> DataFrame:
    """The sample, or where it is larger than so many bytes, of each language as many parts as its equal share of them holds."""
    sized = sample.withColumns({"size": F.octet_length("idx") + F.octet_length("n"), "part": F.pmod(F.xxhash64("k", F.lit(11)), F.lit(PARTS))})
    total = sized.agg(F.sum("size"), F.count_distinct("l")).first()
    if (total[0] or 0) <= max_bytes:
        return sample
    order = Window.partitionBy("l").orderBy("part")
    upto = sized.groupBy("l", "part").agg(F.sum("size").alias("bytes")).withColumn("upto", F.sum("bytes").over(order))  # PARTS rows a language
    fits = upto.filter(F.col("upto") <= max_bytes // total[1]).select("l", "part")
    return sized.join(F.broadcast(fits), ["l", "part"], "left_semi")  # PARTS x max_langs pairs at most


def predictor(docs: DataFrame, model: Model):
    """A function of a text column that gives struct<lang, score, rejected>."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x max_langs floats at most

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(t: pa.Array) -> pa.Array:
        lang, score, no = shared.value.predict(t)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())], ["lang", "score", "rejected"])

    return predict.asNondeterministic()  # else a filter on its result would run it twice


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    return predictor(docs, model)(F.col(text))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, with their own columns only, whose language the model doesn't reject."""
    own = docs.columns
    mark = free_name(docs, "_ratelens_language")
    return docs.withColumn(mark, identify(docs, model, text)).filter(~F.col(f"{mark}.rejected")).select(*[F.col(f"`{c}`") for c in own])


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows outside the held-out fold."""
    return docs.filter(fold(key, 4) != 2)
