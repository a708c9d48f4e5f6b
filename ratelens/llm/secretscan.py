"""Secret scans: character Markov models of random strings and of ordinary identifiers.

Base spans come from three fixed patterns (assigned values, access keys, long hex runs). The method adds
spans: every run of 16 or more token characters that touches no base span is scored by the log-likelihood
ratio of two first-order Markov models over characters, one of random strings and one of ordinary
identifiers; it is a ``markov`` span where the ratio outweighs the prior odds of a secret. The models are
trained from labelled samples: all runs of a bounded sample of at most ``max_docs`` documents, labelled
random where they are values of base spans and ordinary elsewhere, and random strings drawn with a fixed
seed over the usual alphabets, which also serve where the sample has few. Half of the ordinary runs set
the least ratio so that at most one in a thousand passes. Ordinary runs also serve in capitals.

Texts are scanned whole. Offsets count code points, ends are exclusive.

Defined results: null and empty texts have no spans. Overlapping base spans of different kinds all stay.
Repeated rows give equal results. Other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import sample_at_most, small_batches

KINDS = ("assign", "access", "hex", "markov")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
ORDINARY = ("internationalization", "get_user_profile_by_id", "configurationManager", "https-connection-pool", "example_function_name", "responsibilities-and-rights", "MAX_BUFFER_LENGTH_BYTES", "src/main/resources/messages", "version-2024-01-15-release", "------------------------", "========================", "________________________")


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the fixed patterns, in order of kind and place."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def rest_runs(text: str, base: list[tuple[str, int, int, int]]) -> list[re.Match]:
    """Runs that touch no base span."""
    taken = sorted((s, e) for _, s, e, _ in base)
    out, k = [], 0
    far = 0  # the largest end among spans that begin before the run's end
    for m in RUN.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            far = max(far, taken[k][1])
            k += 1
        if far <= m.start():
            out.append(m)
    return out


@dataclass
class Model:
    """Log-likelihood ratios: of a first character, and of a character after another."""

    start: np.ndarray
    step: np.ndarray
    least: float

    def __post_init__(self) -> None:
        self.first = {chr(a): float(self.start[a]) for a in range(128)}
        self.next = {chr(a) + chr(b): float(self.step[a, b]) for a in range(33, 127) for b in range(33, 127)}
        self.memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"start": self.start, "step": self.step, "least": self.least}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def ratio(self, run: str) -> float:
        """Of the whole run, random over ordinary, in nats."""
        got = self.memo.get(run)
        if got is None:
            step = self.next
            got = self.first[run[0]] + sum(step[run[i : i + 2]] for i in range(len(run) - 1))
            if len(self.memo) < 100_000 and len(run) < 64:
                self.memo[run] = got
        return got

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        base = base_spans(text)
        out = [(k, s, e) for k, s, e, _ in base]
        out += [("markov", m.start(), m.end()) for m in rest_runs(text, base) if self.ratio(m[0]) > self.least]
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _counts(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    first, step = np.zeros(128), np.zeros((128, 128))
    for r in runs:
        x = np.frombuffer(r.encode("ascii", "replace"), np.uint8)
        first[x[0]] += 1
        np.add.at(step, (x[:-1], x[1:]), 1)
    return first, step


def random_runs(n: int, seed: int = 1) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(ALPHABETS[i % len(ALPHABETS)]), int(rng.integers(16, 48)))) for i in range(n)]


def train(random: list[str], ordinary: list[str], prior: float = 1e-4, drawn: int = 3000) -> Model:
    """Both models with additive smoothing towards their own character frequencies."""
    ordinary = sorted(set(ordinary)) or sorted(ORDINARY)
    learn, held = ordinary[::2] + list(ORDINARY), ordinary[1::2]
    learn = learn + [r.upper() for r in learn]  # identifiers are as ordinary in capitals
    held = held + [r.upper() for r in held]
    logs = []
    for runs in (random_runs(drawn) + sorted(set(random)), learn):
        first, step = _counts(runs)
        used = np.zeros(128)
        used[33:127] = 1
        share = step.sum(0) + used * 0.5
        share /= share.sum()
        step = step + 8 * share[None, :]
        first = first + 8 * share
        with np.errstate(divide="ignore"):
            logs.append((np.log(first / first.sum()), np.log(step / step.sum(1, keepdims=True))))
    with np.errstate(invalid="ignore"):
        start, step = np.nan_to_num(logs[0][0] - logs[1][0]), np.nan_to_num(logs[0][1] - logs[1][1])
    model = Model(start, step, float(np.log((1 - prior) / prior)))
    if held:
        model.least = max(model.least, float(np.quantile([model.ratio(r) for r in held], 0.999)))
    model.memo.clear()
    return model


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", max_docs: int = 3000) -> Model:
    """A model from the runs of at most max_docs documents."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    some = sample_at_most(rows, "k", max_docs, rows.select("k").count())

    @F.arrow_udf("struct<random:array<string>,ordinary:array<string>>")
    def labelled(t: pa.Array) -> pa.Array:
        out = []
        for text in t.to_pylist():
            base = base_spans(text)
            out.append({"random": [v for v in (text[a:e] for _, _, e, a in base) if RUN.fullmatch(v)], "ordinary": sorted({m[0] for m in rest_runs(text, base)})})
        return pa.array(out, pa.struct([("random", pa.list_(pa.string())), ("ordinary", pa.list_(pa.string()))]))

    got = some.select("k", labelled("t").alias("r")).select("k", "r.*").orderBy("k").limit(max_docs).collect()
    return train([x for r in got for x in r["random"]], [x for r in got for x in r["ordinary"]])


def scanner(docs: DataFrame, model: Model):
    """A function of a text column that gives array<struct<kind, start, end>>, by start, then kind."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 128 x 128 numbers

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(t: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in m.spans(x)] for x in t.to_pylist()], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return scan.asNondeterministic()


def scanned(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with an array column ``secret_spans``, in place of one of that name."""
    return docs.withColumn("secret_spans", scanner(docs, model)(F.col(text)))
