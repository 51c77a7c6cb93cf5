"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad.  A line's features are its own and those of its neighbours; a transition matrix ties the
labels of consecutive lines.  The field is fitted to the labels of whole documents (each line gets its document's), on a
bounded sample.  A document's quality is the mean of its lines' marginals from the forward-backward pass, weighted by
the lines' lengths, and scaled by a logistic function that is fitted to the same sample.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.base import held_out, map_arrow, release, small_batches, trim

OWN = 18  # features of a line itself


def _class(x: str) -> int:
    """The class of a character: 0 lower, 1 upper, 2 digit, 3 space, 4 punctuation, 5 symbol, 6 other."""
    if x.isalpha():
        return 1 if x.isupper() else 0
    if x.isdigit():
        return 2
    if x.isspace():
        return 3
    if x in ".,;:!?'\"()-’“”":
        return 4
    return 5 if x.isprintable() else 6


@lru_cache(1)
def _classes() -> np.ndarray:
    return np.array([_class(chr(c)) for c in range(0x10000)], np.uint8)


def _kinds(points: np.ndarray) -> np.ndarray:
    """The class of each code point; those beyond the table are rare, and looked at one by one."""
    kinds = _classes()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        some, which = np.unique(points[far], return_inverse=True)
        kinds[far] = np.array([_class(chr(c)) for c in some.tolist()], np.uint8)[which]
    return kinds


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line of a whole text, of shape (lines, 3 * OWN + 3), and the lines' weights (their lengths, 1 at least).

    A text has one line at least; an empty one has zeros for its own features.
    """
    lines = _lines(text)
    n = len(lines)
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds(points)
    length = np.fromiter(map(len, lines), np.int64, n)
    at = np.repeat(np.arange(n), length + 1)[:-1] if n else np.zeros(0, np.int64)
    share = np.bincount(at * 7 + kinds, minlength=n * 7).reshape(n, 7)[:, :7].astype(float)
    share[:-1, 3] -= 1  # the line feed itself
    x = np.zeros((n, OWN))
    some = np.maximum(length, 1)
    x[:, :7] = share / some[:, None]
    seen: dict[str, int] = {}
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        if k:
            distinct = len(set(words))
            follow = sum(map(str.__eq__, words, words[1:]))
            bare = sum(map(str.isalpha, words))
            shorts = sum(1 for w in words if len(w) <= 3)
            x[i, 7:14] = (np.log1p(k), distinct / k, follow / k, bare / k, shorts / k, (length[i] - k + 1) / k / 10, words[0][0].isupper())
            x[i, 14] = line.rstrip()[-1] in ".!?"
            x[i, 15] = line.count("|") / k
            x[i, 16] = line.count("http") / k + line.count("@") / k
        x[i, 17] = line in seen
        seen[line] = i
    zero = np.zeros((1, OWN))
    before, after = np.concatenate((zero, x[:-1])), np.concatenate((x[1:], zero))
    ends = np.zeros((n, 3))
    ends[:, 0], ends[0, 1], ends[-1, 2] = 1, 1, 1
    return np.concatenate((x, before, after, ends), axis=1), np.maximum(length, 1).astype(float)


class Chains:
    """Whole chains of any lengths, laid out line by line: the first lines of all chains, then the second ones, and so on.

    Chains are ordered from the longest on, so that those that have a line t are the first of those that have a line before.
    """

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.alive = np.searchsorted(-self.lengths, -np.arange(int(lengths.max(initial=0))), side="left")  # chains with a line t
        self.starts = np.r_[0, np.cumsum(self.alive)]
        begins = np.r_[0, np.cumsum(lengths)][:-1][self.order]
        #: Where the lines are in the chains run together, and the chain (in order) of each.
        self.lines = np.concatenate([begins[:n] + t for t, n in enumerate(self.alive.tolist())]) if len(lengths) else np.zeros(0, np.int64)
        self.chain = np.concatenate([np.arange(n) for n in self.alive.tolist()]) if len(lengths) else np.zeros(0, np.int64)

    def forward_backward(self, good: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, the transition marginals of each chain (chains, 2, 2), and log partition functions.

        good: scores of the state good by line, those of bad are 0.  Messages are scaled to a sum of 1 at every line.
        """
        e, low = np.exp(transition), np.minimum(-good, 0)
        g = np.stack((np.exp(low), np.exp(low + good)), axis=1)  # both states, divided by the greater
        f, b, scale = np.empty_like(g), np.empty_like(g), np.empty(len(g))
        z = np.zeros(len(self.lengths))
        pairs = np.zeros((len(self.lengths), 2, 2))
        for t, n in enumerate(self.alive.tolist()):
            at = self.starts[t]
            m = g[at : at + n] if not t else f[self.starts[t - 1] : self.starts[t - 1] + n] @ e * g[at : at + n]
            scale[at : at + n] = m.sum(axis=1)
            f[at : at + n] = m / scale[at : at + n, None]
            z[:n] += np.log(scale[at : at + n]) - low[at : at + n]
        ahead = 0
        for t in range(len(self.alive) - 1, -1, -1):
            at, n = self.starts[t], self.alive[t]
            b[at : at + n] = 1.0
            if ahead:
                one = self.starts[t + 1]
                m = g[one : one + ahead] * b[one : one + ahead] / scale[one : one + ahead, None]
                b[at : at + ahead] = m @ e.T
                pairs[:ahead] += f[at : at + ahead, :, None] * e * m[:, None, :]
            ahead = n
        return (f * b)[:, 1], pairs, z


def likelihood(x: np.ndarray, chains: Chains, y: np.ndarray, weight: np.ndarray, params: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted negative log likelihood of chains whose lines all have their chain's label, and its gradient.

    x: features by line, y and weight by chain, both as chains orders them; params: a weight a feature, then transitions.
    """
    width, steps = x.shape[1], chains.lengths - 1
    good, transition = x @ params[:width].astype(x.dtype), params[width:].reshape(2, 2)
    good = good.astype(float)
    p, pairs, z = chains.forward_backward(good, transition)
    own = weight[chains.chain]
    loss = (weight * z).sum() - (own * y[chains.chain] * good).sum() - (weight * steps * transition[y, y]).sum()
    np.subtract.at(pairs, (np.arange(len(y)), y, y), steps)
    gradient = np.concatenate(((own * (p - y[chains.chain])).astype(x.dtype) @ x, (weight[:, None, None] * pairs).sum(axis=0).ravel()))
    return float(loss), gradient


class Field:
    """A fitted field: standardised features, weights of the state good, transitions, and the final scale."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, transition: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.mean, self.scale, self.weights, self.transition, self.slope, self.shift = mean, scale, weights, transition, slope, shift

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """P(good) for each line of one text."""
        return _chain(((features - self.mean) / self.scale) @ self.weights, self.transition)

    def raw(self, text: str | None) -> float:
        x, w = line_features(text)
        return float((self.marginals(x) * w).sum() / w.sum())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(self.raw(text)) + self.shift, -30, 30))))


def _logit(p: float | np.ndarray) -> float | np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _chain(good: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(good) of each line of one chain, from the lines' scores (those of bad are 0), in plain floats."""
    e = np.exp(transition).tolist()
    g = np.exp(np.clip(good, -30, 30)).tolist()
    f, a, c = [], 1.0, 1.0
    for i, x in enumerate(g):
        if i:
            a, c = a * e[0][0] + c * e[1][0], (a * e[0][1] + c * e[1][1]) * x
        else:
            c = x
        s = a + c
        a, c = a / s, c / s
        f.append(c)
    out, a, c = [0.0] * len(g), 1.0, 1.0
    for i in range(len(g) - 1, -1, -1):
        good_, bad = f[i] * c, (1 - f[i]) * a
        out[i] = good_ / (good_ + bad)
        a, c = e[0][0] * a + e[0][1] * g[i] * c, e[1][0] * a + e[1][1] * g[i] * c
        s = a + c
        a, c = a / s, c / s
    return np.array(out)


def fit(texts: list[str | None], labels: list[int], *, rounds: int = 150, penalty: float = 1e-3) -> Field:
    """Fit a field by conditional likelihood (Adam over the whole sample), then the logistic scale of document scores.

    Every text is one chain of all its lines.  Classes count equally, however often each occurs, and so do the texts of a class.
    With labels of one class only (or none) the field scores every text by that class.
    """
    width = 3 * OWN + 3
    if len(set(labels)) < 2:
        only = labels[0] if labels else 1
        return Field(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, 3.0 if only else -3.0)
    got = [line_features(t) for t in texts]
    every = np.concatenate([x for x, _ in got])
    mean, scale = every.mean(axis=0), every.std(axis=0)
    mean[-3], scale[scale < 1e-9] = 0, 1  # the constant stays
    chains = Chains(np.array([len(x) for x, _ in got]))
    x = ((every[chains.lines] - mean) / scale).astype(np.float32)
    y = np.array(labels)[chains.order]
    weight = (len(labels) / 2 / np.bincount(y, minlength=2))[y] / chains.lengths
    weight /= weight.sum()
    params, first, second = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, rounds + 1):
        gradient = likelihood(x, chains, y, weight, params)[1] + penalty * params
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        params -= 0.1 * (1 - step / (rounds + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    field = Field(mean, scale, params[:width], params[width:].reshape(2, 2))
    raw = _logit(np.array([(field.marginals(f) * w).sum() / w.sum() for f, w in got]))
    truth = np.array(labels, float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's steps of a logistic regression with one variable and a small penalty
        p = 1 / (1 + np.exp(-(slope * raw + shift)))
        g = np.array([((p - truth) * raw).sum() + 0.1 * (slope - 1), (p - truth).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * raw * raw).sum() + 0.1, (v * raw).sum()], [(v * raw).sum(), v.sum()]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(h, g)
    field.slope, field.shift = max(float(slope), 0.0), float(shift)
    return field


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, seed: int = 7) -> Field:
    """Fit a field on about per_class labelled texts of either class: those with the smallest hashes of their ids.

    per_class bounds what is learnt from and what the driver gets (a mean; a class with fewer texts gives all of them).  Rows whose
    crc32 of the id modulo 5 is 0 teach nothing, nor do rows without a label of 0 or 1, an id or a text.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out("id", 5, 0))
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not n:
        return fit([], [])
    least = F.when(F.col("y") == 1, per_class / n.get(1, 1)).otherwise(per_class / n.get(0, 1))
    drawn = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53)) < least)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    # The drawn ids are bounded by twice per_class.
    # A repeated id teaches its least text, so that the sample stays as small as its ids.
    sample = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y").collect()
    sample = sorted((tuple(r) for r in sample), key=lambda r: (r[0], r[1]))
    return fit([r[1] for r in sample], [r[2] for r in sample])


def score(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better), one row per input row; whole texts are read.

    A null text counts as empty, and an empty one is a line without words.  Null and repeated ids stay as they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": [field.score(t) for t in batch.column("text").to_pylist()]}

    return map_arrow(rows, run, "doc_id long,score double")


def classify(docs: DataFrame, labels: DataFrame, *, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= least)."""
    scored = score(docs, fit_quality(docs, labels, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, *, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose score is least or more, with their columns as they are."""
    field = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **options)
    names, target = docs.columns, docs.schema
    position = names.index(text_col)

    def run(batches):
        release()
        for batch in batches:
            texts = batch.column(position).to_pylist()
            yield batch.filter(pa.array([field.score(t) >= least for t in texts], pa.bool_()))
        trim()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, target)
