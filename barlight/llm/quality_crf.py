"""Document quality from a linear-chain conditional random field over the lines.

Every line of a text is good or bad. Its potentials read features of the line and of its two neighbours; a transition
matrix links neighbouring labels. Forward-backward gives each line's marginal probability of being good, and their
mean weighted by line length (plus one), calibrated on the training documents by a monotone logistic curve, is the
document's score. Lines take the label of their document to train on; the
training sample is bounded by `sample_docs` documents, those with the smallest hash of their id. Every whole text is scored.

Defined cases: null text is empty, an empty text is one empty line; without training documents of both labels the
weights stay zero and every score is one half; a document with several labels is trained on under each; repeated rows
are scored each by themselves; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.shingles import U, mix, powers

CLASSES = ("upper", "lower", "digit", "symbol", "mark", "other", "space")
FEATURES = ("bias", "size", *CLASSES, "word_size", "ends_closed", "again", "empty", "stutter", "seen", "short", "foreign")
D = len(FEATURES)
CHUNK = 400_000  # characters whose features are computed at once


@lru_cache(1)
def char_classes() -> np.ndarray:
    table = np.full(0x110000, 5, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = 6 if ch.isspace() else 0 if ch.isupper() else 1 if ch.isalpha() else 2 if ch.isdigit() else 5
    table[0x3000:] = 1
    table[[ord(c) for c in "#*$%&|<>"]] = 3
    table[[ord(c) for c in "!?"]] = 4
    return table


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of texts (lines x D), characters of each, and lines of each text."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = char_classes()[codes]
    ends = np.concatenate([np.flatnonzero(codes == 10), [len(codes)]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    n_lines = np.array([t.count("\n") + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts)), n_lines)
    line_of = lambda at: np.searchsorted(ends, at, "right")
    x = np.zeros((len(size), D))
    safe = np.maximum(size, 1)
    x[:, 0] = 1
    x[:, 1] = np.log1p(size) / 8
    for k in range(len(CLASSES)):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        x[:, 2 + k] = (total[ends] - total[starts]) / safe
    edge = np.flatnonzero(np.diff(np.concatenate([[True], kinds == 6, [True]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]  # words: runs without white space
    n_words = np.zeros(len(size))
    if len(first):
        kept = np.flatnonzero(kinds != 6)
        length = last - first
        place = kept - np.repeat(first, length)
        offset = np.concatenate([[0], np.cumsum(length)[:-1]])
        word = mix(np.add.reduceat((codes[kept].astype(U) + U(1)) * powers()[place % 4096], offset) + length.astype(U))
        line = line_of(first)
        n_words = np.bincount(line, minlength=len(size)).astype(float)
        many = np.maximum(n_words, 1)
        x[:, 9] = np.bincount(line, weights=length, minlength=len(size)) / many / 10
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (line[1:] == line[:-1])])
        x[:, 13] = np.bincount(line, weights=again, minlength=len(size)) / many
        fresh = np.unique(mix(word ^ mix(doc[line].astype(U))), return_index=True)[1]
        seen = np.ones(len(word), bool)
        seen[fresh] = False
        x[:, 14] = np.bincount(line, weights=seen, minlength=len(size)) / many
        sums = np.zeros(len(size), U)  # the sum of scrambled (word, place) is the line, for all that matters here
        np.add.at(sums, line, mix(word + (np.arange(len(word)) - np.concatenate([[0], np.cumsum(n_words)[:-1]]).astype(np.int64)[line]).astype(U)))
        fresh = np.unique(mix(sums ^ mix(doc.astype(U))), return_index=True)[1]
        same = np.ones(len(size), bool)
        same[fresh] = False
        x[:, 11] = same & (n_words > 0)
    closing = np.zeros(len(size), bool)
    closing[size > 0] = np.isin(codes[ends[size > 0] - 1], [ord(c) for c in ".!?:\"')"])
    x[:, 10] = closing
    x[:, 12] = n_words == 0
    x[:, 15] = (n_words > 0) & (n_words < 4)
    total = np.concatenate([[0], np.cumsum(codes > 127)])
    x[:, 16] = (total[ends] - total[starts]) / safe
    return x, size, n_lines


def with_neighbours(x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it in its text (zeros where there is none)."""
    out = np.zeros((len(x), 3 * D))
    out[:, :D] = x
    stops = np.cumsum(n_lines)
    out[1:, D : 2 * D] = x[:-1]
    out[(stops - n_lines), D : 2 * D] = 0
    out[:-1, 2 * D :] = x[1:]
    out[stops - 1, 2 * D :] = 0
    return out


@dataclass
class Crf:
    """weights: of the good label over the bad one; links: log-potentials of (label, next label).

    slope and shift turn the logit of a text's mean marginal into that of its label, as fitted on the training texts.
    """

    weights: np.ndarray
    links: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, node: np.ndarray, n_lines: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Probability that each line is good, and with pairs the expected count of each (label, next label)."""
        order = np.argsort(-n_lines, kind="stable")
        begin = (np.cumsum(n_lines) - n_lines)[order]
        lengths = n_lines[order]
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if len(lengths) else []
        e = np.exp(np.clip(node, -30, 30))
        a = np.exp(self.links)
        forward = np.zeros((len(node), 2))
        for t, n in enumerate(alive):
            at = begin[:n] + t
            f = forward[at - 1] @ a if t else np.ones((n, 2))
            f[:, 1] *= e[at]
            forward[at] = f / f.sum(1, keepdims=True)
        good, counts = np.zeros(len(node)), np.zeros((2, 2))
        back = np.ones((len(lengths), 2))
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            at = begin[:n] + t
            p = forward[at] * back[:n]
            good[at] = p[:, 1] / p.sum(1)
            b = back[:n].copy()
            b[:, 1] *= e[at]
            if t:
                if pairs:
                    both = forward[at - 1][:, :, None] * a[None] * b[:, None, :]
                    counts += (both / both.sum((1, 2), keepdims=True)).sum(0)
                b = b @ a.T
                back[:n] = b / b.sum(1, keepdims=True)
        return good, counts if pairs else None


    def scores(self, node: np.ndarray, sizes: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and how many of its lines are rather bad than good."""
        good, _ = self.marginals(node, n_lines)
        doc = np.repeat(np.arange(len(n_lines)), n_lines)
        weight = sizes + 1.0
        mean = np.bincount(doc, weights=weight * good, minlength=len(n_lines)) / np.maximum(np.bincount(doc, weights=weight, minlength=len(n_lines)), 1)
        return 1 / (1 + np.exp(-(self.slope * logit(mean) + self.shift))), np.bincount(doc[good < 0.5], minlength=len(n_lines))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def calibrate(crf: Crf, mean: np.ndarray, label: np.ndarray, steps: int = 50) -> None:
    """Logistic regression of the labels, each as heavy as the other, on the logit of the mean (Newton, with a small ridge)."""
    x = np.stack([logit(mean), np.ones(len(mean))], 1)
    w = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ theta))
        grad = x.T @ (w * (p - label)) + 1e-3 * (theta - [1.0, 0.0])
        theta = theta - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    if np.isfinite(theta).all() and theta[0] > 0:
        crf.slope, crf.shift = map(float, theta)


def fit(x: np.ndarray, sizes: np.ndarray, n_lines: np.ndarray, label: np.ndarray, steps: int = 120, ridge: float = 1.0) -> Crf:
    """x with neighbours; label of each text. Gradient ascent (Adam) on the conditional likelihood."""
    crf = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if len(set(label.tolist())) < 2:
        return crf
    y = np.repeat(label, n_lines).astype(float)
    observed = np.zeros((2, 2))
    for k in (0, 1):
        observed[k, k] = (n_lines[label == k] - 1).sum()
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        crf.weights, crf.links = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs = crf.marginals(x @ crf.weights, n_lines, True)
        grad = np.concatenate([x.T @ (y - good), (observed - pairs).ravel()]) - ridge * theta
        grad /= len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -3, 3)  # links never outweigh what the lines say
    crf = Crf(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())
    raw, _ = crf.scores(x @ crf.weights, sizes, n_lines)
    calibrate(crf, raw, label)
    return crf


def chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def is_training(doc_id: Column) -> Column:
    """Rows without id too: they have no label, so none is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) != 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, doc_id: str = "doc_id", text: str = "text") -> Crf:
    """labels: doc_id, quality. Half of the sample is taken from each label, as far as there are so many."""
    marks = labels.where(F.col("quality").isin(0, 1) & is_training(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).distinct()
    turn = F.xxhash64(F.col("_id").cast("string"))
    sample = [marks.where(F.col("label") == k).orderBy(turn, "_id").limit(sample_docs // 2) for k in (0, 1)]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))  # at most sample_docs rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = [t or "" for t in batch.column("text").to_pylist()], batch.column("label").to_pylist()
            for part in chunks(texts):
                x, _, n = line_features(part)
                cut = np.split(x.astype(np.float32), np.cumsum(n)[:-1])
                now, labels = labels[: len(part)], labels[len(part) :]
                yield pa.RecordBatch.from_arrays([pa.array(now, pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["label", "x"])

    given = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(chosen, "_id").select("_id", "text", F.col("label").cast("int").alias("label"))
    one = given.groupBy("_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of several texts of an id always the same one
    rows = one.select("text", "label").mapInArrow(features, "label int, x binary").collect()  # bounded by sample_docs
    if not rows:
        return Crf(np.zeros(3 * D), np.zeros((2, 2)))
    rows.sort(key=lambda r: (r.label, bytes(r.x)))
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, D) for r in rows]
    n_lines = np.array([len(p) for p in parts])
    x = np.concatenate(parts).astype(float)
    sizes = np.expm1(8 * x[:, 1])  # the size feature, turned back
    return fit(with_neighbours(x, n_lines), sizes, n_lines, np.array([r.label for r in rows]))


def score(docs: DataFrame, crf: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_lines, n_bad_lines (marginal under one half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sizes, counts = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in chunks([t.as_py() or "" for t in batch.column("text")]):
                x, size, n = line_features(part)
                node.append(with_neighbours(x, n) @ crf.weights)
                sizes.append(size)
                counts.append(n)
            n_lines = np.concatenate(counts)
            mean, bad = crf.scores(np.concatenate(node), np.concatenate(sizes), n_lines)
            columns = [batch.column("doc_id"), pa.array(mean), pa.array(n_lines.astype(np.int64)), pa.array(bad.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_lines", "n_bad_lines"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, score double, n_lines long, n_bad_lines long")
