"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, under a linear hinge-loss model.

Indicators: byte 1- to 3-grams, words and word pairs (hashed), and n-grams of one word over and over, for some n. The
ratios and the model are fitted on a bounded sample of labelled rows; scoring covers every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampline.llm.common import hold, small_batches
from ampline.llm.dedup_runs import BASE, Hashes, _mix

BITS = 18
#: Labelled rows that are fitted at most (those with the least hashes of their keys, a sample free of order).
SAMPLE = 8_000
#: Bytes hashed at a time; words, pairs and runs go on from one piece to the next.
PIECE = 1 << 20
#: Lengths n of "the same word n times" that are indicators of their own, whichever word it is.
RUNS = (2, 3, 5, 10)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(raw: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct indicator numbers of a text of any size: those of the whole text, however it is cut into pieces."""
    if not raw:
        return np.empty(0, np.int64)
    size = 1 << bits
    seen = np.zeros(size + len(RUNS), bool)
    mask, shift, top = np.uint32((1 << bits) - 1), np.uint32(32 - bits), np.uint64(64 - bits)
    open_sum, open_len = np.uint64(0), 0  # of a word that goes on in the next piece
    last, streak, longest = np.empty(0, np.uint64), 0, 0  # the word before, and how often it has come in a row
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE + 2, len(raw)) if at == 0 else min(PIECE + 2, len(raw) - at + 2), max(0, at - 2)).astype(np.uint32)
        seen[(b * np.uint32(2654435761) >> shift) & mask] = True
        if len(b) > 1:
            two = b[:-1] << np.uint32(8) | b[1:]
            seen[((two + np.uint32(0x10000)) * np.uint32(2654435761) >> shift) & mask] = True
            three = (two[:-1] << np.uint32(8) | b[2:]) + np.uint32(0x2000000)
            seen[(three * np.uint32(2654435761) >> shift) & mask] = True
        data = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
        edge = np.flatnonzero(np.concatenate([[True], SPACE[data], [True]]))
        begin, stop = edge[:-1], edge[1:] - 1
        ok = stop > begin
        begin, stop = begin[ok], stop[ok]
        sums = Hashes(data).sums
        part, length = (sums[stop] - sums[begin]) * Hashes.down[begin], (stop - begin).astype(np.uint64)
        if open_len:
            if len(begin) and begin[0] == 0:
                part[:1] = open_sum + part[:1] * np.uint64(pow(int(BASE), open_len, 1 << 64))
                length[0] += np.uint64(open_len)
            else:
                part, length = np.append(open_sum, part), np.append(np.uint64(open_len), length)
            open_len = 0
        if at + PIECE < len(raw) and len(stop) and stop[-1] == len(data):
            open_sum, open_len = part[-1], int(length[-1])
            part, length = part[:-1], length[:-1]
        if not len(part):
            continue
        w = _mix(part + length)
        seen[(w >> top).astype(np.int64)] = True
        w = np.concatenate([last, w])
        pair = (w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        seen[(pair >> top).astype(np.int64)] = True
        runs = np.diff(np.concatenate([[0], np.flatnonzero(w[1:] != w[:-1]) + 1, [len(w)]]))
        if len(last):
            runs[0] += streak - 1
        last, streak, longest = w[-1:], int(runs[-1]), max(longest, int(runs.max()))
    for i, n in enumerate(RUNS):
        seen[size + i] = longest >= n
    return np.flatnonzero(seen)


def dimension(bits: int = BITS) -> int:
    return (1 << bits) + len(RUNS)


@dataclass
class Model:
    weights: np.ndarray  # of the scaled indicators, ratio included
    bias: float
    slope: float  # of the probability's logit
    offset: float
    bits: int

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum() / np.sqrt(max(1, len(f))) + self.bias)

    def score(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(raw, self.bits)) + self.offset, -35, 35))))


class Rows:
    """Indicator numbers of many texts in one array."""

    def __init__(self, each: list[np.ndarray]):
        self.ends = np.cumsum([0, *map(len, each)])
        self.flat = np.concatenate([np.empty(0, np.int32), *each], dtype=np.int32, casting="unsafe")

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]


def log_ratios(rows: Rows, use: np.ndarray, labels: np.ndarray, bits: int = BITS, alpha: float = 1.0) -> np.ndarray:
    """Log of the ratio of smoothed, normalised indicator counts of the two classes, over the rows in use."""
    counts = np.full((2, dimension(bits)), alpha)
    for i in use.tolist():
        counts[labels[i], rows[i]] += 1  # a row's indicators differ
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def dual_descent(rows: Rows, use: np.ndarray, ratio: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 0, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with L1 hinge loss by dual coordinate descent over the rows in use; the bias is a constant feature.

    A row's values are its indicators' ratios over the root of their number, worked out when the row is visited, so
    that memory holds the indicators once.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    alpha, norm = np.zeros(len(use)), np.zeros(len(use))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(use)).tolist():
            f = rows[use[i]]
            x = ratio[f] / np.sqrt(max(1, len(f)))
            norm[i] = norm[i] or float(x @ x) + 1.0
            g = y[i] * (w[f] @ x + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * x
                bias += step
                most = max(most, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if most < tol:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps on smoothed targets."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, np.log((n1 + 1) / (n0 + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        r, v = p - t, p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, [(r * margin).sum(), r.sum()])
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: Rows, labels: np.ndarray, bits: int = BITS, cost: float = 0.1, epochs: int = 12) -> Model:
    """The model; without rows of both classes its score is the share of class 1 (smoothed) everywhere.

    The curve from margin to probability is fitted on rows held out from a first fit, the model then on all.
    """
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(dimension(bits)), 0.0, 0.0, float(np.log(share / (1 - share))), bits)

    def linear(use: np.ndarray) -> tuple[np.ndarray, float]:
        ratio = log_ratios(rows, use, labels, bits)
        w, bias = dual_descent(rows, use, ratio, np.where(labels[use] == 1, 1.0, -1.0), cost, epochs)
        return w * ratio, bias

    part = np.arange(len(rows)) % 4 == 0
    fold = [np.flatnonzero(~part), np.flatnonzero(part)]
    slope, offset = 1.0, 0.0
    if all(len(set(labels[f].tolist())) == 2 for f in fold):
        first = Model(*linear(fold[0]), 1.0, 0.0, bits)
        slope, offset = platt(np.array([first.margin(rows[i]) for i in fold[1]]), labels[fold[1]])
    return Model(*linear(np.arange(len(rows))), slope, offset, bits)


def labelled_features(df: DataFrame, text_col: str, label_col: str, bits: int) -> tuple[Rows, np.ndarray]:
    """Indicators of a bounded table's rows, gathered on the driver."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [features((t or "").encode(), bits).astype(np.int32).tobytes() for t in pdf["t"]]
            yield pd.DataFrame({"h": pdf["h"], "f": f, "y": pdf["y"]})

    got = df.select(F.col("__order").alias("h"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")).mapInPandas(rows, "h long, f binary, y int")
    out = sorted((r["h"], r["y"], bytes(r["f"])) for r in got.toLocalIterator())
    return Rows([np.frombuffer(f, np.int32) for _, _, f in out]), np.array([y for _, y, _ in out], int)


def train_quality(documents: DataFrame, labels: DataFrame, where: Column | None = None, text_col: str = "text", key_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on at most `sample` labelled rows (those of the least key hashes).

    where: which label rows may be learned from. Rows with a null key or label, and keys without a document, are left
    out; a null text is empty. Repeated rows of either table count as often as they meet. The sample's keys are broadcast
    (at most `sample` of them), so no text is shuffled.
    """
    small_batches(documents.sparkSession)
    known = labels if where is None else labels.where(where)
    known = known.select(F.col(key_col).alias("__id"), F.col(label_col).alias("__y")).dropna()
    chosen = known.withColumn("__order", F.xxhash64("__id")).orderBy("__order", "__y").limit(sample)
    own = documents.select(F.col(key_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), "__id")
    return fit(*labelled_features(own, "__t", "__y", bits), bits)


def score_quality(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is of class 1 (null: the empty text). A column named out is replaced; repeated rows
    get equal scores; a text of any length is read whole, in pieces."""
    small_batches(df.sparkSession)
    shared = hold(df.sparkSession.sparkContext.broadcast(model))  # 2^bits weights, whatever the corpus

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score((t or "").encode()) for t in texts], dtype="float64")

    return df.withColumn(out, scored(F.col(text_col)))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the key's text divides by 5. False for null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
