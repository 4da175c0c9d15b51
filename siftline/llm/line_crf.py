"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siftline.llm.common import held_out, labelled_sample

#: Most labelled rows of the fit.
FIT_ROWS = 2000
#: Own features of a line; the line before and the line after add theirs.
OWN = 11


def _byte_classes() -> np.ndarray:
    """One column per class of bytes."""
    b = np.arange(256)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    digit, upper, space = (b >= 48) & (b <= 57), (b >= 65) & (b <= 90), (b == 32) | ((b >= 9) & (b <= 13))
    table, loud = b == ord("|"), (b == ord("!")) | (b == ord("?"))
    usual = np.isin(b, [ord(c) for c in ".,;:'\"-()"])
    other = ~(letter | digit | space | table | loud | usual)
    return np.stack([letter, digit, upper, space, table, loud, other], axis=1).astype(np.float32)


_CLASSES = _byte_classes()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, each line's bytes, and the number of lines of each text (one at least)."""
    lines: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
        counts[i] = len(own)
        lines += own
    size = np.array([len(x) for x in lines], dtype=np.int64)
    codes = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)  # a line with its end is never empty
    starts = np.r_[0, np.cumsum(size + 1)[:-1]]
    share = np.empty((len(lines), _CLASSES.shape[1]), np.float32)
    for k in range(_CLASSES.shape[1]):
        share[:, k] = np.add.reduceat(_CLASSES[:, k][codes], starts)
    share[:, 3] -= 1  # the line's end
    share /= np.maximum(size, 1)[:, None]
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    own = [np.log1p(size) / 5, np.log1p(n) / 4, distinct / np.maximum(n, 1), (n > 0) * (distinct * 2 <= n)]
    return np.concatenate([share, np.stack(own, axis=1)], axis=1).astype(np.float32), size, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at a text's ends), and a constant."""
    first = np.zeros(len(own), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.r_[first[1:], True]
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1)


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return top + np.log1p(np.exp(-np.abs(a - b)))


def marginals(scores: np.ndarray, move: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and P(it is as the next line) where one follows, by the forward-backward algorithm.

    scores: of good over bad for each line; move: 2 by 2 transition scores (bad,
    good). All texts advance together, one line a step, longest texts first.
    """
    start = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    start, length = start[order], counts[order]
    ahead = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")  # texts with a line t
    forward, backward = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    for t, n in enumerate(ahead):
        at = start[:n] + t
        if t:
            f = forward[at - 1]
            forward[at, 0] = _log_add(f[:, 0] + move[0, 0], f[:, 1] + move[1, 0])
            forward[at, 1] = _log_add(f[:, 0] + move[0, 1], f[:, 1] + move[1, 1])
        forward[at, 1] += scores[at]
    for t in range(len(ahead) - 2, -1, -1):
        at = start[: ahead[t + 1]] + t
        b = backward[at + 1].copy()
        b[:, 1] += scores[at + 1]
        backward[at, 0] = _log_add(move[0, 0] + b[:, 0], move[0, 1] + b[:, 1])
        backward[at, 1] = _log_add(move[1, 0] + b[:, 0], move[1, 1] + b[:, 1])
    both = forward + backward
    total = _log_add(both[:, 0], both[:, 1])
    onward = backward[1:].copy()
    onward[:, 1] += scores[1:]
    stay = np.exp(forward[:-1] + np.diag(move) + onward - total[:-1, None]).sum(axis=1)
    stay[np.cumsum(counts)[:-1] - 1] = 0
    return np.exp(both[:, 1] - total), stay


class LineField:
    """The field's weights, and how a document's length-weighted share of good lines becomes its score."""

    def __init__(self) -> None:
        self.weights = np.zeros(3 * OWN + 1)
        self.move = np.zeros((2, 2))
        self.slope, self.base = 0.0, 0.0

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of P(good) over the lines of each text; an empty line weighs as one byte."""
        if not texts:
            return np.empty(0)
        own, size, counts = line_features(texts)
        good, _ = marginals(with_neighbours(own, counts) @ self.weights, self.move, counts)
        starts, weight = np.cumsum(counts) - counts, size + 1.0
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, texts: list[str | None]) -> np.ndarray:
        share = np.clip(self.shares(texts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.base)))


def fit_field(sample: pd.DataFrame, steps: int = 150) -> LineField:
    """Fit on labelled texts (columns text, label), every line taken to be as its text.

    Gradient ascent (Adam) on the chain's log-likelihood: label counts less their
    expectation under the marginals. Texts weigh alike, whatever their length. The
    document score is then a logistic fit on the logit of the good share. Without
    both labels the score is the share of good rows everywhere.
    """
    field = LineField()
    labels = sample["label"].to_numpy(dtype=float) if len(sample) else np.empty(0)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 1.0
        field.base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return field
    own, size, counts = line_features(list(sample["text"]))
    x = with_neighbours(own, counts).astype(float)
    y = np.repeat(labels, counts)
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))  # either label weighs half
    weight = np.repeat(balance / counts, counts)
    inner = np.r_[np.repeat(np.arange(len(counts)), counts)[1:] == np.repeat(np.arange(len(counts)), counts)[:-1], False]
    m, v = np.zeros(len(field.weights) + 1), np.zeros(len(field.weights) + 1)
    for step in range(1, steps + 1):
        good, stay = marginals(x @ field.weights, field.move, counts)
        gain = np.r_[x.T @ (weight * (y - good)), ((1 - stay) * (weight * inner)[:-1]).sum()] / len(labels)
        gain -= 1e-3 * np.r_[field.weights, 30 * field.move[0, 0]]
        m, v = 0.9 * m + 0.1 * gain, 0.99 * v + 0.01 * gain * gain
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        field.weights += change[:-1]
        field.move += np.eye(2) * change[-1]
    share = np.clip(field.shares(list(sample["text"])), 1e-4, 1 - 1e-4)
    z = np.stack([np.log(share / (1 - share)), np.ones(len(share))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps of a ridge-penalised logistic fit
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(2)
        theta += np.linalg.solve(hess, z.T @ (labels - p) - 0.5 * theta)
    field.slope, field.base = float(max(theta[0], 0.0)), float(theta[1])
    return field


def score_quality(docs: DataFrame, field: LineField, columns: list[str], block_chars: int = 2_000_000) -> DataFrame:
    """``columns`` of ``docs`` with ``score``, P(quality = 1) of the whole text.

    Null and empty texts are one empty line. Every row is scored for itself, so
    repeated rows and extra columns change nothing; an empty table stays empty.
    """
    schema = StructType([*docs.select(*columns).schema.fields, StructField("score", DoubleType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores, block, size = [], [], 0
            for text in part.column(part.num_columns - 1):
                block.append(text.as_py())
                size += len(block[-1] or "")
                if size >= block_chars:
                    scores.append(field.score(block))
                    block, size = [], 0
            if block:
                scores.append(field.score(block))
            found = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], [*columns, "score"])

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(batches, schema)


def quality(docs: DataFrame, labels: DataFrame, columns: list[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fold, and score every row.

    Adds held_out, score and predicted (1 from 0.3 on) to ``columns``.
    """
    field = fit_field(labelled_sample(docs, labels, "quality", fit_rows))
    scored = score_quality(docs, field, columns)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))
