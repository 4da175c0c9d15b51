"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

Trained in numpy on a bounded sample; every text is scored whole, as the highest
score among all its overlapping windows, one from each word on.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import held_out, labelled_sample

_LETTERS = re.compile(r"[^\W\d_]+")

#: Words per window. Every run of so many words is scored.
WINDOW = 12
#: Words between the starts of the windows that the fit takes; they overlap by three words. Scores take all starts.
FIT_STRIDE = 9
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN = 8192, 4096, 8, 6
#: Most labelled rows of the fit, and most windows taken from one of them in one round of the fit.
FIT_ROWS, FIT_WINDOWS = 1500, 20
#: Unique words a task keeps features of; beyond it the table starts anew. It bounds memory and changes no score.
CACHED_WORDS = 400_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum ``values`` by row number into ``n`` rows."""
    total = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
        total[rows[order][cuts]] = np.add.reduceat(values[order], cuts, axis=0)
    return total


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def word_rows(words: list[str]) -> np.ndarray:
    """Row of the word table for each word."""
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.int64) % WORD_ROWS


def char_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word number, row of the character table)`` for each byte trigram of each word between blanks."""
    joined = np.frombuffer(b" " + b"  ".join(w.encode("utf-8", "surrogatepass") for w in words) + b" ", dtype=np.uint8).astype(np.int64)
    if len(words) == 0 or len(joined) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, second, third = joined[:-2], joined[1:-1], joined[2:]
    inside = second != 32  # the trigram's middle belongs to a word
    number = np.cumsum((first == 32) & inside) - 1
    rows = (first * 65_599 + second * 4_099 + third * 31) * 2_654_435_761 % (1 << 32) % CHAR_ROWS
    return number[inside], rows[inside]


def window_table(ids: np.ndarray, lengths: np.ndarray, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts laid end to end, ``stride`` words apart: word numbers (-1 beyond a text's end), and each
    window's text. A text of few words or none has one; the last window may reach beyond the end."""
    per_text = np.maximum(lengths - WINDOW, 0)
    per_text = (per_text + stride - 1) // stride + 1
    text = np.repeat(np.arange(len(lengths)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    offset = np.cumsum(lengths) - lengths
    at = nth[:, None] * stride + np.arange(WINDOW)
    valid = at < lengths[text][:, None]
    if not len(ids):
        return np.full(at.shape, -1, dtype=np.int64), text
    return np.where(valid, ids[np.minimum(offset[text][:, None] + at, len(ids) - 1)], -1), text


class Network:
    """Embeddings, two gated recurrent cells, attention, and a logistic output."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p: dict[str, np.ndarray] = {
            "word": rng.normal(0, 0.05, (WORD_ROWS, WIDTH)).astype(np.float32),
            "char": rng.normal(0, 0.05, (CHAR_ROWS, WIDTH)).astype(np.float32),
            "attend": draw(2 * HIDDEN),
            "out": draw(2 * HIDDEN),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.p["in_" + side] = draw(2 * WIDTH, 3 * HIDDEN)
            self.p["own_" + side] = draw(HIDDEN, 3 * HIDDEN)
            self.p["base_" + side] = np.zeros(3 * HIDDEN, np.float32)

    def inputs(self, rows: np.ndarray, numbers: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Word and mean character embedding of each of ``len(rows)`` words."""
        size = np.maximum(np.bincount(numbers, minlength=len(rows)), 1)[:, None]
        summed = np.zeros((len(rows), WIDTH), np.float32)
        if len(numbers):
            cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            summed[numbers[cuts]] = np.add.reduceat(self.p["char"][chars], cuts, axis=0)
        return np.concatenate([self.p["word"][rows], summed / size], axis=1).astype(np.float32)

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds to the gates of either direction; one zero row more for places beyond the end."""
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        return tuple(np.concatenate([x @ self.p["in_" + s] + self.p["base_" + s], pad]) for s in "fb")

    def forward(self, tables: tuple[np.ndarray, np.ndarray], index: np.ndarray, keep: bool = False):
        """Logit of each window of ``index``; with ``keep`` also what the backward pass needs."""
        n, valid = len(index), (index >= 0)
        states = np.zeros((n, WINDOW, 2 * HIDDEN), np.float32)
        kept = {}
        for side, table, order in (("f", tables[0], range(WINDOW)), ("b", tables[1], range(WINDOW - 1, -1, -1))):
            h, own = np.zeros((n, HIDDEN), np.float32), self.p["own_" + side]
            at = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            for t in order:
                x, m = table[index[:, t]], valid[:, t, None]
                gates = _sigmoid(x[:, : 2 * HIDDEN] + h @ own[:, : 2 * HIDDEN])
                reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + (reset * h) @ own[:, 2 * HIDDEN :])
                if keep:
                    kept[side, t] = (h, reset, update, new)
                h = np.where(m, h + update * (new - h), h)
                states[:, t, at] = h
        score = np.where(valid, states @ self.p["attend"], -1e9)
        weight = np.exp(score - score.max(axis=1, keepdims=True)) * valid
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, valid, states, weight, pooled, kept) if keep else logit

    def gradients(self, x: np.ndarray, index: np.ndarray, target: np.ndarray, weights: np.ndarray):
        """Gradients of the weighted log loss, for all parameters but the embeddings, and for ``x``."""
        logit, valid, states, weight, pooled, kept = self.forward(self.projected(x), index, keep=True)
        d_logit = ((_sigmoid(logit) - target) * weights / weights.sum()).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = (states * d_pooled[:, None, :]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["attend"] = np.einsum("nt,nth->h", d_score, states)
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_score[:, :, None] * self.p["attend"]
        d_x = np.zeros((index.size, 2 * WIDTH), np.float32).reshape(*index.shape, 2 * WIDTH)
        for side, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            own, into = self.p["own_" + side], self.p["in_" + side]
            at = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            g_own, g_in, g_base = np.zeros_like(own), np.zeros_like(into), np.zeros(3 * HIDDEN, np.float32)
            d_h = np.zeros((len(index), HIDDEN), np.float32)
            for t in order:
                h, reset, update, new = kept[side, t]
                m = valid[:, t, None]
                d_all = d_h + d_states[:, t, at]
                d_now = d_all * m
                d_new = d_now * update * (1 - new * new)
                d_update = d_now * (new - h) * update * (1 - update)
                d_rh = d_new @ own[:, 2 * HIDDEN :].T
                d_reset = d_rh * h * reset * (1 - reset)
                d_gates = np.concatenate([d_reset, d_update], axis=1)
                g_own[:, : 2 * HIDDEN] += h.T @ d_gates
                g_own[:, 2 * HIDDEN :] += (reset * h).T @ d_new
                d_in = np.concatenate([d_gates, d_new], axis=1)
                g_base += d_in.sum(axis=0)
                rows = index[:, t]
                g_in += x[np.maximum(rows, 0)].T @ d_in
                d_x[:, t] += d_in @ into.T
                d_h = d_all * (1 - m) + d_now * (1 - update) + d_gates @ own[:, : 2 * HIDDEN].T + d_rh * reset
            g |= {"own_" + side: g_own, "in_" + side: g_in, "base_" + side: g_base}
        return g, _summed(d_x.reshape(-1, 2 * WIDTH), index.ravel() + 1, len(x) + 1)[1:]

    def window_scores(self, tables: tuple[np.ndarray, np.ndarray], index: np.ndarray, block: int = 4096) -> np.ndarray:
        parts = [_sigmoid(self.forward(tables, index[i : i + block])) for i in range(0, len(index), block)]
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def run_scores(self, tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray, block: int = 4096) -> np.ndarray:
        """Score of the window at each place of ``ids`` that has WINDOW words from there on: as ``window_scores`` of
        all these windows, but neighbours share their words, so step t of a block of windows reads one slice."""
        n = len(ids) - WINDOW + 1
        # gates as tanh(x / 2): the halves go into the weights
        halved = np.r_[np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)
        sides = []
        for side, at in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            own = 0.5 * self.p["own_" + side].T
            heads = np.stack([self.p["attend"][at], self.p["out"][at]])
            sides.append((np.ascontiguousarray(own[: 2 * HIDDEN]), np.ascontiguousarray(own[2 * HIDDEN :]), heads))
        scores = np.empty(max(n, 0), np.float32)
        for start in range(0, n, block):
            size = min(block, n - start)
            place = ids[start : start + size + WINDOW - 1]
            seen = np.zeros((2, WINDOW, size), np.float32)  # attention and output of each place's state
            for table, (gate_own, new_own, heads), order in zip(tables, sides, (range(WINDOW), range(WINDOW - 1, -1, -1)), strict=True):
                x = np.ascontiguousarray((table[place] * halved).T)
                h = np.zeros((HIDDEN, size), np.float32)
                for t in order:
                    gates = gate_own @ h
                    gates += x[: 2 * HIDDEN, t : t + size]
                    np.tanh(gates, out=gates)
                    reset, update = gates[:HIDDEN], gates[HIDDEN:]
                    reset *= h
                    reset += h
                    new = new_own @ reset
                    new += x[2 * HIDDEN :, t : t + size]
                    np.tanh(new, out=new)
                    new -= h
                    new *= 0.5
                    h += new
                    new *= update
                    h += new
                    seen[:, t] += heads @ h
            weight = np.exp(seen[0] - seen[0].max(axis=0))
            scores[start : start + size] = _sigmoid((weight * seen[1]).sum(axis=0) / weight.sum(axis=0) + self.p["bias"][0])
        return scores

    def highest(self, tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Highest score of all windows of each of the texts laid end to end in ``ids``."""
        best = np.zeros(len(lengths))
        long = lengths >= WINDOW
        of_word = np.repeat(long, lengths)
        index, _ = window_table(ids[~of_word], lengths[~long])
        best[~long] = self.window_scores(tables, index)
        if long.any():
            run, sizes = ids[of_word], lengths[long]
            scores = self.run_scores(tables, run)
            ends = np.cumsum(sizes)
            left = np.repeat(ends, sizes)[: len(scores)] - np.arange(len(scores))
            scores[left < WINDOW] = 0  # these windows would reach into the next text
            best[long] = np.maximum.reduceat(scores, ends - sizes)
        return best


def _train(net: Network, words: list[str], index, target, weights, epochs: int, rng, rate: float = 0.01) -> None:
    """Adam over batches of windows; each batch looks up its own words only."""
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(index))
        for i in range(0, len(shuffled), 1024):
            take = shuffled[i : i + 1024]
            used, place = np.unique(index[take], return_inverse=True)
            place = place.reshape(len(take), WINDOW)
            if used[0] < 0:
                used, place = used[1:], place - 1
            own = [words[w] for w in used]
            rows, (numbers, chars) = word_rows(own), char_rows(own)
            g, d_x = net.gradients(net.inputs(rows, numbers, chars), place, target[take], weights[take])
            size = np.maximum(np.bincount(numbers, minlength=len(rows)), 1)[:, None]
            g["word"] = _summed(d_x[:, :WIDTH], rows, WORD_ROWS)
            g["char"] = _summed((d_x[:, WIDTH:] / size)[numbers], chars, CHAR_ROWS)
            step += 1
            for k, grad in g.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def fit_network(sample: pd.DataFrame, seed: int = 7) -> Network:
    """Fit on labelled texts (columns text, label).

    Labels belong to texts, not windows. Word embeddings start from each word's
    log-odds. Each round takes, of the texts marked toxic, the windows that score
    as hardly any of the others does, and against them windows of unmarked texts at
    random with the highest-scoring ones. Scores are at first those of the words
    alone, then the network's.
    Without both labels the score is the share of toxic rows everywhere.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    labels = sample["label"].to_numpy(dtype=np.int64) if len(sample) else np.empty(0, np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        net.p["out"][:] = 0
        net.p["bias"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    texts = [np.array([number[w] for w in words_of(t)], dtype=np.int64) for t in sample["text"]]
    words = list(number)
    seen, toxic = np.zeros(len(words)), np.zeros(len(words))
    for ids, label in zip(texts, labels, strict=True):
        once = np.unique(ids)
        seen[once] += 1
        toxic[once] += label
    prior = labels.mean()
    rate = (toxic + 4 * prior) / (seen + 4)
    odds = np.clip(np.log(rate / (1 - rate)) - np.log(prior / (1 - prior)), -3, 3) * (seen >= 2)
    rows = word_rows(words)
    start = np.zeros(WORD_ROWS)
    heaviest = np.argsort(seen, kind="stable")  # the most frequent word of a row decides
    start[rows[heaviest]] = odds[heaviest]
    net.p["word"][:, 0] = start
    lengths = np.array([len(t) for t in texts])
    index, text = window_table(np.concatenate(texts), lengths, FIT_STRIDE)
    target = labels[text].astype(np.float32)

    def some(of: np.ndarray) -> np.ndarray:
        """At most FIT_WINDOWS of the windows of each text, at random."""
        of = rng.permutation(of)
        of = of[np.argsort(text[of], kind="stable")]
        first = np.flatnonzero(np.r_[True, text[of][1:] != text[of][:-1]])
        nth = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        return of[nth < FIT_WINDOWS]

    scores = np.r_[odds, -9.0][index].max(axis=1)  # first by words alone; then the network's own scores
    for _ in range(3):
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, scores)
        clean = np.sort(best[labels == 0])
        bar = clean[int(0.9 * (len(clean) - 1))]
        positive = np.flatnonzero((target == 1) & ((scores > bar) | (scores >= best[text]) & (scores >= clean[len(clean) // 2])))
        hard = np.flatnonzero((target == 0) & (scores >= best[text]))
        negative = np.unique(np.concatenate([some(np.flatnonzero(target == 0)), some(hard)]))
        if not len(positive):
            break
        both = np.concatenate([positive, negative])
        weights = np.concatenate([np.full(len(positive), max(1.0, 0.1 * len(negative) / len(positive))), np.ones(len(negative))])
        epochs = int(np.clip(80_000 // len(both), 2, 8))
        _train(net, words, index[both], target[both], weights.astype(np.float32), epochs, rng)
        scores = net.window_scores(net.projected(net.inputs(rows, *char_rows(words))), index)
    # the cut is set on what texts are judged by: the highest of all their windows
    tables = net.projected(net.inputs(rows, *char_rows(words)))
    best = np.clip(net.highest(tables, np.concatenate(texts), lengths), 1e-7, 1 - 1e-7)
    logit = np.log(best / (1 - best))
    order = np.argsort(logit, kind="stable")
    right = np.r_[labels.sum(), labels.sum() + np.cumsum(np.where(labels[order] == 0, 1, -1))]
    cuts = np.r_[logit[order][0], (logit[order][1:] + logit[order][:-1]) / 2, logit[order][-1]]
    net.p["bias"] -= np.float32(np.median(cuts[right == right.max()]))  # 0.5 parts the fitted texts best
    return net


class Scorer:
    """Scores texts with a fitted network; features of words seen before are kept."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.tables = self.net.projected(np.empty((0, 2 * WIDTH), np.float32))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > CACHED_WORDS:
            self._clear()
        number, ids, lengths = self.number, [], []
        for text in texts:
            found = [number[w] for w in words_of(text)]
            ids += found
            lengths.append(len(found))
        known = len(self.tables[0]) - 1
        fresh = list(islice(number, known, None))
        if fresh:
            more = self.net.projected(self.net.inputs(word_rows(fresh), *char_rows(fresh)))
            self.tables = tuple(np.concatenate([old[:-1], new]) for old, new in zip(self.tables, more, strict=True))
        return self.net.highest(self.tables, np.array(ids, dtype=np.int64), np.array(lengths, dtype=np.int64))


def score_toxicity(docs: DataFrame, net: Network, columns: list[str], block_chars: int = 1_000_000) -> DataFrame:
    """``columns`` of ``docs`` with ``score``: the highest score of the windows of the whole text.

    Null and empty texts, and texts without letters, have one window without words
    and get its score. Every row is scored for itself, so repeated rows and extra
    columns change nothing; an empty table gives an empty result.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = docs.select(*columns)
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for part in parts:
            texts, scores, block, size = part.column(part.num_columns - 1), [], [], 0
            for text in texts:
                block.append(text.as_py())
                size += len(block[-1] or "")
                if size >= block_chars:
                    scores.append(scorer(block))
                    block, size = [], 0
            if block:
                scores.append(scorer(block))
            found = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], [*columns, "score"])

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(batches, schema)


def toxicity(docs: DataFrame, labels: DataFrame, columns: list[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fold, and score every row.

    Adds held_out, score and predicted (1 from 0.5 on) to ``columns``.
    """
    net = fit_network(labelled_sample(docs, labels, "toxic", fit_rows))
    scored = score_toxicity(docs, net, columns)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))
