"""Toxicity scores: a bidirectional gated recurrent network with attention pooling.

Each token's input is its word vector beside the mean vector of its character n-grams at
the word's edges. Two gated recurrent layers read a window in both directions, attention
pools their states, a logistic unit gives the window's probability; a text's score is the
largest over all its overlapping windows. Everything is numpy, training included.

Training takes a bounded sample of labelled rows (at most `sample_rows` toxic texts and twice as
many others, of at most `sample_chars` characters each) of the rows that `learn` allows; it
runs in one task, and only the network travels. A text's label belongs to
some window of it, so each epoch scores all windows of the sample and learns from the
highest of a toxic text and from the highest and a random one of another. Word and n-gram
vectors start from shrunken log odds in one component. Labels, lang, source and doc_id are
no inputs. Scoring covers every whole text.

Defined results: null and empty texts, and texts without words, are one empty window and get
its score; if the sample lacks a class, every score is the share of toxic rows (0.5 without
any rows); unusable labels, and labels of one doc_id that disagree, are ignored; repeated rows repeat; other columns aren't
read (clean() keeps them).
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows

TOKEN = re.compile(r"\w+")
WINDOW, STRIDE, HIDDEN, WIDTH = 32, 16, 8, 8


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def grams(word: str) -> tuple[str, str, str, str]:
    """Character n-grams at the edges of a word, marked."""
    return "^" + word[:3], "^" + word[:4], "^" + word[:5], word[-3:] + "$"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    words: dict[str, int]  # row 0 stands for the rest
    grams: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    # -- inputs ---------------------------------------------------------------------------
    def rows_of(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        w, g = self.words.get, self.grams.get
        return np.array([w(x, 0) for x in vocabulary], np.int32), np.array([[g(y, 0) for y in grams(x)] for x in vocabulary], np.int32).reshape(-1, 4)

    def inputs(self, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.concatenate((self.p["word"][rows[0]], self.p["gram"][rows[1]].mean(axis=1)), axis=1)

    # -- forward --------------------------------------------------------------------------
    def forward(self, ids: np.ndarray, projected: np.ndarray, keep: bool = False):
        """Logits of windows of token ids (-1: no token); projected: per token, of both directions."""
        p, (n, steps) = self.p, ids.shape
        mask = (ids >= 0).astype(np.float32)
        states, tape = np.zeros((steps, n, 2 * HIDDEN), np.float32), []
        for d in (0, 1):
            h, u = np.zeros((n, HIDDEN), np.float32), p[f"u{d}"]
            part = np.ascontiguousarray(projected[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)])
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x, hu = part[ids[:, t]], h @ u
                zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                m = mask[:, t : t + 1]
                if keep:
                    tape.append((d, t, h, z, r, c, hu, m))
                h = h + m * (1 - z) * (c - h)
                states[t, :, HIDDEN * d : HIDDEN * (d + 1)] = h
        a = np.tanh(states @ p["att"] + p["att_b"])
        e = a @ p["att_v"] - 1e9 * (1 - mask.T)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states) * (mask.sum(axis=1, keepdims=True) > 0)
        logit = pooled @ p["out"] + p["out_b"][0]
        return (logit, (states, tape, a, weight, pooled)) if keep else logit

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates; one more row for places without a token."""
        return np.concatenate((x @ self.p["in"] + self.p["in_b"], np.zeros((1, 6 * HIDDEN), np.float32))).astype(np.float32)

    # -- training -------------------------------------------------------------------------
    def gradients(self, ids: np.ndarray, rows: tuple[np.ndarray, np.ndarray], label: np.ndarray) -> tuple[float, dict]:
        p, (n, steps) = self.p, ids.shape
        x = self.inputs(rows)
        projected = self.project(x)
        logit, (states, tape, a, weight, pooled) = self.forward(ids, projected, keep=True)
        y = sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(label > 0, y, 1 - y) + 1e-9)))
        dl = ((y - label) / n).astype(np.float32)
        some = (ids >= 0).any(axis=1)[:, None]
        g = {"out": pooled.T @ dl, "out_b": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["out"][None] * some
        ds = weight[:, :, None] * dpool[None]
        dw = np.einsum("nk,tnk->tn", dpool, states)
        de = weight * (dw - (weight * dw).sum(axis=0))
        g["att_v"] = np.einsum("tn,tnk->k", de, a)
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("tni,tnj->ij", states, da), da.sum(axis=(0, 1))
        ds += da @ p["att"].T
        dproj = np.zeros_like(projected)
        for d in (0, 1):
            dh, u = np.zeros((n, HIDDEN), np.float32), p[f"u{d}"]
            gu, at = np.zeros_like(u), slice(3 * HIDDEN * d, 3 * HIDDEN * (d + 1))
            for _, t, h, z, r, c, hu, m in reversed([s for s in tape if s[0] == d]):
                dh = dh + ds[t, :, HIDDEN * d : HIDDEN * (d + 1)]
                step = dh * m
                dz, dc = step * (h - c) * z * (1 - z), step * (1 - z) * (1 - c * c)
                dr = dc * hu[:, 2 * HIDDEN :] * r * (1 - r)
                dhu = np.concatenate((dz, dr, dc * r), axis=1)
                gu += h.T @ dhu
                np.add.at(dproj[:, at], ids[:, t], np.concatenate((dz, dr, dc), axis=1))
                dh = dh - step * (1 - z) + dhu @ u.T
            g[f"u{d}"] = gu
        dproj = dproj[:-1]
        g["in"], g["in_b"] = x.T @ dproj, dproj.sum(axis=0)
        dx = dproj @ p["in"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], rows[0], dx[:, :WIDTH])
        for k in range(4):
            np.add.at(g["gram"], rows[1][:, k], dx[:, WIDTH:] / 4)
        g["word"][0], g["gram"][0] = 0, 0
        return loss, g


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows of a text of n tokens; the last one ends it."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def window_ids(ids: np.ndarray) -> np.ndarray:
    if len(ids) < WINDOW:
        return np.concatenate((ids, np.full(WINDOW - len(ids), -1, np.int32)))[None]
    return np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[windows(len(ids))]


class WordRows(dict):
    """word -> row, the next free one for a new word."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int = 8, least_steps: int = 240, batch: int = 128, rate: float = 0.01, most: int = 30_000, least: int = 4) -> Network:
    """The network for a sample of texts (labels 0 or 1). A small sample is gone through more often, until there are least_steps steps."""
    if len({*labels}) < 2:
        return Network({}, {}, constant=float(np.mean(labels)) if labels else 0.5)
    rng, y = np.random.default_rng(seed), np.array(labels, np.float32)
    vocabulary, gram_rows = WordRows(), WordRows()
    docs = [np.array([vocabulary[w] for w in tokens(t)], np.int32) for t in texts]  # numbers, not words: a sample is small in memory
    grams_of = np.array([[gram_rows[g] for g in grams(w)] for w in vocabulary], np.int64).reshape(-1, 4)
    counts = {}
    for kind, names in (("word", list(vocabulary)), ("gram", list(gram_rows))):
        by = np.zeros((2, len(names)), np.int64)
        for doc, label in zip(docs, labels):
            seen = np.unique(doc)
            by[label, seen if kind == "word" else np.unique(grams_of[seen])] += 1
        total = by.sum(axis=0)
        kept = sorted(np.flatnonzero(total >= least).tolist(), key=lambda i: (-total[i], names[i]))[:most]
        part = [np.log((by[1, kept] + 0.5) / (y.sum() + 1)), np.log((by[0, kept] + 0.5) / (len(y) - y.sum() + 1))]
        odds = np.concatenate(([0.0], (part[0] - part[1]) * total[kept] / (total[kept] + 8)))
        counts[kind] = ({names[i]: k + 1 for k, i in enumerate(kept)}, np.clip(odds.astype(np.float32), -2, 6) / 3)
    net = Network(counts["word"][0], counts["gram"][0])
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net.p = {"in": normal(2 * WIDTH, 6 * HIDDEN), "in_b": np.zeros(6 * HIDDEN, np.float32), "u0": normal(HIDDEN, 3 * HIDDEN), "u1": normal(HIDDEN, 3 * HIDDEN), "att": normal(2 * HIDDEN, HIDDEN), "att_b": np.zeros(HIDDEN, np.float32), "att_v": normal(HIDDEN), "out": normal(2 * HIDDEN), "out_b": np.array([-1], np.float32)}
    for kind in counts:
        net.p[kind] = (rng.standard_normal((len(counts[kind][0]) + 1, WIDTH)) * 0.02).astype(np.float32)
        net.p[kind][:, 0] = counts[kind][1]
        net.p[kind][0] = 0
    rows = net.rows_of(list(vocabulary))
    parts = [window_ids(doc) for doc in docs]
    first = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    ids = np.concatenate(parts)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(epochs, -(-least_steps // -(-(len(docs) + int((y == 0).sum())) // batch))) if epochs else 0
    for epoch in range(epochs):
        scores = logits(net, ids, net.project(net.inputs(rows)))
        best = np.array([a + int(np.argmax(scores[a:b])) for a, b in zip(first[:-1], first[1:])])
        chance = first[:-1] + (rng.random(len(docs)) * np.diff(first)).astype(np.int64)
        chosen = np.concatenate((np.arange(len(docs)), np.flatnonzero(y == 0)))
        which = np.concatenate((best, chance[y == 0]))
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), batch):
            o = order[at : at + batch]
            w = ids[which[o]]
            used, local = np.unique(w, return_inverse=True)
            local = local.reshape(w.shape) - (used[0] < 0)
            used = used[used >= 0]
            _, grad = net.gradients(local, (rows[0][used], rows[1][used]), y[chosen[o]])
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def logits(net: Network, ids: np.ndarray, projected: np.ndarray, block: int = 1024) -> np.ndarray:
    """Network.forward without a tape, gate by gate over both directions in contiguous blocks.

    The logistic function is taken as a hyperbolic tangent; a place without a token keeps the
    state because its update gate is shut.
    """
    p, steps = net.p, ids.shape[1]
    scale = np.array([0.5, 0.5, 1], np.float32)
    gates = [[np.ascontiguousarray(projected[:, (3 * d + g) * HIDDEN : (3 * d + g + 1) * HIDDEN]) * scale[g] for d in (0, 1)] for g in range(3)]
    for d in (0, 1):
        gates[0][d][-1] = 40
    u = [np.stack([p[f"u{d}"][:, g * HIDDEN : (g + 1) * HIDDEN] for d in (0, 1)]) * scale[g] for g in range(3)]
    att = p["att"].reshape(2, HIDDEN, HIDDEN)
    out = np.empty(len(ids), np.float32)
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block].T)
        n = part.shape[1]
        states, x = np.empty((2, steps, n, HIDDEN), np.float32), np.empty((2, n, HIDDEN), np.float32)
        h, work = np.zeros((2, n, HIDDEN), np.float32), np.empty((2, n, HIDDEN), np.float32)
        for t in range(steps):
            value = []
            for g in range(3):
                gates[g][0].take(part[t], axis=0, out=x[0], mode="wrap")
                gates[g][1].take(part[steps - 1 - t], axis=0, out=x[1], mode="wrap")
                np.matmul(h, u[g], out=work)
                if g == 2:
                    work *= value[1]
                    work += x
                    value.append(np.tanh(work))
                else:
                    work += x
                    z = np.tanh(work)
                    z *= 0.5
                    z += 0.5
                    value.append(z)
            z, _, c = value
            h *= z
            z -= 1
            c *= z
            h -= c
            states[0, t], states[1, steps - 1 - t] = h[0], h[1]
        a = states[0] @ att[0] + states[1] @ att[1]
        a += p["att_b"]
        e = np.tanh(a, out=a) @ p["att_v"]
        masked = part < 0
        e = np.where(masked, np.float32(-1e9), e)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        o = p["out"].reshape(2, HIDDEN)
        value = (e * (states[0] @ o[0] + states[1] @ o[1])).sum(axis=0)
        out[at : at + block] = np.where(masked.all(axis=0), 0, value) + p["out_b"][0]
    return out


class Scorer:
    """Scores of texts; inputs of distinct words are kept in a bounded table."""

    def __init__(self, net: Network, most: int = 150_000, tokens_at_once: int = 1 << 18):
        self.net, self.most, self.at_once = net, most, tokens_at_once
        self.table = WordRows()
        self.projected = np.zeros((0, 6 * HIDDEN), np.float32)

    def batch(self, docs: list[list[str]]) -> list[float]:
        if len(self.table) > self.most:
            self.table, self.projected = WordRows(), self.projected[:0]
        known = len(self.projected)
        table = self.table
        parts = [window_ids(np.array([table[w] for w in d], np.int32)) for d in docs]
        new = list(islice(table, known, None))
        net = self.net
        self.projected = np.concatenate((self.projected, net.project(net.inputs(net.rows_of(new)))[:-1]))
        projected = np.concatenate((self.projected, np.zeros((1, 6 * HIDDEN), np.float32)))
        out = logits(net, np.concatenate(parts), projected)
        ends = np.cumsum([len(p) for p in parts])
        return sigmoid(np.maximum.reduceat(out, np.concatenate(([0], ends[:-1])))).astype(float).tolist()

    def scores(self, texts: list[str | None]) -> Iterator[float]:
        if self.net.constant is not None:
            yield from [self.net.constant] * len(texts)
            return
        held, size = [], 0
        for t in texts:
            held.append(tokens(t))
            size += len(held[-1])
            if size >= self.at_once or len(held) >= 4096:
                yield from self.batch(held)
                held, size = [], 0
        if held:
            yield from self.batch(held)


def learned_rows(doc_id: Column | str = "doc_id") -> Column:
    """Rows that labels may be learnt from: crc32 of the doc_id as text, mod 3, isn't 1."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_chars: int, learn) -> DataFrame:
    """toxic and text of at most sample_rows toxic and twice as many other texts, the first by a hash.

    Labels of a doc_id that disagree are unusable.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")

    def first(df: DataFrame, *by: str) -> DataFrame:
        return reduce(DataFrame.unionAll, [df.where(F.col("toxic") == k).orderBy(F.xxhash64(*by), *by).limit(n) for k, n in ((1, sample_rows), (0, 2 * sample_rows))])

    chosen = F.broadcast(first(usable, "doc_id"))  # 3 * sample_rows rows at most
    texts = docs.where(F.length("text") <= sample_chars).select(F.col("doc_id"), "text").join(chosen, "doc_id")
    return first(texts.select("toxic", "text").distinct(), "text")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, sample_chars: int = 20_000, learn=learned_rows) -> Network:
    """Train on a sample of labelled rows, in one task; only the network comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(1).to_pylist(), b.column(0).to_pylist()))
        net = train([t for t, _ in rows], [k for _, k in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    made = sample(docs, labels, sample_rows, sample_chars, learn).repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(made.net) if made else train([], [])


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": list(scorer.scores(b["text"]))}

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held_out = ~F.coalesce(learned_rows(), F.lit(True))
    return scored(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is below the threshold; columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array([s < threshold for s in scorer.scores(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
