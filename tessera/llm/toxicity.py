"""Toxicity: a convolutional text classifier over hashed embeddings, trained in numpy, with thresholds calibrated by language.

A word's vector is the sum of the hashed embeddings of the word and of its beginnings, so that inflected forms share theirs. Filters of
several widths slide over the whole text; each filter's largest response feeds a logistic output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import class_rate, fold, labelled_sample, sigmoid, temperature
from .tokens import Words, mix, slices, span_hashes

PREFIXES, CELLS, DIM, FILTERS, WIDTHS = (4, 5, 6), 1 << 18, 8, 6, (1, 2, 3)
COLUMNS = [(w, j) for w in WIDTHS for j in range(w)]
_MARK = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


def features(words: Words) -> np.ndarray:
    """(words, 1 + prefixes) cells of each lower-cased word without the marks around it, and of its beginnings."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        start += (start < end - 1) & _MARK[words.data[start]]
        end -= (start < end - 1) & _MARK[words.data[end - 1]]
    out = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = span_hashes(words.data, start, end) % np.uint64(CELLS)
    for k, n in enumerate(PREFIXES, 1):
        out[:, k] = mix(span_hashes(words.data, start, np.minimum(end, start + n)) + np.uint64(k)) % np.uint64(CELLS)
    return out


@dataclass
class Convolution:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    heat: float = 1.0
    prior: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, vectors: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(words, widths * FILTERS): each filter's response at each word; words beyond the text's end count as zero."""
        flat = vectors @ self.filters
        out = np.zeros((len(vectors), len(WIDTHS) * FILTERS), flat.dtype)
        for c, (w, j) in enumerate(COLUMNS):
            part, to = flat[:, c * FILTERS : (c + 1) * FILTERS], slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
            if j:
                out[:-j, to] += np.where((doc[j:] == doc[:-j])[:, None], part[j:], 0) if len(part) > j else 0
            else:
                out[:, to] += part
        return out

    def logits(self, cells: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            vectors = self.embed[cells[:, 0]]
            for k in range(1, cells.shape[1]):
                vectors += self.embed[cells[:, k]]
            pooled[some] = np.maximum(np.maximum.reduceat(self.responses(vectors, doc), first[some], axis=0) + self.bias, 0)
        return pooled @ self.out + self.offset

    def scores(self, column: pa.Array) -> np.ndarray:
        words = Words(column)
        return sigmoid((self.logits(features(words), words.doc, words.first) / self.heat + self.prior).astype(np.float64))


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], rate: float, epochs: int = 10, batch: int = 32, step: float = 0.08, seed: int = 42) -> Convolution:
    """Adagrad on four fifths of the texts (cells of each); temperature, prior and thresholds by language on the others."""
    rng = np.random.default_rng(seed)
    wide = len(WIDTHS) * FILTERS
    net = Convolution(
        rng.normal(0, 0.05, (CELLS, DIM)).astype(np.float32), rng.normal(0, 0.4, (DIM, len(COLUMNS) * FILTERS)).astype(np.float32), np.zeros(wide, np.float32), rng.normal(0, 0.3, wide).astype(np.float32), 0.0
    )
    if not len(labels) or labels.min() == labels.max():
        net.out[:] = 0
        net.offset = float(np.log(rate / (1 - rate)))
        return net
    order = rng.permutation(len(labels))
    cut = len(labels) * 4 // 5
    learn, check = order[:cut], order[cut:]
    seen = [np.full(p.shape, 1e-6, np.float32) for p in (net.embed, net.filters, net.bias, net.out)]
    seen_offset = 1e-6
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
            rows = [r for r in rows if len(texts[r])]
            if not rows:
                continue
            cells = np.concatenate([texts[r] for r in rows])
            size = np.array([len(texts[r]) for r in rows])
            doc, first = np.repeat(np.arange(len(rows)), size), np.concatenate([[0], np.cumsum(size)])
            vectors = net.embed[cells].sum(1)
            response = net.responses(vectors, doc)
            best = np.stack([response[s:e].argmax(0) + s for s, e in zip(first[:-1], first[1:], strict=True)])
            raw = np.take_along_axis(response, best, 0) + net.bias
            pooled = np.maximum(raw, 0)
            g = ((sigmoid(pooled @ net.out + net.offset) - labels[rows]) / len(rows)).astype(np.float32)
            back = np.outer(g, net.out) * (raw > 0)
            grad_filters, at, grad_vectors = np.zeros_like(net.filters), [], []
            for c, (w, j) in enumerate(COLUMNS):
                cols, own = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS), slice(c * FILTERS, (c + 1) * FILTERS)
                token = best[:, cols] + j
                inside = token < first[1:, None]
                token, push = np.minimum(token, len(vectors) - 1), back[:, cols] * inside
                grad_filters[:, own] = np.einsum("bfd,bf->df", vectors[token], push)
                at.append(token.ravel())
                grad_vectors.append((push[:, :, None] * net.filters[:, own].T[None]).reshape(-1, DIM))
            at, grad_vectors = np.concatenate(at), np.concatenate(grad_vectors)
            touched, where = np.unique(cells[at].ravel(), return_inverse=True)
            grad_embed = np.zeros((len(touched), DIM), np.float32)
            np.add.at(grad_embed, where.ravel(), np.repeat(grad_vectors, cells.shape[1], axis=0))
            seen[0][touched] += grad_embed**2
            net.embed[touched] -= step * grad_embed / np.sqrt(seen[0][touched])
            for p, s, grad in zip((net.filters, net.bias, net.out), seen[1:], (grad_filters, back.sum(0), pooled.T @ g), strict=True):
                s += grad**2
                p -= step * grad / np.sqrt(s)
            seen_offset += float(g.sum()) ** 2
            net.offset -= step * float(g.sum()) / np.sqrt(seen_offset)
    ones = float(labels.mean())
    net.prior = float(np.log(rate / (1 - rate)) - np.log(ones / (1 - ones)))
    logit = np.array([net.logits(texts[r], np.zeros(len(texts[r]), int), np.array([0, len(texts[r])]))[0] for r in check])
    if len(check) and labels[check].min() < labels[check].max():
        weight = np.where(labels[check] == 1, rate / ones, (1 - rate) / (1 - ones))
        net.heat = temperature(logit, labels[check], np.ones(len(check)))
        score = sigmoid(logit / net.heat + net.prior)
        for lang in {langs[r] for r in check} - {None}:
            rows = np.array([langs[r] == lang for r in check])
            y, s, w = labels[check][rows], score[rows], weight[rows]
            if y.sum() >= 10 and (1 - y).sum() >= 10:
                grid = np.linspace(0.05, 0.95, 19)
                f1 = [2 * (w * y * (s >= t)).sum() / max((w * y).sum() + (w * (s >= t)).sum(), 1e-9) for t in grid]
                net.thresholds[lang] = float(np.median(grid[np.isclose(f1, max(f1))]))
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_words: int = 4096, seed: int = 42) -> Convolution:
    """Fits on at most ``per_class`` labelled texts a class of up to ``most_words`` words: a bounded sample, not a bound on scoring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                cells = features(words)
                rows = [cells[s:e].tobytes() for s, e in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "label", "lang")] + [pa.array(rows, pa.binary())], ["doc_id", "label", "lang", "cells"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    sample = labelled_sample(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang")), labels, "toxic", per_class, 3, 1)
    rows = sample.mapInArrow(run, "doc_id long, label int, lang string, cells binary").where(F.length("cells") <= most_words * 4 * (1 + len(PREFIXES))).groupBy("doc_id").agg(F.min(F.struct("cells", "lang", "label")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    cells = [np.frombuffer(c.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES)) for c in rows.column("cells")]  # not copied
    return train(cells, rows.column("label").to_numpy().astype(float), rows.column("lang").to_pylist(), class_rate(labels, "toxic", 3, 1), seed=seed)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = 3000, threshold: float = 0.7, seed: int = 42) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold), lang_threshold and flagged (score >= lang_threshold) of each row.

    score is the probability that the label toxic is 1, from the whole text alone; null and empty texts get the network's score of
    no words. The threshold calibrated for the row's language serves ``flagged`` only; languages with few labelled rows, and null, take
    ``threshold``. Labels of the held-out fold (crc32 of the id modulo 3 is 1) are never read; of contradicting labels of one id the
    greater counts, and of repeated rows of a labelled id one, the same in every run. Without labelled rows of both
    classes every score is the prior. Repeated rows are scored each; extra columns are ignored; an empty table gives an empty one.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class, seed=seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = fitted.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                limit = [net.thresholds.get(lang, threshold) for lang in part.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.scores(part.column("text"))), pa.array(limit, pa.float64())], ["doc_id", "score", "lang_threshold"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang")).mapInArrow(run, "doc_id long, score double, lang_threshold double")
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged")
    )
