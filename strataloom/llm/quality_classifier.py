"""Quality classifier: a generalised additive model with pairwise interactions.

Each document is a row of plain features of its text. Features are cut into bins at quantiles of the training rows. Cyclic
boosting visits the features in turn; each visit fits a shallow tree (up to three leaves) to the gradient on the bins of
that one feature and adds it, with a small rate, to the feature's lookup table. Then the pairs of features whose
residuals have the largest gain on a coarse grid get tables of two dimensions, boosted in the same way. The model is
nothing but these tables: a score is the sum of looked-up values, vectorised over rows.

Labels are learned from at most about ``sample`` documents (a documented limit, chosen by a hash of the id); only features of
those are collected. labels, lang, source and doc_id are never features. A document with both labels counts with each, equal
rows of labels count once, and of rows that repeat an id the one with the smallest features is learned from. Null and empty
texts have zero features and are scored like all others. Without labels of both kinds the score is the share of 1 (0.5
without labels). An empty table gives no rows. Rows are kept one for one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, chunks, mix, remainder, share, table
from .quality_rules import by_doc, class_counts, common_counts, duplicate_lines, listed_hashes, repeated_words

FEATURES = ["words", "word_length", "upper", "digits", "symbols", "signs", "wide", "blanks", "lines", "repeated_lines", "repeated_words", "distinct_words", "common_words", "pipes", "exclamations", "longest_word", "symbol_words"]
BINS, COARSE = 48, 8


def features(text: pa.Array, listed: np.ndarray) -> np.ndarray:
    n = len(text)
    words = Words(text)
    w = words.hashes()
    classes = class_counts(words)
    count, solid = words.count, classes.sum(1) - classes[:, 3]
    texts = text.to_pylist()
    lines = np.array([t.count("\n") + 1 if t else 0 for t in texts])
    per = lambda x, y: x / np.maximum(y, 1)
    own = np.repeat(np.arange(n), np.diff(words.off))
    of = lambda sign: by_doc(own[words.buf == ord(sign)], n)
    order = np.lexsort((w, words.doc))
    new = np.r_[True, (w[order][1:] != w[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])] if len(w) else np.zeros(0, bool)
    longest = np.zeros(n, np.int64)
    if len(w):
        np.maximum.at(longest, words.doc, words.lens)
    signed = np.zeros(len(words.buf) + 1, np.int64)
    signed[1:] = np.cumsum(np.isin(words.buf, list(b"#*$%&|<>")))
    marked = signed[words.ends] > signed[words.starts]
    low = Words(text, lower=True).hashes()
    listed_words = count - common_counts(words, low, listed)[:, -1]
    columns = [np.log1p(count), per(solid, count), per(classes[:, 1], solid), per(classes[:, 2], solid), per(classes[:, 4], count), per(classes[:, 5], count), per(classes[:, 6], solid), per(classes[:, 3], count), np.log1p(lines), per(duplicate_lines(texts), lines), per(by_doc(words.doc[repeated_words(words, w)], n), count), per(by_doc(words.doc[order][new], n), count), per(listed_words, count), per(of("|"), count), per(of("!"), count), np.log1p(longest), per(by_doc(words.doc[marked], n), count)]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        listed = listed_hashes()
        for chunk in chunks(batches):
            x = features(chunk.column("text"), listed)
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), values], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def leaves(gradient: np.ndarray, weight: np.ndarray, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Values of a tree of up to three leaves over ordered bins: two greedy cuts, each where the gain is largest."""
    n = len(gradient)
    cuts = [0, n]
    for _ in range(2):
        best = (1e-9, None)
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e - s < 2:
                continue
            g, h = np.cumsum(gradient[s:e]), np.cumsum(weight[s:e])
            gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g[-1] ** 2 / (h[-1] + ridge)
            gain = np.where((hl < least * 0.01) | (hr < least * 0.01), 0, gain)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), s + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(n)
    for s, e in zip(cuts, cuts[1:], strict=False):
        out[s:e] = gradient[s:e].sum() / (weight[s:e].sum() + ridge)
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Bin edges, one table for each feature, tables of the chosen pairs, intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 40):
        k = len(FEATURES)
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(k)]
        self.coarse = [e[np.linspace(0, len(e) - 1, min(COARSE - 1, len(e))).astype(int)] if len(e) else e for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        p = y.mean() if len(y) else 0.5
        self.base = float(np.log((p + 1e-3) / (1 - p + 1e-3)))
        if len(set(y.tolist())) < 2:
            return
        b = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)
        z = np.full(len(y), self.base)
        for _ in range(rounds):
            for f in range(k):
                q = sigmoid(z)
                n = len(self.tables[f])
                step = rate * leaves(np.bincount(b[:, f], y - q, n), np.bincount(b[:, f], q * (1 - q), n))
                self.tables[f] += step
                z += step[b[:, f]]
        c = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)], 1)
        q, gains = sigmoid(z), []
        for i in range(k):
            for j in range(i):
                cell = c[:, i] * COARSE + c[:, j]
                g, h = np.bincount(cell, y - q, COARSE**2), np.bincount(cell, q * (1 - q), COARSE**2)
                gains.append(((g**2 / (h + 1)).sum(), i, j))
        for _, i, j in sorted(gains, reverse=True)[:pairs]:
            self.pairs.append((i, j, np.zeros(COARSE**2)))
        for _ in range(pair_rounds):
            for i, j, own in self.pairs:
                q, cell = sigmoid(z), c[:, i] * COARSE + c[:, j]
                g, h = np.bincount(cell, y - q, COARSE**2), np.bincount(cell, q * (1 - q), COARSE**2)
                grid = g.reshape(COARSE, COARSE), h.reshape(COARSE, COARSE)
                rows = leaves(grid[0].sum(1), grid[1].sum(1))  # cut along one feature, then along the other within each leaf
                step = np.zeros((COARSE, COARSE))
                for value in np.unique(rows):
                    part = rows == value
                    step[part] = leaves(grid[0][part].sum(0), grid[1][part].sum(0))
                own += rate * step.ravel()
                z += rate * step.ravel()[cell]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, e in enumerate(self.edges):
            z += self.tables[f][np.searchsorted(e, x[:, f], "right")]
        for i, j, own in self.pairs:
            z += own[np.searchsorted(self.coarse[i], x[:, i], "right") * COARSE + np.searchsorted(self.coarse[j], x[:, j], "right")]
        return sigmoid(z)


def score(docs: DataFrame, labels: DataFrame, modulo: int = 4, left_out: int = 2, sample: int = 8000, target: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); labels: doc_id and ``target``."""
    spark = docs.sparkSession
    rows = table(spark, featured(docs))
    able = labels.select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("y")).where((remainder("doc_id", modulo) != left_out) & F.col("y").isin(0, 1)).distinct()
    chosen = able.where(share("doc_id", sample, able.count())).join(rows.hint("merge"), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    known = sorted((r[0], r[1], list(r[2])) for r in chosen.collect())  # bounded by the sample
    model = Model(np.array([r[2] for r in known]).reshape(-1, len(FEATURES)), np.array([r[1] for r in known], np.int64))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(x) if len(x) else np.zeros(0))], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", modulo) == left_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
