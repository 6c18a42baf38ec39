"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes of lower-cased text in which all other
ASCII is one blank). Embeddings and softmax are trained by mini-batch stochastic gradient descent in numpy on a bounded
sample (``sample`` documents in proportion to the languages, but a twentieth of that of each language at least, or all it
has (where there are more than 200 languages, ten times the sample in equal parts, but five of each at least), and ``budget`` bytes at most, in equal parts for the languages: documented limits, chosen by
a hash of the id among the learnable ones; of rows that repeat an id and a language the smallest text is learned). Every language that has a learnable row is
learned; the bounds are on rows, not on languages. After training, where there are no more languages than dimensions, the softmax is folded into the embeddings: one row of class
scores for each bucket, so scoring a text is a sum over its n-grams; else the sums of embeddings are multiplied by it, so the model's size hardly follows the number of languages. A temperature and a rejection threshold are fitted on a fifth of the sample that is kept out of training:
``rejected`` marks predictions whose calibrated score is below the threshold that keeps 99.5 % of the right ones.

Null text and text without a letter give ``und`` with score 0. With nothing to learn from, all texts give ``und``.
Documents with null doc_id are not learned from. Rows are kept one for one; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, budgeted, chunks, forget, mix, remainder, table, text_bytes

SIZES, BITS, WIDTH = (2, 3, 4), 16, 16
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]
FOLD[65:91] += 32
FACTORS = mix(np.arange(1, 5, dtype=np.uint64)) | U(1)


def ngrams(text: pa.Array):
    """For each size: buckets of the n-grams of all texts, and the text of each."""
    raw, off = text_bytes(text)
    buf = FOLD[raw].astype(np.uint64) + U(1)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for n in SIZES:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h = buf[:m] * FACTORS[0]
        for k in range(1, n):
            h = h + buf[k : k + m] * FACTORS[k]
        ok = doc[:m] == doc[n - 1 :]
        yield (((h * U(0x9E3779B97F4A7C15)) ^ U(n * 0x1F3D5B79)) * U(0xD6E8FEB86659FD93) >> U(64 - BITS)).astype(np.int64)[ok], doc[:m][ok]


def class_scores(text: pa.Array, model: tuple[np.ndarray, np.ndarray | None]) -> np.ndarray:
    """Scores of each text for each class: the mean of its n-grams' rows, times the softmax's weights if they are not folded in."""
    table, weights = model
    n, k = len(text), table.shape[1]
    total, many = np.zeros((n, k)), np.zeros(n)
    for h, doc in ngrams(text):
        if len(h):
            count = np.bincount(doc, minlength=n)
            some = np.flatnonzero(count)
            at = (np.cumsum(count) - count)[some]
            many += count
            for c in range(k):
                total[some, c] += np.add.reduceat(table[:, c][h], at)
    mean = total / np.maximum(many, 1)[:, None]
    return mean if weights is None else mean @ weights


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def descend(vectors: np.ndarray, weights: np.ndarray, bags: list, labels: np.ndarray, rate: float) -> None:
    """One step down the gradient of the mean log loss of a batch, in place; ``weights`` takes a twentieth of the rate."""
    idx, part = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    row = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    hidden = np.add.reduceat(vectors[idx] * part[:, None], first)
    error = softmax(hidden @ weights)
    error[np.arange(len(bags)), labels] -= 1
    rate /= len(bags)
    back = error @ weights.T
    weights -= rate * 0.05 * hidden.T @ error
    np.add.at(vectors, idx, -rate * back[row] * part[:, None])


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and the share of each."""
    value, many = np.unique(np.concatenate([g for g, _ in ngrams(pa.array([text]))] or [np.zeros(0, np.int64)]), return_counts=True)
    return value, (many / max(1, many.sum())).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, k: int, epochs: int = 6, rate: float = 20.0, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, np.ndarray | None]:
    """The folded table of class scores (bucket x class), or embeddings and weights where there are more classes than dimensions."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    weights = random.normal(0, 0.3, (WIDTH, k)).astype(np.float32)
    bags = list(map(bag, texts))
    used = [i for i, b in enumerate(bags) if len(b[0])]
    steps, done = max(1, epochs * -(-len(used) // batch)), 0
    for _ in range(epochs):
        order = random.permutation(used)
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            descend(vectors, weights, [bags[i] for i in own], labels[own], rate * (1 - done / steps))
            done += 1
    return ((vectors @ weights).astype(np.float64), None) if k <= WIDTH else (vectors.astype(np.float64), weights.astype(np.float64))


def learnable(docs: DataFrame, modulo: int, left_out: int, sample: int, budget: int) -> list[tuple[str, str]]:
    """(text, lang) of the sample."""
    spark = docs.sparkSession
    able = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    able = able.where((remainder("doc_id", modulo) != left_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = table(spark, able.groupBy("lang").agg(F.count("*").alias("k")))
    total, languages = counts.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("*")).first()
    least = min(sample // 20, max(5, 10 * sample // max(1, languages)))  # of each language, whatever its share
    wanted = F.greatest(sample * F.col("k") / max(1, total), F.lit(float(least)))
    rates = counts.select("lang", ((1 << 20) * F.least(wanted / F.col("k"), F.lit(1.0)) + 1).alias("rate"))
    chosen = able.join(rates, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate"))  # a written table: Spark knows its size
    sizes = chosen.select(F.col("doc_id").alias("id"), "lang", F.octet_length("text").cast("long").alias("size"))
    fits = spark.createDataFrame(budgeted(sizes, "lang", budget // max(1, languages)), "doc_id long, lang string")  # bounded by the sample
    rows = chosen.join(F.broadcast(fits), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = rows.select("text", "lang", F.xxhash64("doc_id").alias("h"), "doc_id").collect()
    forget(counts)
    return [(r[0], r[1]) for r in sorted(found, key=lambda r: (r[2], r[3], r[1]))]


def fit(docs: DataFrame, modulo: int, left_out: int, sample: int, budget: int = 32 << 20) -> tuple[list[str], tuple[np.ndarray, np.ndarray | None], float, float]:
    """Languages, model, temperature, rejection threshold."""
    rows = learnable(docs, modulo, left_out, sample, budget)
    langs = sorted({r[1] for r in rows})
    if not langs:
        return [], (np.zeros((1 << BITS, 0)), None), 1.0, 0.0
    number = {lang: k for k, lang in enumerate(langs)}
    labels = np.array([number[r[1]] for r in rows])
    out = np.arange(len(rows)) % 5 == 4
    model = train([r[0] for r, o in zip(rows, out, strict=True) if not o], labels[~out], len(langs))
    heat, floor = 1.0, 0.0
    if out.any():
        z, y = class_scores(pa.array([r[0] for r, o in zip(rows, out, strict=True) if o]), model), labels[out]
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-9).mean()
        heat = float(min(np.geomspace(0.2, 5, 33), key=loss))
        p = softmax(z / heat)
        right = p.argmax(1) == y
        floor = float(np.quantile(p.max(1)[right], 0.005)) if right.any() else 0.0
    return langs, model, heat, floor


def identify(docs: DataFrame, modulo: int = 5, left_out: int = 0, sample: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs`` (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, modulo, left_out, sample))

    def run(batches):
        langs, model, heat, floor = shared.value
        for chunk in chunks(batches):
            text = chunk.column("text")
            raw, off = text_bytes(text)
            ascii_letter = np.add.reduceat(np.r_[((raw | 32) >= 97) & ((raw | 32) <= 122), False].astype(np.int64), off[:-1]) > 0 if len(off) > 1 else np.zeros(0, bool)
            ascii_letter &= np.diff(off) > 0
            for k in np.flatnonzero(~ascii_letter & (np.diff(off) > 0)):
                ascii_letter[k] = any(c.isalpha() for c in text[int(k)].as_py())
            known = ascii_letter & bool(langs)
            p = softmax(class_scores(text, model) / heat) if langs else np.zeros((len(text), 1))
            top = p.argmax(1)
            score = np.where(known, p.max(1), 0.0)
            named = np.array([*langs, "und"], object)[np.where(known, top, len(langs))]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(named.tolist(), pa.string()), pa.array(score), pa.array(score < floor)], ["doc_id", "lang_pred", "score", "rejected"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", F.coalesce(remainder("doc_id", modulo) == left_out, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")
