"""Toxicity by a subsequence string kernel and a support vector machine with Nystroem landmarks.

The kernel of two stretches of text is the sum over all three-letter subsequences u of phi_u(s) phi_u(t), where phi_u(s)
adds ``decay`` to the power of the covered length for each occurrence that spans at most ``SPAN`` characters. Gaps cost
only decay, so insults with characters put in between, or left out, stay close to the plain ones. Letters are folded
(case, common digits and @ for letters, letters beyond ASCII to a few codes); the blank before a word is a symbol of its
own, so word beginnings count; all else lengthens a gap and matches nothing.

Stretches begin before each word, at each sign inside a word that is no letter and has a letter behind it, and every
``STRIDE`` places inside words of more than ``LENGTH``, in fit and scoring alike, so no place of a text without blanks is
left out; there, without a blank before it, a word has no word beginning. ``LENGTH`` places of a stretch can begin a subsequence.

Training: the labels mark documents, not sentences, so stretches stand in for labelled sentences. Labelled documents (about
``sample`` of each label and ``budget`` bytes of text of each at most: documented limits, chosen by a hash of the id, and
weighted back to the share of toxic ones in the calibration) are cut into stretches at these places. A toxic document is
known to hold a toxic stretch, not where: the stretch is first taken by how much more often toxic documents hold its word or
the word's stem, then by the highest score, in turns with the fit. Landmarks are stretches of both kinds; K_nm K_mm^(-1/2) is the feature map and a squared-hinge machine is fitted by Newton steps. Because the kernel is a
sum over subsequences, the machine is a table with one weight for each of them: the score of every stretch of a whole
text is a sum of table values, and a document takes its three highest separate stretches, calibrated by a logistic curve.

Null, empty and letter-free texts score like a text without any subsequence. With labels of one kind only, the score is
the share of 1 (0.5 without labels). Rows are kept one for one; equal rows of labels count once, a document with both labels
with each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_BLANK, budgeted, chunks, mix, remainder, share, text_bytes

SPAN, LENGTH = 6, 13
STRIDE = LENGTH - SPAN
#: Places that are scored at a time.
BLOCK = 1 << 20
#: Symbols: 0 gap, 1-26 letters, ACCENTED codes of letters beyond ASCII, then the blank before a word.
ACCENTED = 11
EDGE = 27 + ACCENTED
SYMBOLS = EDGE + 1
PAIRS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
CODE = np.zeros(256, np.int8)
CODE[97:123] = np.arange(1, 27)
CODE[65:91] = np.arange(1, 27)
for sign, letter in zip("0134578@", "oieastba", strict=True):
    CODE[ord(sign)] = ord(letter) - 96
CODE[128:192] = 27 + (np.arange(128, 192) | 32) % ACCENTED  # the last bytes tell the letter; its case is bit 32
DECAY = 0.6
#: Share of a subsequence below which the metric of the kernel stops growing.
FLOOR = 2e-5
#: Log-likelihood ratio from which a word marks a toxic stretch in the first turn.
SURPRISE, RATIO = 30.0, 6
#: Letters of the word beginnings that are counted in the first turn.
STEMS = (4, 5, 6, 7, 24)
#: Peaks of a document that the calibration sees, and the limits of their scores.
TOP, LIMITS = 3, (-1.5, 2.0)


def stretch_starts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts with a blank before and LENGTH gaps after each, the places where stretches begin, and the text of each."""
    raw, off = text_bytes(text)
    n = len(off) - 1
    body = raw < 192  # the first byte of a letter beyond ASCII takes no place
    upto = np.cumsum(body, dtype=np.int32 if len(body) < 1 << 31 else np.int64)
    off = np.where(off > 0, upto[off - 1], 0).astype(np.int64) if len(upto) else off
    raw = raw[body]
    del body, upto
    bounds = off[:-1] + np.arange(n) * (LENGTH + 1)
    letters = np.ones(len(raw) + n * (LENGTH + 1), bool)
    letters[bounds] = False
    letters[((bounds + 1 + np.diff(off))[:, None] + np.arange(LENGTH)).ravel()] = False
    code, solid = np.zeros(len(letters), np.int8), np.zeros(len(letters), bool)
    code[letters], solid[letters] = CODE[raw], ~IS_BLANK[raw]
    begins = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    size = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1 - begins
    begin = np.zeros(len(code), bool)
    begin[:-1] = solid[:-1] & (code[:-1] == 0) & (code[1:] > 0)
    code[begins - 1] = EDGE
    begin[begins - 1] = True
    long = size > LENGTH
    many = (size[long] - 2) // STRIDE
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + 1
    begin[np.repeat(begins[long] - 1, many) + STRIDE * nth] = True
    starts = np.flatnonzero(begin)
    return code, starts, np.searchsorted(bounds, starts, "right") - 1


def subsequences(code: np.ndarray):
    """For each pair of gaps: the subsequence that begins at each place (0: none), and its weight."""
    n, code = len(code) - SPAN, code.astype(np.int32)
    for j, k in PAIRS:
        if n > 0:
            a, b, c = code[:n], code[j : j + n], code[k : k + n]
            yield np.where((a > 0) & (b > 0) & (c > 0), (a * SYMBOLS + b) * SYMBOLS + c, 0), DECAY ** (k + 1)


def blocks(code: np.ndarray):
    """Where each block of places begins, and its codes with those that stretches from it can reach."""
    for at in range(0, max(len(code) - SPAN, 0), BLOCK):
        yield at, code[at : at + BLOCK + LENGTH + SPAN]


def stretch_scores(code: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each start (in order), the sum of the table values of all subsequences that begin in its LENGTH places."""
    out = np.zeros(len(starts))
    for at, part in blocks(code):
        s, e = np.searchsorted(starts, [at, at + BLOCK])
        if s == e:
            continue
        total = np.zeros(len(part) - SPAN + 1)
        for u, d in subsequences(part):
            total[1:] += weights[u] * np.float32(d)
        total = np.cumsum(total)
        own = starts[s:e] - at
        out[s:e] = total[np.minimum(own + LENGTH, len(total) - 1)] - total[own]
    return out


def peaks(score: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The TOP highest local maxima of each document's stretch scores, within LIMITS (lower limit: missing)."""
    out = np.full((n_docs, TOP), LIMITS[0])
    if len(score):
        edge = doc[1:] != doc[:-1]
        rise, fall = np.r_[True, edge | (score[1:] >= score[:-1])], np.r_[edge | (score[:-1] > score[1:]), True]
        at = np.flatnonzero(rise & fall)
        at = at[np.lexsort((-score[at], doc[at]))]
        own = doc[at]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        top = rank < TOP
        out[own[top], rank[top]] = np.clip(score[at[top]], *LIMITS)
    return out


def document_scores(text: pa.Array, model: tuple) -> np.ndarray:
    """Log odds that each text is toxic."""
    weights, offset, slopes, base = model
    code, starts, doc = stretch_starts(text)
    return peaks(stretch_scores(code, starts, weights) + offset, doc, len(text)) @ slopes + base


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, turns: int = 25) -> tuple[np.ndarray, float]:
    """Slopes and base of a weighted logistic curve over the peaks, by Newton steps with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag(np.r_[np.ones(x.shape[1] - 1), 1e-3])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - y)) + penalty @ w), -2, 2)
    return w[:-1], float(w[-1])


def profile(code: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Subsequences of the stretch at each start, with their weights."""
    at = starts[:, None] + np.arange(LENGTH + SPAN)
    near = np.where(at < len(code), code[np.minimum(at, len(code) - 1)], 0)
    rows = list(subsequences(near.T))
    u = np.concatenate([u.T for u, _ in rows], 1)
    d = np.repeat([d for _, d in rows], LENGTH)
    return [(x[x > 0], d[x > 0]) for x in u]


def features(profiles: list) -> np.ndarray:
    """A column for each stretch, a row for each subsequence."""
    out = np.zeros((SYMBOLS**3, len(profiles)), np.float32)
    for k, (u, d) in enumerate(profiles):
        np.add.at(out[:, k], u, d)
    return out


def kernel(profiles: list, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of stretches (rows) and landmarks (columns of ``features``)."""
    return np.array([d @ landmarks[u] if len(u) else np.zeros(landmarks.shape[1]) for u, d in profiles])


def inverse_root(landmarks: np.ndarray) -> np.ndarray:
    """K_mm^(-1/2) of the landmarks, up to a rotation, without directions of no weight."""
    value, vector = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    keep = value > 1e-6 * value.max()
    return vector[:, keep] / np.sqrt(value[keep])


def stem_hashes(code: np.ndarray, starts: np.ndarray, sizes: tuple):
    """For each size: a hash of the letters behind each word's blank, up to that many or the first place that is no letter."""
    h, alive = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    for k in range(1, max(sizes) + 1):
        c = code[np.minimum(starts + k, len(code) - 1)]
        alive &= (c > 0) & (c < EDGE)
        h[alive] = mix(h[alive] * np.uint64(SYMBOLS) + c[alive].astype(np.uint64))
        if k in sizes:
            yield h


def surprise(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratios of words in a of n toxic and b of m other documents; 0 if not RATIO times as frequent."""
    p = (a + b) / max(1, n + m)
    part = lambda k, t, q: k * np.log(np.maximum(k, 1) / np.maximum(t * q, 1e-9))
    out = 2 * (part(a, n, p) + part(n - a, n, 1 - p) + part(b, m, p) + part(m - b, m, 1 - p))
    return np.where(a * m < RATIO * b * n, 0.0, out)


def word_odds(code: np.ndarray, starts: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The highest log-likelihood ratio among the stems of the word at each start."""
    n = np.bincount(labels, minlength=2)
    odds = np.zeros(len(starts))
    for h in stem_hashes(code, starts, STEMS):
        order = np.lexsort((doc, h))
        stem, own = h[order], doc[order]
        fresh = np.r_[True, stem[1:] != stem[:-1]]
        group = np.cumsum(fresh) - 1
        once = fresh | np.r_[True, own[1:] != own[:-1]]  # one row a stem and document
        seen = [np.bincount(group[once & (labels[own] == y)], minlength=group[-1] + 1) for y in (0, 1)]
        odds[order] = np.maximum(odds[order], surprise(seen[1], n[1], seen[0], n[0])[group])
    return odds


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, turns: int = 20) -> np.ndarray:
    """Squared-hinge linear machine (last column: intercept) by Newton steps over the active rows, a thousand at a time."""
    w, before = np.zeros(x.shape[1] + 1), None
    for _ in range(turns):
        active = y * (x @ w[:-1] + w[-1]) < 1
        if before is not None and (active == before).all():
            break
        before, left, right = active, ridge * np.eye(len(w)), np.zeros(len(w))
        rows = np.flatnonzero(active)
        for at in range(0, len(rows), 1000):
            k = rows[at : at + 1000]
            part = np.c_[x[k], np.ones(len(k))]
            own = part.T * weight[k]
            left += own @ part
            right += own @ y[k]
        w = np.linalg.solve(left, right)
    return w


def fit(texts: list[str], labels: np.ndarray, landmarks: int = 320, turns: int = 3, seed: int = 11, prior: float | None = None) -> tuple[np.ndarray, float, np.ndarray, float]:
    """Weights of all subsequences, the machine's offset, slopes and base of the calibration (for a share ``prior`` of 1)."""
    random = np.random.default_rng(seed)
    zero = np.zeros(SYMBOLS**3, np.float32)
    share_ = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return zero, 0.0, np.zeros(TOP), float(np.log((share_ + 1e-3) / (1 - share_ + 1e-3)))
    code, starts, doc = stretch_starts(pa.array(texts))
    odds = word_odds(code, starts, doc, labels) if len(starts) else np.zeros(0)
    common = sum((d * np.bincount(u[:BLOCK], minlength=SYMBOLS**3) for _, part in blocks(code) for u, d in subsequences(part)), np.zeros(SYMBOLS**3))
    common[0] = 0
    metric = 1 / np.sqrt(common / common.sum() + FLOOR) * np.sqrt(FLOOR)  # rare subsequences tell more
    weights, offset, bad = zero, 0.0, np.zeros(0, np.int64)
    for turn in range(turns):
        score = stretch_scores(code, starts, weights) + offset if turn else odds - SURPRISE
        order = np.lexsort((-score, doc))
        best = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
        toxic = labels[doc[best]] == 1
        own = best[toxic]
        if turn == 0:
            base = np.flatnonzero((labels[doc] == 1) & (score > 0))
            base = random.choice(base, min(len(base), 2500), False) if len(base) else own
        good = np.unique(np.r_[base, own[score[own] > 0]])
        clean = np.flatnonzero(labels[doc] == 0)
        hard = clean[np.argsort(-score[clean], kind="stable")[:1500]]
        bad = np.unique(np.r_[bad, best[~toxic], hard, random.choice(clean, min(len(clean), 1500), False)])
        profiles = [(u, d * metric[u]) for u, d in profile(code, starts[np.r_[good, bad]])]
        y = np.r_[np.ones(len(good)), -np.ones(len(bad))]
        chosen = np.r_[random.choice(len(good), min(len(good), landmarks // 2), False), len(good) + random.choice(len(bad), min(len(bad), landmarks // 2), False)]
        z = features([profiles[k] for k in chosen])
        root = inverse_root(z)
        x = kernel(profiles, z) @ root
        scale = max(1e-9, float(np.abs(x).std()))
        x /= scale
        w = machine(x, y, np.where(y > 0, len(bad) / max(1, len(good)), 1.0))
        weights = ((z @ (root @ (w[:-1] / scale))) * metric).astype(np.float32)
        weights[0], offset = 0, float(w[-1])
        del x, z, profiles
    top = peaks(stretch_scores(code, starts, weights) + offset, doc, len(texts))
    prior = share_ if prior is None else prior
    slopes, base = calibrate(top, labels, np.where(labels == 1, prior / share_, (1 - prior) / (1 - share_)))
    return weights, offset, slopes, base


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulo: int, left_out: int, sample: int, budget: int) -> tuple[list, float | None]:
    """(id, text, label) of about ``sample`` learnable documents of each label, ``budget`` bytes of each at most, and the
    share of 1 among all of them. Ids are sampled first, then sizes; only the texts that fit are collected."""
    able = labels.select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("y")).where((remainder("doc_id", modulo) != left_out) & F.col("y").isin(0, 1)).distinct()
    n = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in able.groupBy("y").count().collect()}
    chosen = able.where(F.when(F.col("y") == 1, share("doc_id", sample, n[1])).otherwise(share("doc_id", sample, n[0])))  # bounded by the sample
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("id"), "y", F.octet_length("text").cast("long").alias("size"))
    fits = docs.sparkSession.createDataFrame(budgeted(sizes, "y", budget), "doc_id long, y int")
    rows = texts.join(F.broadcast(fits), "doc_id").collect()
    return sorted(((r[0], r[1], r[2]) for r in rows), key=lambda r: (r[0], r[2], r[1])), n[1] / (n[0] + n[1]) if n[0] + n[1] else None


def score(docs: DataFrame, labels: DataFrame, modulo: int = 3, left_out: int = 1, sample: int = 1500, budget: int = 8 << 20, target: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); labels: doc_id and ``target``."""
    rows, prior = labelled(docs, labels, target, modulo, left_out, sample, budget)
    shared = docs.sparkSession.sparkContext.broadcast(fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), prior=prior))

    def run(batches):
        for chunk in chunks(batches):
            s = 1 / (1 + np.exp(-np.clip(document_scores(chunk.column("text"), shared.value), -30, 30)))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", modulo) == left_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
