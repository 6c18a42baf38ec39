"""The trained models against plain loops, exhaustive search and finite differences."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from strataloom.llm import language_id as L
from strataloom.llm import quality_classifier as Q
from strataloom.llm import quality_rules, toxicity as T
from strataloom.llm.common import budgeted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_leaves_are_the_best_cuts():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        n = int(rnd.integers(1, 12))
        g, h = rnd.normal(size=n), rnd.uniform(0.1, 3, n)
        gain = lambda s, k, e: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + 1) for a, b in ((s, k), (k, e))) - g[s:e].sum() ** 2 / (h[s:e].sum() + 1)  # noqa: B023, E731
        cuts = [0, n]
        for _ in range(2):
            options = [(gain(s, k, e), k) for s, e in zip(cuts, cuts[1:], strict=False) for k in range(s + 1, e)]
            if options and max(options)[0] > 1e-9:
                cuts = sorted([*cuts, max(options)[1]])
        want = np.concatenate([np.full(e - s, g[s:e].sum() / (h[s:e].sum() + 1)) for s, e in zip(cuts, cuts[1:], strict=False)])
        assert np.allclose(Q.leaves(g, h), want)


def test_scores_are_sums_of_looked_up_values():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, len(Q.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(np.int64)
    m = Q.Model(x, y, rounds=8, pair_rounds=8)
    assert len(m.pairs) == 6
    for row, got in zip(x[:40], m.scores(x[:40]), strict=True):
        z = m.base
        for f, e in enumerate(m.edges):
            z += m.tables[f][sum(v <= row[f] for v in e)]
        for i, j, own in m.pairs:
            z += own[sum(v <= row[i] for v in m.coarse[i]) * Q.COARSE + sum(v <= row[j] for v in m.coarse[j])]
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert ((m.scores(x) > 0.5) == y).mean() > 0.8  # the pair is needed for that


def test_features_against_plain_python():
    rnd = random.Random(3)
    texts = [None, "", "  ", "The house of the é 你 A1!", "x | y\nx | y\n\nthe end!!", " ".join(rnd.choice(["the", "Haus", "##", "12", "é!"]) for _ in range(300))]
    got = Q.features(pa.array(texts), quality_rules.listed_hashes())
    low = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        w = WORD.findall(t)
        n, solid = max(1, len(w)), max(1, sum(map(len, w)))
        grams = list(zip(w, w[1:], w[2:], strict=False))
        inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        count = lambda pattern: len(re.findall(pattern, t))  # noqa: B023, E731
        want = [
            math.log1p(len(w)), sum(map(len, w)) / n, count("[A-Z]") / solid, count("[0-9]") / solid, count(r"[#*$%&|<>]") / n, count(r"[\x00-\x08\x0e-\x1f!\"'()+,\-./:;=?@\[\\\]^_`{}~\x7f]") / n,
            count(r"[^\x00-\x7f]") / solid, count(r"[\x20\x09-\x0d]") / n, math.log1p(t.count("\n") + 1 if t else 0), (len(lines) - len(set(lines))) / max(1, t.count("\n") + 1 if t else 0),
            len(inside) / n, len(set(w)) / n, sum(low(x) in quality_rules.COMMON for x in w) / n, t.count("|") / n, t.count("!") / n, math.log1p(max((len(x.encode()) for x in w), default=0)),
            sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w) / n,
        ]
        assert np.allclose(row, want), (t, dict(zip(Q.FEATURES, zip(row, want, strict=True), strict=True)))


def test_folded_scores_are_those_of_the_embedding():
    rnd = np.random.default_rng(4)
    vectors, weights = rnd.normal(size=(1 << L.BITS, 3)), rnd.normal(size=(3, 2))
    texts = ["Haus und Été", "", "ab", None, "x"]
    got = L.class_scores(pa.array(texts), (vectors @ weights, None))
    for t, row in zip(texts, got, strict=True):
        rows = [vectors[int(h)] for g, _ in L.ngrams(pa.array([t], pa.string())) for h in g]
        body = len((t or "").encode())
        assert len(rows) == sum(max(0, body - n + 1) for n in L.SIZES)
        assert np.allclose(row, np.mean(rows, 0) @ weights if rows else 0)


def test_one_step_goes_down_the_gradient():
    rnd = np.random.default_rng(5)
    texts, labels = ["der fluss geht", "the river walks", "the the", "haus"], np.array([0, 1, 1, 0])
    bags = list(map(L.bag, texts))
    vectors, weights = rnd.normal(size=(1 << L.BITS, 3)) / 3, rnd.normal(size=(3, 2))

    def loss(v, w):
        z = np.array([(v[i] * s[:, None]).sum(0) @ w for i, s in bags])
        return -np.log(L.softmax(z)[np.arange(len(labels)), labels]).mean()

    v, w = vectors.copy(), weights.copy()
    L.descend(v, w, bags, labels, 0.5)
    tiny = 1e-6
    for k in (bags[0][0][0], bags[1][0][3], bags[2][0][1]):
        for c in range(3):
            up, down = vectors.copy(), vectors.copy()
            up[k, c] += tiny
            down[k, c] -= tiny
            assert math.isclose((vectors - v)[k, c], 0.5 * (loss(up, weights) - loss(down, weights)) / (2 * tiny), rel_tol=1e-3, abs_tol=1e-7)
    for c in range(3):
        up, down = weights.copy(), weights.copy()
        up[c, 1] += tiny
        down[c, 1] -= tiny
        assert math.isclose((weights - w)[c, 1], 0.5 * 0.05 * (loss(vectors, up) - loss(vectors, down)) / (2 * tiny), rel_tol=1e-3, abs_tol=1e-7)


def subsequence_kernel(s, t):
    """Sum over common three-symbol subsequences, gaps paid by decay, counted one by one."""

    def weights(x):
        out = {}
        for i in range(T.LENGTH):
            for k in range(2, T.SPAN):
                for j in range(1, k):
                    u = x[i], x[i + j], x[i + k]
                    if all(u):
                        out[u] = out.get(u, 0) + T.DECAY ** (k + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b.get(u, 0) for u, v in a.items())


def test_landmark_map_gives_the_subsequence_kernel():
    text = pa.array(["You absolute grumblewort, go away", "grumble-wort und Haus"])
    code, starts, _ = T.stretch_starts(text)
    profiles = T.profile(code, starts)
    cut = [[int(code[p]) if p < len(code) else 0 for p in range(s, s + T.LENGTH + T.SPAN)] for s in starts]
    want = np.array([[subsequence_kernel(a, b) for b in cut] for a in cut])
    z = T.features(profiles)
    assert np.allclose(T.kernel(profiles, z), want, rtol=1e-4, atol=1e-6)
    x = T.kernel(profiles, z) @ T.inverse_root(z)  # all stretches are landmarks: the map gives the kernel itself
    assert np.allclose(x @ x.T, want, rtol=1e-2, atol=1e-3)


def test_machine_is_at_the_bottom_of_its_loss():
    rnd = np.random.default_rng(6)
    x, weight = rnd.normal(size=(80, 4)), rnd.uniform(0.5, 2, 80)
    y = np.where(x[:, 0] + 0.7 * rnd.normal(size=80) > 0.3, 1.0, -1.0)
    w = T.machine(x, y, weight)
    loss = lambda w: (weight * np.maximum(0, 1 - y * (np.c_[x, np.ones(80)] @ w)) ** 2).sum() + 1e-2 * (w**2).sum()
    for k in range(5):
        for step in (1e-3, -1e-3):
            other = w.copy()
            other[k] += step
            assert loss(other) > loss(w)


def test_samples_are_bounded_in_bytes(spark):
    rows = [(k % 40, k % 2, 100 + k) for k in range(200)] + [(None, 1, 5), (7, 1, 10**9)]
    got = budgeted(spark.createDataFrame(rows, "id long, y int, size long").where("id is not null"), "y", 3000)
    used = {(i, y): sum(s for j, z, s in rows if (j, z) == (i, y)) for i, y in got}
    assert len(got) > 4 and (7, 1) not in used
    for y in (0, 1):
        assert sum(s for (_, z), s in used.items() if z == y) <= 3000


def test_only_allowed_rows_are_learned(spark):
    held = lambda k, m, r: zlib.crc32(str(k).encode()) % m == r
    docs = spark.createDataFrame([(k, f"{'held' if held(k, 5, 0) else 'free'} text {k}", "ab"[k % 2]) for k in range(300)] + [(1, None, "a"), (2, "123", "a"), (None, "held none", "a")], "doc_id long, text string, lang string")
    got = L.learnable(docs, 5, 0, 10_000, 1 << 20)
    assert len(got) == sum(not held(k, 5, 0) for k in range(300)) and all("held" not in t for t, _ in got)
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] * 2, "doc_id long, toxic int")
    rows, share = T.labelled(docs.where("lang is not null and text like '% text %'"), labels, "toxic", 3, 1, 10_000, 1 << 20)
    assert {r[0] for r in rows} == {k for k in range(300) if not held(k, 3, 1)} and 0.4 < share < 0.6


def test_scores_do_not_depend_on_blocks(monkeypatch):
    rnd = random.Random(1)
    text = pa.array([" ".join(rnd.choice(["you", "gr_umble", "haus", "x" * 40, ""]) for _ in range(rnd.randint(0, 60))) for _ in range(30)] + [None, ""])
    weights = np.random.default_rng(1).random(T.SYMBOLS**3).astype(np.float32)
    code, starts, doc = T.stretch_starts(text)
    want = T.stretch_scores(code, starts, weights)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(T, "BLOCK", size)
        assert np.allclose(T.stretch_scores(code, starts, weights), want)
    assert (np.diff(doc) >= 0).all()
