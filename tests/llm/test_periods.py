"""Periodic runs against comparison of every word with every later one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("strataloom.llm")
from strataloom.llm import periods  # noqa: E402


def brute(x, least=12):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_transforms_are_exact():
    rnd = np.random.default_rng(0)
    for size in (2, 8, 64):
        a = rnd.integers(0, periods.PRIME, (3, size)).astype(np.uint64)
        assert (periods.back(periods.transform(a.copy())) == a).all()
    block, window = rnd.integers(0, 9, (4, 8)).astype(np.uint64), rnd.integers(0, 9, (4, 23)).astype(np.uint64)
    got = periods.squared_differences(block, window)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(block[r], window[r, k : k + 8], strict=True)) for k in range(16)] for r in range(4)]
    assert got.tolist() == want


def test_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(600):
        n, a = rnd.randint(0, 150), rnd.choice([1, 2, 2, 3, 5, 40])
        x = [rnd.randrange(a) for _ in range(n)]
        for _ in range(rnd.randint(0, 4) if n > 4 else 0):
            q, s = rnd.randint(1, max(1, n // 3)), rnd.randrange(n)
            for k in range(s + q, min(n, s + rnd.randint(q, 5 * q + 3))):
                x[k] = x[k - q]
        assert periods.find_runs(np.array(x, np.int64)) == brute(x)


def test_runs_of_words_rich_in_them():
    a, b = "0", "01"
    while len(b) < 900:
        a, b = b, b + a
    morse = "".join(str(k.bit_count() % 2) for k in range(700))
    for word in (b, morse, "0" * 500, ("0" * 60 + "1") * 12, "01" * 200 + "011" * 150):
        x = [int(c) for c in word]
        found = periods.find_runs(np.array(x, np.int64))
        assert found == brute(x) and found


def test_long_texts_take_little_time():
    x = np.tile(np.random.default_rng(0).integers(0, 500, 1000), 200)
    assert periods.find_runs(x) == [(0, 200_000, 1000)]


def test_documents(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcde") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    texts += [None, "", " \n\t", "one", "spam " * 500, "a b\x0bc\x0cd\r" * 20, "é è " * 15, "x y z " * 7 + "end"]
    rows = [*enumerate(texts), (None, "spam " * 30), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "r", 5) for i, t in rows], "doc_id long, text string, runs string, period int")
    got = sorted(map(repr, (tuple(r) for r in periods.periodic_runs(docs, tail=periods.tail_period).collect())))
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            w = w[:a] + [w[a + (k - a) % (1 + (n - a) // (3 + h // 10 % 8))] for k in range(a, n)]
        runs = brute(w)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append(repr((i, n, len(runs), *((*top, 1000 * top[1] // top[2]) if top else [None] * 4), len(gone), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))))
    assert got == sorted(want)


def test_texts_and_runs(spark):
    docs = spark.createDataFrame([(1, "go " + "a b c " * 5 + "end"), (2, None)], "doc_id long, text string")
    one, two = periods.periodic_runs(docs, texts=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(1, 15, 3)] and one.clean_text == "go a b c end" and one.n_dropped == 12
    assert two.runs == [] and two.clean_text is None
    assert periods.periodic_runs(docs.limit(0), texts=True).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, least=5)
