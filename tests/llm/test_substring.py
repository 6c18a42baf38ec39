"""Repeated passages with hot anchors, repeated and null ids, clashing names, long texts, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from strataloom.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, n_words, n_removed, sha256) of rows in order."""
    seen, out = set(), []
    for i, text in rows:
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone.update(range(k, k + 20))
            seen.add(g)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def hot_corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(30))
    say = lambda n: [word() for _ in range(n)]
    phrase, passage, around = say(8), say(30), [say(9) for _ in range(4)]
    rows = []
    for k in range(80):
        text = say(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 4)):  # the same eight words with many contexts, some of which repeat
            left, right = (rnd.choice(around) if rnd.random() < 0.5 else say(9) for _ in range(2))
            text += left + phrase + right
        text += passage[: rnd.randint(15, 30)] if k % 3 == 0 else []
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_anchors(spark, seed):
    rows = hot_corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # many chunks in a task
    try:
        got = sorted(map(tuple, substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows) and sum(r[2] for r in got) > 500


def test_status_of_seeds_over_chunks():
    rnd = np.random.default_rng(3)
    key, ctx = rnd.integers(0, 4, 3000).astype(np.uint64), rnd.integers(0, 12, 3000).astype(np.uint64)
    key[2000:] += np.uint64(100)  # anchors that get no more than a few contexts
    ctx[2000:] %= np.uint64(2)
    doc, pos = rnd.permutation(3000), np.zeros(3000, np.int32)
    for size in (100, 700, 3000):
        known = substring.Known()
        status = np.concatenate([known.judge(key[k : k + size], ctx[k : k + size], doc[k : k + size], pos[k : k + size]) for k in range(0, 3000, size)])
        first = {}
        for k, c, d in zip(key, ctx, doc, strict=True):
            first[k, c] = min(d, first.get((k, c), d))
        for k, c, d, s in zip(key, ctx, doc, status, strict=True):
            assert s != 1 or d > first[k, c]  # settled: there is an earlier copy
        for k in set(key[status == 2].tolist()):  # hot anchors have sent two contexts
            assert len(set(ctx[(key == k) & (status == 0)].tolist())) >= 2
        assert (status == 2).any() and not (status[2000:] == 2).any()


def test_odd_ids_names_and_long_texts(spark):
    long = "word " * 30_000 + "x" * 100_000
    rows = [(1, "a b c"), (1, long), (None, long), (None, None), (2, long.replace("word", "other", 40)), (2, ""), (1, "a b c")]
    docs = spark.createDataFrame([(i, t, 9, 8, 7, "m", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, part int, __id long, row_at long, __marks string, `a.b` long")
    got = substring.rewrite(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, __import__("zlib").crc32((r[1] or "").encode()), len(r[1] or "")))
    want = sorted((i, n, m, h) for i, n, m, h in brute(order) if i is not None)
    assert sorted(tuple(r) for r in substring.remove_repeats(docs).collect() if r.doc_id is not None) == want
    assert sum(len(WORD.findall(r.text or "")) for r in got.collect()) == sum(n - m for _, n, m, _ in brute(order))
    assert substring.rewrite(docs.where("false")).count() == 0
