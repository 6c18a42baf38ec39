"""Benchmark decontamination against edit distances by brute force: repetitive texts, several items, wide letters, blocks."""

import random
import resource
import time

import numpy as np
import pyarrow as pa

from strataloom.llm import decontamination as D


def folded(t):
    return D.folded(pa.array([t]))[0][:-1].tobytes().strip()


def edits(a, b):
    """Least edits of a to a stretch of b."""
    row = [0] * (len(b) + 1)
    for x, c in enumerate(a, 1):
        old, row[0] = row[0], x
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (c != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def changed(rnd, t, n, letters):
    t = list(t)
    for _ in range(n):
        k = rnd.randrange(len(t))
        t[k : k + 1] = rnd.choice([[rnd.choice(letters)], [], [t[k], rnd.choice(letters)]])
    return "".join(t)


def test_several_items_wide_letters_and_small_slices(monkeypatch):
    monkeypatch.setattr(D, "SLICE", 256)
    rnd, letters = random.Random(3), "abé中ü "
    say = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    items = [say(n) for n in (40, 90, 25, 60)] + ["ab " * 30, "aaaaaaaaaaaaaaaa", "xyxyxyxyxyxyxyxyxyxyxyxyxy"]
    texts = [say(30) + changed(rnd, t, n, letters) + say(20) for t in items for n in range(0, 9, 2)]
    texts += [say(400), "ab " * 200, "ab c" * 100, "a" * 100, "xy" * 40, "", "中" * 30]
    held = D.Items(list(enumerate(items)), 10, 0.08)
    got = {(d, held.id[k]): e for d, k, e, *_ in D.found_in(pa.array(texts), held, 10)}
    want = {}
    for d, t in enumerate(texts):
        for k, own in enumerate(held.text):
            n = edits(own.tobytes(), folded(t))
            if n <= held.e[k]:
                want[d, held.id[k]] = n
    assert len(want) > 15 and got == want


def test_repetitive_megabyte_in_bounded_memory_and_time():
    held = D.Items([(1, "ab " * 400), (2, "ab ab ab ac " * 40)], 10, 0.08)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    for text in ("ab " * 350_000, "ab ac " * 175_000):
        got = {held.id[k]: e for _, k, e, *_ in D.found_in(pa.array([text]), held, 10)}
        assert got == ({1: 0} if text[3:5] == "ab" else {})
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_short_items_are_whole_words():
    held = D.Items([(1, "cat"), (2, "a"), (3, "big-cat")], 10, 0.08)
    texts = pa.array(["We concatenate strings.", "The cat!", "cat", None, "a big  CAT", "été a"])
    assert {(d, held.id[k]) for d, k, *_ in D.found_in(texts, held, 10)} == {(1, 1), (2, 1), (4, 1), (4, 2), (4, 3), (5, 2)}


def test_short_items_beside_letters_of_scripts_without_blanks():
    held = D.Items([(1, "日本"), (2, "AI"), (3, "ไทย"), (4, "本 AI")], 10, 0.08)
    texts = pa.array(["これは日本語です", "AI技術とMAIL", "the AI", "MAIL aid", "ภาษาไทยดี", "日 本", "한AI국", "日本AI", "xAIไ"])
    assert {(d, held.id[k]) for d, k, *_ in D.found_in(texts, held, 10)} == {(0, 1), (1, 2), (2, 2), (4, 3), (7, 1), (7, 2)}


def test_places_of_a_match_are_those_of_the_text():
    held = D.Items([(1, "one two three four five")], 10, 0.08)
    text = "é -- one,  two THREE four five. end"
    (_, _, n, _, begin, end), = D.found_in(pa.array([text]), held, 10)
    assert n == 0 and text.encode()[begin:end].decode() == "one,  two THREE four five"


def test_blocks_are_bounded_and_find_the_same(spark):
    rnd = random.Random(9)
    items = ["".join(rnd.choice("abcdefgh ") for _ in range(120)) for _ in range(12)]
    docs = spark.createDataFrame([(k, f"before {t} after", "m") for k, t in enumerate(items)] + [(99, "clean text", "m"), (None, items[0], "m")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)] + [(0, items[0], 1)] * 3, "item_id long, text string, doc_id int")
    whole = D.matches(docs, bench)
    small = D.matches(docs, bench, block_bytes=300)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, small.collect()), key=str) and whole.count() == 13
    assert [r.doc_id for r in D.clean(docs, bench, block_bytes=300).collect()] == [99]
    assert D.clean(docs, bench.where("false")).count() == docs.count() and D.clean(docs.where("false"), bench).count() == 0
    sizes = [sum(x.value.m) for x in D.blocks(bench, 10, 0.08, 300)]
    assert len(sizes) > 1 and max(sizes) <= 600 and sum(sizes) == sum(len(np.frombuffer(folded(t), np.uint8)) for t in items)
