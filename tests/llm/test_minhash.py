"""Near duplicates with repeated and null ids, and which rows stay, against brute force."""

import itertools
import random
import re

import pytest

from strataloom.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset({tuple(w)}) if w else frozenset()


def groups(rows, percent, by_id):
    """Component number of each row with words."""
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            same = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if same or by_id and rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                top[i] = top[j] = min(top[i], top[j])
    return sets, top


def corpus(seed):
    rnd = random.Random(seed)
    say = lambda n: [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(40)) for _ in range(n)]
    rows = []
    for _ in range(14):
        base = say(rnd.randint(30, 90))
        for _ in range(rnd.randint(1, 5)):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = "zz" + str(rnd.randrange(99))
            rows.append((rnd.choice([None, *range(25)]), " ".join(w)))
    rows += [(3, None), (None, None), (4, ""), (None, "  "), (7, "one two"), (None, "One  two"), *rows[:4], *rows[:2]]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_that_repeat_or_lack(spark, seed):
    rows = corpus(seed)
    sets, top = groups(rows, 85, True)
    want = []
    for k, (i, _) in enumerate(rows):
        name = min((rows[j][0] for j in range(len(rows)) if sets[k] and top[j] == top[k] and sets[j] and rows[j][0] is not None), default=None) if sets[k] else i
        want.append((i, len(sets[k]), name, i == name if i is not None and name is not None else name is None))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_id_with_two_texts_links_both(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}
    kept = minhash.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b)]


@pytest.mark.parametrize("seed", [4, 5])
def test_one_row_of_each_component_stays(spark, seed):
    rows = corpus(seed)
    sets, top = groups(rows, 80, False)
    docs = spark.createDataFrame([(i, t, "x", k, "k") for k, (i, t) in enumerate(rows)], "doc_id long, text string, own_id string, __part long, key string")
    got = minhash.keep(docs)
    assert got.columns == docs.columns
    got = got.collect()
    with_words = [r for r in got if shingles(r.text)]
    assert len(with_words) == len({top[k] for k in range(len(rows)) if sets[k]})
    for r in with_words:
        k = r["__part"]
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[k] and sets[j] and rows[j][0] is not None]
        assert r.doc_id == min(ids, default=None)
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None and not shingles(r.text)) == [(3, None), (4, "")]
    assert minhash.keep(docs.where("false")).count() == 0


def test_null_ids_go_if_a_numbered_row_has_their_set(spark):
    rows = [(1, "a b c d e f"), (None, "A b c d e f"), (None, "g h i j k l"), (None, "g h i j k l")]
    got = minhash.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "g h i j k l"), (1, "a b c d e f")]


def test_bands_follow_the_threshold():
    for percent in (70, 80, 85, 90, 95):
        bands, rows = minhash.layout(percent)
        assert bands * rows <= 126 and (1 - (percent / 100) ** rows) ** bands <= 1e-6
    assert minhash.layout(85) == (25, 5) and minhash.layout(80) == (31, 4)
