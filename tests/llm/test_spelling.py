"""Spelling variants against brute force over every edit."""

import collections
import random
import re
import zlib

import pytest

pytest.importorskip("strataloom.llm")
from strataloom.llm import spelling  # noqa: E402

LETTERS = [chr(x) for x in [*range(97, 123), *range(0xC0, 0x100)]]


def edits(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + k :] for i in range(len(w) + 1) for a in LETTERS for k in (0, 1)}


def brute(rows):
    count = collections.Counter()
    for i, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            r = r if h % 31 else r[: h % len(r)] + r[h % len(r) + 1 :]
            count[r] += len(r) >= 7
    v = {w: n for w, n in count.items() if n >= 2}
    near = {w: [x for x in edits(w) if x in v and x != w] for w in v}
    best = {w: min(near[w], key=lambda x: (-v[x], x), default=None) for w in v}
    form = {w: b if b and v[b] >= 10 * v[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), v[w], len(near[w]), v[form[w]] if form[w] else None) for w in v}


def corpus():
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdeéÿ÷") for _ in range(rnd.randint(6, 12))) for _ in range(40)] + ["z" * 80, "aaaaaaaa"]
    rows = []
    for d in range(120):
        words = []
        for _ in range(60):
            w = base[min(int(rnd.expovariate(0.15)), len(base) - 1)]
            for _ in range(rnd.choice([0] * 8 + [1, 1, 2])):
                i = rnd.randrange(len(w))
                w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abé") + w[i + 1 :], w[:i] + rnd.choice("abz") + w[i:], w.upper()])
            words.append(w)
        rows.append((d, " ".join(words)))
    chain = ["mmmmmmm"] * 2 + ["mmmmmmmm"] * 20 + ["mmmmmmmmm"] * 300 + ["mmmmmmmmmm"] * 4000  # forms of forms of forms
    return [*rows, *((500 + k, w) for k, w in enumerate(chain)), (None, "aaaaaaaa bbbbbbbb bbbbbbbb"), (5, None), (6, ""), (7, "ZZZZ" * 30 + " " + "zzzz" * 30), (7, "ZZZZ" * 30 + " " + "zzzz" * 30)]


def test_variants(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = brute(rows)
    assert any(f and r != f for f, r, *_ in want.values())
    plain = lambda df: {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    assert plain(spelling.variants(docs, alter=spelling.drop_letters)) == want
    monkeypatch.setattr(spelling, "SEGMENT", 1)  # many rounds, several filters for a length
    sizes = collections.Counter(min(len(w), 64) for w in want)
    layout = spelling.Layout(sizes, 0.00007)
    assert layout.rounds > 2 and layout.parts.max() > 1
    assert plain(spelling.variants(docs, alter=spelling.drop_letters, filter_mb=0.00007)) == want


def test_filters_let_every_word_through(spark):
    words = sorted({"".join(random.Random(k).choices("abcdefgh", k=7 + k % 5)) for k in range(5000)})
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    layout = spelling.Layout(collections.Counter(map(len, words)), 32)
    codes = spelling.Codes(words)
    mine, block = layout.block(codes.hashes(), codes.lens, 0)
    held = spelling.build(vocab, layout, 0)
    assert len(mine) == len(words) and len(spelling.passed(held, codes.hashes(), block)) == len(words)
    other = spelling.Codes(["x" + w[1:] for w in words])
    mine, block = layout.block(other.hashes(), other.lens, 0)
    assert len(spelling.passed(held, other.hashes()[mine], block)) < 0.02 * len(words)


def test_edit_hashes_are_those_of_the_edits():
    codes = spelling.Codes(["abbbcé", "zz", "q" * 70])
    h, at = codes.deleted(0, len(codes.codes))
    built = [codes.words[codes.word[p]][: codes.place[p]] + codes.words[codes.word[p]][codes.place[p] + 1 :] for p in at]
    assert (h == spelling.Codes(built).hashes()).all() and len(set(built)) == len(built) == 4 + 1 + 1
    h, at, letter = codes.replaced(0, 6)
    built = [codes.words[0][: codes.place[p]] + chr(c) + codes.words[0][codes.place[p] + 1 :] for p, c in zip(at, letter, strict=True)]
    assert (h == spelling.Codes(built).hashes()).all()


def test_nothing_to_group(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"] and spelling.variants(empty).count() == 0
    alone = spark.createDataFrame([(1, "lonesome lonesome")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(alone).collect()] == [("lonesome", None, "lonesome", 2, 0, None)]
