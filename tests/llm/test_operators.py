"""Training-data operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strataloom.llm import decontamination, language_id, minhash, pieces, quality_classifier, quality_rules, sharding, substring, token_counts, toxicity  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marks string, key string"


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 150))) for _ in range(n)]
    texts += [texts[3], texts[5] + " more words", texts[7].upper(), texts[1] + "\n" + texts[2], texts[9][: len(texts[9]) // 2] + " x y z " + texts[9][len(texts[9]) // 2 :]]
    texts += [None, "", "   ", "one", "one", "a b\tc\nd  e", "!!! ???", "word " * 4000]
    return [(k, t, "ab"[k % 2], "s", 0, "m", "k") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids."""
    rows = corpus(5, 12)
    return spark.createDataFrame([*rows, rows[0], (None, rows[1][1], None, None, None, None, None), (None, None, None, None, None, None, None), (2, "other text", None, "s", 1, "m", "k")], SCHEMA)


def plain(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_base_counts(docs):
    got = plain(quality_rules.judge(docs))
    for k, text, *_ in corpus():
        w = WORD.findall(text or "")
        grams = list(zip(w, w[1:], w[2:], strict=False))
        inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 500 else set(range(len(w)))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))
        assert tuple(got[k][c] for c in quality_rules.COUNTS) == want
        assert got[k].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_distance_is_jensen_shannon():
    h, r = np.array([[1, 3, 0], [0, 0, 0], [2, 2, 4]]), np.array([2, 2, 4])
    d = quality_rules.distances(h, r)
    p, q = h[0] / 4, r / 8
    m = (p + q) / 2
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    assert abs(d[0] - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-12 and d[1] == 0 and d[2] == 0


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs):
    sets = {k: shingles(t) for k, t, *_ in corpus()}
    top = {k: k for k in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                top[a] = top[b] = min(top[a], top[b])
    got = plain(minhash.near_duplicates(docs))
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), top[k], top[k] == k) for k in sets}


def test_prefix_filter_loses_no_pair(spark):
    rnd = random.Random(1)
    base = rnd.sample(range(10_000), 60)
    sets = {k: sorted({*rnd.sample(base, 56), *(rnd.randrange(10_000) for _ in range(rnd.randint(0, 8)))}) for k in range(40)}
    held = spark.createDataFrame([(k, bytearray(np.array(s, np.int64).tobytes())) for k, s in sets.items()], "id long, set binary")
    named = spark.createDataFrame([(k, k) for k in sets], "x long, component long")
    got = {tuple(sorted(r)) for r in minhash.prefix_pairs(held, named, 85).collect()}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})}
    assert want and want <= got


def test_substring(docs):
    got, seen = plain(substring.remove_repeats(docs, texts=True)), set()
    for k, text, *_ in corpus():
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone.update(range(i, i + 20))
            seen.add(g)
        kept = [x for i, x in enumerate(w) if i not in gone]
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert WORD.findall(got[k].clean_text or "") == kept and (got[k].clean_text is None) == (text is None)


def test_rewrite_keeps_rows_and_columns(docs, odd):
    for d in (docs, odd):
        out = substring.rewrite(d)
        assert out.columns == d.columns and out.count() == d.count()


def test_shards(docs, odd):
    for d in (docs, odd):
        rows = sharding.balanced_shards(d, 4).orderBy("shard", "slot").collect()
        sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
        assert len(rows) == d.count() and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
        for s in range(4):
            own = [r.slot for r in rows if r["shard"] == s]
            assert own == list(range(len(own)))


def test_token_counts(docs):
    sp, got = token_counts.model(PATH), plain(token_counts.token_counts(docs, PATH))
    for k, text, *_ in corpus():
        assert (got[k].n_tokens, got[k].n_bytes) == (len(sp.encode(text or "")), len((text or "").encode()))


def test_pre_tokens_add_up():
    sp = token_counts.model(PATH)
    for text in ["", " ", "  a", "a  ", "a \n b", "<s> x</s>", "é ü 你好", "a" * 300, "\t\t x"]:
        words = token_counts.pre_tokens(text) if text else []
        assert sum(token_counts.lengths_of(PATH, words)) == len(sp.encode(text))


def test_nbest_against_enumeration():
    lat = pieces.lattice(PATH)

    def every(word, v):
        if v == 0:
            return [(0.0, ())]
        return [(a + s, x + ((i,) if i else tuple(lat.byte[b] for b in word[u:v].encode()))) for u, i, s in lat.edges(word, v) for a, x in every(word, u)]

    for text in ["hello you", "a  b", "x", " ☃ é", "ab\ncd", " "]:
        flat, _, ways = lat.encode([text], 5)
        words = "".join("▁" + w.replace(" ", "▁") for w in token_counts.pre_tokens(text))
        best = sorted(every(words, len(words)), reverse=True)[:5]
        assert np.allclose([s for s, _ in best], [s for s, _ in ways[0]]) and lat.decode(flat) == text
        assert len({tuple(lat.changed(flat, c)) for _, c in ways[0]}) == len(best)


def test_nbest_of_long_words():
    lat, rnd, n = pieces.lattice(PATH), random.Random(6), 100_000
    words = [rnd.choice(["house", "river", "été", "walks", "x1"]) for _ in range(n)]
    for text, many in [("\n".join(words)[:n], 4), ("\t".join(words)[:n], 4), ("a" * n, 4), ("".join(words)[:n], 4), ("\u4f60\u597d" * (n // 2), 1)]:  # no piece has those two signs
        flat, _, ways = lat.encode([text], 4)
        assert lat.decode(flat) == text
        assert len({lat.changed(flat, c).tobytes() for _, c in ways[0]}) == len(ways[0]) == many
        assert all(lat.decode(lat.changed(flat, c)) == text for _, c in ways[0])
        scores = [s for s, _ in ways[0]]
        assert scores == sorted(scores, reverse=True)


def test_nbest_with_cuts_and_ties_against_enumeration():
    lat = pieces.lattice(PATH)

    def best(word, n):  # the n best scores at each position, kept by brute force
        at = [[0.0]]
        for v in range(1, len(word) + 1):
            at.append(sorted((a + s for u, _, s in lat.edges(word, v) for a in at[u]), reverse=True)[:n])
        return at[-1]

    for text in ["a" * 300, "ab" * 200, "abc\ndef\tghi" * 30, "house" * 60, "\u4f60x" * 40, "q" + " " * 50, "x" * 24, "x" * 25, "x" * 255, "x" * 256, "x" * 257]:
        flat, _, ways = lat.encode([text], 6)
        words = "".join("▁" + w.replace(" ", "▁") for w in token_counts.pre_tokens(text))
        assert np.allclose(best(words, 6), [s for s, _ in ways[0]], rtol=1e-12) and lat.decode(flat) == text
        assert len({tuple(lat.changed(flat, c)) for _, c in ways[0]}) == len(ways[0])


def test_round_trip(docs):
    rows = pieces.segment(docs, PATH, every=True).collect()
    back = {r.doc_id: r.text for r in pieces.decode(pieces.segment(docs, PATH).select("doc_id", "ids"), PATH).collect()}
    for (k, text, *_), r in zip(corpus(), sorted(rows, key=lambda r: r.doc_id), strict=True):
        assert (r.ids is None) == (text is None) and r.round_trip in (None, True) and back[k] == text


def edits(a, b):
    """Least edits of a to a stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination(spark):
    rnd = random.Random(2)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(150)).strip()
    fold = lambda t: decontamination.folded(pa.array([t]))[0][:-1].tobytes().strip()
    texts = [None, "", item, "x y " + item.upper() + " z"]
    for n in range(0, 26, 2):
        t = list(item)
        for _ in range(n):
            k = rnd.randrange(len(t))
            t[k : k + 1] = rnd.choice([["q"], [], [t[k], "q"]])
        texts.append("before it " + "".join(t) + " after")
    texts.append("".join(rnd.choice("abcdefgh ") for _ in range(2000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "zzz9")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.matches(docs, bench).collect()}
    budget = int(0.08 * len(fold(item)))
    want = {(k, 1): edits(fold(item), fold(t)) for k, t in enumerate(texts) if t and edits(fold(item), fold(t)) <= budget}
    assert got == want
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == {k for k in range(len(texts)) if (k, 1) not in want}


def test_models_learn(spark):
    rnd = random.Random(4)
    words = {"x": ["the", "house", "river", "walks"], "y": ["der", "haus", "fluss", "geht"]}
    rows = []
    for k in range(400):
        lang = "xy"[k % 2]
        w = [rnd.choice(words[lang]) for _ in range(60)]
        if k % 5 == 0:
            w[rnd.randrange(60)] = "grumblewort"
        if k % 7 == 0:
            w = [x + "###" for x in w]
        rows.append((k, " ".join(w), lang, int(k % 7 != 0), int(k % 5 == 0)))
    every = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")
    named = language_id.identify(every).join(every, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in named) >= 0.95 * len(named)
    good = quality_classifier.score(every, every).join(every, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in good) >= 0.95 * len(good)
    bad = toxicity.score(every, every).join(every, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in bad) >= 0.9 * len(bad)


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None)], "item_id long, text string")
    for d in (odd, odd.where("false")):
        n = d.count()
        assert quality_rules.judge(d).count() == n
        assert decontamination.matches(d, bench).count() == 0
        assert quality_classifier.score(d, labels).where("score between 0 and 1").count() == n
        assert toxicity.score(d, labels).where("score between 0 and 1").count() == n
        assert quality_classifier.score(d, labels.where("false")).count() == toxicity.score(d, labels.where("false")).count() == n
        assert token_counts.token_counts(d, PATH).count() == n
        assert pieces.segment(d, PATH).count() == n
        assert minhash.near_duplicates(d).count() == n
        assert language_id.identify(d).count() == n
        assert substring.remove_repeats(d).count() == n
        assert sharding.balanced_shards(d).count() == n
    assert language_id.identify(odd).where("lang_pred = 'und'").count() >= 3


def test_peaks_are_the_highest_separate_stretches():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        doc, s = np.sort(rnd.integers(0, 6, 30)), rnd.integers(-3, 4, 30) / 1.5
        got = toxicity.peaks(s, doc, 7)
        for k in range(7):
            own = s[doc == k].tolist()
            tops = [v for i, v in enumerate(own) if (i == 0 or v >= own[i - 1]) and (i == len(own) - 1 or v > own[i + 1])]
            want = sorted((min(max(v, -1.5), 2.0) for v in tops), reverse=True)[:3]
            assert np.allclose(got[k], want + [-1.5] * (3 - len(want)))
    assert toxicity.peaks(np.zeros(0), np.zeros(0, int), 2).shape == (2, 3)


def test_table_of_the_string_kernel_equals_subsequences_one_by_one():
    text = pa.array(["Ab éc ab", None, "", "x"])
    code, starts, doc = toxicity.stretch_starts(text)
    assert doc.tolist() == [0, 0, 0, 3]
    h = next(toxicity.stem_hashes(code, starts, (2,)))
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    weights = np.random.default_rng(1).random(toxicity.SYMBOLS**3).astype(np.float32)
    weights[0] = 0
    for start in starts.tolist():
        want, code = 0.0, code.astype(int)
        for i in range(start, start + toxicity.LENGTH):
            for k in range(2, toxicity.SPAN):
                for j in range(1, k):
                    if i + k < len(code) and i < len(code) - toxicity.SPAN and code[i] and code[i + j] and code[i + k]:
                        want += weights[(code[i] * toxicity.SYMBOLS + code[i + j]) * toxicity.SYMBOLS + code[i + k]] * toxicity.DECAY ** (k + 1)
        assert abs(toxicity.stretch_scores(code, np.array([start]), weights)[0] - want) < 1e-4


def test_toxicity_sees_all_of_a_text_without_blanks():
    rnd = random.Random(8)
    words = ["the", "house", "river", "walks", "green", "later", "stone", "paper"]
    say = lambda n, sep: sep.join(rnd.choice(words) for _ in range(n))
    texts = [say(10, " ") + (" grumblewort " if k % 3 == 0 else " ") + say(10, " ") for k in range(600)]
    model = toxicity.fit(texts, np.array([int(k % 3 == 0) for k in range(600)]))
    for sep in ["-", "_", "|", "\u00a0", ""]:
        clean = [say(20, sep) for _ in range(20)]
        bad = [t[:at] + sep + "grumblewort" + sep + t[at:] for t in clean for at in (30, 31, 32, 33, 34, 35, 36, 70)]
        got = toxicity.document_scores(pa.array(bad), model), toxicity.document_scores(pa.array(clean), model)
        assert got[0].min() > got[1].max(), sep
    for size in range(1, 60):
        _, starts, _ = toxicity.stretch_starts(pa.array(["x" * size]))
        assert set(range(max(1, size - 1))) <= {p for s in starts.tolist() for p in range(s, s + toxicity.LENGTH)}
    assert toxicity.stretch_starts(pa.array(["ab-cd ef--g-"]))[1].tolist() == [0, 3, 6, 10]


def test_rare_languages_are_learned_in_large_tables(spark):
    rows = [(k, "the house river walks", "x") for k in range(2000)] + [(5000 + k, "der fluss geht heim", "y") for k in range(8)]
    langs, *_ = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5, 0, 60)
    assert langs == ["x", "y"]


def test_every_language_is_learned_however_many_there_are(spark):
    """230 languages, each with syllables of its own: none is left out, and the model is not folded for each of them."""
    rnd = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñåøæœ"
    own = {f"l{k:03}": [rnd.choice(letters) + rnd.choice(letters) + rnd.choice(letters) for _ in range(6)] for k in range(230)}
    rows = [(k, " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(60)), lang) for k, (lang, s) in enumerate(sorted(own.items()) * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, (vectors, weights), *_ = language_id.fit(docs, 5, 0, 400)
    assert langs == sorted(own) and vectors.shape[1] == language_id.WIDTH and weights.shape == (language_id.WIDTH, 230)
    held = language_id.identify(docs, sample=400).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang_pred == r.lang for r in held)
    assert right > 0.3 * len(held), (right, len(held))
