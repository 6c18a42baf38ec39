"""The pipeline and its stage functions against brute force on small corpora."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402

from strataloom.llm import decontamination, minhash, pieces, quality_rules, queries, substring  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
#: Words of no natural language, so that the histograms of real ones say nothing about them.
LISTED = quality_rules.COMMON


def corpus(seed=7):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    say = lambda n: [rnd.choice(vocabulary) if rnd.random() < 0.7 else rnd.choice(LISTED) for _ in range(n)]
    texts = [say(rnd.randint(60, 130)) for _ in range(50)]
    items = [" ".join(say(30)) for _ in range(3)]
    passage = say(60)
    for k in (3, 11, 19, 27):
        texts[k][20:20] = passage
    for k in (5, 6):
        texts[k][30:30] = items[k - 5].split()
    near = list(texts[8])
    near[10] = "changed"
    texts += [texts[2], near, say(20), say(4) * 40, ["|||", "###"] * 90, [f"#{j}|" for j in range(120)]]
    rows = [(k, " ".join(t), "ab"[k % 2], "s", len(" ".join(t))) for k, t in enumerate(texts)]
    return rows + [(90, None, "a", None, None), (91, "", None, "s", 0)], items


def distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (p + q) / 2
    return float(np.sqrt(max(0, sum(a * np.log2(a / c) for a, c in zip(p, m, strict=True) if a) / 2 + sum(b * np.log2(b / c) for b, c in zip(q, m, strict=True) if b) / 2)))


def histograms(t):
    kinds = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0d]", r"[#*$%&|<>]", r"[\x00-\x08\x0e-\x1f!\"'()+,\-./:;=?@\[\\\]^_`{}~\x7f]", r"[^\x00-\x7f]"]
    low = [w.lower() for w in WORD.findall(t)]
    return [len(re.findall(k, t)) for k in kinds], [low.count(w) for w in LISTED] + [sum(w not in LISTED for w in low)]


def kept_by_rules(rows):
    base, hist = {}, {}
    for k, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        base[k], hist[k] = len(w) >= 50 and 100 * len(inside) <= 50 * len(w), histograms(t)
    alike = lambda c: [c[0] + c[6], *c[1:6]]
    refs, names = [], set()
    good = [(k, lang) for k, _, lang, *_ in rows if base[k]]
    every = alike(np.sum([hist[k][0] for k, _ in good] or [[0] * 7], 0))
    for lang in {x for _, x in good if x}:
        own = [hist[k] for k, x in good if x == lang]
        sums = [np.sum([h[s] for h in own], 0) for s in (0, 1)]
        if len(own) >= quality_rules.LEAST_DOCS and distance(alike(sums[0]), every) <= quality_rules.MAX_CHAR:
            refs.append(sums)
            names.add(lang)
    out = []
    for r in rows:
        c, w = hist[r[0]]
        near = [min((distance(h, ref[s]) for ref in refs), default=0) for s, h in ((0, c), (1, w))]
        if r[2] and r[2] not in names:
            near = [distance(alike(c), every), 0]
        far = sum(c) >= quality_rules.MIN_CHARS and near[0] > quality_rules.MAX_CHAR or sum(w) >= quality_rules.MIN_WORDS and near[1] > quality_rules.MAX_WORD
        if base[r[0]] and not far:
            out.append(r)
    return out


def one_of_each(rows):
    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, out = {}, []
    for r in sorted(rows):
        own = shingles(r[1])
        if not any(100 * len(own & s) >= 80 * len(own | s) for s in sets.values()):
            out.append(r)
        sets[r[0]] = own
    return out


def without_repeats(rows):
    seen, out = set(), []
    for k, t, *rest in sorted(rows):
        w, gone = WORD.findall(t), set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone.update(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, text, *rest[:2], len(text)))
    return out


def without_items(rows, items):
    fold = lambda t: decontamination.folded(pa.array([t]))[0][:-1].tobytes().strip()
    return [r for r in rows if not any(fold(i) in fold(r[1]) for i in items)]


def test_run_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    after = [kept_by_rules(rows)]
    after.append(one_of_each(after[-1]))
    after.append(without_repeats(after[-1]))
    after.append(without_items(after[-1], items))
    assert [len(a) for a in after] == sorted((len(a) for a in after), reverse=True) and 46 < len(after[0]) < 54 and len(after[0]) > len(after[1]) and len(after[2]) > len(after[3])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], after, strict=True):
        got = stage(spark, docs, str(tmp_path))
        assert got.schema.simpleString() == docs.schema.simpleString()
        docs = spark.createDataFrame(got.collect(), got.schema)
        assert [(r.doc_id, WORD.findall(r.text)) for r in docs.orderBy("doc_id").collect()] == [(r[0], WORD.findall(r[1])) for r in want]
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lat = pieces.lattice(pieces_path())
    assert sorted(r.doc_id for r in got) == [r[0] for r in after[-1]]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert lat.decode(r.ids) == texts[r.doc_id] and r.round_trip and len(r.digests) == len(r.scores) == 4


def pieces_path():
    import public_tokenizers

    return public_tokenizers.path(queries.TOKENIZER)


def test_stages_on_empty_tables_and_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, "a", "a", "s", 1), (1, "b " * 60_000, "a", "s", 1), (None, "c" * 120_000, None, None, None), (2, "the house " * 60, "a", "s", 1)] * 2
    for docs in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_extra_columns_with_odd_names_stay(spark):
    rows, items = corpus()
    names = ["part", "__id", "own_key", "a", "x", "set", "marks", "words", "key"]
    docs = spark.createDataFrame([(r[0], r[1], r[2], *range(len(names))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in names))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for out in (quality_rules.keep(docs), minhash.keep(docs), substring.rewrite(docs), decontamination.clean(docs, bench)):
        assert out.columns == docs.columns and all(tuple(r[3:]) == tuple(range(len(names))) for r in out.collect())


RUSSIAN = "и в не он на я что тот быть с а весь это как она по но они к у ты из мы за вы так же от сказать этот который мочь человек о один ещё бы такой только себя своё какой когда уже для вот кто да говорить год мой знать до или если время рука нет самый ни стать большой даже другой наш свой ну под где дело есть сам раз чтобы два там чем глаз жизнь первый день тут во ничто потом очень со хотеть ли при голова надо без видеть идти теперь тоже стоять друг дом сейчас можно после слово здесь думать место спросить через лицо что тогда ведь хороший каждый новый жить должный смотреть почему потому сторона просто нога сидеть понять иметь конечный делать вдруг над взять никто сделать дверь перед нужный понимать казаться работа три ваш уж земля конец несколько час голос город последний пока хорошо давать вода более хотя всегда второй куда пойти".split()


def judged(spark, english, others):
    rnd = random.Random(5)
    words = [w for w in quality_rules.COMMON if w.isascii()][:40] + ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(300)), "en", "s", 0) for k in range(english)]
    return {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows + others, SCHEMA)).where("doc_id >= 100000").collect()}


def test_few_documents_of_a_language_stay_whatever_else_there_is(spark):
    """Four Russian documents among 1,000 and among 6,000 English ones; and twelve, enough for a reference of their own."""
    rnd = random.Random(6)
    for english, n in ((1000, 4), (6000, 4), (1000, 12)):
        russian = [(100_000 + k, " ".join(rnd.choice(RUSSIAN) for _ in range(300)), "ru", "s", 0) for k in range(n)]
        assert judged(spark, english, russian) == {100_000 + k: True for k in range(n)}


def test_junk_under_a_language_of_its_own_is_no_reference(spark):
    rows, _ = corpus()
    for n in (6, 40):
        junk = [(200_000 + k, " ".join(["||||", "###", f"{k}"] * 80 + [f"w{j}" for j in range(200)]), "zz", "s", 0) for k in range(n)]
        assert judged(spark, 300, junk) == {200_000 + k: False for k in range(n)}
    got = quality_rules.judge(spark.createDataFrame(rows + junk[:6], SCHEMA)).where("doc_id >= 200000").collect()
    assert len(got) == 6 and all(not r.kept for r in got)


def test_without_a_language_column(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    assert quality_rules.keep(docs).columns == ["doc_id", "text"] and quality_rules.judge(docs).where("not kept and not base_failed").count() == 0


def test_quality_rules_against_sql(spark):
    rows, _ = corpus(9)
    rnd = random.Random(7)
    rows += [(5000 + k, " ".join(rnd.choice(RUSSIAN) for _ in range(250)), "ru", "s", 0) for k in range(3)] + [(6000 + k, " ".join(["||||", "###", f"{k}"] * 80 + [f"w{j}" for j in range(200)]), "zz", "s", 0) for k in range(14)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars int)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "char_distance", "word_distance").collect()
    want = con.execute(queries.OP1).fetchall()
    plain = lambda rows: sorted([[round(float(v), 5) for v in r] for r in rows])
    assert plain(got) == plain(want) and [r[0] for r in kept_by_rules(rows)] == sorted(r.doc_id for r in got if r.kept)
