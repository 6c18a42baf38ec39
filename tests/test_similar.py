"""Possible-same-as candidates against all pairs."""

import itertools
import random
import re

from strataloom.operators import similar

SCHEMA = "item long, kind string, name string, description string"


def words(text):
    low = text.lower()
    return set(re.findall(r"[^\W_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+", low)) | set(re.findall(r"(?=([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]{1,2}))", low))


def brute(rows, threshold):
    sets = {r[0]: (r[1], frozenset(words(" ".join(x for x in r[2:] if x)))) for r in rows if r[0] is not None and r[1] is not None}
    sets = {k: v for k, v in sets.items() if v[1]}
    head = {v: min(k for k in sets if sets[k] == v) for v in sets.values()}
    out = {(head[v], k): 1.0 for k, v in sets.items() if head[v] != k}
    for a, b in itertools.combinations(sorted(head.values()), 2):
        x, y = sets[a], sets[b]
        score = len(x[1] & y[1]) / len(x[1] | y[1])
        if x[0] == y[0] and score >= threshold - 1e-9:
            out[a, b] = round(score, 6)
    return out


def items():
    rnd = random.Random(8)
    vocabulary = [f"w{min(int(rnd.expovariate(0.02)), 400)}" for _ in range(600)] + ["数据", "产品", "交易所", "カード"]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))] for _ in range(25)]
    rows = []
    for k in range(160):
        text = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        rows.append((k, rnd.choice("pq"), rnd.choice([None, "", text[0], "Same  Name"]), " ".join(text)))
    rows += [(900, "p", "", ""), (901, "p", None, None), (902, None, "w1 w2", "w3"), (903, "p", "!!", " - "), (904, "p", "A b", "c"), (905, "p", "b A", "C c"), (906, "p", "一", "一"), (907, "p", "一", "")]
    return rows


def test_candidates_are_those_of_all_pairs(spark):
    rows = items()
    df = spark.createDataFrame([*rows, rows[0], (None, "p", "w1", "w2")], SCHEMA)
    for threshold, ranked in ((0.8, 20_000), (0.5, 3)):
        got = similar.possible_same_as(df, threshold, ranked=ranked).collect()
        assert len(got) == len({(r.item, r.other) for r in got})
        assert {(r.item, r.other): r.score for r in got} == brute(rows, threshold)
    reasons = {(r.item, r.other): r.reason for r in got}
    assert reasons[904, 905] == "equal tokens" and {"equal names", "similar tokens"} <= set(reasons.values())


def test_common_tokens_bring_no_pairs_together(spark):
    """Every item has the same thirty common tokens; only their rare ones are joined on."""
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(k, "p", f"n{k}", f"{common} " + " ".join(f"r{k}x{j}" for j in range(20))) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = df.selectExpr("item", "kind").join(df.select("item", similar.F.array_sort(similar.F.transform(similar.tokens(df.description), lambda w: similar.F.xxhash64(w))).alias("set")), "item")
    ordered = similar.in_order(sets, similar.most_frequent(sets, 1000))
    first = ordered.select(similar.F.explode(similar.F.slice("set", 1, 11)).alias("token")).groupBy("token").count()
    assert first.where("count > 1").count() == 0 and similar.possible_same_as(df).count() == 0


def test_known_links_are_left_out_and_empty_tables_give_nothing(spark):
    df = spark.createDataFrame([(1, "p", "a b c", ""), (2, "p", "c b a", ""), (3, "p", "a c b", None)], SCHEMA)
    linked = spark.createDataFrame([(1, 7), (3, 7)], "item long, entity long")
    assert [(r.item, r.other) for r in similar.possible_same_as(df, linked=linked).collect()] == [(1, 2)]
    assert similar.possible_same_as(df.limit(0)).count() == 0


def test_bitmaps_bound_differences_and_turn_long_strangers_away(spark):
    """Two bitmaps differ in no more bits than their sets in tokens, also where one is twice as long; of long sets with half their tokens in common no pair is left."""
    rnd = random.Random(3)
    every = [rnd.getrandbits(64) - 2**63 for _ in range(6000)]
    sets = []
    for n in (1, 40, 102, 103, 120, 800, 820, 1000, 3000):
        base = rnd.sample(every, n)
        sets += [base, base[: max(1, n * 9 // 10)], rnd.sample(every, n), base[: n // 2] + rnd.sample(every, n - n // 2)]
    df = spark.createDataFrame([(k, "p", sorted(set(s))) for k, s in enumerate(sets)], "item long, kind string, set array<long>")
    ordered = similar.in_order(df, similar.most_frequent(df, 100))
    a, b = ordered.alias("a"), ordered.alias("b")
    pairs = a.join(b, similar.F.expr("a.item < b.item and greatest(size(a.bits), size(b.bits)) <= 2 * least(size(a.bits), size(b.bits))"))
    got = pairs.select(similar.F.col("a.item").alias("x"), similar.F.col("b.item").alias("y"), similar.differing("a.bits", "b.bits").alias("d"), similar.F.expr("size(a.bits) <> size(b.bits)").alias("folded")).collect()
    assert all(r.d <= len(set(sets[r.x]) ^ set(sets[r.y])) for r in got) and any(r.folded for r in got)
    strangers = [r for r in got if len(sets[r.x]) >= 800 and len(set(sets[r.x]) ^ set(sets[r.y])) >= 0.9 * len(sets[r.x])]
    assert strangers and all(r.d > (len(sets[r.x]) + len(sets[r.y])) / 9 for r in strangers)


def test_rows_of_the_join_carry_no_prefixes(spark):
    """Each of a long text's prefix tokens carried all of them, which grew with the square of its length."""
    df = spark.createDataFrame([(k, "p", list(range(k, k + 50))) for k in range(4)], "item long, kind string, set array<long>")
    pairs = similar.close_pairs(similar.in_order(df, similar.most_frequent(df, 10)), 0.8)
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("prefix" in line for line in joins)
    assert {(r.item, r.other) for r in pairs.collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}


def small_sets():
    rnd = random.Random(11)
    rows = []
    for n in range(1, 25):
        for _ in range(5):
            base = rnd.sample(range(40), n)
            rows += [base, base[1:] + rnd.sample(range(40), 1), base + rnd.sample(range(40), 1 + n // 6), base[: n - n // 6]]
    return [sorted(x) for x in sorted({frozenset(x) for x in rows if x}, key=sorted)]


def test_steps_find_all_pairs_of_small_sets_at_any_threshold(spark):
    """Sets of few and common tokens, where each step may be the last one that two sets share."""
    sets = small_sets()
    df = spark.createDataFrame([(k, "p", s) for k, s in enumerate(sets)], "item long, kind string, set array<long>")
    for threshold, ranked in ((0.5, 5), (0.51, 40), (0.6, 5), (0.8, 40), (0.8, 0), (0.95, 40)):
        got = similar.close_pairs(similar.in_order(df, similar.most_frequent(df, ranked)), threshold).collect()
        every = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a, b in itertools.combinations(range(len(sets)), 2)}
        assert len(got) == len({(r.item, r.other) for r in got}) and {(r.item, r.other): r.score for r in got} == {p: s for p, s in every.items() if s >= threshold - 1e-9}


def test_strangers_that_share_single_tokens_do_not_meet(spark):
    """Each set has 40 of 800 tokens: of their rarest, any two sets in three shared one, and pairs that met grew with the square of the sets."""
    rnd = random.Random(5)
    df = spark.createDataFrame([(k, "p", sorted(rnd.sample(range(800), 40))) for k in range(500)], "item long, kind string, set array<long>")
    ordered = similar.in_order(df, similar.most_frequent(df, 1000))
    pairs = similar.F.expr("coalesce(sum(c * (c - 1) div 2), 0) as pairs")
    single = ordered.select(similar.F.explode(similar.F.slice("set", 1, 9)).alias("key")).groupBy("key").agg(similar.F.count("*").alias("c")).select(pairs).first()
    rows, k = similar.steps(ordered, 0.8)
    met = rows.groupBy("key").agg(similar.F.count("*").alias("c")).select(pairs).first()
    assert k == 2 and single.pairs > 10_000 and met.pairs < single.pairs / 10


def test_near_copies_are_compared_by_their_differences(spark):
    """Sets that drift, so that two of a pair have different smallest partners, and pairs of two kinds."""
    df = spark.createDataFrame([(k, "pq"[k % 9 == 8], list(range(k, k + 30))) for k in range(40)], "item long, kind string, set array<long>")
    found = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, min(a + 5, 40))], "item long, other long")
    got = similar.verified(found, df).collect()
    one = [(a, b) for a, b in itertools.combinations(range(40), 2) if b < a + 5 and (a % 9 == 8) == (b % 9 == 8)]
    assert sorted((r.item, r.other, r.kind, r.n, r.m, r.common) for r in got) == [(a, b, "pq"[a % 9 == 8], 30, 30, 30 - b + a) for a, b in one]
