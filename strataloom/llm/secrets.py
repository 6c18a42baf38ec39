"""Secret scans: patterns of well-known secrets, and random strings told from ordinary identifiers by two character Markov models.

Base spans are the leftmost non-overlapping matches of three patterns (a key word with a value of 8 characters or more, access keys,
long hexadecimal runs). Beyond them every stretch ``[A-Za-z0-9+/_-]{16,}={0,2}`` with a letter that lies outside the base spans is judged: its
log-likelihood under a first-order Markov chain of random strings less that under one of ordinary identifiers must reach ``THRESHOLD``
(natural logarithm; ln of the odds of a secret against an identifier beforehand, about one in 160,000). Letters are folded to lower case in both chains, so words in
capitals are no news, and transitions from or to a sign that is neither letter nor digit say nothing. The chains smooth every transition by ``SMOOTHING``, so that without any training the ratio is 0 and nothing is added.

Labelled samples: identifiers (label 0) are the stretches of 8 characters or more outside the base spans that two or more texts have
(a secret that the patterns miss seldom recurs), each once; random strings
(label 1) are the distinct values of base spans, and hexadecimal and base64 strings made from SHA-256 sums of the ids, random by construction, so a corpus
without secrets has them too. They come from a random choice of about ``sample_docs`` rows by a hash of the id, the first ``sample_chars`` characters
of each: a bounded sample, for the fit only. The search reads every text whole.

All steps are DataFrame functions on the JVM: matches by ``regexp_extract_all``, the texts between them by ``split``, places as
running sums over their lengths in blocks (time linear in the number of matches), ratios as sums of looked-up table entries.
There is no join, and only letter-pair counts of the sample are shuffled and collected (80 x 80 entries).

Null text has no spans (empty digest); an empty table gives no rows; rows are kept one for one, with repeated rows; a null doc_id
stays null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share

#: Patterns of base spans, with letters of key words in either case.
KEYWORDS = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + ")"
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""{KEYWORDS}["']?\x20*[:=]\x20*["']?({VALUE}+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
STRETCH = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}"
THRESHOLD, SMOOTHING, LEAST = 12.0, 0.5, 16
#: ASCII codes from "+" to "z".
LOW, SPAN = 43, 80
BLOCK = 128
SAMPLE_DOCS, SAMPLE_CHARS = 5_000, 20_000


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def found(df: DataFrame, text: str, kind: str, pattern: str) -> DataFrame:
    """``df`` with columns ``kind`` (the matches), ``kind``_between (the texts around them, null if there is none) and ``kind``_ends
    (where each match ends). The running sum goes over blocks, then inside a block."""
    df = df.withColumn(kind, matches(F.col(text), pattern))
    df = df.withColumn(f"{kind}_between", F.when(F.size(kind) > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn("_sizes", F.zip_with(kind, F.slice(f"{kind}_between", F.lit(1), F.size(kind)), lambda m, b: F.length(m).cast("long") + F.length(b)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    df = df.withColumn("_sums", F.when(F.size(kind) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(kind) - 1) / BLOCK).cast("int")), lambda k: total(F.slice("_sizes", k * BLOCK + 1, F.lit(BLOCK))))))
    df = df.withColumn("_starts", F.transform("_sums", lambda _, k: total(F.slice("_sums", F.lit(1), k))))
    ends = F.transform("_sizes", lambda _, i: F.element_at("_starts", F.floor(i / BLOCK).cast("int") + 1) + total(F.slice("_sizes", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))
    return df.withColumn(f"{kind}_ends", F.coalesce(ends, F.array().cast("array<bigint>"))).drop("_sizes", "_sums", "_starts")


def spans(kind: str) -> Column:
    """Structs (start, rank, kind, end, value) of the matches of ``kind``."""
    rank = KINDS.index(kind)
    return F.zip_with(kind, f"{kind}_ends", lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")))


def without(df: DataFrame, text: str, kind: str, hidden) -> DataFrame:
    """``df`` with the matches of ``kind`` for which ``hidden`` holds blanked out in ``text``, at equal length."""
    blank = F.transform(kind, lambda m: F.when(hidden(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    pieces = F.flatten(F.zip_with(f"{kind}_between", blank, lambda b, m: F.array(b, F.coalesce(m, F.lit("")))))
    return df.withColumn(text, F.when(F.size(kind) > 0, F.array_join(pieces, "")).otherwise(F.col(text)))


def long_value(match: Column) -> Column:
    """Whether the value of an assignment has 8 characters or more."""
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8


def base(docs: DataFrame) -> DataFrame:
    """Adds ``base``, the base spans by start, then kind, and ``rest``, the text with them blanked out. Needs doc_id and text."""
    df = docs.withColumn("rest", F.col("text"))
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX), strict=False):
        df = found(df, "text", kind, pattern)
    each = [F.filter(spans("assign"), lambda s: long_value(s["value"])), spans("access"), spans("hex")]
    df = df.withColumn("base", F.array_sort(F.concat(*each)))
    rest = without(df.drop("rest").withColumn("rest", F.col("text")), "rest", "assign", long_value).drop("assign_ends", "access", "access_between", "access_ends", "hex", "hex_between", "hex_ends", "assign", "assign_between")
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):  # what the spans before have left of these
        rest = rest.withColumn(kind, matches(F.col("rest"), pattern))
        rest = rest.withColumn(f"{kind}_between", F.when(F.size(kind) > 0, F.split(F.col("rest"), pattern, -1)))
        rest = without(rest, "rest", kind, lambda m: F.lit(True)).drop(kind, f"{kind}_between")
    return rest


def codes(text: Column) -> Column:
    """Numbers 0 to 79 of the characters of a stretch, letters folded."""
    return F.transform(F.split(F.lower(text), ""), lambda c: F.ascii(c) - LOW)


def pairs(text: Column) -> Column:
    """The transitions of a stretch, as numbers below 6,400."""
    return F.zip_with(codes(text), F.slice(codes(text), F.lit(2), F.greatest(F.length(text), F.lit(1))), lambda a, b: a * SPAN + b)


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(value, label): distinct ordinary identifiers (0) and random strings (1) of a bounded choice of rows; see above."""
    some = docs.where(share("doc_id", sample_docs, docs.count())).select("doc_id", F.substring("text", 1, sample_chars).alias("text"))
    held = base(some)
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    made = F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""))
    value = F.transform("base", lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
    ones = held.select(F.explode(F.concat(made, value)).alias("value"), F.lit(1).alias("label"))
    plain = F.filter(matches(F.col("rest"), STRETCH % 8), lambda s: s.rlike("[A-Za-z]"))
    zeros = held.select(F.explode(F.array_distinct(plain)).alias("value")).groupBy("value").count().where("count > 1").select("value", F.lit(0).alias("label"))
    return ones.distinct().union(zeros)


def train(labelled: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """The table of log-likelihood ratios of all transitions, from rows (value, label)."""
    seen = labelled.select("label", F.explode(pairs(F.substring("value", 1, 256))).alias("pair")).where("pair is not null").groupBy("label", "pair").count()
    count, row = {0: {}, 1: {}}, {0: {}, 1: {}}
    for r in seen.collect():
        count[r.label][r.pair] = r["count"]
        row[r.label][r.pair // SPAN] = row[r.label].get(r.pair // SPAN, 0) + r["count"]
    kinds = 26 + 10 + 5  # letters, digits and + / _ - =
    log_p = lambda k, pair: math.log((count[k].get(pair, 0) + smoothing) / (row[k].get(pair // SPAN, 0) + kinds * smoothing))
    tells = [chr(k + LOW).isalnum() for k in range(SPAN)]
    return [round(log_p(1, p) - log_p(0, p), 4) if tells[p // SPAN] and tells[p % SPAN] else 0.0 for p in range(SPAN * SPAN)]


def ratio(text: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a stretch: the sum of its transitions' entries."""
    held = F.split(F.lit(" ".join(map(str, model))), " ").cast("array<double>")
    return F.aggregate(pairs(text), F.lit(0.0), lambda x, p: x + F.when(p.isNull(), 0.0).otherwise(F.get(held, p)))


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """doc_id and ``found``, all spans (start, rank, kind, end, value, ratio) by start, then kind, of every row. Without a model one is trained on ``docs``."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = train(samples(docs)) if model is None else model
    df = found(base(docs).drop("text"), "rest", "markov", STRETCH % least)
    scored = F.transform(spans("markov"), lambda s: s.withField("ratio", F.when(s["value"].rlike("[A-Za-z]"), ratio(s["value"], model))))
    more = F.filter(scored, lambda s: s["ratio"] >= threshold)
    known = F.transform("base", lambda s: s.withField("ratio", F.lit(None).cast("double")))
    return df.select("doc_id", F.array_sort(F.concat(known, more)).alias("found"))


def digests(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, from ``scan``."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = [F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *n[:3], F.sha2(text(F.filter("found", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), n[3])
