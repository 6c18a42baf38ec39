"""Quality rules by distribution divergence.

Two histograms describe a document: characters by class, and how often each word of a fixed list of common words occurs
(with one bin for all other words). The references are the same histograms summed over the documents of each language
that the corpus names, but only those that pass the base rules. A document is compared with every reference and the
nearest counts, so a wrong or missing language does not matter. The divergence is the Jensen-Shannon distance (base 2,
0 to 1). It is judged only from a minimum length on: below ``min_chars`` characters the class histogram says too little,
below ``min_words`` words the word histogram, and the document keeps the verdict of the base rules. The base rules reject
documents under 50 words and those with more than half of their words in repeated three-word windows.

A language has a reference from ``least_docs`` such documents on, a fixed number, whatever else the corpus holds. Documents of a language
without one are not measured by foreign words or letters: their characters are compared by classes that all alphabets share (letters of
ASCII and others are one) with those of all documents that pass the base rules, and nothing else. The same comparison keeps junk under a
name of its own from being its own measure: a language whose summed characters are farther than ``max_char`` from all documents' has no
reference. A dirty language column may name any number: the ``most_languages`` with the most documents are references, documents of
the others are judged as those of a language without one.

Null text has no words. Documents without a language (null, or no such column) add to no language's reference; with no reference at all nothing diverges
(distance 0). An empty table gives no rows. Rows are kept one for one, with repeated rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, chunks, forget, mix, spans, table

#: Common words of four languages.
COMMON = (
    "the of and to in a is that for it with as be on by this are from or was "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par sur au avec ne "
    "el y los se del las por con para su al lo no más"
).split()
COMMON = sorted(set(COMMON))
#: Character classes: a-z, A-Z, 0-9, blanks, the symbols #*$%&|<>, other ASCII, all else.
SYMBOLS = b"#*$%&|<>"
CLASS = np.full(256, 5, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[0x20, 9, 10, 11, 12, 13]], CLASS[list(SYMBOLS)], CLASS[192:], CLASS[128:192] = 0, 1, 2, 3, 4, 6, 7
CLASSES = 7
MAX_CHAR, MAX_WORD, MIN_CHARS, MIN_WORDS, BASE_WORDS = 0.30, 0.26, 200, 200, 50
LEAST_DOCS, MOST_LANGUAGES = 10, 1000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def by_doc(doc: np.ndarray, n: int, weight=None) -> np.ndarray:
    return np.bincount(doc, weight, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def class_counts(words: Words) -> np.ndarray:
    """Characters of each class (a row for each document). Bytes that continue a character are not counted."""
    sizes = np.diff(words.off)
    codes = np.repeat(np.arange(words.n_docs) * 8, sizes) + CLASS[words.buf]
    return by_doc(codes, 8 * words.n_docs).reshape(-1, 8)[:, :CLASSES]


def repeated_words(words: Words, w: np.ndarray, width: int = 3) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words that its document has twice or more."""
    ok = np.flatnonzero(words.same_doc(width))
    h = mix(spans(w, width)[ok] ^ mix(words.doc[ok].astype(np.uint64) + U(1)))
    order = np.argsort(h)
    s = h[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= s[1:] == s[:-1]
    inside = np.zeros(len(w), bool)
    for k in range(width):
        inside[ok[order[twice]] + k] = True
    return inside


def duplicate_lines(texts: list[str | None]) -> np.ndarray:
    """Lines with a word that are equal to an earlier line."""
    out = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if t and "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
            out[k] = len(lines) - len(set(lines))
    return out


def common_counts(words: Words, w: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Occurrences of each listed word (A-Z lowered beforehand), one row for each document; the last column: all others."""
    order = np.argsort(listed)
    place = np.minimum(np.searchsorted(listed[order], w), len(listed) - 1)
    k = np.where(listed[order][place] == w, order[place], len(listed))
    return by_doc(words.doc * (len(listed) + 1) + k, words.n_docs * (len(listed) + 1)).reshape(words.n_docs, -1)


def listed_hashes() -> np.ndarray:
    return Words(pa.array(COMMON)).hashes()


def measure(text: pa.Array, listed: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The base counts, the class histogram and the common-word histogram of each text."""
    n = len(text)
    words = Words(text)
    w = words.hashes()
    classes = class_counts(words)
    common = common_counts(words, Words(text, lower=True).hashes(), listed)
    base = [words.count, classes.sum(1) - classes[:, 3], classes[:, 4], duplicate_lines(text.to_pylist()), by_doc(words.doc[repeated_words(words, w)], n)]
    return [np.asarray(b, np.int64) for b in base], classes, common


def measured(docs: DataFrame) -> DataFrame:
    """The base counts and both histograms of every document."""

    def run(batches):
        listed = listed_hashes()
        for chunk in chunks(batches):
            base, *both = measure(chunk.column("text"), listed)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(h.ravel()), h.shape[1]).cast(pa.list_(pa.int64())) for h in both]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("lang"), *map(pa.array, base), *lists], ["doc_id", "lang", *COUNTS, "chars", "words"])

    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", chars array<long>, words array<long>"
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select(F.col("doc_id").cast("long"), lang, F.col("text").cast("string")).mapInArrow(run, schema)


def distances(h: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row to one reference; an empty histogram is at distance 0."""
    n = h.sum(1, keepdims=True)
    if not reference.sum():
        return np.zeros(len(h))
    p, q = h / np.maximum(n, 1), (reference / reference.sum())[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(n[:, 0] > 0, np.sqrt(np.maximum(d / 2, 0)), 0)


class Limits(NamedTuple):
    """Thresholds of the rules."""

    max_char: float = MAX_CHAR
    max_word: float = MAX_WORD
    min_chars: int = MIN_CHARS
    min_words: int = MIN_WORDS
    base_words: int = BASE_WORDS
    least_docs: int = LEAST_DOCS
    most_languages: int = MOST_LANGUAGES


class References(NamedTuple):
    """A language's name and both histograms for each language that has a reference; the neutral classes of all good documents."""

    languages: list[tuple[str, np.ndarray, np.ndarray]]
    neutral: np.ndarray


def neutral(chars: np.ndarray) -> np.ndarray:
    """Class histograms with all letters in one class."""
    out = chars[..., :6].copy()
    out[..., 0] += chars[..., 6]
    return out


def references(rows: DataFrame, limits: Limits) -> References:
    """The references of a corpus; see above for the languages that count. Collected are sums for each of ``most_languages`` languages at most."""
    good = rows.where(f"n_words >= {limits.base_words} and 100 * n_repeat_words <= 50 * n_words")
    sums = [F.sum(F.col("chars")[k]).alias(f"c{k}") for k in range(CLASSES)] + [F.sum(F.col("words")[k]).alias(f"w{k}") for k in range(len(COMMON) + 1)]
    each = table(rows.sparkSession, good.groupBy("lang").agg(F.count("*").alias("docs"), *sums))
    total = neutral(np.array([x or 0 for x in each.agg(*[F.sum(f"c{k}") for k in range(CLASSES)]).first()], np.int64))
    near = shared_distance(total, limits.max_char)
    found = each.where((F.col("lang").isNotNull()) & (F.col("docs") >= limits.least_docs) & near).orderBy(F.desc("docs"), "lang").limit(limits.most_languages).collect()
    forget(each)
    found = sorted(found, key=lambda r: r["lang"])
    return References([(r[0], np.array(r[2 : 2 + CLASSES], np.int64), np.array(r[2 + CLASSES :], np.int64)) for r in found], total)


def shared_distance(total: np.ndarray, most: float):
    """Whether a language's summed classes c0 to c6 lie within ``most`` of the corpus's neutral classes: the distance as a column, so that only languages
    that count are collected."""
    c = [F.col(f"c{k}").cast("double") for k in range(CLASSES)]
    own = [c[0] + c[6], *c[1:6]]
    n, q = sum(own[1:], own[0]), total / max(int(total.sum()), 1)
    parts = []
    for x, y in zip(own, q.tolist(), strict=True):
        p = x / n
        m = (p + F.lit(y)) / 2
        parts.append(F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + (F.lit(y) * F.log2(F.lit(y) / m) if y else F.lit(0.0)))
    return (n > 0) & (F.sqrt(F.greatest(sum(parts[1:], parts[0]) / 2, F.lit(0.0))) <= most)


def verdict(base: list[np.ndarray], chars: np.ndarray, words: np.ndarray, langs: list[str | None], refs: References, limits: Limits):
    """Distances to the nearest reference (to the neutral classes, for a language without one), and whether each document diverges, fails the base rules, is kept."""
    near = [np.min([distances(h, r[k]) for r in refs.languages], axis=0) if refs.languages and len(h) else np.zeros(len(h)) for k, h in enumerate((chars, words), 1)]
    names = {r[0] for r in refs.languages}
    alone = np.fromiter((x is not None and x not in names for x in langs), bool, len(langs))
    if alone.any():
        near[0][alone], near[1][alone] = distances(neutral(chars[alone]), refs.neutral), 0
    diverges = (chars.sum(1) >= limits.min_chars) & (near[0] > limits.max_char)
    diverges |= (base[0] >= limits.min_words) & (near[1] > limits.max_word)
    failed = (base[0] < limits.base_words) | (100 * base[4] > 50 * base[0])
    return near, diverges, failed, ~failed & ~diverges


def judge(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, the base counts, char_distance, word_distance, diverges, base_failed, kept for every row of ``docs``."""
    rows, limits = table(docs.sparkSession, measured(docs)), limits or Limits()
    refs = references(rows, limits)

    def run(batches):
        for b in batches:
            hist = [b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("chars", "words")]
            near, *flags = verdict([b.column(c).to_numpy() for c in COUNTS], *hist, b.column("lang").to_pylist(), refs, limits)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *COUNTS)), *(pa.array(np.round(x, 6)) for x in near), *map(pa.array, flags)], ["doc_id", *COUNTS, "char_distance", "word_distance", "diverges", "base_failed", "kept"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", char_distance double, word_distance double, diverges boolean, base_failed boolean, kept boolean")


def keep(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; the texts are read twice and never shuffled."""
    limits = limits or Limits()
    refs = references(measured(docs), limits)

    def run(batches):
        listed = listed_hashes()
        for chunk in chunks(batches):
            base, *both = measure(chunk.column("text").cast(pa.string()), listed)
            langs = chunk.column("lang").cast(pa.string()).to_pylist() if "lang" in chunk.schema.names else [None] * chunk.num_rows
            yield chunk.filter(pa.array(verdict(base, *both, langs, refs, limits)[3]))

    return docs.mapInArrow(run, docs.schema)
