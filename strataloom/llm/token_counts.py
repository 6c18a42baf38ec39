"""Token counts of a SentencePiece BPE model by a two-tier map-side lookup of pre-token lengths.

A pre-token is a run of blanks (U+0020) with what follows up to the next blank. No piece of the model goes from a
non-blank to a blank (checked when the model is read), so the count of a text is the sum over its pre-tokens. Tier one
is a table of the most frequent pre-tokens of a random sample of about ``sample`` rows (``frequent`` entries, so the
broadcast is bounded); tier two is a cache in each Python worker, emptied at ``cache`` entries. Only what misses both is encoded. Pre-tokens are
never shuffled. The sample decides speed only: the counts are those of the library for every text.

Null text counts as empty: 0 bytes, 0 tokens. A text that holds U+2581 itself, which the library takes for a blank, is
encoded whole. Rows are kept one for one, with repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

MARK = "▁"


@lru_cache(1)
def model(path: str):
    import sentencepiece

    out = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in p.lstrip(MARK) for p in map(out.id_to_piece, range(out.get_piece_size()))):
        raise ValueError("a piece of this model spans two words: pre-token counts would not add up")
    return out


def pre_tokens(text: str) -> list[str]:
    """Split at single blanks, without the first blank of each; runs of blanks stay with the word that follows."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, blanks = [], 0
    for k, p in enumerate(parts):
        if p:
            out.append(" " * blanks + p)
            blanks = 0
        elif k == len(parts) - 1:
            out.append(" " * blanks)
        else:
            blanks += 1
    return out


class Counts:
    """Lengths of pre-tokens, kept in a worker from batch to batch."""

    held: dict[str, Counts] = {}

    def __init__(self, path: str, frequent: dict[str, int], limit: int):
        self.path, self.frequent, self.limit, self.seen = path, frequent, limit, {}

    def of(self, words: list[str]) -> int:
        found = list(map(self.frequent.get, words))
        if None not in found:
            return sum(found)
        rest = [w for w, n in zip(words, found, strict=True) if n is None]
        total = sum(filter(None, found))
        new = [w for w in set(rest) if w not in self.seen]
        if new:
            if len(self.seen) + len(new) > self.limit:
                self.seen = {}
                new = list(set(rest))
            lengths = lengths_of(self.path, new)
            self.seen.update(zip(new, lengths, strict=True))
        return total + sum(map(self.seen.__getitem__, rest))


def lengths_of(path: str, words: list[str]) -> list[int]:
    """A pre-token as the library sees it: with the blank that it puts in front. Only blanks: one more than it has."""
    ids = model(path).encode(words, num_threads=1)
    return [len(i) if w else 1 for w, i in zip(words, ids, strict=True)]


def frequent_lengths(docs: DataFrame, path: str, sample: int, frequent: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens in about ``sample`` texts (whole texts, a fixed random share of the rows, counted
    where they lie)."""
    n = docs.count()
    texts = docs.sample(False, min(1.0, sample / max(n, 1)), seed=5).select(F.col("text").cast("string")).where("text is not null")

    def run(batches):
        n = Counter()
        for chunk in chunks(batches):
            for t in chunk.column("text").to_pylist():
                n.update(pre_tokens(t))
            n = Counter(dict(n.most_common(frequent)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    top = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(frequent)
    words = [r[0] for r in top.collect()]
    return dict(zip(words, lengths_of(path, words), strict=True)) if words else {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, sample: int = 1000, frequent: int = 20_000, cache: int = 600_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    query = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample, frequent))

    def run(batches):
        if query not in Counts.held:
            Counts.held.clear()  # those of earlier queries
            Counts.held[query] = Counts(path, shared.value, cache)
        counts = Counts.held[query]
        for chunk in chunks(batches):
            out = []
            for t in chunk.column("text").to_pylist():
                out.append(0 if not t else len(model(path).encode(t)) if MARK in t else counts.of(pre_tokens(t)))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("n_bytes"), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
