"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary.

1. Words. Runs of letters ``[A-Za-z\\u00C0-\\u00FF]+`` are lowered in A-Z and counted; words of ``min_length`` code points and
   ``min_count`` occurrences or more are the vocabulary. Counts are summed in each task before they are shuffled, so a frequent
   word is one row a task. The vocabulary is written to the shared folder.
2. Filters. The vocabulary's words are dealt by length (64 and more are one) into blocked Bloom filters of 512-bit blocks, at
   ``BITS`` bits a word. A length with more words than one filter may hold is split by a hash. Filters are packed into rounds of
   at most ``filter_mb`` megabytes, whatever the vocabulary: only one round's filters are broadcast at a time, built in tasks
   from 64-bit hashes, and destroyed before the next. A round probes only edits that fall into its filters, so every edit is
   probed once over all rounds.
3. Probes. For each word all its single deletions and all replacements by a larger letter of the alphabet are hashed from prefix
   sums, without building a string; insertions are the other word's deletions, and smaller letters the other word's replacements.
   Only edits that the filter lets through become strings and are shuffled to an exact join with the vocabulary, which removes
   the false ones. A filter has no false negatives, so no link is lost.
4. Forms. A word's form is its near word of largest count (ties: the smallest in code-point order), if that count is ``ratio``
   times the word's or more. Forms are followed to the last by doubling: counts grow by the ratio with each step, so the number of
   rounds follows the logarithm of the largest count, and there are no circles.

No word has more than 180 near words a letter, so no group grows with the input. Null texts have no words; a null doc_id
counts as an empty one in ``drop_letters``. An empty table gives no rows; repeated rows count again; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, STEP, U, forget, mix, powers, table

#: Letters of words, lowered.
ALPHABET = np.concatenate([np.arange(97, 123), np.arange(0xC0, 0x100)]).astype(np.int64)
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
INVERSE = U(pow(int(BASE), -1, 1 << 64))
LONGEST, BITS, BLOCK, PROBES, SEGMENT = 64, 16, 512, 6, 512
POSITIONS, WORDS = 16_384, 20_000


def drop_letters(doc_id: Column, word: Column, one_in: int = 31) -> Column:
    """The fixed rule for measured documents: of one (document, word) in 31, by crc32, one letter is missing."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, alter=None) -> DataFrame:
    """(word, n) of all words of that length and count; ``alter(doc_id, word)`` may change a word first."""
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("word"))
    words = words.select((alter(F.col("doc_id"), F.col("word")) if alter else F.col("word")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Codes:
    """Letters of many words one after the other, with what is needed to hash every edit of them."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lens = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
        self.first = np.cumsum(self.lens) - self.lens
        self.word = np.repeat(np.arange(len(words)), self.lens)
        self.place = np.arange(len(self.codes)) - self.first[self.word]
        self.power = powers(BASE, int(self.lens.max(initial=0)) + 1)[self.place]
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[self.codes] * self.power)])
        self.sums = self.upto[self.first + self.lens] - self.upto[self.first]

    def hashes(self) -> np.ndarray:
        return finished(self.sums, self.lens)

    def replaced(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the letters a to b: hashes with each larger letter in place, the position, the letter."""
        at, k = np.nonzero(ALPHABET[None, :] > self.codes[a:b, None])
        at += a
        w = self.word[at]
        letter = ALPHABET[k]
        return finished(self.sums[w] + (VALUES[letter] - VALUES[self.codes[at]]) * self.power[at], self.lens[w]), at, letter

    def deleted(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the letters a to b: hashes without each, and the position; of equal letters in a row only the last is left out."""
        last = self.first + self.lens - 1
        at = np.arange(a, b)
        at = at[(at == last[self.word[at]]) | (self.codes[at] != self.codes[np.minimum(at + 1, len(self.codes) - 1)])]
        w = self.word[at]
        before, after = self.upto[at] - self.upto[self.first[w]], self.upto[self.first[w] + self.lens[w]] - self.upto[at + 1]
        return finished(before + after * INVERSE, self.lens[w] - 1), at


def finished(sums: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return mix(sums + lens.astype(np.uint64) * STEP)


class Layout:
    """Which filter holds a word: by length, then by hash where a length needs several; which round and where its blocks begin."""

    def __init__(self, counts: dict[int, int], filter_mb: float):
        most = max(SEGMENT, int(filter_mb * 2**20) * 8 // BLOCK)
        self.parts, self.slot = np.ones(LONGEST + 1, np.int64), np.full(LONGEST + 1, -1, np.int64)
        rounds, begins, blocks, used = [], [], [], 0
        for length, n in sorted(counts.items()):
            need = -(-n * BITS // BLOCK)
            self.parts[length], self.slot[length] = -(-need // most), len(rounds)
            each = -(-need // int(self.parts[length]))
            for _ in range(int(self.parts[length])):
                if not rounds or used + each > most:
                    rounds.append((rounds[-1] if rounds else -1) + 1)
                    used = 0
                else:
                    rounds.append(rounds[-1])
                begins.append(used)
                blocks.append(each)
                used += each
        self.round, self.begin, self.blocks = (np.array(x, np.int64) for x in (rounds, begins, blocks))
        self.rounds = int(self.round[-1]) + 1 if rounds else 0

    def size(self, k: int) -> int:
        return int((self.begin + self.blocks)[self.round == k].max())

    def block(self, h: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash belongs to round ``k``, and the block of those that do."""
        length = np.clip(lens, 0, LONGEST)
        slot = self.slot[length]
        slot = np.where(slot >= 0, slot + (h % U(1_000_003)).astype(np.int64) % self.parts[length], -1)
        mine = np.flatnonzero((slot >= 0) & (self.round[slot] == k))
        slot = slot[mine]
        return mine, self.begin[slot] + (((h[mine] >> U(32)) * self.blocks[slot].astype(np.uint64)) >> U(32)).astype(np.int64)


def bits(h: np.ndarray) -> np.ndarray:
    """The places of a word in its block, a row for each of the probes."""
    g = mix(h ^ STEP)
    return np.stack([(g >> U(9 * k)) & U(BLOCK - 1) for k in range(PROBES)]).astype(np.int64)


def build(vocab: DataFrame, layout: Layout, k: int) -> np.ndarray:
    """The filters of one round as 64-bit words: bit arrays of ``SEGMENT`` blocks are made in tasks and put one behind the other."""

    def hashed(batches):
        for b in batches:
            codes = Codes(b.column("word").to_pylist())
            h = codes.hashes()
            mine, block = layout.block(h, codes.lens, k)
            yield pa.RecordBatch.from_arrays([pa.array(block // SEGMENT), pa.array(block % SEGMENT), pa.array(h[mine].view(np.int64))], ["segment", "block", "h"])

    def filled(t: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT * BLOCK // 64, np.uint64)
        block = t.column("block").to_numpy() * BLOCK
        for bit in bits(t.column("h").to_numpy().view(np.uint64)):
            np.bitwise_or.at(out, (block + bit) >> 6, U(1) << ((block + bit) & 63).astype(np.uint64))
        return pa.table({"segment": t.column("segment")[:1], "words": pa.array([out.tobytes()], pa.binary())})

    made = vocab.select("word").mapInArrow(hashed, "segment long, block long, h long").groupBy("segment").applyInArrow(filled, "segment long, words binary").collect()
    out = np.zeros((-(-layout.size(k) // SEGMENT), SEGMENT * BLOCK // 64), np.uint64)
    for r in made:
        out[r.segment] = np.frombuffer(r["words"], np.uint64)
    return out.ravel()


def passed(held: np.ndarray, h: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Indices of the hashes whose bits are all set; each probe looks only at what the one before left."""
    left = np.arange(len(h))
    g = mix(h ^ STEP)
    for k in range(PROBES):
        at = block[left] * BLOCK + ((g[left] >> U(9 * k)) & U(BLOCK - 1)).astype(np.int64)
        left = left[(held[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) == 1]
    return left


def probed(vocab: DataFrame, layout: Layout, k: int, shared) -> DataFrame:
    """(word, n, edit): edits of each word that round ``k``'s filters let through."""

    def run(batches):
        held = np.frombuffer(shared.value, np.uint64)
        for b in batches:
            codes = Codes(b.column("word").to_pylist())
            source, edits = [], []
            for a in range(0, len(codes.codes), POSITIONS):
                to = min(a + POSITIONS, len(codes.codes))
                h, at = codes.deleted(a, to)
                mine, block = layout.block(h, codes.lens[codes.word[at]] - 1, k)
                for p in at[mine[passed(held, h[mine], block)]].tolist():
                    w, i = int(codes.word[p]), int(codes.place[p])
                    source.append(w)
                    edits.append(codes.words[w][:i] + codes.words[w][i + 1 :])
                h, at, letter = codes.replaced(a, to)
                mine, block = layout.block(h, codes.lens[codes.word[at]], k)
                good = mine[passed(held, h[mine], block)]
                for p, c in zip(at[good].tolist(), letter[good].tolist(), strict=True):
                    w, i = int(codes.word[p]), int(codes.place[p])
                    source.append(w)
                    edits.append(f"{codes.words[w][:i]}{chr(c)}{codes.words[w][i + 1 :]}")
            rows = b.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("word"), rows.column("n"), pa.array(edits, pa.string())], ["word", "n", "edit"])

    return vocab.mapInArrow(run, "word string, n long, edit string")


def near_pairs(vocab: DataFrame, filter_mb: float = 32) -> list[DataFrame]:
    """(word, n, near, near_n) of each two words one edit apart, once; one written table for each round of filters."""
    spark = vocab.sparkSession
    counts = vocab.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("length")).count().collect()
    layout, out = Layout({r["length"]: r["count"] for r in counts}, filter_mb), []
    exact = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    dealt = vocab.repartition(max(1, sum(r["count"] for r in counts) // WORDS))  # a word has some 400 probes: small rows, long work
    for k in range(layout.rounds):
        shared = spark.sparkContext.broadcast(build(vocab, layout, k).tobytes())
        out.append(table(spark, probed(dealt, layout, k, shared).join(exact.hint("merge"), F.col("edit") == F.col("near")).select("word", "n", "near", "near_n")))
        shared.destroy()
    return out


def followed(forms: DataFrame, max_n: int, ratio: int) -> DataFrame:
    """(word, root) from (word, form): each round doubles the steps taken."""
    spark, roots = forms.sparkSession, table(forms.sparkSession, forms.select("word", F.col("form").alias("root")))
    steps = math.floor(math.log(max(max_n, 1), ratio)) if ratio > 1 else 0
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("last"))
        further = table(spark, roots.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("last", "root").alias("root")))
        forget(roots)
        roots = further
    return roots


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, alter=None, filter_mb: float = 32) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    spark = docs.sparkSession
    vocab = table(spark, vocabulary(docs, min_length, min_count, alter))
    pairs = near_pairs(vocab, filter_mb)
    both = None
    for p in pairs:
        sides = p.select(F.expr("inline(array(named_struct('word', word, 'n', n, 'best', named_struct('m', -near_n, 'near', near)), named_struct('word', near, 'n', near_n, 'best', named_struct('m', -n, 'near', word))))"))
        both = sides if both is None else both.union(sides)
    if both is None:
        return vocab.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.m") >= ratio * F.col("n")
    stats = table(spark, best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    forget(*pairs)
    roots = followed(stats.where("form is not null"), vocab.agg(F.max("n")).first()[0] or 0, ratio)
    out = vocab.join(stats.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
