"""Exact removal of repeated passages by seed and extend.

A window is ``length`` (20) consecutive words of one document. Of the 13 runs of 8 words in a window the one with the
smallest hash (leftmost on ties) is its anchor: equal windows have equal anchors at equal places, so the winnowed
anchors, one in seven positions, seed every match.

1. Seeds: each anchor with the hash of its context, the 12 words on either side that its windows can reach (document
   ends count). Within a task, a repeated (anchor, context) is settled at once where an earlier copy was sent on.
2. Join on anchors: the rest is partitioned and sorted by anchor. An occurrence whose whole context occurred earlier is
   settled: all its windows are repeats (the match extends past both ends). The first occurrence of a context whose
   anchor has other contexts too is open: the match ends within reach of the anchor.
3. Extend: for open anchors only, in all steps to the left and to the right that keep ``length`` words (the 13 windows about
   the anchor). Each extension is hashed (128 bits) and meets all occurrences at once, the earliest of which stays; comparing
   pairs of occurrences would grow with the square of a passage's copies.
4. The repeated extensions of a document merge into maximal runs of at least ``length`` words; their words go.

Hot anchors: a passage that many documents share sends one row for each task (a bounded table of repeated contexts, kept
from chunk to chunk), and an anchor with ``MANY`` contexts in one chunk sends two; its other occurrences are open without
being joined, which is always right, as open anchors are compared exactly, and spreads over the hashes of their windows.

Windows are judged on the input, not on what is left. Order is (doc_id, position). Null text has no words. If doc_ids
repeat or are null, rows are first numbered in the order (doc_id with nulls first, checksum, size) and that number
takes the place of doc_id, so that of equal rows the first stays. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, chunks, mix, neutral, spans, table, to_long
from .sharding import PART, ROW_AT, numbered

GRAM = 8
#: Contexts of an anchor in a chunk from which it is hot; entries that a task's tables hold.
MANY, HELD = 8, 1 << 16
STEP2 = U(0xE7037ED1A0B428DB)


def window_anchors(words: Words, length: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the word position of the anchor of each."""
    grams = spans(w, GRAM)
    reach = length - GRAM + 1
    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, at, size = grams, np.arange(len(grams)), 1
    while size < reach:  # doubling, with a last overlapping step
        by = min(size, reach - size)
        left = low[:-by] <= low[by:]
        low, at, size = np.where(left, low[:-by], low[by:]), np.where(left, at[:-by], at[by:]), size + by
    ok = np.flatnonzero(words.same_doc(length))
    return ok, at[:n][ok]


def contexts(words: Words, w: np.ndarray, anchors: np.ndarray, length: int) -> np.ndarray:
    """Hash of the words that the windows of each anchor can reach; places outside the document have a value of their own."""
    side = length - GRAM
    at = anchors[:, None] + np.arange(-side, GRAM + side)
    inside = (at >= 0) & (at < len(w))
    at = np.where(inside, at, 0)
    inside &= words.doc[at] == words.doc[anchors][:, None]
    v = np.where(inside, w[at], U(1))
    return mix((v * mix(np.arange(1, v.shape[1] + 1, dtype=np.uint64))[None, :]).sum(axis=1, dtype=np.uint64))


class Known:
    """What a task has already sent on: repeated (anchor, context) pairs with their smallest place, and hot anchors."""

    def __init__(self):
        self.key, self.ctx, self.doc, self.pos = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.hot = np.zeros(0, np.uint64)

    def judge(self, key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Status of each seed: 0 to be joined, 1 settled, 2 open."""
        n, old = len(key), len(self.key)
        k, c, d, p = (np.concatenate(x) for x in ((self.key, key), (self.ctx, ctx), (self.doc, doc), (self.pos, pos)))
        order = np.lexsort((p, d, c, k))
        same_key = np.r_[False, k[order[1:]] == k[order[:-1]]]
        same = same_key & np.r_[False, c[order[1:]] == c[order[:-1]]]
        status = np.zeros(old + n, np.int8)
        status[order[same]] = 1  # there is an earlier copy, in this chunk or before
        anchor, group = np.cumsum(~same_key) - 1, np.cumsum(~same) - 1
        nth = group - group[np.flatnonzero(~same_key)][anchor] if len(order) else group  # contexts of the anchor before this one
        contexts = np.bincount(anchor, ~same).astype(np.int64)
        first = np.flatnonzero(~same_key)
        was = np.isin(k[order[first]], self.hot)
        spare = (was[anchor] | (contexts[anchor] >= MANY) & (nth >= 2)) & ~same
        status[order[spare]] = 2
        if len(self.hot) < HELD:
            self.hot = np.union1d(self.hot, k[order[first[contexts >= MANY]]])
        sizes = np.bincount(group)
        held = order[~same][sizes > 1][-HELD:]
        self.key, self.ctx, self.doc, self.pos = k[held], c[held], d[held], p[held]
        return status[old:]


def seeds(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        known = Known()
        for chunk in chunks(batches):
            words = Words(chunk.column("text"))
            w = words.hashes()
            anchors = np.unique(window_anchors(words, length, w)[1])
            if not len(anchors):
                continue
            ids = chunk.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            key, ctx = spans(w, GRAM)[anchors], contexts(words, w, anchors, length)
            doc, pos = ids[words.doc[anchors]], (anchors - words.first[words.doc[anchors]]).astype(np.int32)
            status = known.judge(key, ctx, doc, pos)
            key = np.where(status > 0, mix(doc.view(np.uint64)), key)  # judged already: anywhere
            yield pa.RecordBatch.from_arrays([to_long(key), to_long(ctx), pa.array(doc), pa.array(pos), pa.array(status)], ["anchor", "ctx", "doc_id", "pos", "status"])

    return docs.mapInArrow(run, "anchor long, ctx long, doc_id long, pos int, status byte")


def judged(seeded: DataFrame) -> DataFrame:
    """doc_id, pos, settled of all anchors that may lie in a repeat."""

    def run(batches):
        held = None  # the first of a context, not yet known to be open: its anchor, doc_id, pos
        last = None  # anchor and context of the row before
        for b in batches:
            if not b.num_rows:
                continue
            status = b.column("status").to_numpy()
            known = status > 0
            ids, pos = b.column("doc_id").to_numpy(), b.column("pos").to_numpy()
            anchor, ctx = b.column("anchor").to_numpy(), b.column("ctx").to_numpy()
            out = [(ids[known], pos[known], status[known] == 1)]
            ids, pos, anchor, ctx = ids[~known], pos[~known], anchor[~known], ctx[~known]
            if len(anchor):
                same = np.r_[last is not None and last[0] == anchor[0], anchor[1:] == anchor[:-1]]
                copy = same & np.r_[last is not None and last[1] == ctx[0], ctx[1:] == ctx[:-1]]
                out.append((ids[copy], pos[copy], np.ones(copy.sum(), bool)))
                first = np.flatnonzero(~copy)
                if held is not None and len(first) and same[first[0]]:
                    out.append((np.array([held[1]]), np.array([held[2]], np.int32), np.zeros(1, bool)))
                    held = None
                if len(first):
                    more = np.r_[anchor[first[1:]] == anchor[first[:-1]], False]
                    opened = first[same[first] | more]
                    out.append((ids[opened], pos[opened], np.zeros(len(opened), bool)))
                    end = first[-1]
                    held = None if same[end] else (anchor[end], ids[end], pos[end])
                last = (anchor[-1], ctx[-1])
            i, p, s = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(p.astype(np.int32)), pa.array(s)], ["doc_id", "pos", "settled"])

    return seeded.repartition("anchor").sortWithinPartitions("anchor", "ctx", "doc_id", "pos").mapInArrow(run, "doc_id long, pos int, settled boolean")


def open_windows(docs: DataFrame, length: int) -> DataFrame:
    """The windows of open anchors, as 128-bit hashes. ``docs`` has a list of word positions, ``marks``."""

    def run(batches):
        for chunk in chunks(batches):
            words = Words(chunk.column("text"))
            w = words.hashes()
            starts, at = window_anchors(words, length, w)
            marked = np.zeros(len(w) + 1, bool)
            marks = chunk.column("marks")
            many = np.diff(marks.offsets.to_numpy())
            marked[np.repeat(words.first, many) + marks.flatten().to_numpy()] = True
            starts = starts[marked[at]]
            if not len(starts):
                continue
            ids = chunk.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            doc = words.doc[starts]
            yield pa.RecordBatch.from_arrays([to_long(spans(w, length)[starts]), to_long(spans(w, length, STEP2)[starts]), pa.array(ids[doc]), pa.array((starts - words.first[doc]).astype(np.int32))], ["a", "b", "doc_id", "start"])

    return docs.mapInArrow(run, "a long, b long, doc_id long, start int")


def coverage(chunk: pa.RecordBatch, length: int) -> tuple[Words, np.ndarray]:
    """Words, and whether each lies in a repeated window. ``__marks`` has 2 * position for a settled anchor and
    2 * position + 1 for the start of a repeated window."""
    words = Words(chunk.column("text"))
    w = words.hashes()
    n = len(w)
    marks = chunk.column("__marks")
    flat = marks.flatten().to_numpy()
    places = np.repeat(words.first, np.diff(marks.offsets.to_numpy())) + (flat >> 1)
    settled, begun = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    settled[places[flat & 1 == 0]] = True
    begun[places[flat & 1 == 1]] = True
    starts, at = window_anchors(words, length, w)
    starts = starts[settled[at] | begun[starts]]
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    if len(starts):
        edge -= np.bincount(starts + length, minlength=n + 1)
    return words, np.cumsum(edge)[:n] > 0


def digests(words: Words, keep: np.ndarray) -> list[str]:
    """sha256 of the kept words of each document, joined by one space."""
    lens, doc = words.lens[keep], words.doc[keep]
    solid = words.buf[words.solid][np.repeat(keep, words.lens)]
    ends = np.cumsum(lens + 1)
    line = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    line[np.arange(len(solid)) + np.repeat(np.arange(len(lens)), lens)] = solid
    n = np.bincount(doc, minlength=words.n_docs) if len(doc) else np.zeros(words.n_docs, np.int64)
    upto = np.r_[0, ends][np.r_[0, np.cumsum(n)]]
    return [hashlib.sha256(line[s : max(s, e - 1)]).hexdigest() for s, e in zip(upto, upto[1:], strict=False)]


def cut(text: pa.Array, words: Words, gone: np.ndarray) -> pa.Array:
    """The texts without the removed words and the blanks that follow each; untouched texts stay as they are."""
    size = len(words.buf)
    if not gone.any():
        return text.cast(pa.string())
    ends = np.where(np.r_[words.doc[1:] == words.doc[:-1], False], np.r_[words.starts[1:], size], words.off[words.doc + 1])
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, words.starts[gone], 1)
    np.add.at(edge, ends[gone], -1)
    keep = np.cumsum(edge)[:size] == 0
    at = np.r_[0, np.cumsum(keep)][words.off]
    left = pa.LargeStringArray.from_buffers(words.n_docs, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(words.buf[keep].tobytes()))
    return pc.if_else(text.is_null(), pa.scalar(None, pa.string()), left.cast(pa.string()))


def marked(docs: DataFrame, length: int) -> DataFrame:
    """``docs``, all columns, with the list ``__marks`` of what is repeated in each row."""
    spark = docs.sparkSession
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    if not rows.groupBy("__id").count().where("count > 1 or __id is null").isEmpty():
        raw = F.coalesce("text", F.lit("")).cast("binary")
        held, parts = numbered(rows.withColumns({"__crc": F.crc32(raw), "__size": F.octet_length(raw)}), ["__id", "__crc", "__size"], "__size")
        before, n = [], 0
        for part, count, _ in parts:
            before.append((part, n))
            n += count
        starts = spark.createDataFrame(before, f"{PART} int, __before long")  # one row for each partition
        held = held.join(F.broadcast(starts), PART)
        rows = table(spark, held.withColumn("__id", F.col("__before") + F.col(ROW_AT)).select(*docs.columns, "__id"))
    plain = rows.select(F.col("__id").alias("doc_id"), "text")
    found = table(spark, judged(seeds(plain, length)))
    opened = found.where("not settled").groupBy("doc_id").agg(F.collect_list("pos").alias("marks"))
    windows = table(spark, open_windows(plain.join(opened.hint("merge"), "doc_id"), length))
    firsts = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = windows.join(firsts.hint("merge"), ["a", "b"]).where("struct(doc_id, start) <> first").select("doc_id", (F.col("start").cast("long") * 2 + 1).alias("mark"))
    marks = found.where("settled").select("doc_id", (F.col("pos").cast("long") * 2).alias("mark")).union(repeats)
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("mark").alias("__marks"))  # bounded by the document
    return rows.join(marks.hint("merge"), "__id", "left").withColumn("__marks", F.coalesce("__marks", F.array().cast("array<long>"))).select(*docs.columns, "__marks")


def remove_repeats(docs: DataFrame, length: int = 20, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on request, clean_text, for every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for chunk in chunks(batches):
            words, gone = coverage(chunk, length)
            removed = np.bincount(words.doc[gone], minlength=chunk.num_rows) if len(gone) else np.zeros(chunk.num_rows)
            columns = [chunk.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests(words, ~gone))]
            if texts:
                columns.append(cut(chunk.column("text"), words, gone))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "clean_text"][: len(columns)])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return marked(narrow, length).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", clean_text string" * texts)


def rewrite(docs: DataFrame, length: int = 20) -> DataFrame:
    """``docs``, all rows and columns, with repeated passages cut out of text."""
    own = neutral(docs).withColumn("text", F.col("text").cast("string"))
    names = own.columns

    def run(batches):
        for chunk in chunks(batches):
            words, gone = coverage(chunk, length)
            chunk = chunk.set_column(chunk.schema.get_field_index("text"), "text", cut(chunk.column("text"), words, gone))
            yield chunk.select(names)

    return marked(own, length).mapInArrow(run, own.schema).toDF(*docs.columns)
