"""Benchmark decontamination by the q-gram lemma.

Texts are folded to lower case with one blank for each run of ASCII that is no letter or digit; the unit is the UTF-8
byte. If a passage holds a benchmark item of m units with at most e edits, the two share at least m - q + 1 - q * e
q-grams, all within e neighbouring diagonals (place in the text minus place in the item). Each shared q-gram is counted
in two overlapping bands of 2 (e + 1) diagonals, so that any e + 1 neighbours lie in one; bands that reach the bound are
verified by banded alignment (semi-global edit distance). The budget e is ``rate`` times m, lowered for short items
so that the bound stays positive; items shorter than q are matched exactly, as whole words: between letters of scripts
that write words apart there must be a border, beside Han, Kana, Thai, Lao, Khmer or Burmese letters none is needed.

A place of the text counts once in each band of an item, however often the item has its q-gram nearby: that loses no
match, as the q-grams of an alignment lie at different places of the text. Places of an item with the same q-gram and no
more than e + 1 between neighbours are held as one run, and a run meets a place of the text in every band from its first
to its last; so a place meets an item in about 1 / rate bands at most, repetitive or not. Places are counted ``SLICE``
pairs at a time, and the counts of bands that lie behind are settled before the next slice: memory follows the chunk of
text, not the number of pairs.

The benchmark is the query set: it is read in blocks whose sizes are checked (none over twice ``block_bytes``, unless one
item is), each broadcast with its q-gram table; documents are only mapped, never shuffled. Null or empty texts contain
nothing and null or empty items (also those without a letter or digit) are found nowhere; so an empty benchmark finds
nothing and an empty table of documents gives no rows. Rows of documents are kept one for one, a doc_id that repeats gives
a row for each; items that are equal in id and text count once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks, mix, powers, table, text_bytes

Q, RATE, BLOCK_BYTES = 10, 0.08, 4 << 20
STEP = U(0xD1342543DE82EF95)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [b if chr(b).isalnum() else 32 for b in range(128)]
FOLD[65:91] += 32
BITS = 22
#: Pairs of a place in a text and a band of an item that are counted at a time; cells of bands aligned at a time.
SLICE, CELLS = 1 << 19, 1 << 16


def folded(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts with a zero after each, where each text begins, and the first byte's place in its text."""
    raw, off = text_bytes(text)
    buf = FOLD[raw]
    if len(raw):
        latin = np.r_[False, (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)]
        buf = np.where(latin, buf + np.uint8(32), buf)  # capitals of Latin-1
    before = np.r_[np.uint8(32), buf[:-1]] if len(buf) else buf
    firsts = off[:-1][np.diff(off) > 0]
    before[firsts] = 32
    keep = ~((buf == 32) & (before == 32))
    at = np.r_[0, np.cumsum(keep)][off]
    place = np.flatnonzero(keep)
    n = len(off) - 1
    out = np.zeros(len(place) + n, np.uint8)
    origin = np.zeros(len(place) + n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(place)) + doc] = buf[keep]
    origin[np.arange(len(place)) + doc] = place - off[doc]
    return out, at + np.arange(n + 1), origin


def grams(buf: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes from each place, by doubling."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    times, block, out, have, size = powers(STEP, q + 1), buf.astype(np.uint64) + U(1), None, 0, 1
    while size <= q:
        if q & size:
            part = block[have : have + n] * times[have]
            out, have = part if out is None else out + part, have + size
        if size * 2 <= q:
            block = block[: len(block) - size] + block[size:] * times[size]
        size *= 2
    return mix(out)


class Items:
    """A block of benchmark items with the table of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float):
        buf, at, _ = folded(pa.array([t for _, t in rows], pa.string()))
        parts = [bytes(buf[s : e - 1]).strip(b" ") for s, e in zip(at, at[1:], strict=False)]
        keep = [k for k, p in enumerate(parts) if p]
        self.id = [rows[k][0] for k in keep]
        self.text = [np.frombuffer(parts[k], np.uint8) for k in keep]
        self.m = np.array([len(t) for t in self.text], np.int64)
        self.e = np.maximum(0, np.minimum((rate * self.m).astype(np.int64), (self.m - q) // q))
        self.bound = np.maximum(1, self.m - q + 1 - q * self.e)
        self.short = [k for k in range(len(self.m)) if self.m[k] < q]
        g, owner, low, high = [], [], [], []
        for k, t in enumerate(self.text):
            own = grams(t, q)
            order = np.argsort(own, kind="stable")
            value = own[order]
            first = np.ones(len(own), bool)
            first[1:] = (value[1:] != value[:-1]) | (np.diff(order) > self.e[k] + 1)
            at = np.flatnonzero(first)
            g.append(value[at])
            owner.append(np.full(len(at), k))
            low.append(order[at])
            high.append(order[np.r_[at[1:], len(own)][: len(at)] - 1])
        g, owner, low, high = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (g, owner, low, high))
        order = np.argsort(g, kind="stable")
        self.owner, self.low, self.high = (x[order].astype(np.int32) for x in (owner, low, high))
        self.gram, self.at, self.many = np.unique(g[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.gram >> U(64 - BITS)).astype(np.int64)] = True


def aligned(item: np.ndarray, regions: list[np.ndarray], width: int) -> list[tuple[int, int, int]]:
    """Least edit distance of an item to a stretch of each region, with the stretch; regions side by side.

    A region begins at the first diagonal of its band; ``width``: diagonals of the band."""
    m, n = len(item), len(regions)
    text = np.full((n, m + width), 255, np.uint8)
    for k, region in enumerate(regions):
        text[k, : min(len(region), m + width)] = region[: m + width]
    ramp, far = np.arange(width), np.full((n, 1), 1 << 40)
    row, begin = np.zeros((n, width), np.int64), np.tile(ramp, (n, 1))
    for j in range(m):
        change = row + (text[:, j : j + width] != item[j])
        skip = np.concatenate([row[:, 1:] + 1, far], 1)
        best = np.minimum(change, skip) - ramp
        start = np.where(change <= skip, begin, np.concatenate([begin[:, 1:], far * 0], 1))
        low = np.minimum.accumulate(best, 1)
        origin = np.maximum.accumulate(np.where(best == low, ramp, 0), 1)
        row, begin = low + ramp, np.take_along_axis(start, origin, 1)
    k = row.argmin(1)
    return list(zip(row[np.arange(n), k].tolist(), begin[np.arange(n), k].tolist(), (k + m).tolist(), strict=True))


def full_bands(i: np.ndarray, k: np.ndarray, at: np.ndarray, items: Items):
    """(text, item, band, shared places) of the double bands that reach their item's bound; i: places of the texts, in
    order, whose q-gram is the k-th of the table."""
    upper = np.cumsum(np.r_[0, np.diff(at) + int(items.m.max()) + 3])  # room for the bands of each text
    many, left = items.many[k], (np.zeros(0, np.int64), np.zeros(0, np.int64))
    upto = np.cumsum(many)
    start = 0
    while start < len(i):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE // 16, "right")))
        runs = many[start:stop]
        entry = np.arange(int(runs.sum())) + np.repeat(items.at[k[start:stop]] - np.cumsum(runs) + runs, runs)
        owner, place = items.owner[entry].astype(np.int64), np.repeat(i[start:stop], runs)
        doc = np.searchsorted(at, place, "right") - 1
        width, from_start = items.e[owner] + 1, place - at[doc] + items.m[owner]  # so that no band is negative
        first, last = (from_start - items.high[entry]) // width, (from_start - items.low[entry]) // width
        wide = last - first + 1
        band = np.arange(int(wide.sum())) + np.repeat(first - np.cumsum(wide) + wide, wide)
        band += np.repeat(owner * upper[-1] + upper[doc], wide)
        value, n = np.unique(np.concatenate([left[0], band + 1, band]), return_counts=True)  # bands band and band - 1, moved up by one
        if len(left[0]):
            n[np.searchsorted(value, left[0])] += left[1] - 1
        item, band = value // upper[-1], value % upper[-1]
        doc = np.searchsorted(upper, band, "right") - 1
        band -= upper[doc]
        open_ = np.zeros(len(value), bool)
        if stop < len(i):  # bands that later places may still reach
            d = int(np.searchsorted(at, i[stop], "right")) - 1
            open_ = (doc == d) & ((band + 1) * (items.e[item] + 1) >= i[stop] - at[d])
        left = value[open_], n[open_]
        done = ~open_ & (n >= items.bound[item])
        yield from zip(doc[done].tolist(), item[done].tolist(), (band[done] - 1).tolist(), n[done].tolist(), strict=True)
        start = stop


#: UTF-8 of letters of scripts that do not write words apart (with their punctuation): U+0E00 to 0EFF, 1000 to 109F, 1780 to 17FF, 3000 to 9FFF.
JOINED = rb"(?:[\xe3-\xe9][\x80-\xbf]|\xe0[\xb8-\xbb]|\xe1(?:[\x80-\x81]|\x82[\x80-\x9f]|[\x9e-\x9f]))"
BEFORE = rb"(?:(?<![^\x00 ])|(?<=[\xe3-\xe9][\x80-\xbf][\x80-\xbf])|(?<=\xe0[\xb8-\xbb][\x80-\xbf])|(?<=\xe1[\x80-\x81][\x80-\xbf])|(?<=\xe1\x82[\x80-\x9f])|(?<=\xe1[\x9e-\x9f][\x80-\xbf]))"
AFTER = rb"(?:(?![^\x00 ])|(?=" + JOINED + rb"))"
LAST_JOINED = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x81][\x80-\xbf]|\xe1\x82[\x80-\x9f]|\xe1[\x9e-\x9f][\x80-\xbf])\Z")


def whole_word(item: bytes) -> re.Pattern:
    """A pattern for a short item with the borders that its first and last letters need."""
    before = b"" if re.match(JOINED, item) else BEFORE
    after = b"" if LAST_JOINED.search(item) else AFTER
    return re.compile(before + re.escape(item) + after)


def found_in(chunk: pa.Array, items: Items, q: int):
    """(row, item, edits, shared q-grams, begin, end) of all items that the texts hold; begin and end in bytes of the text."""
    buf, at, origin = folded(chunk)
    best: dict[tuple[int, int], tuple] = {}
    if len(items.gram):
        g = grams(buf, q)
        i = np.flatnonzero(items.seen[(g >> U(64 - BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(items.gram, g[i]), len(items.gram) - 1)
        ok = items.gram[k] == g[i]
        waiting: dict[int, list] = {}
        asked: set[tuple[int, int, bytes]] = set()  # equal regions of a text are aligned once; bounded, as it only saves time

        def verify(item: int) -> None:
            own, width = waiting.pop(item), int(4 * items.e[item] + 2)
            for (d, s, end, shared), (edits, b, z) in zip(own, aligned(items.text[item], [buf[s:end] for _, s, end, _ in own], width), strict=True):
                z = min(z, end - s)
                if edits <= items.e[item] and ((d, item) not in best or edits < best[d, item][0]):
                    best[d, item] = (edits, shared, int(origin[s + b]), int(origin[max(s + b, s + z - 1)]) + 1)

        for d, item, band, shared in full_bands(i[ok], k[ok], at, items):
            if best.get((d, item), (1,))[0] == 0:
                continue
            e, m = int(items.e[item]), int(items.m[item])
            low = band * (e + 1) - m - e  # the band's first diagonal, less the budget
            s, end = int(at[d]) + max(0, low), int(at[d + 1]) - 1
            wide = 4 * e + 2 + min(0, low)
            if wide <= 0 or s >= end:
                continue
            end = min(end, s + m + wide)
            region = buf[s:end].tobytes()
            exact = region.find(items.text[item].tobytes())
            if exact >= 0:
                best[d, item] = (0, shared, int(origin[s + exact]), int(origin[s + exact + m - 1]) + 1)
            elif e and (d, item, region) not in asked:
                if len(asked) >= 4096:
                    asked.clear()
                asked.add((d, item, region))
                waiting.setdefault(item, []).append((d, s, end, shared))
                if len(waiting[item]) * (4 * e + 2) >= CELLS:
                    verify(item)
        for item in list(waiting):
            verify(item)
    if items.short:
        whole = buf.tobytes()
        for item in items.short:
            word, place = whole_word(items.text[item].tobytes()), 0
            while hit := word.search(whole, place):
                s, d = hit.start(), int(np.searchsorted(at, hit.start(), "right")) - 1
                best[d, item] = (0, 0, int(origin[s]), int(origin[s + items.m[item] - 1]) + 1)
                place = int(at[d + 1])
    return [(d, item, *x) for (d, item), x in sorted(best.items())]


def blocks(benchmark: DataFrame, q: int, rate: float, block_bytes: int):
    """The benchmark in blocks of about ``block_bytes``, as broadcasts."""
    items = table(benchmark.sparkSession, benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct())
    size, rows = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = 1 + (size or 0) // block_bytes
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        most = items.groupBy(block).agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("many")).where("many > 1").agg(F.max("size")).first()[0]
        if (most or 0) <= 2 * block_bytes or n > 4 * rows:
            break
        n *= 2
    for k in range(n):
        own = [tuple(r) for r in items.where(block == k).collect()]
        if own or n == 1:
            yield benchmark.sparkSession.sparkContext.broadcast(Items(own, q, rate))


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, budget, shared, begin, end: the benchmark items that documents hold."""

    def finder(shared):
        def run(batches):
            items = shared.value
            for chunk in chunks(batches):
                rows = found_in(chunk.column("text"), items, q)
                if rows:
                    d, k, *rest = zip(*rows, strict=True)
                    ids = chunk.column("doc_id").take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([items.id[x] for x in k], pa.int64()), *(pa.array(x, pa.int64()) for x in (rest[0], [int(items.e[x]) for x in k], *rest[1:]))], ["doc_id", "item_id", "edits", "budget", "shared", "begin", "end"])

        return run

    rows, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None
    for shared in blocks(benchmark, q, rate, block_bytes):
        part = rows.mapInArrow(finder(shared), "doc_id long, item_id long, edits long, budget long, shared long, begin long, end long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; a map for each block, without a shuffle. Between
    blocks, what is left is written to the shared folder, so that no task runs more than one block at a time."""

    def keeper(shared):
        def run(batches):
            for chunk in chunks(batches):
                keep = np.ones(chunk.num_rows, bool)
                keep[[r[0] for r in found_in(chunk.column("text"), shared.value, q)]] = False
                yield chunk.filter(pa.array(keep))

        return run

    for k, shared in enumerate(blocks(benchmark, q, rate, block_bytes)):
        docs = (table(docs.sparkSession, docs) if k else docs).mapInArrow(keeper(shared), docs.schema)
    return docs
