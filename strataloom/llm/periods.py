"""Periodic runs of words: a block's exact occurrences in the window behind it, by number-theoretic transforms.

A run is a stretch of consecutive words in which words ``q`` apart are equal, with ``q`` its smallest period and a length of
``least`` or more and of 2 q or more, that no neighbouring word extends. Periods are searched by dyadic scales. At scale b
(2, 4, 8, ...; periods 1 to 6, 7 to 14, 15 to 30, ...) every run of such a period holds an aligned block of b words together with
the same block one period later, since its length is at least q + 2 b - 1. So the sum of squared differences between each aligned
block and each place of the window behind it is computed, as sums of squares less twice a correlation, the correlation by
integer transforms modulo a prime: it is 0 wherever the block occurs. Such a distance is a seed; it is extended word by word
to both sides, which also settles the rare sum that only the modulus makes 0. Smaller periods come first, so a stretch that is
known already has a smaller period and is no run of this one.

Two sound cuts keep ordinary text away from the transforms. Within a run of period q every word but those of the last period
comes again within q words: a block counts only inside a long enough stretch of words that come again within the scale's
largest period. And a block whose window lies inside a known run with a period of at most b can only show multiples of it.

The work needs no shuffle: a document is one row. Its time is n log(n)^2 at most and its memory some 64 bytes a word
(one million words: see README). Null text has no words and no run; an empty table gives no rows; rows are kept one for one, with repeated
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: 119 * 2^23 + 1, with 3 as a primitive root: transforms up to 2^23 places, products below 2^60.
PRIME, ROOT = 998_244_353, 3
P = np.uint64(PRIME)
LEAST, BATCH = 12, 1 << 19
FINGERPRINTS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, n_dropped long, runs_sha256 string, collapsed_sha256 string"


@lru_cache(64)
def twiddles(half: int, inverse: bool) -> np.ndarray:
    """Powers of a root of order 2 ``half`` (or of its inverse)."""
    step = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    step = pow(step, PRIME - 2, PRIME) if inverse else step
    out = np.ones(half, np.uint64)
    have = 1
    while have < half:
        out[have : 2 * have] = out[: min(have, half - have)] * np.uint64(pow(step, have, PRIME)) % P
        have *= 2
    return out


def transform(a: np.ndarray) -> np.ndarray:
    """Forward transform of each row, in place; the result is in bit-reversed order."""
    half = a.shape[1] // 2
    while half:
        v = a.reshape(len(a), -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        diff = (low + (P - high)) * twiddles(half, False) % P
        low += high
        np.minimum(low, low - P, out=low)  # wraps to a large number where it was below P
        high[:] = diff
        half //= 2
    return a


def back(a: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``, in place, from bit-reversed order."""
    half, n = 1, a.shape[1]
    while half < n:
        v = a.reshape(len(a), -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        turned = high * twiddles(half, True) % P
        np.add(low, P - turned, out=high)
        np.minimum(high, high - P, out=high)
        low += turned
        np.minimum(low, low - P, out=low)
        half *= 2
    return a * np.uint64(pow(n, PRIME - 2, PRIME)) % P


def squared_differences(block: np.ndarray, window: np.ndarray) -> np.ndarray:
    """For each row and each place of the window where the block fits: the sum of squared differences, modulo the prime."""
    b, m = block.shape[1], window.shape[1]
    size = 1 << max(m - 1, 1).bit_length()
    x, y = np.zeros((len(block), size), np.uint64), np.zeros((len(block), size), np.uint64)
    x[:, :b], y[:, :m] = block[:, ::-1], window
    common = back(transform(x) * transform(y) % P)[:, b - 1 : m]
    squares = np.zeros((len(block), m + 1), np.uint64)
    np.cumsum(window * window % P, axis=1, out=squares[:, 1:])
    total = (block * block % P).sum(1, keepdims=True) + squares[:, b:] - squares[:, : m - b + 1]
    return (total + (P - common) * np.uint64(2)) % P


def agree(x: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from ``i`` and from ``j`` (i < j) on are equal, at most ``most``, forwards (step 1) or backwards (-1)."""
    have, size = 0, 16
    while have < most:
        take = min(size, most - have)
        if step > 0:
            differ = x[i + have : i + have + take] != x[j + have : j + have + take]
        else:
            differ = (x[i - have - take + 1 : i - have + 1] != x[j - have - take + 1 : j - have + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return have + at
        have += take
        size *= 4
    return have


def again(x: np.ndarray) -> np.ndarray:
    """How many words later each word comes next; the number of words where it does not."""
    out = np.full(len(x), len(x), np.int64)
    order = np.argsort(x, kind="stable")
    same = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    out[order[same]] = order[same + 1] - order[same]
    return out


def blocks_inside(close: np.ndarray, need: int, b: int) -> np.ndarray:
    """Starts of the aligned blocks of ``b`` places inside stretches of ``need`` or more true places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], close, [False])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    long = end - start >= need
    first, last = -(-start[long] // b), end[long] // b
    n = np.maximum(last - first, 0)
    return (np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * b


def find_runs(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``x`` (numbers of words from 0), by start, then period. ``least`` is 12 or more."""
    n, found = len(x), {}
    if n < least:
        return []
    distance, b, lo, hi = again(x), 2, 1, 6
    values = x.astype(np.uint64)
    missing = np.uint64(int(x.max()) + 1)
    while 2 * lo <= n:
        at = blocks_inside(distance <= hi, max(lo, 6), b)
        if len(at) and found:
            reach = np.zeros(n, np.int64)
            for (start, end), q in found.items():
                if q <= b:
                    reach[start] = max(reach[start], end)
            at = at[np.maximum.accumulate(reach)[at] < np.minimum(at + b + hi, n)]
        seeds = []
        width = hi - lo + b
        for k in range(0, len(at), max(1, BATCH // (4 * b))):
            some = at[k : k + max(1, BATCH // (4 * b))]
            places = some[:, None] + (lo + np.arange(width))
            window = np.where(places < n, values[np.minimum(places, n - 1)], missing)
            row, q = np.nonzero(squared_differences(values[some[:, None] + np.arange(b)], window) == 0)
            seeds.append(np.stack([q + lo, some[row]], 1))
        seeds = np.concatenate(seeds) if seeds else np.zeros((0, 2), np.int64)
        upto, period = 0, 0
        for q, i in seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))].tolist():
            upto = upto if q == period else 0
            period = q
            if i + b + q <= upto or i + b + q > n:
                continue
            right = agree(x, i, i + q, n - i - q, 1)
            if right < b:
                continue
            start = i - agree(x, i - 1, i - 1 + q, i, -1)
            upto = i + q + right
            if upto - start >= max(least, 2 * q):
                found.setdefault((start, upto), q)
        b, lo, hi = 2 * b, hi + 1, 8 * b - 2
    return sorted((start, end - start, q) for (start, end), q in found.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word lies in a run behind that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def tail_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The fixed rule for measured documents: of one id in ten (by crc32) the words from a place on repeat with a period; (place, period) or None."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    start = h // 10 % n
    return start, 1 + (n - start) // (3 + h // 10 % 8)


def periodic_runs(docs: DataFrame, least: int = LEAST, tail: Callable[[int | None, int], tuple[int, int] | None] | None = None, texts: bool = False) -> DataFrame:
    """For each row the number of runs, the longest run, how many words are dropped, and digests; with ``texts`` also the runs and
    the words that stay. ``tail(doc_id, n)`` may name a place and a period with which the words from that place on are repeated first."""
    if least < LEAST:
        raise ValueError(f"runs are complete from {LEAST} words on")

    def one(doc_id, text):
        words = (text or "").encode().split()  # exactly the blanks \\x20 \\x09-\\x0D
        n = len(words)
        if tail and (rule := tail(doc_id, n)):
            start, q = rule
            words = words[:start] + [words[start + k % q] for k in range(n - start)]
        number: dict[bytes, int] = {}
        runs = find_runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n), least)
        kept = words
        if runs:
            kept = [words[k] for k in np.flatnonzero(~dropped(n, runs)).tolist()]
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        joined = b" ".join(kept)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        out = (doc_id, n, len(runs), *best, n - len(kept), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(joined).hexdigest())
        return (*out, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], text if text is None else joined.decode()) if texts else out

    names = [c.split()[0] for c in FINGERPRINTS.split(", ")] + (["runs", "clean_text"] if texts else [])
    types = [pa.string() if "sha256" in c else pa.int64() for c in names[:10]]
    types += [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()] if texts else []

    def run(batches):
        for chunk in chunks(batches):
            rows = [one(*r) for r in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = FINGERPRINTS + ", runs array<struct<start: long, length: long, period: long>>, clean_text string" * texts
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
