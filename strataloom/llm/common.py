"""Shared pieces of the training-data operators: word tables over Arrow text, 64-bit hashes, shared-folder tables.

Texts are handled in chunks of about two megabytes inside each task, so a worker's memory does not follow the size of
a partition. All hashes are functions of the bytes alone: equal on every machine and in every run.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
U = np.uint64
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_BLANK = np.isin(np.arange(256), BLANKS)
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply and xor-shift)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASE = U(0xD6E8FEB86659FD93)
STEP = U(0xA0761D6478BD642F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def offsets(text: pa.Array) -> np.ndarray:
    wide = text.cast(pa.large_string())
    return np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other (null counts as empty) and where each text begins and ends."""
    wide = text.fill_null("").cast(pa.large_string())
    off = offsets(wide)
    data = wide.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk of texts: byte ranges, document of each word, 64-bit hashes."""

    def __init__(self, text: pa.Array, lower: bool = False):
        self.buf, self.off = text_bytes(text)
        self.n_docs = len(text)
        if lower:
            self.buf = LOWER_AZ[self.buf]
        n = len(self.buf)
        self.solid = ~IS_BLANK[self.buf]
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:] = ~self.solid[:-1] | cut[1:n]
            after[:-1] = ~self.solid[1:] | cut[1:n]
        self.starts = np.flatnonzero(self.solid & before)
        self.ends = np.flatnonzero(self.solid & after) + 1
        self.lens = self.ends - self.starts
        self.doc = np.searchsorted(self.off, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs) if len(self.doc) else np.zeros(self.n_docs, np.int64)
        self.first = np.cumsum(self.count) - self.count

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        at = np.cumsum(self.lens) - self.lens
        inside = np.arange(at[-1] + self.lens[-1]) - np.repeat(at, self.lens)
        h = np.add.reduceat(BYTE_VALUES[self.buf[self.solid]] * powers(BASE, int(self.lens.max()))[inside], at)
        return mix(h + self.lens.astype(np.uint64) * STEP)

    def same_doc(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each start lie in one document."""
        n = len(self.doc) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def spans(w: np.ndarray, k: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hashes of all runs of ``k`` values, by doubling; the runs may cross documents."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, size, block = None, 0, 1, w
    times = powers(step, k + 1)
    while size <= k:
        if k & size:
            part = block[have : have + n] * times[have]
            out = part if out is None else out + part
            have += size
        if size * 2 <= k:
            block = block[: len(block) - size] + block[size:] * times[size]
        size *= 2
    return mix(out)


def to_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it back: short lineage that outlives lost executors."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables written by ``table`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        inside = shared_folder(spark).split(":", 1)[-1].lstrip("/")
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if inside in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a folder of our own, but on one machine only: executors
    elsewhere could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='strataloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def neutral(docs: DataFrame) -> DataFrame:
    """``docs`` with names of our own for all columns but doc_id and text, so that no name can clash; by position."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, k: int):
    """crc32 of the id as text, modulo ``k``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def share(column: str, wanted: int, total: int):
    """A fixed pseudo-random choice of about ``wanted`` of ``total`` rows by a hash of ``column``."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, wanted / max(total, 1)) + 1)


def budgeted(rows: DataFrame, label: str, budget: int) -> list[tuple]:
    """(id, label) of rows (id, label, size): for each label, in the order of a hash of the id, as many as fit into
    ``budget`` bytes. Rows that repeat an id are one choice, with the sum of their sizes. ``rows`` is a sample of bounded length."""
    found = rows.groupBy("id", label).agg(F.sum("size").alias("size")).select("id", label, "size", F.xxhash64("id").alias("h")).collect()
    out, used = [], {}
    for r in sorted(found, key=lambda r: (r["h"], r["id"], r[label])):
        if used.get(r[label], 0) + r["size"] <= budget:
            used[r[label]] = used.get(r[label], 0) + r["size"]
            out.append((r["id"], r[label]))
    return out
