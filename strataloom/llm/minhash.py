"""MinHash near-duplicate classes with min-max hashing.

Each of 63 permutations of the shingle hashes gives two signature values, its minimum and its maximum; both are
unbiased for the Jaccard similarity and the pair has a lower variance than two minima, at half the hash evaluations.
Bands of these values make the candidates: ``layout`` takes the longest rows at which a pair at the threshold shares no
band with a probability of at most 1e-6 (25 bands of 5 at 0.85: 4e-7; 31 of 4 at 0.80: 8e-8). Candidates are confirmed on
the full shingle sets.

Texts with equal sets are one class from the start. In a bucket every class is first compared with one only, that
which meets most others in buckets (a star around the likely original). Components of the confirmed links follow. Then,
for the classes in buckets that still hold several components, all pairs across components that can meet the threshold
are found by an exact prefix filter on the full sets. So a group of n near copies costs n comparisons, and no link between
band-sharing documents that joins two components is missed.

Nodes are classes, not ids. Nulls and edges: null or word-less text has an empty set, ``component_id = doc_id``, and is
linked with nothing. An id that repeats with several texts is one document: it links the classes of all its texts. A null
``doc_id`` takes part in its class and names no component (``component_id`` is null if no other row of the component has
an id, and then ``kept``). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U, Words, chunks, forget, mix, neutral, spans, table, to_long

PERMUTATIONS, MISS = 63, 1e-6
FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)) | U(1)
SHIFTS = mix(np.arange(101, PERMUTATIONS + 101, dtype=np.uint64))


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted by document and hash. Fewer words than ``width``: one shingle."""
    w = words.hashes()
    ok = words.same_doc(width)
    h, doc = spans(w, width)[ok], words.doc[: len(ok)][ok]
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        extra = [mix(spans(w[words.first[d] : words.first[d] + words.count[d]], int(words.count[d])) + U(7))[0] for d in short]
        h, doc = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[new], doc[new]
    return h, doc


def layout(percent: int) -> tuple[int, int]:
    """Bands and rows of a band."""
    fits = [(2 * PERMUTATIONS // r, r) for r in range(1, 9) if (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) <= MISS]
    return max(fits, key=lambda x: x[1], default=(2 * PERMUTATIONS, 1))


def digest(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's set; zeros for empty ones."""
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(h):
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        a[doc[at]], b[doc[at]] = np.add.reduceat(mix(h + U(11)), at), np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), at)
    return a, b


def text_key() -> Column:
    """Tells the texts of an id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, text_key, n_shingles, the set's 128-bit digest (a, b), and its band keys."""
    bands, rows = layout(percent)

    def run(batches):
        for chunk in chunks(batches):
            h, doc = shingle_sets(Words(chunk.column("text"), lower=True), width)
            n = np.bincount(doc, minlength=chunk.num_rows) if len(doc) else np.zeros(chunk.num_rows, np.int64)
            some = np.flatnonzero(n)
            at = (np.cumsum(n) - n)[some]
            keys = np.zeros((chunk.num_rows, bands), np.uint64)
            if len(some):
                low, high = np.empty((PERMUTATIONS, len(some)), np.uint64), np.empty((PERMUTATIONS, len(some)), np.uint64)
                for p in range(PERMUTATIONS):
                    v = (h ^ SHIFTS[p]) * FACTORS[p]
                    low[p], high[p] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
                values = np.concatenate([low, high])[: bands * rows].reshape(bands, rows, -1)
                for k in range(bands):
                    keys[some, k] = mix(spans(np.ascontiguousarray(mix(values[k])).T.ravel(), rows)[::rows] + U(k + 1))
            lists = pa.FixedSizeListArray.from_arrays(to_long(keys.ravel()), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("text_key"), pa.array(n.astype(np.int64)), *map(to_long, digest(h, doc, chunk.num_rows)), lists], ["doc_id", "text_key", "n_shingles", "a", "b", "bands"])

    narrow = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, text_key long, n_shingles long, a long, b long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, set) of the classes in ``wanted`` (id, doc_id, text_key: one row that has the set), written to the shared folder.
    Texts meet the wanted rows in a merge join, their only shuffle. Rows without an id, whose texts may repeat without end,
    are reduced to one for each text before they move."""

    def run(batches):
        for chunk in chunks(batches):
            h, doc = shingle_sets(Words(chunk.column("text"), lower=True), width)
            ends = np.searchsorted(doc, np.arange(chunk.num_rows + 1))
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array([h[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)], pa.binary())], ["id", "set"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    chosen = rows.where("doc_id is not null").join(wanted.where("doc_id is not null").hint("merge"), ["doc_id", "text_key"]).select("id", "text")
    if not wanted.where("doc_id is null").isEmpty():
        plain = rows.where("doc_id is null").groupBy("text_key").agg(F.first("text").alias("text"))
        chosen = chosen.union(plain.join(wanted.where("doc_id is null").hint("merge"), "text_key").select("id", "text"))
    return table(docs.sparkSession, chosen.mapInArrow(run, "id long, set binary").dropDuplicates(["id"]))


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets meet the threshold."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    with_x = pairs.join(held.select(F.col("id").alias("x"), F.col("set").alias("sx")).hint("merge"), "x")
    both = with_x.join(held.select(F.col("id").alias("y"), F.col("set").alias("sy")).hint("merge"), "y")
    return table(pairs.sparkSession, both.select("x", "y", "sx", "sy").mapInArrow(compare, "x long, y long"))


def prefix_pairs(held: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """All pairs (x, y) of ``held`` of different components (``named``: x, component) that may meet the threshold.

    The shingles of a set are ordered by how many of the sets have them. Two sets of similarity t share at least
    t / (1 + t) of their joint size, so they share a shingle near the front of both orders: in the first
    n - ceil(2 t / (1 + t) n) + 1 of the smaller set and the first n - ceil(t n) + 1 of the larger; and what follows that
    place must be enough for the overlap. Shingles of one set only stand in front and match nothing, so copies that
    were changed in places of their own make no pairs, however many there are."""

    def rows(batches):
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist()]
            n = np.array([len(x) for x in own], np.int64)
            ids = np.repeat(batch.column("id").to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if len(own) else np.zeros(0, np.int64)), pa.array(ids), pa.array(np.repeat(n, n))], ["h", "x", "n"])

    every = held.mapInArrow(rows, "h long, x long, n long")
    often = every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("x")  # as many rows as a document has shingles
    placed = every.join(often.hint("merge"), "h").withColumns({"place": F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h"))})
    p = percent
    front = placed.where(f"place <= n - (({p} * n + 99) div 100) + 1").join(named.hint("merge"), "x").select("h", "x", "n", "place", "component")
    front = table(held.sparkSession, front)
    small = front.where(f"place <= n - ((2 * {p} * n + {99 + p}) div {100 + p}) + 1")
    large = front.select("h", F.col("x").alias("y"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("component").alias("other"))
    fits = f"component <> other and (n < m or n = m and x < y) and 100 * n >= {p} * m and least(n - place, m - at) + 1 >= ({p} * (n + m) + {99 + p}) div {100 + p}"
    return small.join(large.hint("merge"), "h").where(fits).select("x", "y").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Alternating large and small stars; each round
    is written to the shared folder, and the rounds end when the edges stay the same."""
    spark = links.sparkSession
    edges, before = table(spark, links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, edges = edges, table(spark, small.where("u <> v").distinct())
        forget(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def repeated_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (x, y) between the classes of each id that has several."""
    own = signed.where("n_shingles > 0 and doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("one"), F.max(F.struct("a", "b")).alias("other")).where("one <> other").drop("other")
    every = own.select("doc_id", "a", "b").join(several.hint("merge"), "doc_id").select("one", "a", "b").distinct()
    x = every.join(classes.select("a", "b", F.col("x").alias("x")).hint("merge"), ["a", "b"]).select("one.a", "one.b", "x")
    return x.join(classes.select("a", "b", F.col("x").alias("y")).hint("merge"), ["a", "b"]).select("x", "y")


def linked(docs: DataFrame, width: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, their classes (a, b, number x, a row of each: low), and (node, component) of linked classes;
    ``by_id``: an id with several texts links their classes."""
    spark = docs.sparkSession
    signed = table(spark, signatures(docs, width, percent))
    # the smallest row of a class; nulls last
    row = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_key")
    classes = signed.where("n_shingles > 0").groupBy("a", "b").agg(F.min(row).alias("low"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = table(spark, classes.withColumn("x", F.monotonically_increasing_id()))  # written once, so the numbers stay
    keys = classes.select("x", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("x").alias("low"), F.max("x").alias("high")).where("low < high").select("key", "members")
    buckets = keys.join(shared.hint("merge"), "key")
    weights = buckets.groupBy("x").agg(F.sum("members").alias("weight"))
    buckets = table(spark, buckets.join(weights.hint("merge"), "x").select("key", "x", "n", "weight"))
    heads = buckets.groupBy("key").agg(F.max(F.struct("weight", -F.col("x"), "x", "n")).alias("head")).select("key", F.col("head.x").alias("y"), F.col("head.n").alias("m"))
    stars = buckets.join(heads.hint("merge"), "key").where(f"x <> y and 100 * least(n, m) >= {percent} * greatest(n, m)")
    stars = table(spark, stars.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    rows = classes.select("x", "low.doc_id", "low.text_key")
    some = lambda ids: table(spark, rows.join(ids.distinct().hint("merge"), "x").withColumnRenamed("x", "id"))
    held = full_sets(docs, some(stars.select(F.explode(F.array("x", "y")).alias("x"))), width)
    good = confirmed(stars, held, percent)
    forget(held)
    if by_id:
        good = good.union(repeated_ids(signed, classes))
    found = components(good)
    named = found.select(F.col("node").alias("x"), "component").hint("merge")
    spread = table(spark, buckets.select("key", "x").join(named, "x", "left").withColumn("component", F.coalesce("component", "x")))
    mixed = spread.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = table(spark, spread.join(mixed.hint("merge"), "key").select("x", "component").distinct())
    forget(spread, buckets)
    if not rest.isEmpty():
        held = full_sets(docs, some(rest.select("x")), width)
        across = prefix_pairs(held, rest, percent)
        across = across.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        across = table(spark, across.join(stars.hint("merge"), ["x", "y"], "left_anti"))
        if not across.isEmpty():
            found = components(found.select(F.col("node").alias("x"), F.col("component").alias("y")).union(confirmed(across, held, percent)))
        forget(held, across)
    forget(stars, rest)
    return signed, classes, found


def tops(classes: DataFrame, found: DataFrame) -> DataFrame:
    """a, b, low and the smallest low of the component (top), for each class."""
    members = found.select(F.col("node").alias("x"), "component").union(found.select("component", "component").distinct())  # roots are no nodes
    least = members.join(classes.select("x", "low").hint("merge"), "x").groupBy("component").agg(F.min("low").alias("least"))
    named = members.join(least.hint("merge"), "component").select("x", "least")
    return classes.select("a", "b", "low", "x").join(named.hint("merge"), "x", "left").select("a", "b", "low", F.coalesce("least", "low").alias("top"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    signed, classes, found = linked(docs, width, percent, True)
    own = tops(classes, found).select("a", "b", F.col("top.doc_id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "a", "b").join(own.hint("merge"), ["a", "b"], "left")
    name = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", name.alias("component_id"), F.coalesce(F.col("doc_id") == name, name.isNull()).alias("kept"))


def keep(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component of texts one row stays, that of the
    smallest id (rows without an id come last, ties go by a hash of the text). Here an id that repeats links nothing: each of
    its texts is judged by itself. Rows without words stay. Rows that are equal in doc_id and text count once."""
    signed, classes, found = linked(docs, width, percent, False)
    first = tops(classes, found).where("low <=> top").select("low.doc_id", "low.text_key")
    chosen = first.union(signed.where("n_shingles = 0").select("doc_id", "text_key")).distinct()
    chosen = table(docs.sparkSession, chosen.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")))
    own = neutral(docs)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("own_id")) & (text_key().eqNullSafe(F.col("own_key")))
    out = own.join(chosen.hint("merge"), same, "left_semi").toDF(*docs.columns)
    if signed.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return out
    return out.dropDuplicates(["doc_id", "text"])
