"""Possible-same-as candidates: items of one kind whose name and description share most of their tokens; never merged.

An exact set-similarity join. Tokens are runs of letters and digits, lowered, and pairs of neighbouring characters in scripts without
blanks (Han, Kana). Items with equal token sets are one class, represented by its smallest item: its other members are candidates
of the representative, and only representatives are compared, so copies are not multiplied out.

Two sets x and y with a Jaccard similarity of t or more: a tokens of x missing in y and b more of y allow a + t b <= (1 - t) |x|. If all tokens are put in one order,
a token and the next one after it are called a step (the last has none after it). A missing token takes two steps of x away, one more of y takes one, which is less than 2 t for t above a half.
So of the first 2 (1 - t) |x| + 1 steps of x one is left, and the first one left is among those of y too. Rare tokens come first: those that are not among the ``ranked`` most
frequent ones, by hash, then those by frequency. The order decides speed only; its table is bounded by ``ranked``. Two tokens in common as neighbours are far rarer than one, so strangers seldom
meet. With t of a half or less steps are single tokens.
Rows (kind, step) meet in a merge join, in which a pair counts only if sizes, places and bitmaps still allow the overlap, and only where a stretch of common steps begins.
An item's bitmap holds for each of its bits whether an even or an odd number of its tokens falls there: two sets differ in at least as many
tokens as their bitmaps in bits. It grows with the set, so that it turns long texts away too; the pairs left, each once, are verified on
all tokens, by the differences of near copies from a common center. Tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as T
from ..functions.steps import settled
from ..sources.tables import forget, written

SOLID = r"[぀-ヿ㐀-䶿一-鿿]"
RUNS = r"[\p{L}\p{N}&&[^぀-ヿ㐀-䶿一-鿿]]+"


def words(text: Column) -> Column:
    """The tokens of a text as often as they come; an empty array for null or without a letter or digit. Texts of other scripts, most of them, are spared the longer patterns."""
    low = F.lower(F.coalesce(text, F.lit("")))
    both = F.concat(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0)), F.regexp_extract_all(low, F.lit(f"(?=({SOLID}{{1,2}}))"), F.lit(1)))
    return F.when(low.rlike(SOLID), both).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def tokens(text: Column) -> Column:
    """The distinct tokens of a text."""
    return F.array_distinct(words(text))


def most_frequent(sets: DataFrame, ranked: int) -> np.ndarray:
    """Hashes of the ``ranked`` most frequent tokens, the least frequent of them first; counts are summed in each task first."""
    top = sets.select(F.explode("set").alias("h")).groupBy("h").count().orderBy(F.desc("count"), "h").limit(ranked).collect()
    return np.array([r.h for r in reversed(top)], np.int64)


def in_order(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``sets`` (item, kind, set) with each set in the common order, and its ``bits``."""
    by_hash = np.argsort(frequent, kind="stable")
    known = frequent[by_hash]

    def run(batches):
        for b in batches:
            column = b.column("set")
            flat, off = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            place = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            rank = np.where(known[place] == flat, by_hash[place] + 1, 0) if len(known) else np.zeros(len(flat), np.int64)
            order = np.lexsort((flat, rank + np.repeat(np.arange(b.num_rows) * (len(known) + 1), np.diff(off))))
            ordered = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat[order]))
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("kind"), ordered, bitmaps(flat, np.diff(off))], ["item", "kind", "set", "bits"])

    return sets.select("item", "kind", "set").mapInArrow(run, sets.select("item", "kind", "set").schema.add("bits", ArrayType(LongType())))


def bitmaps(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """The bitmaps of sets of those sizes that lie one after the other in ``flat``, as words of 64 bits: a power of two, so that the halves of
    a bitmap, one laid on the other, are the bitmap of half its length; 5 to 10 bits for 8 tokens."""
    words = 2 ** np.ceil(np.log2(np.maximum(sizes * 5 / 512, 1))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(words)])
    h = flat.view(np.uint64)
    place = np.repeat(first[:-1], sizes) + ((h >> np.uint64(6)) & np.repeat(words - 1, sizes).astype(np.uint64)).astype(np.int64)
    out = np.zeros(first[-1], np.uint64)
    np.bitwise_xor.at(out, place, np.uint64(1) << (h & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(out.view(np.int64)))


def differing(x: str, y: str) -> Column:
    """In how many bits two bitmaps differ, of which one may be twice as long as the other."""
    k = f"least(size({x}), size({y}))"
    folded = lambda b: f"{b}[j] ^ if(size({b}) > {k}, {b}[j + {k}], 0L)"
    return F.expr(f"aggregate(sequence(0, {k} - 1), 0, (s, j) -> s + bit_count({folded(x)} ^ {folded(y)}))")


def steps(sets: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(item, key, before, place, bits) of the first steps of the ordered ``sets``, by which pairs of that similarity meet, with the token before each; and of how many tokens a step is.
    A set's size and where in it the step is are the halves of ``place``: a number less for each row that is dealt out."""
    k = 2 if threshold > 0.5 else 1
    first = F.slice("set", 1, F.floor(k * (1 - F.lit(threshold)) * F.size("set") + 1e-6).cast("int") + 1)
    rows = sets.select("item", "kind", "set", F.size("set").alias("n"), "bits", F.posexplode(first).alias("at", "token"))
    key = F.xxhash64("kind", "token", *([F.get("set", F.col("at") + 1)] if k > 1 else []))
    return rows.select("item", key.alias("key"), F.get("set", F.col("at") - 1).alias("before"), (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("place"), "bits"), k


def close_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(item, other, kind, score) of the ordered ``sets`` (item, kind, set) of one kind with that similarity or more; item < other."""
    rows, k = steps(sets, threshold)
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    c, t = F.col, F.lit(threshold)
    n, at = ({x: f(c(f"{x}.place")) for x in "ab"} for f in (lambda p: F.shiftright(p, 32), lambda p: p.bitwiseAND(2**32 - 1)))
    need = F.ceil(t / (1 + t) * (n["a"] + n["b"]) - 1e-9)
    met = (c("a.key") == c("b.key")) & (c("a.item") < c("b.item"))
    fits = F.least(n["a"], n["b"]) >= t * F.greatest(n["a"], n["b"]) - 1e-9
    for x, y in ("ab", "ba"):  # before the first step in common, tokens in both sets are k - 1 at most for each that is in one
        fits &= k * at[x] - (k - 1) * at[y] <= (2 * k - 1) * (n[x] - need)
    if k > 1:  # after the same token, the pair has met one step earlier
        fits &= ~F.coalesce(c("a.before") == c("b.before"), F.lit(False))
    # bitmaps are compared last and, of pairs whose sizes are that far apart that one is folded more than once, not at all
    near = F.when(F.greatest(F.size("a.bits"), F.size("b.bits")) > 2 * F.least(F.size("a.bits"), F.size("b.bits")), True).otherwise(differing("a.bits", "b.bits") <= n["a"] + n["b"] - 2 * need)
    found = a.join(b, met & fits & near).select(c("a.item").alias("item"), c("b.item").alias("other")).distinct()
    shared = verified(written(found), sets)
    return shared.withColumn("score", c("common") / (c("n") + c("m") - c("common"))).where(c("score") >= threshold - 1e-9).select("item", "other", "kind", "score")


def verified(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(item, other, kind, n, m, common) of the pairs ``found`` of one kind: the sizes of both sets and of what they share.

    Near copies come in groups, of which each pair is a result. So the two sets of a pair are compared by the tokens in which they differ from one center, the smallest partner of
    its item: a token that is in both differences is in both sets or in neither. A set is compared as a whole with its centers only, mostly one."""
    c = F.col
    both = found.select("item", c("item").alias("center")).unionByName(found.select(c("other").alias("item"), c("item").alias("center")))
    pairs = written(found.join(both.groupBy("item").agg(F.min("center").alias("center")).hint("merge"), "item"))
    each = pairs.select("item", "center").unionByName(pairs.select(c("other").alias("item"), "center")).distinct()
    each = each.join(sets.select("item", "kind", c("set").alias("x")).hint("merge"), "item").join(sets.select(c("item").alias("center"), c("set").alias("y")).hint("merge"), "center")
    each = written(each.select("item", "center", "kind", F.size("x").alias("n"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("x")))
    others = each.select(c("item").alias("other"), "center", c("kind").alias("other_kind"), c("n").alias("m"), c("x").alias("y"))
    pairs = pairs.join(each.hint("merge"), ["item", "center"]).join(others.hint("merge"), ["other", "center"]).where("kind = other_kind")
    common = (c("n") + c("m") - F.size("x") - F.size("y")) / 2 + F.size(F.array_intersect("x", "y"))
    return settled(pairs, {"common": common.cast("long")}).select("item", "other", "kind", "n", "m", "common")


def possible_same_as(items: DataFrame, threshold: float = 0.8, linked: DataFrame | None = None, ranked: int = 20_000) -> DataFrame:
    """(item, other, kind, score, reason) of ``items`` (item, kind, name, description): item < other. Reasons: equal tokens (other is in
    item's class), equal names, similar tokens. Pairs that ``linked`` (item, entity) has in one entity already are left out.

    Items without a token, or of null kind, are candidates of nothing; blank names are no equal names; repeated rows count once."""
    folded = F.lower(T.normalize_text(F.coalesce("name", F.lit(""))))
    known = items.where("item is not null and kind is not null").select("item", "kind", folded.alias("name"), F.concat_ws(" ", "name", "description").alias("text"))
    rows = settled(known, {"set": F.sort_array(F.array_distinct(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))))}).drop("text").where(F.size("set") > 0)
    rows = settled(rows, {"digest": F.md5(F.array_join(F.col("set").cast("array<string>"), ",").cast("binary"))})
    rows = written(rows)  # repeated rows are still in it: only what is narrow, and later the sets of the classes, is dealt out
    once = rows.groupBy("item").agg(F.min(F.struct("kind", "digest", "name")).alias("s")).select("item", "s.*")
    heads = once.groupBy("kind", "digest").agg(F.min("item").alias("head"))
    placed = written(once.join(heads.hint("merge"), ["kind", "digest"]).select("item", "kind", "digest", "name", "head"))
    copies = placed.where("item <> head").select(F.col("head").alias("item"), F.col("item").alias("other"), "kind", F.lit(1.0).alias("score"))
    key = ["item", "kind", "digest"]
    chosen = rows.select(*key, "set").join(placed.where("item = head").select(*key).hint("merge"), key, "left_semi").dropDuplicates(key)
    sets = written(in_order(chosen, most_frequent(rows, ranked)))
    forget(rows)
    pairs = copies.unionByName(close_pairs(sets, threshold))
    names = placed.select("item", "name")
    pairs = pairs.join(names.hint("merge"), "item").join(names.select(F.col("item").alias("other"), F.col("name").alias("other_name")).hint("merge"), "other")
    reason = F.when(F.col("score") == 1.0, "equal tokens").when((F.col("name") != "") & (F.col("name") == F.col("other_name")), "equal names").otherwise("similar tokens")
    out = pairs.select("item", "other", "kind", F.round("score", 6).alias("score"), reason.alias("reason"))
    if linked is None:
        return out
    one, two = (linked.select(F.col("item").alias(i), F.col("entity").alias(e)).hint("merge") for i, e in (("item", "__e1"), ("other", "__e2")))
    return out.join(one, "item", "left").join(two, "other", "left").where("not coalesce(__e1 = __e2, false)").select(out.columns)
