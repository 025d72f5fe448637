"""Benchmark passages in documents: a lossless shingle gate, SimHash windows of item size, exact check.

Windows of as many words as an item has slide over a document. The similarity of a window
and an item is the weighted Jaccard similarity of their word shingles (weights: how often
each occurs), so a window of similarity `threshold` shares a least number of shingles with
its item. Four steps:

1. One of every few neighbouring shingles of such a window is an item's. Documents are
   probed at that stride, and only those with a hit go on. No window is lost.
2. All their shingles meet the items that have them. In a window, as many places as it must
   share at least are such places, so only starts of windows with so many are left, each
   beside the item that it may hold. No window is lost.
3. Their SimHash fingerprints (a bit for each bit of the shingles' hashes: what most have) are
   compared with the item's by blocks of 16 bits: fingerprints within `radius` bits have a block
   with at most radius / blocks different bits. All pairs within the radius pass, others don't.
4. The shared shingles of what is left are counted.

At 128 bits a window at the very threshold differs from its item in 19 bits on average, with a
standard deviation of 4; the radius of 47 lies nearly seven deviations off, and three
unrelated windows of a thousand are within it (simulated, 9 to 200 shingles).

All steps are built-in functions and joins; the planner broadcasts a side only below its
size limit and sorts and merges beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeforge.llm.blocks import checkpoint


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; one empty word if there are none."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingle(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(k)), F.lit(k))


def _shingles(w: Column, k: int) -> Column:
    """Of all places; texts of fewer words have none."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: _shingle(w, i, k))).otherwise(F.array().cast("array<bigint>"))


def _once(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def simhash(shingles: Column) -> Column:
    """Two 64-bit words: each bit is one where more than half of the shingles' hashes have it."""
    long = lambda n: F.lit(n).cast("long")

    def word(hashes: Column) -> Column:
        votes = lambda b: F.aggregate(hashes, long(0), lambda acc, h: acc + F.call_function("shiftright", h, b).bitwiseAND(long(1)))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), long(0), lambda acc, b: F.when(votes(b) * 2 > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", long(1), b))).otherwise(acc))

    return F.array(_once(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(1))), word), _once(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(2))), word))


def within(a: Column, b: Column, radius: int) -> Column:
    """Fingerprints of at most `radius` different bits: some block of 16 has few enough, then all bits are counted."""

    def close(words: Column) -> Column:
        blocks = [F.bit_count(F.shiftrightunsigned(F.get(words, F.lit(w)), 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))) for w in (0, 1) for i in range(4)]
        return (F.least(*blocks) <= radius // len(blocks)) & (F.bit_count(F.get(words, F.lit(0))) + F.bit_count(F.get(words, F.lit(1))) <= radius)

    return _once(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), close)


def find_contamination(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    radius: int = 47,
) -> DataFrame:
    """The best window of each document for each item that it holds: id_col, item_id, start_word, n_words, similarity.

    Words are lower-cased runs of letters and digits; n_words is the item's size, cut to the document's. The
    similarity of equally good windows is that of the first. Items of fewer than `shingle` words are compared by
    shingles of as many words as they have; items and documents without words, and null items, match nothing. Rows
    that agree in id and text are one document; a null id is an id. Repeated items count once, by id and text.
    Long texts are searched whole; a very long one is a row of one task. Other columns don't take part, whatever their
    names; empty tables give no rows.
    """
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("iw")).where("item_id is not null").distinct()
    tests = tests.withColumn("size", F.size("iw")).where("iw[0] != ''").withColumn("k", F.least("size", F.lit(shingle)))
    tests = tests.withColumn("item", F.xxhash64("item_id", "iw"))
    docs = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    pieces, probed, places = None, None, None
    # Widths below `shingle` only where items are that short; a handful of numbers.
    widths = sorted((r["k"], r["least"]) for r in tests.groupBy("k").agg(F.min("size").alias("least")).collect())
    if not widths:
        return df.select(F.col(id_col), *(F.lit(0).cast(t).alias(c) for c, t in (("item_id", "long"), ("start_word", "int"), ("n_words", "int"), ("similarity", "double")))).where("false")
    for k, least in widths:
        # of n shingles at most n * lost can be missing in a similar window
        lost, n = (1 - threshold), least - k + 1
        stride = next(s for s in (4, 3, 2, 1) if s == 1 or all(x // s > int(x * lost / (1 + lost) * 2 + 1e-9) for x in range(n, n + 400)))
        own = tests.where(F.col("k") == k).withColumn("b", _shingles(F.col("iw"), k)).drop("iw")
        pieces = own if pieces is None else pieces.unionByName(own)
        few, all_ = (_placed(k, step) for step in (stride, 1))
        probed = few if probed is None else F.concat(probed, few)
        places = all_ if places is None else F.concat(places, all_)
    pieces = pieces.withColumn("print", simhash(F.col("b")))
    known = pieces.select("item", F.explode(F.array_distinct("b")).alias("h"))
    keys = docs.select("key", F.explode(probed).alias("p")).select("key", "p.h").join(known.select("h").distinct(), "h", "left_semi").select("key").distinct()
    # Only documents with an item's shingle go on; their texts move once.
    texts = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gated = checkpoint(texts.join(keys, "key").dropDuplicates(["key"]).select("key", "id", words(F.col("text")).alias("w")))
    hits = gated.select("key", "id", F.size("w").alias("n"), F.explode(places).alias("p")).select("key", "id", "n", "p.*").join(known, "h")
    pairs = hits.groupBy("key", "item").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("hits"))
    # a and b: shingles of a window and of the item; a window that is similar shares `need`
    pairs = pairs.join(pieces, "item").withColumn("both", F.least("size", "n") - F.col("k") + 1 + F.size("b"))
    pairs = pairs.withColumn("a", F.col("both") - F.size("b")).withColumn("need", F.greatest(F.ceil(F.col("both") * (threshold / (1 + threshold)) - 1e-6).cast("int"), F.lit(1)))
    pairs = pairs.where(F.size("hits") >= F.col("need")).withColumn("starts", _starts()).where(F.size("starts") > 0)
    # the shingles of those windows alone, from the text's row
    low, high = F.array_min("starts"), F.array_max("starts")
    around = F.coalesce(*(F.when(F.col("k") == k, _near(k, low, high + F.col("a") - 1)) for k, _ in widths))
    pairs = pairs.join(gated.select("key", "w"), "key").withColumn("around", around).drop("w")
    pairs = pairs.withColumn("starts", F.filter("starts", lambda s: within(simhash(F.slice("around", s - low + 1, F.col("a"))), F.col("print"), radius)))
    found = F.array_max(F.transform("starts", lambda s: F.struct(_shared(F.filter("hits", lambda x: (x["pos"] >= s) & (x["pos"] < s + F.col("a")))["h"]).alias("shared"), (-s).alias("s"))))
    pairs = pairs.where(F.size("starts") > 0).select("key", "id", "item_id", F.least("size", "n").alias("n_words"), "both", found.alias("m"))
    scored = pairs.withColumn("similarity", F.col("m.shared") / (F.col("both") - F.col("m.shared"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("key", "item_id").agg(F.first("id").alias("id"), F.max(F.struct("similarity", "m.s", "n_words")).alias("m"))
    return best.select(F.col("id").alias(id_col), "item_id", (-F.col("m.s")).alias("start_word"), F.col("m.n_words").alias("n_words"), F.col("m.similarity").alias("similarity"))


def _placed(k: int, stride: int) -> Column:
    """(pos, h) of every stride-th shingle of w."""
    at = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), _shingle(F.col("w"), i, k).alias("h")))


def _near(k: int, first: Column, last: Column) -> Column:
    """The shingles of the places from first to last."""
    return F.transform(F.sequence(first, last), lambda i: _shingle(F.col("w"), i, k))


def _starts() -> Column:
    """The starts of the windows of a shingles that have `need` places among `hits`, which are sorted."""
    hits, a, need = F.col("hits"), F.col("a"), F.col("need")
    place = lambda j: F.get(hits, j)["pos"]

    def starting(j: Column) -> Column:
        """Windows whose first hit is the j-th."""
        low = F.greatest(place(j + need - 1) - a + 1, F.coalesce(place(j - 1), F.lit(-1)) + 1)
        high = F.least(place(j), F.col("n") - F.col("k") + 1 - a)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    # optimised plans may come here before the filter
    return F.when(F.size(hits) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - need), starting)))


def _shared(found: Column) -> Column:
    """How many of a window's shingles that are an item's it shares: equal ones are counted by value, where there are any."""
    count = lambda array, h: F.size(F.filter(array, lambda x: x == h))

    def of(w: Column) -> Column:
        once = F.array_distinct(w)
        return F.when(F.size(once) == F.size(w), F.size(w)).otherwise(F.aggregate(once, F.lit(0), lambda acc, h: acc + F.least(count(w, h), count(F.col("b"), h))))

    return F.get(F.transform(F.array(found), of), F.lit(0))
