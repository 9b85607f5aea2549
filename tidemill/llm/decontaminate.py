"""Benchmark decontamination: SimHash of item-sized windows and a multi-index Hamming join.

A window of a document has as many words as the benchmark item it may match. Window and item
get a 64-bit SimHash of their weighted five-word shingles; an item's fingerprint is indexed
under every value within three bit errors of each of its four 16-bit blocks, so that by
pigeonhole all fingerprints within a distance of 15 meet. What meets is verified by the exact
weighted Jaccard similarity of the two multisets of shingles.

Windows begin where a shingle of an item of that size occurs, or end with the document, or
begin less than a window before such a shingle with one that several items of other sizes
have. No match is lost by that: any other first shingle is not shared and has the largest
weight there is, so shifting the window to the right does not lower its similarity. Everything runs as DataFrame expressions; only benchmark tables of a counted
size are broadcast, larger ones are joined through a shuffle.

Weights are ln(1 + items / items with the shingle); shingles of no item weigh like those of
one. Words are compared in lower case (A-Z).

With `short_documents` a document with fewer words than an item is one window as a whole,
unless its shingles weigh too little for any item of that size; without it, it does not
match that item.

Defined results: null or empty documents match nothing. Items that are null or shorter than a shingle match nothing. Rows that repeat a doc
id or an item id are reported together, a pair once. Of equal similarities the first window
counts. Texts are read whole; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import lower_ascii, materialize, words

BLOCKS, BLOCK_BITS = 4, 16


@dataclass(frozen=True)
class LeakSettings:
    shingle: int = 5
    similarity: float = 0.8
    errors: int = 3  # per block; finds all fingerprints within BLOCKS * (errors + 1) - 1 bits
    sent_bytes: int = 16 << 20  # of a side table that may be broadcast
    short_documents: bool = False  # compare a document that is shorter than an item as a whole

    @property
    def radius(self) -> int:
        return BLOCKS * (self.errors + 1) - 1


def _with_hashes(rows: DataFrame, size: int) -> DataFrame:
    """`text` replaced by the hashes of its word shingles in order; none for shorter texts.

    The words are a column of their own: inside the transform they would be found again for
    every shingle. For the same reason the hashes are exploded by `posexplode_outer`: the
    filter on their number that Spark derives for a plain explosion is pushed below the
    projection and takes the words' expression with it into the lambda.
    """
    rows = rows.withColumn("_words", words(lower_ascii(F.col("text")))).drop("text")
    each = F.transform(F.sequence(F.lit(1), F.size("_words") - (size - 1)), lambda i: F.xxhash64(F.slice("_words", i, size)))
    return rows.withColumn("hashes", F.when(F.size("_words") >= size, each).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def fingerprint(shingles: str) -> Column:
    """SimHash of a column of (h, w) structs: bit b is set if the weights of hashes with it prevail."""
    signed = "if((shiftright(x.h, b) & 1L) = 1L, x.w, -x.w)"
    total = f"aggregate({shingles}, 0D, (a, x) -> a + {signed})"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if({total} > 0, shiftleft(1L, b), 0L))")


def _size_checked(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if its numbers, hashed, take at most `most` bytes; else left to a shuffle join."""
    return F.broadcast(df) if df.count() * (8 * len(df.columns) + 40) <= most else df


def _items(benchmark: DataFrame, key: str, text: str, s: LeakSettings) -> tuple[DataFrame, DataFrame]:
    """(item_id, n, shingles (h, w), fingerprint), and (h, w, df, n) for each size of items with h."""
    rows = _with_hashes(benchmark.select(F.col(key).alias("item_id"), F.col(text).alias("text")), s.shingle)
    rows = rows.filter(F.size("hashes") > 0).withColumn("item", F.xxhash64("item_id", "hashes"))
    each = rows.withColumn("n", F.size("hashes")).select("item_id", "item", "n", F.posexplode_outer("hashes").alias("at", "h"))
    total = rows.select("item").distinct().agg(F.count("*").alias("total"))
    weights = each.groupBy("h").agg(F.count_distinct("item").alias("df")).crossJoin(F.broadcast(total))
    weights = weights.select("h", "df", F.log1p(F.col("total") / F.col("df")).alias("w"))
    listed = materialize(each.join(weights, "h"), "leak-items")
    whole = listed.groupBy("item_id", "item", "n").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("at", "h", "w"))), lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("s")
    )
    whole = materialize(whole.withColumn("print", fingerprint("s")), "leak-prints")
    return whole, listed.select("h", "w", "df", "n").distinct()


def _block(print_: Column, b: int) -> Column:
    return F.shiftrightunsigned(print_, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _index(items: DataFrame, s: LeakSettings) -> DataFrame:
    """(slot, item, item_print): each block value within `errors` bits of an item's, by item size."""
    masks = [sum(1 << i for i in flips) for e in range(s.errors + 1) for flips in combinations(range(BLOCK_BITS), e)]
    flips = items.sparkSession.createDataFrame([(m,) for m in masks], "mask long")
    blocks = F.array(*(F.struct(F.lit(b).alias("b"), _block(F.col("print"), b).alias("v")) for b in range(BLOCKS)))
    each = items.select("item", "n", F.col("print").alias("item_print"), F.explode(blocks).alias("x"))
    near = each.crossJoin(F.broadcast(flips))  # a fixed number of masks
    value = F.col("x.v").bitwiseXOR(F.col("mask"))
    return near.select(_slot(F.col("n"), F.col("x.b"), value).alias("slot"), "item", "item_print").distinct()


def _slot(n: Column, block: Column, value: Column) -> Column:
    return (n.cast("long") * BLOCKS + block) * (1 << BLOCK_BITS) + value


def find_leaks(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item_key: str, item_text: str, settings: LeakSettings | None = None) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of every pair that matches."""
    s = settings or LeakSettings()
    items, sizes = _items(benchmark, item_key, item_text, s)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = _with_hashes(rows.withColumn("row", F.xxhash64("doc_id", "text")), s.shingle)
    # only pairs of numbers leave the explosion: benchmark shingles are looked up on the spot
    # (their number is a column before that: else each of the rows would carry the array)
    each = rows.withColumn("all", F.size("hashes")).select("row", "all", F.posexplode_outer("hashes").alias("at", "h"))
    hits = each.join(_size_checked(sizes, s.sent_bytes), "h").select("row", "all", "at", "n", "w", "df")
    starts = materialize(_starts(materialize(hits, "leak-hits"), items, s), "leak-windows")
    found = _size_checked(starts.select("row").distinct(), s.sent_bytes)
    weights = _size_checked(sizes.select("h", "w").distinct(), s.sent_bytes)
    alone = items.select("item").distinct().agg(F.log1p(F.count("*").cast("double")).alias("alone"))
    near = rows.join(found, "row", "left_semi").select("doc_id", "row", F.posexplode_outer("hashes").alias("at", "h"))
    near = near.join(weights, "h", "left").crossJoin(F.broadcast(alone))
    near = near.select("doc_id", "row", F.struct("at", "h", F.coalesce("w", "alone").alias("w")).alias("x"))
    near = near.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("x")).alias("x"))
    windows = near.join(starts, "row").select("doc_id", "row", F.size("x").alias("all"), "at", "n", F.slice("x", F.col("at") + 1, F.col("n")).alias("s"))
    windows = materialize(windows.withColumn("print", fingerprint("s")), "leak-prints")
    slots = F.array(*(_slot(F.col("n"), F.lit(b), _block(F.col("print"), b)) for b in range(BLOCKS)))
    probes = windows.select("row", "at", "n", "print", F.explode(slots).alias("slot"))
    index = _size_checked(materialize(_index(items, s), "leak-index"), s.sent_bytes)
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= s.radius
    candidates = probes.join(index, "slot").filter(close).select("row", "at", "n", "item").distinct()
    return _verified(candidates, windows, items, s)


def _starts(hits: DataFrame, items: DataFrame, s: LeakSettings) -> DataFrame:
    """(row, n, at): where the windows for items with n shingles begin."""
    own = hits.filter(F.col("n") <= F.col("all"))
    # shingles of several items may weigh less than what a shift to the right takes in
    light = hits.filter("df > 1").select("row", "all", "at").distinct().join(own.select("row", "n").distinct(), "row")
    both = own.select("row", "all", "at", "n", F.col("at").alias("hit"))
    both = both.unionByName(light.withColumn("hit", F.lit(None).cast("int")))
    # the next hit, read backwards so that the frame only grows
    onwards = W.partitionBy("row", "n").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("next", F.last("hit", ignorenulls=True).over(onwards))
    both = both.filter(F.col("hit").isNotNull() | (F.col("next") - F.col("at") < F.col("n")))
    starts = both.select("row", "n", F.least(F.col("at"), F.col("all") - F.col("n")).alias("at"))
    if s.short_documents:
        whole = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"])
        least = _size_checked(items.groupBy("n").agg(F.min(whole).alias("least")), s.sent_bytes)
        short = hits.filter(F.col("n") > F.col("all")).groupBy("row", "n").agg(F.sum("w").alias("most")).join(least, "n")
        short = short.filter(F.col("most") >= (s.similarity - 1e-6) * F.col("least"))
        starts = starts.unionByName(short.select("row", "n", F.lit(0).alias("at")))
    return starts.distinct()


def _verified(candidates: DataFrame, windows: DataFrame, items: DataFrame, s: LeakSettings) -> DataFrame:
    pair = ["row", "at", "n", "item"]
    counted = candidates.join(windows.dropDuplicates(["row", "at", "n"]), ["row", "at", "n"]).select(*pair, F.explode("s").alias("x"))
    counted = counted.groupBy(*pair, F.col("x.h").alias("h"), F.col("x.w").alias("w")).agg(F.count("*").alias("c"))
    own = items.dropDuplicates(["item"]).select("item", F.explode("s").alias("y"))
    own = own.groupBy("item", F.col("y.h").alias("h")).agg(F.count("*").alias("d"))
    whole = items.dropDuplicates(["item"]).select("item", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]).alias("item_weight"))
    shared = counted.join(own, ["item", "h"], "left").groupBy(*pair).agg(
        F.sum(F.col("w") * F.col("c")).alias("weight"), F.sum(F.col("w") * F.least("c", F.coalesce("d", F.lit(0)))).alias("common")
    )
    similar = shared.join(whole, "item").withColumn(
        "similarity", F.col("common") / (F.col("weight") + F.col("item_weight") - F.col("common"))
    )
    similar = similar.filter(F.col("similarity") >= s.similarity - 1e-9)
    names = items.select("item", "item_id").distinct()
    ids = windows.select("row", "doc_id", "all").distinct()
    best = F.max_by(F.struct("similarity", "at", F.least("n", "all").alias("n")), F.struct("similarity", -F.col("at"))).alias("best")
    matched = similar.join(names, "item").join(ids, "row").groupBy("doc_id", "item_id").agg(best)
    return matched.select(
        "doc_id", "item_id", F.least(F.col("best.similarity"), F.lit(1.0)).alias("similarity"),
        F.col("best.at").cast("long").alias("first_word"), (F.col("best.n") + s.shingle - 1).cast("long").alias("n_words"),
    )
