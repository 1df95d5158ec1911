"""Benchmark decontamination, in DataFrame operations only.

Texts are lower-cased and read as words of letters and digits, so punctuation and spacing do not hide a
copy. A document is contaminated by an item if one of its windows of the item's number of words has a
weighted 5-word-shingle similarity of 0.8 or more with the item: shared shingles over all shingles,
each weighted by how often it occurs.

1. Which windows are fingerprinted: a window of a similar text consists of benchmark shingles, whichever
   item's, by 8/9 at least (by 0.8 of the item's if the document is shorter). One set of all items'
   shingles marks a document's places; for each length of item, windows with enough marks are taken.
   This drops no match, and says nothing of which item is meant.
2. Each of these item-sized windows gets a 64-bit SimHash of its weighted shingles: a shingle that
   occurs n times counts as n different ones, so that none outweighs the others. The items'
   fingerprints are indexed by RADIUS + 1 blocks of bits: two fingerprints within the radius agree in
   at least one block, so probing all blocks finds every one. Similar pairs differ in 9.7 of 64 bits on
   average (standard deviation 2.9); of pairs right at the threshold one or two in 100,000 differ in more
   than the radius of 23 and are lost, of more similar ones fewer.
3. Pairs of a window and an item within the radius are compared by their full shingles, exactly.

Items with fewer than five words are one shingle, their whole sequence, and match windows that are equal.
Items without words and null or empty texts match nothing. Rows without doc_id or item_id are not reported.
Repeated rows are one document or item; rows that share a doc_id but not the text all count for it.
Windows of documents shorter than the item are the whole document. Of windows that are alike the first is
reported. A document's words must fit a task. Tables without rows give none. Other columns are not looked
at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.llm.common import stage

SIZE, PERCENT, RADIUS = 5, 80, 23
#: Starts of windows that are fingerprinted together, and a one in each of four 16-bit lanes.
REGION, LANE = 256, sum(1 << 16 * j for j in range(4))
#: Most bytes of a table that is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(name: str, size: int = SIZE) -> Column:
    """Hashes of the runs of `size` words of the array column; of the whole array if it is shorter."""
    return F.expr(f"CASE WHEN size({name}) = 0 THEN cast(array() AS array<bigint>) WHEN size({name}) < {size} THEN array(xxhash64({name})) ELSE transform(sequence(1, size({name}) - {size - 1}), i -> xxhash64(slice({name}, i, {size}))) END")


def numbered(name: str) -> Column:
    """Shingles with their second and later occurrences hashed with their number, in any order."""
    later = "transform(s, (h, i) -> if(i + 1 = array_position(s, h), h, xxhash64(h, i + 1 - array_position(s, h))))"
    return F.expr(f"CASE WHEN size(array_distinct({name})) = size({name}) THEN {name} ELSE transform(array(array_sort({name})), s -> {later})[0] END")


def lane_sums(name: str) -> dict[str, Column]:
    """Sixteen sums over an array of shingles that count four bits each, in 16-bit lanes."""
    return {f"_sum{k}": F.expr(f"coalesce(aggregate({name}, 0L, (n, h) -> n + (shiftrightunsigned(h, {k}) & {LANE}L)), 0L)") for k in range(16)}


def running_sums(name: str) -> dict[str, Column]:
    """The same as arrays: the sums over the first 0, 1, 2, ... shingles."""
    return {f"_run{k}": F.expr(f"aggregate({name}, array(0L), (p, h) -> array_append(p, element_at(p, -1) + (shiftrightunsigned(h, {k}) & {LANE}L)))") for k in range(16)}


def simhash(sums: list[Column], n: Column) -> Column:
    """Bit b is set if more than half of the n shingles have it set."""
    bits = F.lit(0).cast("long")
    for k in range(16):
        for j in range(4):
            count = F.shiftrightunsigned(sums[k], 16 * j).bitwiseAND(F.lit(0xFFFF))
            bit = 1 << (16 * j + k)
            bits = bits.bitwiseOR(F.when(2 * count > n, F.lit(bit - (1 << 64) if bit >> 63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def with_simhash(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds the fingerprint of an array of shingles, numbered."""
    sums = lane_sums("_numbered")
    return df.withColumn("_numbered", numbered(name)).withColumns(sums).withColumn(out, simhash([F.col(c) for c in sums], F.size(name))).drop("_numbered", *sums)


def _block(fingerprint: Column, i: int) -> Column:
    a, b = 64 * i // (RADIUS + 1), 64 * (i + 1) // (RADIUS + 1)
    return F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def blocks(fingerprint: Column) -> Column:
    """The fingerprint's RADIUS + 1 blocks as (block number, bits)."""
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(fingerprint, i).alias("bits")) for i in range(RADIUS + 1)])


def first_equal_block(a: Column, b: Column) -> Column:
    return F.coalesce(*[F.when(_block(a, i) == _block(b, i), F.lit(i)) for i in range(RADIUS + 1)])


def shared_weight(a: str, b: str) -> Column:
    """Shingles in both arrays, each as often as in the array that has it less often."""
    plain = f"size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b})"
    counted = f"aggregate(array_distinct({a}), 0, (n, s) -> n + least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))"
    return F.expr(f"CASE WHEN {plain} THEN size(array_intersect({a}, {b})) ELSE {counted} END")


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def window_starts(hits: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """(doc_id, key, n_words, start): the windows that may be similar to an item of their length, from the
    sorted places of a document's hits (doc_id, key, n_doc, ats).

    Of two sets of n shingles, similar by p / 100, at least n * 2p / (100 + p) are shared, and p / 100 of n if
    one is smaller. So `need` hits in a row must lie in one window: two places of the list tell where."""
    every = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(-(-2 * PERCENT * (n - size + 1) // (100 + PERCENT))).alias("need"), F.lit(-(-PERCENT * (n - size + 1) // 100)).alias("least")) for n in sizes])
    rows = hits.withColumn("m", F.size("ats")).select("*", F.inline(F.filter(every, lambda s: F.when(F.col("n_doc") >= s["n"], s["need"]).otherwise(s["least"]) <= F.col("m"))))
    whole = rows.where("n_doc < n").select("doc_id", "key", "n", F.lit(0).alias("start"))
    pairs = F.arrays_zip(F.slice("ats", 1, F.col("m") - F.col("need") + 1).alias("lo"), F.slice("ats", F.col("need"), F.col("m") - F.col("need") + 1).alias("hi"))
    spans = rows.where("n_doc >= n").select("doc_id", "key", "n_doc", "n", F.inline(pairs)).where(F.col("hi") - F.col("lo") <= F.col("n") - size)
    first, last = F.greatest(F.col("hi") - (F.col("n") - size), F.lit(0)), F.least("lo", F.col("n_doc") - F.col("n"))
    spans = spans.select("doc_id", "key", "n", F.explode(F.sequence(first, last)).alias("start"))
    return whole.unionByName(spans).distinct().withColumnRenamed("n", "n_words")


def fingerprints(regions: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, block, n_words, start, print) of the windows of each region (doc_id, key, block, lo, sh,
    windows). Where no shingle of a region comes twice, running sums over it give all of them."""
    once = regions.where("size(array_distinct(sh)) = size(sh)")
    runs = running_sums("sh")
    rows = once.withColumns(runs).select("*", F.inline("windows"))
    a = F.col("start") - F.col("lo") + 1
    n = F.least(F.col("n_words") - (size - 1), F.size("sh"))
    plain = rows.select("doc_id", "key", "block", "n_words", "start", simhash([F.element_at(F.col(r), a + n) - F.element_at(F.col(r), a) for r in runs], n).alias("print"))
    rows = regions.where("size(array_distinct(sh)) < size(sh)").select("*", F.inline("windows")).select("doc_id", "key", "block", "n_words", "start", window_of(size).alias("window"))
    return plain.unionByName(with_simhash(rows, "window", "print").drop("window"))


def window_of(size: int) -> Column:
    return F.slice("sh", F.col("start") - F.col("lo") + 1, F.least(F.col("n_words") - (size - 1), F.size("sh")))


def similar_windows(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(doc_id, item_id, similarity, start_word) of all windows similar to items of shingles of `size` words."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    members = items.select(F.explode("item").alias("shingle")).distinct()
    shape = items.agg(F.collect_set("n_words").alias("sizes"), F.sum(F.size("item")).alias("n"), F.count(F.lit(1)).alias("items")).first()
    hits = rows.select("doc_id", "key", F.size("w").alias("n_doc"), F.posexplode(shingles("w", size)).alias("at", "shingle")).join(small(members, shape["n"] * 16), "shingle", "left_semi")
    hits = hits.groupBy("doc_id", "key", "n_doc").agg(F.array_sort(F.collect_set("at")).alias("ats"))  # at most n_doc
    hits = stage(hits.where(F.size("ats") * 100 >= PERCENT * (min(shape["sizes"]) - size + 1)), "hits")
    windows = stage(window_starts(hits, sorted(shape["sizes"]), size).withColumn("block", F.expr(f"start div {REGION}")), "windows")

    wanted = stage(windows.select("doc_id", "key").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").join(small(wanted, wanted.count() * 16), ["doc_id", "key"], "left_semi")
    grouped = windows.groupBy("doc_id", "key", "block").agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("n_words")).alias("hi"), F.collect_set(F.struct("n_words", "start")).alias("windows"))
    regions = texts.select("doc_id", "key", words(F.col("text")).alias("w")).join(grouped, ["doc_id", "key"])
    regions = regions.select("doc_id", "key", "block", "lo", "windows", F.expr("slice(w, lo + 1, hi - lo)").alias("w")).withColumn("sh", shingles("w", size)).drop("w")
    regions = stage(regions.dropDuplicates(["doc_id", "key", "block"]), "regions")

    index = items.select("item_id", "n_words", "item_print", F.inline(blocks(F.col("item_print"))))
    prints = fingerprints(regions, size)
    probes = prints.select("doc_id", "key", F.col("block").alias("region"), "n_words", "start", "print", F.inline(blocks(F.col("print"))))
    # within the radius; a pair that agrees in several blocks is spoken for by the first of them
    within = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    near = probes.join(small(index, shape["items"] * (RADIUS + 1) * 32), ["n_words", "block", "bits"])
    near = near.where(within & (F.col("block") == first_equal_block(F.col("print"), F.col("item_print")))).select("doc_id", "key", F.col("region").alias("block"), "n_words", "start", "item_id")
    near = near.join(regions.select("doc_id", "key", "block", "lo", "sh"), ["doc_id", "key", "block"]).select("doc_id", "item_id", "start", window_of(size).alias("window"))
    scored = near.join(small(items.select("item_id", "item"), shape["n"] * 8), "item_id").select("doc_id", "item_id", "start", shared_weight("item", "window").alias("shared"), F.size("item").alias("n"), F.size("window").alias("m"))
    scored = scored.where(F.col("shared") * 100 >= (F.col("n") + F.col("m") - F.col("shared")) * PERCENT)
    return scored.select("doc_id", "item_id", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("similarity"), F.col("start").alias("start_word"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): the best window of each contaminated document and item."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    items = items.select("item_id", F.size("w").alias("n_words"), shingles("w").alias("item")).distinct()
    items = stage(with_simhash(items, "item", "item_print"), "items")
    # items of fewer words than a shingle are one shingle of their own size, one pass for each such size
    short = F.least("n_words", F.lit(SIZE))
    found = None
    for size in sorted(r[0] for r in items.select(short).distinct().collect()):
        part = similar_windows(docs, items.where(short == size), size)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.select(F.lit(0).cast("long").alias("doc_id"), "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"))
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("start"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start_word"))
