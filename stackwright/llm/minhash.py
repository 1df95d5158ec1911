"""MinHash near-dedup with b-bit signatures.

A document's set is that of its distinct shingles of `size` words (A-Z lower-cased); with fewer words
the whole sequence is one shingle. Each of 576 hash functions gives the set's minimum, of which 8 bits
are kept and packed. 72 bands of 8 lanes make candidates: a pair at the threshold of 0.8 shares no band
with a probability of 2e-6. Documents with the same set are one class from the start, so copies are
never paired.

Candidates are settled in rounds. First each member of a band's bucket is held against the bucket's
smallest member only: a group of n near copies has n pairs, not n squared. Links are joined to
components. In TURNS more rounds members outside a bucket's largest component are held against one
member of it. Then only buckets that still hold more than one component give pairs, across components
alone. In all rounds the similarity estimated from equal lanes, corrected for the 1 in 256 that are
equal by chance, must come within 0.07 (over four standard deviations) of the threshold; then the full
shingle sets are compared. So two classes that share a band are either compared or already connected.

A class is told by 128 bits of its set; in the few cases where two share the first 64, which name it in
joins, they are named anew. In the last round the members of a large bucket are dealt into blocks, and
each two blocks are one key of the join, so that a bucket is spread over many tasks.

Null texts, empty ones, texts without words and rows without doc_id are linked with nothing and kept.
Repeated rows are one class. Texts of any length are shingled whole. A group's smallest doc_id stands for
it; rows that share a doc_id but not the text are classes of their own. A table without rows gives none.
Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.llm.common import bytes_of, drop, groups_of, list_array, stage, tidy
from stackwright.llm.graphs import components
from stackwright.llm.hashing import mix
from stackwright.llm.substrings import Words

BANDS, ROWS = 72, 8
LANES = BANDS * ROWS
#: Bits kept of each minimum; bands that fit a 64-bit word, and words of a plane.
BITS, PER_WORD = 8, 64 // ROWS
WORDS = -(-BANDS // PER_WORD)
#: Links have 100 * intersection >= PERCENT * union; estimates may fall short by MARGIN.
PERCENT, MARGIN = 80, 0.07
GROUP_BYTES, SLAB = 500_000, 2048
#: Rounds of one comparison per bucket and member before all pairs across components.
TURNS = 2
#: Members of a block of a bucket in the last round.
BLOCK = 2_000
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000

#: Finer signatures, for the last round only: lanes, bits of each, and the shortfall allowed (over four
#: standard deviations).
FINE_LANES, FINE_BITS, FINE_MARGIN = 3072, 1, 0.045

_FACTORS = (np.random.default_rng(20_07).integers(0, 1 << 31, LANES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FINE_FACTORS = (np.random.default_rng(20_08).integers(0, 1 << 31, FINE_LANES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], size: int):
    """The distinct shingles of each text as sorted 64-bit hashes."""
    for a, b in groups_of([len(t) for t in texts], GROUP_BYTES):
        parts = [b" ".join(t.lower().split()) for t in texts[a:b]]
        h = Words(b"\n".join(parts)).hashes
        counts = np.fromiter((p.count(b" ") + 1 if p else 0 for p in parts), np.int64, len(parts))
        stops = np.cumsum(counts)
        g = h[: max(0, len(h) - size + 1)]
        for k in range(1, size):
            g = g * _STEP + h[k : len(h) - size + 1 + k]
        g = mix(g)
        for n, stop in zip(counts.tolist(), stops.tolist(), strict=True):
            if n >= size:
                yield np.unique(g[stop - n : stop - size + 1])
            elif n:
                whole = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in h[stop - n : stop]:
                        whole = whole * _STEP + x
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """The minimum of each of the hash functions."""
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    step = SLAB * LANES // len(factors)
    for i in range(0, len(x), step):
        np.minimum(low, (x[None, i : i + step] * factors[:, None]).min(axis=1), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """Signatures of many documents (n x LANES minima): BITS bits of each minimum, as BITS planes of
    WORDS 64-bit words in which each band's lanes stand side by side."""
    lanes = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    bits = np.unpackbits(lanes[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1)
    band, row = np.divmod(np.arange(LANES), ROWS)
    planes = np.zeros((len(low), BITS, WORDS * 64), np.uint8)
    planes[:, :, band // PER_WORD * 64 + band % PER_WORD * ROWS + row] = bits
    return np.packbits(planes, axis=2, bitorder="little").reshape(len(low), -1).view("<i8")


def packed_fine(low: np.ndarray) -> np.ndarray:
    """As packed, with FINE_BITS planes and lanes in their order."""
    lanes = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - FINE_BITS)).astype(np.uint8)
    bits = np.unpackbits(lanes[:, :, None], axis=2, count=FINE_BITS, bitorder="little").transpose(0, 2, 1)
    return np.packbits(np.ascontiguousarray(bits), axis=2, bitorder="little").reshape(len(low), -1).view("<i8")


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: sums of mixed members."""
    with np.errstate(over="ignore"):
        a, b = mix(shingles ^ np.uint64(0xA5A5)).sum(dtype=np.uint64), mix(shingles + np.uint64(0x5A5A)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, key, key2, sig). Narrow: texts go no further."""

    def work(batches):
        for batch in batches:
            n, keys, low = [], [], []
            for s in shingle_sets(bytes_of(batch), size):
                n.append(len(s))
                keys.append(set_keys(s))
                low.append(minima(s))
            sigs = np.concatenate([packed(np.array(low[i : i + 256])) for i in range(0, len(low), 256)] or [np.zeros((0, BITS * WORDS), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), list_array(sigs.ravel(), np.full(len(n), BITS * WORDS), pa.int64())],
                names=["doc_id", "n_shingles", "key", "key2", "sig"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(tidy(work), "doc_id long, n_shingles long, key long, key2 long, sig array<long>")


def band_keys(classes: DataFrame) -> DataFrame:
    """The columns of classes with one row per band, and the band's key."""

    lanes = ", ".join(f"shiftrightunsigned(sig[{plane * WORDS} + cast(i div {PER_WORD} as int)], i % {PER_WORD} * {ROWS}) & {(1 << ROWS) - 1}" for plane in range(BITS))
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, {lanes}))")
    return classes.withColumn("band", F.explode(keys))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: a lane is unequal if any plane's bits differ."""
    unequal = F.lit(0)
    for word in range(WORDS):
        differ = None
        for plane in range(BITS):
            x = a[plane * WORDS + word].bitwiseXOR(b[plane * WORDS + word])
            differ = x if differ is None else differ.bitwiseOR(x)
        unequal = unequal + F.bit_count(differ)
    equal = 1 - unequal / F.lit(float(LANES))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, fine: bool = False) -> DataFrame:
    """(key, shingles array<long>) of the wanted classes (key, half, key2, rep): read again from their texts.
    With fine, the finer signatures instead of the sets."""

    def work(batches):
        for batch in batches:
            keys, sets = [], []
            wants = zip(*(batch.column(c).to_pylist() for c in ("key", "half", "key2")), strict=True)
            for (key, *want), s in zip(wants, shingle_sets(bytes_of(batch), size), strict=True):
                if set_keys(s) == tuple(want):
                    keys.append(key)
                    sets.append(packed_fine(minima(s, _FINE_FACTORS)[None, :])[0] if fine else s.view(np.int64))
            lengths = np.array([len(s) for s in sets], np.int64)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), list_array(values, lengths, pa.int64())], names=["key", "shingles"])

    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"].alias("text")).join(ids, "rep").select("key", "half", "key2", "text")
    return rows.mapInArrow(tidy(work), "key long, shingles array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = stage(ends.join(classes.select("key", "half", "key2", "rep"), "key"), "wanted")
    # a text may stand in several rows with one doc_id; equal keys have equal sets
    sets = stage(sets_of(docs, wanted, size), "sets")
    if sets.count() > wanted.count():
        sets = sets.dropDuplicates(["key"])
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = both.where(shared * 100 >= PERCENT * (F.size("sa") + F.size("sb") - shared)).select("a", "b")
    out = stage(links, "links")
    drop(wanted, sets)
    return out


def near_components(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = stage(signatures(docs, size), "signatures")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = stage(rows.where(linkable).groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).withColumn("half", F.col("key")), "classes")
    rows, classes = told_apart(rows, classes)
    bands = band_keys(classes.select("key", "sig")).select("band", "key")
    centres = bands.groupBy("band").agg(F.min("key").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "centre")
    buckets = stage(bands.join(centres, "band"), "buckets")  # of two members and more
    stars = buckets.where("key != centre").select(F.col("key").alias("a"), F.col("centre").alias("b")).distinct()
    few = classes.select("key", "n", "sig")

    def plausible(pairs: DataFrame) -> DataFrame:
        left, right = (few.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"g{k}")) for k in "ab")
        both = pairs.join(left, "a").join(right, "b").where(sizes_allow(F.col("na"), F.col("nb")))
        return both.where(estimate(F.col("ga"), F.col("gb")) >= PERCENT / 100 - MARGIN).select("a", "b")

    tested = stage(plausible(stars), "stars")
    links = confirm(docs, tested, classes, size)
    first = components(links)
    # further rounds: buckets that still hold several components. Their members outside the bucket's
    # largest component are held against one member of it, another one each round
    for turn in range(TURNS):
        buckets = mixed_buckets(buckets, first, turn)
        sizes = buckets.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("order"), "key")).alias("pick"))
        chosen = sizes.groupBy("band").agg(F.max(F.struct("n", "component", F.col("pick.key").alias("centre"))).alias("c")).select("band", F.col("c.component").alias("largest"), F.col("c.centre").alias("centre"))
        held = buckets.join(chosen, "band").where("component != largest").select(F.greatest("key", "centre").alias("a"), F.least("key", "centre").alias("b")).distinct()
        fresh = stage(plausible(held.join(tested, ["a", "b"], "left_anti")), "held")
        tested = tested.unionByName(fresh)
        if not fresh.isEmpty():
            links = links.unionByName(confirm(docs, fresh, classes, size))
            first = components(links)
    # last round: all pairs across the components that remain in a bucket, each in its first common band
    buckets = mixed_buckets(buckets, first, TURNS)
    wanted = stage(buckets.select("key").distinct().join(classes.select("key", "half", "key2", "rep"), "key"), "members")
    fine = stage(sets_of(docs, wanted, size, fine=True), "fine").dropDuplicates(["key"]).withColumnRenamed("shingles", "fine")
    pairs = pairs_across(buckets.join(classes.select("key", "n"), "key"), fine)
    fresh = stage(pairs.join(tested, ["a", "b"], "left_anti"), "across")
    if not fresh.isEmpty():
        links = links.unionByName(confirm(docs, fresh, classes, size))
        first = components(links)
    found = classes.select("key", "rep").join(first, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    # written, so that adaptive execution can split a large component in the join
    least = stage(found.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    by_class = found.join(least, "component").select("key", "component_id")
    # last: one row per class against all rows, so that adaptive execution can split a hot class
    out = rows.select("doc_id", "n_shingles", F.when(linkable, F.col("key")).alias("key")).join(by_class, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def told_apart(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a key that one class alone has: where classes share a key, it is hashed with key2."""
    for turn in range(1, 9):
        shared = stage(classes.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", F.lit(True).alias("_shared")), "shared-keys")
        n = shared.count()
        if not n:
            drop(shared)
            return rows, classes

        def named(df: DataFrame) -> DataFrame:
            found = df.join(F.broadcast(shared) if n <= BROADCAST_IDS else shared, "key", "left")
            return found.withColumn("key", F.when(F.col("_shared"), F.xxhash64(F.lit(turn), "key", "key2")).otherwise(F.col("key"))).drop("_shared")

        rows, classes = stage(named(rows), "signatures"), stage(named(classes), "classes")
    raise ValueError("128-bit keys of different sets are equal")


def pairs_across(buckets: DataFrame, fine: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a > b, of a bucket's members (band, key, component, n) in different components whose sizes and
    finer signatures (key, fine) allow a link, once for each pair in its first common band."""
    mine = buckets.groupBy("key").agg(F.array_sort(F.collect_set("band")).alias("bands"))  # BANDS at most
    # words as plain columns: the join's condition stays small enough to be compiled
    words = {f"f{i}": F.coalesce(F.col("fine")[i], F.lit(0)) for i in range(FINE_LANES // 64)}
    many = buckets.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    members = buckets.join(many, "band").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")
    members = members.join(mine, "key").join(fine.withColumns(words).drop("fine"), "key")
    x, y = members.alias("x"), members.alias("y")
    # within a block by key, between two from the lower one to the higher
    once = F.when(F.col("x.lo") == F.col("x.hi"), F.col("x.key") < F.col("y.key")).otherwise((F.col("x.own") == F.col("x.lo")) & (F.col("y.own") == F.col("x.hi")))
    across = once & (F.col("x.component") != F.col("y.component")) & sizes_allow(F.col("x.n"), F.col("y.n"))
    unequal = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
    # one bit a lane: equal by chance in half of the cases
    close = unequal <= int(FINE_LANES * (1 - (PERCENT / 100 - FINE_MARGIN)) / 2)
    leads = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    pairs = x.join(y, same & F.when(~across, False).when(~close, False).otherwise(leads))
    return pairs.select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b"))


def mixed_buckets(buckets: DataFrame, first: DataFrame, turn: int) -> DataFrame:
    """(band, key, component) of the buckets that hold several components, staged."""
    names = buckets.select("band", "key").join(first, F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("component", "key").alias("component"))
    names = stage(names, f"components-{turn}")
    mixed = names.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("band")
    return stage(names.join(mixed, "band", "left_semi"), f"mixed-{turn}")


def sizes_allow(m: Column, n: Column) -> Column:
    """Sets whose sizes differ too much can't reach the threshold."""
    return F.least(m, n) * 100 >= F.greatest(m, n) * PERCENT
