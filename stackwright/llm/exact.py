"""Exact dedup against a minimal perfect hash over historical distinct digests.

A text's digest is the SHA-256 of its UTF-8 bytes with A-Z lower-cased. The history's distinct digests
are dealt into buckets by digest, and each bucket gets a minimal perfect hash: a pilot number for each
small group of digests sends its members to slots of their own, with no slot left over. A slot holds
the full digest, the locator of the winner (its doc_id) and the number of rows. Rows of a delivery are
first summed up by digest, so copies cost one lookup however many there are; a lookup compares all 32
bytes of the slot. Members join the history's group, nonmembers are grouped among themselves.

Null texts count as empty. Of equal texts the row with the largest doc_id stays, null ids last. Rows
that repeat both doc_id and text all count in the group's size; they are one document and share its
fate. Texts of any length are hashed whole. A table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.llm.common import bytes_of, stage

#: Digests that share a pilot, on average; digests of a bucket, on average; slots' bytes: digest, locator, rows.
GROUP, BUCKET = 4, 50_000
SLOT = np.dtype([("digest", "V32"), ("winner", "<i8"), ("null", "<u1"), ("rows", "<i8")])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest binary). Narrow: no shuffle, and texts go no further."""

    def work(batches):
        for batch in batches:
            found = [hashlib.sha256(x.lower()).digest() for x in bytes_of(batch)]  # bytes.lower is for A-Z only
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "digest"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(work, "doc_id long, digest binary")


def group_rows(rows: DataFrame) -> DataFrame:
    """(digest, winner, rows): partial sums before the shuffle, so no copy count is too large."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("rows"))


def _mixed(a: np.ndarray, b: np.ndarray | int, salt: np.ndarray | int) -> np.ndarray:
    x = a ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(salt, np.uint64) + np.uint64(1)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ np.asarray(b, np.uint64) ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _halves(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = data.view("<u8").reshape(-1, 4)
    return words[:, 0] ^ words[:, 2], words[:, 1] ^ words[:, 3]


def build_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots for distinct digests (n x 32 bytes), and each digest's slot: a bijection onto 0..n-1."""
    n = len(data)
    a, b = _halves(data)
    n_groups = max(1, -(-n // GROUP))
    group = (_mixed(a, b, 0) % np.uint64(n_groups)).astype(np.int64)
    pilots, slots, taken = np.zeros(n_groups, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=n_groups)
    begins = np.cumsum(sizes) - sizes
    free: np.ndarray | None = None
    for g in np.argsort(-sizes, kind="stable"):
        k = sizes[g]
        if not k:
            break
        rows = order[begins[g] : begins[g] + k]
        x, y, tried = a[rows], b[rows], 1
        if k == 1:  # the last ones take what is left: the pilot is the slot itself
            if free is None:
                free = np.flatnonzero(~taken)[::-1].tolist()
            slots[rows[0]] = slot = free.pop()
            pilots[g] = np.uint32(1 << 31 | slot)
            continue
        while True:
            salts = np.arange(tried, tried + 64, dtype=np.uint64)
            places = (_mixed(x[None, :], y[None, :], salts[:, None]) % np.uint64(n)).astype(np.int64)
            ok = ~taken[places].any(axis=1)
            if k > 1:
                ordered = np.sort(places, axis=1)
                ok &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if ok.any():
                hit = int(ok.argmax())
                pilots[g], slots[rows] = tried + hit, places[hit]
                taken[places[hit]] = True
                break
            tried += 64
    return pilots, slots


def slots_of(pilots: np.ndarray, n: int, data: np.ndarray) -> np.ndarray:
    """The slot each digest would have; only a comparison tells whether it is a member."""
    a, b = _halves(data)
    pilot = pilots[(_mixed(a, b, 0) % np.uint64(len(pilots))).astype(np.int64)]
    direct = pilot >> np.uint32(31) > 0
    return np.where(direct, (pilot & np.uint32(0x7FFFFFFF)).astype(np.int64), (_mixed(a, b, pilot.astype(np.uint64)) % np.uint64(n)).astype(np.int64)) % n


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def bucket_of(digest: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(n_buckets))


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """One row per bucket: (bucket, n, pilots binary, slots binary), from (digest, winner, rows)."""

    def work(table: pa.Table) -> pa.Table:
        data = _matrix(table.column("digest"))
        pilots, slots = build_hash(data)
        out = np.zeros(len(data), SLOT)
        out["digest"][slots] = data.view("V32").ravel()
        winners = table.column("winner")
        out["null"][slots] = winners.is_null().to_numpy()
        out["winner"][slots] = winners.fill_null(0).to_numpy()
        out["rows"][slots] = table.column("rows").to_numpy()
        return pa.table({"bucket": [table.column("bucket")[0].as_py()], "n": pa.array([len(data)], pa.int64()), "pilots": pa.array([pilots.tobytes()], pa.binary()), "slots": pa.array([out.tobytes()], pa.binary())})

    rows = history.withColumn("bucket", bucket_of(F.col("digest"), n_buckets))
    return rows.groupBy("bucket").applyInArrow(work, "bucket long, n long, pilots binary, slots binary")


def look_up(groups: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """All groups of history and delivery together: (digest, winner, rows, is_member). A delivery's
    group whose digest the index holds is one with the history's; others stand alone."""

    def work(key, new: pa.Table, old: pa.Table) -> pa.Table:
        slots = np.frombuffer(old.column("slots")[0].as_py(), SLOT).copy() if old.num_rows else np.zeros(0, SLOT)
        data, winners, rows = _matrix(new.column("digest")), new.column("winner"), new.column("rows").to_numpy()
        null, winner = winners.is_null().to_numpy(), winners.fill_null(0).to_numpy()
        member = np.zeros(len(data), bool)
        if len(slots) and len(data):
            at = slots_of(np.frombuffer(old.column("pilots")[0].as_py(), np.uint32), len(slots), data)
            held = np.frombuffer(slots["digest"].tobytes(), np.uint8).reshape(-1, 32)
            member = (held[at] == data).all(axis=1)
            at = at[member]
            better = ~null[member] & ((slots["null"][at] > 0) | (winner[member] > slots["winner"][at]))
            slots["winner"][at[better]], slots["null"][at[better]] = winner[member][better], 0
            slots["rows"][at] += rows[member]
            met = np.zeros(len(slots), bool)
            met[at] = True
        else:
            met = np.zeros(len(slots), bool)
        digest = [x.tobytes() for x in np.frombuffer(slots["digest"].tobytes(), np.uint8).reshape(-1, 32)] + [x.tobytes() for x in data[~member]]
        return pa.table({
            "digest": pa.array(digest, pa.binary()),
            "winner": pa.array(np.concatenate([slots["winner"], winner[~member]]).astype(np.int64), mask=np.concatenate([slots["null"] > 0, null[~member]])),
            "rows": pa.array(np.concatenate([slots["rows"], rows[~member]]).astype(np.int64)),
            "is_member": pa.array(np.concatenate([met, np.zeros(int((~member).sum()), bool)])),
        })

    left = groups.withColumn("bucket", bucket_of(F.col("digest"), n_buckets)).groupBy("bucket")
    return left.cogroup(index.groupBy("bucket")).applyInArrow(work, "digest binary, winner long, rows long, is_member boolean")


def dedup(docs: DataFrame) -> DataFrame:
    """Each row's (doc_id, keep_id, group_size, kept, digest, is_member); the rows up to the middle doc_id
    (an approximate median, so that outlying ids don't matter) are the history, the later ones the delivery
    that is looked up in it. The result is the same wherever the history ends."""
    rows = stage(digests(docs), "digests")
    ends = rows.agg(F.percentile_approx("doc_id", 0.5, 100).alias("middle"), F.count(F.lit(1)).alias("n")).first()
    middle = ends["middle"] if ends["middle"] is not None else 0
    n_buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ends["n"] // BUCKET))
    old = F.col("doc_id") <= middle
    index = stage(build_index(group_rows(rows.where(old)), n_buckets), "digest-index")
    groups = look_up(group_rows(rows.where(F.coalesce(~old, F.lit(True)))), index, n_buckets)
    # equi-join on the digest with one row per group: a hot digest's rows can be split by adaptive execution
    found = rows.join(groups, "digest")
    return found.select(
        "doc_id", F.col("winner").alias("keep_id"), F.col("rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), "digest", "is_member",
    )
