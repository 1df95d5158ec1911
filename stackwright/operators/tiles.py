"""Sparse matrices in tiles: laid out once over the cluster, then multiplied from both sides without moving again.

Cells are gathered in tiles of SIDE x SIDE, and tiles are dealt to a grid of p x q parts by row and column block, so that neither
a full row nor a full column lies in one part. The tiles are written as a table with a bucket per part. In a product
every block of the vector is sent to the p (or q) parts that may need it, each part adds up its own blocks, and partial sums are
merged in a tree. Vectors are tables of blocks (block, arrays).
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators.blocks import flat, merge_blocks
from stackwright.staging import shared_folder

#: Rows and columns of a tile; cells that a part should have at most.
SIDE, CELLS = 512, 4_000_000


@dataclass
class Tiles:
    """A laid-out matrix: its tiles (part, rb, cb, r, c, v), the grid of parts and the side of a tile."""

    table: DataFrame
    p: int
    q: int
    side: int

    def times(self, vector: DataFrame, values: list[str]) -> DataFrame:
        """(block, values): the products of the matrix with vectors over its columns."""
        return self._product(vector, values, "rb", "cb", "r", "c")

    def transposed_times(self, vector: DataFrame, values: list[str]) -> DataFrame:
        """(block, values): the products of the transposed matrix with vectors over its rows."""
        return self._product(vector, values, "cb", "rb", "c", "r")

    def _product(self, vector: DataFrame, values: list[str], out: str, on: str, out_at: str, on_at: str) -> DataFrame:
        side, n = self.side, self.p * self.q
        # the parts in whose rows or columns of the grid a block is needed
        where = F.transform(F.sequence(F.lit(0), F.lit(self.p - 1)), lambda i: (i * self.q + F.col("block") % self.q).cast("int")) if on == "cb" else F.transform(F.sequence(F.lit(0), F.lit(self.q - 1)), lambda j: (F.col("block") % self.p * self.q + j).cast("int"))
        sent = vector.select(F.explode(where).alias("part"), F.col("block").cast("long").alias("block"), *values).repartition(n, "part")
        tiles = self.table.select("part", F.col(out).alias("to"), F.col(on).alias("from"), F.col(out_at).alias("to_at"), F.col(on_at).alias("from_at"), "v")

        def work(mine: pa.Table, blocks: pa.Table) -> pa.Table:
            found, sums = np.zeros(0, np.int64), np.zeros((len(values), 0, side))
            if len(mine) and len(blocks):
                mine, blocks = mine.combine_chunks(), blocks.combine_chunks()
                held, place = np.unique(blocks.column("block").to_numpy(), return_inverse=True)
                vectors = np.zeros((len(values), len(held), side))
                for full, v in zip(vectors, values, strict=True):
                    data, at = flat(_one(blocks.column(v)))
                    rows = np.repeat(np.arange(len(place)), np.diff(at))
                    full[place[rows], np.arange(len(rows)) - (at[:-1] - at[0])[rows]] = data[at[0] : at[-1]]
                (to_at, ends), (from_at, _), (v, _) = (flat(_one(mine.column(c))) for c in ("to_at", "from_at", "v"))
                to_at, from_at, v = (x[ends[0] : ends[-1]] for x in (to_at, from_at, v))
                # all cells of the part at once, for sparse tiles hold a few each; those that meet no block of the vector go
                source = np.minimum(np.searchsorted(held, mine.column("from").to_numpy()), len(held) - 1)
                known = held[source] == mine.column("from").to_numpy()
                found, target = np.unique(mine.column("to").to_numpy()[known], return_inverse=True)
                cells = np.diff(ends)
                used = np.repeat(known, cells)
                to = np.repeat(target, cells[known]) * side + to_at[used]
                at, v = np.repeat(source[known], cells[known]) * side + from_at[used], v[used]
                sums = np.array([np.bincount(to, v * full.ravel()[at], len(found) * side).reshape(-1, side) for full in vectors])
            part = mine.column("part")[0].as_py() if len(mine) else 0
            ends = pa.array(np.arange(len(found) + 1) * side, pa.int32())
            arrays = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in sums]
            return pa.table([pa.array(found, pa.int64()), pa.array(np.full(len(found), part), pa.int32()), *arrays], names=["block", "_task", *values])

        parts = tiles.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(work, ", ".join(["block long, _task int", *(f"{v} array<double>" for v in values)]))
        return merge_blocks(parts, [], values)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def tiled(matrix: DataFrame, row: str = "row", col: str = "col", val: str = "val", side: int = SIDE, cells: int = CELLS) -> Tiles:
    """Lay out a matrix of cells (row, col, val) with indices from 0; cells that come more than once are added first, so a tile is
    bounded by its side. The same cells laid out before, in any order, are found by their content and used again."""
    spark = matrix.sparkSession
    one = matrix.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(val).cast("double").alias("val")).groupBy("row", "col").agg(F.sum("val").alias("val"))
    n, mark, other = one.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("row", "col", F.round("val", 9))), F.bit_xor(F.xxhash64(F.round("val", 9), "col", "row"))).first()
    grid = max(1, math.ceil(math.sqrt(n / cells)))
    name = f"tiles_{n}_{(mark or 0) & (1 << 64) - 1:x}_{(other or 0) & (1 << 64) - 1:x}_{side}_{grid}"
    path = f"{shared_folder(spark)}/stackwright/{name}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        tiles = one.groupBy(F.floor(F.col("row") / side).alias("rb"), F.floor(F.col("col") / side).alias("cb")).agg(F.collect_list(F.struct((F.col("row") % side).cast("int").alias("r"), (F.col("col") % side).cast("int").alias("c"), "val")).alias("cells"))
        part = (F.col("rb") % grid * grid + F.col("cb") % grid).cast("int")
        rows = tiles.select(part.alias("part"), "rb", "cb", F.col("cells.r").alias("r"), F.col("cells.c").alias("c"), F.col("cells.val").alias("v"))
        # one file per bucket: a part's tiles are read by one task
        rows.repartition(grid * grid, "part").write.mode("overwrite").bucketBy(grid * grid, "part").option("path", path).saveAsTable(f"{name}_{uuid.uuid4().hex[:8]}")
    return Tiles(bucketed(spark, path, grid * grid), grid, grid, side)


def bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A table over files that were written in buckets: plans know where a part lies and don't shuffle it."""
    name = f"tiles_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (part INT, rb BIGINT, cb BIGINT, r ARRAY<INT>, c ARRAY<INT>, v ARRAY<DOUBLE>) USING parquet CLUSTERED BY (part) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def to_blocks(vector: DataFrame, at: str, values: list[str], side: int = SIDE) -> DataFrame:
    """(block, values) from (at, values): absent elements are 0."""
    rows = vector.groupBy(F.floor(F.col(at) / side).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col(at) % side).cast("int"), F.struct(*[F.col(v).cast("double").alias(v) for v in values])))).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(side - 1))
    return rows.select("block", *[F.transform(places, lambda i: F.coalesce(F.try_element_at(F.col("_m"), i)[v], F.lit(0.0))).alias(v) for v in values])


def from_blocks(blocks: DataFrame, values: list[str], side: int = SIDE) -> DataFrame:
    """(at, values)."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip(*values)).alias("_i", "_v"))
    return rows.select((F.col("block") * side + F.col("_i")).alias("at"), *[F.col(f"_v.{v}").alias(v) for v in values])
