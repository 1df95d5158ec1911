"""Image stacks and volumes in MRC files: a Spark data source that reads and writes them.

Layout (fixed values of the format): 1024 bytes of header, 256 little-endian words: 0-2 nx ny nz, 3 mode
(1 int16, 2 float32), 7-9 mx my mz, 10-12 cell lengths, 13-15 angles, 16-18 axis order, 19-21 min max
mean, 52 'MAP ', 53 machine stamp; then the data, x fastest.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from stackwright.operators.fourier import resize

HEADER_BYTES = 1024
MODES = {1: np.dtype("<i2"), 2: np.dtype("<f4")}
IMAGES_PER_PARTITION, IMAGES_PER_BATCH = 1000, 64


def parse_header(data: bytes) -> dict:
    """nx, ny, nz, mode, lengths and the pixel size they give."""
    nx, ny, nz, mode = struct.unpack("<4i", data[:16])
    lengths = struct.unpack("<3f", data[40:52])
    if mode not in MODES:
        raise ValueError(f"mode {mode} is not supported")
    return {"nx": nx, "ny": ny, "nz": nz, "mode": mode, "lengths": lengths, "pixel_size": lengths[0] / nx if nx else 0.0}


def build_header(shape: tuple[int, int, int], pixel_size: float, low: float, high: float, mean: float) -> bytes:
    nx, ny, nz = shape
    head = bytearray(HEADER_BYTES)
    struct.pack_into("<4i", head, 0, nx, ny, nz, 2)
    struct.pack_into("<3i3f3f3i3f", head, 28, nx, ny, nz, nx * pixel_size, ny * pixel_size, nz * pixel_size, 90.0, 90.0, 90.0, 1, 2, 3, low, high, mean)
    head[208:212] = b"MAP "
    head[212:216] = bytes([68, 65, 0, 0])
    return bytes(head)


def encode(images: np.ndarray, pixel_size: float = 1.0) -> bytes:
    """A file of images (n, ny, nx), mode 2."""
    a = np.ascontiguousarray(images, "<f4")
    stats = (float(a.min()), float(a.max()), float(a.mean())) if a.size else (0.0, 0.0, 0.0)
    return build_header((a.shape[2], a.shape[1], a.shape[0]), pixel_size, *stats) + a.tobytes()


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, per: int):
        self.path, self.per = path.removeprefix("file://"), per
        with open(self.path, "rb") as f:
            self.head = parse_header(f.read(HEADER_BYTES))
        self.low, self.high = 0, self.head["nz"]

    def pushFilters(self, filters):
        """Bounds on image_id narrow the range of bytes that is read."""
        for f in filters:
            if getattr(f, "attribute", None) == ("image_id",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, f.value + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self):
        return [_Range(i, min(i + self.per, self.high)) for i in range(self.low, self.high, self.per)] or [_Range(0, 0)]

    def read(self, part):
        """Arrow batches of images."""
        import pyarrow as pa

        kind = MODES[self.head["mode"]]
        size = self.head["nx"] * self.head["ny"]
        with open(self.path, "rb") as f:
            f.seek(HEADER_BYTES + part.start * size * kind.itemsize)
            for i in range(part.start, part.stop, IMAGES_PER_BATCH):
                k = min(IMAGES_PER_BATCH, part.stop - i)
                values = np.frombuffer(f.read(k * size * kind.itemsize), kind).astype(np.float32)
                px = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * size), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + k)), px], names=["image_id", "px"])


@dataclass
class _Written(WriterCommitMessage):
    """What a task has written: images, the largest id, and sums of the values for the header."""

    images: int
    last: int
    pixels: int
    low: float
    high: float
    total: float


class _Writer(DataSourceArrowWriter):
    """Every task writes its images at their places in one file beside the target, so tasks need no order and a task that
    is repeated writes the same bytes. The driver adds up what the tasks say, writes the header and names the file; if a task
    fails, an id is missing or comes twice, nothing stays."""

    def __init__(self, path: str, pixel_size: float, overwrite: bool):
        self.path, self.pixel_size, self.overwrite = path.removeprefix("file://"), pixel_size, overwrite
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        with open(self.part, "wb"):
            pass

    def write(self, iterator):
        done = _Written(0, -1, 0, math.inf, -math.inf, 0.0)
        with open(self.part, "r+b") as f:
            for batch in iterator:
                lists = batch.column("px")
                ends = lists.offsets.to_numpy()
                values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                sizes = np.diff(ends)
                if len(sizes):
                    size = done.pixels or int(sizes[0])
                    if lists.null_count or (sizes != size).any() or math.isqrt(size) ** 2 != size:
                        raise ValueError("images must be square, of one size and not null")
                    done.pixels = size
                    for i, k in enumerate(batch.column("image_id").to_pylist()):
                        f.seek(HEADER_BYTES + k * size * 4)
                        f.write(values[i * size : (i + 1) * size].tobytes())
                        done.last = max(done.last, k)
                    done.images += len(sizes)
                    done.low, done.high = min(done.low, float(values.min())), max(done.high, float(values.max()))
                    done.total += float(values.sum(dtype=np.float64))
        return done

    def commit(self, messages):
        done = [m for m in messages if m is not None and m.images]
        images, sizes = sum(m.images for m in done), {m.pixels for m in done}
        if len(sizes) > 1 or images != max((m.last for m in done), default=-1) + 1:
            self._remove()
            raise ValueError("images must be of one size and their ids 0, 1, 2, ... each once")
        n = math.isqrt(sizes.pop()) if sizes else 0
        low, high = min((m.low for m in done), default=0.0), max((m.high for m in done), default=0.0)
        with open(self.part, "r+b") as f:
            f.write(build_header((n, n, images), self.pixel_size, low, high, sum(m.total for m in done) / max(1, images * n * n)))
        if os.path.exists(self.path) and not self.overwrite:
            self._remove()
            raise FileExistsError(self.path)
        os.replace(self.part, self.path)

    def abort(self, messages):
        self._remove()

    def _remove(self):
        if os.path.exists(self.part):
            os.remove(self.part)


class MrcDataSource(DataSource):
    """spark.read.format("mrc").load(path): (image_id, px), and df.write.format("mrc").save(path) of such rows: float values,
    ids from 0 without gaps; option pixelSize. The path must be open to all executors as a file; files in other stores are
    read with read_binary."""

    @classmethod
    def name(cls):
        return "mrc"

    def schema(self):
        return "image_id bigint, px array<float>"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("imagesPerPartition", IMAGES_PER_PARTITION)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], float(self.options.get("pixelSize", 1.0)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MrcDataSource)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, image_id, px) of whole files from any store that Spark reads."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                head = parse_header(data)
                kind, size = MODES[head["mode"]], head["nx"] * head["ny"]
                values = np.frombuffer(data, kind, size * head["nz"], HEADER_BYTES).astype(np.float32).reshape(head["nz"], size)
                for i in range(0, head["nz"], 256):
                    some = values[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(i, i + len(some)), pa.int64()), pa.array(list(some), pa.list_(pa.float32()))], names=["path", "image_id", "px"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, image_id long, px array<float>")


def read_stack(spark: SparkSession, path: str, scale: float = 1.0, pixel_size: float | None = None) -> tuple[DataFrame, dict]:
    """A stack of square images, (image_id, px), resized by the scale, and what it is: images, pixels (of a
    side) and pixel_size, which the header gives unless it is named."""
    with open(path.removeprefix("file://"), "rb") as f:
        head = parse_header(f.read(HEADER_BYTES))
    if head["nx"] != head["ny"] or (pixel_size is None and head["lengths"][0] != head["lengths"][1]):
        raise ValueError(f"{path}: images are not square")
    register(spark)
    images, n = spark.read.format("mrc").load(path), head["nx"]
    size = head["pixel_size"] if pixel_size is None else pixel_size
    target = int(math.floor(scale * n + 0.5))
    if target != n:
        wide = images.select("image_id", F.col("px").cast("array<double>").alias("px"))
        images = resize(wide, "image_id", "px", n, target, 2).withColumnRenamed("v", "px")
    return images, {"images": head["nz"], "pixels": target, "pixel_size": size * n / target}


def image(stack: DataFrame, image_id: int) -> DataFrame:
    """One image of a stack: the filter reaches the source, which reads its bytes alone."""
    return stack.where(F.col("image_id") == image_id)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, nx, ny, nz, mode) without the data, in column expressions. Files are read whole for that: for files that are open
    by path, spark.read.format("mrc") reads the header alone."""
    files = spark.read.format("binaryFile").load(path)
    little = [F.conv(F.concat(*[F.hex(F.substring("content", 4 * i + 4 - k, 1)) for k in range(4)]), 16, 10).cast("int").alias(n) for i, n in enumerate(["nx", "ny", "nz", "mode"])]
    return files.select("path", *little)


def write_stack(images: DataFrame, path: str, pixel_size: float = 1.0) -> None:
    """Write images (image_id, px) to one file, by all tasks at once; an older file is replaced when all is written."""
    register(images.sparkSession)
    images.select(F.col("image_id").cast("long").alias("image_id"), F.col("px").cast("array<float>").alias("px")).write.format("mrc").option("pixelSize", pixel_size).mode("overwrite").save(path)


def write(images: np.ndarray, path: str, pixel_size: float = 1.0) -> None:
    """Write one file from the driver: a volume or a small stack."""
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(encode(images, pixel_size))
