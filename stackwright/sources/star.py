"""STAR files: blocks of whitespace-separated loops, read by Spark as text.

A file has blocks `data_name`, each with `loop_`, labels `_label #n` and rows. Blocks are joined on the
columns they all have; `#` begins a comment; an empty line ends a loop's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_blocks(lines: list[str]) -> list[tuple[list[str], list[list[str]]]]:
    """(labels, rows) of each loop."""
    blocks: list[tuple[list[str], list[list[str]]]] = []
    labels: list[str] = []
    rows: list[list[str]] = []
    in_loop = False
    for line in [*lines, "data_"]:
        text = line.split("#", 1)[0].strip() if not line.lstrip().startswith("_") else line.strip()
        if text.startswith("data_") or text == "loop_" or not text and rows:
            if labels and rows:
                blocks.append((labels, rows))
            if text != "" or rows:
                labels, rows = [], []
            in_loop = text == "loop_"
        elif text.startswith("_") and in_loop and not rows:
            labels.append(text[1:].split()[0])
        elif text and labels:
            rows.append(text.split())
    return blocks


def read_star(spark: SparkSession, path: str) -> DataFrame:
    """All blocks of all files on their common columns, with the file's name; numbers where a whole column
    is numeric. Files are metadata of some megabytes each; each is parsed by one task."""
    import pyarrow as pa

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    labels = files.mapInArrow(_labels, "label array<string>").distinct().collect()
    names = [n for n in (labels[0]["label"] if labels else []) if all(n in r["label"] for r in labels)]

    def work(batches):
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                for block, (found, rows) in enumerate(parse_blocks(text.splitlines())):
                    at = [found.index(n) for n in names]
                    cells = [pa.array([r[i] for r in rows], pa.string()) for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([block] * len(rows), pa.int32()), *cells], names=["file", "block", *names])

    out = files.mapInArrow(work, ", ".join(["file string", "block int", *[f"`{n}` string" for n in names]]))
    if not names:
        return out
    numeric = out.agg(*[F.every(F.col(f"`{n}`").try_cast("double").isNotNull()).alias(n) for n in names]).first()
    return out.select("file", "block", *[F.col(f"`{n}`").try_cast("double").alias(n) if numeric[n] else F.col(f"`{n}`") for n in names])


def _labels(batches):
    import pyarrow as pa

    for batch in batches:
        found = [labels for text in batch.column("value").to_pylist() for labels, _ in parse_blocks(text.splitlines())]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["label"])


def write_star(df: DataFrame, path: str, block: str = "images", order: str | None = None, files: int = 1) -> None:
    """A folder of files with one loop each, which read_star reads together; numbers as %20.6f. With an order the rows are
    ranged over the files and sorted in each. Every task writes its file's labels and rows, through Spark's writer."""
    import pyarrow as pa

    kinds = dict(df.dtypes)
    cells = [F.format_string("%20.6f", F.col(c)) if kinds[c] in ("double", "float") else F.format_string("%20s", F.col(c).cast("string")) for c in df.columns]
    header = ["", f"data_{block}", "", "loop_", *[f"_{c} #{i + 1}" for i, c in enumerate(df.columns)]]
    placed = df.repartitionByRange(files, order).sortWithinPartitions(order) if order else df.repartition(files)

    def headed(batches):
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(header, batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    placed.select(F.concat_ws(" ", *cells).alias("value")).mapInArrow(headed, "value string").write.mode("overwrite").text(path)
