"""Tables in and out: CSV with dates kept as text, row ids, Parquet anchors with a codec and level."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "__row_id"
CODECS = ("snappy", "gzip", "zstd", "brotli", "lz4", "none")


def working_folder(spark: SparkSession, name: str) -> str:
    """A new place for intermediate files, in the folder that the cluster shares (``spark.checkpoint.dir``).  Where that
    is unset, a local master takes a temporary folder, removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header.  Types are inferred, but for dates and times, which stay text; pass the schema to save
    the pass that infers it."""
    if schema is None:
        found = spark.read.csv(path, header=True, inferSchema=True).schema
        dates = (T.TimestampType, T.TimestampNTZType, T.DateType)
        schema = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, dates) else f.dataType) for f in found])
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Rows in the order of their row ids, without them.  ``single_file`` brings all rows to one writer: leave it on for
    tables that a person opens, turn it off for large ones."""
    out = df
    if ROW_ID in df.columns:
        out = df.orderBy(ROW_ID).drop(ROW_ID)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").csv(path, header=True)


def with_row_id(df: DataFrame) -> DataFrame:
    """Appends ``__row_id``, 0, 1, 2... in the order of the scan, keeping an existing one.

    Partition sizes are counted once, and only their running sum goes into the plan; no row is shuffled."""
    if ROW_ID in df.columns:
        return df
    tagged = df.withColumn("__mono", F.monotonically_increasing_id())
    part = F.shiftright("__mono", 33)
    sizes = tagged.groupBy(part.alias("part")).count().collect()
    offsets, total = {}, 0
    for part_id, n in sorted((r["part"], r["count"]) for r in sizes):
        offsets[part_id] = total
        total += n
    # one row of two numbers per partition of the scan
    starts = df.sparkSession.createDataFrame(list(offsets.items()), "__part long, __start long")
    numbered = tagged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.select(*df.columns, (F.col("__start") + F.col("__mono").bitwiseAND((1 << 33) - 1)).alias(ROW_ID))


def folder_size(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength())


def write_anchors(df: DataFrame, path: str, codec: str = "zstd", level: int | None = 19, files: int | None = None) -> int:
    """Writes Parquet, returns its bytes.  ``level`` counts for zstd and gzip; if it is refused, the default is taken."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}; there are {', '.join(CODECS)}")
    if codec == "brotli":
        raise ValueError("brotli needs a codec class that Spark doesn't ship; take zstd")
    out = df.coalesce(files) if files else df
    writer = out.write.mode("overwrite").option("compression", "uncompressed" if codec == "none" else codec)
    options = {"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level"}
    try:
        (writer.option(options[codec], level) if level is not None and codec in options else writer).parquet(path)
    except Exception as e:
        # a refused level names itself in the error; anything else, such as a full disk, is an error of the write
        if level is None or "level" not in str(e).lower():
            raise
        return write_anchors(df, path, codec, None, files)
    return folder_size(df.sparkSession, path)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def anchor_savings(df: DataFrame, anchors: list[str], original_bytes: int, path: str) -> dict[str, float]:
    """What storing the anchors alone takes, as CSV text and as snappy Parquet, against the whole table."""
    chosen = df.select(*anchors)
    text = chosen.agg(F.sum(F.octet_length(F.to_csv(F.struct(*anchors))) + 1)).first()[0] or 0
    header = len(",".join(anchors).encode()) + 1
    packed = write_anchors(chosen, path, "snappy")
    return {"original_bytes": original_bytes, "anchor_csv_bytes": text + header, "anchor_parquet_bytes": packed, "ratio": original_bytes / packed if packed else 0.0}
