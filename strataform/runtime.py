"""Session, table reading, lineage cuts and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is below this many bytes.
BROADCAST_LIMIT = 32 << 20


def local_session(app: str = "strataform", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is written for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; a local one only on a local master (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strataform-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and go on from the files, so lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run in the checkpoint folder, for tables that tasks read by themselves."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def file_system(name: str) -> tuple[fs.FileSystem, str]:
    """The file system of a name in the shared folder and its path there (for tasks)."""
    return (fs.LocalFileSystem(), "/" + name[5:].lstrip("/")) if name.startswith("file:") else fs.FileSystem.from_uri(name)


def read_parts(folder: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches of a Parquet table of the shared folder, part by part in the order of their names (for tasks)."""
    files, path = file_system(folder)
    for info in sorted(files.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                yield from parquet.ParquetFile(f).iter_batches(columns=columns)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Like cut, but in compressed columns: for wide tables, whose checkpoints take more disk."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered_rows(df: DataFrame, into: str) -> DataFrame:
    """df, cut, with a number from 0 without gaps for every row; only a count a partition passes through the driver."""
    low = (1 << 33) - 1
    rows = cut(df.withColumn(into, F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright(into, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    ends, total = {}, 0
    for part, n in counts:
        ends[part] = total
        total += n
    if not ends:
        return rows
    starts = F.broadcast(df.sparkSession.createDataFrame(list(ends.items()), "_part bigint, _start bigint"))
    return rows.join(starts, F.shiftright(into, 33) == F.col("_part")).select(*df.columns, (F.col("_start") + F.col(into).bitwiseAND(low)).alias(into))


def row_bytes(df: DataFrame) -> int:
    """A generous width of one row, from its types; strings and arrays count as 64 and 512 bytes."""
    sizes = {"bigint": 8, "int": 4, "double": 8, "float": 4, "boolean": 1, "timestamp": 8, "smallint": 2}
    return sum(sizes.get(kind, 64 if kind == "string" else 512) for _, kind in df.dtypes) + 16


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only if rows x row width is within limit; otherwise df is left to a shuffled join.

    df should be cheap to count (a cut table); pass rows if they are known.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes(df) <= limit else df


def cores(spark: SparkSession) -> int:
    """Cores of the whole cluster, as Spark reports them."""
    return max(1, spark.sparkContext.defaultParallelism)


def is_local_path(path: str) -> bool:
    """Whether a path has no URI scheme or is a file URI."""
    return path.startswith("file:") or "://" not in path or os.path.isabs(path)
