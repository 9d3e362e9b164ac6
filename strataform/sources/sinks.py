"""Writers: atomic, resumable, frozen, appending, cached, and small reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.contracts import ContractError
from strataform.operators.relational import frames_equal


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Replace a Parquet table: it is written beside the old one and takes its name when all of it is there.

    Until then, and if the job dies, readers have the old table; df may read it too. Where the file system can't rename,
    the new table stays beside the old one and an error is raised.
    """
    spark = df.sparkSession
    beside, old = f"{path}.writing-{uuid4().hex}", f"{path}.old-{uuid4().hex}"
    df.write.mode("errorifexists").parquet(beside)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(make(path))
    if had and not fs.rename(make(path), make(old)):
        raise OSError(f"{path} can't be replaced; the new table is {beside}")
    if not fs.rename(make(beside), make(path)):
        if had:
            fs.rename(make(old), make(path))
        raise OSError(f"{path} can't be replaced; the new table is {beside}")
    if had:
        fs.delete(make(old), True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def write_frozen(df: DataFrame, path: str) -> DataFrame:
    """Write once; if the table exists it must have the same rows, and nothing is written."""
    spark = df.sparkSession
    if exists(spark, path):
        if not frames_equal(spark.read.parquet(path), df):
            raise ContractError(f"{path} is frozen and has other rows")
    else:
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def pending(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in the table yet."""
    spark = df.sparkSession
    return df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if exists(spark, path) else df


def resume(df: DataFrame, path: str, keys: list[str], compute: Callable[[DataFrame], DataFrame], partition: str | None = None) -> DataFrame:
    """Compute only what is missing in a table and append it; run again after a loss, it goes on where it was."""
    out = compute(pending(df, path, keys)).write.mode("append")
    (out.partitionBy(partition) if partition else out).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_json(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows as JSON lines, without those whose keys are there already."""
    spark = df.sparkSession
    todo = df.join(spark.read.schema(df.schema).json(path).select(*keys).distinct(), keys, "left_anti") if exists(spark, path) else df
    todo.write.mode("append").json(path)
    return spark.read.schema(df.schema).json(path)


def write_report(df: DataFrame, path: str, form: str = "csv", most: int = 10_000) -> str:
    """A small table as one local csv, md or json file; raises over most rows."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ContractError(f"a report has at most {most} rows")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.part"
    with open(temporary, "w", encoding="utf-8") as f:
        if form == "csv":
            rows.to_csv(f, index=False)
        elif form == "json":
            json.dump(json.loads(rows.to_json(orient="records")), f, indent=1)
        else:
            f.write("| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n")
            f.writelines("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows.itertuples(index=False))
    os.replace(temporary, path)
    return path


def verified_archive(df: DataFrame, columns: list[str], rows: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row a check: the row count, and every column finite and in range."""
    found = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.col(c) < low) | (F.col(c) > high)).alias(c) for c in columns])
    checks = F.array(F.struct(F.lit("rows").alias("check"), (F.col("n") == rows).alias("passed")), *[F.struct(F.lit(c).alias("check"), (F.col(c) == 0).alias("passed")) for c in columns])
    return found.select(F.explode(checks).alias("c")).select("c.*")
