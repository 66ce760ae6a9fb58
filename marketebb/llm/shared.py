"""Scratch tables of the operators in the folder that ``spark.checkpoint.dir`` names, and the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketebb.session import scratch_dir

__all__ = ["discard", "documents", "fresh", "scratch_dir", "small_batches", "stage", "table"]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: later steps neither repeat the work nor depend on lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Take away staged tables that nothing reads any more."""
    for df in staged:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes to differ from the columns of the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts are long: fewer rows in an Arrow batch keep the memory of tasks small. Smaller settings are left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
