"""Intermediate tables on storage that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_STORED = "cohortspark-"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the one the cluster names in ``spark.checkpoint.dir``.

    Without that setting it is below the session's warehouse, unless that is a local folder of one machine of a cluster.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")) and not context.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{_STORED}{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below a path, in order of name."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in files.listStatus(hadoop_path) if f.isDirectory())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it, on whatever file system it is."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet_checkpoint(
    df: DataFrame, path: str, partition_by: str | None = None, only_these_partitions: bool = False
) -> None:
    """Write all partitions in parallel, replacing what is there, or only the partitions that ``df`` has."""
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
        if only_these_partitions:
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def saved_rows(spark: SparkSession, path: str) -> int:
    """Number of rows of a saved table, from the footers of its files: no column is read.

    (Observing the write would spare this as well, but a session that has observed anything cannot send the predictions of
    Spark ML models to executors any more.)
    """
    return read_parquet(spark, path).count()


PUBLISHED = "_published"
_PUBLISHED_SCHEMA = "run STRING, at TIMESTAMP, tables ARRAY<STRING>, counts MAP<STRING, BIGINT>"


def published_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """(run, at, tables, counts) of all runs that were finished below ``path``; None when there is none."""
    try:
        return spark.read.schema(_PUBLISHED_SCHEMA).parquet(f"{path}/{PUBLISHED}")
    except AnalysisException:  # nothing has been published here
        return None


def published_run(spark: SparkSession, path: str, names: Iterable[str]) -> str | None:
    """The folder below ``path`` of the last run that was finished and holds all these tables."""
    runs = published_runs(spark, path)
    if runs is None:
        return None
    whole = runs.where(F.size(F.array_except(F.array(*map(F.lit, names)), "tables")) == 0)
    last = whole.orderBy(F.col("at").desc(), F.col("run").desc()).select("run").first()
    return last and last[0]


def published_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(table_name, n_rows)`` of the last finished run, as counted when its tables were written; reads none of them."""
    runs = published_runs(spark, path)
    if runs is None:
        return spark.createDataFrame([], "table_name STRING, n_rows BIGINT")
    last = runs.orderBy(F.col("at").desc(), F.col("run").desc()).limit(1)
    return last.select(F.explode("counts").alias("table_name", "n_rows"))


def remove_old_runs(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Remove the folders of all finished runs but the last ``keep``, and return their names.

    Their published rows stay, so readers have to ask for the last run, as :func:`published_run` does. Folders of runs
    that were not finished are left alone: one of them may still be written.
    """
    if keep < 1:
        raise ValueError("at least one run has to be kept")
    runs = published_runs(spark, path)
    if runs is None:
        return []
    ordered = [r.run for r in runs.orderBy(F.col("at").desc(), F.col("run").desc()).select("run").collect()]
    old = [run for run in ordered[keep:] if path_exists(spark, f"{path}/{run}")]
    for run in old:
        remove_folder(spark, f"{path}/{run}")
    return old


def checkpoint_or_reload(
    spark: SparkSession,
    path: str,
    build: Mapping[str, Callable[[dict[str, DataFrame]], DataFrame]],
    reload: bool = False,
    keep: int | None = None,
) -> dict[str, DataFrame]:
    """Tables saved below ``path``; they are built and saved first when asked to, or when any of them is missing.

    ``build`` gives for each table, in order, a function of the tables saved before it. Every run writes into a folder
    of its own and is published by one small row when its last table is written. So a run that was interrupted is
    never read, and tables of different runs are never mixed. Rows of each table are counted once it is written. Folders of earlier
    runs stay, unless ``keep`` says how many runs to keep: then older ones go after the new one is published.
    """
    run = None if reload else published_run(spark, path, build)
    saved: dict[str, DataFrame] = {}
    counts: list[Column] = []
    if run is not None:
        return {name: read_parquet(spark, f"{path}/{run}/{name}") for name in build}
    run = f"run-{uuid.uuid4().hex}"
    for name, step in build.items():
        write_parquet_checkpoint(step(saved), f"{path}/{run}/{name}")
        counts += [F.lit(name), F.lit(saved_rows(spark, f"{path}/{run}/{name}")).cast("bigint")]
        saved[name] = read_parquet(spark, f"{path}/{run}/{name}")
    row = spark.range(1).select(
        F.lit(run).alias("run"),
        F.current_timestamp().alias("at"),
        F.array(*map(F.lit, build)).alias("tables"),
        F.create_map(*counts).alias("counts"),
    )
    row.write.mode("append").parquet(f"{path}/{PUBLISHED}")
    if keep is not None:
        remove_old_runs(spark, path, keep)
    return saved


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to shared storage, so that lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    write_parquet_checkpoint(df, path)
    return read_parquet(df.sparkSession, path)


def release(*tables: DataFrame) -> None:
    """Remove stored tables that :func:`durable` has made and that nothing reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if not folder.rsplit("/", 1)[-1].startswith(_STORED):
                raise ValueError(f"{folder} was not made by durable()")
            remove_folder(table.sparkSession, folder)
