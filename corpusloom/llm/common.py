"""Session settings, shared storage and table access used by every operator of this subpackage."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; with whole texts this keeps a Python worker's batch at a few MB.
ARROW_ROWS = 256
#: A key is hot that has more rows than this and than an eighth of what a partition gets on average.
HOT_ROWS = 512
#: Rows of a table of ids that may be sent to every executor (about 32 MB).
BROADCAST_IDS = 2_000_000


def ensure_session(spark: SparkSession) -> SparkSession:
    """Give Arrow batches a size fit for whole texts, and a checkpoint folder where none is named (tests)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset. On a cluster, whose
    executors share no local folder, an unset one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, level: int = 3) -> DataFrame:
    """Write df to the shared folder and read it back: the plan restarts from files that outlive executors."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_ids(ids: DataFrame, label: str) -> DataFrame:
    """A table of ids, written; it is broadcast if it holds BROADCAST_IDS rows at most, by its count."""
    table = materialize(ids, label)
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage through Spark's own file system layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Remove the files of tables of `materialize` that nothing will read again (as the rounds of a loop)."""
    for df in tables:
        for folder in {os.path.dirname(x) for x in df.inputFiles()}:
            drop_path(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """docs with every column but `own` under a number, so that no name of an operator meets one of theirs, and the
    names: `back` gives the columns their own again."""
    names = [c if c in own else f"_c{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def back(rows: DataFrame, names: list[str], docs: DataFrame) -> DataFrame:
    """The columns of docs, which `aside` numbered, out of rows."""
    return rows.select(*names).toDF(*docs.columns)


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the id as text: pandas turns whole numbers beside nulls into floats."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def id_back(rows: DataFrame) -> DataFrame:
    """rows with the id of text_rows as a number again."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def hot_keys(rows: DataFrame, key: str, total: int) -> list[tuple[object, int]]:
    """(key, number of parts) of the hot keys of rows, a written table of `total` rows: at most eight a partition,
    since each holds more than an eighth of a partition's rows. Null keys are not asked for."""
    limit = max(HOT_ROWS, total // (8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return [(r[0], r[1]) for r in counts.select(key, F.ceil(F.col("n") / limit).cast("int")).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, hot: list[tuple[object, int]], how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique; the rows of a hot key are dealt over its parts by hash, and
    right's row stands in each of them."""
    if not hot:
        return left.join(right, key, how)
    parts = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(F.col(key).alias("_hot"), F.lit(0).alias("_parts")).schema))
    n = F.coalesce("_parts", F.lit(1))
    dealt = left.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), n).cast("int")).drop("_hot", "_parts")
    spread = right.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_hot", "_parts")
    return dealt.join(spread, [key, "_part"], how).drop("_part")


_held: dict[object, object] = {}


def worker_state(key: object, build: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks: the state of one operator, that of the last one is let go."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def forget_state() -> None:
    """Let the state of an operator before this one go."""
    _held.clear()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; for a file scan the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions that grow with a written table: at least the session's number, and one for each bytes_each."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(plan_bytes(df) / bytes_each))
