"""Session-level helpers shared by every operator.

Nothing in here collects data: the helpers choose partition counts, name the
shared folder that materialised intermediates go to, and number rows inside
groups without ever putting a whole group into one task.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of input files that one task of a CPU-bound step gets at most.
TASK_BYTES = 256 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table ``name`` below ``sf_dir`` (file or folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, local mode) is a folder of our
    own chosen and set; it is removed when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = getattr(context, "_repolith_folder", None)
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="repolith-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            folder = "file://" + own
            context._repolith_folder = folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame, *, compression: str = "zstd", partition_by: str | None = None) -> str:
    """Write ``df`` as Parquet into the shared folder; the path of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    written = getattr(spark.sparkContext, "_repolith_tables", None)
    if written is None:
        written = spark.sparkContext._repolith_tables = []
    written.append(path)
    return path


def shared_table(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table.

    Unlike a checkpoint the result keeps column pruning and statistics.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, compression=compression))


def drop_shared(spark: SparkSession) -> None:
    """Delete the tables written so far; for a caller that has consumed every result built on them."""
    paths = getattr(spark.sparkContext, "_repolith_tables", [])
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallel_slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def cpu_partitions(spark: SparkSession, size: int = 0) -> int:
    """Partitions for a step that is bound by computing: some for every slot, and none above ``TASK_BYTES``."""
    return max(parallel_slots(spark) * 4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads, by the optimizer; rows that come from elsewhere count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = (leaves.apply(i) for i in range(leaves.size()))
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in found if leaf.getClass().getSimpleName() == "LogicalRelation")


#: Logical operators that keep the partitions of a file scan.
_NARROW = {"Project", "Filter", "LogicalRelation", "SubqueryAlias", "MapInArrow"}


def _is_narrow(plan) -> bool:
    if plan.getClass().getSimpleName() not in _NARROW:
        return False
    below = plan.children()
    return all(_is_narrow(below.apply(i)) for i in range(below.size()))


def is_wide_scan(df: DataFrame, *, factor: int = 4) -> bool:
    """Whether ``df`` is a plain scan whose files already give every slot enough tasks.

    Partitions are counted on plain scans only: asking a plan with shuffles
    would run them.
    """
    narrow = _is_narrow(df._jdf.queryExecution().optimizedPlan())
    return narrow and df.rdd.getNumPartitions() >= parallel_slots(df.sparkSession) * factor // 2


def spread(df: DataFrame, key: str, *, factor: int = 4) -> DataFrame:
    """Give a CPU-bound step enough partitions; a wide scan is left as it is.

    A table of one small file arrives as one partition, and what comes out of a
    shuffle may be coalesced by its bytes; either would keep few cores busy. Only
    then are rows hash-distributed by ``key`` (a unique id, so a hot value cannot
    gather rows), into more partitions the more bytes there are.
    """
    if is_wide_scan(df, factor=factor):
        return df
    want = max(parallel_slots(df.sparkSession) * factor, -(-input_bytes(df) // TASK_BYTES))
    return df.repartition(want, F.xxhash64(key))


def number_in_groups(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in its group by ``order``.

    Equal to ``row_number() - 1`` over the group, but a group that holds a
    third of all rows is not sorted by one task: rows are range-partitioned by
    (group, order), the cell each row landed in is written down, every cell is
    numbered on its own, and the cells' sizes are summed up per group. Only one
    row per (group, cell) takes part in that sum. ``order`` must be a total
    order; rows that tie on all of it may take each other's numbers.
    """
    spark = df.sparkSession
    cells = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // TASK_BYTES))
    ordered = [c if not isinstance(c, str) else F.col(c) for c in order]
    placed = materialise(
        df.repartitionByRange(cells, *[F.col(c) for c in group], *ordered).withColumn("__cell", F.spark_partition_id())
    )
    sizes = placed.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__cell").orderBy(*ordered)
    on = placed.withColumn("__k", F.row_number().over(inside).cast("long") - 1)
    match = [on[c].eqNullSafe(starts[c]) for c in (*group, "__cell")]
    joined = on.join(starts, match, "inner")
    return joined.select(*[on[c] for c in df.columns], (F.col("__k") + F.col("__start")).alias(name))


def blocks_for(rows: int, rows_per_block: int) -> int:
    return max(1, math.ceil(rows / max(1, rows_per_block)))


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (as a zip of source files)."""
    context = spark.sparkContext
    if getattr(context, "_repolith_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="repolith-src-"), "repolith")
    context.addPyFile(shutil.make_archive(base, "zip", package_root(), "repolith"))
    context._repolith_shipped = True
