"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings that suit the library on any cluster.  Sizes and cores stay with whoever submits the job.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Documents vary from a line to a book; small record batches keep Python workers within memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # A null column must still be a key in the written JSON line.
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
}


def get_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library defaults; keyword settings use ``__`` in place of ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the functions that run in Python there.

    Not needed where the package is installed on every node.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="gleaner-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for module in sorted(package.rglob("*.py")):
            bundle.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; elsewhere a machine-local folder
    would be invisible to the other executors, so the missing setting is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="gleaner-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder of this application; all of them may go when the application has ended."""
    return f"{scratch_root(spark)}/gleaner/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing will read again."""
    system, target = file_system(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, target = file_system(spark, path)
    return system.exists(target)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, with the folders above it."""
    system, target = file_system(spark, path)
    system.create(target, True).close()


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the scratch folder and go on from the table.

    It cuts the lineage, survives the loss of any executor, and gives the planner a true size, so that a
    later join is broadcast only when the table really is small.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with_row_id(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written once with a number per row that no other row has, and the name of its column.

    Results that several passes find for a row come back to it by that number, whatever its own keys are.
    """
    name = "_row_id"
    while name in df.columns:
        name += "_"
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), label), name
