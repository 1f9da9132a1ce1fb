"""Scratch tables in the folder that all executors share, and column helpers."""

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = " \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder, which goes with that folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Off by default, Spark keeps the shuffle files of a finished query until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it from there, so that lost executors cost nothing; its shuffles go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, which nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        java = spark.sparkContext._jvm
        folder = java.org.apache.hadoop.fs.Path(java.java.net.URI(files[0])).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` alone would change other letters too."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_package(df: DataFrame) -> DataFrame:
    """``df``, after giving this package to the session's Python workers (once a session).

    Spark serves the archive from the driver to every executor, also to those started later.
    """
    context = df.sparkSession.sparkContext
    if not any(name.endswith("ordersight.zip") for name in context._python_includes):
        root = pathlib.Path(__file__).resolve().parents[2]
        archive = pathlib.Path(tempfile.mkdtemp(prefix="ordersight-")) / "ordersight.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "ordersight").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(archive))
    return df
