"""Session settings and frames written once to the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans rely on. Skewed sort-merge joins are split even
# when that costs one more exchange: a third of all rows may share one key.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


#: Folders that frames are written to, innermost scope last.
_scopes: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; by default one below the warehouse."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """Where intermediate files go: the innermost open scope, else a folder of the session."""
    own = f"{checkpoint_dir(spark)}/frames-{spark.sparkContext.applicationId}"
    return _scopes[-1] if _scopes and _scopes[-1].startswith(own) else own


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the scratch folder and go on from the written rows.

    Readers share one evaluation, a lost executor costs no recomputation, and Spark knows
    the true size, by which it decides whether a join broadcasts the frame.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Frames frozen inside are deleted at the end; what is returned must not read them."""
    folder = f"{checkpoint_dir(spark)}/frames-{spark.sparkContext.applicationId}/scope-{uuid4().hex}"
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        discard(spark, folder)


def release(spark: SparkSession) -> None:
    """Delete all that the session has frozen; call it before ``spark.stop()``."""
    discard(spark, f"{checkpoint_dir(spark)}/frames-{spark.sparkContext.applicationId}")


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
