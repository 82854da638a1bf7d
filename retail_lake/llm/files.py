"""Files of tasks in the shared folder of the session."""

from __future__ import annotations

from uuid import uuid4

from pyarrow import fs
from pyspark.sql import SparkSession

from retail_lake.session import scratch_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the session's shared scratch folder; tasks create it."""
    return f"{scratch_dir(spark)}/{name}-{uuid4().hex}"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path there."""
    return fs.FileSystem.from_uri(folder)
