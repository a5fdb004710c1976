"""Files that tasks write to the shared folder under a manifest.

A task writes a file under a name no other attempt uses and returns a row that describes it.
The rows are written as a Spark table, so its commit decides which attempt's files count;
files of lost or repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_system(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI or an absolute path."""
    from pyarrow import fs

    match = re.match(r"file:/*(/.*)", uri)
    return fs.FileSystem.from_uri(match.group(1) if match else uri)


def new_name(folder: str, label: str, suffix: str) -> str:
    return f"{folder}/{label}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def open_stream(uri: str):
    store, path = file_system(uri)
    return store.open_input_stream(path)


def open_random(uri: str):
    """Memory map of a local file, else a random-access file."""
    import pyarrow as pa
    from pyarrow import fs

    store, path = file_system(uri)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def committed(manifest: DataFrame, folder: str) -> DataFrame:
    """Run the writing job and return its manifest as a table."""
    path = f"{folder}/manifest"
    manifest.write.mode("overwrite").parquet(path)
    return manifest.sparkSession.read.schema(manifest.schema).parquet(path)


def dealt(pairs: DataFrame, *keys: str, most: int = 10_000) -> DataFrame:
    """Written rows dealt out by a hash of their keys, about one a task (several beyond ``most`` rows).

    A repeated task is given the same rows.
    """
    return pairs.repartition(max(1, min(most, pairs.count())), *keys)


def one_task_each(manifest: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """The manifest dealt out so that tasks hold about one file each (several beyond ``most`` files)."""
    files = max(1, min(most, manifest.count()))
    placed = manifest.withColumn("place", F.row_number().over(Window.orderBy(key)) % files)
    return placed.repartitionByRange(files, "place").drop("place")
