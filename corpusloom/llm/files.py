"""Files in the shared folder that tasks write and later tasks read.

Spark's own readers and writers handle tables; archives and id stores are byte formats of their own,
so tasks open them through Arrow's file systems. Every file gets a fresh name: a task that runs again
after a lost executor writes another file, and only the names in the committed manifest count.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession

from corpusloom.session import checkpoint_root


def shared_folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a folder's URI and the folder's path in it."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"
