"""Folders that all executors share, and their end.

A table of a session's own goes when the session's driver exits or, in a process
that has had several sessions, once another one asks for a folder.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Of each folder: the application, and the Java objects that delete it, which
#: also work after the session has been stopped.
_made: list[tuple[str, object, object]] = []
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session that names none (tests, a laptop) gets a temporary
    folder; on a cluster, where no other machine would see it, that's an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_dirs.get(sc.applicationId) or tempfile.mkdtemp(prefix="quillspark-")
        _own_dirs[sc.applicationId] = found
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    files, target = file_system(spark, path)
    files.delete(target, True)


def session_folder(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path under the shared folder.  ``keep`` leaves what is written there."""
    path = f"{shared_dir(spark)}/quillspark/{label}-{uuid.uuid4().hex}"
    if not keep:
        own = spark.sparkContext.applicationId
        _delete(lambda application: application != own)
        _made.append((own, *file_system(spark, path)))
    return path


@atexit.register
def _delete(ended=lambda application: True) -> None:
    for entry in [e for e in _made if ended(e[0])]:
        _made.remove(entry)
        try:
            entry[1].delete(entry[2], True)
        except Exception:  # noqa: S112  the Java side has ended; others may be of another
            continue
