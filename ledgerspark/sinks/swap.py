"""Swapping rewritten partitions into a stored table so that a crash half-way can be mended.

The new partitions are first written aside in full. Then a note beside the table's data names that
copy, the partition column and the partitions that end up empty. Only then the partitions are
overwritten (dynamic overwrite), the emptied ones deleted, and the note removed. Every step after
the note can be done again: ``recover`` repeats them from the copy, so a table is either as before
the note or, after recovery, as the interrupted write meant it to be. Writers recover first; a
reader who comes after a crash does the same by calling ``recover``.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

NOTE = "_swap.json"  # hidden from Spark's readers by its underscore


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _write_note(spark: SparkSession, path: str, note: dict) -> None:
    """The note appears whole or not at all: written under another name, then renamed."""
    fs, draft = _fs(spark, f"{path}/{NOTE}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(note).encode("utf-8")))
    out.close()
    if not fs.rename(draft, _fs(spark, f"{path}/{NOTE}")[1]):
        raise OSError(f"{path}: the note of a swap could not be put in place")


def _finish(spark: SparkSession, path: str, note: dict) -> None:
    fresh = spark.read.parquet(note["aside"])
    # the rebalance splits large partitions over tasks and keeps small ones in one file each
    (fresh.hint("rebalance", note["by"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(note["by"]).parquet(path))
    for name in note["emptied"]:
        delete(spark, f"{path}/{name}")
    delete(spark, f"{path}/{NOTE}")
    delete(spark, note["aside"])


def swap_in(spark: SparkSession, path: str, aside: str, by: str, emptied: list[str] = ()) -> None:
    """Replace the partitions of the table at ``path`` that the table ``aside`` holds, and delete the
    partitions (folder names) ``emptied``. ``aside`` must be complete and is deleted at the end."""
    note = {"aside": aside, "by": by, "emptied": list(emptied)}
    _write_note(spark, path, note)
    _finish(spark, path, note)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a swap that a crash has interrupted; whether there was one."""
    if not exists(spark, f"{path}/{NOTE}"):
        return False
    fs, where = _fs(spark, f"{path}/{NOTE}")
    stream = fs.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    _finish(spark, path, json.loads(text))
    return True
