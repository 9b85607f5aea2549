"""Logs of numbered entries, each a file that is created once and never changed."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

from tidemill.session import list_files, path_exists

DIGITS = 20


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file unless there is one of that name; says whether it was written.

    The text goes to a file of another name first, so nobody reads half an entry. On a local
    folder a hard link then gives it its name, elsewhere a rename that does not overwrite.
    Both are one step for HDFS and local disks; an object store needs a file system whose
    rename or create fails on an existing name.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = system.makeQualified(target)
    system.mkdirs(target.getParent())
    spare = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(spare, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if system.getScheme() == "file":
            return _linked(spare.toUri().getPath(), target.toUri().getPath())
        return _renamed(spark, spare, target)
    finally:
        system.delete(spare, False)


def _linked(spare: str, target: str) -> bool:
    try:
        os.link(spare, target)
    except FileExistsError:
        return False
    return True


def _renamed(spark: SparkSession, spare, target) -> bool:
    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = getattr(kind, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(spare, target, options)
    except Py4JJavaError as failure:
        if "FileAlreadyExists" in str(failure.java_exception.getClass().getName()):
            return False
        raise
    return True


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the entries below a folder, ascending."""
    if not path_exists(spark, folder):
        return []
    names = (name.removesuffix(".json") for name in list_files(spark, folder) if name.endswith(".json"))
    return sorted(int(name) for name in names if name.isdigit())


def entry_path(folder: str, number: int) -> str:
    return f"{folder}/{number:0{DIGITS}d}.json"


def read_entries(spark: SparkSession, folder: str, wanted: list[int]) -> list[dict]:
    """The entries of those numbers, in order; a line of text each."""
    if not wanted:
        return []
    rows = spark.read.text([entry_path(folder, n) for n in wanted], wholetext=True).collect()  # one small row an entry
    found = [json.loads(row["value"]) for row in rows]
    return sorted(found, key=lambda entry: entry["seq"])


def append_entry(spark: SparkSession, folder: str, entry: dict, number: int) -> bool:
    """Add the entry as that number; False if another writer has taken the number."""
    return create_once(spark, entry_path(folder, number), json.dumps({**entry, "seq": number}))
