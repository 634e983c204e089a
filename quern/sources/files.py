"""File sources: articles, logs and project trees, read in parallel from a local or mounted folder or any file system that Arrow knows.

Spark's own file sources pass over names that begin with ``_`` or ``.``. Here folders are listed and files opened by the tasks
themselves, so every legal name is read as it is, ``100%.md`` and ``a%20b.md`` too. A listing (path, length, mtime) comes first and
costs no content; what it holds is written once, so files are read as they were listed, and only those that are asked for.
"""

from __future__ import annotations

import errno
import os
import stat
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.constants import SUBDIRS, TREE_BYTES
from quern.session import settle

FILES = "path string, length long, mtime double, content string, valid boolean"
#: Bytes and files that one task reads, about, and bytes that it holds at once.
TASK_BYTES, TASK_FILES, HELD_BYTES = 64 << 20, 2000, 16 << 20


def system(root: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in root and not root.startswith("file:"):
        return afs.FileSystem.from_uri(root)
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return afs.LocalFileSystem(), root.rstrip("/") or "/"


def exists(root: str) -> bool:
    fs, path = system(root)
    return fs.get_file_info(path).type != afs.FileType.NotFound


def read_text(path: str) -> str | None:
    """The text of a small file; None where there is none."""
    if not exists(path):
        return None
    fs, p = system(path)
    with fs.open_input_stream(p) as f:
        return f.read().decode("utf-8", "replace")


def write_text(path: str, text: str | bytes) -> None:
    """A file, put in place at once."""
    fs, p = system(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{p}.part") as f:
        f.write(text.encode() if isinstance(text, str) else text)
    fs.move(f"{p}.part", p)


def _children(root: str) -> list[afs.FileInfo]:
    fs, path = system(root)
    return sorted(fs.get_file_info(afs.FileSelector(path, allow_not_found=True)), key=lambda i: i.path)


_LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime", pa.float64())])
#: Files of a row batch of a listing.
LISTED = 10_000


def _local(top: str, d: str, recursive: bool) -> Iterator[tuple[str, int, float | None]]:
    """What lies in a local folder, one by one: a folder of any size takes no more memory. Links are followed, dangling ones passed over."""
    first = d.rstrip("/")
    todo = [first]
    while todo:
        d, inner = todo.pop(), False
        try:
            found = os.scandir(f"{top}/{d}")
        except FileNotFoundError:
            continue
        with found:
            for e in found:
                try:
                    st = e.stat()
                except OSError as x:
                    if x.errno in (errno.ENOENT, errno.ENOTDIR, errno.ELOOP):
                        continue
                    raise
                path, is_file, is_dir = f"{d}/{e.name}".lstrip("/"), stat.S_ISREG(st.st_mode), stat.S_ISDIR(st.st_mode)
                inner |= is_file or is_dir
                if is_file:
                    yield path, st.st_size, st.st_mtime_ns // 10**6 / 1000
                elif is_dir and recursive:
                    todo.append(path)
        if not inner and d != first:
            yield f"{d}/", 0, None


def _remote(fs: afs.FileSystem, top: str, d: str, recursive: bool) -> Iterator[tuple[str, int, float | None]]:
    """The same on any other file system, whose folders come whole: one at a time."""
    first, cut = d.rstrip("/"), len(top.rstrip("/")) + 1
    todo = [first]
    while todo:
        d, inner = todo.pop(), False
        for i in fs.get_file_info(afs.FileSelector(f"{top}/{d}".rstrip("/"), allow_not_found=True)):
            inner |= i.type in (afs.FileType.File, afs.FileType.Directory)
            if i.type == afs.FileType.File:
                yield i.path[cut:], i.size, i.mtime_ns // 10**6 / 1000
            elif i.type == afs.FileType.Directory and recursive:
                todo.append(i.path[cut:])
        if not inner and d != first:
            yield f"{d}/", 0, None


def listing(spark: SparkSession, root: str, folders: list[str], recursive: bool = False) -> DataFrame:
    """(path, length, mtime) of what lies in the folders of ``root``, each listed by a task; a missing folder is empty."""
    schema = "path string, length long, mtime double"
    if not folders:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = system(root)
        for b in batches:
            for d in b.column("d").to_pylist():
                found = _local(top, d, recursive) if isinstance(fs, afs.LocalFileSystem) else _remote(fs, top, d, recursive)
                while part := list(islice(found, LISTED)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _LISTED)], schema=_LISTED)

    dirs = spark.createDataFrame([(d,) for d in folders], "d string").repartition(min(len(folders), spark.sparkContext.defaultParallelism))
    return settle(dirs.mapInArrow(run, schema), "listing")


def read(spark: SparkSession, root: str, listed: DataFrame, replace: bool = False) -> DataFrame:
    """(path, mtime, content, valid) of listed files. Bytes that aren't UTF-8 are replaced, or else flagged: no text, and not valid; so is a
    file that is gone or can't be read."""
    return _filled(spark, root, listed, replace).select("path", "mtime", "content", "valid")


def _filled(spark: SparkSession, root: str, listed: DataFrame, replace: bool, most_bytes: int | None = None) -> DataFrame:
    """(path, length, mtime, content, valid) of all that is listed. Folders, and files over ``most_bytes``, aren't opened where
    that is given: they have no content, and count as valid.

    Contents join no listing: Spark would take them for as small as that, and broadcast them.
    """
    listed = settle(listed.select("path", "length", "mtime"), "read")
    opened = F.lit(True) if most_bytes is None else F.col("mtime").isNotNull() & (F.col("length") <= most_bytes)
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.when(opened, F.col("length"))), F.lit(0))).first()
    parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-size // TASK_BYTES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = system(root)
        rows, held = [], 0
        for b in batches:
            for path, length, mtime, take in zip(*(b.column(c).to_pylist() for c in ("path", "length", "mtime", "opened"))):
                try:
                    text = None
                    if take:
                        with fs.open_input_stream(f"{top}/{path}", compression=None) as f:
                            raw = f.read()
                        held += len(raw)
                        text = raw.decode("utf-8", "replace" if replace else "strict").replace("\r\n", "\n").replace("\r", "\n")
                    rows.append((path, length, mtime, text, True))
                except (OSError, UnicodeDecodeError):
                    rows.append((path, length, mtime, None, False))
                if held >= HELD_BYTES or len(rows) >= LISTED:
                    yield _read_batch(rows)
                    rows, held = [], 0
        if rows:
            yield _read_batch(rows)

    return listed.withColumn("opened", opened).repartition(parts, F.xxhash64("path")).mapInArrow(run, FILES)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.float64(), pa.string(), pa.bool_()))], ["path", "length", "mtime", "content", "valid"])


def articles_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime) of the markdown files right in the five folders; a missing base is empty."""
    return listing(spark, root, SUBDIRS).where(F.col("path").endswith(".md"))


def knowledge_base(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, content, valid) of the same files."""
    return read(spark, root, articles_listing(spark, root))


def all_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every markdown file under the base, at any depth."""
    top = _children(root)
    here = [(i.base_name,) for i in top if i.type == afs.FileType.File]
    deep = listing(spark, root, [i.base_name for i in top if i.type == afs.FileType.Directory], True).select("path")
    return deep.union(spark.createDataFrame(here, "path string")).where(F.col("path").endswith(".md"))


def logs(spark: SparkSession, root: str) -> DataFrame:
    """(log_name, content, valid) of the folder's markdown files."""
    found = listing(spark, root, [""]).where(F.col("path").endswith(".md")).withColumn("path", F.substring_index("path", "/", -1))
    return read(spark, root, found).select(F.col("path").alias("log_name"), "content", "valid")


def project_tree(spark: SparkSession, root: str, most_bytes: int = TREE_BYTES) -> DataFrame:
    """(project, rel_path, name, suffix, length, mtime, content) of every file under the folders of ``root``, hidden ones too; bad bytes are replaced.

    Contents of files over ``most_bytes`` aren't read: nothing looks at them. A folder without files is a row whose rel_path ends in a slash.
    """
    every = listing(spark, root, [i.base_name for i in _children(root) if i.type == afs.FileType.Directory], True)
    f = _filled(spark, root, every.where(F.instr("path", "/") > 0), True, most_bytes)
    f = f.withColumn("project", F.substring_index("path", "/", 1)).withColumn("rel_path", F.expr("substring(path, length(project) + 2)")).where("rel_path <> ''")
    f = f.withColumn("name", F.substring_index("path", "/", -1)).withColumn("mtime", F.timestamp_millis((F.col("mtime") * 1000).cast("long")))
    return f.select("project", "rel_path", "name", F.regexp_extract("name", r"[^.](\.[^.]+)$", 1).alias("suffix"), "length", "mtime", "content")
