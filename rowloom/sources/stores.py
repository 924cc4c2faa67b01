"""Files of any store, listed and opened by path inside tasks.

Spark's readers hide names that begin with ``_`` or ``.``, give no row for empty files, and fail a whole job over a file
that has gone. Here every file is a row: read, or with the reason why not. A path is one that all tasks reach: local
to a shared folder, or of a store that pyarrow knows by its scheme.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.refs import path_extension
from rowloom.session import materialize

LISTING = "path string, kind string, length bigint, modified timestamp, message string, todo array<string>"


def store_of(uri: str) -> tuple[Any, str]:
    """The pyarrow file system of ``uri``, and the path in it; characters of the path mean themselves."""
    from pyarrow import fs

    found = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?)?(/.*)", uri)
    if found is None:
        return fs.LocalFileSystem(), uri
    scheme, host, rest = found.groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), rest
    system, root = fs.FileSystem.from_uri(f"{scheme}://{host or ''}/")
    return system, root.rstrip("/") + rest


def reason(problem: Exception) -> str:
    """A failure as it is reported."""
    return f"{type(problem).__name__}: {problem}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, so that tasks go to the one the driver means."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def name_pattern(glob: str) -> str:
    """The regular expression of one part of a path pattern: ``*``, ``?``, ``[ab]``, ``{a,b}``, and ``\\`` before a
    character that means itself."""
    out, i, braces = [], 0, 0
    while i < len(glob):
        c = glob[i]
        closing = glob.find("]", i + 2) if c == "[" else -1
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        elif closing > 0:
            inner = glob[i + 1 : closing].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = closing
        elif c == "{":
            out.append("(?:")
            braces += 1
        elif c in ",}" and braces:
            out.append("|" if c == "," else ")")
            braces -= c == "}"
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)" + "".join(out)


def _root(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The literal beginning of a path, and the patterns of the names below it."""
    parts = re.split(r"(?<!\\)/", path)
    plain = 0
    while plain < len(parts) and not re.search(r"(?<!\\)[*?\[{]", parts[plain]):
        plain += 1
    literal = re.sub(r"\\(.)", r"\1", "/".join(parts[:plain])) or ("/" if path.startswith("/") else ".")
    return qualified(spark, literal), [name_pattern(p) for p in parts[plain:] if p]


def every_file(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """``(path, extension, length, modified, message)`` of all files at ``paths``, hidden and empty ones too.

    A path is a file, a folder, or a pattern of either; with ``recursive`` folders count with all below them. A path that
    is not there, or cannot be listed, is a row with a message. The folders of a level are dealt over tasks; only
    ``paths`` themselves are known to the driver. A file reached twice is listed once.
    """
    roots = [_root(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    return walk(spark.createDataFrame(roots, "path string, todo array<string>"), recursive)


def walk(level: DataFrame, recursive: bool = False) -> DataFrame:
    """:func:`every_file` of ``(path, todo)``: literal paths, and the patterns of the names below each."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = ["path", "kind", "length", "modified", "message", "todo"]

        def found(info: Any, path: str, todo: list[str]) -> tuple | None:
            if info.type == fs.FileType.Directory:
                return (path, "folder", None, None, None, todo)
            return None if todo else (path, "file", info.size, info.mtime and info.mtime.replace(tzinfo=None), None, [])

        def below(path: str, todo: list[str]) -> Iterator[tuple | None]:
            system, place = store_of(path)
            info = system.get_file_info(place)
            if info.type == fs.FileType.NotFound:
                yield (path, "error", None, None, "the file is not there", [])
            elif info.type != fs.FileType.Directory:
                yield found(info, path, todo)
            else:
                for entry in system.get_file_info(fs.FileSelector(place)):
                    inner = f"{path.rstrip('/')}/{entry.base_name}"
                    if todo and re.fullmatch(todo[0], entry.base_name):
                        yield found(entry, inner, todo[1:])
                    elif not todo and (recursive or entry.type != fs.FileType.Directory):
                        yield found(entry, inner, [])

        for batch in batches:
            for path, todo in zip(batch["path"], batch["todo"]):
                try:
                    rows = [row for row in below(path, list(todo)) if row is not None]
                except Exception as problem:  # a folder that cannot be listed is one row
                    rows = [(path, "error", None, None, reason(problem), [])]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"length": "Int64", "modified": "datetime64[us]"})

    every = None
    while level is not None:
        seen = materialize(level.repartition("path").mapInPandas(look, LISTING))
        here = seen.filter("kind != 'folder'")
        every = here if every is None else every.unionByName(here)
        folders = seen.filter("kind = 'folder'").select("path", "todo")
        level = None if folders.isEmpty() else folders
    kept = every.groupBy("path").agg(F.max("length").alias("length"), F.max("modified").alias("modified"), F.max("message").alias("message"))
    return kept.select("path", path_extension(F.col("path")).alias("extension"), "length", "modified", "message")
