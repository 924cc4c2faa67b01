"""Binary results as files of their own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def write_files(files: DataFrame, target: str, overwrite: bool = True) -> DataFrame:
    """Write each row of ``files(name, content)`` as a file below ``target``; a lazy report.

    ``target`` is a URI or path all executors reach. A file is written under a name of its task
    attempt and then moved, so a repeated task leaves the same result. Without ``overwrite`` a file
    that is there with other content stays. What cannot be written is a failed row.
    """

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        uri = target.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", target) else target
        system, root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        for batch in batches:
            report = []
            for name, content in zip(batch["name"], batch["content"]):
                final = f"{root.rstrip('/')}/{name}"
                part = f"{final}.{uuid.uuid4().hex}.part"
                try:
                    if not overwrite and system.get_file_info(final).type != fs.FileType.NotFound:
                        with system.open_input_stream(final) as there:
                            if there.read() != bytes(content):  # else a lost attempt of this task has written it
                                raise FileExistsError(final)
                    system.create_dir(final.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(part) as out:
                        out.write(bytes(content))
                    system.move(part, final)
                    report.append((name, "ok", None))
                except Exception as problem:
                    report.append((name, "failed", f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(report, columns=["name", "status", "message"])

    return files.select("name", "content").mapInPandas(store, "name string, status string, message string")
