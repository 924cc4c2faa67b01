"""Files of a shared file system, opened inside tasks."""

from __future__ import annotations

import re
import uuid
from typing import Any


def locate(uri: str) -> tuple[Any, str]:
    """The pyarrow file system of ``uri`` and the path in it; a plain path is one every task must see."""
    from pyarrow import fs

    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def new_file(folder: str, name: str) -> tuple[str, Any]:
    """A stream to a new file of this task attempt in ``folder``, and its URI.

    The name is unique, so a repeated or a second attempt of a task never touches the file of another; only
    files that a finished attempt reports are ever read.
    """
    uri = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, system.open_output_stream(path)
