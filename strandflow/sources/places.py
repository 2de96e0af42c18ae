"""Files by their paths or addresses, on any file system that pyarrow opens."""

from __future__ import annotations


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
