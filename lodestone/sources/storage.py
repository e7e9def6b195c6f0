"""Reading and writing single files on whatever file system a path names, by the driver or by tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is the local one."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if re.match(r"[a-z][a-z0-9+.-]+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def read_bytes(path: str) -> bytes:
    system, at = located(path)
    with system.open_input_stream(at) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> str:
    """Writes a file, making its folder where there is none, and gives its path."""
    system, at = located(path)
    system.create_dir(at.rpartition("/")[0] or "/", recursive=True)
    with system.open_output_stream(at) as f:
        f.write(data)
    return path


def write_text(path: str, text: str) -> str:
    return write_bytes(path, text.encode("utf-8", "replace"))


def write_array(path: str, items: Iterable[str]) -> str:
    """Writes a JSON array of items, which are JSON texts themselves, one after the other."""
    system, at = located(path)
    system.create_dir(at.rpartition("/")[0] or "/", recursive=True)
    with system.open_output_stream(at) as f:
        f.write(b"[")
        for k, item in enumerate(items):
            f.write((",\n  " if k else "\n  ").encode() + item.encode("utf-8", "replace"))
        f.write(b"\n]\n")
    return path


def write_json(path: str, value) -> str:
    return write_text(path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def read_json(path: str):
    return json.loads(read_bytes(path).decode("utf-8"))
