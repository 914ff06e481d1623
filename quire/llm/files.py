"""Whole files in the shared folder, by URI, from driver or executors. Writing is quire.sources.output's."""

from __future__ import annotations

from pyarrow import fs

from quire.sources.output import write_bytes as write_file

__all__ = ["read_file", "write_file"]


def read_file(uri: str) -> memoryview:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return memoryview(f.read_buffer())
