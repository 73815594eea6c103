"""Byte files in the shared folder, written and read by tasks through pyarrow's file
systems (``file:``, ``hdfs:``, ``s3:`` ...).  A task's file has a name of its own, and
counts only once its row has reached the driver's table: an attempt that is lost leaves
at most an unreferenced file behind."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def new_file(folder: str, stem: str, ending: str):
    """(stream, name) of a new file below ``folder``."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{ending}"
    return system.open_output_stream(f"{path}/{name}", compression=None), name


def read_file(folder: str, name: str):
    system, path = opened(folder)
    return system.open_input_file(f"{path}/{name}")
