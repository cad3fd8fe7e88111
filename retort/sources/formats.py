"""Registry of formats by file extension [A11, A12]."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlparse


class RetortIOError(IOError):
    """Base of the library's I/O errors [N13]."""


class UnsupportedFormatError(RetortIOError):
    pass


class RecordParseError(RetortIOError):
    def __init__(self, source: str, index: int, reason: str):
        super().__init__(f"{source}, record {index}: {reason}")
        self.source, self.index, self.reason = source, index, reason


READERS: dict[str, Callable] = {}
WRITERS: dict[str, Callable] = {}


def register_format(ext: str, reader: Callable | None = None, writer: Callable | None = None) -> None:
    """``reader(spark, paths, **options)`` gives records; ``writer(records, **options)`` gives text lines."""
    ext = ext.lower().lstrip(".")
    if reader is not None:
        READERS[ext] = reader
    if writer is not None:
        WRITERS[ext] = writer


def detect_format(path: str) -> str:
    """Lower-case extension; ``.gz`` and ``.bz2`` are looked through."""
    name = os.path.basename(urlparse(path).path or path).lower()
    for packed in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(packed)
    ext = name.rpartition(".")[2] if "." in name else ""
    if ext not in READERS and ext not in WRITERS:
        raise UnsupportedFormatError(f"no format for {path!r}")
    return ext


def get_reader(ext: str) -> Callable:
    if ext not in READERS:
        raise UnsupportedFormatError(f"no reader for {ext!r}")
    return READERS[ext]


def get_writer(ext: str) -> Callable:
    if ext not in WRITERS:
        raise UnsupportedFormatError(f"no writer for {ext!r}")
    return WRITERS[ext]
