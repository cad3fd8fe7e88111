"""File formats, sinks and versioned bundles."""

from .bundle import Bundle, ConflictError, load, save
from .formats import detect_format, get_reader, get_writer, register_format
from .readers import RecordParseError, RetortIOError, UnsupportedFormatError, batches, from_records, from_smarts, from_smiles, iter_batches, read_file, read_records
from .writers import to_records, write_file

__all__ = [
    "Bundle", "ConflictError", "RecordParseError", "RetortIOError", "UnsupportedFormatError", "batches", "detect_format", "from_records", "from_smarts", "from_smiles", "iter_batches", "get_reader", "get_writer",
    "load", "read_file", "read_records", "register_format", "save", "to_records", "write_file",
]
