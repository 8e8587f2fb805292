"""Versioned inventories of file metadata on Spark."""

from .catalog import Catalog, CatalogReader, FlatCatalog, write_tsv
from .functions import parse_size
from .plans import Change
from .schema import FILE_SCHEMA, LOG_SCHEMA
from .sources import from_table

__version__ = "0.1.0"

__all__ = [
    "Catalog", "CatalogReader", "Change", "FILE_SCHEMA", "FlatCatalog", "LOG_SCHEMA",
    "from_table", "parse_size", "write_tsv",
]
