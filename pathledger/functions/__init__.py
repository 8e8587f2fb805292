"""Per-row expressions; each takes and returns Columns and stays in codegen."""

from .paths import (
    child_name,
    directory_prefix,
    exp_dir_name,
    extension,
    filename,
    like_literal,
    parent_path,
    run_number,
)
from .sizes import parse_size, parse_size_column, size_human
from .state import entry_changed, is_regular_file, is_symlink, resolve_on_disk

__all__ = [
    "child_name", "directory_prefix", "entry_changed", "exp_dir_name", "extension", "filename",
    "is_regular_file", "is_symlink", "like_literal", "parent_path", "parse_size",
    "parse_size_column", "resolve_on_disk", "run_number", "size_human",
]
