"""Sources and sinks of frames."""

from .files import read_table, write_table
from .shared import shared_folder

__all__ = ["read_table", "shared_folder", "write_table"]
