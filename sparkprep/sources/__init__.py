"""Reading and writing of tabular and semi-structured files."""

from .readers import read
from .writers import write

__all__ = ["read", "write"]
