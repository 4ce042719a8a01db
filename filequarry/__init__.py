"""SQL and DataFrame queries over plain data files, on Spark."""

__version__ = "0.1.0"

from .catalog import Column, TableConfig
from .engine import Engine
from .session import session

__all__ = ["Column", "Engine", "TableConfig", "session"]
