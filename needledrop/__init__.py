"""Play-event analytics expressed as Spark DataFrame jobs."""

from needledrop.config import Settings

__all__ = ["Settings"]
