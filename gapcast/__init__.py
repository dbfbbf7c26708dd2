"""gapcast: headway analytics for many arrival series at once, on Spark."""

from gapcast.config import Config

__all__ = ["Config"]
