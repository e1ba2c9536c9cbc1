"""Privacy-first signal screening as Spark DataFrame operators."""

from vigilframe.config import Config

__all__ = ["Config"]
__version__ = "0.1.0"
