"""sitesieve: language-targeted web corpus work over tables and streams of fetched pages."""

from .config import SieveConfig

__all__ = ["SieveConfig"]
