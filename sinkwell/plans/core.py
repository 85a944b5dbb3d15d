"""Every registered query of the library, without the subpackage ``llm``."""

from . import choices, evidence, markup, more, ranked, related, searches, views  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
