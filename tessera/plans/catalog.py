"""All named queries of the library, and their SQL."""

from tessera.plans import answers, files, lexical, questions, relations, selections  # noqa: F401
from tessera.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
