"""All registered queries."""

from folioscope.catalog import documents, evaluation, feedback, library, ranking, evidence, streams  # noqa: F401, I001
from folioscope.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
