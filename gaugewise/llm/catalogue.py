"""All registered queries of this subpackage."""

from gaugewise.llm import queries_archive, queries_models, queries_native, queries_pairs, queries_text  # noqa: F401
from gaugewise.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
