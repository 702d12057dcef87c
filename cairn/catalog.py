"""Imports every module that registers queries."""

from .plans import absence, evaluation, fusion, gaps, graph, judging, linkage, records, retrieval, streams, structure, structures, text  # noqa: F401
