"""Registered queries over the given tables, each with an equivalent SQL text where SQL can say it."""

from tesselar.workload.registry import ORACLE, QUERIES  # noqa: F401
from tesselar.workload import (  # noqa: F401,E402
    annotation_queries,
    cluster_queries,
    density_queries,
    detail_queries,
    embedding_queries,
    incremental_queries,
    scalar_queries,
    selection_queries,
    source_queries,
)
