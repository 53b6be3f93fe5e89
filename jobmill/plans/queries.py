"""All registered queries: each reads the driver tables (whole tables, no row caps) and
has a DuckDB twin in ``ORACLE`` with the same column names where SQL can express it.
Importing this module imports every query module, which registers itself."""

from __future__ import annotations

from . import q_config, q_pages, q_relational, q_scan, q_scoring, q_sources, q_store, q_stream, q_text, q_vectors  # noqa: F401
from .registry import AS_OF, ORACLE, QUERIES, SAMPLE_PROFILE, TOP_K, register  # noqa: F401
