"""Named queries over the driver's tables and their DuckDB equivalents.

Stand-ins: documents are chunks (source: document and ticker, lang: section,
labels.quality: narrative), benchmark holds the questions, embeddings the vectors of
the documents with the same number and of the questions, events the queues.
"""

from . import evaluation, ingestion, maintenance, monitoring, relational, retrieval  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = QUERIES["hybrid_search"]

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
