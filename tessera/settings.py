"""Parameters of the engine, and values that are fixed by the data format."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

#: Words that carry no weight in sparse search.
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were will with".split()

#: Report items in their order: number, words that follow the number in a heading, title, narrative.
ITEMS = [
    ("1", r"Business", "Business", True),
    ("1A", r"Risk\s+Factors", "Risk Factors", True),
    ("1B", r"Unresolved\s+Staff\s+Comments", "Unresolved Staff Comments", False),
    ("1C", r"Cybersecurity", "Cybersecurity", False),
    ("2", r"Propert", "Properties", False),
    ("3", r"Legal\s+Proceedings", "Legal Proceedings", True),
    ("4", r"Mine\s+Safety", "Mine Safety Disclosures", False),
    ("5", r"Market\s+for", "Market for Registrant's Common Equity", True),
    ("6", r"(?:\[?\s*Reserved|Selected)", "Reserved", False),
    ("7", r"Management", "Management's Discussion and Analysis", True),
    ("7A", r"Quantitative", "Quantitative and Qualitative Disclosures About Market Risk", True),
    ("8", r"Financial\s+Statements", "Financial Statements and Supplementary Data", False),
    ("9", r"Changes", "Changes in and Disagreements with Accountants", False),
    ("9A", r"Controls", "Controls and Procedures", False),
    ("9B", r"Other\s+Information", "Other Information", False),
    ("10", r"Directors", "Directors, Executive Officers and Corporate Governance", False),
    ("11", r"Executive\s+Compensation", "Executive Compensation", False),
    ("12", r"Security\s+Ownership", "Security Ownership", False),
    ("13", r"Certain\s+Relationships", "Certain Relationships and Related Transactions", False),
    ("14", r"Principal\s+Accountant", "Principal Accountant Fees and Services", False),
    ("15", r"Exhibit", "Exhibits and Financial Statement Schedules", False),
]

#: Fixed value: what may stand between an item's number and its words.
ITEM_SEPARATOR = r"\s*[\.\:\u2013\u2014-]?\s*"

#: Page furniture, as Java patterns, removed in this order.
PAGE_FURNITURE = [
    r"(?i)[^|\n]{0,60}\|\s*\d{4}\s*Form\s*10-K\s*\|\s*\d{1,4}",
    r"(?i)\bPage\s+\d{1,4}\s+of\s+\d{1,4}\b",
    r"(?i)\bTable\s+of\s+Contents\b",
    r"(?i)\bPART\s+(?:I{1,3}|IV)\b(?=\s+Item\b)",
    r"(?m)^\s*PART\s+(?:I{1,3}|IV)\s*$",
    r"(?m)^\s*\d{1,4}\s*$",
]

#: Tags that end a line, and tags that end a cell.
BLOCK_TAGS = "p div br tr table li ul ol h1 h2 h3 h4 h5 h6 section article hr".split()
CELL_TAGS = "td th".split()

#: Bounds of the stage duration histogram, in seconds.
DURATION_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]

#: The filter keys that a search accepts.
FILTER_KEYS = ["tenant", "ticker", "section", "item", "fiscal_year", "document_id", "is_narrative", "date_after", "date_before", "tags"]


@dataclass(frozen=True)
class Settings:
    """Defaults are those of the service this engine stands in for."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    chunk_min: int = 32
    special_tokens: int = 2
    safety_tokens: int = 4
    chunker_version: str = "1"
    strategy: str = "section_aware"
    embedding_model: str = "BAAI/bge-m3"
    top_k_dense: int = 100
    top_k_sparse: int = 100
    rrf_k: int = 60
    weight_dense: float = 0.5
    weight_sparse: float = 0.5
    mmr_lambda: float = 0.7
    mmr_top_n: int = 20
    k1: float = 1.2
    b: float = 0.75
    max_context_tokens: int = 100_000
    context_reserve: int = 2_000
    dedupe_threshold: float = 0.95
    per_document: int = 3
    rerank_pool: int = 100
    top_k: int = 5
    oversampling: float = 2.0
    job_attempts: int = 3
    stuck_minutes: int = 30
    outbox_batch: int = 500
    outbox_attempts: int = 10
    stale_minutes: int = 5
    shard_rows: int = 2_000
    batch_tokens: int = 16_384

    def fingerprint(self) -> str:
        """Identifies everything that changes what a chunk contains; part of every chunk's identity."""
        parts = {
            "v": self.chunker_version, "strategy": self.strategy, "size": self.chunk_size,
            "overlap": self.chunk_overlap, "min": self.chunk_min, "model": self.embedding_model,
        }
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:8]


DEFAULTS = Settings()
