"""Hybrid search for a batch of questions: two legs, fusion, diversity, reranking, context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULTS, Settings
from ..storage import written
from .breaker import CircuitBreaker, CircuitOpen
from .dense import dense_topk
from .filters import build_filter
from .fusion import rrf, weighted
from .selection import build_context, mmr, overlap_score, rerank, service_rerank
from .sparse import SparseIndex, bm25_topk


class RetrievalUnavailable(RuntimeError):
    """Both legs of the search are down."""


@dataclass
class Search:
    """What a search runs with; a leg that is down or fails, or no reranker, changes the plan and is told in `degraded`."""

    filters: dict[str, Any] | None = None
    fusion: str = "rrf"
    dense: bool = True
    sparse: bool = True
    reranker: bool = True
    diverse: bool = True
    top_k: int = DEFAULTS.top_k
    budget: int | None = None
    settings: Settings = field(default_factory=Settings)
    rewrite: Any = None  # a function of the question's column; none by default
    scorer: Callable[[Column, Column], Column] = overlap_score  # of question and text
    service: Callable[[str, list[str]], list[dict]] | None = None  # scores a question's texts in place of scorer, and may fail
    breakers: dict[str, CircuitBreaker] = field(default_factory=dict)  # by leg: run it at once, and go on without it if it fails


def legs(docs: DataFrame, vectors: DataFrame, queries: DataFrame, s: Search, index: SparseIndex | None = None) -> dict[str, DataFrame]:
    """Ranked lists by source; the filter holds before scoring in both.  index has the postings of docs, if they are written already."""
    if not (s.dense or s.sparse):
        raise RetrievalUnavailable("neither dense nor sparse search is available")
    keep: Column | None = build_filter(s.filters)
    found = {}
    if s.dense:
        rows = vectors if keep is None else vectors.join(docs.where(keep).select("doc_id"), "doc_id", "left_semi")
        found["dense"] = dense_topk(rows, queries, s.settings.top_k_dense)
    if s.sparse:
        asked = queries if s.rewrite is None else queries.withColumn("text", s.rewrite(F.col("text")))
        found["sparse"] = bm25_topk(docs, asked.select("query_id", "text"), s.settings.top_k_sparse, keep, s.settings, index)
    return found


def standing(found: dict[str, DataFrame], s: Search) -> dict[str, DataFrame]:
    """The legs that work: those with a breaker are run and written, and left out if they fail or the breaker is open."""
    up = {}
    for name, leg in found.items():
        try:
            up[name] = s.breakers[name].call(written, leg, f"leg-{name}") if name in s.breakers else leg
        except (CircuitOpen, PySparkException, Py4JJavaError):
            continue
    if not up:
        raise RetrievalUnavailable("neither dense nor sparse search is available")
    return up


def fused(found: dict[str, DataFrame], s: Search) -> DataFrame:
    if s.fusion == "rrf":
        return rrf(found, s.settings.rrf_k).drop("source_ranks")
    return weighted(found, {"dense": s.settings.weight_dense, "sparse": s.settings.weight_sparse})


def diverse(found: DataFrame, vectors: DataFrame, s: Search) -> DataFrame:
    """query_id, doc_id, fused_score, mmr_rank: the mmr_top_n candidates that go on."""
    if not s.diverse:
        return found.where(F.col("fused_rank") <= s.settings.mmr_top_n).select("query_id", "doc_id", "fused_score", F.col("fused_rank").alias("mmr_rank"))
    with_vectors = found.join(vectors.select("doc_id", "embedding"), "doc_id", "left")
    return mmr(with_vectors, s.settings.mmr_top_n, s.settings.mmr_lambda)


def hydrate(hits: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with columns of their documents; hits whose document is gone are dropped.  Texts are fetched for these few only."""
    return docs.select("doc_id", *columns).join(hits, "doc_id")


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, s: Search | None = None, index: SparseIndex | None = None) -> DataFrame:
    """Citations of a context for each question: see build_context, and degraded (what was missing, joined by commas).

    docs has doc_id, text, source, lang and the columns that filters name; vectors has
    doc_id and embedding; queries has query_id, text and embedding.
    """
    s = s or Search()
    found = standing(legs(docs, vectors, queries, s, index), s)
    down = [name for name in ("dense_unavailable", "sparse_unavailable") if name.split("_")[0] not in found]
    chosen = diverse(fused(found, s), vectors, s)
    full = hydrate(chosen, docs, ["text", "source", "lang"]).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    if not s.reranker:
        top = full.where(F.col("mmr_rank") <= max(s.top_k, 1)).withColumns({"rerank_score": F.lit(None).cast("double"), "place": F.col("mmr_rank")})
    elif s.service:
        top = written(service_rerank(full, s.service, "mmr_rank", s.top_k, s.settings.rerank_pool).withColumnRenamed("rerank_rank", "place"), "reranked")  # asked once
    else:
        top = rerank(full, s.scorer(F.col("question"), F.col("text")), "mmr_rank", s.top_k, s.settings.rerank_pool).withColumnRenamed("rerank_rank", "place")
    lost = F.when(F.col("rerank_score").isNull(), F.lit("rerank_unavailable"))
    flags = top.groupBy("query_id").agg(F.concat_ws(",", *map(F.lit, down), F.max(lost)).alias("degraded"))
    top = top.withColumn("score", F.coalesce("rerank_score", "fused_score"))
    top = top.withColumn("n_tokens", T.token_estimate(F.lit(None).cast("int"), F.col("text")))
    top = top.withColumn("label", T.citation_label(F.col("source"), F.col("lang"), F.lit(None).cast("string")))
    top = top.join(vectors.select("doc_id", "embedding"), "doc_id", "left")
    context = build_context(top, "place", s.budget, s.settings)
    if s.service is None:  # what is missing is the same for all questions
        return context.withColumn("degraded", F.lit(",".join(down + ["rerank_unavailable"] * (not s.reranker))))
    return context.join(flags, "query_id")


def context_text(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id and the context's text: numbered, labelled blocks joined by blank lines."""
    block = F.concat(F.lit("["), F.col("citation_id").cast("string"), F.lit("] ("), F.col("label"), F.lit(")\n"), F.col("text"))
    rows = citations.join(docs.select("doc_id", "text"), "doc_id")
    blocks = F.array_sort(F.collect_list(F.struct("citation_id", block.alias("block"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context_text"))


def prompt(question: str, context: str) -> str | None:
    """The prompt for a text generator, None without evidence: there is nothing to answer from then."""
    if not context:
        return None
    return f"Answer from the numbered passages alone and cite them as [n].\n\n{context}\n\nQuestion: {question}"
