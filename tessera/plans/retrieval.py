"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import dense as D
from ..operators import postings as P
from ..operators import selection as M
from ..operators.filters import build_filter
from ..operators.fusion import rrf, weighted
from ..operators.search import Search, diverse, fused, hydrate, legs, search
from ..operators.sparse import SparseIndex, idf, ranked, tf_weight, write_index
from ..operators.sparse import bm25_topk as scored
from ..storage import signature
from . import sql as Q
from .registry import query, table


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


_indexes: dict[tuple, SparseIndex] = {}


def index(spark, sf_dir) -> SparseIndex:
    """The postings of the documents: written by an application's first search, read by all that follow as long as the files are the same."""
    rows = docs(spark, sf_dir)
    key = spark.sparkContext.applicationId, signature(rows)
    if key not in _indexes:
        _indexes[key] = write_index(rows)
    return _indexes[key]


def bm25(spark, sf_dir, k=100, rows=None, keep=None) -> DataFrame:
    """Ranked documents of all questions."""
    return scored(docs(spark, sf_dir) if rows is None else rows, questions(spark, sf_dir).select("query_id", "text"), k, keep, index=index(spark, sf_dir))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def questions(spark, sf_dir) -> DataFrame:
    """query_id, text and embedding (null without one)."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked.join(vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "embedding"), "query_id", "left")


def both_legs(spark, sf_dir):
    return legs(docs(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), Search(), index(spark, sf_dir))


@query(f"with {Q.ANALYZED} select doc_id, term, tf from tf")
def term_freq(spark, sf_dir):
    return P.term_frequencies(docs(spark, sf_dir))


@query(f"with {Q.ANALYZED} select doc_id, len(words)::bigint as doc_len from analyzed")
def doc_len(spark, sf_dir):
    return P.lengths(docs(spark, sf_dir))


@query(f"with {Q.ANALYZED} select term, df from df")
def df_stats(spark, sf_dir):
    return P.document_frequencies(P.term_frequencies(docs(spark, sf_dir)))


@query(f"with {Q.ANALYZED} select n_docs, total_len, avgdl from totals")
def corpus_stats(spark, sf_dir):
    return P.corpus_totals(P.lengths(docs(spark, sf_dir)))


@query(f"with {Q.ANALYZED} select doc_id, term, round({Q.TFW}, 6) as weight from tf join analyzed using (doc_id), totals")
def bm25_index_weights(spark, sf_dir):
    """The saturating half of each posting's score, with the average length as it is now."""
    rows = docs(spark, sf_dir)
    totals = P.corpus_totals(P.lengths(rows))
    weights = P.term_frequencies(rows).join(P.lengths(rows), "doc_id").join(F.broadcast(totals.select("avgdl")), how="cross")
    return weights.select("doc_id", "term", F.round(tf_weight(F.col("tf"), F.col("doc_len"), F.col("avgdl")), 6).alias("weight"))


@query(f"with {Q.ANALYZED} select term, df, round({Q.IDF}, 6) as idf from df, totals")
def bm25_idf(spark, sf_dir):
    rows = docs(spark, sf_dir)
    totals = P.corpus_totals(P.lengths(rows))
    weights = P.document_frequencies(P.term_frequencies(rows)).join(F.broadcast(totals), how="cross")
    return weights.select("term", "df", F.round(idf(F.col("df"), F.col("n_docs")), 6).alias("idf"))


@query(f"with {Q.sparse(100)} select query_id, doc_id, score, rank from sparse")
def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir)


@query(f"with {Q.dense(10)} select query_id, doc_id, score, rank from dense")
def dense_exact_topk(spark, sf_dir):
    return D.dense_topk(vectors(spark, sf_dir), questions(spark, sf_dir), 10)


@query(f"with {Q.dense(10, 'label in (1, 2)')} select query_id, doc_id, score, rank from dense")
def prefilter_topk(spark, sf_dir):
    """The filter holds before ranking: each question gets its full 10."""
    return D.dense_topk(vectors(spark, sf_dir), questions(spark, sf_dir), 10, F.col("label").isin(1, 2))


@query(f"with {Q.sparse(10, """analyzed.lang = 'en' and analyzed.source in ('src1', 'src2')""")} select query_id, doc_id, score, rank from sparse")
def prefilter_sparse(spark, sf_dir):
    """The filter restricts results, not the statistics."""
    rows = docs(spark, sf_dir).withColumns({"section": F.col("lang"), "ticker": F.col("source")})
    return bm25(spark, sf_dir, 10, rows, build_filter({"item": "en", "ticker": ["src1", "src2"], "tenant": None}))


@query("with r as (select vec_id, label, row_number() over (partition by label order by round(list_sum(embedding::double[]), 6) desc, vec_id) as k from embeddings) select label, vec_id, k::int as rank from r where k <= 5")
def rank_lists(spark, sf_dir):
    total = F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6)
    return ranked(vectors(spark, sf_dir).select("label", F.col("doc_id").alias("vec_id"), total.alias("total")), 5, "label", "vec_id", "total").drop("total")


@query(f"with {Q.sparse()}, {Q.dense()}, {Q.RRF} select query_id, doc_id, fused_score, fused_rank from rrf")
def rrf_fusion(spark, sf_dir):
    return rrf(both_legs(spark, sf_dir)).drop("source_ranks")


@query(f"with {Q.sparse()}, {Q.dense()}, {Q.RRF} select query_id, doc_id, dense_rank, sparse_rank from rrf")
def rrf_source_ranks(spark, sf_dir):
    found = rrf(both_legs(spark, sf_dir))
    return found.select("query_id", "doc_id", F.col("source_ranks")["dense"].alias("dense_rank"), F.col("source_ranks")["sparse"].alias("sparse_rank"))


@query(
    f"""with {Q.sparse()}, {Q.dense()}, {Q.RRF},
    b as (select *, min(score) over (partition by query_id, source) as lo, max(score) over (partition by query_id, source) as hi from lists),
    f as (select query_id, doc_id, round(sum(0.5e0 * case when hi = lo then 1e0 else (score - lo) / (hi - lo) end), 6) as fused_score, min(list * 1000000 + rank) as first from b group by all)
    select query_id, doc_id, fused_score, row_number() over (partition by query_id order by fused_score desc, first)::int as fused_rank from f"""
)
def weighted_fusion(spark, sf_dir):
    return weighted(both_legs(spark, sf_dir), {"dense": 0.5, "sparse": 0.5})


@query(
    f"""with {Q.dense(8)}, m as (select query_id, doc_id, v from dense join vectors using (doc_id))
    select a.query_id, a.doc_id as doc_a, b.doc_id as doc_b, round(list_dot_product(a.v, b.v), 6) as similarity from m a join m b on a.query_id = b.query_id and a.doc_id < b.doc_id"""
)
def pairwise_sim(spark, sf_dir):
    """All pairs within each question's candidates, which are few."""
    own = vectors(spark, sf_dir)
    hits = D.dense_topk(own, questions(spark, sf_dir), 8).select("query_id", "doc_id").join(own.select("doc_id", "embedding"), "doc_id")
    a, b = (hits.select("query_id", F.col("doc_id").alias(f"doc_{x}"), F.col("embedding").alias(x)) for x in "ab")
    return a.join(b, "query_id").where("doc_a < doc_b").select("query_id", "doc_a", "doc_b", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"with recursive {Q.sparse()}, {Q.dense()}, {Q.RRF}, {Q.MMR} select query_id, doc_id, mmr_rank from mmr")
def mmr_select(spark, sf_dir):
    s = Search()
    return diverse(fused(both_legs(spark, sf_dir), s), vectors(spark, sf_dir), s).select("query_id", "doc_id", "mmr_rank")


@query(f"with {Q.sparse()} select query_id, doc_id, rank, source, lang, md5(text) as text_md5 from sparse join documents using (doc_id) where rank <= 20")
def hydrate_hits(spark, sf_dir):
    """Texts are fetched for the hits alone."""
    hits = bm25(spark, sf_dir, 20).drop("score")
    full = hydrate(hits, docs(spark, sf_dir), ["text", "source", "lang"])
    return full.select("query_id", "doc_id", "rank", "source", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"with recursive {Q.sparse()}, {Q.dense()}, {Q.RRF}, {Q.MMR}, {Q.HYDRATED} select query_id, doc_id, rerank_score, rerank_rank from reranked where rerank_rank <= 5")
def rerank_topk(spark, sf_dir):
    """With the stand-in scorer (shared terms)."""
    s, rows = Search(), docs(spark, sf_dir)
    chosen = diverse(fused(both_legs(spark, sf_dir), s), vectors(spark, sf_dir), s)
    full = hydrate(chosen, rows, ["text"]).join(questions(spark, sf_dir).select("query_id", F.col("text").alias("question")), "query_id")
    return M.rerank(full, M.overlap_score(F.col("question"), F.col("text")), "mmr_rank").select("query_id", "doc_id", "rerank_score", "rerank_rank")


def _context_candidates(spark, sf_dir):
    rows, own = docs(spark, sf_dir), vectors(spark, sf_dir)
    hits = bm25(spark, sf_dir, 20)
    full = hydrate(hits, rows, ["text", "source", "lang"]).join(own.select("doc_id", "embedding"), "doc_id", "left")
    label = T.citation_label(F.col("source"), F.col("lang"), F.lit(None).cast("string"))
    return full.withColumns({"n_tokens": T.token_estimate(F.lit(None).cast("int"), F.col("text")), "label": label})


_CONTEXT = f"with recursive {Q.sparse(20)}, {Q.dense(1)}, hits as (select s.*, d.text, d.source, d.lang, v, rank as place from sparse s join documents d using (doc_id) left join vectors using (doc_id)), {Q.context('hits', 'score', 3000)}"


@query(f"{_CONTEXT} select * from context")
def context_build(spark, sf_dir):
    """The rules in their order, with a budget small enough that all of them drop something."""
    return M.build_context(_context_candidates(spark, sf_dir), "rank", 3000)


@query(f"{_CONTEXT} select query_id, max(context_tokens)::bigint as context_tokens, count(distinct source)::bigint as n_documents, count(*)::bigint as n_citations from context group by query_id")
def context_stats(spark, sf_dir):
    found = M.build_context(_context_candidates(spark, sf_dir), "rank", 3000)
    return found.groupBy("query_id").agg(F.max("context_tokens").cast("long").alias("context_tokens"), F.count_distinct("source").alias("n_documents"), F.count("*").alias("n_citations"))


@query(f"with {Q.sparse(50)}, c as (select s.query_id, s.doc_id, d.source, row_number() over (partition by query_id, d.source order by rank)::int as nth from sparse s join documents d using (doc_id)) select * from c where nth <= 3")
def doc_cap(spark, sf_dir):
    """At most three hits of a document, by rank alone."""
    hits = hydrate(bm25(spark, sf_dir, 50), docs(spark, sf_dir), ["source"])
    nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))
    return hits.withColumn("nth", nth).where("nth <= 3").select("query_id", "doc_id", "source", "nth")


_HYBRID = f"with recursive {Q.sparse()}, {Q.dense()}, {Q.RRF}, {Q.MMR}, {Q.HYDRATED}, top as (select *, rerank_rank as place from reranked where rerank_rank <= 5), {Q.context('top', 'rerank_score')}"


@query(f"{_HYBRID} select *, '' as degraded from context")
def hybrid_search(spark, sf_dir):
    """The whole read path for all questions at once."""
    return search(docs(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), index=index(spark, sf_dir))


@query(
    f"with recursive {Q.sparse()}, {Q.dense(1)}, one as (select query_id, doc_id, round(1e0 / (60 + rank), 9) as fused_score, rank as fused_rank, v from sparse left join vectors using (doc_id)),"
    f" top as (select o.query_id, o.doc_id, o.fused_score, fused_rank as place, d.text, d.source, d.lang, v from one o join documents d using (doc_id) where fused_rank <= 5), {Q.context('top', 'fused_score')}"
    " select *, 'dense_unavailable,rerank_unavailable' as degraded from context"
)
def degraded_sparse_only(spark, sf_dir):
    """Without vectors and reranker the sparse list goes on alone, and the result says so."""
    s = Search(dense=False, reranker=False, diverse=False)
    return search(docs(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), s, index(spark, sf_dir))


@query(f"with {Q.sparse()}, {Q.dense()}, {Q.RRF} select query_id, doc_id, round(fused_score, 5) as fused_score, fused_rank from rrf where fused_rank <= 10")
def debug_panel(spark, sf_dir):
    found = rrf(both_legs(spark, sf_dir)).where("fused_rank <= 10")
    return found.select("query_id", "doc_id", F.round("fused_score", 5).alias("fused_score"), "fused_rank")


@query(
    f"""with {Q.dense(1)}, codes as (select doc_id, v, list_transform(v, lambda x: round(x * 127e0)::int) as c from vectors),
    qs as (select query_id, q, list_transform(q, lambda x: round(x * 127e0)::int) as qc from questions),
    pool as (select * from (select query_id, doc_id, v, q, row_number() over (partition by query_id order by list_dot_product(c::double[], qc::double[]) desc, doc_id) as k from qs, codes) where k <= 20),
    s as (select query_id, doc_id, round(list_dot_product(v, q), 6) as score from pool)
    select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s) where rank <= 10"""
)
def dense_int8_rescore(spark, sf_dir):
    """Codes of 8 bits choose twice as many candidates, exact cosines rank them."""
    unit = V.normalized(F.col("embedding"))
    return D.int8_topk(vectors(spark, sf_dir).withColumn("embedding", unit), questions(spark, sf_dir).withColumn("embedding", unit), 10)


@query(
    f"""with {Q.dense(1)}, d as (select query_id, doc_id, len(list_filter(list_zip(v, q), lambda x: (x[1] > 0) <> (x[2] > 0)))::bigint as distance from questions, vectors)
    select * from (select *, row_number() over (partition by query_id order by distance, doc_id)::int as rank from d) where rank <= 10"""
)
def dense_binary_hamming(spark, sf_dir):
    return D.hamming_topk(vectors(spark, sf_dir), questions(spark, sf_dir), 10)


def _ivf(spark, sf_dir, cells=16):
    own = vectors(spark, sf_dir)
    centres = D.centroids(own, cells)
    return D.with_cells(own, centres), centres


@query()
def dense_ivf_topk(spark, sf_dir):
    index, centres = _ivf(spark, sf_dir)
    return D.ivf_topk(index, centres, questions(spark, sf_dir).where("embedding is not null"), 10, 8)


@query()
def dense_pq_topk(spark, sf_dir):
    return D.pq_topk(vectors(spark, sf_dir), questions(spark, sf_dir).where("embedding is not null"), 10)


@query()
def hash_embed(spark, sf_dir):
    """Vectors of the stand-in embedding model."""
    return docs(spark, sf_dir).select("doc_id", V.hash_embedding(64)("text").alias("embedding"))


@query()
def term_ids(spark, sf_dir):
    """Wire numbers of the vocabulary."""
    return P.document_frequencies(P.term_frequencies(docs(spark, sf_dir))).select("term", V.term_id("term").alias("term_id"))


@query(
    """select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as dot, round(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])), 6) as norm,
    round(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as cosine
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"""
)
def vector_math(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    both = a.join(b, "vec_id")
    return both.select("vec_id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(V.norm(F.col("a")), 6).alias("norm"), F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))
