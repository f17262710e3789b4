"""Quality of search, and consistency of the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import dense as D
from ..operators import evaluation as E
from ..operators.search import Search, diverse, fused, hydrate
from ..operators.selection import overlap_score, rerank
from ..operators.sparse import BROADCAST_TERMS
from ..storage import written
from . import retrieval as R
from . import sql as Q
from .registry import query, table

_GOLDEN = """golden as (select query_id, doc_id from (select item_id as query_id, doc_id, row_number() over (partition by item_id order by doc_id) as k from benchmark b join documents d on contains(d.text, b.text)) where k <= 60)"""


def relevant(spark, sf_dir):
    """query_id and doc_id: documents that hold a question's text, at most 60 for each, the first by doc_id.

    A question's rarest term has to occur in a document that holds the question, so only
    documents with that term are compared, not all pairs.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    inner = F.array_distinct(F.regexp_extract_all(F.col("phrase"), F.lit(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])"), 0))  # runs that are whole in the text too
    terms = asked.select("query_id", F.explode(inner).alias("term"))
    vocabulary = terms.select("term").distinct()
    if vocabulary.count() <= BROADCAST_TERMS:
        vocabulary = F.broadcast(vocabulary)
    runs = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z0-9]+"), 0))
    postings = d.select("doc_id", F.explode(runs).alias("term")).join(vocabulary, "term")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    rarest = terms.join(df, "term").groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("m")).select("query_id", F.col("m.term").alias("term"))
    pairs = rarest.join(postings, "term").select("query_id", "doc_id")
    found = pairs.join(asked, "query_id").join(d, "doc_id").where(F.contains("text", "phrase"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    return found.select("query_id", "doc_id", nth.alias("nth")).where("nth <= 60").drop("nth")


@query(f"with {_GOLDEN} select query_id, doc_id from golden")
def golden_labels(spark, sf_dir):
    return relevant(spark, sf_dir)


def configurations(spark, sf_dir):
    """Ranked lists of the four ways to search; what several of them use is written once."""
    s = Search()
    found = {name: written(leg, f"leg-{name}") for name, leg in R.both_legs(spark, sf_dir).items()}
    hybrid = written(fused(found, s), "fused")
    full = hydrate(diverse(hybrid, R.vectors(spark, sf_dir), s), R.docs(spark, sf_dir), ["text"]).join(R.questions(spark, sf_dir).select("query_id", F.col("text").alias("question")), "query_id")
    full = rerank(full, overlap_score(F.col("question"), F.col("text")), "mmr_rank", 20)
    return {
        "dense": found["dense"].select("query_id", "doc_id", "rank"), "sparse": found["sparse"].select("query_id", "doc_id", "rank"),
        "hybrid": hybrid.select("query_id", "doc_id", F.col("fused_rank").alias("rank")), "full": full.select("query_id", "doc_id", F.col("rerank_rank").alias("rank")),
    }


_LISTS = "all_lists as (select 'dense' as config, query_id, doc_id, rank from dense union all select 'sparse', query_id, doc_id, rank from sparse union all select 'hybrid', query_id, doc_id, fused_rank from rrf union all select 'full', query_id, doc_id, rerank_rank from reranked)"


@query(
    f"""with recursive {Q.sparse()}, {Q.dense()}, {Q.RRF}, {Q.MMR}, {Q.HYDRATED}, {_GOLDEN}, {_LISTS},
    firsts as (select config, query_id, min(rank) as f from all_lists join golden using (query_id, doc_id) group by all),
    m as (select config, query_id, f from (select * from (select distinct query_id from golden), (select unnest(['dense', 'sparse', 'hybrid', 'full']) as config)) left join firsts using (config, query_id))
    select config, count(*)::bigint as n_queries, round(avg((coalesce(f, 999) <= 1)::int), 4) as hit_1, round(avg((coalesce(f, 999) <= 5)::int), 4) as hit_5, round(avg((coalesce(f, 999) <= 10)::int), 4) as hit_10, round(avg(coalesce(1e0 / f, 0)), 4) as mrr from m group by config"""
)
def golden_metrics(spark, sf_dir):
    truth = written(relevant(spark, sf_dir), "relevant")
    rows = [E.mean_metrics(E.golden_metrics(found, truth)).withColumn("config", F.lit(name)) for name, found in configurations(spark, sf_dir).items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(f"with {Q.sparse()}, {_GOLDEN}, f as (select query_id, min(rank) as f from sparse join golden using (query_id, doc_id) group by query_id) select query_id, coalesce(1e0 / f, 0e0) as rr from (select distinct query_id from golden) left join f using (query_id)")
def mrr(spark, sf_dir):
    found = R.bm25(spark, sf_dir)
    return E.golden_metrics(found, relevant(spark, sf_dir)).select("query_id", "rr")


_INT8 = f"""{Q.dense(10)}, codes as (select doc_id, v, list_transform(v, lambda x: round(x * 127e0)::int) as c from vectors),
    pool as (select * from (select query_id, doc_id, v, q, row_number() over (partition by query_id order by list_dot_product(c::double[], list_transform(q, lambda x: round(x * 127e0)::int)::double[]) desc, doc_id) as k from questions, codes) where k <= 20),
    s8 as (select query_id, doc_id, round(list_dot_product(v, q), 6) as score from pool),
    found as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s8) where rank <= 10)"""


@query(
    f"""with {_INT8}, b as (select t.query_id, t.rank as tr, f.rank as fr from dense t left join found f using (query_id, doc_id))
    select query_id, round(count(*) filter (tr <= 1 and fr <= 1) / least(1, count(*))::double, 5) as recall_1, round(count(*) filter (tr <= 5 and fr <= 5) / least(5, count(*))::double, 5) as recall_5,
      round(count(*) filter (tr <= 10 and fr <= 10) / least(10, count(*))::double, 5) as recall_10, round(coalesce(max(case when tr = 1 then 1e0 / fr end), 0), 5) as rr from b group by query_id"""
)
def ann_recall(spark, sf_dir):
    """Of 8-bit search with rescoring, against exact search."""
    unit = V.normalized(F.col("embedding"))
    vectors, asked = R.vectors(spark, sf_dir), R.questions(spark, sf_dir)
    found = D.int8_topk(vectors.withColumn("embedding", unit), asked.withColumn("embedding", unit), 10)
    return E.ann_recall(found, D.dense_topk(vectors, asked, 10))


@query()
def nprobe_sweep(spark, sf_dir):
    """Recall of inverted lists by how many of 16 are probed."""
    vectors, asked = R.vectors(spark, sf_dir), R.questions(spark, sf_dir).where("embedding is not null")
    truth = written(D.dense_topk(vectors, asked, 10), "truth")
    centres = D.centroids(vectors, 16)
    index = written(D.with_cells(vectors, centres), "cells")
    rows = [E.ann_recall(D.ivf_topk(index, centres, asked, 10, n), truth).agg(F.round(F.avg("recall_10"), 4).alias("recall_10")).withColumn("nprobe", F.lit(n)) for n in (1, 4, 8, 16)]
    return reduce(lambda a, b: a.unionByName(b), rows)


_LEVELS = {"all": "true", "label": "label = 3", "label_and_id": "label = 3 and doc_id % 4 = 0", "none": "label = -1"}


@query("with v as (select vec_id as doc_id, label from embeddings) " + " union all ".join(f"select '{n}' as level, round(avg(({c})::int), 5) as match_share, count(*) filter ({c})::bigint as n_match from v" for n, c in _LEVELS.items()))
def filter_selectivity(spark, sf_dir):
    """The share of vectors that each filter keeps, in one pass."""
    rows = R.vectors(spark, sf_dir).select("doc_id", "label")
    parts = [x for n, c in _LEVELS.items() for x in (F.round(F.avg(F.expr(c).cast("int")), 5).alias(f"s_{n}"), F.count_if(F.expr(c)).alias(f"n_{n}"))]
    one = rows.agg(*parts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"s_{n}").alias("match_share"), F.col(f"n_{n}").alias("n_match")) for n in _LEVELS])))


@query()
def filtered_recall(spark, sf_dir):
    """Recall and number of results of inverted lists under ever narrower filters, against exact search under the same filter."""
    vectors, asked = R.vectors(spark, sf_dir), R.questions(spark, sf_dir).where("embedding is not null")
    centres = D.centroids(vectors, 16)
    index = written(D.with_cells(vectors, centres), "cells")
    rows = []
    for name, condition in _LEVELS.items():
        own = vectors.where(condition)
        found = written(D.ivf_topk(index.join(own.select("doc_id"), "doc_id", "left_semi"), centres, asked, 10, 8), "filtered")
        recall = E.ann_recall(found, D.dense_topk(own, asked, 10)).agg(F.round(F.avg("recall_10"), 4).alias("recall_10"))
        rows.append(recall.join(found.agg(F.count("*").alias("n_returned")), how="cross").withColumn("level", F.lit(name)))  # one row each
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("select doc_id, 'missing' as kind from documents where doc_id not in (select vec_id from embeddings) union all select vec_id, 'stray' from embeddings where vec_id not in (select doc_id from documents)")
def index_drift(spark, sf_dir):
    return E.drift(table(spark, sf_dir, "documents"), R.vectors(spark, sf_dir), "doc_id")
