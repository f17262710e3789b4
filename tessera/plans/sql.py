"""Pieces of DuckDB SQL that several equivalents share: each is a list of common table expressions."""

from __future__ import annotations

from ..settings import DEFAULTS as S
from ..settings import STOPWORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def terms(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda t: not list_contains({STOP}, t))"


def unit(column: str) -> str:
    return f"list_transform({column}::double[], lambda x: x / sqrt(list_dot_product({column}::double[], {column}::double[])))"


ANALYZED = f"analyzed as (select doc_id, source, lang, {terms('text')} as words, text from documents), tf as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(words) as term from analyzed) group by all), totals as (select count(*)::bigint as n_docs, coalesce(sum(len(words)), 0)::bigint as total_len, sum(len(words))::double / count(*)::double as avgdl from analyzed), df as (select term, count(*)::bigint as df from tf group by term)"

IDF = "ln((n_docs - df + 0.5e0) / (df + 0.5e0) + 1e0)"
TFW = f"(tf * {S.k1 + 1}e0 / (tf + {S.k1}e0 * ({1 - S.b}e0 + {S.b}e0 * len(words) / avgdl)))"


def sparse(k: int = S.top_k_sparse, keep: str = "true") -> str:
    return f"""{ANALYZED},
    asked as (select distinct item_id as query_id, unnest({terms('text')}) as term from benchmark),
    sparse_scores as (select query_id, tf.doc_id, round(sum({IDF} * {TFW}), 6) as score
      from asked join df using (term) join tf using (term) join analyzed on analyzed.doc_id = tf.doc_id, totals where {keep} group by query_id, tf.doc_id),
    sparse as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from sparse_scores) where rank <= {k})"""


def dense(k: int = S.top_k_dense, keep: str = "true") -> str:
    return f"""vectors as (select vec_id as doc_id, {unit('embedding')} as v, label from embeddings),
    questions as (select item_id as query_id, text as question, v as q from benchmark join vectors on doc_id = item_id),
    dense_scores as (select query_id, vectors.doc_id, round(list_dot_product(v, q), 6) as score from questions, vectors where {keep}),
    dense as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from dense_scores) where rank <= {k})"""


RRF = f"""lists as (select query_id, doc_id, score, rank, 0 as list, 'dense' as source from dense union all select query_id, doc_id, score, rank, 1, 'sparse' from sparse),
    rrf_scores as (select query_id, doc_id, round(sum(1e0 / ({S.rrf_k} + rank)), 9) as fused_score, min(list * 1000000 + rank) as first, max(rank) filter (source = 'dense') as dense_rank, max(rank) filter (source = 'sparse') as sparse_rank from lists group by query_id, doc_id),
    rrf as (select *, row_number() over (partition by query_id order by fused_score desc, first)::int as fused_rank from rrf_scores)"""

MMR = f"""with_v as (select rrf.*, v from rrf left join vectors using (doc_id)),
    scaled as (select *, case when count(v) over (partition by query_id) = 0 then null else (fused_score - min(fused_score) filter (v is not null) over (partition by query_id)) / coalesce(nullif(max(fused_score) filter (v is not null) over (partition by query_id) - min(fused_score) filter (v is not null) over (partition by query_id), 0), 1) end as rel from with_v),
    steps as (
      select query_id, 1 as step, [fused_rank] as picked, [v] as vs from (select *, row_number() over (partition by query_id order by rel desc, fused_rank) as k from scaled where v is not null) where k = 1
      union all
      select query_id, step + 1, list_append(picked, fused_rank), list_append(vs, v) from (
        select steps.query_id, step, picked, vs, c.fused_rank, c.v, row_number() over (partition by steps.query_id order by
          round({S.mmr_lambda}e0 * c.rel - (1e0 - {S.mmr_lambda}e0) * list_max(list_transform(vs, lambda x: list_dot_product(x, c.v))), 9) desc, c.fused_rank) as k
        from steps join scaled c on c.query_id = steps.query_id and c.v is not null and not list_contains(picked, c.fused_rank) where step < {S.mmr_top_n}) where k = 1),
    picks as (select query_id, unnest(picked) as fused_rank, generate_subscripts(picked, 1) as mmr_rank from steps s where step = (select max(step) from steps t where t.query_id = s.query_id)),
    n_picks as (select q.query_id, count(p.fused_rank) as n from (select distinct query_id from rrf) q left join picks p using (query_id) group by all),
    tails as (select s.query_id, s.fused_rank, n + row_number() over (partition by s.query_id order by s.fused_rank) as mmr_rank from scaled s join n_picks using (query_id) where v is null),
    mmr as (select r.query_id, r.doc_id, r.fused_score, a.mmr_rank::int as mmr_rank from (select * from picks union all select * from tails where mmr_rank <= {S.mmr_top_n}) a join rrf r using (query_id, fused_rank))"""

HYDRATED = f"""hydrated as (select m.*, d.text, d.source, d.lang, b.text as question, v from mmr m join documents d using (doc_id) join benchmark b on b.item_id = m.query_id left join vectors using (doc_id)),
    overlap as (select *, case when len(list_distinct({terms('question')})) > 0 then round(len(list_intersect(list_distinct({terms('question')}), {terms('text')})) / len(list_distinct({terms('question')}))::double, 6) else 0e0 end as rerank_score from hydrated),
    reranked as (select *, row_number() over (partition by query_id order by rerank_score desc, mmr_rank)::int as rerank_rank from overlap)"""


def context(candidates: str, score: str, budget: int = S.max_context_tokens - S.context_reserve) -> str:
    """Citations of build_context from a table with query_id, doc_id, source, lang, text, v, place (1 to n without gaps)."""
    return f"""cands as (select query_id, doc_id, source, place, {score} as score, greatest(1, length(text) // 4)::int as n, source || ' | Item ' || lang || '.' as label, v from {candidates}),
    folds as (
      select query_id, 0 as pos, 0 as used, []::bigint[] as ids, []::varchar[] as docs, []::double[][] as vs, 0 as db, 0 as dc, 0 as dd from (select distinct query_id from cands)
      union all
      select query_id, pos + 1,
        case when ok = 0 then used + n else used end, case when ok = 0 then list_append(ids, place) else ids end,
        case when ok = 0 then list_append(docs, source) else docs end, case when ok = 0 and v is not null then list_append(vs, v) else vs end,
        db + (ok = 1)::int, dc + (ok = 2)::int, dd + (ok = 3)::int
      from (select folds.*, c.place, c.n, c.source, c.v, case when used + c.n > {budget} then 1
          when len(list_filter(docs, lambda x: x = c.source)) >= {S.per_document} then 2
          when c.v is not null and len(vs) > 0 and list_max(list_transform(vs, lambda x: list_dot_product(x, c.v))) >= {S.dedupe_threshold}e0 then 3 else 0 end as ok
        from folds join cands c on c.query_id = folds.query_id and c.place = folds.pos + 1)),
    ended as (select * from folds f where pos = (select max(pos) from folds g where g.query_id = f.query_id)),
    context as (select e.query_id, k.citation_id::int as citation_id, c.doc_id, c.source, round(c.score, 4) as score, c.n as n_tokens, c.label, e.used::int as context_tokens,
      len(list_distinct(e.docs))::int as n_documents, e.db::int as dropped_budget, e.dc::int as dropped_doc_cap, e.dd::int as dropped_duplicate
      from ended e, (select query_id, unnest(ids) as place, generate_subscripts(ids, 1) as citation_id from ended) k join cands c on c.query_id = k.query_id and c.place = k.place where k.query_id = e.query_id)"""
