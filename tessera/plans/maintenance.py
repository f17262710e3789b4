"""Versions, reconciliation, queues and state machines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import maintenance as M
from ..operators import postings as P
from . import sql as Q
from .registry import query, table

#: The clock of queries that depend on time.
AS_OF = datetime(2024, 1, 1, 12, 0, 0)


def versions(spark, sf_dir):
    """Two versions of the documents: of ten, one is new, one is gone and one has another text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    old = d.where("chunk_id % 10 != 1")
    new = d.where("chunk_id % 10 != 2").withColumn("text", F.when(F.col("chunk_id") % 10 == 3, F.concat("text", F.lit(" amended wording"))).otherwise(F.col("text")))
    hashed = lambda v: v.withColumn("content_sha256", T.content_hash(F.col("text")))
    return hashed(old), hashed(new)


_ACTION = "case doc_id % 10 when 1 then 'inserted' when 2 then 'deleted' when 3 then 'updated' else 'unchanged' end"
_NEW = "case when doc_id % 10 = 3 then text || ' amended wording' else text end"


@query(f"select doc_id as chunk_id, {_ACTION} as action from documents")
def reconcile(spark, sf_dir):
    return M.reconcile(*versions(spark, sf_dir))


_TERMS = f"""o as (select doc_id, unnest(list_distinct({Q.terms('text')})) as term from documents where doc_id % 10 <> 1),
n as (select doc_id, unnest(list_distinct({Q.terms(_NEW)})) as term from documents where doc_id % 10 <> 2),
d as (select term, -1 as d from o where doc_id % 10 in (2, 3) union all select term, 1 from n where doc_id % 10 in (1, 3)),
deltas as (select term, sum(d)::bigint as delta from d group by term having sum(d) <> 0)"""


def _deltas(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    terms = lambda v: P.term_frequencies(v, "chunk_id").drop("tf")
    return M.term_deltas(M.reconcile(old, new), terms(old), terms(new)), terms(old)


@query(f"with {_TERMS} select * from deltas")
def df_delta(spark, sf_dir):
    return _deltas(spark, sf_dir)[0]


@query(f"with {_TERMS}, df as (select term, count(*) as df from o group by term) select term, greatest(0, coalesce(df, 0) + coalesce(delta, 0))::bigint as df from df full join deltas using (term)")
def df_after_reconcile(spark, sf_dir):
    deltas, old = _deltas(spark, sf_dir)
    return M.apply_term_deltas(P.document_frequencies(old), deltas)


@query(
    f"""with l as (select doc_id, {_ACTION} as action, len({Q.terms('text')}) as a, len({Q.terms(_NEW)}) as b from documents)
    select coalesce(sum(case action when 'inserted' then 1 when 'deleted' then -1 else 0 end), 0)::bigint as n_delta,
      coalesce(sum(case action when 'inserted' then b when 'deleted' then -a when 'updated' then b - a else 0 end), 0)::bigint as len_delta from l"""
)
def reconcile_deltas(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return M.corpus_delta(M.reconcile(old, new), P.lengths(old, "chunk_id"), P.lengths(new, "chunk_id"))


@query(f"with {Q.ANALYZED}, gone as (select term, count(*) as n from tf join documents using (doc_id) where documents.source = 'src1' group by term) select term, greatest(0, df - coalesce(n, 0))::bigint as df from df left join gone using (term)")
def df_decrement(spark, sf_dir):
    """Frequencies after a document is deleted."""
    d = table(spark, sf_dir, "documents")
    terms = P.term_frequencies(d)
    gone = terms.join(d.where("source = 'src1'").select("doc_id"), "doc_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("delta"))
    return M.apply_term_deltas(P.document_frequencies(terms), gone)


@query(
    """select 'chunks' as name, count(*)::bigint as n from documents where source <> 'src1' union all
    select 'vectors', count(*) from embeddings join documents on doc_id = vec_id where source <> 'src1' union all
    select 'labels', count(*) from labels join documents using (doc_id) where source <> 'src1'"""
)
def cascade_delete(spark, sf_dir):
    """What's left of each child table."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    left = d.where("source != 'src1'")
    found = M.cascade(left, {"vectors": vectors, "labels": table(spark, sf_dir, "labels").select("doc_id")}, "doc_id")
    count = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("chunks", left).unionByName(count("vectors", found["vectors"])).unionByName(count("labels", found["labels"]))


@query("select doc_id as chunk_id, doc_id % 7 = 0 as tombstone from documents where source = 'src1'")
def delete_document(spark, sf_dir):
    """Chunks of a deleted document; those that were indexed (here every seventh) leave a tombstone."""
    d = table(spark, sf_dir, "documents").where("source = 'src1'")
    return d.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 7 == 0).alias("tombstone"))


_MODEL = "case when vec_id % 3 = 0 then null when vec_id % 3 = 1 then 'old' else 'new' end"


@query(f"select doc_id as chunk_id from documents left join (select vec_id, {_MODEL} as model from embeddings) on vec_id = doc_id where vec_id is null or model is distinct from 'new'")
def stale_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    model = F.when(F.col("vec_id") % 3 == 1, "old").when(F.col("vec_id") % 3 == 2, "new")
    vectors = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"), model.alias("model"))
    return M.stale(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), vectors, "new")


@query("select doc_id as chunk_id, round(case when vec_id is null or vec_id % 2 = 1 then doc_id else list_sum(embedding::double[]) end, 6) as value from documents left join embeddings on vec_id = doc_id")
def vector_backfill(spark, sf_dir):
    """New values where there are some, old ones elsewhere."""
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("double").alias("value"))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    new = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("chunk_id"), total.alias("value"))
    return M.backfill(old, new, "chunk_id", "value").withColumn("value", F.round("value", 6))


@query("with c as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_type = 'signup') select c_custkey as id, coalesce(event_id, -1) as event_id from customer left join c on user_id = c_custkey and k = 1 union all select user_id, event_id from c where k = 1 and user_id not in (select c_custkey from customer)")
def index_upsert(spark, sf_dir):
    """Of several changes of a key the last counts."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("event_id"))
    changes = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("id"), "event_id", "ts")
    return M.upsert_latest(base, changes, "id", ["ts", "event_id"])


@query("select c_custkey as id from customer where c_custkey not in (select user_id from events where event_type = 'error')")
def index_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"))
    return M.delete(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), gone, "id")


@query("select url, max(page_id) as document_id, count(*)::bigint as n_jobs from (select 'u' || page_id % 40 as url, page_id from pages) group by url")
def register_upsert(spark, sf_dir):
    """Registering an address again updates its document, and always adds a job."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("u"), (F.col("page_id") % 40).cast("string")).alias("url"), F.col("page_id").alias("document_id"))
    none = p.limit(0)
    jobs = p.groupBy("url").agg(F.count("*").alias("n_jobs"))
    return M.upsert_latest(none, p, "url", ["document_id"]).join(jobs, "url")


def outbox(spark, sf_dir):
    """Events as an outbox: id, chunk_id, status, attempts, created_at."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("view", "click"), "pending").when(F.col("event_type") == "signup", "processing").when(F.col("event_type") == "error", "failed").otherwise("synced")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("chunk_id"), status.alias("status"), (F.col("event_id") % 12).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("created_at"))


_OUTBOX = "outbox as (select event_id as id, user_id as chunk_id, case when event_type in ('view', 'click') then 'pending' when event_type = 'signup' then 'processing' when event_type = 'error' then 'failed' else 'synced' end as status, (event_id % 12)::int as attempts, ts as created_at from events)"


@query(f"with {_OUTBOX} select id, chunk_id from outbox where status = 'pending' and attempts < 10")
def queue_eligible(spark, sf_dir):
    return outbox(spark, sf_dir).where((F.col("status") == "pending") & (F.col("attempts") < 10)).select("id", "chunk_id")


@query(f"with {_OUTBOX} select id, chunk_id, 'processing' as status, attempts + 1 as attempts from outbox where status = 'pending' and attempts < 10 order by id limit 500")
def claim_batch(spark, sf_dir):
    return M.claim(outbox(spark, sf_dir), 500, 10).drop("created_at")


@query(f"with {_OUTBOX} select distinct doc_id as chunk_id from documents join embeddings on vec_id = doc_id where doc_id not in (select chunk_id from outbox where status = 'pending')")
def outbox_enqueue(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"))
    return M.enqueue(d.join(vectors, "chunk_id", "left"), outbox(spark, sf_dir))


@query(f"with {_OUTBOX} select vec_id as chunk_id from embeddings where vec_id not in (select chunk_id from outbox where status = 'pending')")
def requeue_all(spark, sf_dir):
    """Every indexed chunk again, but for those that wait already."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"))
    return M.enqueue(vectors, outbox(spark, sf_dir))


@query(f"with {_OUTBOX} select o.id, o.chunk_id, d.source, q.quality from outbox o join documents d on d.doc_id = o.chunk_id join embeddings on vec_id = o.chunk_id join labels q on q.doc_id = o.chunk_id where status = 'pending'")
def outbox_details(spark, sf_dir):
    """Four tables joined by chunk: what a batch of the outbox needs."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return outbox(spark, sf_dir).where("status = 'pending'").select("id", "chunk_id").join(d, "chunk_id").join(e, "chunk_id").join(q, "chunk_id").select("id", "chunk_id", "source", "quality")


@query(
    """with ops as (select event_id as seq, user_id as id, case when event_type = 'error' then 'delete' else 'upsert' end as op, value from events),
    last as (select *, row_number() over (partition by id order by seq desc) as k from ops)
    select id, round(value, 6) as value from last where k = 1 and op = 'upsert' union all select c_custkey, 0e0 from customer where c_custkey not in (select id from ops)"""
)
def outbox_drain(spark, sf_dir):
    """The index after all operations: of each key the last one counts."""
    index = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("value"))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    ops = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), op.alias("op"), F.round("value", 6).alias("value"))
    return M.drained(index, ops, "id")


@query("select event_id, case when regexp_matches(json_extract_string(props, '$.k') || case when event_id % 97 = 0 then 'x' else '' end, '^[0-9]+$') then 'good' else 'poison' end as outcome from events")
def poison_isolation(spark, sf_dir):
    """Rows that can't be read are told apart one by one; the others of their batch go on."""
    raw = F.concat(F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 97 == 0, "x").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", F.when(raw.try_cast("int").isNotNull(), "good").otherwise("poison").alias("outcome"))


@query(f"with {_OUTBOX} select id, case when attempts + 1 >= 10 then 'failed' else 'pending' end as status, attempts + 1 as attempts from outbox where status = 'processing'")
def retry_deadletter(spark, sf_dir):
    """The outbox after all claimed rows fail once more."""
    rows = outbox(spark, sf_dir).where("status = 'processing'")
    return rows.select("id", M.after_failure(F.col("attempts"), 10).alias("status"), (F.col("attempts") + 1).alias("attempts"))


@query(f"with {_OUTBOX} select id, case when status = 'processing' and created_at < timestamp '2024-01-01 12:00:00' - interval 5 minutes then 'pending' else status end as status from outbox")
def stale_reset(spark, sf_dir):
    stale = (F.col("status") == "processing") & M.overdue(F.col("created_at"), 5, AS_OF)
    return outbox(spark, sf_dir).select("id", F.when(stale, "pending").otherwise(F.col("status")).alias("status"))


def jobs(spark, sf_dir):
    o = outbox(spark, sf_dir)
    return o.select("id", "chunk_id", "status", (F.col("attempts") % 5).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("worker_id"), F.col("created_at").alias("started_at"))


_STUCK = "status = 'processing' and created_at < timestamp '2024-01-01 12:00:00' - interval 30 minutes"


@query(f"with {_OUTBOX} select id, case when {_STUCK} and attempts % 5 >= 3 then 'dead' when {_STUCK} then 'pending' else status end as status, case when {_STUCK} then ' [reaped: stuck over 30 min]' end as last_error from outbox")
def reap_stuck(spark, sf_dir):
    return M.reap(jobs(spark, sf_dir), AS_OF).select("id", "status", "last_error")


@query(f"with {_OUTBOX} select id, case when id % 2 = 0 and status = 'processing' and id % 3 = 1 then 'done' else status end as status, case when id % 2 = 0 then status = 'processing' and id % 3 = 1 end as applied from outbox")
def fenced_finish(spark, sf_dir):
    """Worker w1 reports on every other job; only those that it still holds change."""
    own = jobs(spark, sf_dir)
    results = own.where("id % 2 = 0").select("id", F.lit("w1").alias("worker_id"), F.lit("done").alias("outcome"))
    return M.fenced_finish(own, results).select("id", "status", "applied")


@query("select source as shard from documents group by source having min(doc_id) % 2 = 1")
def resume_todo(spark, sf_dir):
    """Shards without a marker of completion."""
    shards = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("shard")).agg(F.min("doc_id").alias("m"))
    done = shards.where("m % 2 = 0").select("shard")
    return shards.select("shard").join(done, "shard", "left_anti")
