"""Operators on small inputs with known results."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import backfill, chunking, evaluation, fusion, generation, maintenance, monitoring, postings, selection, sparse
from tessera.operators import dense as D
from tessera.operators.breaker import CircuitBreaker, CircuitOpen
from tessera.operators.filters import InvalidFilter, build_filter, validate_request
from tessera.operators.html import item_sections, page_text
from tessera.operators.search import RetrievalUnavailable, Search, context_text, legs, prompt, search, standing
from tessera.settings import ITEMS, STOPWORDS, Settings
from tessera.sources import files
from tessera.streaming import outbox


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_terms_and_weights(spark):
    assert one(spark, T.terms(F.col("t")), t="The 10-K of ACME, the Risk & the risk") == ["10", "k", "acme", "risk", "risk"]
    assert len(STOPWORDS) == 27
    tf, dl, avgdl, n, df = 3, 120, 100.0, 50, 4
    closed = math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    got = one(spark, sparse.idf(F.lit(df), F.lit(n)) * sparse.tf_weight(F.lit(tf), F.lit(dl), F.lit(avgdl)))
    assert abs(got - closed) < 1e-9
    weight = lambda tf, dl, avgdl=100.0: one(spark, sparse.tf_weight(F.lit(tf), F.lit(dl), F.lit(avgdl)))
    assert weight(2, 100) > weight(1, 100) and weight(2, 100) - weight(1, 100) > weight(9, 100) - weight(8, 100)
    assert weight(2, 50) > weight(2, 200) and weight(2, 7, 0.0) == weight(2, 100)


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, None), (4, "gamma")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta alpha"), (2, "nothing shared"), (3, "the of")], "query_id long, text string")
    got = sparse.bm25_topk(docs, asked).collect()
    assert {r.query_id for r in got} == {1} and {r.doc_id for r in got} == {1, 2}
    assert sparse.bm25_topk(docs.limit(0), asked).count() == 0
    assert postings.corpus_totals(postings.lengths(docs.limit(0))).first()["avgdl"] == 0.0


def lists(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_rrf(spark):
    a, b = lists(spark, (1, 10, 9.0, 1), (1, 20, 8.0, 2)), lists(spark, (1, 20, 1.0, 1), (1, 10, 0.5, 2), (1, 30, 0.1, 3))
    got = {r.doc_id: r for r in fusion.rrf({"dense": a, "sparse": b}).collect()}
    assert got[10].fused_score == got[20].fused_score == round(1 / 61 + 1 / 62, 9)
    assert [d for d, _ in sorted(got.items(), key=lambda x: x[1].fused_rank)] == [10, 20, 30]
    assert got[10].source_ranks == {"dense": 1, "sparse": 2} and got[30].source_ranks == {"sparse": 3}


def test_weighted(spark):
    a, b = lists(spark, (1, 10, 9.0, 1), (1, 20, 8.0, 2)), lists(spark, (1, 20, 1.0, 1), (1, 10, 0.5, 2))
    got = {r.doc_id: r.fused_score for r in fusion.weighted({"d": a, "s": b}, {"d": 0.5, "s": 0.5}).collect()}
    assert got[10] == got[20] == 0.5
    alone = fusion.weighted({"d": lists(spark, (1, 10, 3.0, 1)), "s": b.limit(0)}, {"d": 0.4, "s": 0.6}).collect()
    assert alone[0].fused_score == 0.4


def test_mmr():
    score, near = [1.0, 0.99, 0.5], [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]]
    assert selection.mmr_order(np.array(score), near, 2, 0.5) == [0, 2]
    assert selection.mmr_order(np.array(score), near, 3, 1.0) == [0, 1, 2]
    assert selection.mmr_order(np.array(score), [None, [1.0, 0.0], None], 3, 0.7) == [1, 0, 2]
    assert selection.mmr_order(np.array(score), [None] * 3, 2, 0.7) == [0, 1]
    assert selection.mmr_order(np.array([0.2, 0.2]), [[0.0, 0.0], [1.0, 0.0]], 2, 0.7) == [0, 1]


def test_context_rules():
    rows = [(60, "a", None)] * 5
    assert selection.pick(rows, 100, 3, 0.95) == ([0], {"budget": 4, "doc_cap": 0, "duplicate": 0})
    rows = [(1, "a", None)] * 5
    assert selection.pick(rows, 100, 3, 0.95) == ([0, 1, 2], {"budget": 0, "doc_cap": 2, "duplicate": 0})
    rows = [(1, "a", [1.0, 0.0]), (1, "b", [0.999, 0.01]), (1, "c", [0.0, 1.0]), (200, "d", None), (1, "e", None)]
    assert selection.pick(rows, 100, 3, 0.95) == ([0, 2, 4], {"budget": 1, "doc_cap": 0, "duplicate": 1})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from("ab"), st.sampled_from([None, (1.0, 0.0), (0.0, 2.0), (0.0, 0.0)])), max_size=12), st.integers(0, 120))
def test_context_keeps_its_bounds(rows, budget):
    """No citation can be added back, and none breaks a rule."""
    chosen, dropped = selection.pick(rows, budget, 2, 0.95)
    assert len(chosen) + sum(dropped.values()) == len(rows) and sum(rows[i][0] for i in chosen) <= budget
    assert all(sum(rows[i][1] == d for i in chosen) <= 2 for d in "ab")
    vectors = [rows[i][2] for i in chosen if rows[i][2] and any(rows[i][2])]
    assert len(vectors) == len(set(vectors))


def test_hash_embedding_in_single_precision(spark):
    seed = int.from_bytes(hashlib.sha256(b"text").digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(16).astype(np.float32)
    got = spark.createDataFrame([("text",)], "t string").select(V.hash_embedding(16)("t").alias("e")).first().e
    assert np.array_equal(np.array(got, np.float32), v / np.linalg.norm(v))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=30), st.integers(60, 200), st.integers(0, 50))
def test_packing_terminates_and_loses_nothing(sizes, budget, overlap):
    units = [[f"{k}.{j}" for j in range(n)] for k, n in enumerate(sizes)]
    parts = [p for u in units for p in (chunking.split_unit(u, budget, overlap) if len(u) > budget else [u])]
    windows = chunking.pack_units(parts, budget, overlap)
    assert {w for win in windows for w in win} == {w for u in units for w in u}
    assert all(0 < len(w) <= budget for w in windows)


def test_packing():
    units = lambda *n: [[f"{k}.{j}" for j in range(x)] for k, x in enumerate(n)]
    assert len(chunking.pack_units(units(*[500] * 5), 512, 64)) == 5
    assert [len(w) for w in chunking.pack_units(units(200, 200, 200), 512, 64)] == [400, 264]
    windows = chunking.pack_units(units(500, 60, 500), 512, 64)
    assert windows[0][-1] == "0.499" and windows[1][0] == "0.436" and windows[2][0] == "2.0"
    assert chunking.split_unit([], 10, 2) == []


def test_sections():
    body = "\n".join(f"Item {n}. {re.sub(r'[^A-Za-z ]', '', t)}\nbody of {n}\n" for n, _, t, _ in ITEMS if n in ("1", "1A", "3"))
    text = "Item 1. Business 3\nItem 1A. Risk Factors 9\nItem 3. Legal Proceedings 20\n\n" + body + "\nRefer to Item 1A. Risk Factors above."
    found = dict(item_sections(text))
    assert list(found) == ["1", "1A", "3"] and "body of 1A" in found["1A"] and "body of 3" in found["3"] and "body of 3" not in found["1A"]
    assert [i for i, _ in item_sections("ITEM 1:  business\nItem 1A — Risk  Factors\nItem 2. Properties")] == ["1", "1A", "2"]
    assert item_sections("") == [] == item_sections(None) == item_sections("no headings")


def test_html():
    page = "<!doctype html><html><head><title>T</title><style>x{}</style><script>var a='<p>';</script></head><body><!-- no --><p>RIS<span>K</span> &amp; more<table><tr><td>1</td><td>2</td></tr></table>a<br>b&nbsp; c</body></html>"
    text = page_text(page)
    assert "RISK & more" in text and "1 2" in text and "a\nb c" in text and "var a" not in text and "no" not in text.split() and text.startswith("T")
    assert page_text(None) is None and page_text("") == ""
    assert page_text("<ul><li>One<li>Two</ul>x").split() == ["One", "Two", "x"]
    assert page_text("<table><tr><td>a<td>b<tr><td>c</table>d").split() == ["a", "b", "c", "d"] and page_text("<td>a<td>b<tr><td>c") == "a b c"
    assert page_text("<table><tr><td><p>x<td>y<ul><li>q<li>r</ul><tr><th>z</table>").split() == ["x", "yq", "r", "z"]  # a block ends a line, it does not begin one
    assert page_text("<p>a<p>b<div>c</div>d") == "a\nb\nc\nd" and page_text("a</p>b</div>c") == "a\nbc" and page_text("RIS<span>K</b></span>S") == "RISKS"


def test_text_functions(spark):
    assert one(spark, T.sentences(F.col("t")), t="Acme Inc. Was here. So it is! \n\n Next one (yes). 5 more") == ["Acme Inc.", "Was here.", "So it is!", "Next one (yes).", "5 more"]
    assert one(spark, T.cleaned(F.col("t")), t="Apple | 2025 Form 10-K | 18 a  b\n\n\n\nPART I Item 1\n 12 \nend") == "a b\n\nItem 1\n\nend"
    assert one(spark, T.content_hash(F.col("t")), t=" A  b\n") == hashlib.sha256(b"a b").hexdigest()
    name = "default|gs://b/x#item=1A&i=0&cfg=" + Settings().fingerprint()
    assert one(spark, T.name_uuid(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, T.chunk_id(F.lit("default"), F.lit("gs://b/x"), F.lit("1A"), F.lit(0))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, T.uri_parts(F.col("t")), t="gs://b/filings/320193/0001/a.htm").asDict() == {"cik": "320193", "accession": "0001", "document": "a.htm"}
    assert one(spark, T.uri_parts(F.col("t")), t="x.htm").asDict() == {"cik": None, "accession": None, "document": "x.htm"}
    assert one(spark, T.token_estimate(F.lit(None).cast("int"), F.lit("abcdefgh"))) == 2 and one(spark, T.token_estimate(F.lit(0), F.lit("a"))) == 1
    assert one(spark, T.citation_label(F.lit("Doc"), F.lit("1A"), F.lit("Risk"))) == "Doc | Item 1A. Risk"
    none = F.lit(None).cast("string")
    assert one(spark, T.header(F.lit(""), none, F.lit("77"), none, none, F.lit("2024-01-02"), F.lit("1"), F.lit("Business"))) == "77 (77) 10-K 2024-01-02 - Item 1. Business"
    assert [len(w) for w in one(spark, T.hard_split(T.tokens(F.col("t")), 4, 1), t="a b c d e f g h")] == [4, 4, 2]


def test_vector_functions(spark):
    zero, x = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.cosine(zero, x)) == 0.0 and one(spark, V.norm(x)) == 5.0 and one(spark, V.normalized(zero)) == [0.0, 0.0]
    got = spark.createDataFrame([("risk",), (None,)], "t string").select(V.term_id("t").alias("x")).collect()
    assert got[0].x == int.from_bytes(hashlib.blake2b(b"risk", digest_size=4).digest(), "big") & 0x7FFFFFFF and got[1].x is None
    rows = [r.e for r in spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(V.hash_embedding(8)("t").alias("e")).collect()]
    assert rows[0] == rows[1] != rows[2] and abs(sum(v * v for v in rows[0]) - 1) < 1e-5


def test_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    vectors = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(300)] + [(999, None)], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [float(v) for v in x[q]]) for q in (3, 4)], "query_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: np.lexsort((np.arange(300), -np.round(unit @ unit[q], 6)))[:5].tolist() for q in (3, 4)}

    def by_query(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
            out.setdefault(r.query_id, []).append(r.doc_id)
        return out

    assert by_query(D.dense_topk(vectors, asked, 5)) == want
    normal = lambda df: df.withColumn("embedding", V.normalized(F.col("embedding")))
    assert by_query(D.int8_topk(normal(vectors), normal(asked), 5)) == want
    assert by_query(D.pq_topk(vectors, asked, 5, parts=8, oversampling=30)) == want
    centres = D.centroids(vectors, 4)
    assert by_query(D.ivf_topk(D.with_cells(vectors, centres), centres, asked, 5, 4)) == want
    assert D.dense_topk(vectors, asked.limit(0), 5).count() == 0
    with pytest.raises(Exception, match="expected 4 dimensions"):
        D.assert_dimension(vectors, 4).count()


def test_dense_many_questions_and_components(spark):
    """More questions than a batch holds, ties across tasks, and signs beyond the first 64."""
    rng = np.random.default_rng(4)
    x = rng.integers(-1, 2, size=(90, 5)).astype(float)
    x[x.any(axis=1) == 0, 0] = 1.0
    q = rng.normal(size=(5000, 5))
    vectors = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(90)], "doc_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(k, [float(v) for v in q[k]]) for k in range(5000)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(unit(q) @ unit(x).T, 6)
    want = {(k, int(i), r + 1) for k in range(5000) for r, i in enumerate(np.lexsort((np.arange(90), -score[k]))[:3])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in D.dense_topk(vectors, asked, 3).collect()} == want
    centres = D.centroids(vectors, 4)
    found = D.ivf_topk(D.with_cells(vectors, centres), centres, asked, 3, 4)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in found.collect()} == want
    signs = rng.choice([-1.0, 1.0], size=(30, 100))
    wide = spark.createDataFrame([(k, [float(v) for v in signs[k]]) for k in range(30)], "doc_id long, embedding array<double>").repartition(2)
    differ = (signs[:, None] != signs[None]).sum(axis=2)
    got = {(r.query_id, r.doc_id): r.distance for r in D.hamming_topk(wide, wide.withColumnRenamed("doc_id", "query_id"), 4).collect()}
    assert got == {(a, int(b)): differ[a, b] for a in range(30) for b in np.lexsort((np.arange(30), differ[a]))[:4]}


def test_filters(spark):
    rows = spark.createDataFrame([(1, "1A", "x", True, ["p"], "2024-01-01"), (2, "7", "y", False, ["q", "r"], None)], "document_id long, section string, ticker string, is_narrative boolean, tags array<string>, filing_date string")
    rows = rows.withColumn("filing_date", F.col("filing_date").cast("timestamp"))
    keep = lambda **f: {r.document_id for r in rows.where(build_filter(f)).collect()}
    assert build_filter(None) is None and build_filter({"ticker": None, "tags": []}) is None
    assert keep(item="1A") == {1} and keep(section=["7", "8"]) == {2} and keep(section=[]) == set() and keep(is_narrative=False) == {2}
    assert keep(tags=["r", "z"]) == {2} and keep(date_after="2024-01-01") == {1} and keep(date_before="2023-12-31") == set()
    with pytest.raises(InvalidFilter, match="unknown"):
        build_filter({"colour": 1})
    for bad in ({"query": ""}, {"query": "x" * 4001}, {"query": "x", "top_k": 51}, {"query": "x", "ef_search": 3}):
        with pytest.raises(ValueError):
            validate_request(**bad)
    validate_request("x")


def corpus(spark):
    docs = spark.createDataFrame([(k, f"common words alpha{k} beta{k % 3}", f"s{k % 4}", "en") for k in range(40)], "doc_id long, text string, source string, lang string")
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=4)]) for k in range(30)], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "alpha7 beta1", [1.0, 0.0, 0.0, 0.0])], "query_id long, text string, embedding array<double>")
    return docs, vectors, asked


def test_search_and_degradation(spark):
    docs, vectors, asked = corpus(spark)
    full = search(docs, vectors, asked).collect()
    assert [r.citation_id for r in sorted(full, key=lambda r: r.citation_id)] == list(range(1, len(full) + 1))
    assert full[0].degraded == "" and 7 in {r.doc_id for r in full}
    alone = search(docs, vectors, asked, Search(dense=False, reranker=False)).collect()
    assert alone[0].degraded == "dense_unavailable,rerank_unavailable"
    with pytest.raises(RetrievalUnavailable):
        search(docs, vectors, asked, Search(dense=False, sparse=False))
    upper = search(docs, vectors, asked, Search(rewrite=lambda c: F.regexp_replace(c, "alpha7", "alpha9"), dense=False, reranker=False)).collect()
    assert 9 in {r.doc_id for r in upper}
    kept = search(docs.withColumn("section", F.col("source")), vectors, asked, Search(filters={"section": ["s3"]}, fusion="weighted")).collect()
    assert {r.source for r in kept} == {"s3"}
    text = context_text(search(docs, vectors, asked), docs).first()["context_text"]
    assert text.startswith("[1] (s") and "\n\n[2] (" in text
    assert prompt("q", "") is None and "Question: q" in prompt("q", text)


def test_search_goes_on_without_what_fails(spark):
    docs, vectors, asked = corpus(spark)
    broken = vectors.withColumn("embedding", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("index is down"))).otherwise(F.col("embedding")).cast("array<double>"))
    guard = lambda: {"dense": CircuitBreaker(1), "sparse": CircuitBreaker(1)}
    whole = search(docs, vectors, asked, Search(breakers=guard())).collect()
    assert {r.degraded for r in whole} == {""} and sorted(whole) == sorted(search(docs, vectors, asked).collect())
    s = Search(breakers=guard(), diverse=False)
    found = standing(legs(docs, broken, asked, s), s)
    assert list(found) == ["sparse"]
    with pytest.raises(CircuitOpen):
        s.breakers["dense"].call(int)
    with pytest.raises(RetrievalUnavailable):
        standing({"dense": broken}, Search(breakers=guard()))
    reverse = lambda question, texts: [{"index": k, "score": float(k)} for k in reversed(range(len(texts)))]
    top = search(docs, vectors, asked, Search(service=reverse, top_k=3)).collect()
    assert len(top) == 3 and {r.degraded for r in top} == {""} and max(top, key=lambda r: r.score).citation_id == 1
    lost = search(docs, vectors, asked, Search(service=lambda question, texts: 1 / 0, top_k=3)).collect()
    plain = search(docs, vectors, asked, Search(reranker=False, top_k=3)).collect()
    assert {r.degraded for r in lost} == {"rerank_unavailable"} and sorted(lost) == sorted(plain)
    by_length = search(docs, vectors, asked, Search(scorer=lambda q, t: F.char_length(t).cast("double"), top_k=1)).collect()
    assert len(by_length) == 1 and by_length[0].score >= 20
    assert selection.by_index([{"index": 2, "score": 5}, {"index": 0, "score": 1.5}], 4) == [1.5, 0.0, 5.0, 0.0]


def test_stages_and_migrations(spark, tmp_path):
    seen, root = [], str(tmp_path / "job")
    waits = iter([False, True, True])
    stages = [backfill.Stage("one", lambda: seen.append("one")), backfill.Stage("two", lambda: seen.append("two") if len(seen) > 1 else seen.append("x") or 1 / 0, lambda: next(waits))]
    with pytest.raises(ZeroDivisionError):
        backfill.run_stages(spark, root, stages, poll=0.01)
    assert backfill.run_stages(spark, root, stages, poll=0.01) == ["two"] and seen == ["one", "x", "two"]
    assert backfill.run_stages(spark, root, stages) == []
    with pytest.raises(TimeoutError):
        backfill.run_stages(spark, root, [backfill.Stage("never", int, lambda: False)], poll=0.01, patience=0.02)
    root = str(tmp_path / "tables")
    assert len(backfill.migrate(spark, root)) == 3 and backfill.migrate(spark, root) == []
    assert backfill.current(spark, root, "jobs").columns[:2] == ["id", "document_id"]
    more = [*backfill.MIGRATIONS, ("0004_priority", {"jobs": files.JOB + ", priority int"})]
    assert backfill.migrate(spark, root, more) == ["0004_priority"]
    assert "priority" in backfill.current(spark, root, "jobs", more).columns and backfill.current(spark, root, "none") is None


def test_reconcile_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "chunk_id string, content_sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "chunk_id string, content_sha256 string")
    assert {(r.chunk_id, r.action) for r in maintenance.reconcile(old, new).collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "deleted"), ("d", "inserted")}
    assert {r.action for r in maintenance.reconcile(new, new).collect()} == {"unchanged"}
    df = spark.createDataFrame([("x", 1), ("y", 5)], "term string, df long")
    deltas = spark.createDataFrame([("x", -3), ("z", 2)], "term string, delta long")
    assert {(r.term, r.df) for r in maintenance.apply_term_deltas(df, deltas).collect()} == {("x", 0), ("y", 5), ("z", 2)}


def test_metrics(spark):
    found = lists(spark, (1, 10, 0.0, 1), (1, 11, 0.0, 2), (2, 12, 0.0, 7), (4, 1, 0.0, 1))
    relevant = spark.createDataFrame([(1, 11), (2, 12), (3, 5)], "query_id long, doc_id long")
    got = {r.query_id: r for r in evaluation.golden_metrics(found, relevant).collect()}
    assert (got[1].hit_1, got[1].hit_5, got[1].rr) == (0.0, 1.0, 0.5) and got[2].hit_10 == 1.0 and got[3].rr == 0.0 and 4 not in got
    truth = lists(spark, (1, 11, 0.0, 1), (1, 12, 0.0, 2))
    recall = evaluation.ann_recall(found, truth).first()
    assert (recall.recall_1, recall.recall_5, recall.rr) == (0.0, 0.5, 0.5)
    series = spark.createDataFrame([("a", t, n) for t, n in ((0, 9), (60, 9), (120, 1), (180, 9), (240, 9), (300, 9))], "k string, t long, n long")
    assert [(r.start, r.steps) for r in monitoring.held(series, "t", F.col("n") > 5, ["k"], 60, 3).collect()] == [(180, 3)]


def test_breaker():
    now = [0.0]
    breaker = CircuitBreaker(2, 30, lambda: now[0])
    fail = lambda: 1 / 0
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(fail)
    with pytest.raises(CircuitOpen):
        breaker.call(int)
    now[0] = 31.0
    with pytest.raises(ZeroDivisionError):
        breaker.call(fail)
    with pytest.raises(CircuitOpen):
        breaker.call(int)
    now[0] = 62.0
    assert breaker.call(int) == 0 and breaker.failures == 0


def test_sources(spark, tmp_path):
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.htm").write_bytes(b"<p>caf\xc3\xa9 \xff</p>")
    assert files.read_html(spark, str(tmp_path / "html")).first()["html"] == "<p>café �</p>"
    (tmp_path / "tickers.txt").write_text("aapl # Apple\n\n# none\n msft\n")
    assert [r.ticker for r in files.ticker_list(spark, str(tmp_path / "tickers.txt")).collect()] == ["AAPL", "MSFT"]
    (tmp_path / "map.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "aa", "title": "A"}}))
    assert files.ticker_map(spark, str(tmp_path / "map.json")).collect() == [("AA", "7")]
    (tmp_path / "npy").mkdir()
    for shard, n in (("s1", 2), ("s2", 1)):
        (tmp_path / "npy" / f"{shard}.ids.json").write_text(json.dumps([f"{shard}-{k}" for k in range(n)]))
        np.save(tmp_path / "npy" / f"{shard}.f16.npy", np.full((n, 3), 0.5, np.float16))
    got = {r.chunk_id: r.dense for r in files.read_vector_arrays(spark, str(tmp_path / "npy")).collect()}
    assert got == {c: [0.5] * 3 for c in ("s1-0", "s1-1", "s2-0")}
    rows = spark.createDataFrame([(d, k) for d in "abc" for k in range(5)], "document_id string, chunk_index int")
    sharded = files.with_shard(rows, ["chunk_index"], "document_id", 4)
    assert sorted(r["count"] for r in sharded.groupBy("shard").count().collect()) == [3, 4, 4, 4]
    files.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 15
    lines = spark.createDataFrame([("c1", [0.5, 0.25], "m")], files.VECTOR_LINE)
    lines.write.json(str(tmp_path / "lines"))
    (tmp_path / "q.jsonl").write_text('{"id": "b", "query": "two"}\n{"id": "a", "query": "one"}\n{"id": "c"}\n')
    assert [tuple(r) for r in files.read_questions(spark, str(tmp_path / "q.jsonl")).orderBy("query_id").collect()] == [(0, "one"), (1, "two")]
    (tmp_path / "g.jsonl").write_text('{"query": "one", "anchors": ["x"], "section": "1A"}\n{"query": "two", "anchors": []}\n')
    assert [r.section for r in files.read_golden(spark, str(tmp_path / "g.jsonl")).orderBy("query").collect()] == ["1A", None]
    assert files.read_vector_lines(spark, str(tmp_path / "lines")).collect() == lines.collect()


def test_stream_restarts_on_its_checkpoint(spark, tmp_path):
    """Batches before and after a restart give the state of one batch over all rows."""
    source, root, checkpoint = (str(tmp_path / x) for x in ("ops", "index", "checkpoint"))
    parts = [[(1, 10, "upsert", 1.0), (2, 11, "upsert", 2.0), (3, None, "upsert", 0.0)], [(4, 10, "delete", None), (5, 12, "upsert", 3.0), (6, 13, "bad", 1.0)], [(7, 10, "upsert", 9.0)]]
    last = -1
    for rows in parts:
        spark.createDataFrame(rows, outbox.OPERATIONS).coalesce(1).write.mode("append").parquet(source)
        last = outbox.synchronise(spark.readStream.schema(outbox.OPERATIONS).parquet(source), root, checkpoint)
    assert {tuple(r) for r in outbox.read_version(spark, root, last).collect()} == {(10, 9.0), (11, 2.0), (12, 3.0)}
    assert spark.read.parquet(f"{root}/poison").count() == 2
    assert outbox.synchronise(spark.readStream.schema(outbox.OPERATIONS).parquet(source), root, checkpoint) == -1


def test_stream_attempts_and_rates(spark, tmp_path):
    source = str(tmp_path / "failures")
    spark.createDataFrame([(1,)] * 3 + [(2,)], "id long").coalesce(1).write.parquet(source)
    query = outbox.attempts(spark.readStream.schema("id long").parquet(source), most=3).writeStream.outputMode("update").format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from attempts").collect()} == {(1, 3, "failed"), (2, 1, "pending")}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    query = outbox.rates(stream).writeStream.outputMode("update").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = outbox.rates(events)
    assert spark.sql("select * from rates").count() == batch.count()


def test_chunks(spark):
    text = " ".join(f"Sentence number {k} has words." for k in range(200))
    rows = [("d", "default", "u", "1", 0, "Head", text), ("d", "default", "u", "1A", 1, "Head", text), ("d", "default", "u", "2", 2, "Head", "Too short.")]
    sections = spark.createDataFrame(rows, "document_id string, tenant string, source_uri string, item string, position int, header string, text string")
    small = Settings(chunk_size=120, chunk_overlap=16, chunk_min=8)
    got = sorted(chunking.chunks(sections, small).collect(), key=lambda r: r.chunk_index)
    assert {r.item for r in got} == {"1"} and [r.chunk_index for r in got] == list(range(len(got))) == [r.section_chunk_index for r in got]
    assert all(8 <= r.token_count <= 113 for r in got) and len({r.chunk_id for r in got}) == len(got)
    with pytest.raises(Exception, match="chunk budget"):
        chunking.chunks(sections, Settings(chunk_size=40)).count()


@pytest.mark.parametrize("sizes", [[7] * 900 + [3] * 40 + [0, 0, 60], [50, 60, 70], [5], list(range(1, 40)) * 3])
def test_token_batches(spark, sizes):
    """One group with all rows, many of one size, against packing row by row."""
    rows = spark.createDataFrame([("g", n) for n in sizes], "g string, n long")
    want, used = [], None
    for n in sorted(sizes):
        if used is None or used + n > 50:
            want.append([0, 0])
            used = 0
        used += n
        want[-1][0] += 1
        want[-1][1] = used
    got = sorted(chunking.token_batches(rows, "g", "n", 50).collect(), key=lambda r: r.batch)
    assert [(r.batch, r.n_rows, r.tokens) for r in got] == [(k, *w) for k, w in enumerate(want)]


def test_orders_of_one_key(spark):
    """Shards and percentiles where one key holds nine in ten rows."""
    rng = np.random.default_rng(5)
    rows = [("hot" if k % 10 else f"c{k}", k, float(rng.integers(0, 30))) for k in range(500)]
    df = spark.createDataFrame(rows + [("hot", 900, None)], "g string, k long, v double").repartition(4)
    want = {(g, k): n // 7 for n, (g, k, _) in enumerate(sorted([*rows, ("hot", 900, None)], key=lambda r: r[:2]))}
    assert {(r.g, r.k): r.shard for r in files.with_shard(df, ["k"], "g", 7).collect()} == want
    hot = sorted(v for g, _, v in rows if g == "hot")
    nearest = {r.g: r for r in evaluation.nearest_percentiles(df, "g", "v", {"a": 0.5, "b": 0.95, "c": 0.001}).collect()}
    floored = {r.g: r for r in evaluation.floor_percentiles(df, "g", "v", {"a": 0.5, "b": 0.95, "c": 1.0}).collect()}
    n = len(hot)
    assert [nearest["hot"][x] for x in "abc"] == [hot[math.ceil(q * n) - 1] for q in (0.5, 0.95)] + [hot[0]]
    assert [floored["hot"][x] for x in "abc"] == [hot[min(n - 1, int(n * q))] for q in (0.5, 0.95, 1.0)]
    assert len(nearest) == 51


def test_chunk_statistics(spark):
    """Against counting by hand: a repeated section, a short one, and one sentence of 300 words."""
    text = " ".join(f"Sentence number {k} has words." for k in range(60))
    long = " ".join(f"w{k}" for k in range(300))
    parts = [("1", 0, text), ("1A", 1, text), ("2", 2, "Too short."), ("3", 3, long), ("2", 4, "Too short.")]
    sections = spark.createDataFrame([("d", "t", "u", item, place, "Head", t) for item, place, t in parts], "document_id string, tenant string, source_uri string, item string, position int, header string, text string")
    small = Settings(chunk_size=120, chunk_overlap=16, chunk_min=8)
    got = {r.item: r for r in chunking.statistics(sections, small).collect()}
    sizes = {t: [w["n"] for w in chunking.section_windows(t.replace(". ", ".|").split("|"), 113, 16)[0]] for t in (text, long)}
    assert (got["1"].windows, got["1"].tokens, got["1"].duplicates, got["1"].chunks) == (len(sizes[text]), sum(sizes[text]), 0, len(sizes[text]))
    assert (got["1A"].duplicates, got["1A"].chunks, got["1A"].chars) == (len(sizes[text]), 0, 0)
    assert (got["2"].windows, got["2"].dropped_short, got["2"].duplicates, got["2"].chunks) == (2, 2, 0, 0)
    assert (got["3"].hard_split, got["3"].tokens) == (1, sum(sizes[long])) and sizes[long] == [113, 113, 106] and got["1"].hard_split == 0
    chunks = chunking.chunks(sections, small).collect()
    assert {i: sum(r.item == i for r in chunks) for i in got} == {i: r.chunks for i, r in got.items()}
    assert {i: sum(r.char_count for r in chunks if r.item == i) for i in got} == {i: r.chars for i, r in got.items()}


def test_chunks_are_packed_once(spark):
    """One Python node in the plan, and windows keep a text's own spacing."""
    rows = [("d", "default", "u", "1", 0, "Head", "One  two\tthree\nfour five. Six seven eight.")]
    sections = spark.createDataFrame(rows, "document_id string, tenant string, source_uri string, item string, position int, header string, text string")
    found = chunking.chunks(sections, Settings(chunk_size=20, chunk_overlap=2, chunk_min=2))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r.text for r in found.collect()] == ["One two three\nfour five. Six seven eight."]


def test_library_tokenizer():
    """Windows of a real vocabulary: within the budget, on token boundaries, nothing lost."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    spans = chunking.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    sentences = ["The undertaking's  revenue rose by 12.5%.", "Supercalifragilisticexpialidocious " * 20, "So it is."]
    windows, split = chunking.section_windows(sentences, 40, 6, spans)
    assert split == 1 and all(0 < w["n"] <= 44 for w in windows) and windows[0]["body"].startswith(sentences[0])
    assert all(w["n"] == len(spans(w["body"])) for w in windows)
    text = " ".join(w["body"] for w in windows)
    assert text.count("So it is.") == 1 and all(w in text for w in ("undertaking's", "Supercalifragilisticexpialidocious"))


def test_answers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q1", "[1] (d)\ntext"), (2, "q2", ""), (3, "q3", None)], "query_id long, question string, context_text string")
    assert {r.answer for r in generation.answers(rows).collect()} == {None}
    got = {r.query_id: r.answer for r in generation.answers(rows, lambda p: p[-2:]).collect()}
    assert got == {1: "q1", 2: None, 3: None}
    calls = spark.sparkContext.accumulator(0)

    def weak(prompt):
        calls.add(1)
        raise OSError

    many = spark.createDataFrame([(k, "q", "text") for k in range(20)], "query_id long, question string, context_text string").coalesce(1)
    assert {r.answer for r in generation.answers(many, weak, attempts=2, wait=0.0, threshold=3).collect()} == {None} and calls.value == 6
    assert generation.answers(many.limit(1), lambda p: iter(["a", "b"])).first().answer == "ab"
    for run in ("r1", "r2"):
        generation.append_results(rows.select("query_id"), str(tmp_path / "runs"), run, "dense")
    assert spark.read.parquet(str(tmp_path / "runs")).where("run_id = 'r1'").count() == 3
    assert generation.read_results(spark, str(tmp_path / "runs"), "r2").count() == 3 and generation.read_results(spark, str(tmp_path / "runs")).count() == 6
