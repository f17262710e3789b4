"""Scans, filters, projections and rankings of single tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunking import item_table
from ..operators.dense import assert_dimension
from ..operators.filters import build_filter
from ..settings import ITEMS
from ..sources import files
from .registry import query, table


def payload(spark, sf_dir):
    """Orders as documents with metadata: the columns that filters name."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("section"), F.col("o_orderstatus").alias("ticker"),
        F.year("o_orderdate").cast("string").alias("fiscal_year"), F.col("o_orderdate").cast("timestamp").alias("filing_date"),
        (F.col("o_totalprice") > 150000).alias("is_narrative"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.lit("default").alias("tenant"),
    )


def _kept(spark, sf_dir, filters):
    return payload(spark, sf_dir).where(build_filter(filters)).select("document_id", "section", "ticker")


_PAYLOAD = "select o_orderkey as document_id, o_orderpriority as section, o_orderstatus as ticker from orders"


@query(f"{_PAYLOAD} where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def filter_eq(spark, sf_dir):
    return _kept(spark, sf_dir, {"ticker": "F", "item": "1-URGENT", "fiscal_year": None})


@query(f"{_PAYLOAD} where o_orderpriority in ('1-URGENT', '2-HIGH') and year(o_orderdate)::varchar in ('1995', '1996')")
def filter_in(spark, sf_dir):
    return _kept(spark, sf_dir, {"section": ["1-URGENT", "2-HIGH"], "fiscal_year": ["1995", "1996"]})


@query(f"{_PAYLOAD} where list_has_any([o_orderstatus, o_orderpriority], ['P', '5-LOW'])")
def filter_tags_any(spark, sf_dir):
    return _kept(spark, sf_dir, {"tags": ["P", "5-LOW"]})


@query(f"{_PAYLOAD} where not (o_totalprice > 150000)")
def filter_bool(spark, sf_dir):
    """False is a value, not a missing condition."""
    return _kept(spark, sf_dir, {"is_narrative": False})


@query(f"{_PAYLOAD} where o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1995-12-31'")
def filter_daterange(spark, sf_dir):
    return _kept(spark, sf_dir, {"date_after": "1995-01-01", "date_before": "1995-12-31"})


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 0)")
def semi_join_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(keys, "doc_id", "left_semi")


@query("select event_id, event_type from events where json_extract_string(props, '$.k') = '7'")
def json_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id", "event_type")


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def variant_attributes(spark, sf_dir):
    """Attributes without a fixed schema, read as a variant."""
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("select doc_id, lang, source, n_chars from documents")
def lean_projection(spark, sf_dir):
    """Everything that an index keeps of a document: the text is not read."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query(r"""select doc_id, md5(source || ' (' || source || ') 10-K ' || lang || ' - Item 1A. Risk Factors' || chr(10) || chr(10) || text) as embed_md5 from documents""")
def embed_text(spark, sf_dir):
    none = F.lit(None).cast("string")
    head = T.header(F.lit(""), F.col("source"), F.col("source"), none, F.lit(""), F.col("lang"), F.lit("1A"), F.lit("Risk Factors"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.embed_text(head, F.col("text")).cast("binary")).alias("embed_md5"))


@query("select distinct source from documents order by source limit 50")
def distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").limit(50)


_RANKED_EVENTS = "(select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc)::int as nth from events where event_type = 'purchase')"


def _parallel(spark, sf_dir):
    """A row for each user with parallel arrays, newest first, as a filings index has them."""
    e = table(spark, sf_dir, "events")
    arrays = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")), asc=False)
    return e.groupBy("user_id").agg(arrays.alias("a")).select("user_id", F.col("a.event_id").alias("event_id"), F.col("a.event_type").alias("event_type"))


@query(f"select user_id, event_id, event_type from {_RANKED_EVENTS} where nth = 1")
def latest_filing(spark, sf_dir):
    kind = F.col("entry.event_type") == "purchase"
    return files.latest_of_kind(_parallel(spark, sf_dir), "user_id", ["event_id", "event_type"], kind).drop("nth")


@query(f"select user_id, nth, event_id, event_type from {_RANKED_EVENTS} where nth <= 3")
def latest_n_per_key(spark, sf_dir):
    kind = F.col("entry.event_type") == "purchase"
    return files.latest_of_kind(_parallel(spark, sf_dir), "user_id", ["event_id", "event_type"], kind, 3)


@query("select page_id, nullif(upper(trim(string_split(url, '#')[1])), '') as line from (select page_id, ' ' || url || ' # comment' as url from pages)")
def comment_strip(spark, sf_dir):
    line = F.concat(F.lit(" "), F.col("url"), F.lit(" # comment"))
    return table(spark, sf_dir, "pages").select("page_id", files.comment_stripped(line).alias("line"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def skip_existing(spark, sf_dir):
    return files.skip_existing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("select conv_id, turn, ((row_number() over (order by conv_id, turn) - 1) // 100)::bigint as shard from conversations")
def shard_assign(spark, sf_dir):
    return files.with_shard(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["turn"], "conv_id", 100).select("conv_id", "turn", "shard")


@query("select vec_id, len(embedding)::int as dim from embeddings")
def dim_guard(spark, sf_dir):
    """Fails on a vector of another dimension."""
    return assert_dimension(table(spark, sf_dir, "embeddings"), 64).select("vec_id", F.size("embedding").alias("dim"))


@query("select page_id, url, length(html)::bigint as n_chars, md5(html) as html_md5 from pages")
def pages_scan(spark, sf_dir):
    html = F.make_valid_utf8(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.char_length(html).cast("long").alias("n_chars"), F.md5(html.cast("binary")).alias("html_md5"))


@query("select doc_id, '0' as item, length(text)::bigint as n_chars from documents")
def inline_sections(spark, sf_dir):
    """A text that comes with its registration is section 0 as a whole."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("0").alias("item"), F.char_length("text").cast("long").alias("n_chars"))


@query(
    """select source, count(*)::bigint as n_chunks, max(doc_id) as newest from documents group by source order by newest desc limit 10"""
)
def list_documents(spark, sf_dir):
    """The newest documents with the numbers of their chunks; the count is joined, not asked for row by row."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_chunks"), F.max("doc_id").alias("newest")).orderBy(F.desc("newest")).limit(10)


@query(
    """with c as (select source, count(*)::bigint as n_chunks from documents group by 1),
    p as (select source, count(*)::bigint as n_pending from documents d where not exists (select 1 from embeddings where vec_id = d.doc_id) group by 1),
    j as (select source, string_agg(doc_id::varchar || ':' || quality::varchar, ',' order by doc_id) as jobs from documents join labels using (doc_id) group by 1)
    select source, n_chunks, coalesce(n_pending, 0) as n_pending, coalesce(jobs, '') as jobs from c left join p using (source) left join j using (source)"""
)
def document_status(spark, sf_dir):
    """Chunks, chunks that aren't indexed yet and ordered jobs of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    indexed = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    pending = d.join(indexed, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n_pending"))
    jobs = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "quality"))).alias("j"))
    jobs = jobs.select("source", F.array_join(F.transform("j", lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["quality"].cast("string"))), ",").alias("jobs"))
    counts = d.groupBy("source").agg(F.count("*").alias("n_chunks"))
    return counts.join(pending, "source", "left").join(jobs, "source", "left").select("source", "n_chunks", F.coalesce("n_pending", F.lit(0)).alias("n_pending"), F.coalesce("jobs", F.lit("")).alias("jobs"))


_QUOTED = ", ".join("('{}', '{}', {})".format(n, t.replace("'", "''"), str(b).lower()) for n, _, t, b in ITEMS)


@query(f"select * from (values {_QUOTED}) as t(item, title, is_narrative)")
def section_dim(spark, sf_dir):
    return item_table(spark)


@query(
    r"""with p as (select page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/'), lambda x: x <> '') as p from pages)
    select page_id, case when len(p) >= 3 and regexp_matches(p[-3], '^[0-9]+$') then p[-3] end as cik, case when len(p) >= 3 and regexp_matches(p[-3], '^[0-9]+$') then p[-2] end as accession, p[-1] as document from p"""
)
def uri_metadata(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.uri_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query("select page_id, '12345' as cik, '000012345625000001' as accession, 'page' || page_id::varchar || '.htm' as document from pages")
def uri_metadata_filings(spark, sf_dir):
    """The same on paths of filings."""
    uri = F.concat(F.lit("gs://bucket/filings/12345/000012345625000001/page"), F.col("page_id").cast("string"), F.lit(".htm"))
    return table(spark, sf_dir, "pages").select("page_id", T.uri_parts(uri).alias("p")).select("page_id", "p.*")


@query("select c_custkey, lpad(c_custkey::varchar, 10, '0') as cik, replace(c_name, '#', '') as name_plain, substring(coalesce(nullif('', ''), '2024-03-01'), 1, 4) as fiscal_year from customer")
def filing_keys(spark, sf_dir):
    """Padded numbers, names without separators, years of the first date that's given."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.replace("c_name", F.lit("#"), F.lit("")).alias("name_plain"), F.substring(T.filled(F.lit(""), F.lit("2024-03-01")), 1, 4).alias("fiscal_year"))


@query("select doc_id, source || ' | Item ' || lang || '.' as label, greatest(1, length(text) // 4)::int as n_tokens from documents")
def citation_labels(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", T.citation_label(F.col("source"), F.col("lang"), none).alias("label"), T.token_estimate(F.lit(0), F.col("text")).alias("n_tokens"))


@query(
    """select conv_id, string_agg(role, '>' order by turn) as roles, (list(role order by turn))[-1] as last_role, array_to_string(list_reverse(list(role order by turn))[1:2], ',') as last_two, count(distinct role)::bigint as n_roles from conversations group by conv_id"""
)
def array_functions(spark, sf_dir):
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("r"))
    return rows.select("conv_id", F.array_join("r", ">").alias("roles"), F.element_at("r", -1).alias("last_role"), F.array_join(F.slice(F.reverse("r"), 1, 2), ",").alias("last_two"), F.size(F.array_distinct("r")).cast("long").alias("n_roles"))


@query("select event_type, round(min(value), 6) as low, round(max(value), 6) as high, round(avg(case when hi = lo then 1e0 else (value - lo) / (hi - lo) end), 6) as mean_scaled from (select *, min(value) over (partition by event_type) as lo, max(value) over (partition by event_type) as hi from events) group by event_type")
def min_max_scaling(spark, sf_dir):
    """By aggregates that are joined back: no window holds all rows of a type."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    bounds = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    rows = e.join(bounds, "event_type").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg(scaled).alias("mean_scaled"))
    return rows.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("mean_scaled", 6).alias("mean_scaled"))


@query("with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k, lead(turn, 1, -1) over (partition by conv_id order by turn) as next_turn from conversations) select conv_id, turn, next_turn::bigint as next_turn from t")
def next_boundary(spark, sf_dir):
    following = F.lead("turn", 1, -1).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", following.cast("long").alias("next_turn"))


