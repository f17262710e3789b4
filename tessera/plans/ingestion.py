"""Pages and texts to sections and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import hash_embedding
from ..operators import chunking as C
from ..operators import html as H
from ..settings import PAGE_FURNITURE, Settings
from .registry import query, table


@query()
def html_to_text(spark, sf_dir):
    text = H.html_to_text("html")
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


def _reports(spark, sf_dir):
    """Texts with report headings: three documents become the bodies of items, after a table of contents."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(
        F.lit("Item 1. Business 1\nItem 1A. Risk Factors 2\nItem 7. Management 3\n\nItem 1. Business\n"), F.col("text"),
        F.lit("\nItem 1A: Risk Factors\n"), F.col("text"), F.lit("\nItem 7 — Management\nSee Item 1A. Risk Factors.\n"), F.col("text"),
    )
    return d.select("doc_id", "source", "lang", body.alias("text"))


@query()
def split_sections(spark, sf_dir):
    parts = F.posexplode(H.split_sections("text")).alias("position", "part")
    return _reports(spark, sf_dir).select("doc_id", parts).select("doc_id", "position", "part.item", "part.text")


def _cleaned_sql(column: str) -> str:
    patterns = [p for p in PAGE_FURNITURE if "(?=" not in p]
    out = column
    for p in patterns:
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    out = f"regexp_replace(replace({out}, chr(160), ' '), '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query(f"select doc_id, md5({_cleaned_sql('text')}) as clean_md5 from (select doc_id, 'Page 12 of 118 ' || text || chr(10) || ' 17 ' || chr(10) || chr(10) || chr(10) || chr(10) || 'Table  of Contents' as text from documents)")
def clean_section(spark, sf_dir):
    text = F.concat(F.lit("Page 12 of 118 "), F.col("text"), F.lit("\n 17 \n\n\n\nTable  of Contents"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.cleaned(text).cast("binary")).alias("clean_md5"))


@query(r"select doc_id, sha256(lower(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g'))) as content_sha256 from documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_sha256"))


@query(r"select conv_id, len(list_filter(string_split_regex(string_agg(text, chr(10) || ' ' || chr(10) order by turn), '\n\s*\n'), lambda p: trim(p, ' ' || chr(10)) <> ''))::bigint as n_paragraphs from conversations group by conv_id")
def paragraph_split(spark, sf_dir):
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n \n")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts.alias("t"))
    return rows.select("conv_id", F.size(T.paragraphs(F.col("t"))).cast("long").alias("n_paragraphs"))


@query()
def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


@query(r"select doc_id, len(regexp_extract_all(text, '\S+'))::bigint as n_tokens from documents")
def token_count(spark, sf_dir):
    """With the stand-in tokenizer."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    r"""with w as (select doc_id, regexp_extract_all(text, '\S+') as w from documents),
    s as (select doc_id, w, unnest(range(greatest(0, ceil((len(w) - 100) / 80.0))::bigint + 1)) as k from w where len(w) > 0)
    select doc_id, k::int as window, md5(array_to_string(w[k * 80 + 1 : k * 80 + 100], ' ')) as window_md5 from s"""
)
def hard_split(spark, sf_dir):
    """Windows of 100 tokens, 20 of them shared with the next."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.hard_split(T.tokens(F.col("text")), 100, 20)).alias("window", "words"))
    return rows.select("doc_id", "window", F.md5(F.array_join("words", " ").cast("binary")).alias("window_md5"))


@query(
    r"""with recursive u as (select doc_id, k, len(regexp_extract_all(s, '\S+')) as n from (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as k from (select doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\S')) as ss from documents))),
    units as (select doc_id, row_number() over (partition by doc_id order by k) as k, least(n, 60) as n from u),
    f as (
      select doc_id, 1::bigint as k, n as used, 1::bigint as first, n as last_n, [n] as cur, []::bigint[] as done from units where k = 1
      union all
      select doc_id, k, list_sum(list_append(now, n))::bigint, 1::bigint, n, list_append(now, n), case when over then list_append(done, used) else done end
      from (select *, case when not over then cur when list_sum(carried) + n > 120 then []::bigint[] else carried end as now from (
        select *, case when n_keep > 0 then cur[len(cur) - n_keep + 1 :] else [15::bigint] end as carried from (
          select f.doc_id, u.k, f.used, f.cur, f.done, u.n, f.used + u.n > 120 as over,
            (select max(j) from range(0, len(f.cur) + 1) t(j) where j = 0 or list_sum(f.cur[len(f.cur) - j + 1 :]) <= 15) as n_keep
          from f join units u on u.doc_id = f.doc_id and u.k = f.k + 1)))),
    e as (select doc_id, list_append(done, used) as sizes from f where k = (select max(k) from units x where x.doc_id = f.doc_id))
    select doc_id, len(sizes)::bigint as n_windows, array_to_string(sizes, ',') as sizes from e"""
)
def pack_windows(spark, sf_dir):
    """Lines packed to windows of 120 tokens, with up to 15 tokens carried over; longer lines are split with 15 tokens shared.

    The SQL above drops what follows the 60th token of a line, so it differs where a line is longer.
    """
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"\S"))
    whole = F.transform(lines, lambda s: F.array_join(T.tokens(s), " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", whole.alias("units")).where(F.size("units") > 0)
    packed = rows.select("doc_id", C.packer(15)("units", F.lit(120)).alias("p"))
    return packed.select("doc_id", F.col("p.windows.n").alias("s")).select("doc_id", F.size("s").cast("long").alias("n_windows"), F.array_join(F.col("s").cast("array<string>"), ",").alias("sizes"))


def _sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    uri = F.concat(F.lit("gs://bucket/filings/1/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("source").alias("document_id"), F.lit("default").alias("tenant"), uri.alias("source_uri"), F.lit("0").alias("item"), F.col("doc_id").alias("position"),
        T.header(none, F.col("source"), F.lit("1"), none, F.lit("2024"), none, F.lit("0"), none).alias("header"), "text",
    )


@query()
def chunk_documents(spark, sf_dir):
    """Documents of a source as the sections of one document, to chunks."""
    return C.chunks(_sections(spark, sf_dir))


@query()
def chunk_stats(spark, sf_dir):
    """Windows, tokens, what was dropped or split, and what stays of each document."""
    return C.statistics(_sections(spark, sf_dir))


@query()
def ingest_batch(spark, sf_dir):
    """Pages to sections, chunks, vectors of the stand-in model and term counts."""
    p = table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    pages = p.select(F.col("page_id").cast("string").alias("document_id"), F.lit("default").alias("tenant"), F.col("url").alias("source_uri"), none.alias("company"), none.alias("ticker"), F.lit("2024").alias("fiscal_year"), none.alias("inline"), "html")
    chunks = C.chunks(C.sections_of(pages))
    return chunks.select("chunk_id", "document_id", "item", "chunk_index", "token_count", "content_sha256", F.size(T.terms(F.col("text"))).alias("doc_len"), hash_embedding(16)("text").alias("dense"))


@query("select doc_id, n as token_count, n < 32 as is_short from (select doc_id, len(regexp_extract_all(text, '\\S+'))::int as n from documents)")
def short_flags(spark, sf_dir):
    n = F.size(T.tokens(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("token_count"), (n < Settings().chunk_min).alias("is_short"))


@query("select source, count(*)::bigint as windows, count(*) filter (n < 32)::bigint as dropped_short, sum(n)::bigint as tokens, sum(n) filter (n >= 32)::bigint as kept_tokens from (select source, len(regexp_extract_all(text, '\\S+')) as n from documents) group by source")
def drop_short(spark, sf_dir):
    n = F.size(T.tokens(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("source", n.alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("windows"), F.count_if(F.col("n") < 32).alias("dropped_short"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("n") >= 32, F.col("n"))).alias("kept_tokens"))


_HASHED = r"select doc_id, source, lang, length(text) as n, sha256(lower(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g'))) as h from documents"


@query(f"select doc_id, source from (select *, row_number() over (partition by source, h order by doc_id) as k from ({_HASHED})) where k = 1")
def chunk_dedup(spark, sf_dir):
    """The first of equal contents within a document, over all its items."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", T.content_hash(F.col("text")).alias("h"))
    return rows.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query(f"select doc_id, (row_number() over (partition by source order by doc_id) - 1)::int as chunk_index, (row_number() over (partition by source, lang order by doc_id) - 1)::int as section_chunk_index from ({_HASHED}) where n >= 400")
def chunk_indexes(spark, sf_dir):
    """Running numbers in a document and in a section, over what is left after the filter."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.char_length("text").alias("n")).where("n >= 400")
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id")) - 1
    return rows.select("doc_id", number("source").alias("chunk_index"), number("source", "lang").alias("section_chunk_index"))


@query(r"select count(*)::bigint as n_chunks, round(avg(n), 4) as mean_tokens, max(n)::bigint as max_tokens, count(*) filter (n > 512)::bigint as over_budget from (select len(regexp_extract_all(text, '\S+')) as n from documents)")
def chunk_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.size(T.tokens(F.col("text"))).alias("n"))
    return rows.agg(F.count("*").alias("n_chunks"), F.round(F.avg("n"), 4).alias("mean_tokens"), F.max("n").cast("long").alias("max_tokens"), F.count_if(F.col("n") > 512).alias("over_budget"))


@query()
def chunk_ids(spark, sf_dir):
    """Version 5 UUIDs of chunks, by column expressions."""
    uri = F.concat(F.lit("gs://bucket/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(F.lit("default"), uri, F.lit("1A"), F.lit(0)).alias("chunk_id"))


@query(
    r"""with recursive t as (select source, row_number() over (partition by source order by n, doc_id) as k, n from (select source, doc_id, least(len(regexp_extract_all(text, '\S+')), 512) as n from documents)),
    f as (select source, k, n as used, 0 as batch from t where k = 1
      union all select f.source, t.k, case when f.used + t.n > 2000 then t.n else f.used + t.n end, case when f.used + t.n > 2000 then f.batch + 1 else f.batch end from f join t on t.source = f.source and t.k = f.k + 1)
    select source, batch::int as batch, count(*)::bigint as n_rows, max(used)::bigint as tokens from f group by source, batch"""
)
def token_batches(spark, sf_dir):
    """Rows of a shard (here a source) in order of length, in batches of at most 2,000 tokens; a batch holds one row at least."""
    rows = table(spark, sf_dir, "documents").select("source", F.least(F.size(T.tokens(F.col("text"))), F.lit(512)).alias("n"))
    return C.token_batches(rows, "source", "n", 2000)
