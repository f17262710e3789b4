"""Operator 2: line deduplication over windows of three consecutive lines.

A text is cut at line feeds.  Each window of three lines that follow one another gets a
128-bit digest.  Of all places of a window in the corpus, the first stays (by doc_id,
null first, then a hash of the text, then position); at each later place its three
lines are covered, and the lines that any such window covers are removed.  Windows are
found in the texts as they are given, so removal doesn't depend on an order of work.

Plan: windows are counted with partial sums before the shuffle; only windows that occur
more than once meet their places again, the few very frequent ones by broadcast.  Of the
texts, those that a filter of bounded size finds among the ones with covered lines are
shuffled, to meet their positions; all others stay where they are.

Cases: a null text stays null; texts of fewer than three lines (empty ones too) have no
window and stay as they are; rows equal in doc_id and text count as one document; an
empty table gives an empty result; all columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, screened, skew_safe_join, written

#: Lines in a window.
WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """_d (doc_id), _t (hash of the text), _at (first line, from 0 on), _h (digest) of every window of every row."""
    lines = F.split("text", "\n", -1)
    n = F.size("_lines")
    digest = lambda k: F.unhex(F.md5(F.array_join(F.slice("_lines", k + 1, WINDOW), "\n").cast("binary")))
    cut = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), lines.alias("_lines")).where(n >= WINDOW)
    cut = cut.select("_d", "_t", F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), digest).alias("_hs"))
    return cut.select("_d", "_t", F.posexplode("_hs").alias("_at", "_h"))


def covered(docs: DataFrame) -> DataFrame:
    """_d, _t and _gone: the sorted positions of lines to remove, for each document that has any."""
    found = written(windows(docs), "windows")
    total = found.count()
    counted = found.groupBy("_h").agg(F.min(F.struct(F.col("_d"), F.col("_t"), F.col("_at"))).alias("_first"), F.count("*").alias("_n"))
    again = skew_safe_join(found, counted.where("_n > 1"), "_h", "_n", total)
    first = F.col("_first._d").eqNullSafe(F.col("_d")) & (F.col("_first._t") == F.col("_t")) & (F.col("_first._at") == F.col("_at"))
    later = again.where(~first).select("_d", "_t", "_at")
    starts = later.groupBy("_d", "_t").agg(F.collect_set("_at").alias("_starts"))
    lines = F.transform("_starts", lambda s: F.sequence(s, s + WINDOW - 1))
    gone = written(starts.select("_d", "_t", F.array_sort(F.array_distinct(F.flatten(lines))).alias("_gone")), "covered")
    discard(found)
    return gone


def without_repeats(docs: DataFrame) -> DataFrame:
    """Columns _c0, _c1 and so on as those of docs, the text without its covered lines, and _lines and _gone: lines before, and removed positions."""
    kept = [f"_c{k}" for k in range(len(docs.columns))]
    text = kept[docs.columns.index("text")]
    rows = docs.toDF(*kept).withColumns({"_d": F.col(kept[docs.columns.index("doc_id")]), "_t": F.xxhash64(text)})
    gone = covered(docs.select("doc_id", "text").where(F.col("text").isNotNull())).withColumnsRenamed({"_d": "_d2", "_t": "_t2"})
    rows = screened(rows, gone.select(F.col("_d2").alias("_d"), F.col("_t2").alias("_t")), ["_d", "_t"])
    met = rows.where("_maybe").join(gone, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2")), "left")
    both = met.select(*kept, "_gone").unionByName(rows.where("not _maybe").select(*kept, F.lit(None).cast("array<int>").alias("_gone")))
    lines = F.split(text, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))  # by hashing: linear in a text's lines
    picked = F.transform(F.array(lines), lambda ls: F.transform(places, lambda k: F.get(ls, k)))  # the outer function cuts the text once
    left = F.array_join(picked[0], "\n")
    left = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left)
    size = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    columns = [left.alias(c) if c == text else F.col(c) for c in kept]
    return both.select(*columns, size.alias("_lines"), F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (positions, joined by commas) and text_md5 (of what stays) of every row."""
    found = without_repeats(docs.select(docs["doc_id"].cast("long"), docs["text"]))
    return found.select(
        F.col("_c0").alias("doc_id"), F.col("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"),
        F.array_join(F.col("_gone").cast("array<string>"), ",").alias("removed"), F.md5(F.col("_c1").cast("binary")).alias("text_md5"),
    )


def kept_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs with the lines that stay; n_chars follows; rows of which nothing stays go."""
    found = without_repeats(docs)
    found = found.where((F.size("_gone") == 0) | (F.size("_gone") < F.col("_lines")))
    if "n_chars" in docs.columns:
        text, size = (f"_c{docs.columns.index(c)}" for c in ("text", "n_chars"))
        found = found.withColumn(size, F.when(F.size("_gone") > 0, F.char_length(text).cast("long")).otherwise(F.col(size)))
    return found.drop("_lines", "_gone").toDF(*docs.columns)


#: DuckDB SQL for line_dedup().
LINE_DEDUP_SQL = """
with cut as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, unnest(range(len(ls) - 2)) as k, ls from cut where len(ls) >= 3),
h as (select doc_id, k, array_to_string(ls[k + 1 : k + 3], chr(10)) as h from w),
r as (select doc_id, k, row_number() over (partition by h order by doc_id, k) as n from h),
g as (select doc_id, list_sort(list_distinct(flatten(list([k, k + 1, k + 2])))) as gone from r where n > 1 group by doc_id),
b as (select cut.*, coalesce(gone, []) as gone from cut left join g using (doc_id)),
j as (select *, case when len(gone) = 0 then text else coalesce(array_to_string(list_transform(list_filter(list_zip(ls, range(len(ls))), lambda x: not list_contains(gone, x[2])), lambda x: x[1]), chr(10)), '') end as left_text from b)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, len(gone)::bigint as n_removed,
  coalesce(array_to_string(gone, ','), '') as removed, md5(left_text) as text_md5 from j"""
