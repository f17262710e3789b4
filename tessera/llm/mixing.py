"""Operator 10: mix sources to target weights by weighted fair queueing; DataFrame functions only.

Sources by code point, null last, weigh 1, 2, 3 and so on in turn, and share the total
of all sizes (words).  A target stops at three times its source's size; the excess is
shared again by weight until none is above.  Each source offers its documents in
shuffled order (by a digest of the identifier), up to three times over.  A document's
virtual finish time is the source's words up to and with it, divided by the source's
target; all offers are ranked by finish time and taken until the total is used up.

Plan: rows are reduced to a locator, source, size and order, written once; all that
follows works on these.  Each source's order is cut into cells of about BUCKET_ROWS rows;
a running sum is a sum within a cell plus the sums of the cells before, so no task gets a
whole source.  Rows that share a doc_id, or have none, share a place in the order: where
they are many they are cut further by their locators.  Finish times fall into equal bins,
which hold about equal numbers of words whatever the sources' sizes; the bin in which the
total runs out is divided again until few offers are left, and only those are ranked one
by one.  What one task holds at most are the sources, a row each, and the cells of one
source.

Cases: a null text has size 0; documents of size 0, and sources of them, are taken 0
times; all rows with a null source are one source; equal finish times go by source;
rows that share a doc_id come in the order of a hash of their texts; an empty table gives an empty result; other columns pass through or are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT_SHARE, WORD, located, skew_safe_join, written

#: A source is offered so many times at most.
REPEATS = 3
WEIGHTS = 3
BINS = 8192
#: Rows in a cell of a source's order, about.
BUCKET_ROWS = 1000
#: Offers that are ranked one by one, about.
RANKED = 100_000


def sized(rows: DataFrame) -> DataFrame:
    """From located rows of doc_id, text and source: _file and _row (a row's locator), _id (doc_id), _source (a key that sorts null last), _size, _order (shuffled place), _next and _last (the places of rows equal in that, and of rows equal in text too)."""
    text = F.coalesce(F.col("_c1"), F.lit(""))
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("_c0").cast("string"), F.lit(""))).cast("binary"))
    source = F.coalesce(F.concat(F.lit("0"), F.col("_c2").cast("string")), F.lit("1"))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    found = rows.select("_file", "_row", F.col("_c0").cast("long").alias("_id"), source.alias("_source"), size.alias("_size"), order.alias("_order"), F.xxhash64(text).alias("_next"), F.xxhash64("_file", "_row").alias("_last"))
    return written(found, "mix-sized")


def share(number, parts):
    """The part, from 0 on, of a whole number from 0 to 2 ** 32 - 1 when that range is cut into equal parts."""
    return F.floor(number * parts / F.lit(float(1 << 32))).cast("long")


def celled(rows: DataFrame, counts: DataFrame, total: int, cell_rows: int) -> DataFrame:
    """Adds _cell, an array that sorts as the rows of a source do: no cell has much more than cell_rows rows.

    Places are spread evenly, so a source's order is cut into equal ranges of them.  Where
    a range has far more rows than that, rows share places: at most HOT_SHARE places
    hold over 1/HOT_SHARE of all rows, and each of these is cut by text; and where rows
    are equal in text too, so that any order of them is the same, by locator.
    """
    parts = counts.select("_source", "_rows", F.ceil(F.col("_rows") / cell_rows).alias("_parts"))
    rows = skew_safe_join(rows, parts, "_source", "_rows", total)
    rows = rows.withColumn("_range", share(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.col("_parts")))
    rows = rows.drop("_parts", "_rows").withColumn("_cell", F.array("_range"))
    full = rows.groupBy("_source", "_range").count().where(F.col("count") > 4 * cell_rows).select("_source", "_range")
    most = max(total // HOT_SHARE, 4 * cell_rows)
    some = rows.join(full, ["_source", "_range"], "left_semi")
    for place, rest in (("_order", "_next"), ("_next", "_last")):
        shared = some.groupBy(place).count().where(F.col("count") > most).collect()
        if not shared:
            break
        own, places = F.col(place), F.array(*[F.lit(r[place]) for r in sorted(shared)])
        many = F.create_map(*[F.lit(x) for r in shared for x in (r[place], -(-r["count"] // cell_rows))])[own]
        before = 2 * F.size(F.filter(places, lambda p: p < own)).cast("long")  # noqa: B023
        low = share(F.shiftrightunsigned(rest, 32), many)
        finer = F.when(many.isNull(), F.array(before, F.lit(0).cast("long"))).otherwise(F.array(before + 1, low))
        rows, some = (df.withColumn("_cell", F.concat("_cell", finer)) for df in (rows, some.where(many.isNotNull())))
    return rows.drop("_range")


def targets(sources: DataFrame) -> DataFrame:
    """_source, source_size, _rank and target from _source and source_size: one row for each source.

    In the order of the level at which a source's target stops growing, a source is
    below its stop exactly if the level that shares the rest among it and all later ones
    doesn't reach that stop.  The first such level holds for all.
    """
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy("_source")))
    ranked = ranked.withColumn("_w", ((F.col("_rank") - 1) % WEIGHTS + 1).cast("double"))
    by_stop = Window.orderBy(REPEATS * F.col("source_size") / F.col("_w"), "_rank")
    before = F.coalesce(F.sum("source_size").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_w").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - REPEATS * before).cast("double") / after
    levelled = ranked.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") <= REPEATS * F.col("source_size"))
    common = F.min(F.when(F.col("_free"), F.struct(REPEATS * F.col("source_size") / F.col("_w"), "_rank", F.col("_level").alias("level")))).over(Window.partitionBy())
    target = F.least((REPEATS * F.col("source_size")).cast("double"), F.coalesce(common["level"], F.lit(0.0)) * F.col("_w"))
    return levelled.select("_source", "source_size", "_rank", target.alias("target"))


def placed(located_rows: DataFrame, cell_rows: int | None = None) -> DataFrame:
    """Every row of sized() with its source's figures and _sum: the source's words up to and with it."""
    own = sized(located_rows)
    counts = own.groupBy("_source").agg(F.count("*").alias("_rows"))
    rows = celled(own, counts, own.count(), cell_rows or BUCKET_ROWS)
    cells = written(rows.groupBy("_source", "_cell").agg(F.sum("_size").alias("_words")), "mix-cells")
    sources = targets(cells.groupBy("_source").agg(F.sum("_words").alias("source_size")))
    before = F.sum("_words").over(Window.partitionBy("_source").orderBy("_cell")) - F.col("_words")
    cells = cells.withColumn("_before", before).join(sources, "_source").drop("_words")
    inside = Window.partitionBy("_source", "_cell").orderBy("_order", "_next", "_last").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("_inside", F.sum("_size").over(inside))
    found = running.join(cells, ["_source", "_cell"]).withColumn("_sum", F.col("_before") + F.col("_inside"))
    return written(found.select("_file", "_row", "_id", "_size", "source_size", "target", "_rank", "_sum"), "mix-placed")


def finish(repeat: int):
    """The virtual finish time of a row's offer number `repeat`, from 0 on; null if the row can't be taken."""
    return F.when((F.col("_size") > 0) & (F.col("target") > 0), (repeat * F.col("source_size") + F.col("_sum")).cast("double") / F.col("target"))


def bin_of(time, low: float = 0.0, width: float = 1.0, last: int = 4 * BINS):
    """The bin of a time: BINS equal ones from `low` on within `width`, and the last for all after."""
    return F.greatest(F.lit(0), F.least(F.floor((time - F.lit(low)) / F.lit(width) * BINS), F.lit(last))).cast("int")


def mix(located_rows: DataFrame, cell_rows: int | None = None) -> DataFrame:
    """Every row of doc_id, text and source: _file and _row (its locator), _id, _size, source_size, target, and _times: how often the mix takes it."""
    rows = placed(located_rows, cell_rows)
    offers = rows.select("_size", "_rank", F.explode(F.array(*[finish(k) for k in range(REPEATS)])).alias("_time")).where("_time is not null")
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    used, low, width, last, cuts = 0, 0.0, 1.0, 4 * BINS, []
    while True:  # the bin in which the total runs out, and within it again, until few offers are left
        binned = offers.withColumn("_bin", bin_of(F.col("_time"), low, width, last))
        bins = binned.groupBy("_bin").agg(F.sum("_size").alias("_words"), F.count("*").alias("_n")).withColumn("_until", F.sum("_words").over(Window.orderBy("_bin")) + used)  # at most 4 * BINS + 1 rows
        cut = bins.where(F.col("_until") > total).orderBy("_bin").limit(1).first()
        if cut is None:
            break
        cuts.append((low, width, last, cut["_bin"]))
        used = cut["_until"] - cut["_words"]
        offers = binned.where(F.col("_bin") == cut["_bin"]).drop("_bin")
        low, width, last = low + cut["_bin"] * width / BINS, width / BINS, BINS - 1
        if cut["_n"] <= RANKED or len(cuts) == 3:  # three times is as fine as the times themselves
            break
    if not cuts:  # every offer fits
        taken = [finish(k).isNotNull() for k in range(REPEATS)]
    else:
        ranked = offers.withColumn("_until", F.sum("_size").over(Window.orderBy("_time", "_rank").rowsBetween(Window.unboundedPreceding, 0)))
        end = ranked.where(F.col("_until") + used <= total).agg(F.max(F.struct("_time", "_rank")).alias("end")).first()["end"]
        taken = []
        for k in range(REPEATS):
            time = finish(k)
            fits = F.lit(False) if end is None else (time < end["_time"]) | (time == end["_time"]) & (F.col("_rank") <= end["_rank"])
            for low, width, last, b in reversed(cuts):
                own = bin_of(time, low, width, last)
                fits = (own < b) | (own == b) & fits
            taken.append(F.coalesce(time.isNotNull() & fits, F.lit(False)))
    times = sum((t.cast("int") for t in taken[1:]), taken[0].cast("int"))
    return rows.select("_file", "_row", "_id", "_size", "source_size", "target", times.alias("_times"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words taken, repeats counted) of every row."""
    rows = mix(located(docs, "doc_id", "text", "source"))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).alias("taken"))


def taken_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it's taken, all columns as they are; texts are shuffled once, to meet their numbers."""
    full = located(docs, *docs.columns)
    own = [F.col(f"_c{docs.columns.index(c)}").alias(f"_c{k}") for k, c in enumerate(("doc_id", "text", "source"))]
    times = mix(full.select(*own, "_file", "_row")).where("_times > 0").select("_file", "_row", "_times")
    found = full.join(times, ["_file", "_row"]).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return found.select(*[f"_c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


#: DuckDB SQL for mixed().
MIXED_SQL = rf"""
with own as (
  select doc_id, coalesce('0' || source, '1') as s, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
    md5('mix:' || coalesce(doc_id::varchar, '')) as r from documents),
sources as (select s, sum(size)::bigint as z from own group by s),
ranked as (select *, row_number() over (order by s) as k, ((row_number() over (order by s) - 1) % 3 + 1)::double as w from sources),
levels as (
  select *, (sum(z) over () - 3 * coalesce(sum(z) over (order by 3 * z / w, k rows between unbounded preceding and 1 preceding), 0))::double
    / sum(w) over (order by 3 * z / w, k rows between current row and unbounded following) as level from ranked),
level as (select coalesce((select level from levels where level * w <= 3 * z order by 3 * z / w, k limit 1), 0) as level),
aims as (select s, z, k, least((3 * z)::double, (select level from level) * w) as t from ranked),
sums as (
  select own.*, z, k, t, sum(size) over (partition by own.s order by r, size rows unbounded preceding)::bigint as c
  from own join aims on own.s = aims.s),
offers as (select doc_id, size, k, e, (e * z + c)::double / t as f from sums, (select unnest([0, 1, 2]) as e) where size > 0 and t > 0),
used as (select *, sum(size) over (order by f, k rows unbounded preceding) as u from offers),
fits as (select doc_id, sum(size)::bigint as taken from used where u <= (select sum(size) from own) group by doc_id)
select own.doc_id, own.size, z as source_size, t as target, coalesce(taken, 0)::bigint as taken
from own join aims on own.s = aims.s left join fits on own.doc_id = fits.doc_id"""
