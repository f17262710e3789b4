"""Sections to chunks: clean, sentences, windows within a budget of tokens, identity.

Cleaning, sentences, hashes, filters and numbering are column expressions; only the
packing of sentences, which goes through a section in order, is an Arrow function of one
row.  It runs once for each section and hands its counts on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text as T
from ..settings import DEFAULTS, ITEMS, Settings

_WORDS = re.compile(r"\S+")

#: A tokenizer gives the first and last place (exclusive) of each token of a text.
Tokenizer = Callable[[str], list[tuple[int, int]]]


def words(text: str) -> list[tuple[int, int]]:
    """The stand-in tokenizer: runs of characters that aren't white space."""
    return [m.span() for m in _WORDS.finditer(text)]


@cache
def _library(path: str):
    from tokenizers import Tokenizer as Library

    found = Library.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def library_tokenizer(path: str) -> Tokenizer:
    """The tokenizers library with a vocabulary file, which every worker reads from `path`; no special tokens are added."""

    def spans(text: str) -> list[tuple[int, int]]:
        return [(a, b) for a, b in _library(path).encode(text, add_special_tokens=False).offsets if b > a]

    return spans


def split_unit(words: Sequence, budget: int, overlap: int) -> list[Sequence]:
    """Windows of `budget` words every budget - overlap, as many as the words need; none for none."""
    step = max(1, budget - overlap)
    more = max(0, -(-(len(words) - budget) // step))
    return [words[k * step :][:budget] for k in range(more + 1 if words else 0)]


def pack_pieces(units: list[Sequence], budget: int, overlap: int) -> list[list[Sequence]]:
    """Windows of whole units up to the budget, each beginning with the end of the one before.

    What is carried over is as many whole last units as `overlap` tokens hold, else the
    last `overlap` tokens of the last unit, and nothing if the next unit would not fit.
    """
    windows, current, used = [], [], 0
    for unit in units:
        if current and used + len(unit) > budget:
            windows.append(current)
            keep, size = len(current), 0
            while keep and size + len(current[keep - 1]) <= overlap:
                keep -= 1
                size += len(current[keep])
            carried = current[keep:]
            if not carried and overlap and current[-1]:
                carried = [current[-1][-overlap:]]
                size = len(carried[0])
            current, used = (carried, size) if size + len(unit) <= budget else ([], 0)
        current = [*current, unit]
        used += len(unit)
    return [*windows, current] if current else windows


def pack_units(units: list[list[str]], budget: int, overlap: int) -> list[list[str]]:
    """pack_pieces with each window as one list of its tokens."""
    return [[w for piece in window for w in piece] for window in pack_pieces(units, budget, overlap)]


def section_windows(sentences: list[str], budget: int, overlap: int, tokenizer: Tokenizer = words) -> tuple[list[dict], int]:
    """Windows (body and n, its tokens) of sentences, and how many sentences were too long and split.

    Text between a window's pieces is one blank; within a piece it's as it was.
    """
    tokens: list[tuple[int, int, int]] = []  # sentence, first and last place
    units, split = [], 0
    for k, sentence in enumerate(sentences):
        start = len(tokens)
        tokens += [(k, a, b) for a, b in tokenizer(sentence)]
        unit = range(start, len(tokens))
        split += len(unit) > budget
        units += split_unit(unit, budget, overlap) if len(unit) > budget else [unit] if unit else []
    found = []
    for window in pack_pieces(units, budget, overlap):
        body = " ".join(sentences[tokens[p[0]][0]][tokens[p[0]][1] : tokens[p[-1]][2]].strip() for p in window)
        found.append({"body": body, "n": sum(map(len, window)) if tokenizer is words else len(tokenizer(body))})
    return found, split


def packer(overlap: int, tokenizer: Tokenizer = words):
    """A function of sentences and a budget of tokens: windows (body, n) and split.

    It's marked as not deterministic so that no plan runs it twice.
    """

    @F.pandas_udf("windows array<struct<body:string,n:int>>, split int")
    def pack(sentences: pd.Series, budgets: pd.Series) -> pd.DataFrame:
        found = [section_windows(list(u), int(b), overlap, tokenizer) for u, b in zip(sentences, budgets, strict=True)]
        return pd.DataFrame({"windows": [w for w, _ in found], "split": [s for _, s in found]})

    return pack.asNondeterministic()


def item_table(spark) -> DataFrame:
    """item, title and is_narrative of the fixed items: a small dimension."""
    return spark.createDataFrame([(n, t, b) for n, _, t, b in ITEMS], "item string, title string, is_narrative boolean")


def counted(text: Column, tokenizer: Tokenizer = words) -> Column:
    """Tokens of a text."""
    if tokenizer is words:
        return F.size(T.tokens(text))
    return F.pandas_udf(lambda texts: texts.map(lambda t: len(tokenizer(t or ""))), IntegerType())(text)


def budget(header: Column, s: Settings = DEFAULTS, tokenizer: Tokenizer = words) -> Column:
    """Tokens that are left for a chunk's body; a size that leaves too few is an error."""
    left = F.lit(s.chunk_size - s.special_tokens - s.safety_tokens) - counted(header, tokenizer)
    least = max(s.chunk_min, s.chunk_overlap)
    message = F.concat(F.lit("chunk budget "), left.cast("string"), F.lit(f" is not above {least}"))
    return F.when(left > least, left).otherwise(F.raise_error(message).cast("int"))


def windows(sections: DataFrame, s: Settings = DEFAULTS, tokenizer: Tokenizer = words) -> DataFrame:
    """Sections (any columns, with header and text) to windows: adds window (from 0 on), body, token_count, and split (the section's sentences that were too long)."""
    packed = packer(s.chunk_overlap, tokenizer)(T.sentences(T.cleaned(F.col("text"))), budget(F.col("header"), s, tokenizer))
    kept = [c for c in sections.columns if c != "text"]
    rows = sections.withColumn("_p", packed).select(*kept, "_p.split", F.posexplode("_p.windows").alias("window", "_w"))
    return rows.select(*kept, "split", "window", F.col("_w.body").alias("body"), F.col("_w.n").alias("token_count"))


def repeated(rows: DataFrame) -> DataFrame:
    """Adds content_sha256 and nth: of equal contents of a document the first has 1, in the order of its sections."""
    rows = rows.withColumn("content_sha256", T.content_hash(F.col("body"))).repartition("document_id")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "content_sha256").orderBy("position", "window")))


def chunks(sections: DataFrame, s: Settings = DEFAULTS, tokenizer: Tokenizer = words) -> DataFrame:
    """Chunks of sections (document_id, tenant, source_uri, item, position, header, text).

    Short windows go, then windows whose content a document has had already, in the order
    of its sections; numbers and identities count those that stay.  One shuffle by
    document serves all three orders.
    """
    order = ["position", "window"]
    kept = repeated(windows(sections, s, tokenizer).where(F.col("token_count") >= s.chunk_min)).where("nth = 1").drop("nth")
    kept = kept.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)) - 1)
    kept = kept.withColumn("section_chunk_index", F.row_number().over(Window.partitionBy("document_id", "position").orderBy("window")) - 1)
    identity = T.chunk_id(F.col("tenant"), F.col("source_uri"), F.col("item"), F.col("section_chunk_index"), s.fingerprint())
    return kept.select(
        identity.alias("chunk_id"), "document_id", "tenant", "source_uri", "item", "chunk_index", "section_chunk_index",
        F.col("body").alias("text"), F.col("header").alias("context_header"), "token_count", F.char_length("body").alias("char_count"), "content_sha256",
        F.lit(s.embedding_model).alias("embedding_model"), F.lit(s.fingerprint()).alias("fingerprint"),
    )


def statistics(sections: DataFrame, s: Settings = DEFAULTS, tokenizer: Tokenizer = words) -> DataFrame:
    """document_id, item: windows, tokens of all windows, how many windows were short or had come before, sentences that were split, and what stays: chunks and their characters."""
    rows = windows(sections, s, tokenizer).withColumn("short", F.col("token_count") < s.chunk_min)
    # short windows don't count as the first of equal ones
    rows = repeated(rows.withColumn("position", F.col("position") + F.when(F.col("short"), F.lit(1 << 40)).otherwise(0)))
    stays = ~F.col("short") & (F.col("nth") == 1)
    # a section's number of split sentences stands at its first window
    return rows.groupBy("document_id", "item").agg(
        F.count("*").alias("windows"), F.sum("token_count").alias("tokens"), F.count_if("short").alias("dropped_short"),
        F.count_if(~F.col("short") & (F.col("nth") > 1)).alias("duplicates"), F.sum(F.when(F.col("window") == 0, F.col("split")).otherwise(0)).alias("hard_split"),
        F.count_if(stays).alias("chunks"), F.coalesce(F.sum(F.when(stays, F.char_length("body"))), F.lit(0)).alias("chars"),
    )


def sections_of(pages: DataFrame) -> DataFrame:
    """Sections of pages (document_id, tenant, source_uri, company, ticker, fiscal_year, html or inline text).

    An inline text is section 0 as a whole; so is a page in which no item is found.
    """
    from .html import html_to_text, split_sections

    text = F.coalesce(F.col("inline"), html_to_text("html"))
    parts = F.when(F.col("inline").isNotNull(), F.array(F.struct(F.lit("0").alias("item"), F.col("inline").alias("text")))).otherwise(split_sections(text))
    rows = pages.select("document_id", "tenant", "source_uri", "company", "ticker", "fiscal_year", F.posexplode(parts).alias("position", "part"))
    titles = F.broadcast(item_table(pages.sparkSession))
    rows = rows.withColumn("item", F.col("part.item")).join(titles, "item", "left")
    cik = T.uri_parts(F.col("source_uri"))["cik"]
    none = F.lit(None).cast("string")
    head = T.header(F.col("company"), F.col("ticker"), F.coalesce(cik, F.lit("unknown")), none, F.col("fiscal_year"), none, F.col("item"), F.col("title"))
    return rows.select("document_id", "tenant", "source_uri", "item", "position", "is_narrative", head.alias("header"), F.col("part.text").alias("text"))


def token_batches(rows: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """group, batch, n_rows and tokens: rows of a group in order of size, in batches of at most `most` tokens, of one row at least.

    Rows of equal size are interchangeable, so a group comes as counts by size; batches
    that are alike are laid out as one row and multiplied after that.
    """

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[list[int]] = []  # first batch, number of batches, rows and tokens of each
        batch = used = held = 0
        for n, count in sorted(zip(pdf["n"], pdf["c"], strict=True)):
            n, left = int(n), int(count)
            take = left if n == 0 else min(left, max((most - used) // n, 0 if held else 1))
            held, used, left = held + take, used + take * n, left - take
            if left:
                found.append([batch, 1, held, used])
                each = max(most // n, 1)
                full, rest = divmod(left, each)
                whole = full if rest else full - 1  # the last batch stays open
                if whole:
                    found.append([batch + 1, whole, each, each * n])
                batch, held = batch + 1 + whole, rest or each
                used = held * n
        if held:
            found.append([batch, 1, held, used])
        out = pd.DataFrame(found, columns=["first", "batches", "n_rows", "tokens"], dtype="int64")
        return out.assign(group=pdf["g"].iloc[0])[["group", "first", "batches", "n_rows", "tokens"]]

    counts = rows.groupBy(F.col(group).alias("g"), F.col(size).alias("n")).agg(F.count("*").alias("c"))
    laid = counts.groupBy("g").applyInPandas(lay, "group string, first long, batches long, n_rows long, tokens long")
    every = F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("batches") - 1).cast("int"))
    return laid.select(F.col("group").alias(group), F.explode(every).alias("batch"), "n_rows", "tokens")
