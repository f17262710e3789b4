"""Text as column expressions: all of these stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULTS, PAGE_FURNITURE, STOPWORDS

#: A sentence ends after . ! or ? (with closing marks) before white space and an opening of the next one.
SENTENCE_END = r"""(?<=[.!?])["')\]]*(?U:\s+)(?=["'(\[]*[A-Z0-9$])"""

#: The namespace of names that are URLs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def terms(text: Column) -> Column:
    """Lower-case words of letters a to z and digits, without stopwords, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    """sha256 of the text with white space collapsed, ends trimmed, in lower case."""
    return F.sha2(F.lower(stripped(F.regexp_replace(text, r"(?U)\s+", " "))), 256)


def cleaned(text: Column) -> Column:
    """Without page furniture; no-break spaces and runs of blanks become one, more than one blank line too."""
    footer, *others = PAGE_FURNITURE
    text = F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, footer, " ")).otherwise(text)  # the footer has bars, and is slow to look for
    text = reduce(lambda t, p: F.regexp_replace(t, p, " "), others, text)
    text = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    return stripped(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n(?U:\s*)\n"), stripped)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences of paragraphs; abbreviations do end a sentence."""
    parts = F.flatten(F.transform(paragraphs(text), lambda p: F.split(p, SENTENCE_END)))
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def tokens(text: Column) -> Column:
    """The stand-in tokenizer: runs of characters that aren't white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0)


def token_estimate(token_count: Column, text: Column) -> Column:
    """The stored count, or a quarter of the length (1 at least) where that is 0 or missing."""
    return F.when(F.coalesce(token_count, F.lit(0)) != 0, token_count).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int")))


def hard_split(words: Column, budget: int, overlap: int) -> Column:
    """Windows of `budget` tokens every budget - overlap (1 at least), until one reaches the end."""
    step = max(1, budget - overlap)
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - budget) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(words, k * step + 1, budget))).otherwise(F.array().cast("array<array<string>>"))


def uri_parts(uri: Column) -> Column:
    """cik, accession and document of a path .../cik/accession/document; cik and accession only if cik is a number."""
    parts = F.filter(F.split(F.regexp_replace(uri, "^[a-z]+://[^/]+/", ""), "/"), lambda p: p != "")
    has = (F.size(parts) >= 3) & F.coalesce(F.try_element_at(parts, F.lit(-3)).rlike("^[0-9]+$"), F.lit(False))
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.struct(F.when(has, at(-3)).alias("cik"), F.when(has, at(-2)).alias("accession"), at(-1).alias("document"))


def filled(*choices: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def header(company: Column, ticker: Column, cik: Column, form: Column, year: Column, filed: Column, item: Column, title: Column) -> Column:
    head = F.concat(filled(company, cik), F.lit(" ("), filled(ticker, cik), F.lit(") "), F.coalesce(form, F.lit("10-K")))
    return stripped(F.concat(head, F.lit(" "), filled(year, filed), F.lit(" - Item "), item, F.lit(". "), F.coalesce(title, F.lit(""))))


def embed_text(head: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(head, F.lit("")), body)


def citation_label(name: Column, section: Column, title: Column) -> Column:
    item = F.when(filled(section) != "", F.rtrim(F.concat(F.lit("Item "), section, F.lit(". "), F.coalesce(title, F.lit("")))))
    return F.concat_ws(" | ", F.nullif(name, F.lit("")), item)


def name_uuid(name: Column) -> Column:
    """The version 5 UUID of a name under the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3))]
    return F.concat_ws("-", *parts, F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def chunk_id(tenant: Column, uri: Column, item: Column, kept: Column, fingerprint: str = DEFAULTS.fingerprint()) -> Column:
    name = F.concat(tenant, F.lit("|"), uri, F.lit("#item="), item, F.lit("&i="), kept.cast("string"), F.lit(f"&cfg={fingerprint}"))
    return name_uuid(name)
