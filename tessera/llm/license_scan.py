"""Operator 1: licence scans by sentence rules; DataFrame functions only.

The lines of a paragraph are joined, without the marks of comments before them, but for
SPDX marks and lines that begin with a copyright.  Paragraphs are cut into sentences
after `.`, `!`, `?`, `:` and `;` before white space, but not after
`SPDX-License-Identifier:` and `v.` or before `either version`.  An SPDX mark names each
identifier of its expression.  A sentence is lower-cased,
everything but letters, digits, `.`, `+` and `-` becomes one space, and the ends are
trimmed.  All known sentences whose patterns are found in it name it, in the order of
their places, of several at one place the first known; a sentence that speaks of licences
but matches none is UNKNOWN.  Ordered rules then match the sequence of names but UNKNOWN:
each match gives its licence and uses its names up, so that a longer rule hides the
shorter ones after it.

Everything happens within a row: no shuffle, no state, any number of copies.

Cases: null and empty texts, and texts without any such sentence, give empty strings
and 0; repeated rows each give a row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences, by name, as patterns over normalised sentences; the first that is found counts.
SENTENCES = [
    ("SPDX-MIT", r"spdx-license-identifier mit$"),
    ("SPDX-APACHE-2.0", r"spdx-license-identifier apache-2.0$"),
    ("SPDX-GPL-3.0", r"spdx-license-identifier gpl-3.0(-only)?$"),
    ("SPDX-BSD-3", r"spdx-license-identifier bsd-3-clause$"),
    ("CC-BY-NC-ND", r"licensed under (a |the )?(cc|creative commons) by-nc-nd"),
    ("CC-BY-NC-SA", r"licensed under (a |the )?(cc|creative commons) by-nc-sa"),
    ("CC-BY-NC", r"licensed under (a |the )?(cc|creative commons) by-nc"),
    ("CC-BY-SA", r"licensed under (a |the )?(cc|creative commons) by-sa"),
    ("CC-BY", r"licensed under (a |the )?(cc|creative commons) by"),
    ("APACHE-2.0", r"licensed under the apache license version 2(\.0)?"),
    ("APACHE-COPY", r"may obtain a copy of the license at"),
    ("APACHE-BASIS", r"distributed under the license is distributed on an as is basis"),
    ("LGPL-3", r"gnu lesser general public license version 3"),
    ("LGPL-2", r"gnu lesser general public license version 2"),
    ("AGPL-3", r"gnu affero general public license version 3"),
    ("GPL-3", r"gnu general public license version 3"),
    ("GPL-2", r"gnu general public license version 2"),
    ("ANY-LATER", r"at your option any later version"),
    ("MIT-NAME", r"(released|licensed|distributed) under the (terms of the )?mit license"),
    ("MIT-GRANT", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT-NOTICE", r"copyright notice and this permission notice shall be included"),
    ("BSD-USE", r"redistribution and use in source and binary forms"),
    ("BSD-SOURCE", r"redistributions of source code must retain the above copyright notice"),
    ("BSD-BINARY", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSD-NAMES", r"neither the name .* used to endorse or promote products"),
    ("MPL-2.0", r"mozilla public license (version|v\.) 2\.0"),
    ("PUBLIC-DOMAIN", r"(released|placed) (into|in) the public domain"),
    ("AS-IS", r"provided as is without warrant(y|ies)"),
    ("ALL-RIGHTS", r"all rights reserved"),
    ("COPYRIGHT", r"^copyright "),
]

#: Patterns that also find the wording of the published notices; the SQL has the shorter ones above.
_PUBLISHED = r"public license( as published by the free software foundation)?( either)? version"
WORDINGS = {n: p.replace("public license version", _PUBLISHED) for n, p in SENTENCES if "general public license version" in p}

#: Sentences of further published licences, which come before those above and aren't in the SQL.
MORE_SENTENCES = [
    ("LGPL-2.1", rf"gnu lesser general {_PUBLISHED} 2\.1"),
    ("ISC-GRANT", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0BSD-GRANT", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted$"),
]

#: Rules over these names, and over names above, that aren't in the SQL.
MORE_RULES = [
    (["LGPL-2.1", "ANY-LATER"], "LGPL-2.1-or-later"),
    (["LGPL-2.1"], "LGPL-2.1"),
    (["AGPL-3", "ANY-LATER"], "AGPL-3.0-or-later"),
    (["ISC-GRANT"], "ISC"),
    (["0BSD-GRANT"], "0BSD"),
]

#: An SPDX mark and its expression: identifiers, with and, or, with and brackets between them.
_IDENTIFIER = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = rf"(?i)spdx-license-identifier:\s*((?:\(\s*)*{_IDENTIFIER}(?:\s*\))*(?:\s+(?:and|or|with)\s+(?:\(\s*)*{_IDENTIFIER}(?:\s*\))*)*)"
#: Identifiers that have a sentence's name above.
SPDX_NAMES = {"mit": "SPDX-MIT", "apache-2.0": "SPDX-APACHE-2.0", "gpl-3.0": "SPDX-GPL-3.0", "gpl-3.0-only": "SPDX-GPL-3.0", "bsd-3-clause": "SPDX-BSD-3"}

#: Ordered rules: sequences of sentence names and the licence that they state.
RULES = [
    (["SPDX-MIT"], "MIT"),
    (["SPDX-APACHE-2.0"], "Apache-2.0"),
    (["SPDX-GPL-3.0"], "GPL-3.0"),
    (["SPDX-BSD-3"], "BSD-3-Clause"),
    (["BSD-USE", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES"], "BSD-3-Clause"),
    (["BSD-USE", "BSD-SOURCE", "BSD-BINARY"], "BSD-2-Clause"),
    (["MIT-GRANT", "MIT-NOTICE"], "MIT"),
    (["MIT-NAME"], "MIT"),
    (["APACHE-2.0", "APACHE-COPY", "APACHE-BASIS"], "Apache-2.0"),
    (["APACHE-2.0"], "Apache-2.0"),
    (["GPL-3", "ANY-LATER"], "GPL-3.0-or-later"),
    (["GPL-2", "ANY-LATER"], "GPL-2.0-or-later"),
    (["LGPL-3", "ANY-LATER"], "LGPL-3.0-or-later"),
    (["LGPL-2", "ANY-LATER"], "LGPL-2.0-or-later"),
    (["GPL-3"], "GPL-3.0"),
    (["GPL-2"], "GPL-2.0"),
    (["LGPL-3"], "LGPL-3.0"),
    (["LGPL-2"], "LGPL-2.0"),
    (["AGPL-3"], "AGPL-3.0"),
    (["MPL-2.0"], "MPL-2.0"),
    (["CC-BY-NC-ND"], "CC-BY-NC-ND"),
    (["CC-BY-NC-SA"], "CC-BY-NC-SA"),
    (["CC-BY-NC"], "CC-BY-NC"),
    (["CC-BY-SA"], "CC-BY-SA"),
    (["CC-BY"], "CC-BY"),
    (["PUBLIC-DOMAIN"], "Public-Domain"),
    (["COPYRIGHT", "ALL-RIGHTS"], "Proprietary"),
]

#: Every pattern above needs one of these, so other texts and sentences have no known sentence.
MENTION = r"licen[cs]e|copyright|permission|redistribution|public domain|warrant|all rights reserved|at your option"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (names, joined by commas), licenses (sorted, joined by commas), n_unknown of every row."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    text = F.regexp_replace("text", r"(?md)\r$|^[\x20\t]*(?:(?://+|/\*+/?|\*+/?|#+|--+|;+|%+|<!--|>+)[\x20\t]*)?", "")
    text = F.regexp_replace(text, r"(?md)^(.*(?i:spdx-license-identifier:).*)$", "\n$1\n")
    text = F.regexp_replace(text, r"(?md)^(?=Copyright |(?i:copyright)\s+(?:\([cC]\)|©|[0-9]))", "\n")
    text = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    cut = F.split(F.regexp_replace(text, r"([.!?:]|;(?!\s+either\s+version))(?<!(?i:spdx-license-identifier:))(?<!(?i:\bv\.))[\x20\x09-\x0D]+", "$1\n"), "\n")
    told = F.filter(cut, lambda s: s.rlike(f"(?i){MENTION}"))

    def cleaned(sentence):
        clean = F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9.+-]+", " "))
        return F.regexp_replace(clean, r"\.$", "")

    def found_in(clean):
        known = [*MORE_SENTENCES, *((n, WORDINGS.get(n, p)) for n, p in SENTENCES)]
        places = [F.struct(F.regexp_instr(clean, F.lit(p)).alias("at"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (n, p) in enumerate(known)]
        return F.array_sort(F.filter(F.array(*places), lambda x: x["at"] > 0))

    def marked(sentence):
        """Names of the identifiers of an SPDX mark; an exception after `with` is no licence."""
        ids = F.regexp_extract_all(F.regexp_replace(F.regexp_extract(sentence, SPDX, 1), r"(?i)\bwith\s+\S+", ""), F.lit(_IDENTIFIER), 0)
        ids = F.transform(F.filter(ids, lambda x: ~F.lower(x).isin("and", "or")), lambda x: F.regexp_replace(x, r"\.$", ""))
        names = F.create_map(*[F.lit(x) for pair in SPDX_NAMES.items() for x in pair])
        return F.transform(ids, lambda x: F.coalesce(names[F.lower(x)], F.concat(F.lit("SPDX:"), x)))

    def named(hits):
        first = F.filter(hits, lambda x, i: ~F.get(hits, i - 1)["at"].eqNullSafe(x["at"]))
        return F.when(F.size(hits) == 0, F.array(F.lit("UNKNOWN"))).otherwise(F.transform(first, lambda x: x["name"]))

    # step by step, as what stands in a function of an array's elements is computed wherever it's named
    steps = F.transform(told, lambda s: F.struct(F.when(s.rlike(SPDX), marked(s)).alias("marks"), cleaned(s).alias("clean")))
    steps = F.transform(steps, lambda x: F.struct(x["marks"].alias("marks"), F.when(x["marks"].isNull(), found_in(x["clean"])).alias("hits")))
    told = F.transform(steps, lambda x: F.coalesce(x["marks"], named(x["hits"])))
    names = F.when(F.col("text").rlike(f"(?i){MENTION}"), F.flatten(told))
    found = docs.select("doc_id", F.coalesce(names, F.array().cast("array<string>")).alias("names"))
    found = found.withColumn("sentence_ids", F.array_join("names", ","))
    rest = F.concat(F.lit(","), F.array_join(F.filter("names", lambda n: n != "UNKNOWN"), ",,"), F.lit(","))
    rules = F.array(*[F.struct(F.lit("".join(f",{n}," for n in sequence)).alias("names"), F.lit(licence).alias("licence")) for sequence, licence in ordered_rules()])

    def applied(state, rule):
        used = F.struct(F.replace(state["rest"], rule["names"], F.lit(",")).alias("rest"), F.array_append(state["hits"], rule["licence"]).alias("hits"))
        return F.when(F.contains(state["rest"], rule["names"]), used).otherwise(state)

    hits = F.aggregate(rules, F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("hits")), applied)["hits"]
    spdx = F.transform(F.filter("names", lambda n: n.startswith("SPDX:")), lambda n: F.regexp_replace(F.regexp_replace(F.substring(n, 6, 1000), "-only$", ""), r"\+$", "-or-later"))
    licenses = F.array_join(F.array_sort(F.array_distinct(F.concat(hits, spdx))), ",")
    licenses = F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(licenses)
    n_unknown = F.size(F.filter("names", lambda s: s == "UNKNOWN")).cast("long")
    return found.select("doc_id", "sentence_ids", licenses.alias("licenses"), n_unknown.alias("n_unknown"))


def ordered_rules() -> list[tuple[list[str], str]]:
    """All rules, longest statements first: a licence after a reserved copyright isn't proprietary."""
    reserved, _ = RULES[-1]
    rules = [*MORE_RULES, *RULES]
    return [(reserved + names, licence) for names, licence in rules if names != reserved] + rules


def license_sql() -> str:
    """As DuckDB SQL, line by line and with one name for a sentence: the same where no statement is wrapped or holds several names."""
    quoted = "'" + "(?i)" + MENTION + "'"
    cases = " ".join(f"when regexp_matches(c, '{p}') then '{n}'" for n, p in SENTENCES)
    steps, rest, hits = [], "left0", []
    for k, (sequence, licence) in enumerate(RULES):
        pattern = "".join(f",{s}," for s in sequence)
        steps.append(f"s{k} as (select *, case when contains({rest}, '{pattern}') then '{licence}' end as h{k}, replace({rest}, '{pattern}', ',') as left{k + 1} from {'named' if not k else f's{k - 1}'})")
        rest = f"left{k + 1}"
        hits.append(f"h{k}")
    return rf"""
    with cut as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?:;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, {quoted})) as told from documents),
    clean as (select doc_id, list_transform(coalesce(told, []), lambda s: regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9.+-]+', ' ', 'g'), ' '), '\.$', '')) as told from cut),
    ids as (select doc_id, list_transform(told, lambda c: case {cases} else 'UNKNOWN' end) as names from clean),
    named as (select doc_id, names, array_to_string(names, ',') as sentence_ids, ',' || array_to_string(names, ',,') || ',' as left0 from ids),
    {", ".join(steps)}
    select doc_id, coalesce(sentence_ids, '') as sentence_ids,
      coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(hits)}], lambda x: x is not null))), ','), '') as licenses,
      len(list_filter(names, lambda s: s = 'UNKNOWN'))::bigint as n_unknown
    from s{len(RULES) - 1}"""
