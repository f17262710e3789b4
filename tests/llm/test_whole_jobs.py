"""Cases that operators and stages used to cut short."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import ann, license_scan, line_dedup, near_copies, shared

from .test_operators import prose


@pytest.mark.parametrize(("copies", "noise"), [(3000, 0.01), (500, 0.01), (3000, 0.2), (500, 0.2)])
def test_ann_tells_near_copies_apart(copies, noise):
    """Near copies share their codes; the nearest are found all the same."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x[:copies] = x[0] + noise * rng.normal(size=(copies, 64))
    book = ann.fit(x[::5])
    codes = ann.packed(ann.assign(book, ann.paired(x)))
    asked = np.concatenate([np.arange(0, copies, copies // 20), np.arange(copies, 6000, 500)])
    q, v, score = ann.search_tile(book, np.arange(6000), x, codes, asked, x[asked], 5, ann.RERANK)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in asked:
        exact = unit @ unit[i]
        exact[i] = -9
        got = v[q == i][np.lexsort((v[q == i], -score[q == i]))]
        assert got.tolist() == np.lexsort((np.arange(6000), -exact))[:5].tolist()


def licences(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in license_scan.license_scan(docs).orderBy("doc_id").collect()]


def test_license_scan_finds_spdx_marks(spark):
    texts = ["// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: Apache-2.0", "/* spdx-license-identifier:  GPL-3.0-only */\nint y;", "SPDX-License-Identifier:BSD-3-Clause", "x\n# SPDX-License-Identifier: MIT\n# Copyright 2020 A\nimport b"]
    assert licences(spark, texts) == ["MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MIT"]


MIT = """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""

BSD = """Copyright (c) 2020, A Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_license_scan_finds_published_texts(spark):
    commented = lambda t, mark: "\n".join(f"{mark} {line}".rstrip() for line in t.split("\n"))
    gpl2 = GPL.replace("Foundation, either version 3", "Foundation; either version 2")
    texts = [MIT, BSD, GPL, gpl2, GPL.replace("\n", " "), GPL.replace("GNU General", "GNU Lesser General"), "Under the GNU General Public License version 3 or, at your option, any later version."]
    want = ["MIT", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-3.0-or-later", "GPL-3.0-or-later"]
    texts += [commented(t, mark) for t in (MIT, BSD, GPL) for mark in ("//", " *", "#", "--")] + [t.replace("\n", "\r\n") for t in (MIT, BSD, GPL)]
    want += [w for w in want[:3] for _ in range(4)] + want[:3]
    assert licences(spark, texts) == want


def test_language_stage_rejects_unknown_languages(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, ("abcde", "vwxyz")[k % 2], rng.randrange(3, 40)), ("aa", "zz")[k % 2]) for k in range(300)]
    foreign = [prose(rng, "mnopq"), prose(rng, "бвгде"), "すべての人間は生まれながらにして自由であり", "xkq zrtpl mwvbn qqzx hjklp wrtzx cvbnm ghtrw plkjh", prose(rng, "ghijkl", 5)]
    planted = [(1000 + k, t, ("aa", None)[k % 2]) for k, t in enumerate(foreign)]
    docs = spark.createDataFrame(rows + planted, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {k for k, *_ in rows}


def test_line_dedup_against_brute_force(spark):
    """Null and shared identifiers, repeated rows, short, empty and null texts, one passage in a third of all rows."""
    draw = random.Random(5)
    common = "\n".join(["all", "of", "us", "", "again"])
    rows = [(None, "a\nb\nc"), (7, "a\nb\nc"), (7, "a\nb\nc"), (8, None), (8, None), (9, ""), (9, "x\ny"), (10, "x\nx\nx\nx\nx"), (11, "\n\n\n\n")]
    for k in range(20, 320):
        lines = [draw.choice("pqrstuvw") * draw.randint(1, 3) for _ in range(draw.randint(0, 12))]
        rows.append((k, "\n".join(lines + ([common] if k % 3 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    first, distinct = {}, {r for r in rows if r[1] is not None}
    windows = lambda text: [tuple(text.split("\n")[k : k + 3]) for k in range(text.count("\n") - 1)]
    place = lambda d, k: (d is not None, d or 0, k)
    for d, text in distinct:
        for k, w in enumerate(windows(text)):
            first[w] = min(first.get(w, place(d, k)), place(d, k))

    def expected(d, text):
        if text is None:
            return (d, 0, 0, "", None)
        gone = sorted({k + j for k, w in enumerate(windows(text)) if first[w] != place(d, k) for j in range(3)})
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        return (d, text.count("\n") + 1, len(gone), ",".join(map(str, gone)), hashlib.md5(left.encode()).hexdigest())

    got = Counter(tuple(r) for r in line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "removed", "text_md5").collect())
    assert got == Counter(expected(*r) for r in rows) and sum(1 for r in got if r[2]) > 100


def test_near_copies_that_bands_and_fingerprints_miss(spark):
    """Texts of similarity 0.8 whose fingerprints differ in over 24 bits, or that agree in no band."""
    rows = [(2 * k + j, " ".join(f"{c}{k}" for c in "abcdefghi"[: 8 + j])) for k in (1707, 2094, 3676, 10261, 14419, 18114) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.one_of_each(docs).collect()} == {i for i, _ in rows if i % 2 == 0}


@pytest.mark.parametrize("block", [2, 7])
def test_near_copies_over_blocks(spark, block, monkeypatch):
    """Groups of many blocks and no pivots: links between blocks are found all the same, and texts that have a prefix in common but don't link stay apart."""
    monkeypatch.setattr(near_copies, "PIVOTS", 0)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[:k], f"own{k}", *words[k + 1 :]])) for k in range(60)]  # neighbours link (0.8 or more), most others do not (0.7): one chain
    rows += [(100 + k, " ".join([*words[:30], *[f"x{k}.{j}" for j in range(8)]])) for k in range(12)]  # 26 of 42 shingles in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    full = shared.located(docs, "text", "doc_id")
    got = full.join(near_copies.near_copy_classes(full.select("_file", "_row", "_c0"), block=block), ["_file", "_row"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.label, set()).add(r._c1)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label = {i: min(label[a], label[b]) if x in (label[a], label[b]) else x for i, x in label.items()}
    want = {}
    for i, x in label.items():
        want.setdefault(x, set()).add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()} and len(want) < len(rows)
