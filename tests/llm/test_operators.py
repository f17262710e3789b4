"""The training-data operators against brute force, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tessera.llm import ann, bpe_codec, near_copies, shared, exact_dedup, language_id, license_scan, line_dedup, mixing, quality, simhash, token_counts
from tessera.llm.bpe import Merges
from tessera.llm.lexicon import Lexicon, compile_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, kept string, _gone string"
LONG = " ".join(f"word{k % 97}" for k in range(20_000))
ODD = [None, "", " ", "\n\n\n", "a", "a b", "...", "😀 ñandú Σίγμα ΟΔΟΣ", "x" * 5000, LONG, "a<|endoftext|>b <|startoftext|>", "tab\there\r\nline\x0bfeed", "I'll don't 'S ''s", "é ﬁ Å 한글 ²½"]


def table(spark, rows):
    """documents with more columns, whose names clash with those of results; rows: (doc_id, text, lang, source)."""
    full = [(i, t, g, s, None if t is None else len(t), "x", "y", "z", "w") for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 3}") for k, t in enumerate(ODD)]
    rows += [(1000 + k, "the same text\nin three lines\nof words\nand more", "en", "s1") for k in range(40)]
    return table(spark, [*rows, rows[-1], rows[4], (None, "no identifier here", "en", "s2"), (None, None, None, None)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_scan(spark, odd, empty):
    texts = {
        1: "Some words.\nReleased under the MIT License.\nMore.",
        2: "This work is licensed under the GNU General Public License, version 3. Either that or, at your option, any later version.",
        3: "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
        4: "This licence is my own.",
        5: "Redistribution and use in source and binary forms are allowed. Redistributions of source code must retain the above copyright notice. "
        "Redistributions in binary form must reproduce the above copyright notice.",
        6: "nothing here",
    }
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, [(k, t, "en", "s") for k, t in texts.items()])).collect()}
    assert [got[k].licenses for k in range(1, 7)] == ["MIT", "GPL-3.0-or-later", "Apache-2.0,CC-BY-NC", "", "BSD-2-Clause", ""]
    assert got[4].sentence_ids == "UNKNOWN" and got[4].n_unknown == 1 and got[6].n_unknown == 0
    assert license_scan.license_scan(odd).count() == odd.count() and license_scan.license_scan(empty).count() == 0


def brute_lines(rows):
    """Rows (doc_id, text) to kept texts, by going through all windows in order."""
    places = defaultdict(list)
    for i, t in rows:
        ls = (t or "").split("\n")
        for k in range(len(ls) - 2):
            places[tuple(ls[k : k + 3])].append((i, k))
    gone = defaultdict(set)
    for at in places.values():
        for i, k in sorted(at)[1:]:
            gone[i] |= {k, k + 1, k + 2}
    return {i: None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup(spark, odd, empty):
    rng = random.Random(1)
    rows = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))) for k in range(120)] + [(500, None), (501, "")]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    want = brute_lines(rows)
    assert {i: r.text_md5 for i, r in got.items()} == {i: None if t is None else hashlib.md5(t.encode()).hexdigest() for i, t in want.items()}
    kept = line_dedup.kept_lines(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert r.text == want[r.doc_id] and r.n_chars == (None if r.text is None else len(r.text))
    assert line_dedup.line_dedup(odd).count() == odd.count() and line_dedup.line_dedup(empty).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[100:400] = x[7]  # one common vector
    x[401] = 2 * x[7]
    rows = [(k, [float(v) for v in x[k]], "w", 1) for k in range(len(x))]
    rows += [(5000, None, "w", 1), (5050, [0.0] * 16, "w", 1), (5100, [float("nan")] * 16, "w", 1), (5150, [None] * 16, "w", 1), (5200, [1.0] * 15, "w", 1), (None, [1.0] * 16, "w", 1), rows[50]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int")
    got = defaultdict(list)
    found = ann.nearest(vectors, F.col("vec_id") % 50 == 0, block_rows=400, query_rows=16).collect()
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    length = np.sqrt((x**2).sum(axis=1))
    hits = 0
    for q in range(0, 1500, 50):
        score = (x * x[q]).sum(axis=1) / (length * length[q])
        score[q] = -9
        want = np.lexsort((np.arange(len(x)), -score))[:5]
        hits += len({int(w) for w in want} & {v for v, _ in got[q]})
        assert all(abs(score[v] - s) < 1e-12 for v, s in got[q]) and len(got[q]) == 5
    assert set(got) == set(range(0, 1500, 50)) and hits / (30 * 5) >= 0.9
    assert [v for v, _ in got[100]] == [7, 101, 102, 103, 104]
    assert ann.fiftieths(vectors.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.fiftieths(few).collect()] == [(0, 1, 1)]


def test_ann_repeats_and_extremes(spark):
    """Many copies of one row, ties, and vectors whose squares overflow or vanish."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 6))
    near = x[5] + 1e-3 * rng.normal(size=(60, 6))
    rows = [(1, x[5])] * 20 + [(k, x[5]) for k in (2, 3, 4)] + [(100 + k, x[k]) for k in range(120)] + [(300 + k, near[k]) for k in range(60)]
    rows += [(1, x[9]), (400, x[7] * 1e-200), (450, x[7] * 1e200), (460, x[8] * 5e-310)]
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in rows], "vec_id long, embedding array<double>").repartition(4)
    found = defaultdict(list)
    for r in sorted(ann.nearest(vectors, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=2, rerank=4).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    unit = lambda v: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())
    for q in {i for i, _ in rows if i % 50 == 0}:
        own = unit(next(r for i, r in rows if i == q))
        best = {}
        for i, r in rows:
            if i != q:
                best[i] = max(best.get(i, -2.0), float(own @ unit(r)))
        ids, scores = zip(*found[q], strict=True)
        assert len(set(ids)) == 5 and all(abs(best[i] - s) < 1e-12 for i, s in found[q])
        assert np.allclose(scores, sorted(best.values(), reverse=True)[:5], rtol=0, atol=1e-12)
        assert all(a < b for (a, s), (b, t) in zip(found[q], found[q][1:], strict=False) if s == t)


def prose(rng, letters, n=40):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_language_id(spark, odd, empty):
    rng = random.Random(3)
    rows = [(k, prose(rng, ("abcde", "vwxyz")[k % 2]), ("aa", "zz")[k % 2], "s") for k in range(300)] + [(900, None, "aa", "s"), (901, "12 34!", "zz", "s"), (902, "zzz", None, None)]
    got = {r.doc_id: r for r in language_id.language_id(table(spark, rows)).collect()}
    right = [got[i].lang_pred == g for i, t, g, _ in rows[:300] if got[i].held_out]
    assert 20 < len(right) and all(right) and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "zz"
    kept = language_id.with_language(table(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {900, 901}
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert language_id.language_id(odd).count() == odd.count() and language_id.language_id(empty).count() == 0


def scalar_bucket(gram, bits):
    """The bucket of an n-gram by whole numbers, apart from numpy."""
    wrap = 0xFFFFFFFF
    x = (ord(gram[0]) + 0x27D4EB2F * len(gram)) & wrap
    for c in gram[1:]:
        x = (x * 0x9E3779B1 + ord(c)) & wrap
    x = x * 0xC2B2AE35 & wrap
    x ^= x >> 15
    return (x * 0x85EBCA6B & wrap) >> (32 - bits)


def brute_language(rows, bits=16):
    """Multinomial naive Bayes by dictionaries: doc_id to language and probability."""
    def grams(text):
        t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        found = [t[k] for k in range(len(t)) if t[k] != " "]
        found += [t[k : k + n] for n in (2, 3) for k in range(len(t) - n + 1) if t[k : k + 2] != "  "]
        return [scalar_bucket(g, bits) for g in found]

    from zlib import crc32

    train = [(t, g) for i, t, g, _ in rows if crc32(str(i).encode()) % 5 and t is not None and g is not None]
    names = sorted({g for _, g in train})
    counts, prior = {g: Counter() for g in names}, Counter(g for _, g in train)
    for t, g in train:
        counts[g].update(grams(t))
    total = {g: sum(counts[g].values()) + 0.5 * 2**bits for g in names}
    out = {}
    for i, t, *_ in rows:
        if not any(c.isalpha() for c in t or ""):
            out[i] = ("und", 0.0)
            continue
        n = Counter(grams(t))
        score = [np.log(prior[g] / len(train)) + sum(c * np.log((counts[g][b] + 0.5) / total[g]) for b, c in n.items()) for g in names]
        best = int(np.argmax(score))
        out[i] = (names[best], 1 / float(np.exp(np.array(score) - score[best]).sum()))
    return out


def test_language_id_against_brute_force(spark):
    rng = random.Random(13)
    letters = ["abcdefgh", "defghijk", "éñabcd", "ШЩабвг"]
    rows = [(k, prose(rng, letters[k % 4], rng.randrange(1, 12)), f"g{k % 4}", "s") for k in range(160)]
    rows += [(500 + k, t, None, "s") for k, t in enumerate(ODD[:12] + ["İstanbul ǅ", "a1b2", "-"])]
    want, size = brute_language(rows), {i: len(t or "") for i, t, *_ in rows}
    for r in language_id.language_id(table(spark, rows)).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-4 + 1e-6 * size[r.doc_id], r  # weights are in single precision


def test_language_id_of_many_languages(spark):
    """No language is left out, and the matrix keeps its bound by fewer buckets."""
    rng = random.Random(14)
    words = {f"g{k:03}": [prose(rng, "abcdefghijklmnop", 3) for _ in range(3)] for k in range(300)}
    rows = [(6 * k + j, " ".join(rng.choice(w) for _ in range(6)), g, "s") for k, (g, w) in enumerate(words.items()) for j in range(6)]
    got = language_id.language_id(table(spark, rows)).collect()
    right = {i: g for i, _, g, _ in rows}
    assert len({r.lang_pred for r in got}) >= 295 and sum(r.lang_pred == right[r.doc_id] for r in got) > 0.9 * len(got)
    model = language_id.learn(table(spark, rows), F.lit(True), matrix=1 << 18)
    assert len(model.languages) == 300 and model.weights.size < 1 << 18 and np.allclose(np.exp(model.weights[:, :-1]).sum(axis=1), 1, atol=1e-3)


def test_token_counts(spark, odd, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    for r, t in ((r, t) for r in token_counts.token_counts(odd).collect() for k, t in enumerate(ODD) if r.doc_id == k):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), count(t), count(t) > 512)
    assert token_counts.token_counts(empty).count() == 0
    own = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abcdefghi  stnrETH\n',.é0") for _ in range(rng.randrange(1, 40)))
        assert own.count(text) == count(text)
        ends, counts = own.prefix_counts(text)
        assert ends[-1] == len(text.encode()) and counts[-1] == count(text)
        cut = text.encode()[: own.truncated(text, 5)].decode()
        assert count(cut) <= 5
    word = b"antidisestablishmentarianism"
    assert own.table(word)[1:] == [count(word[:k].decode()) for k in range(1, len(word) + 1)]


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[k : k + 3]), seed=42).intdigest() for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Smallest doc_id reachable, for rows (doc_id, fingerprint)."""
    parent = list(range(len(prints)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    lowest = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        lowest[top(k)].append(i)
    return {(i, f): min((x for x in lowest[top(k)] if x is not None), default=None) for k, (i, f) in enumerate(prints)}


@pytest.mark.parametrize("group_rows", [400_000, 6])
def test_simhash(spark, odd, empty, group_rows):
    rng = random.Random(5)
    rows = list(enumerate(ODD))
    for k in range(40):
        words = prose(rng, "abcdefgh", 60).split()
        for c in range(5):
            rows.append((100 + 5 * k + c, " ".join(words)))
            words[rng.randrange(len(words))] += "q"
    got = simhash.simhash_components(table(spark, [(i, t, "en", "s") for i, t in rows]), group_rows=group_rows).collect()
    want = brute_components([(i, brute_simhash(t)) for i, t in rows])
    assert {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in got} == want
    if group_rows > 6:
        found = simhash.simhash_dedup(odd)
        assert found.count() == odd.count() and {len(r.fingerprint) for r in found.collect()} == {16}
        assert simhash.simhash_dedup(empty).count() == 0
        kept = simhash.one_of_each(odd)
        assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id >= 1000) == {1000: 1}


def brute_near(rows, similarity=0.8):
    """Groups of row numbers that five-word similarity connects, by all pairs."""
    sets = []
    for _, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if label[a] != label[b] and (s == t or len(s & t) >= similarity * len(s | t) > 0):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    return label


@pytest.mark.parametrize("block", [1000, 6])
def test_near_copies(spark, odd, empty, block, monkeypatch):
    monkeypatch.setattr(near_copies, "PIVOTS", min(block, near_copies.PIVOTS))
    rng = random.Random(15)
    rows = list(enumerate(ODD)) + [(900, "Same  Words here"), (901, "same words HERE"), (None, "same words here"), (902, None)]
    for k in range(12):
        words = prose(rng, "abcdefgh", 120).split()
        for c in range(8):
            rows.append((100 + 8 * k + c, " ".join(words)))
            words[rng.randrange(len(words))] += "q"
            if c % 3 == 2:
                words[rng.randrange(len(words))] = "z"
    rows += [(100, "another text under the same number " + prose(rng, "xyz", 30))]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    full = shared.located(docs, "text", "doc_id")
    got = near_copies.near_copy_classes(full.select("_file", "_row", "_c0"), block=block)
    by_row = defaultdict(set)
    found = full.join(got, ["_file", "_row"]).select(F.col("_c1").alias("i"), F.col("_c0").alias("t"), "label").collect()
    for r in found:
        by_row[r.label].add((r.i, r.t))
    label, want = brute_near(rows), defaultdict(set)
    for k, r in enumerate(rows):
        want[label[k]].add(r)
    assert len(found) == len(rows) and {frozenset(x) for x in by_row.values()} == {frozenset(x) for x in want.values()}
    if block > 6:
        kept = near_copies.one_of_each(docs)
        first = [min(x, key=lambda r: (r[0] is None, r[0] or 0)) for x in want.values()]
        assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(first)
        assert near_copies.one_of_each(empty).count() == 0


def test_near_copies_in_hot_groups(spark):
    """Ninety in a hundred texts are near copies in one chain of blocks; the rest stays apart."""
    rng = random.Random(16)
    words = prose(rng, "abcdefgh", 200).split()
    rows = [(k, " ".join([*words[: (s := rng.randrange(190))], f"w{k}", *words[s + 1 :]])) for k in range(1800)]
    rows += [(5000 + k, prose(rng, "abcdefgh", 60)) for k in range(200)]
    kept = {r.doc_id for r in near_copies.one_of_each(table(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert kept == {0, *range(5000, 5200)}


def test_simhash_index():
    rng = np.random.default_rng(6)
    for bits, n in ((12, 900), (63, 400)):
        fp = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64))
        index = simhash.Index(np.zeros(len(fp), np.int64), fp)
        got = {(int(index.fp[a]), int(index.fp[b])) for i, j in index.pairs(frontier=5000) for a, b in zip(i, j, strict=True)}
        want = {(a, b) for a in fp.tolist() for b in fp.tolist() if a < b and (a ^ b).bit_count() <= 3}
        assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)


def test_bpe_codec(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = dict(enumerate(ODD))
    for words in (5, 1000):
        for r in bpe_codec.bpe_codes(odd, words=words, with_ids=True).collect():
            if r.doc_id in texts:
                ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
                back = library.decode(ids, skip_special_tokens=False)
                assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, back)
                assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe_codec.bpe_codes(empty).count() == 0
    counts = {r.word: r.n for r in bpe_codec.word_counts(table(spark, [(1, "To be, or not to BE", "en", "s"), (2, None, "en", "s")])).collect()}
    assert counts == {"to": 2, "be": 2, ",": 1, "or": 1, "not": 1}


def test_lexicon():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["b", "a", "tap", "taps", "top", "tops", "stops", "été", "zzz"])}
    lexicon = Lexicon(compile_words(words.items()))
    assert all(lexicon.find(w) == ids for w, ids in words.items()) and lexicon.words == 9
    assert all(lexicon.find(w) is None for w in (b"", b"t", b"topsx", b"st", b"c", "é".encode()))
    assert lexicon.states < sum(map(len, words))
    assert Lexicon(compile_words([])).find(b"a") is None


def test_merges_long_and_short():
    merges, rng = Merges(public_tokenizers.path("word_bpe_49k.json")), random.Random(7)
    for _ in range(200):
        word = merges.symbols("".join(rng.choice("abenrst") for _ in range(rng.randrange(1, 90))))
        assert merges._merge_short(word.copy()) == merges._merge_long(word.copy())


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = Counter()
    for same, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        for k, (_, no_id, i) in enumerate(members):
            out[None if no_id else i, keep, len(members), k == 0, hashlib.sha256(same.encode()).hexdigest()] += 1
    return out


def weak(text):
    from pyspark.sql import functions as F

    return F.unhex(F.lpad(F.hex(F.length(text) % 3), 16, "0"))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_exact_dedup(spark, odd, empty, digest, monkeypatch):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a b c", "ab c", " abc ", "abd", "x\ty", "xy", "", None])) for k in range(200)] + list(zip(range(300, 330), ODD, strict=False)) + [(7, "a b c"), (None, "abd")]
    found = exact_dedup.grouped(table(spark, [(i, t, "en", "s") for i, t in rows]), digest).collect()
    got = Counter((r.doc_id, r.keep.doc_id, r.group_size, (r.file, r.row) == (r.keep.file, r.keep.row)) for r in found)
    want = Counter()
    for key, n in brute_dedup(rows).items():
        want[key[:4]] += n
    assert got == want
    if digest is exact_dedup.sha256:
        assert exact_dedup.exact_dedup(odd).count() == odd.count() and exact_dedup.exact_dedup(empty).count() == 0
        full = Counter(tuple(r) for r in exact_dedup.exact_dedup(table(spark, [(i, t, "en", "s") for i, t in rows])).collect())
        assert full == brute_dedup(rows)


def test_exact_dedup_state_goes_on(spark, tmp_path):
    """A later run with the same checkpoint meets the state of the first."""
    from pyspark.sql import functions as F

    folder, out, checkpoint = (str(tmp_path / x) for x in ("rows", "out", "checkpoint"))
    parts = [[(1, "a b"), (2, "c")], [(0, "ab"), (3, "a  b"), (4, "d")]]
    for rows in parts:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({"file": F.lit("f"), "row": F.col("doc_id")})
        content = exact_dedup.contents(df)
        content.write.mode("append").parquet(folder)
        exact_dedup.deduplicated(spark.readStream.schema(content.schema).parquet(folder), checkpoint, out)
    got = {r.keep.doc_id: r.group_size for r in exact_dedup.latest(spark, out).collect()}
    assert got == {3: 3, 2: 1, 4: 1}


def test_quality(spark, odd, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(400):
        text = prose(rng, "abcdefgh", 50)
        rows.append((k, text if k % 4 else text.upper().replace(" ", "!! "), "en", "s"))
        labels.append((k, int(k % 4 > 0), 0))
    labels += [(None, 1, 0), (5, None, 0), (99999, 1, 0), labels[3]]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(table(spark, [*rows, (900, None, None, None)]), marks).collect()}
    assert all(got[k].predicted == int(k % 4 > 0) for k in range(400)) and 0 <= got[900].score <= 1
    assert all((r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())
    assert quality.quality_scores(odd, marks.limit(0)).where("score = 0.5").count() == odd.count()
    assert quality.quality_scores(empty, marks).count() == 0


def test_quality_against_brute_force(spark):
    """Ratios by counting, the fit by its duality gap, and scores by sums over sets of indicators."""
    rng = random.Random(17)
    texts = [prose(rng, "abcdefgh" if k % 3 else "efghijkl", rng.randrange(3, 30)) for k in range(300)]
    y = np.array([int(k % 3 > 0) if rng.random() < 0.9 else int(k % 3 == 0) for k in range(300)])
    marks = [quality.packed(m) for m in quality.indicators(texts, 16)]
    sets = [set(quality.unpacked(m).tolist()) for m in marks]
    dense = np.zeros(1 << 16, np.float32)
    dense[:40_000:2] = 1
    assert quality.packed(dense)[:1] == b"b" and np.array_equal(quality.unpacked(quality.packed(dense)), np.flatnonzero(dense))
    for t, s in zip(texts[:20], sets, strict=False):
        padded = f" {t} "
        grams = {scalar_bucket(padded[k : k + n], 16) for n in (1, 2, 3) for k in range(len(padded) - n + 1)}
        assert grams <= s
    model = quality.fit(marks, y, 16)
    fits = np.ones(300, bool)
    for side in (0, 1):
        fits[np.flatnonzero(y == side)[::5]] = False
    n = [Counter(b for k in range(300) if fits[k] and y[k] == side for b in sets[k]) for side in (0, 1)]
    total = [sum(c.values()) + 2.0**16 for c in n]
    ratio = lambda b: np.log((n[1][b] + 1) / total[1]) - np.log((n[0][b] + 1) / total[0])
    assert all(abs(model.ratio[b] - ratio(b)) < 1e-5 for b in set().union(*sets[:30]))

    def margin(s):
        return sum(ratio(b) * model.weight[b] for b in s) / np.sqrt(sum(ratio(b) ** 2 for b in s)) + model.intercept

    side = np.where(y > 0, 1, -1)
    cost = {v: fits.sum() / (2 * np.sum(side[fits] == v)) for v in (-1, 1)}
    primal = 0.5 * (model.weight @ model.weight + model.intercept**2) + sum(cost[side[k]] * max(0, 1 - side[k] * margin(sets[k])) for k in np.flatnonzero(fits))
    rest = rng.sample(range(300), 40)
    for _ in range(20):  # no small step from the fit lowers the objective
        step = np.array([rng.gauss(0, 1) for _ in range(300)])
        direction = defaultdict(float)
        for k in rest:
            length = np.sqrt(sum(ratio(b) ** 2 for b in sets[k]))
            for b in sets[k]:
                direction[b] += 1e-3 * step[k] * ratio(b) / length
        moved = lambda s: sum(ratio(b) * (model.weight[b] + direction.get(b, 0)) for b in s) / np.sqrt(sum(ratio(b) ** 2 for b in s)) + model.intercept  # noqa: B023, E731
        square = model.weight @ model.weight + sum(2 * model.weight[b] * d + d * d for b, d in direction.items()) + model.intercept**2
        assert 0.5 * square + sum(cost[side[k]] * max(0, 1 - side[k] * moved(sets[k])) for k in np.flatnonzero(fits)) > primal * (1 - 2e-3)
    docs = table(spark, [(k, t, "en", "s") for k, t in enumerate([*texts[:40], None, ""])])
    for r in quality.predict(docs.select("doc_id", "text"), model).collect():
        own = sets[r.doc_id] if r.doc_id < 40 else set()
        assert abs(r.score - 1 / (1 + np.exp(-(model.slope * (margin(own) if own else model.intercept) + model.offset)))) < 1e-4


def test_mixing_with_one_identifier(spark, monkeypatch):
    """Nine in ten rows share a doc_id, or have none: all places of the order are used, none twice."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rng = random.Random(18)
    for shared_id in (7, None):
        rows = [(shared_id if k % 10 else 1000 + k, prose(rng, "ab", rng.randrange(1, 9)), "a" if k % 4 else "b") for k in range(600)]
        docs = table(spark, [(i, t, "en", s) for i, t, s in rows])
        placed = mixing.placed(shared.located(docs, "doc_id", "text", "source")).collect()
        for rank in (1, 2):
            own = sorted((r["_sum"], r["_size"]) for r in placed if r["_rank"] == rank)
            assert [s for s, _ in own] == np.cumsum([n for _, n in own]).tolist()  # a running sum over all rows, in some order
        again = [sorted(tuple(r) for r in mixing.mixed(docs).collect() if r.doc_id is not None) for _ in range(2)]
        total = sum(len(t.split()) for _, t, _ in rows)
        taken = sum(r.taken for r in mixing.mixed(docs).collect())
        assert again[0] == again[1] and total - 9 < taken <= total


def brute_mix(rows):
    """Fair queueing row by row, for rows (doc_id, text, source): taken by doc_id, and targets by source."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    z = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * z[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        above = {s for s in names if s not in stopped and rest * weight[s] > 3 * z[s] * free}
        if not above:
            break
        stopped |= above
    target = {s: 3 * z[s] if s in stopped else rest * weight[s] / free for s in names}
    offers, sums = [], Counter()
    for i, _, s in sorted(rows, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
        sums[s] += size[i]
        offers += [((e * z[s] + sums[s]) / target[s], names.index(s), i) for e in range(3) if size[i]]
    taken, used = Counter(), 0
    for _, _, i in sorted(offers):
        if used + size[i] > total:
            break
        used, taken[i] = used + size[i], taken[i] + size[i]
    return taken, target


@pytest.mark.parametrize("bucket_rows", [20_000, 20])
def test_mixing(spark, odd, empty, bucket_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(10)
    rows = [(k, prose(rng, "ab", rng.randrange(0, 30)), rng.choice(["a", "a", "a", "a", "b", "c", "é", None, "z"])) for k in range(400)] + [(900, None, "a"), (901, "", "empty")]
    docs = table(spark, [(i, t, "en", s) for i, t, s in rows])
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    taken, target = brute_mix(rows)
    assert {i: r.taken for i, r in got.items()} == {i: taken[i] for i, *_ in rows}
    assert all(abs(got[i].target - target[s]) < 1e-6 for i, _, s in rows)
    for s in target:
        assert abs(sum(got[i].taken for i, _, x in rows if x == s) - target[s]) <= 60
    again = mixing.taken_rows(docs)
    assert again.columns == docs.columns
    assert Counter(r.doc_id for r in again.collect()) == {i: r.taken // r.size for i, r in got.items() if r.taken}
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(empty).count() == 0 and mixing.taken_rows(empty).count() == 0
