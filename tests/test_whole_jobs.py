"""Cases that queries used to cut short."""

from __future__ import annotations

from tessera.plans import QUERIES


def brute_windows(text, budget=120, overlap=15):
    """Sizes of windows, by going through numbered tokens; every token must reach a window."""
    n, units = 0, []
    for line in text.split("\n"):
        words = list(range(n, n := n + len(line.split())))
        while len(words) > budget:
            units.append(words[:budget])
            words = words[budget - overlap :]
        if words:
            units.append(words)
    windows, current = [], []
    for unit in units:
        if current and sum(map(len, current)) + len(unit) > budget:
            windows.append(sum(current, []))
            keep = max(j for j in range(len(current) + 1) if sum(map(len, current[len(current) - j :])) <= overlap)
            carried = current[len(current) - keep :] if keep else [current[-1][-overlap:]]
            current = carried if sum(map(len, carried)) + len(unit) <= budget else []
        current = [*current, unit]
    windows += [sum(current, [])] if current else []
    assert {w for x in windows for w in x} == set(range(n))
    return [len(w) for w in windows]


def test_pack_windows_keeps_long_lines(spark, tmp_path):
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    texts = ["\n".join(map(words, sizes)) for sizes in ([61], [300], [10, 119, 500, 3], [60, 60, 61], [70, 80, 5, 4, 120, 121])]
    rows = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["pack_windows"](spark, str(tmp_path)).collect()}
    for k, text in rows:
        sizes = brute_windows(text)
        assert (got[k].n_windows, got[k].sizes) == (len(sizes), ",".join(map(str, sizes)))
