"""Operator 6: SimHash near-deduplication with a Gray-order hierarchical index.

A text's fingerprint has a bit set if over half of the XXH64 hashes of its word
shingles have it.  Texts link when their fingerprints differ in 3 bits or fewer; linked
texts form components.

Search is over distinct fingerprints, so copies cost nothing.  The index's first level
is a shared masked pattern of 16 bits: two fingerprints that differ in 3 bits agree in
one of four blocks of 16, so each goes to four groups, one for each of its blocks.  A
group that is still too large is divided the same way by the bits that are left, again
without loss.  Within a group, fingerprints are sorted by Gray rank; runs of neighbours
become nodes, runs of nodes become nodes above.  A node factors out the bits on which
all below it agree and its parent has not factored out yet.  Queries go down the levels,
accumulate differences on the factored patterns, and drop a node with all below it once
these exceed the limit.  Each task hands on one edge for each linked fingerprint (a
spanning star), never all pairs; the components follow from those (components.py).

Cases: a null or empty text has fingerprint 0, which links like any other; fewer words
than a shingle has make one shingle; rows with equal doc_id are rows of their own;
component_id is the smallest non-null doc_id, null if there is none; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .gray_index import DISTANCE, Index, majority
from .near_copies import one_of_each  # noqa: F401
from .shared import arrow_rows, lean, skew_safe_join, written

SHINGLE = 3
#: A larger group is divided by further bits, as work within a group is near its square.
GROUP_ROWS = 20_000
#: Rows of a task, about.
TASK_ROWS = 400_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits, as a long) of every row; no shuffle."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lean(run), "doc_id long, fp long")


def stars(group: np.ndarray, fp: np.ndarray, limit: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly what the links within the groups connect: one for each linked entry but one."""
    sizes = np.unique(group, return_inverse=True, return_counts=True)
    many = sizes[2][sizes[1]] > 1
    if not many.any():
        return fp[:0], fp[:0]
    index = Index(group[many], fp[many])
    label = np.arange(len(index.fp))
    for i, j in index.pairs(limit):
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    moved = np.flatnonzero(label != np.arange(len(label)))
    return index.fp[moved], index.fp[label[moved]]


def divided(rows: DataFrame, width: int) -> DataFrame:
    """Each row once for each of four blocks of its `width` bits that are left: the block joins the key, the rest is left."""
    w = width // 4
    parts = []
    for k in range(4):
        low = F.col("rest").bitwiseAND(F.lit((1 << (w * k)) - 1))
        block = F.shiftrightunsigned("rest", w * k).bitwiseAND(F.lit((1 << w) - 1))
        high = F.lit(0).cast("long") if w * (k + 1) >= 64 else F.shiftrightunsigned("rest", w * (k + 1))
        parts.append(F.struct(F.xxhash64("key", F.lit(k), block).alias("key"), F.shiftleft(high, w * k).bitwiseOR(low).alias("rest")))
    return rows.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.key", "p.rest")


def links(nodes: DataFrame, total: int, limit: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """u, v: edges between distinct fingerprints (column fp) that connect all within `limit` bits, at most 3."""
    done, width = [], 64
    rows = nodes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    for level in range(3):
        rows = divided(rows, width)
        width -= width // 4
        if total <= group_rows or level == 2:
            done.append(rows)
            break
        large = rows.groupBy("key").count().where(F.col("count") > group_rows).select("key")  # at most 4 ** level * total / group_rows keys
        large = written(large, "simhash-large")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = rows.join(large, "key", "left_semi")
    for k in range(1, len(done)):
        done[0] = done[0].unionByName(done[k])
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * total // TASK_ROWS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            u, v = stars(np.concatenate([k for k, _ in got]), np.concatenate([f for _, f in got]).view(np.uint64), limit)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return done[0].select("key", "fp").repartition(tasks, "key").mapInArrow(lean(run), "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, limit: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = written(fingerprints(docs, shingle), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    total, distinct = rows.count(), nodes.count()
    labels = components(links(nodes, distinct, limit, group_rows))
    linked = written(nodes.join(labels, nodes["fp"] == labels["node"]).select("fp", "first", "n", "label"), "simhash-linked")
    firsts = linked.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    found = skew_safe_join(linked.select("fp", "n", "label"), firsts, "label", "m", distinct).select("fp", "n", "component_id")
    alone = nodes.join(linked, "fp", "left_anti").select("fp", "n", F.col("first").alias("component_id"))
    return skew_safe_join(rows, written(found.unionByName(alone), "simhash-found"), "fp", "n", total).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
