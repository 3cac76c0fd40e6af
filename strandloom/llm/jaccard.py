"""Join of documents whose sets of five-word runs are similar: MinHash banding, then full sets.

Documents with equal sets are one class and are represented by the first of them. Representatives are
hashed in bands; band and row counts follow from the wanted recall at the threshold. Rows
shuffle on band hashes, where each is tied to the smallest of its bucket only, never to all others.
What is tied together, directly or not, is a cluster. Clusters travel to tasks with the full sets of their
members, large clusters in blocks of members, so that each pair of blocks is one task's work. A large
cluster that is a loose chain of small buckets travels bucket by bucket instead, where that makes fewer
copies; there a pair is verified in its first common bucket. So all pairs that share a band are verified
once, and counts and a spanning forest come out, not pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.blocks import (
    DOC_BITS, Segments, U, Words, _mixed, blocked, each_block, with_blocks,
)
from strandloom.llm.common import NO_ID, attach, shuffle_width, store

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Hash functions that may be spent; more rows per band mean fewer false candidates.
MOST_HASHES = 128
#: Members and n-grams of a block of a large cluster, and n-grams of small clusters handled together.
BLOCK_MEMBERS, BLOCK_GRAMS, TASK_GRAMS = 400, 300_000, 1_500_000
UNITS = "array<struct<unit:bigint,band:int,parts:int>>"


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which so many bands as ``recall`` needs fit into ``most`` hashes.

    A pair of similarity s shares one of b bands of r rows with probability 1 - (1 - s**r)**b.
    """
    best = None
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no band count reaches this recall with so few hashes")
    return best


def ngrams(words: Words, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word runs of each text; of all words where there are fewer."""
    runs = Segments(words.hashes, 1)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        starts = np.arange(a, max(b - n + 1, min(a + 1, b)))
        out.append(np.unique(runs(starts, np.minimum(starts + n, b))))
    return out


def _parameters(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.random.default_rng(7).integers(0, 1 << 63, (2, hashes, 1), dtype=np.uint64)
    return seeds[0] * U(2) + U(1), seeds[1]


def band_hashes(grams: np.ndarray, bands: int, rows: int, parameters) -> np.ndarray:
    """One hash per band of the MinHash signature of a set."""
    factor, shift = parameters
    least = np.full(bands * rows, np.iinfo(U).max, U)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048] * factor + shift).min(1), out=least)
    out = np.arange(bands, dtype=U)
    for row in _mixed(least).reshape(bands, rows).T:
        out = _mixed(out * U(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (node, other: bigint); root is the smallest node reached.

    Alternates two steps until nothing changes: each node ties its larger neighbours to the smallest
    neighbour, then its smaller ones. Edges become stars around roots in a few rounds.
    """
    now = store(edges.select(
        F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"),
    ).where("node <> other").distinct(), "edges")
    known = None
    while True:
        both = now.unionByName(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        least = store(both.groupBy("node").agg(
            F.least("node", F.min("other")).alias("least"), F.count("*").alias("n")), "least")
        large = attach(both.where("other > node"), least, "node", "n", "other").select(
            F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        large = large.unionByName(least.where("least < node").select("node", F.col("least").alias("other"))).distinct()
        large = store(large, "edges")
        small_least = large.groupBy("node").agg(F.min("other").alias("least"))
        small = large.join(small_least, "node").where("other <> least").select(
            F.col("other").alias("node"), F.col("least").alias("other"))
        now = store(small.unionByName(
            small_least.select("node", F.col("least").alias("other"))).distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())
        if state == known:
            break
        known = state
    return now.select("node", F.col("other").alias("root")).unionByName(
        now.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct())


def _shared(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``pairs`` of sets."""
    if len(pairs) < 2000:
        out = np.zeros(len(pairs), np.int64)
        for n, (i, j) in enumerate(pairs.tolist()):
            a, b = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[n] = np.count_nonzero(b[at] == a)
        return out
    # Many pairs: products of the members' rows over the n-grams that several of them have.
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return np.rint(total[pairs[:, 0], pairs[:, 1]]).astype(np.int64)


def _verified(threshold: float):
    """Function of the members of some clusters (band -1) and buckets: (node, links, lead)."""

    def run(table: pa.Table) -> pa.Table:
        unit, band, low, high, node, part, copies = (
            np.array(table[c]) for c in ("unit", "band", "low", "high", "node", "part", "copies"))
        order = np.lexsort((node, high, low, band, unit))
        key = np.column_stack([unit, band, low, high])[order]
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        grams, bands = table["grams"], table["bands"]
        out = []
        for rows in np.split(order, cuts):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(grams[i].as_py(), U) for i in rows.tolist()]
            marks = np.array([bands[i].as_py() for i in rows.tolist()])
            near = np.zeros((len(rows), len(rows)), bool)
            own = band[rows[0]]
            for column in marks.T if own < 0 else marks.T[:own]:
                near |= column[:, None] == column[None, :]
            if own >= 0:  # a bucket: all share this band, and those that share an earlier one meet there
                near = ~near
            if low[rows[0]] != high[rows[0]]:
                side = part[rows]
                near &= side[:, None] != side[None, :]
            pairs = np.argwhere(np.triu(near, 1))
            sizes = np.array([len(s) for s in sets])
            shared = _shared(sets, pairs)
            union = sizes[pairs].sum(1) - shared
            pairs = pairs[shared >= threshold * union - 1e-9]
            if not len(pairs):
                continue
            weight = copies[rows]
            links = np.zeros(len(rows), np.int64)
            np.add.at(links, pairs[:, 0], weight[pairs[:, 1]])
            np.add.at(links, pairs[:, 1], weight[pairs[:, 0]])
            lead = np.arange(len(rows))
            while True:
                least = np.minimum(lead[pairs[:, 0]], lead[pairs[:, 1]])
                fresh = lead.copy()
                np.minimum.at(fresh, pairs[:, 0], least)
                np.minimum.at(fresh, pairs[:, 1], least)
                fresh = fresh[fresh]
                if (fresh == lead).all():
                    break
                lead = fresh
            some = np.flatnonzero(links)
            out.append(np.column_stack([node[rows][some], links[some], node[rows][lead[some]]]))
        found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pa.table({"node": found[:, 0], "links": found[:, 1], "lead": found[:, 2]})

    return run


def _parts():
    """Blocks that the members of a cluster or bucket need."""
    return F.ceil(F.greatest(
        F.count("*") / BLOCK_MEMBERS, F.sum("size") / BLOCK_GRAMS)).cast("int").alias("parts")


def _with_units(members: DataFrame, weights: DataFrame) -> DataFrame:
    """``members`` with ``units``, where a member meets others: (unit, band, parts).

    That is its cluster (band -1), or each of its buckets if the cluster has several blocks and its
    buckets make fewer copies of members than all pairs of blocks would.
    """
    large = members.where("parts > 1").select("root", "node", "size", F.posexplode("bands").alias("band", "unit"))
    buckets = store(large.groupBy("unit", "band").agg(
        F.min("root").alias("root"), F.count("*").alias("n"), _parts()).where("n > 1"), "buckets")
    loose = store(
        buckets.groupBy("root").agg(F.sum(F.col("n") * F.col("parts")).alias("copies"), F.count("*").alias("buckets"))
        .join(weights, "root").where(F.col("copies") < F.col("n") * F.col("parts")).select("root", "buckets"), "loose")
    chosen = store(attach(buckets, loose, "root", "buckets", "unit").drop("root"), "chosen")
    own = attach(large.select("node", "unit"), chosen, "unit", "n", "node").groupBy("node").agg(
        F.collect_list(F.struct("unit", "band", "parts")).alias("units"))
    whole = F.array(F.struct(F.col("root").alias("unit"), F.lit(-1).alias("band"), "parts"))
    return members.join(own, "node", "left").withColumn("units", F.coalesce("units", whole))


def _joined(docs: DataFrame, doc_id: str, text: str, n: int, threshold: float, recall: float):
    """Blocks of ``docs``; (block, node, doc, key) of all rows; (key, copies, class_node, class_doc, links)."""
    bands, rows = bands_for(threshold, recall)
    parameters = _parameters(bands * rows)
    id_at, text_at = docs.columns.index(doc_id), docs.columns.index(text)
    blocks = blocked(docs, "near", text)

    def sign(block: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = ngrams(Words(batch.column(text_at).to_pylist()), n)
        nodes = (block << DOC_BITS) + np.arange(len(sets))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(sets), block)), pa.array(nodes),
            batch.column(id_at).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
            pa.array([band_hashes(s, bands, rows, parameters) for s in sets], pa.list_(pa.int64())),
        ], names=["block", "node", "doc", "size", "key", "bands"])

    signed = store(each_block(
        blocks, sign, "block long, node long, doc long, size int, key binary, bands array<bigint>"), "signatures")
    doc = F.coalesce("doc", F.lit(NO_ID))
    classes = store(
        signed.where(F.col("key").isNotNull()).groupBy("key").agg(
            F.min(F.struct(doc.alias("doc"), "node", "block", "size", "bands")).alias("first"),
            F.count("*").alias("copies"))
        .select("key", "first.*", "copies"), "classes")

    # Candidates: each member of a bucket is tied to the bucket's smallest.
    hashed = classes.select("node", F.explode("bands").alias("band"))
    buckets = store(hashed.groupBy("band").agg(
        F.min("node").alias("other"), F.count("*").alias("n")).where("n > 1"), "buckets")
    ties = attach(hashed, buckets, "band", "n", "node").select("node", "other")
    clusters = store(components(ties), "clusters")
    members = classes.select("block", "node", "size", "copies", "bands").join(clusters, "node")
    weights = store(members.groupBy("root").agg(F.count("*").alias("n"), _parts()), "weights")
    members = store(attach(members, weights, "root", "n", "node"), "members")
    members = store(_with_units(members, weights), "members")
    alone = F.size(F.filter("units", lambda u: u["parts"] == 1))
    total = members.agg(F.sum(F.col("size") * alone)).first()[0] or 0
    bins = max(shuffle_width(docs.sparkSession), -(-total // TASK_GRAMS))

    def sets_of(batch: pa.RecordBatch, info: pa.Table) -> pa.Table:
        where = [x & ((1 << DOC_BITS) - 1) for x in info["node"].to_pylist()]
        sets = ngrams(Words(batch.column(text_at).take(pa.array(where, pa.int64())).to_pylist()), n) if where else []
        return info.select(["node", "copies", "bands", "units"]).append_column(
            "grams", pa.array([s.tobytes() for s in sets], pa.binary()))

    full = with_blocks(
        blocks, members.select("block", "node", "copies", "bands", "units"), sets_of,
        f"node long, copies long, bands array<bigint>, units {UNITS}, grams binary")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    spread = full.select("node", "copies", "bands", "grams", F.inline("units")).withColumn("part", part).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(
        {"low": F.least("part", "with"), "high": F.greatest("part", "with")})
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("unit"), F.lit(bins))).otherwise(
        F.xxhash64("unit", "low", "high"))
    verified = store(
        spread.withColumn("task", task).select(
            "task", "unit", "band", "low", "high", "node", "part", "copies", "grams", "bands")
        .groupBy("task").applyInArrow(_verified(threshold), "node long, links long, lead long"), "links")
    found = components(verified.select("node", F.col("lead").alias("other")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    own = classes.select("key", "node", "doc", "copies").join(links, "node", "left").join(found, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    own = store(own, "classes")
    first = store(own.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("first"), F.count("*").alias("n")), "first")
    final = attach(own, first, "root", "n", "node").select(
        "key", "copies", F.col("first.node").alias("class_node"), F.nullif("first.doc", F.lit(NO_ID)).alias("class_doc"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return blocks, signed.select("block", "node", "doc", "key"), store(final, "near-classes")


def linked(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM,
    threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of n-word runs is at least ``threshold``;
    n_links counts the other documents a document is linked to, copies included. Documents that links
    connect share the class_id: the smallest doc_id among them. A text of fewer than n words has
    one run, all of it. A text without words, null included, has no links and its own id as class. Rows
    with equal ids are documents of their own. A null id comes after all others; the class_id is null if
    all ids of the class are. An empty table gives no rows. Other columns play no part.
    """
    _, rows, classes = _joined(docs.select(doc_id, text), doc_id, text, n, threshold, recall)
    return attach(rows, classes, "key", "copies", "node", "left").select(
        F.col("doc").alias("doc_id"),
        F.when(F.col("class_node").isNull(), F.col("doc")).otherwise(F.col("class_doc")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM,
    threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """The rows of ``docs`` without those that are not the first (by id) of their class; see ``linked``.

    Of several rows with the smallest id of a class one stays. Rows without words all stay.
    """
    blocks, rows, classes = _joined(docs, doc_id, text, n, threshold, recall)
    gone = attach(rows, classes, "key", "copies", "node").where("node <> class_node").select("block", "node")
    names = docs.columns

    def keep(batch: pa.RecordBatch, info: pa.Table) -> pa.Table:
        stays = np.ones(batch.num_rows, bool)
        stays[np.array(info["node"], np.int64) & ((1 << DOC_BITS) - 1)] = False
        return pa.table(batch.filter(pa.array(stays)).columns, names=names)

    return with_blocks(blocks, gone, keep, docs.schema)
