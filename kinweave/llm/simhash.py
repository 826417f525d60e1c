"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through vantage-point trees."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, connected_components, free_names, materialize, slices, text_docs, to_batch
from .kernels import union_labels


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    """Bit b is 1 if set in over half the XXH64 of the k-word shingles (repeats included).

    ASCII capitals are lowered and words are runs without ASCII white space. Fewer
    than k words: the one shingle of all of them; no word: 0.
    """
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate([len(x) + 1 for x in w]))
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's 64 bits as a signed long; null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, k, seed) for t in column_bytes(b, "text")], dtype=np.uint64).view(np.int64)
            yield to_batch({"doc_id": b.column(0), "fp": fps}, schema)

    return text_docs(docs).mapInArrow(run, "doc_id long, fp long")


WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)


def block_masks(reach: int, blocks: int) -> list[np.uint64]:
    """Masks of which every pair at most ``reach`` bits apart agrees wholly on one at least.

    The 64 bits are cut into ``blocks`` runs; a mask keeps all but ``reach`` of them.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    runs = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [np.uint64(sum(c)) for c in combinations(runs, blocks - reach)]


def _distance(pts: np.ndarray, v, mask) -> np.ndarray:
    return np.bitwise_count((pts ^ v) & mask).astype(np.int64)


class VantageTree:
    """Splits fingerprints by their Hamming distance, over a mask's bits, to vantage points.

    It serves the pairs that agree on the mask: over its bits they are at distance 0,
    so by the triangle inequality both lie on the same side of every vantage point and
    nothing is copied. Points that all agree on the mask and are still over ``most``
    are split by distance over all bits: there a fingerprint within ``reach`` of x
    lies inside only if x is at most radius + reach away, and outside only if x is
    over radius - reach away. Leaves are numbered shards; ``route`` sends each
    fingerprint to its own leaf and to all others that its ball reaches.
    """

    def __init__(self, sample: np.ndarray, most: float, mask, reach: int, seed: int = 1):
        self.nodes: list = []
        self.leaves, self.most, self.mask, self.reach = 0, most, mask, reach
        self._build(np.unique(sample), np.random.default_rng(seed))

    def _build(self, pts, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        split = _split(pts, self.mask, self.reach, rng, 1.25 if len(pts) >= 256 else 0) if len(pts) > self.most else None
        if split is None:
            self.nodes[at] = self.leaves
            self.leaves += 1
        else:
            v, mask, r, slack, d = split
            self.nodes[at] = (v, mask, r, slack, self._build(pts[d <= r + slack], rng), self._build(pts[d > r - slack], rng))
        return at

    def route(self, pts: np.ndarray):
        """(leaf, index into pts, at home) of all visits."""
        out = []
        stack = [(0, np.arange(len(pts)), np.ones(len(pts), dtype=bool))]
        while stack:
            at, who, home = stack.pop()
            node = self.nodes[at]
            if not len(who):
                continue
            if isinstance(node, int):
                out.append((np.full(len(who), node), who, home))
                continue
            v, mask, r, slack, inside, outside = node
            d = _distance(pts[who], v, mask)
            near, far = d <= r + slack, d > r - slack
            stack.append((inside, who[near], home[near] & (d[near] <= r)))
            stack.append((outside, who[far], home[far] & (d[far] > r)))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]


def _vantage(pts: np.ndarray, mask, rng):
    """A vantage point and radius that split ``pts`` most evenly of a few tried, or None."""
    best = None
    for v in rng.choice(pts, size=min(4, len(pts)), replace=False):
        d = _distance(pts, v, mask)
        r = int(np.median(d))
        if r == d.max():
            r -= 1
        inside = int((d <= r).sum())
        if 0 < inside < len(pts) and (best is None or abs(2 * inside - len(pts)) < best[0]):
            best = (abs(2 * inside - len(pts)), v, r, d)
    return best and best[1:]


def _split(pts: np.ndarray, mask, reach: int, rng, copies: float):
    """(vantage point, mask, radius, slack, distances): over the mask if that parts ``pts``, else over all bits.

    A cut over all bits counts if both sides, with what reaches over it, hold at most
    ``copies`` times the points and neither nearly all of them; None if there is none.
    """
    if (cut := _vantage(pts, mask, rng)) is not None:
        v, r, d = cut
        return v, mask, r, 0, d
    if (cut := _vantage(pts, WHOLE, rng)) is not None:
        v, r, d = cut
        near, far = int((d <= r + reach).sum()), int((d > r - reach).sum())
        if max(near, far) <= 0.9 * len(pts) and near + far <= copies * len(pts):
            return v, WHOLE, r, reach, d
    return None


def close_stars(pts: np.ndarray, home: np.ndarray, reach: int, mask=WHOLE, bucket: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges (index, smallest index linked) that join all fingerprints of one shard within ``reach`` that agree on ``mask``.

    A tree over the home points is searched by all points in blocks; pairs are
    folded into labels block by block, so memory is bounded and at most one edge for
    each point comes out, whatever the group's size. Where no cut helps, the points
    are one tight group: a block whose members are linked already is compared with
    points of other labels only. With the mask of all bits only equal points agree,
    so it then cuts by whole distances alone.
    """
    rng = np.random.default_rng(2)
    labels = np.arange(len(pts))
    narrow = mask if mask != WHOLE else np.uint64(0)
    stack = [(np.flatnonzero(home), np.arange(len(pts)))]
    while stack:
        mem, ask = stack.pop()
        if not len(mem) or not len(ask):
            continue
        split = _split(pts[mem], narrow, reach, rng, 1.8) if len(mem) > bucket else None
        if split is not None:
            v, over, r, slack, d = split
            q = _distance(pts[ask], v, over)
            stack.append((mem[d <= r], ask[q <= r + slack]))
            stack.append((mem[d > r], ask[q > r - slack]))
            continue
        if len(mem) > bucket:  # a tight group: whatever lies near one of its points is linked through it
            for v in rng.choice(mem, size=4, replace=False):
                labels = _fold(pts, labels, np.array([v]), ask, reach)
            mem = mem[np.argsort(labels[mem], kind="stable")]
        for m in range(0, len(mem), 512):
            block = mem[m : m + 512]
            for i in range(0, len(ask), 1024):
                some, of = ask[i : i + 1024], labels[block]
                if (of == of[0]).all():
                    some = some[labels[some] != of[0]]
                labels = _fold(pts, labels, block, some, reach)
    at = np.flatnonzero(labels != np.arange(len(pts)))
    return at, labels[at]


def _fold(pts: np.ndarray, labels: np.ndarray, mem: np.ndarray, ask: np.ndarray, reach: int) -> np.ndarray:
    """``labels`` after joining all of ``ask`` with all of ``mem`` within ``reach``."""
    a, b = np.nonzero(np.bitwise_count(pts[ask, None] ^ pts[None, mem]) <= reach)
    a, b = ask[a], mem[b]
    off = labels[a] != labels[b]
    return union_labels(len(pts), a[off], b[off], labels) if off.any() else labels


def link_fingerprints(fps: DataFrame, reach: int = 4, shard: int = 16_384, sample: int = 65_536, blocks: int | None = None) -> DataFrame:
    """(fp, root): components of distinct fingerprints at most ``reach`` bits apart.

    ``fps`` holds distinct longs in ``fp``. The bits are cut into ``blocks`` runs
    (reach + 1 if not given); for every choice of runs that a pair can agree on there
    is one vantage tree, cut into shards of about ``shard``. With 5 runs a fingerprint
    goes to 5 trees and, but for tight groups, to one shard of each, however large the
    table is; shards stay small to some 10^8 fingerprints, beyond which 6 runs (15
    trees) cut finer. The trees are shaped by at most ``sample`` fingerprints (by
    hash); that shapes the shards only: every pair is found wherever the cuts lie.
    """
    n = fps.count()
    keep = max(1, n // sample)
    rows = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(keep)) == 0).limit(2 * sample).toPandas()["fp"].to_numpy(dtype=np.int64)
    most = shard * len(rows) / max(1, n)
    masks = block_masks(reach, blocks or reach + 1)
    trees = [VantageTree(rows.view(np.uint64), most, m, reach) for m in masks]
    schema = pa.schema([("tree", pa.int32()), ("shard", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def send(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for t, tree in enumerate(trees):
                leaf, who, home = tree.route(fp.view(np.uint64))
                yield to_batch({"tree": np.full(len(leaf), t, np.int32), "shard": leaf, "fp": fp[who], "home": home}, schema)

    def search(table):
        fp = table.column("fp").to_numpy()
        order = np.argsort(fp)
        fp, home = fp[order], table.column("home").to_numpy(zero_copy_only=False)[order]
        a, b = close_stars(fp.view(np.uint64), home, reach, masks[table.column("tree")[0].as_py()])
        return pa.table({"a": fp[a], "b": fp[b]})

    sent = fps.select("fp").mapInArrow(send, "tree int, shard long, fp long, home boolean")
    edges = sent.groupBy("tree", "shard").applyInArrow(search, "a long, b long")
    return connected_components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, k: int = 4, reach: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Documents with equal fingerprints are one node, so a group of copies of any size
    costs one. component_id is the smallest doc_id reachable over links, itself
    included (null ids are passed over; null if the component has no other). Texts
    without a word have fingerprint zero and are linked like any other.
    """
    marked = materialize(fingerprints(docs, k), "simhash")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = link_fingerprints(nodes.select("fp"), reach)
    comp = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    named = comp.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = 4, reach: int = 4) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of its least doc_id.

    Rows without doc_id come after all others of their component; of rows that repeat
    in doc_id and fingerprint one stays.
    """
    columns = docs.columns
    own, best_fp, best_id = free_names(columns, "own_fp", "best_fp", "best_id")
    schema = docs.select(*columns, F.lit(0).cast("long").alias(own)).schema

    def run(batches):
        for batch in batches:
            for b in slices([batch]):
                fps = np.array([fingerprint(t, k) for t in column_bytes(b, "text")], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*columns, own])

    marked = materialize(fingerprints(docs, k), "simhash")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("low")
    nodes = materialize(marked.groupBy("fp").agg(low), "simhash-nodes")
    roots = link_fingerprints(nodes.select("fp"), reach)
    comp = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = comp.groupBy("root").agg(F.min(F.struct("low.none", "low.doc_id", "fp")).alias("w"))
    best = best.select(F.col("w.fp").alias(best_fp), F.col("w.doc_id").alias(best_id))
    rows = docs.mapInArrow(run, schema)
    kept = rows.join(best, (F.col(own) == F.col(best_fp)) & F.col("doc_id").cast("long").eqNullSafe(F.col(best_id)), "left_semi")
    return kept.dropDuplicates([own, "doc_id"]).select(*columns)
