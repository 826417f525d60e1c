"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine c lie at squared distance 2 - 2c. After a fixed rotation the
coordinates are split into blocks, each with a share of that squared distance in
proportion to its coordinates: a pair within the whole budget is within its share in
some block at least. Distinct vectors are packed into sides of some thousands, once, and
every two sides meet as a tile that is read from the packed table, so no vector goes
through a shuffle for the join. Within a tile each block is range-joined and each
candidate is checked exactly in double precision. The join is whole: no pair at or
over the threshold is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, to_batch
from .kernels import union_labels

#: Coordinates of a block; vectors of a side, at least and at most.
BLOCK, LEAST, PART = 32, 1024, 16_384
#: Half the angle of a hot ball (degrees), and what share of the sample makes it hot.
BALL, HOT = 10.0, 0.01
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    """A fixed orthogonal matrix for each dimension."""
    if d not in _ROTATIONS:
        _ROTATIONS[d] = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    return _ROTATIONS[d]


def blocks(d: int, budget: float) -> list[tuple[int, int, float]]:
    """(first, end, squared-distance share) of each block of coordinates."""
    return [(a, min(a + BLOCK, d), budget * (min(a + BLOCK, d) - a) / d) for a in range(0, d, BLOCK)]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def hot_leaders(sample: np.ndarray) -> np.ndarray:
    """Unit vectors around which over one in a hundred of the sample lies within the ball's angle."""
    if not len(sample):
        return sample
    near = sample @ sample.T >= np.cos(np.radians(BALL))
    least, out = max(20, HOT * len(sample)), []
    while len(out) < 64:
        i = int(near.sum(axis=1).argmax())
        members = near[i].copy()
        if members.sum() < least:
            break
        out.append(sample[i])
        near[members] = False
        near[:, members] = False
    return np.array(out).reshape(-1, sample.shape[1])


class Side:
    """The vectors of one side of a tile with what the search needs of them."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray, ball: np.ndarray, budget: float):
        self.raw, self.copies, self.ball = raw, copies, ball
        self.norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        u = raw / self.norm[:, None]
        self.rot, self.short = u @ rotation(u.shape[1]), u.astype(np.float32)
        self.left, self.right = [], []  # their products are the squared distances within a block
        one = np.ones((len(u), 1), dtype=np.float32)
        for a, b, _ in blocks(u.shape[1], budget):
            f = self.rot[:, a:b].astype(np.float32)
            sq = np.einsum("ij,ij->i", f, f)[:, None]
            self.left.append(np.hstack([-2 * f, sq, one]))
            self.right.append(np.ascontiguousarray(np.hstack([f, one, sq]).T))


def near_places(left: np.ndarray, right: np.ndarray, most: float, above: bool):
    """(row, column) of the products up to ``most``, some at a time; with ``above`` only columns after the row's number."""
    for i in range(0, len(left), 256):
        for j in range(i // 2048 * 2048 if above else 0, right.shape[1], 2048):
            near = left[i : i + 256] @ right[:, j : j + 2048] <= most
            flat = near.ravel()
            if flat.size % 8 == 0:  # eight at a time, as hardly any is near
                at = np.flatnonzero(flat.view(np.uint64))
                at = (at[:, None] * 8 + np.arange(8)).ravel()
                at = at[flat[at]]
            else:
                at = np.flatnonzero(flat)
            if len(at):
                q, x = at // near.shape[1] + i, at % near.shape[1] + j
                if above:
                    q, x = q[q < x], x[q < x]
                yield q, x


def tile_links(one: Side, two: Side, budget: float, least: float):
    """Copies linked to each vector of both sides (of one, if they are the same), and labels that join linked ones."""
    same = one is two
    n, m = len(one.raw), 0 if same else len(two.raw)
    parts = blocks(one.raw.shape[1], budget)
    links, labels = np.zeros(n + m, dtype=np.int64), np.arange(n + m)
    for block, (_, _, share) in enumerate(parts):
        for q, x in near_places(one.left[block], two.right[block], share * 1.001 + 1e-5, same):
            ok = (one.ball[q] != two.ball[x]) | (one.ball[q] < 0)
            q, x = q[ok], x[ok]
            for k in range(0, len(q), 1 << 16):
                p, y = q[k : k + (1 << 16)], x[k : k + (1 << 16)]
                ok = np.einsum("ij,ij->i", one.short[p], two.short[y]) >= least - 1e-3
                p, y = p[ok], y[ok]
                diff = (one.rot[p] - two.rot[y]) ** 2
                inside = np.stack([diff[:, s:e].sum(axis=1) <= t * (1 + 1e-9) for s, e, t in parts])
                ok = inside[block] & (inside[:block].any(axis=0) == 0)  # counted in the first block that finds it
                p, y = p[ok], y[ok]
                ok = np.einsum("ij,ij->i", one.raw[p], two.raw[y]) / (one.norm[p] * two.norm[y]) >= least
                p, y = p[ok], y[ok]
                at = y if same else y + n
                np.add.at(links, p, two.copies[y])
                np.add.at(links, at, one.copies[p])
                off = labels[p] != labels[at]
                if off.any():
                    labels = union_labels(n + m, p[off], at[off], labels)
    return links, labels


def near_duplicates(vectors: DataFrame, least: float = 0.9, sample: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, link with nothing: their component is their own id. Equal vectors
    are one node with a count; vectors of another length never link. Around leaders
    found in a bounded ``sample``, vectors within 10 degrees are known to link with one
    another (20 degrees are within the threshold's angle), so a large group of near
    copies is counted, not paired; with a threshold over cos 20 the balls are off.
    """
    budget = 2 - 2 * least + 1e-9
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150))) & F.exists("v", lambda x: F.abs(x) > 1e-150)
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite, F.lit(False))
    rows = rows.select("vec_id", F.when(good, F.xxhash64("v")).alias("nid"), F.when(good, F.col("v")).alias("v"))
    nodes = rows.filter("nid is not null").groupBy("nid").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    nodes = nodes.withColumn("d", F.size("v"))
    short = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # floats are doubles once read, and half as wide
    width = np.float32 if short else np.float64
    many = vectors.count()
    side = int(np.clip(many // 24, LEAST, PART))
    packing = pa.schema([("d", pa.int32()), ("n", pa.int32()), ("head", pa.int64()), ("nid", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("v", pa.binary())])

    def arrays(b):
        """The batch's vectors by dimension: (rows, matrix)."""
        d = b.column(b.schema.get_field_index("d")).to_numpy()
        v = b.column(b.schema.get_field_index("v"))
        flat, offs = v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
        for k in np.unique(d):
            at = np.flatnonzero(d == k)
            yield int(k), at, flat[offs[at][:, None] + np.arange(k)]

    def pack(batches):
        held: dict[int, list] = {}

        def flush(d):
            nid, copies, low, v = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            for o in range(0, len(nid), side):
                at = slice(o, o + side) if len(nid) - o > 1.25 * side else slice(o, None)  # no tiny side for what is left
                yield to_batch({"d": [d], "n": [len(nid[at])], "head": [nid[o]], "nid": [nid[at]], "copies": [copies[at]], "low": [low[at]], "v": [v[at].tobytes()]}, packing)
                if at.stop is None:
                    break

        for b in batches:
            nid, copies, low = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for d, at, v in arrays(b):
                held.setdefault(d, []).append((nid[at], copies[at], low[at], v.astype(width)))
                if sum(len(x[0]) for x in held[d]) >= 4 * side:
                    yield from flush(d)
        for d in list(held):
            yield from flush(d)

    # Few partitions, so that sides are full; small row groups, so that a task reads some sides only.
    made = nodes.select("nid", "copies", "low", "d", "v").coalesce(max(8, -(-many // side)))
    packed = materialize(made.mapInArrow(pack, "d int, n int, head long, nid array<long>, copies array<long>, low array<long>, v binary"), "embed-sides", {"parquet.block.row.count.limit": "1"})
    total = packed.agg(F.sum("n")).first()[0] or 0

    def matrix(d, v):
        return np.frombuffer(v, dtype=width).astype(np.float64).reshape(-1, d)

    leaders: dict[int, np.ndarray] = {}
    if least <= np.cos(np.radians(2 * BALL)):
        step = max(1, total // sample)

        def some(batches):
            for b in batches:
                for d, nid, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    v = matrix(d, v)[np.array(nid) % step == 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), d, dtype=np.int32)), pa.array(list(v), pa.list_(pa.float64()))], names=["d", "v"])

        got = packed.select("d", "nid", "v").mapInArrow(some, "d int, v array<double>").limit(2 * sample).toPandas()
        leaders = {int(d): hot_leaders(unit(np.stack(g["v"]))) for d, g in got.groupby("d")}

    def balls(u, d):
        out = np.full(len(u), -1)
        if len(lead := leaders.get(d, ())):
            c = u @ lead.T
            best = c.argmax(axis=1)
            near = c[np.arange(len(u)), best] >= np.cos(np.radians(BALL)) + 1e-9
            out[near] = best[near]
        return out

    marked = pa.schema([("nid", pa.int64()), ("copies", pa.int64()), ("low", pa.int64()), ("d", pa.int32()), ("ball", pa.int32())])

    def mark(batches):
        for b in batches:
            for d, nid, copies, low, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
                yield to_batch({"nid": nid, "copies": copies, "low": low, "d": np.full(len(nid), d), "ball": balls(unit(matrix(d, v)), d)}, marked)

    nodes = materialize(packed.select("d", "nid", "copies", "low", "v").mapInArrow(mark, "nid long, copies long, low long, d int, ball int"), "embed-nodes")
    parts = ("d", "head", "nid", "copies", "v")
    one, two = (packed.select(*[F.col(c).alias(c + x) for c in parts]) for x in "12")
    # Every two sides of a dimension meet once; a product of the tables reads them where they lie.
    tiles = one.hint("shuffle_replicate_nl").join(two, (F.col("d1") == F.col("d2")) & (F.col("head1") <= F.col("head2"))).select("d1", "head1", "nid1", "copies1", "v1", "head2", "nid2", "copies2", "v2")
    linked = pa.schema([("nid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def search(batches):
        last = (None, None, None)
        for batch in batches:
            for r in range(batch.num_rows):
                b = {f: batch.column(k)[r] for k, f in enumerate(batch.schema.names)}
                d = b["d1"].as_py()

                def load(x, b=b, d=d):
                    raw, copies = matrix(d, b["v" + x].as_buffer()), b["copies" + x].values.to_numpy()
                    return b["nid" + x].values.to_numpy(), Side(raw, copies, balls(unit(raw), d), budget)

                if last[0] != (d, b["head1"].as_py()):
                    last = ((d, b["head1"].as_py()), *load("1"))
                _, nid, first = last
                if b["head1"].as_py() == b["head2"].as_py():
                    links, labels = tile_links(first, first, budget, least)
                else:
                    more, second = load("2")
                    links, labels = tile_links(first, second, budget, least)
                    nid = np.concatenate((nid, more))
                at = np.flatnonzero((links > 0) | (labels != np.arange(len(labels))))
                yield to_batch({"nid": nid[at], "links": links[at], "root": nid[labels[at]]}, linked)

    found = materialize(tiles.mapInArrow(search, "nid long, links long, root long"), "embed-links")
    held = nodes.filter("ball >= 0")
    of_ball = held.groupBy("d", "ball").agg(F.sum("copies").alias("size"), F.min("nid").alias("head"))  # 64 of a dimension at most
    in_ball = held.join(F.broadcast(of_ball), ["d", "ball"])
    edges = found.filter("nid <> root").select(F.col("nid").alias("a"), F.col("root").alias("b")).unionByName(in_ball.filter("nid <> head").select(F.col("nid").alias("a"), F.col("head").alias("b")))
    comp = nodes.select("nid", "low").join(connected_components(edges).withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least_id = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    more = found.groupBy("nid").agg(F.sum("links").alias("more"))
    info = (
        nodes.select("nid", "copies").join(more, "nid", "left").join(in_ball.select("nid", F.col("size")), "nid", "left")
        .select("nid", (F.col("copies") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce(F.col("size") - F.col("copies"), F.lit(0))).alias("n_links"))
        .join(comp.join(least_id, "root").select("nid", "component_id"), "nid")
    )
    out = rows.select("vec_id", "nid").join(info, "nid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
