"""Operators 2, 5, 8 and 10 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kinweave.llm import common, compact, embed_dedup, simhash, suffix
from kinweave.llm.kernels import mix, union_labels

from ..conftest import SF
from .helpers import awkward, by_id, empty, prose


def plain_fingerprint(text, k=4):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = prose(5, 400).split()
    near = [(200 + i, " ".join([*base[: i * 3], "edit", *base[i * 3 :]]), "en", "n") for i in range(12)]
    d = awkward(spark, near)
    for f in (d, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in f.collect() if len(r["text"] or "") < 60_000 or True]
        fp = np.array([x for _, x in rows], dtype=np.uint64)
        lab = union_labels(len(fp), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4))
        low = defaultdict(lambda: None)
        for (i, _), c in zip(rows, lab):
            if i is not None:
                low[c] = i if low[c] is None else min(low[c], i)
        want = Counter((i, f"{x:016x}", low[c]) for (i, x), c in zip(rows, lab))
        assert Counter(map(tuple, simhash.near_duplicates(f).select("doc_id", "fingerprint", "component_id").collect())) == want
    one = simhash.keep_one(d)
    assert one.columns == d.columns
    ids = Counter(r["doc_id"] for r in one.collect())
    assert max(ids.values()) == 1 and ids[1] == 1 and ids[2] == 0 and ids[9] == 1 and ids[6] == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def fingerprint_mix(rng, lone, cluster):
    """Distinct fingerprints: unlike ones, chains of close ones, and a tight group around one."""
    base = rng.integers(0, 2**64, lone, dtype=np.uint64)
    flips = lambda n, k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, k), dtype=np.uint64), axis=1)
    near = base[: lone // 4] ^ flips(lone // 4, 4)
    return np.unique(np.concatenate([base, near, near ^ flips(len(near), 5), base[0] ^ flips(cluster, 6)]))


@pytest.mark.parametrize("blocks", [5, 6])
@pytest.mark.parametrize("most", [4, 300, 10**9])
def test_trees_find_all_pairs(blocks, most):
    pts = fingerprint_mix(np.random.default_rng(3), 1200, 900)
    a, b = [], []
    for mask in simhash.block_masks(4, blocks):
        tree = simhash.VantageTree(pts[::2], most, mask, 4)
        leaf, who, home = tree.route(pts)
        assert home.sum() == len(pts)
        for s in range(tree.leaves):
            i, h = who[leaf == s], home[leaf == s]
            x, y = simhash.close_stars(pts[i], h, 4, mask, bucket=16)
            a.append(i[x])
            b.append(i[y])
    got = union_labels(len(pts), np.concatenate(a), np.concatenate(b))
    want = union_labels(len(pts), *np.nonzero(np.bitwise_count(pts[:, None] ^ pts[None]) <= 4))
    assert (got == want).all()


def test_tight_group_is_joined_whole():
    pts = fingerprint_mix(np.random.default_rng(4), 4, 4000)
    a, b = simhash.close_stars(pts, np.ones(len(pts), bool), 4)
    want = union_labels(len(pts), *np.nonzero(np.bitwise_count(pts[:, None] ^ pts[None]) <= 4))
    assert (union_labels(len(pts), a, b) == want).all() and np.bincount(want).max() > 1000


def test_shards_stay_small_and_copies_few():
    rng = np.random.default_rng(5)
    pts = rng.integers(0, 2**64, 1_000_000, dtype=np.uint64)
    for mask in simhash.block_masks(4, 5):
        tree = simhash.VantageTree(pts[:65_536], 16_384 * 65_536 / len(pts), mask, 4)
        leaf, who, home = tree.route(pts)
        assert len(who) == len(pts) and home.all()  # one copy a tree
        assert np.bincount(leaf).max() < 2 * 16_384


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    lab = union_labels(6000, *np.array(edges).T)
    assert got == {i: lab[i] for e in edges if e[0] != e[1] for i in e}


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, 64))
    x = [b + rng.standard_normal(64) * s for b in base for s in np.linspace(0, 0.5, 12)]
    hot = rng.standard_normal(64)
    return x + [hot + rng.standard_normal(64) * 0.05 for _ in range(120)] + [hot] * 20 + [hot * 3] + [hot + rng.standard_normal(64) * 0.35 for _ in range(40)]


@pytest.mark.parametrize(("axes", "part"), [(None, 32_768), (2, 100)])
def test_embeddings(spark, monkeypatch, axes, part):
    monkeypatch.setattr(embed_dedup, "PART", part)
    if axes:
        monkeypatch.setattr(embed_dedup.np, "clip", lambda *a: axes)
    x = [[float(v) for v in r] for r in np.array(vectors(), dtype=np.float32)]
    x += [None, [0.0] * 64, [float("nan")] * 64, [1.0] * 3, [2.0] * 3, [None] + [1.0] * 63, []]
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(x)) + 5]
    d = spark.createDataFrame(list(zip(ids, x, ["l"] * len(x))), "vec_id long, embedding array<float>, ball string")
    link = np.zeros((len(x), len(x)), dtype=bool)
    good = [i for i, v in enumerate(x) if v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([x[i] for i in good], dtype=np.float64)
    n = np.linalg.norm(m, axis=1)
    link[np.ix_(good, good)] = (m @ m.T) / n[:, None] / n[None] >= 0.9
    k = len(x) - 4
    link[k, k + 1] = link[k + 1, k] = True
    np.fill_diagonal(link, False)
    lab = union_labels(len(x), *np.nonzero(link))
    low = {c: min(i for i, l in zip(ids, lab) if l == c) for c in set(lab)}
    want = {i: (int(s), low[c], i == low[c]) for i, s, c in zip(ids, link.sum(axis=1), lab)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(d).collect()} == want


def test_embeddings_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    r = embed_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], schema)).collect()
    assert sorted((str(x["vec_id"]), x["n_links"], x["kept"]) for x in r) == [("2", 1, True), ("2", 1, True), ("None", 0, False)]


def test_embeddings_are_not_sent_many_times(spark):
    """The join reads its vectors where they lie; through shuffles goes each but once or so, whatever the number of tiles."""
    x = np.random.default_rng(3).standard_normal((8000, 64)).astype(np.float32)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    executors = spark.sparkContext._jsc.sc().statusStore().executorList
    before = executors(True).apply(0).totalShuffleWrite()
    assert embed_dedup.near_duplicates(d).filter("kept").count() == len(x)
    assert executors(True).apply(0).totalShuffleWrite() - before < 3 * x.nbytes


def covered(texts, size):
    where = defaultdict(list)
    for i, t in enumerate(texts):
        for j in range(len(t) - size + 1):
            where[t[j : j + size]].append((i, j))
    out = [np.zeros(len(t), dtype=bool) for t in texts]
    for v in where.values():
        for i, j in v if len(v) > 1 else []:
            out[i][j : j + size] = True
    return out


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", b"a"])
def test_run_length_index(alphabet):
    rng = random.Random(7)
    for _ in range(12):
        base = bytes(rng.choices(alphabet, k=200))
        texts = []
        for _ in range(rng.randint(1, 7)):
            a = rng.randint(0, 150)
            p = bytearray(base[a : rng.randint(a, 200)] + bytes(rng.choices(alphabet, k=rng.randint(1, 50))))
            p[rng.randrange(len(p))] = rng.choice(alphabet)
            texts.append(bytes(p))
        size = rng.choice([3, 10, 30])
        for (s, e), want in zip(suffix.repeated_positions(texts, size), covered(texts, size)):
            got = np.zeros(len(want), dtype=bool)
            for a, b in zip(s, e):
                got[a:b] = True
            assert (got == want).all()


@pytest.mark.parametrize(("hot", "often"), [(2048, 256), (2, 256), (2048, 2), (2, 1)])
def test_exact_repeats(spark, monkeypatch, hot, often):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "OFTEN", often)
    passage = prose(33, 90)
    d = awkward(spark, [(300 + i, prose(400 + i, 60) + " " + passage + " " + prose(500 + i, 60), "en", "r") for i in range(5)] + [(310, "ab" * 600, "en", "r")])
    for f in (d, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in f.collect()]
        want = Counter()
        for (i, t), m in zip(rows, covered([t for _, t in rows], 400)):
            runs = int(np.count_nonzero(np.diff(np.concatenate(([False], m)).astype(int)) == 1))
            want[(i, len(t), int(m.sum()), runs, hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~m].tobytes()).hexdigest())] += 1
        assert Counter(map(tuple, suffix.remove_repeats(f).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(3)
    for trial in range(60):
        sizes = rng.integers(0, 60, rng.integers(1, 6))
        first = np.concatenate(([0], np.cumsum(sizes)))
        h = rng.integers(0, rng.choice([5, 1000]), first[-1]).astype(np.uint64)
        least, reach = int(rng.integers(1, 12)), 30
        g = (mix(h + np.uint64(trial * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(24)).tolist()
        want = set()
        for lo, hi in zip(first, first[1:]):
            for c in range(lo, hi):
                a = b = c
                while a > lo and c - a < reach and g[a - 1] > g[c]:
                    a -= 1
                while b + 1 < hi and b - c < reach and g[b + 1] >= g[c]:
                    b += 1
                if b - a + 1 >= least:
                    want.add((c, a, b))
        assert set(zip(*(x.tolist() for x in compact.compact_windows(h, first, trial, least, reach)))) == want


def word_spans(text):
    return {i for x in text.split(",") if x for i in range(*map(int, x.split(":")))}


def passages(d):
    """(documents and words that must be found): 50-word runs that other documents have word for word."""
    where, need = defaultdict(list), defaultdict(set)
    for i, t in d:
        w = t.lower().split()
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].append((i, j))
    for v in where.values():
        if len({i for i, _ in v}) > 1:
            for i, j in v:
                need[i].update(range(j, j + 50))
    return need


def test_passages(spark):
    passage, line = prose(33, 60), prose(34, 20)
    changed = passage.split()
    changed[30] = "other"
    extra = [(300 + i, prose(400 + i, 80) + " " + passage + " " + prose(500 + i, 80), "en", "r") for i in range(4)] + [(310, prose(600, 80) + " " + " ".join(changed) + " " + prose(601, 90), "en", "r")]
    extra += [(700 + i, prose(700 + i, 70) + " " + line + " " + prose(800 + i, 70), "en", "c") for i in range(30)]
    d = awkward(spark, extra)
    got = defaultdict(set)
    for r in compact.near_duplicate_passages(d).collect():
        got[r["doc_id"]] |= word_spans(r["spans"])
    need = passages([(r["doc_id"], r["text"] or "") for r in d.collect()])
    assert all(w <= got[i] for i, w in need.items())
    assert len(got[310] & set(range(80, 140))) >= 50  # one changed word does not hide a passage
    assert not {i for i in got if i and i >= 700}  # a common line is too short
    assert not {i for i in (4, 5, 6, 7, 8) if got[i]}
    out = by_id(compact.drop_repeats(d))
    assert compact.drop_repeats(d).count() == d.count() and compact.drop_repeats(d).columns == d.columns
    assert sum(passage in (out[i]["text"] or "") for i in (300, 301, 302, 303)) <= 1
    assert out[700]["text"] == by_id(d)[700]["text"] and out[3]["text"] is None
    assert sorted(len((out[i]["text"] or "").split()) for i in (1, 2)) == [0, 120]
    assert compact.near_duplicate_passages(empty(spark)).count() == 0 and compact.drop_repeats(empty(spark)).count() == 0


def test_common_shingle_is_split(spark, monkeypatch):
    monkeypatch.setattr(compact, "GROUP", 8)
    line, passage = prose(34, 30), prose(35, 55)
    rows = [(i, prose(2000 + i, 40) + " " + line + " " + prose(3000 + i, 40)) for i in range(60)] + [(100 + i, prose(4000 + i, 20) + " " + line + " " + passage + " " + prose(5000 + i, 20)) for i in range(6)]
    got = {r["doc_id"] for r in compact.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(100, 106))


def test_no_exact_repeat_is_lost_between_parts(spark, monkeypatch):
    monkeypatch.setattr(compact, "GROUP", 4)
    monkeypatch.setattr(compact, "HOT", 1)
    line = prose(34, 48)  # one shingle short of a passage of its own
    rows = [(i, prose(2000 + i, 60) + " " + line + " " + prose(3000 + i, 60)) for i in range(80)]
    rows += [(100 + i, prose(4000 + i, 60) + " " + line + " " + prose(35 + i // 2, 4) + " " + prose(5000 + i, 60)) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    need = passages(rows)
    got = {r["doc_id"]: word_spans(r["spans"]) for r in compact.near_duplicate_passages(d).collect()}
    assert all(w <= got.get(i, set()) for i, w in need.items())
    assert set(got) == set(need) >= set(range(100, 112))


def batches(table, rng):
    at = 0
    while at < table.num_rows:
        n = rng.randint(1, 4)
        yield from table.slice(at, n).to_batches()
        at += n


def test_folds_do_not_depend_on_batches():
    rng = random.Random(5)
    for _ in range(80):
        n = rng.randint(1, 30)
        rows = sorted((rng.randint(0, 2), rng.randint(0, 1), rng.randint(0, 3), i) for i in range(n))
        pick = lambda k: pa.array([r[k] for r in rows], pa.int64())
        groups = defaultdict(list)
        for a, x, t, i in rows:
            groups[a, x].append((t, i))
        table = pa.table({"h1": pick(2), "h2": pick(2), "a": pick(0), "x1": pick(1), "x2": pick(1), "s": pick(3), "e": pick(3), "mark": pa.array([False] * n)})
        got = [r for b in suffix.fold_same(batches(table, rng)) for r in b.to_pylist()]
        assert sorted(r["s"] for r in got if r["a"] is not None) == sorted(g[0][1] for g in groups.values())
        assert sorted(r["s"] for r in got if r["a"] is None) == sorted(i for g in groups.values() if len(g) > 1 for _, i in g)
        small = pa.array([r[3] for r in rows], pa.int32())
        table = pa.table({"key": pick(0), "x": pick(1), "h1": pick(2), "h2": pick(2), "c": small, "s": small, "e": small, "m": pa.array([-1] * n, pa.int32())})
        schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("c", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("later", pa.bool_())])
        got = [r for b in compact.fold_equal(batches(table, rng), schema) for r in b.to_pylist()]
        assert sorted(r["s"] for r in got if r["key"] is not None) == sorted(g[0][1] for g in groups.values())
        several = [g for g in groups.values() if g[0][0] != g[-1][0]]
        assert sorted((r["s"], r["later"]) for r in got if r["key"] is None) == sorted((i, t != g[0][0]) for g in several for t, i in g)


def test_index_of_a_shard_takes_little_memory():
    """Two tasks of an executor index a shard each; what one holds at a time stays under 100 bytes a byte of text."""
    import tracemalloc

    rng = np.random.default_rng(2)
    part = rng.integers(97, 123, 200_000).astype(np.uint8).tobytes()
    pieces = [part, rng.integers(97, 123, 100_000).astype(np.uint8).tobytes(), part[50_000:150_000]]
    tracemalloc.start()
    got = suffix.repeated_positions(pieces, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(s.tolist(), e.tolist()) for s, e in got] == [([50_000], [150_000]), ([], []), ([0], [100_000])]
    assert peak < 100 * sum(map(len, pieces))


def test_passages_of_fifty_words_show_though_they_are_too_short_to_go(spark):
    rng = random.Random(12)
    some = lambda n: ["".join(rng.choices("abcdefghijk", k=rng.randint(1, 7))) for _ in range(n)]
    passage, common = some(55), some(9)
    texts = [some(200) + passage + some(100), some(30) + passage, [*passage[:49], "x"] + some(80), some(60), passage[3:] + some(5) + passage[:52], some(49), common]
    texts += [some(rng.randint(0, 90)) + common + some(rng.randint(0, 90)) for _ in range(20)] + [texts[3]]
    rows = [(i, rng.choice(" \n\t").join(t)) for i, t in enumerate(texts)] + [(99, None)]
    runs = Counter(tuple(t[i : i + 50]) for t in texts for i in range(len(t) - 49))
    want = {i: len({k for j in range(len(t) - 49) if runs[tuple(t[j : j + 50])] > 1 for k in range(j, j + 50)}) for i, t in enumerate(texts)} | {99: 0}
    assert want[0] == want[1] == 55 and want[2] == 0 and want[4] == 104 and want[3] == 60
    for length in (400, 120):
        got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length).collect()}
        assert {i: r.n_repeat_words for i, r in got.items()} == want
    assert {r.n_removed for r in suffix.remove_repeats(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()} == {0}
