"""Passage matching of operator 10 against all pairs of stretches."""

import random

import numpy as np

from kinweave.llm import compact

from .helpers import prose


def edited(rng, p, sizes=(2, 6)):
    """``p`` with one or two runs of words changed, put in or left out in its middle third."""
    p = list(p)
    for _ in range(rng.choice([1, 1, 2])):
        n, at = rng.randint(*sizes), rng.randint(len(p) // 3, 2 * len(p) // 3)
        p[at : at + rng.choice([0, n, n])] = [f"e{rng.random()}" for _ in range(rng.choice([0, n, n]))]
    return p


def hashes(words):
    return compact.shingled([" ".join(words).encode()])[0]


def all_stretches(a, ca, b, cb, least, similar):
    """What all similar passages around the centres take in, by trying all; both end at shingles of both."""
    a, b = a.tolist(), b.tolist()
    stretches = lambda t, c, o: [(i, j, set(t[i:j])) for i in range(c + 1) for j in range(max(c + 1, i + least), len(t) + 1) if t[i] in o and t[j - 1] in o]
    found = []
    for i, j, p in stretches(a, ca, set(b)):
        for x, y, q in stretches(b, cb, set(a)):
            n = len(p & q)
            if n >= similar * (len(p) + len(q) - n) and {a[i], a[j - 1]} <= q and {b[x], b[y - 1]} <= p:
                found.append((i, j, x, y))
    return found and tuple(f(v) for f, v in zip((min, max, min, max), zip(*found, strict=True), strict=True))


def test_passages_match_over_any_hole():
    rng, found = random.Random(1), 0
    for trial in range(40):
        p = rng.choices("abcd", k=40) if trial % 4 == 3 else [f"w{trial}-{i}" for i in range(rng.randint(35, 45))]
        a, b = (hashes([f"{s}{i}" for i in range(6)] + x + [f"{s}{i}" for i in range(9, 15)]) for s, x in (("x", p), ("y", edited(rng, p))))
        common = sorted(set(a.tolist()) & set(b.tolist()))
        if not common:
            continue
        v = rng.choice(common)
        ca, cb = a.tolist().index(v), b.tolist().index(v)
        want, m = all_stretches(a, ca, b, cb, 20, 0.6), compact.match_passages(a, ca, b, cb, 20, 0.6)
        assert (m or []) == want
        found += bool(m)
    assert found >= 10


def test_three_changed_words_do_not_hide_a_passage():
    a = prose(41, 98).split()
    b = [*a[:46], "one", "two", "three", *a[49:]]
    a, b = hashes(a), hashes(b)
    assert len(set(a.tolist()) & set(b.tolist())) == 87
    assert compact.match_passages(a, 20, b, 20, 46, 0.8) == (0, 94, 0, 94)


def marks(rows, contexts):
    """Per item and kind of mark (any, later): the places marked."""
    out = {(i, k): set() for i in range(len(contexts)) for k in (False, True)}
    for i, s, e, later in rows:
        out[i, False].update(range(s, e))
        if later:
            out[i, True].update(range(s, e))
    return out


def linked(ids, contexts, centres, sides, least, similar):
    """``link_group`` with a row (item, start, end, later) for each item."""
    rows = []
    for items, spans in compact.link_group(ids, contexts, centres, sides, least, similar):
        rows += [(i, centres[i] + s, centres[i] + e, bool(low < ids[i])) for i in items for s, e, low, high in spans if {low, high} != {ids[i]}]
    return rows


def all_pairs(ids, contexts, centres, least, similar, cross=None):
    rows = []
    for i in range(len(ids)):
        for k in range(len(ids)):
            if ids[i] > ids[k] and not (cross and cross[i] == cross[k]):
                m = compact.match_passages(contexts[i], centres[i], contexts[k], centres[k], least, similar)
                rows += [(i, m[0], m[1], True), (k, m[2], m[3], False)] if m else []
    return marks(rows, contexts)


def around(words, at):
    """(surroundings, centre) of the shingle that begins at word ``at``."""
    h = hashes(words)
    lo = max(0, at - 46)
    return h[lo : at + 47], at - lo


def test_links_do_not_go_through_leaders_only():
    p = [f"p{i}" for i in range(70)]
    b = [*p[:12], "b", *p[13:]]
    c = [*b[:58], "c1", "c2", "c3", "c4", *b[62:]]
    group = [around([f"{n}{i}" for i in range(60)] + w + [f"{n}{i}" for i in range(60, 120)], 95) for n, w in (("x", p), ("y", b), ("z", c))]
    ctx, at = zip(*group, strict=True)
    want = all_pairs([1, 2, 3], ctx, at, 46, 0.8)
    assert marks(linked([1, 2, 3], ctx, at, [False] * 3, 46, 0.8), ctx) == want and want[2, True]
    x = [f"x{i}" for i in range(300)]
    group = [around(x[:100] + [f"k{i}" for i in range(60)], 80), around([f"j{i}" for i in range(60)] + x[60:200], 80), around(x, 80)]
    ctx, at = zip(*group, strict=True)
    got = marks(linked([1, 2, 3], ctx, at, [False] * 3, 46, 0.8), ctx)
    assert got == all_pairs([1, 2, 3], ctx, at, 46, 0.8) and got[0, False] and got[1, False]


def test_large_groups_are_compared_whole():
    rng = random.Random(2)
    line = [f"line{i}" for i in range(30)]
    for trial in range(6):
        group, ids = [], []
        for n in range(80):
            kind = rng.randrange(7 if trial else 40)
            t = f"{trial}-{kind}-"
            after = edited(rng, [f"{t}{i}" for i in range(60)]) if kind < 5 else [f"{t}{n}-{i}" for i in range(60)]
            front = [f"{t}front{i}" for i in range(40)] if rng.random() < 0.3 else [f"{t}{n}f{i}" for i in range(40)]
            group.append(around(front + line + after, 40 + 20))
            ids.append(rng.randrange(70))
        ctx, at = zip(*group, strict=True)
        for sides in (None, [i % 2 for i in ids]):
            got = marks(linked(ids, ctx, at, sides or [0] * len(ids), 46, 0.8), ctx)
            assert got == all_pairs(ids, ctx, at, 46, 0.8, sides)


def test_a_partner_that_many_share_more_with():
    """Twenty items share more shingles with the last one than its true partner does, but no passage."""
    w = [f"w{i}" for i in range(97)]
    other = lambda n, keep: [x if i in keep else f"{n}-{i}" for i, x in enumerate(w)]
    rows = [other(n, {*range(24), *range(44, 52), *range(71, 97)}) for n in range(20)] + [other(20, {*range(23, 74)} - {30}), w]
    ctx, at = zip(*(around(r, 46) for r in rows), strict=True)
    ids = [*range(5, 25), 30, 31]
    assert {i for i, *_ in linked(ids, ctx, at, [False] * 22, 46, 0.8)} == {20, 21}


def test_changed_passages_of_a_common_line_at_any_group_size(spark, monkeypatch):
    line = prose(34, 30)
    rows = [(i, prose(2000 + i, 60) + " " + line + " " + prose(3000 + i, 60)) for i in range(80)]
    for n in range(20):  # one word changed on either side of the line: no word-for-word repeat
        for k in range(2):
            p = (prose(6000 + n, 16) + " " + line + " " + prose(7000 + n, 20)).split()
            p[7 if k else 55] = f"k{n}"
            rows.append((100 + 2 * n + k, prose(4000 + 2 * n + k, 60) + " " + " ".join(p) + " " + prose(5000 + 2 * n + k, 60)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for size in (4, 4096):
        monkeypatch.setattr(compact, "GROUP", size)
        got[size] = sorted(map(tuple, compact.near_duplicate_passages(d).collect()))
    assert got[4] == got[4096]
    assert {r[0] for r in got[4]} == set(range(100, 140))


def test_edited_passages_are_found():
    """Each passage of 50 to 100 words with one or two edits that keeps the similarity is met and matched, with one hash function."""
    rng, tried, run = random.Random(5), 0, compact.shared_run(46, 0.8)
    assert run == 21

    def windows(t):
        h = hashes(t)
        return h, compact.compact_windows(h, compact.np.array([0, len(h)]), 0, run, run)[0].tolist()

    def meet(a, b):
        (a, at), (b, of) = windows(a), windows(b)
        places = {a[c]: c for c in at}
        cut = lambda t, c: (t[max(0, c - compact.REACH) : c + compact.REACH + 1], min(c, compact.REACH))
        return any(b[c] in places and compact.match_passages(*cut(a, places[b[c]]), *cut(b, c), 46, 0.8) for c in of)

    for t in range(400):
        p = prose(10_000 + t, rng.randint(50, 100)).split()
        q = edited(rng, p)
        hp, hq = set(hashes(p).tolist()), set(hashes(q).tolist())
        if len(q) < 50 or len(hp & hq) < 0.8 * len(hp | hq):
            continue
        tried += 1
        assert meet(*(prose(20_000 + t, 60).split() * (k == 0) + prose(30_000 + t + k, 60).split() + x + prose(40_000 + t + k, 60).split() for k, x in enumerate((p, q))))
    assert tried > 150


def test_large_groups_lose_no_changed_passage(spark, monkeypatch):
    """The recall is the same whether a group is folded by Spark, within a task, or dealt over blocks."""
    line, rng, rows = prose(34, 40), random.Random(3), []
    for n in range(60):
        front = prose(6000 + n % 12, 20) if n % 3 else prose(6500 + n, 20)
        back = prose(7000 + n % 15, 24).split()
        back[rng.randrange(24)] = f"k{n}"
        rows.append((n, prose(8000 + n, 30) + " " + front + " " + line + " " + " ".join(back) + " " + prose(9000 + n, 30)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for hot, size in ((512, 2048), (2, 2048), (2, 8)):
        monkeypatch.setattr(compact, "HOT", hot)
        monkeypatch.setattr(compact, "GROUP", size)
        got.append(sorted(map(tuple, compact.near_duplicate_passages(d).collect())))
    assert len(got[0]) > 40 and got[0] == got[1] == got[2]


def test_repeats_are_numbered_from_the_centre():
    h = compact.np.array([5, 7, 5, 5, 9, 5, 1, 2], dtype=compact.np.uint64)
    out = compact.number_repeats(h, compact.np.array([0, 6, 8]), compact.np.array([3, 0]))
    assert out[3] == 5 and len(set(out[:6].tolist())) == 6 and out[6:].tolist() == [1, 2]


def test_many_pairs_match_as_one_by_one():
    rng, group = random.Random(8), []
    for n in range(60):
        p = [f"p{i}" for i in range(70)] if n % 4 else rng.choices("abc", k=70)
        x = [f"x{n}{i}" for i in range(20)] + edited(rng, p) + [f"y{n % 3}{i}" for i in range(30)]
        if n % 7 == 0:
            x = x[45:] + x[:45]
        common = [k for k in range(len(x) - 5) if x[k : k + 5] == [f"p{i}" for i in range(10, 15)]] or [25]
        group.append(around(x, common[0]))
    ctx, at = zip(*group, strict=True)
    small = [(c >> compact.np.uint64(32)).astype(compact.np.uint32) for c in ctx]
    offs = compact.np.concatenate(([0], compact.np.cumsum([len(c) for c in small])))
    a, b = compact.np.triu_indices(60, 1)
    meet = compact.np.array([small[i][at[i]] == small[j][at[j]] for i, j in zip(a, b, strict=True)])
    a, b = a[meet], b[meet]
    got = {r[0]: tuple(r[1:]) for r in compact.match_many(compact.np.concatenate(small), offs, compact.np.array(at), a, b, 30, 0.7).tolist()}
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        assert got.get(k) == compact.match_passages(small[i], at[i], small[j], at[j], 30, 0.7)
    assert len(got) > 100


def test_pairs_of_many_groups_are_looked_up_within_their_group():
    """Pairs of several groups at a time, and one of a group with the others, match as pair by pair; some hold a shingle twice or in another order."""
    np, rng = compact.np, compact.np.random.default_rng(4)
    items, centres, at = [], [], [0]
    for size in (2, 9, 1, 30):
        base = rng.integers(0, 300, 90).astype(np.uint32)
        base[45] = 1 << 31
        for k in range(size):
            c = base.copy()
            change = rng.integers(0, 90, k % 12)
            c[change[change != 45]] = rng.integers(0, 300, int((change != 45).sum()))
            if k % 3:
                c = np.where(np.arange(90) == 45, c, c + np.arange(90, dtype=np.uint32) * 1000)  # no shingle twice
            if k % 7 == 6:
                c[[10, 60]] = c[[60, 10]]
            lo = int(rng.integers(0, 20))
            items.append(c[lo:])
            centres.append(45 - lo)
        at.append(len(items))
    offs = np.concatenate(([0], np.cumsum([len(c) for c in items])))
    flat, centres = np.concatenate(items), np.array(centres)
    pairs = [(i, k) for lo, hi in zip(at, at[1:]) for i in range(lo, hi) for k in range(i + 1, hi)]
    a, b = np.array(pairs).T
    want = [compact.match_passages(items[i], int(centres[i]), items[k], int(centres[k]), 40, 0.8) for i, k in pairs]
    assert 20 < sum(w is not None for w in want) < len(want) - 20
    got = {r[0]: tuple(r[1:]) for r in compact.match_many(flat, offs, centres, a, b, 40, 0.8, np.array(at)).tolist()}
    assert [got.get(n) for n in range(len(pairs))] == want
    codes, code = np.unique(flat, return_inverse=True)
    twice = np.array([len(np.unique(c)) < len(c) for c in items])
    others, table = np.arange(at[3] + 1, at[4]), np.full(len(codes), -1)
    got = {r[0]: tuple(r[1:]) for r in compact.match_one(code, offs, centres, at[3], others, twice, table, 40, 0.8)}
    assert (table == -1).all()
    assert [got.get(n) for n in range(len(others))] == [w for (i, _), w in zip(pairs, want) if i == at[3]]


def test_pairs_that_can_add_nothing_are_not_compared(monkeypatch):
    rng = random.Random(8)
    base = [rng.randrange(1 << 32) for _ in range(129)]
    contexts = []
    for _ in range(150):  # copies of one text, each changed in two places but for the centre
        a = list(base)
        for at in (rng.randrange(0, 50), rng.randrange(75, 120)):
            a[at : at + 9] = [rng.randrange(1 << 32) for _ in range(9)]
        contexts.append(np.array(a, dtype=np.uint32))
    ids, centres, sides = list(range(150)), [64] * 150, [False] * 150
    compared, one = [], compact.match_one

    def counted(code, offs, at, a, b, *rest):
        compared.append(len(b))
        return one(code, offs, at, a, b, *rest)

    monkeypatch.setattr(compact, "match_one", counted)
    got = marks(linked(ids, contexts, centres, sides, 46, 0.8), contexts)
    assert got == all_pairs(ids, contexts, centres, 46, 0.8)
    assert sum(compared) < 1000  # 150 * 149 / 2 pairs


def test_reachable_bounds_hold_every_match():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.permutation(1 << 20)[:129].astype(np.uint32)
        b = a.copy()
        for at in rng.integers(0, 120, 4):
            if not at <= 64 < at + 9:
                b[at : at + 9] = rng.integers(1 << 21, 1 << 30, 9)
        p = np.flatnonzero(a == b)
        lo, hi, down, up, fits = compact._reachable(np.zeros(len(p), dtype=np.int64), p, p, np.ones(1, dtype=bool), 64, 46, 0.8)
        m = compact.match_passages(a, 64, b, 64, 46, 0.8)
        assert not m or fits[0] and lo[0] <= m[0] and hi[0] >= m[1] and down[0] <= m[2] and up[0] >= m[3]
        assert not m or (lo[0], hi[0], down[0], up[0]) == m or min(m[1] - m[0], m[3] - m[2]) < 60


def test_a_shingle_is_counted_once_for_each_text(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(140)]
    texts = [" ".join(words), " ".join(words[:139] + ["other"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = compact.distinct_texts(docs)
    member = rows.selectExpr("h1", "h2", "explode(sequence(50, 90, 4)) as c").selectExpr("cast(c as long) as key", "h1", "h2", "c", "c - 40 as s", "c + 40 as e")
    sent, table = [], compact.bloom_table
    monkeypatch.setattr(compact, "bloom_table", lambda counted: (sent.append([tuple(r) for r in counted.collect()]), table(counted))[1])
    kept = compact._classes(rows, member, 46, 0.8)
    assert len(sent[0]) == 120 and {n for _, n in sent[0]} == {2}  # shingles 10 to 129, in eleven groups each text
    assert kept.count() == 22
