"""Near-duplicate passages by compact windows.

A text is its sequence of hashed word shingles. All passages whose least hash stands at
the same place form one compact window: that place with the nearest smaller hashes to
both sides, a node of the Cartesian tree. Windows wide enough for a run of shingles that
near-duplicate passages must share (``shared_run``) are joined by their least hash; what
is around them is compared shingle by shingle, and near-duplicate passages are kept that
reach the asked Jaccard similarity.

How many hash functions are enough follows from the windows' width: with windows as wide
as a whole passage one function meets a pair with the probability of its similarity; with
windows as wide as the shared run every function meets every pair, so one is enough.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_table, column_bytes, free_names, in_bloom, materialize, slices, text_docs, text_key, to_batch
from .kernels import LOWER, join_texts, mix, prefix, shingle_hashes, span_hash, words
from .suffix import merge_spans, window_minima

#: Words of a shingle, least words of a passage, least similarity, hash functions.
SHINGLE, PASSAGE, SIMILAR, FUNCTIONS = 5, 50, 0.8, 1
#: Shingles to each side of a window's least one that are compared.
REACH = 64
#: Groups with more different surroundings are folded into classes by Spark instead of within a task.
HOT = 2048
#: Groups of up to so many different surroundings are compared pair by pair, many groups at a time.
FEW = 48
#: Groups of more classes are dealt over blocks of about so many, all pairs of which are compared.
GROUP = 2048
#: Counted shingles that a task holds before it sends them.
SEEN = 1 << 20
#: Surroundings that are held at a time.
PLACES = 8192
_POS = 24


def shared_run(least: int, similar: float) -> int:
    """Shingles in a row that passages of ``least`` shingles or more share if they reach ``similar``.

    Of n shingles of the shorter passage at least 2 s / (1 + s) n are shared. A hole between
    shared runs takes SHINGLE - 1 or more of the others, so the runs are few and the longest
    is no shorter than the mean. (Shingles that repeat within a passage can undercut this.)
    """
    part = 2 * similar / (1 + similar)
    runs = lambda n: int((n - math.ceil(part * n - 1e-9)) // (SHINGLE - 1)) + 1
    return max(1, min(-(-math.ceil(part * n - 1e-9) // runs(n)) for n in range(least, 8 * least)))


def shingled(texts: list[bytes]):
    """(hashes, first, word starts, word ends, offsets): all texts' shingles, in order.

    ``first[i]`` is where text i's shingles begin in ``hashes`` (one more at the end);
    word starts and ends are byte places in the joined buffer.
    """
    buf, offs = join_texts(texts)
    low = LOWER[buf]
    s, e, doc = words(low, offs)
    h, at = shingle_hashes(span_hash(prefix(low), s, e), doc, SHINGLE)
    first = np.searchsorted(doc[at], np.arange(len(texts) + 1))
    return h, first, s, e, np.searchsorted(doc, np.arange(len(texts) + 1)), offs


def compact_windows(h: np.ndarray, first: np.ndarray, seed: int, least: int, reach: int = REACH):
    """(c, l, r): compact windows of at least ``least`` shingles, cut at ``reach`` to each side.

    Only places that are least in some run of ``least`` can have one; their nearest
    smaller neighbours are found by descending through minima over powers of two.
    """
    n = len(h)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    # The place in the low bits makes all values differ: the leftmost of equal hashes is least.
    bits = np.uint64(max(_POS, n.bit_length()))  # more where a slice has more shingles than usual
    g = (mix(h + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) >> bits) << bits | np.arange(n, dtype=np.uint64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[: n - least + 1] == doc[least - 1 :]
    c = np.unique(window_minima(g, least)[whole] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lo, hi, own = first[doc[c]], first[doc[c] + 1], g[c]
    levels = [g]
    while 2 ** len(levels) <= min(reach, n):
        step = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    left, right = c.copy(), c + 1
    for k in range(len(levels) - 1, -1, -1):
        size, m = 2**k, levels[k]
        at = right
        ok = (at + size <= hi) & (at + size - c <= reach + 1)
        ok[ok] = m[at[ok]] > own[ok]
        right = np.where(ok, at + size, right)
        at = left - size
        ok = (at >= lo) & (c - at <= reach)
        ok[ok] = m[at[ok]] > own[ok]
        left = np.where(ok, at, left)
    wide = right - left >= least
    return c[wide], left[wide], right[wide] - 1


def inside_runs(h: np.ndarray, first: np.ndarray, c: np.ndarray, every: int = 32) -> np.ndarray:
    """Of places ``c`` those within a run of one and the same shingle, but for every 32nd.

    Where one word goes on and on each place is least of some window; all inside look alike.
    """
    same = h[1:] == h[:-1]
    same[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(h))] - 1] = False
    before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
    start = np.maximum.accumulate(np.where(before, 0, np.arange(len(h))))
    return before[c] & after[c] & ((c - start[c]) % every != 0)


def _keys(h: np.ndarray, seed: int) -> np.ndarray:
    return mix(h ^ mix(np.array([seed + 77], dtype=np.uint64))[0])


def match_passages(a: np.ndarray, ca: int, b: np.ndarray, cb: int, least: int, similar: float, once: bool | None = None):
    """(start, end) of what near-duplicate passages around the shared shingle take in of a and of b, or None.

    Every two stretches between shared shingles are looked at and checked exactly: wide
    enough on both sides, and their sets of shingles similar enough. ``once`` says that neither a nor b
    has a shingle twice; then shingles that come in the same order in both need no search
    through all pairs of stretches.
    """
    if once is None:
        once = len(np.unique(a)) == len(a) and len(np.unique(b)) == len(b)
    if once:
        both = np.concatenate((a, b))
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        twin = np.flatnonzero(ranked[1:] == ranked[:-1])
        if len(twin) < similar * least:
            return None
        i, x = order[twin], order[twin + 1] - len(a)
        by = np.argsort(i)
        i, x = i[by], x[by]
        if (x[1:] > x[:-1]).all():
            return _in_order(i, x, ca, least, similar)
    elif len(a) == len(b) and ca == cb and (a == b).all():
        return (0, len(a), 0, len(b)) if len(a) >= least else None
    return _widest(a, ca, b, cb, least, similar)


def _in_order(i: np.ndarray, x: np.ndarray, c: int, least: int, similar: float):
    """What near-duplicate passages take in if places ``i`` of one and ``x`` of the other hold the shared shingles, both ascending.

    Passages end at shared shingles; going on along a run that both have lowers no
    similarity, so only the runs' ends are tried, all with all.
    """
    new = (np.diff(i) > 1) | (np.diff(x) > 1)
    k = int(np.searchsorted(i, c))
    starts = np.concatenate(([0], np.flatnonzero(new) + 1))
    ends = np.concatenate((np.flatnonzero(new), [len(i) - 1]))
    starts, ends = starts[starts <= k], ends[ends >= k]
    shared = ends[None, :] - starts[:, None] + 1
    wide, broad = i[ends][None, :] - i[starts][:, None] + 1, x[ends][None, :] - x[starts][:, None] + 1
    ok = (np.minimum(wide, broad) >= least) & (shared >= similar * (wide + broad - shared) - 1e-9)
    if not ok.any():
        return None
    s, e = starts[ok.any(axis=1).argmax()], ends[len(ends) - 1 - ok.any(axis=0)[::-1].argmax()]
    return int(i[s]), int(i[e]) + 1, int(x[s]), int(x[e]) + 1


def _widest(a: np.ndarray, ca: int, b: np.ndarray, cb: int, least: int, similar: float):
    """(start, end) of what all passages around the shared shingle that are similar enough take in, or None.

    Passages end at shingles that both have. To go on while the next shingle of one
    side follows on the other lowers no similarity, so only the ends of such runs are
    tried, all with all.
    """
    i, j = _run_ends(a, ca, b, least)
    x, y = _run_ends(b, cb, a, least)
    if not len(i) or not len(x):
        return None
    values, code = np.unique(np.concatenate((a, b)), return_inverse=True)

    def inside(code, lo, hi):
        seen = np.zeros((len(code) + 1, len(values)), dtype=np.int16)
        np.cumsum(code[:, None] == np.arange(len(values)), axis=0, out=seen[1:])
        return seen[hi] > seen[lo]

    of_a, of_b = code[: len(a)], code[len(a) :]
    p, q = inside(of_a, i, j), inside(of_b, x, y)
    shared = (p.astype(np.float32) @ q.T.astype(np.float32)).astype(np.int64)
    union = p.sum(axis=1)[:, None] + q.sum(axis=1) - shared
    ok = (shared >= similar * union - 1e-9) & q[:, of_a[i]].T & q[:, of_a[j - 1]].T & p[:, of_b[x]] & p[:, of_b[y - 1]]
    if not ok.any():
        return None
    k, m = ok.any(axis=1), ok.any(axis=0)
    return int(i[k].min()), int(j[k].max()), int(x[m].min()), int(y[m].max())


def _run_ends(a: np.ndarray, c: int, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all stretches of a around c, ``least`` wide or more, from one run's start to one's end."""
    where: dict[int, list[int]] = {}
    for k, v in enumerate(b.tolist()):
        where.setdefault(v, []).append(k)
    at = [where.get(v, []) for v in a.tolist()]
    goes_on = [bool(at[k]) and [q + 1 for q in at[k]] == at[k + 1] for k in range(len(a) - 1)]
    starts = np.array([k for k in range(c + 1) if at[k] and not (k and goes_on[k - 1])])
    ends = np.array([k + 1 for k in range(c, len(a)) if at[k] and not (k + 1 < len(a) and goes_on[k])])
    i, j = np.repeat(starts, len(ends)), np.tile(ends, len(starts))
    wide = j - i >= least
    return i[wide], j[wide]


def number_repeats(h: np.ndarray, offs: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Surroundings in which a shingle that repeats is told apart by its number, counted from the centre outward.

    So shingles count as often as they occur, and a line that goes on and on is no passage
    like any other that holds it once.
    """
    size = np.diff(offs)
    item = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((h, item))
    twice = np.flatnonzero((h[order][1:] == h[order][:-1]) & (item[order][1:] == item[order][:-1]))
    if not len(twice):
        return h
    some = np.zeros(len(size), dtype=bool)
    some[item[order[twice]]] = True
    at = np.flatnonzero(some[item])
    rel = at - offs[item[at]] - centres[item[at]]
    by = np.lexsort((np.abs(rel), rel < 0, h[at], item[at]))
    key = np.stack([item[at][by], h[at][by].view(np.int64), rel[by] < 0])
    new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))
    number = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    # The first to the left counts on from the centre's own, or the first to the right is number 0.
    number = number * 2 + (key[2] > 0)
    out = h.copy()
    many = number > 0
    out[at[by[many]]] = mix(h[at[by[many]]] + mix(number[many].astype(np.uint64)))
    return out


def last_before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the greatest place at or before it that some later place up to it repeats; -1 for none."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))  # stable, so places ascend
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    out = np.full(len(h), -1)
    out[order[1:][same]] = order[:-1][same]
    return np.maximum.accumulate(out)


def cut_around(h: np.ndarray, before: np.ndarray, s: np.ndarray, e: np.ndarray, c: np.ndarray):
    """(shingles, offsets) of the surroundings [s, e) of places c, repeats numbered; ``before`` as from ``last_before``."""
    size = e - s
    offs = np.concatenate(([0], np.cumsum(size)))
    out = h[np.arange(offs[-1]) - np.repeat(offs[:-1] - s, size)]
    some = np.flatnonzero(before[e - 1] >= s)
    if len(some):
        of = np.concatenate(([0], np.cumsum(size[some])))
        at = np.arange(of[-1]) - np.repeat(of[:-1] - offs[some], size[some])
        out[at] = number_repeats(out[at], of, (c - s)[some])
    return out, offs


def match_many(flat: np.ndarray, offs: np.ndarray, centres: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, similar: float, at: np.ndarray | None = None):
    """(pair, start, end, start, end) of pairs of surroundings (a[i], b[i]) that match, as ``match_passages`` has it; many at a time.

    ``flat`` holds all surroundings' shingles as 32-bit words, places (under 512) count from their starts.
    ``at`` bounds groups of surroundings within which the pairs lie. Each group has a table of where
    its shingles stand in each of its surroundings, so a pair is looked up and not sorted.
    """
    n = offs[1:] - offs[:-1]
    at = np.array([0, len(n)]) if at is None else np.asarray(at)
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))  # of an item
    item = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - offs[item]
    kinds, code = np.unique(group[item].astype(np.uint64) << np.uint64(32) | flat.astype(np.uint64), return_inverse=True)
    first = np.searchsorted(kinds >> np.uint64(32), np.arange(len(at)).astype(np.uint64))
    wide = np.diff(first)  # different shingles of a group
    begin = np.concatenate(([0], np.cumsum(wide * np.diff(at))))
    row = begin[group] + (np.arange(len(n)) - at[group]) * wide[group] - first[group]  # an item's row, less the group's first code
    table = np.full(begin[-1], -1, dtype=np.int16)
    table[row[item] + code] = place
    twice = np.zeros(len(n), dtype=bool)
    twice[item[table[row[item] + code] != place]] = True
    out = [np.zeros((0, 5), dtype=np.int64)]
    per = 1 << 13
    for lo in range(0, len(a), per):
        p, q = a[lo : lo + per], b[lo : lo + per]
        ends = np.concatenate(([0], np.cumsum(n[p])))
        i = np.arange(ends[-1]) - np.repeat(ends[:-1], n[p])
        x = table[code[i + np.repeat(offs[p], n[p])] + np.repeat(row[q], n[p])]
        hit = np.flatnonzero(x >= 0)
        pair = np.searchsorted(ends, hit, "right") - 1
        found = _match_places(flat, offs, centres, p, q, twice[p] | twice[q], pair, i[hit], x[hit].astype(np.int64), least, similar)
        if found:
            got = np.array(found, dtype=np.int64)
            got[:, 0] += lo
            out.append(got)
    return np.concatenate(out)


def match_one(code: np.ndarray, offs: np.ndarray, centres: np.ndarray, a: int, b: np.ndarray, twice: np.ndarray, table: np.ndarray, least: int, similar: float) -> list:
    """``match_many`` of one of a group's surroundings with others.

    ``table`` holds -1 for each code and does so again afterwards; ``twice`` says which surroundings hold a shingle twice.
    """
    n = offs[b + 1] - offs[b]
    mine = code[offs[a] : offs[a + 1]]
    table[mine] = np.arange(len(mine))
    ends = np.concatenate(([0], np.cumsum(n)))
    x = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
    i = table[code[x + np.repeat(offs[b], n)]]
    table[mine] = -1
    hit = np.flatnonzero(i >= 0)
    pair = np.searchsorted(ends, hit, "right") - 1
    return _match_places(code, offs, centres, np.full(len(b), a), b, twice[b] | twice[a], pair, i[hit], x[hit], least, similar)


def _match_places(flat, offs, centres, p, q, odd, pair, i, x, least: int, similar: float) -> list:
    """(pair, start, end, start, end) of matching pairs (p[k], q[k]) with the same shingles at places i and x.

    Sorted by pair and either place. Pairs that are ``odd`` or have shingles in another order are matched one by one.
    """
    enough = np.bincount(pair, minlength=len(p)) >= similar * least
    some = (enough & ~odd)[pair]
    pair, i, x = pair[some], i[some], x[some]
    inner = pair[1:] == pair[:-1]
    odd = odd.copy()
    odd[pair[1:][inner & ((x[1:] <= x[:-1]) | (i[1:] <= i[:-1]))]] = True
    found = [(k, *m) for k in np.flatnonzero(odd).tolist() if (m := match_passages(flat[offs[p[k]] : offs[p[k] + 1]], int(centres[p[k]]), flat[offs[q[k]] : offs[q[k] + 1]], int(centres[q[k]]), least, similar))]
    keep = ~odd[pair]
    pair, i, x = pair[keep], i[keep], x[keep]
    if len(pair):
        found += _runs_in_order(pair, i, x, centres[p], least, similar)
    return found


def _runs_in_order(pair: np.ndarray, i: np.ndarray, x: np.ndarray, c: np.ndarray, least: int, similar: float) -> list:
    """``_in_order`` for the shared places of many pairs, sorted by pair and place."""
    new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (np.diff(i) > 1) | (np.diff(x) > 1)))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(pair)) - 1
    of = pair[head]
    # A start is a run's head at or before the centre, an end a run's tail at or after it.
    starts, ends = head[i[head] <= c[of]], tail[i[tail] >= c[of]]
    count = np.bincount(pair[ends], minlength=len(c))
    begin = np.concatenate(([0], np.cumsum(count)))
    each = count[pair[starts]]
    s = np.repeat(starts, each)
    e = ends[np.arange(len(s)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[pair[starts]], each)]
    shared, wide, broad = e - s + 1, i[e] - i[s] + 1, x[e] - x[s] + 1
    ok = (np.minimum(wide, broad) >= least) & (shared >= similar * (wide + broad - shared) - 1e-9)
    s, e = s[ok], e[ok]
    if not len(s):
        return []
    k = pair[s]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    lo, hi = np.minimum.reduceat(s, first), np.maximum.reduceat(e, first)
    return list(zip(k[first].tolist(), i[lo].tolist(), (i[hi] + 1).tolist(), x[lo].tolist(), (x[hi] + 1).tolist(), strict=True))


def project(codes: np.ndarray, centres: np.ndarray, offs: np.ndarray, shared: np.ndarray, least: int, similar: float):
    """(usable, class hash, start, end) of each item's surroundings as the others of its group see them.

    Only shingles that are ``shared`` with another item can be matched; the rest are holes of which
    no more than the width counts, and what no passage can reach (``_bounds``) does not count at
    all. Items of one class hash match alike. Unusable are those whose shared shingles cannot make
    up a passage.
    """
    n = len(offs) - 1
    item = np.repeat(np.arange(n), np.diff(offs))
    rel = np.arange(len(codes)) - offs[item] - centres[item]
    reach = int(max(np.abs(rel).max(), 1)) if len(rel) else 1
    at = np.flatnonzero(shared)
    many = np.bincount(item[at], minlength=n)
    order = np.lexsort((codes, item))
    again = (codes[order[1:]] == codes[order[:-1]]) & (item[order[1:]] == item[order[:-1]])
    repeats = np.bincount(item[order[1:][again]], minlength=n) > 0
    # Fewer shared shingles cannot reach the similarity, unless shingles repeat.
    first, last, fits = _bounds(item[at], rel[at] + reach, np.where(repeats, 0.0, similar), reach, least)
    first, last = first - reach, last - reach
    usable = fits & ((many >= similar * least) | repeats)
    # Holes count by their width; where an item repeats itself they are kept as they are.
    keep = (shared | repeats[item]) & (rel >= first[item]) & (rel < last[item])
    part = mix(codes + mix(rel.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(np.where(keep, part, np.uint64(0)))))
    ends = mix(first.astype(np.int64).view(np.uint64) * np.uint64(1 << 20) + last.astype(np.int64).view(np.uint64))
    return usable, mix((sums[offs[1:]] - sums[offs[:-1]]) ^ ends), first + centres, last + centres


class _Classes:
    """Classes of a group in the order of their least texts: members and how far they are matched.

    Per class and place relative to the shared shingle ``low`` and ``high`` are the least and the
    greatest text (by rank) that a passage over the place was matched with.
    """

    def __init__(self, text: np.ndarray, of: np.ndarray, reach: int):
        order = np.lexsort((text, of))
        heads = np.flatnonzero(np.diff(of[order], prepend=-1))
        self.members = np.split(order, heads[1:])
        self.members.sort(key=lambda m: text[m[0]])
        self.first = np.array([text[m[0]] for m in self.members])
        self.last = np.array([text[m[-1]] for m in self.members])
        self.low = np.full((len(self.members), 2 * reach + 1), 1 << 30, dtype=np.int32)
        self.high = np.full(self.low.shape, -1, dtype=np.int32)
        self.own = len(np.unique(text)) == len(text)  # no text is there twice

    def add(self, x: int, y: int, span: slice) -> None:
        """A passage over ``span`` of class x was matched with class y."""
        np.minimum(self.low[x, span], self.first[y], out=self.low[x, span])
        np.maximum(self.high[x, span], self.last[y], out=self.high[x, span])

    def open(self, x, before: int) -> np.ndarray:
        """Places of class(es) x of which a match with a class whose least text is ``before`` could tell more than is known."""
        low = self.low[x]
        return low > before if self.own else (low > before) | (low == self.high[x])


def link_group(ids, contexts, centres, sides, least: int, similar: float, reach: int | None = None):
    """(items, [(start, end, low, high)]) for each class of one group around a shared shingle.

    A class is a list of items that match alike (``project``); places count from the centre,
    ``low`` and ``high`` are the least and the greatest id that a passage over these places
    matches. All pairs of different texts that can reach the similarity are compared, class by
    class (where there are two sides, those from side to side), but for pairs that could only tell again what is known.
    """
    reach = max([REACH, *map(len, contexts)]) if reach is None else reach
    names, text = np.unique(np.asarray(ids), return_inverse=True)
    offs = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
    centres, sides = np.asarray(centres, dtype=np.int64), np.asarray(sides)
    flat, code = np.unique(np.concatenate(contexts), return_inverse=True)
    item = np.repeat(np.arange(len(ids)), np.diff(offs))
    pairs = np.unique(code * np.int64(len(names)) + text[item])
    shared = np.bincount(pairs // len(names), minlength=len(flat))[code] > 1
    usable, x, first, last = project(flat[code].astype(np.uint64), centres, offs, shared, least, similar)
    place = np.arange(len(code)) - offs[item]
    shared &= (place >= first[item]) & (place < last[item])
    cross = len(np.unique(sides)) > 1
    if cross:
        x = x * np.uint64(2) + sides.astype(np.uint64)
    use = np.flatnonzero(usable)
    if len(use) < 2:
        return []
    classes = _Classes(text[use], np.unique(x[use], return_inverse=True)[1], reach)
    members = [use[m] for m in classes.members]
    once = np.ones(len(ids), dtype=bool)
    again = np.sort(item * np.int64(len(flat)) + code)
    once[again[1:][again[1:] == again[:-1]] // len(flat)] = False

    def matched(i: int, k: int, a: int, b: int, m) -> None:
        at = lambda c, lo, hi: slice(int(lo - c + reach), int(hi - c + reach))
        classes.add(i, k, at(centres[a], m[0], m[1]))
        classes.add(k, i, at(centres[b], m[2], m[3]))
        partner[i] = k

    def compare(i: int, k: int, a: int, b: int) -> None:
        if text[a] != text[b] and (m := match_passages(contexts[a], centres[a], contexts[b], centres[b], least, similar, bool(once[a] and once[b]))):
            matched(i, k, a, b, m)

    partner = np.zeros(len(members), dtype=np.int64)
    table = np.full(len(flat), -1, dtype=np.int64)
    if not cross:
        for i, m in enumerate(members):
            if len(m) > 1:
                compare(i, i, m[0], m[-1])
    # Of each class its first item stands for all, with only the shingles that are shared.
    reps = np.array([m[0] for m in members])
    own = [np.arange(offs[r], offs[r + 1])[shared[offs[r] : offs[r + 1]]] for r in reps]
    sizes = np.array([len(o) for o in own])
    start = np.concatenate(([0], np.cumsum(sizes)))
    at = np.concatenate(own)
    cls, what, place = np.repeat(np.arange(len(reps)), sizes), code[at], at - np.repeat(offs[reps], sizes)
    cls, out = cls.astype(np.int32), (place - centres[reps[cls]] + reach).astype(np.int32)  # places from the centre outward
    posts = np.argsort(what, kind="stable")
    begin = np.searchsorted(what[posts], np.arange(len(flat) + 1))
    ordered = what[posts] * len(at) + posts
    plain = once[reps]
    side = sides[reps]
    where = np.arange(-reach, reach + 1)
    # Places that passages can take in; what of them a later class could still add to is open.
    inside = (where >= (first - centres)[reps][:, None]) & (where < (last - centres)[reps][:, None])
    unmatched = (inside & (classes.high < 0)).any(axis=1) if classes.own else np.ones(len(reps), dtype=bool)
    for i in range(1, len(reps)):
        a = reps[i]
        for k in dict.fromkeys((i - 1, int(partner[i - 1]))):  # what lies next to it in order is as good a guess as any
            if k < i and text[reps[k]] != text[a] and not (cross and side[k] == side[i]) and (inside[i] & classes.open(i, classes.first[i] - 1)).any():
                compare(i, k, a, reps[k])
                unmatched[k] &= not classes.own or bool((inside[k] & (classes.high[k] < 0)).any())
        mine = what[start[i] : start[i + 1]]
        # To add to it a passage must end at a shared shingle as far out as its first open place to that side.
        open_ = np.flatnonzero(inside[i] & classes.open(i, classes.first[i] - 1)) - reach
        right, left = min(open_[open_ >= 0], default=1 << 30), max(open_[open_ <= 0], default=-(1 << 30))
        rel = out[start[i] : start[i + 1]] - reach
        need = (rel >= right) | (rel <= left)
        useful = unmatched[:i].copy()
        if not (need.any() or useful.any()):
            unmatched[i] = not classes.own or bool((inside[i] & (classes.high[i] < 0)).any())
            continue
        # All (place here, place in an earlier class) with the same shingle.
        size = np.searchsorted(ordered, mine * len(at) + start[i]) - begin[mine]
        here = np.repeat(np.arange(len(mine), dtype=np.int32), size)
        there = posts[np.arange(len(here)) + np.repeat(begin[mine] - np.cumsum(size) + size, size)]
        near = cls[there]
        useful[near[need[here]]] = True
        if cross:
            useful &= side[:i] != side[i]
        count = np.bincount(near, minlength=i)
        can = np.flatnonzero((count >= np.where(plain[:i] | plain[i], similar * least, 1)) & useful)
        row = np.full(i, -1, dtype=np.int32)
        row[can] = np.arange(len(can))
        row = row[near]
        use = np.flatnonzero(row >= 0)
        here, there, row = here[use], there[use], row[use]
        lo, hi, down, up, fits = _reachable(row, out[start[i] + here], out[there], plain[can] & plain[i], reach, least, similar)
        todo = np.flatnonzero(fits)
        todo = todo[np.argsort(-count[can[todo]], kind="stable")]
        theirs = np.zeros((len(todo), 2 * reach + 2), dtype=np.int32)
        np.cumsum(classes.open(can[todo], classes.first[i]), axis=1, out=theirs[:, 1:])
        n = np.arange(len(todo))
        theirs = theirs[n, up[todo]] > theirs[n, down[todo]]
        step = 4
        while len(todo):
            # A later class is done where an earlier text is known; an earlier one where any is.
            mine = np.concatenate(([0], np.cumsum(classes.open(i, classes.first[i] - 1))))
            adds = np.flatnonzero(theirs | (mine[hi[todo]] > mine[lo[todo]]))
            now, todo, theirs = can[todo[adds[:step]]], todo[adds[step:]], theirs[adds[step:]]
            step *= 4
            plainly = now[text[reps[now]] != text[a]]
            for k, *m in match_one(code, offs, centres, a, reps[plainly], ~once, table, least, similar):
                matched(i, int(plainly[k]), a, reps[plainly[k]], m)
            for k in now[text[reps[now]] == text[a]].tolist():  # another text of either class
                compare(i, k, members[i][-1], reps[k]) if text[members[i][-1]] != text[reps[k]] else compare(i, k, a, members[k][-1])
            unmatched[now] &= not classes.own or (inside[now] & (classes.high[now] < 0)).any(axis=1)
        unmatched[i] = not classes.own or bool((inside[i] & (classes.high[i] < 0)).any())
    found = []
    for i, m in enumerate(members):
        known = classes.high[i] >= 0
        if known.any():
            low, high = classes.low[i], classes.high[i]
            cut = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True])))
            found.append((m, [(int(s - reach), int(e - reach), names[low[s]], names[high[s]]) for s, e in zip(cut, cut[1:], strict=False) if known[s]]))
    return found


def _bounds(row: np.ndarray, at: np.ndarray, similar: np.ndarray, c: int, least: int):
    """(start, end, usable) per row of what passages around c can take in if the shingles at its places ``at`` are shared.

    A passage ends at shared shingles and at least ``similar`` of its shingles are shared.
    """
    hit = np.zeros((len(similar), 2 * c + 1), dtype=bool)
    hit[row, at] = True
    over = np.zeros((len(similar), 2 * c + 2), dtype=np.float32)
    np.cumsum(hit - similar[:, None].astype(np.float32), axis=1, out=over[:, 1:])
    left, right = over[:, : c + 1], over[:, c + 1 :]
    starts = hit[:, : c + 1] & (left <= right.max(axis=1, keepdims=True) + 1e-3)
    ends = hit[:, c:] & (right >= left.min(axis=1, keepdims=True) - 1e-3)
    start, end = starts.argmax(axis=1), 2 * c + 1 - ends[:, ::-1].argmax(axis=1)
    return start, end, starts.any(axis=1) & ends.any(axis=1) & (end - start >= least)


def _reachable(row: np.ndarray, p: np.ndarray, q: np.ndarray, once: np.ndarray, c: int, least: int, similar: float):
    """(start, end, start, end, usable) per row of what near-duplicate passages around c can take in of two surroundings.

    Places ``p`` of one (ascending within a row) and ``q`` of the other hold the same shingles. Where each shingle
    is there ``once`` and in the same order in both, what a stretch shares and its two widths
    are sums over its steps, so a start is possible if it is with the best of all ends, and an
    end if it is with the best of all starts. Elsewhere each side has its own bounds (``_bounds``).
    """
    n = len(once)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=bool),)
    by = np.argsort(row.astype(np.uint16) if n <= 1 << 16 else row, kind="stable")  # short words sort by radix
    row, p, q = row[by], p[by], q[by]
    first = np.searchsorted(row, np.arange(n))
    plain = once.copy()
    plain[row[1:][(row[1:] == row[:-1]) & ((p[1:] <= p[:-1]) | (q[1:] <= q[:-1]))]] = False
    worth = (1 + similar) * np.arange(len(row)) - similar * (p + q)
    starts, ends = p <= c, p >= c
    least_start = np.minimum.reduceat(np.where(starts, worth, np.inf), first)
    best_end = np.maximum.reduceat(np.where(ends, worth, -np.inf), first)
    starts &= worth <= best_end[row] + (1 - similar) + 1e-6
    ends &= worth >= least_start[row] - (1 - similar) - 1e-6
    low = lambda at: np.minimum.reduceat(np.where(starts, at, 2 * c + 1), first)
    high = lambda at: np.maximum.reduceat(np.where(ends, at, -1), first) + 1
    lo, hi, down, up = low(p), high(p), low(q), high(q)
    fits = (hi - lo >= least) & (up - down >= least)
    if len(odd := np.flatnonzero(~plain)):
        to = np.full(n, -1)
        to[odd] = np.arange(len(odd))
        at = np.flatnonzero(to[row] >= 0)
        tight = np.where(once[odd], similar, 0.0)
        lo[odd], hi[odd], some = _bounds(to[row[at]], p[at], tight, c, least)
        down[odd], up[odd], too = _bounds(to[row[at]], q[at], tight, c, least)
        fits[odd] = some & too
    return lo, hi, down, up, fits


def fold_equal(batches, schema):
    """Of rows sorted by (key, x, h1, h2): one row of each (key, x), and a mark for each row of those with several texts.

    Marks have a null key; rows that are marks already (``m`` is 0 or 1 for later) pass. What is carried between batches is the open group's first
    text and that text's rows, never the group.
    """
    key = x = head = None
    many, held = False, []

    def rows(i, b, later=None, key=None):
        n = len(i)
        cols = {c: b[c][i] for c in ("h1", "h2", "c", "s", "e")}
        return to_batch({"key": pa.nulls(n, pa.int64()) if key is None else key, **cols, "later": pa.nulls(n, pa.bool_()) if later is None else later}, schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        b = {f.name: batch.column(i).to_numpy() for i, f in enumerate(batch.schema)}
        if (b["m"] >= 0).any():
            yield rows(np.flatnonzero(b["m"] >= 0), b, b["m"][b["m"] >= 0] > 0)
            b = {c: v[b["m"] < 0] for c, v in b.items()}
            if not len(b["key"]):
                continue
        k, y, t = b["key"], b["x"], np.rec.fromarrays([b["h1"], b["h2"]])
        new = np.concatenate(([(k[0], y[0]) != (key, x)], (k[1:] != k[:-1]) | (y[1:] != y[:-1])))
        heads = np.flatnonzero(new)
        lead = np.arange(heads[0] if len(heads) else len(k))
        if len(lead):  # the group that is open from the batch before
            if not many and t[lead[-1]].item() != head:
                many = True
                for h in held:
                    yield rows(np.arange(len(h["h1"])), h, np.zeros(len(h["h1"]), dtype=bool))
                held = []
            if many:
                yield rows(lead, b, (b["h1"][lead] != head[0]) | (b["h2"][lead] != head[1]))
            else:
                held.append({c: b[c][lead] for c in b})
        if not len(heads):
            continue
        yield rows(heads, b, key=k[heads])
        ends = np.append(heads[1:], len(k))
        several = t[ends - 1] != t[heads]
        group = np.cumsum(new) - 1
        inside = np.flatnonzero((group >= 0) & several[group]) if several.any() else np.zeros(0, np.int64)
        if len(inside):
            yield rows(inside, b, t[inside] != t[heads][group[inside]])
        key, x, head, many = k[-1], y[-1], t[heads[-1]].item(), bool(several[-1])
        held = [] if many else [{c: b[c][heads[-1] :] for c in b}]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n, low, z): distinct texts by 128 bits of hash, their documents' number and least id."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("z", pa.binary())])

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            yield to_batch({"h1": b.column(0), "h2": b.column(1), "doc_id": b.column(2), "z": [z.compress(t) for t in column_bytes(b, "text")]}, schema)

    rows = docs.select(*text_key(), "doc_id", "text").mapInArrow(squeeze, "h1 long, h2 long, doc_id long, z binary")
    return materialize(rows.groupBy("h1", "h2").agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")), "passage-texts")


def once_each(pairs: np.ndarray) -> np.ndarray:
    """The different columns of a (2, n) array, in order."""
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    return pairs[:, np.concatenate((np.ones(min(1, pairs.shape[1]), dtype=bool), (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)))]


def _classes(texts: DataFrame, member: DataFrame, least: int, similar: float) -> DataFrame:
    """(key, x, h1, h2, c, s, e): usable rows of ``member`` with their class ``x`` (see ``project``).

    Which shingles are shared is counted over all members' surroundings at once: a shingle goes
    once for each text and not for each group that it stands near, so the count grows with the
    texts. That another group shares a shingle, like a chance hit in the bit table of fixed size
    that carries it, makes two classes of one but loses nothing.
    """
    places = member.groupBy("h1", "h2").agg(F.collect_list(F.struct("key", "c", "s", "e")).alias("p"))
    joined = texts.join(places, ["h1", "h2"]).select("h1", "h2", "z", "p")

    def surroundings(b):
        """Per slice: (row, key, c, s) of each place and the joined shingles around, with offsets."""
        unzip = zstandard.ZstdDecompressor()
        for b in slices([b], "z", 1 << 18):
            h, first, *_ = shingled([unzip.decompress(z) for z in b.column(2).to_pylist()])
            before = last_before(h, first)
            at = [(i, p["key"], p["c"], p["s"], p["e"]) for i, places in enumerate(b.column(3).to_pylist()) for p in places]
            for lo in range(0, len(at), PLACES):
                i, key, c, s, e = (np.array(v, dtype=np.int64) for v in zip(*at[lo : lo + PLACES], strict=True))
                around, offs = cut_around(h, before, first[i] + s, first[i] + e, first[i] + c)
                yield b, i, key, c, s, around, offs

    def emit(batches):
        held, size = [], 0

        def merged():
            u, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return u, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for _, parts in itertools.groupby(surroundings(batch), key=lambda part: id(part[0])):
                seen = [np.zeros((2, 0), dtype=np.uint64)]
                for _, i, _, _, _, h, offs in parts:  # a text counts once
                    seen.append(once_each(np.stack([h, np.repeat(i, np.diff(offs)).astype(np.uint64)])))
                held.append(np.unique(once_each(np.concatenate(seen, axis=1))[0], return_counts=True))
                size += len(held[-1][0])
                if size > SEEN:  # what slices have in common goes on once
                    held = [merged()]
                    size = len(held[0][0])
                    if size > SEEN // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["key", "n"])
                        held, size = [], 0
        if held:
            u, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["key", "n"])

    table = bloom_table(joined.mapInArrow(emit, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"))
    kept = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("c", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])

    def keep(batches):
        for batch in batches:
            for b, i, key, c, s, h, offs in surroundings(batch):
                usable, x, first, last = project(h, c - s, offs, in_bloom(table.value, h), least, similar)
                at = np.flatnonzero(usable)
                if len(at):
                    row = i[at]
                    cols = {"h1": b.column(0).to_numpy()[row], "h2": b.column(1).to_numpy()[row], "key": key[at], "x": x[at].view(np.int64), "c": c[at].astype(np.int32), "s": (s + first)[at].astype(np.int32), "e": (s + last)[at].astype(np.int32)}
                    yield to_batch(cols, kept)

    return materialize(joined.mapInArrow(keep, "key long, x long, h1 long, h2 long, c int, s int, e int"), "hot-members")


def _representatives(hot: DataFrame) -> DataFrame:
    """The first and the last member of each class, dealt over blocks of classes: (key, part, side, x, h1, h2, c, s, e).

    Each part holds two blocks, which meet, or one, whose classes all meet.
    """
    whole = F.struct("h1", "h2", "c", "s", "e")
    ends = hot.groupBy("key", "x").agg(F.min(whole).alias("a"), F.max(whole).alias("z"))
    parts = ends.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")
    reps = ends.join(parts, "key").withColumn("block", block).withColumn("r", F.explode(F.array_distinct(F.array("a", "z"))))
    reps = reps.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    part = F.least("block", "other") * F.col("parts") + F.greatest("block", "other")
    return reps.select("key", part.alias("part"), (F.col("block") > F.col("other")).alias("side"), "x", "r.*")


def find_passages(texts: DataFrame, least_words: int = PASSAGE, similar: float = SIMILAR, functions: int = FUNCTIONS) -> DataFrame:
    """(h1, h2, p): word ranges (s, e, later) of texts that near-duplicate a passage of another text.

    ``later`` says that another such text comes first (by hash), so that dropping all later
    ones leaves one. Surroundings that are equal shingle by shingle are one group member.
    A shingle that repeats counts with its number (``number_repeats``). Groups of any size are compared whole: members that look alike to the others are one
    class, of which the first and the last text stand for all, so a passage or line in a
    third of all documents makes a few classes; what a class matches is joined back to its
    members. Shingles are told apart by 32 bits within a group, texts by 128.
    """
    least = least_words - SHINGLE + 1
    run = shared_run(least, similar)

    def all_windows(b):
        h, first, *_ = shingled([zstandard.ZstdDecompressor().decompress(z) for z in b.column(2).to_pylist()])
        for k in range(functions):
            c, _, _ = compact_windows(h, first, k, run, run)
            d = np.searchsorted(first, c, "right") - 1
            s, e = np.maximum(c - REACH, first[d]), np.minimum(c + REACH + 1, first[d + 1])
            wide = (e - s >= least) & ~inside_runs(h, first, c)  # else there is no room for a passage
            yield k, h, first, c[wide], s[wide], e[wide], d[wide]

    def seen(batches):
        for b in slices(batches, "z", 1 << 17):
            for k, h, _, c, *_ in all_windows(b):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(h[c], k).view(np.int64))], names=["key"])

    rows = texts.select("h1", "h2", "z")
    counted = rows.mapInArrow(seen, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    table = bloom_table(counted)
    schema = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("c", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("m", pa.int32())])

    def emit(batches):
        for b in slices(batches, "z", 1 << 18):
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k, h, first, c, s, e, d in all_windows(b):
                key = _keys(h[c], k)
                use = in_bloom(table.value, key)
                c, s, e, d, key = c[use], s[use], e[use], d[use], key[use]
                if not len(c):
                    continue
                pre = np.concatenate(([np.uint64(0)], np.cumsum(mix(h * np.uint64(2) + np.uint64(1)) * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))))
                flat = np.concatenate(([np.uint64(0)], np.cumsum(mix(h * np.uint64(2) + np.uint64(1)))))
                # The sum of hashes times places, counted from the surroundings' start: order counts.
                x = mix((pre[e] - pre[s]) - (flat[e] - flat[s]) * (s.astype(np.uint64) * np.uint64(2)) ^ mix((c - s).astype(np.uint64) * np.uint64(1 << 32) + (e - s).astype(np.uint64)))
                cols = {"key": key.view(np.int64), "x": x.view(np.int64), "h1": h1[d], "h2": h2[d], "c": (c - first[d]).astype(np.int32), "s": (s - first[d]).astype(np.int32), "e": (e - first[d]).astype(np.int32)}
                # Equal surroundings of several texts in the slice are marked here; those of the first text go on.
                order = np.lexsort((cols["h2"], cols["h1"], cols["x"], cols["key"]))
                ordered = {n: v[order] for n, v in cols.items()}
                differs = lambda i, j: (ordered["h1"][i] != ordered["h1"][j]) | (ordered["h2"][i] != ordered["h2"][j])  # noqa: B023, E731
                new = np.concatenate(([True], (ordered["key"][1:] != ordered["key"][:-1]) | (ordered["x"][1:] != ordered["x"][:-1])))
                heads = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                several = differs(np.append(heads[1:], len(order)) - 1, heads)[group]
                on, known = np.flatnonzero(~differs(np.arange(len(order)), heads[group])), np.flatnonzero(several)
                at = np.concatenate((on, known))
                yield to_batch({n: v[at] for n, v in ordered.items()} | {"m": np.concatenate((np.full(len(on), -1), differs(known, heads[group[known]]))).astype(np.int32)}, schema)

    found = rows.mapInArrow(emit, "key long, x long, h1 long, h2 long, c int, s int, e int, m int")
    folded = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("c", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("later", pa.bool_())])
    spread = F.when(F.col("m") >= 0, F.xxhash64("h1", "s")).otherwise(F.lit(0).cast("long"))  # marks need no company
    found = found.repartition(F.col("key"), F.col("x"), spread).sortWithinPartitions((F.col("m") >= 0), "key", "x", "h1", "h2", "s")
    found = materialize(found.mapInArrow(lambda it: fold_equal(it, folded), "key long, h1 long, h2 long, c int, s int, e int, later boolean"), "windows")
    # Equal surroundings in different texts are near duplicates as they are.
    same = found.filter("key is null").select("h1", "h2", "s", (F.col("e") + SHINGLE - 1).alias("e"), "later")
    kinds = found.filter("key is not null")
    t = F.struct("h1", "h2")
    groups = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(t).alias("t0"), F.max(t).alias("t1")).filter("m > 1 and t0 <> t1").select("key", "m")
    member = materialize(kinds.join(groups, "key").select("key", "h1", "h2", "c", "s", "e", (F.col("m") > HOT).alias("hot")), "window-members")
    placed = member.filter("not hot").select("key", F.lit(0).alias("part"), F.lit(False).alias("side"), F.lit(None).cast("long").alias("x"), "h1", "h2", "c", "s", "e")
    hot = member.filter("hot").drop("hot")
    if some := not hot.isEmpty():
        hot = _classes(rows, hot, least, similar)
        placed = placed.unionByName(_representatives(hot))
    places = placed.groupBy("h1", "h2").agg(F.collect_list(F.struct("key", "part", "side", "x", "c", "s", "e")).alias("p"))
    sent = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("side", pa.bool_()), ("x", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("c", pa.int32()), ("s", pa.int32()), ("h", pa.binary())])

    def cut(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 18):
            h, first, *_ = shingled([unzip.decompress(z) for z in b.column(2).to_pylist()])
            before = last_before(h, first)
            at = [(first[i], p["key"], p["part"], p["side"], p["x"], h1, h2, p["c"], p["s"], p["e"]) for i, (h1, h2, places) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)) for p in places]
            for lo in range(0, len(at), PLACES):
                o, *cols, e = zip(*at[lo : lo + PLACES], strict=True)
                o, c, s, e = (np.array(v, dtype=np.int64) for v in (o, cols[-2], cols[-1], e))
                around, offs = cut_around(h, before, o + s, o + e, o + c)
                flat = (around >> np.uint64(32)).astype(np.uint32).tobytes()
                cols.append([flat[4 * lo : 4 * hi] for lo, hi in zip(offs.tolist(), offs[1:].tolist(), strict=False)])
                yield to_batch(dict(zip(sent.names, cols, strict=True)), sent)

    around = rows.join(places, ["h1", "h2"]).select("h1", "h2", "z", "p").mapInArrow(cut, "key long, part int, side boolean, x long, h1 long, h2 long, c int, s int, h binary")
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), *[(n, pa.int64()) for n in ("low1", "low2", "high1", "high2")]]))
    out = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("p", spans)])

    def compare(batches):
        """Groups lie one after another in each partition, sorted; small ones are compared many at a time, others one by one."""

        def link(group):
            ids = np.rec.fromarrays([np.array([g[4] for g in group], dtype=np.int64), np.array([g[5] for g in group], dtype=np.int64)], names="a,b")
            ctx = [np.frombuffer(g[8], dtype=np.uint32) for g in group]
            rows = []
            for items, spans in link_group(ids, ctx, [g[6] - g[7] for g in group], [g[2] for g in group], least, similar, REACH):
                for x in dict.fromkeys(group[i][3] for i in items if group[i][3] is not None):
                    rows.append((group[0][0], x, None, None, [{"s": s, "e": e + SHINGLE - 1, "low1": low.item()[0], "low2": low.item()[1], "high1": high.item()[0], "high2": high.item()[1]} for s, e, low, high in spans]))
                for i in items:
                    if group[i][3] is None:
                        own, c = (group[i][4], group[i][5]), group[i][6]
                        rows.append((None, None, *own, [{"s": c + s, "e": c + e + SHINGLE - 1, "low1": low.item()[0], "low2": low.item()[1], "high1": high.item()[0], "high2": high.item()[1]} for s, e, low, high in spans]))
            return rows

        def link_small(groups):
            """Each pair of different texts; a plain row for each text and stretch."""
            rows = [r for g in groups for r in g]
            flat = np.frombuffer(b"".join(r[8] for r in rows), dtype=np.uint32)
            offs = np.concatenate(([0], np.cumsum([len(r[8]) // 4 for r in rows])))
            h1, h2, c, s = (np.array([r[k] for r in rows], dtype=np.int64) for k in (4, 5, 6, 7))
            at = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
            both = [np.triu_indices(len(g), 1) for g in groups]
            a, b = (np.concatenate([p[k] + o for p, o in zip(both, at, strict=False)]) for k in (0, 1))
            differ = (h1[a] != h1[b]) | (h2[a] != h2[b])
            a, b = a[differ], b[differ]
            m = match_many(flat, offs, c - s, a, b, least, similar, at)
            a, b = a[m[:, 0]], b[m[:, 0]]  # rows of a group ascend by text: b is the later one
            who, low = np.concatenate((a, b)), np.concatenate((b, a))
            start, end = np.concatenate((m[:, 1], m[:, 3])) + s[who], np.concatenate((m[:, 2], m[:, 4])) + s[who] + SHINGLE - 1
            later = np.repeat([False, True], [len(a), len(b)])
            by = np.stack([h1[who], h2[who], start, end, later])
            by = by[:, np.lexsort(by[::-1])]
            by = by[:, np.concatenate((np.ones(min(1, by.shape[1]), dtype=bool), (by[:, 1:] != by[:, :-1]).any(axis=0)))]
            one = lambda h1, h2, s, e, later: {"s": s, "e": e, "low1": h1 if not later else -(1 << 63), "low2": h2 + 1 if not later else 0, "high1": (1 << 63) - 1, "high2": 0}
            return [(None, None, *r[:2], [one(*r)]) for r in zip(*by.tolist(), strict=True)]

        held, size, now = [], 0, None
        group: list = []

        def done(last=False):
            nonlocal held, size
            if len(group) > 1:
                if len(group) <= FEW and all(g[3] is None and not g[2] for g in group):
                    held.append(list(group))
                    size += len(group) ** 2
                else:
                    yield from link(group)
            if held and (last or size > 20_000):
                small, held, size = held, [], 0
                yield from link_small(small)

        rows = []
        for b in batches:
            for row in zip(*(v.to_pylist() for v in b.columns), strict=True):
                if row[:2] != now:
                    rows += done()
                    now, group = row[:2], []
                group.append(row)
            if rows:
                yield to_batch(dict(zip(out.names, zip(*rows, strict=True), strict=True)), out)
                rows = []
        if rows := list(done(True)):
            yield to_batch(dict(zip(out.names, zip(*rows, strict=True), strict=True)), out)

    linked = around.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", "h1", "h2", "c")
    linked = linked.mapInArrow(compare, "key long, x long, h1 long, h2 long, p array<struct<s:int,e:int,low1:long,low2:long,high1:long,high2:long>>")
    t = F.struct(F.col("h1").alias("low1"), F.col("h2").alias("low2"))
    ends = lambda x: (F.struct(x["low1"].alias("low1"), x["low2"].alias("low2")), F.struct(x["high1"].alias("low1"), x["high2"].alias("low2")))

    def own(p, c):
        """What a member of a class is marked with: all that another text matches; later if one comes first."""
        some = F.filter(p, lambda x: (ends(x)[0] != t) | (ends(x)[1] != t))
        return F.transform(some, lambda x: F.struct((x["s"] + c).alias("s"), (x["e"] + c).alias("e"), (ends(x)[0] < t).alias("later"))).alias("p")

    if some:
        linked = materialize(linked, "passage-links")
        of = linked.filter("key is not null").select("key", "x", "p")
        linked = linked.filter("key is null").select("h1", "h2", own(F.col("p"), F.lit(0))).unionByName(hot.join(of, ["key", "x"]).select("h1", "h2", own(F.col("p"), F.col("c"))))
    else:
        linked = linked.select("h1", "h2", own(F.col("p"), F.lit(0)))
    same = same.select("h1", "h2", F.array(F.struct("s", "e", "later")).alias("p"))
    return same.unionByName(linked)


def near_duplicate_passages(docs: DataFrame, least_words: int = PASSAGE, similar: float = SIMILAR) -> DataFrame:
    """One row per document with a passage that near-duplicates one of another document.

    doc_id, n_words, n_spans, n_repeat_words, spans ("start:end" word ranges, end
    exclusive, comma-joined) and removed (the ranges that dropping later copies takes;
    of equal texts all but the least doc_id's are later ones, and rows that repeat are
    documents of their own). Null and short texts have none; clean documents no row.
    """
    docs = text_docs(docs)
    marked = _marked(docs, least_words, similar)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_spans", pa.int64()), ("n_repeat_words", pa.int64()), ("spans", pa.string()), ("removed", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, words_, spans, removed in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = lambda xs: ",".join(f"{s}:{e}" for s, e in xs)
                s, r = _pairs(spans), _pairs(removed)
                rows.append((doc_id, words_, len(s), sum(e - a for a, e in s), text(s), text(r)))
            if rows:
                yield to_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return marked.filter(F.size("spans") > 0).select("doc_id", "n_words", "spans", "removed").mapInArrow(run, "doc_id long, n_words long, n_spans long, n_repeat_words long, spans string, removed string")


def _pairs(flat) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _marked(docs: DataFrame, least_words: int, similar: float) -> DataFrame:
    """(doc_id, h1, h2, n_words, spans, removed) of all documents; ranges flat, in words."""
    texts = distinct_texts(docs)
    found = find_passages(texts, least_words, similar).groupBy("h1", "h2").agg(F.flatten(F.collect_list("p")).alias("p"))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("removed", pa.list_(pa.int32())), ("n", pa.int64()), ("low", pa.int64())])

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 20):
            rows = []
            for h1, h2, z, n, low, p in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                size = len(unzip.decompress(z).split())
                whole = [(0, size)] if n > 1 and size >= least_words else []
                spans = merge_spans([(x["s"], x["e"]) for x in p or []] + whole)
                gone = merge_spans([(x["s"], x["e"]) for x in p or [] if x["later"]])
                rows.append((h1, h2, size, [v for s in spans for v in s], [v for s in gone for v in s], n, low))
            yield to_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    done = texts.select("h1", "h2", "z", "n", "low").join(found, ["h1", "h2"], "left").mapInArrow(run, "h1 long, h2 long, n_words long, spans array<int>, removed array<int>, n long, low long")
    return docs.select("doc_id", *text_key()).join(done, ["h1", "h2"]).withColumn("removed", _of_copies(least_words)).drop("n", "low")


def _of_copies(least_words: int):
    """Copies of a text after its first document lose all of it."""
    copy = (F.col("n") > 1) & (F.col("n_words") >= least_words) & ~F.coalesce(F.col("doc_id") == F.col("low"), F.lit(False))
    return F.when(copy, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.col("removed"))


def drop_words(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the ranges and the white space after each."""
    buf = np.frombuffer(text, dtype=np.uint8)
    s, e, _ = words(buf, np.array([0, len(buf)]))
    keep, at = [], 0
    for a, b in ranges:
        keep.append(text[at : s[a]])
        at = int(s[b]) if b < len(s) else len(text)
    return b"".join([*keep, text[at:]])


def drop_repeats(docs: DataFrame, least_words: int = PASSAGE, similar: float = SIMILAR) -> DataFrame:
    """``docs`` without the later copies of near-duplicate passages in ``text``; all rows and columns stay.

    One copy of each passage is kept. n_chars, if there, follows the text. Null texts
    stay null. Rows with a clean text are not changed.
    """
    plain, names = text_docs(docs), docs.columns
    marks = _marked(plain, least_words, similar).filter(F.size("removed") > 0).groupBy("doc_id", "h1", "h2").agg(F.first("removed").alias("removed"))
    doc, h1, h2, gone = free_names(names, "doc", "h1", "h2", "gone")
    marks = marks.toDF(doc, h1, h2, gone)
    same = docs["doc_id"].cast("long").eqNullSafe(marks[doc])
    for key, h in zip(text_key(F.coalesce(docs["text"], F.lit(""))), (h1, h2), strict=True):
        same &= key == marks[h]
    joined = docs.join(marks, same, "left").select(*[docs[f"`{c}`"] for c in names], gone)

    def run(batches):
        for batch in batches:
            for b in slices([batch]):
                i = b.schema.get_field_index("text")
                gone = b.column(b.num_columns - 1).to_pylist()
                new = [t if not g else drop_words(t.encode(), _pairs(g)).decode() for t, g in zip(b.column(i).to_pylist(), gone, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(k).type) if k == i else b.column(k) for k in range(b.num_columns - 1)], names=names)

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
