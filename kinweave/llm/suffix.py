"""Exact repeated substrings through run-length Burrows-Wheeler indexes of repetitive text.

Content-sampled anchors bring together all places that may share a long string: the
least-hashed short gram of every window is an anchor, so two copies of a string hold
the same anchor at the same place. Grams that are anchors very often (of a common line or
passage) are chosen only where a window has no other, so what surrounds them is common
text alone and equal wherever it stands. Only surroundings of anchors that occur twice are
indexed, shard by shard: the shard's text is run-compressed by its Burrows-Wheeler
transform, longest matches are known at the runs' ends and streamed to all other
positions, and matches of the asked length are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_table, column_bytes, in_bloom, materialize, slices, text_docs, text_key, to_batch
from .kernels import join_texts, mix, prefix, shingle_hashes, span_hash, spans_from_points, words

#: Bytes of a gram; bits of the hash by which grams are compared in a window.
GRAM, RANK = 64, 36
#: Least words of a passage; words of a gram within one.
PASSAGE, SHINGLE = 50, 8
#: Compressed bytes of text that are worked on at a time, so that the arrays stay in the processor's caches.
CACHED = 1 << 17
#: Pairs of suffixes that are compared at a time.
PAIRS = 1 << 16
#: Grams that are anchors more often than this are chosen last.
OFTEN = 256
#: Anchors with more different surroundings are settled string by string, by hash, outside the indexes.
HOT = 2048


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w successive values, by minima from both sides of blocks of w."""
    n = len(values)
    pad = -n % w
    v = np.concatenate((values, np.full(pad, values.dtype.type(np.iinfo(values.dtype).max)))).reshape(-1, w)
    head = np.minimum.accumulate(v, axis=1).ravel()
    tail = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchors(buf: np.ndarray, pre: np.ndarray, offs: np.ndarray, length: int, gram: int = GRAM, often=None):
    """(anchor, start, end, moved): in each window of ``length`` bytes of one text the first least-hashed gram, and what the windows that choose it span.

    Grams that ``often`` (hashes -> bool) holds come after all others; ``moved`` is where a window looked past one. The choice depends on a
    window's bytes alone, so equal windows have equal anchors.
    """
    n = len(buf) - gram + 1
    w = length - gram + 1
    if n < w:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, dtype=bool))
    at = np.arange(n)
    h = span_hash(pre, at, at + gram)
    bits = np.uint64(max(64 - RANK, n.bit_length()))  # more where a slice has more bytes than usual
    key = (h >> (bits + np.uint64(1))) << bits | at.astype(np.uint64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    windows = n - w + 1
    whole = doc[:windows] == doc[length - 1 : length - 1 + windows]
    whole &= np.arange(windows) + length <= offs[doc[:windows] + 1] - 1  # the separator is no part of the text
    begin = np.flatnonzero(whole)
    place = lambda key, at: (window_minima(key, w)[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    low = place(key, begin)
    moved = np.zeros(len(low), dtype=bool)
    if often is not None and len(low):
        unique, back = np.unique(low, return_inverse=True)
        doubt = np.flatnonzero(often(h[unique])[back])
        if len(doubt):
            edge = np.zeros(n + 1, dtype=np.int32)
            edge[begin[doubt]] += 1
            edge[begin[doubt] + w] -= 1
            look = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            again = key[look]
            again[often(h[look])] |= np.uint64(1) << np.uint64(63)
            low[doubt] = place(again, np.searchsorted(look, begin[doubt]))
            moved[doubt] = True
    head = np.flatnonzero(np.diff(low, prepend=-1))  # the windows that choose an anchor lie side by side
    return low[head], begin[head], begin[np.append(head[1:], len(low)) - 1] + length, np.logical_or.reduceat(moved, head) if len(head) else moved


def word_anchors(buf: np.ndarray, pre: np.ndarray, offs: np.ndarray, least: int, gram: int = SHINGLE, spans: bool = True):
    """(hash, text, start, end, x1, x2): ``anchors`` by words, of every ``least`` words in a row of one text.

    Starts and ends count words; x1 and x2 are hashes of the words that an anchor's windows span
    and of where it lies among them (zero without ``spans``). White space between words does not count.
    """
    s, e, doc = words(buf, offs)
    own = span_hash(pre, s, e)
    h, at = shingle_hashes(own, doc, gram)
    w = least - gram + 1
    if len(h) < w:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2)
    bits = np.uint64(max(64 - RANK, len(h).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low = window_minima((h >> bits) << bits | np.arange(len(h), dtype=np.uint64), w)
    begin = np.flatnonzero(doc[at[: len(low)]] == doc[at[w - 1 :]])
    low = (low[begin] & mask).astype(np.int64)
    head = np.flatnonzero(np.diff(low, prepend=-1))
    centre, a, b = at[low[head]], at[begin[head]], at[begin[np.append(head[1:], len(low)) - 1]] + least
    x1, x2 = (run_hash(own, k, a, b) if spans else np.zeros(len(a), np.uint64) for k in (1, 2))
    x1 = mix(x1 + (centre - a).astype(np.uint64))
    base = np.searchsorted(doc, np.arange(len(offs)))[doc[centre]]
    return mix(h[low[head]] ^ np.uint64(0x5BF03635F0B7A54D)), doc[centre], a - base, b - base, x1, x2


def run_hash(own: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the runs [a, b) of word hashes, by ``kind``."""
    return span_hash(prefix(mix(own + np.uint64(kind))), a, b)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes of ``text`` in order, by doubling; settled suffixes are not sorted again."""
    n = len(text)
    lead = np.zeros(n + 8, dtype=np.uint64)
    lead[:n] = text + np.uint64(1)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(7):  # nine bits a symbol
        key = key << np.uint64(9) | lead[i : i + n]
    order = np.argsort(key).astype(np.int32)  # n is far below 2**31
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    del lead, key
    group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = group
    k = 7
    tied = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    del new
    while len(tied):
        who = order[tied]
        nxt = who + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], np.int32(-1))
        g = group[tied]
        by = np.argsort(g.astype(np.int64) * (n + 1) + second)
        who, g, second = who[by], g[by], second[by]
        order[tied] = who
        start = np.concatenate(([True], (g[1:] != g[:-1]) | (second[1:] != second[:-1])))
        group[tied] = np.maximum.accumulate(np.where(start, tied, np.int32(0)))
        rank[who] = group[tied]
        alone = start & np.append(start[1:], True)
        tied = tied[~alone]
        k *= 2
    return order


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text of symbols 0..256 with samples at run ends.

    Where the transform continues a run, the longest match with the neighbouring
    suffix is one shorter than at the position before in the text; so matches need
    be measured only at the runs' ends (``sampled``), and all others are streamed.
    """

    def __init__(self, text: np.ndarray):
        self.text = text
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        bwt[order == 0] = 65535
        head = np.concatenate(([True], bwt[1:] != bwt[:-1]))
        first = np.flatnonzero(head)
        self.runs = np.stack([bwt[first].astype(np.int64), np.diff(np.append(first, n))])
        self.n = n
        above = first[first > 0]  # the suffix before a run's head, measured against it
        heads, lasts = order[above], order[above - 1]
        del order, bwt, head, first, above
        # The suffix after a run's last one is the same boundary seen from its other side, with the same match.
        match = self._common(heads, lasts)
        self.head_at, self.head_match = self._sorted(heads, match)
        self.last_at, self.last_match = self._sorted(lasts, match)

    def _sorted(self, at: np.ndarray, match: np.ndarray):
        by = np.argsort(at)
        return at[by], match[by]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffix pairs, some at a time."""
        pre, out = prefix(self.text.astype(np.uint64)), np.zeros(len(a), dtype=np.int32)
        for lo in range(0, len(a), PAIRS):
            out[lo : lo + PAIRS] = self._gallop(pre, a[lo : lo + PAIRS], b[lo : lo + PAIRS])
        return out

    def _gallop(self, pre: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_common`` by blocks that double while the suffixes agree."""
        n = self.n
        out = np.zeros(len(a), dtype=np.int64)
        room = n - np.maximum(a, b)
        step = np.full(len(a), 64, dtype=np.int64)
        live = np.arange(len(a))
        while len(live):  # gallop
            k = np.minimum(step[live], room[live] - out[live])
            x, y = a[live] + out[live], b[live] + out[live]
            same = (span_hash(pre, x, x + k) == span_hash(pre, y, y + k)) & (k > 0)
            out[live[same]] += k[same]
            step[live[same]] *= 2
            live = live[same]
        live = np.flatnonzero(out < room)
        size = step[live]
        while len(live):  # close in on the first difference
            size = size // 2
            k = np.minimum(size, room[live] - out[live])
            x, y = a[live] + out[live], b[live] + out[live]
            same = span_hash(pre, x, x + k) == span_hash(pre, y, y + k)
            out[live[same]] += k[same]
            more = size > 1
            live, size = live[more], size[more]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest string starting there that starts elsewhere in the text too."""
        best = np.zeros(self.n, dtype=np.int32)
        pos = np.arange(self.n, dtype=np.int32)
        for at, match in ((self.head_at, self.head_match), (self.last_at, self.last_match)):
            if len(at):
                i = np.searchsorted(at, pos, "right") - 1
                ok = i >= 0
                best[ok] = np.maximum(best[ok], match[i[ok]] - (pos[ok] - at[i[ok]]))
        return best


def repeated_positions(pieces: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece the (starts, ends) covered by strings of ``length`` that start elsewhere in the pieces."""
    text = np.concatenate([np.append(np.frombuffer(p, dtype=np.uint8).astype(np.uint16), np.uint16(256)) for p in pieces])
    sizes = np.array([len(p) for p in pieces])
    offs = np.concatenate(([0], np.cumsum(sizes + 1)))
    best = RunLengthIndex(text).matching_statistics()
    room = np.repeat(offs[1:] - 1, sizes + 1) - np.arange(len(text))
    hit = np.flatnonzero((np.minimum(best, room)) >= length)
    del best, room
    step = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + length, -1)
    s, e = spans_from_points(np.cumsum(step[:-1]) > 0)
    cuts = np.searchsorted(s, offs)
    return [(s[a:b] - o, e[a:b] - o) for a, b, o in zip(cuts, cuts[1:], offs, strict=False)]


def fold_same(batches):
    """Of rows sorted by (a, x1, x2): the first of each group, and, with a null ``a``, every row of groups of two or more.

    Rows that are marks already pass. Nothing but the last group's key and first row is carried from batch to batch.
    """
    schema = pa.schema([("a", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
    last, first, shown = None, None, True

    def rows(b, at, named):
        return to_batch({"a": b["a"][at] if named else pa.nulls(len(at), pa.int64()), **{c: b[c][at] for c in ("h1", "h2", "s", "e")}}, schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        b = {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)}
        if b["mark"].any():
            yield rows(b, np.flatnonzero(b["mark"]), False)
            b = {c: v[~b["mark"]] for c, v in b.items()}
            if not len(b["a"]):
                continue
        key = np.stack([b["a"], b["x1"], b["x2"]])
        n = key.shape[1]
        new = np.concatenate(([last is None or bool((key[:, 0] != last).any())], (key[:, 1:] != key[:, :-1]).any(axis=0)))
        heads = np.flatnonzero(new)
        if not new[0] and not shown:  # the open group has a second row
            yield rows(first, np.arange(1), False)
            shown = True
        group = np.cumsum(new) - 1
        size = np.diff(np.append(heads, n))
        at = np.flatnonzero((group < 0) | (size[group] > 1)) if len(heads) else np.arange(n)
        if len(heads):
            yield rows(b, heads, True)
            first, shown = {c: b[c][heads[-1:]] for c in b}, bool(size[-1] > 1)
        if len(at):
            yield rows(b, at, False)
        last = key[:, -1]


def fold_slice(cols: dict) -> dict:
    """Of a slice's surroundings (a, x1, x2, ...) one of each kind, and, with ``mark``, every one of kinds that are there twice."""
    order = np.lexsort((cols["x2"], cols["x1"], cols["a"]))
    new = np.concatenate(([True], (np.diff(np.stack([cols[c].view(np.int64) for c in ("a", "x1", "x2")])[:, order], axis=1) != 0).any(axis=0)))[: len(order)]
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    heads, many = order[new], order[np.repeat(sizes > 1, sizes)]
    at = np.concatenate((heads, many))
    return {c: v.view(np.int64)[at] for c, v in cols.items()} | {"mark": np.repeat([False, True], [len(heads), len(many)])}


def folded(found: DataFrame) -> DataFrame:
    """``fold_same`` of all surroundings of one kind; marks are dealt evenly, they need no company."""
    spread = F.when(F.col("mark"), F.xxhash64("h1", "s")).otherwise(F.lit(0).cast("long"))
    found = found.repartition(F.col("a"), F.col("x1"), F.col("x2"), spread).sortWithinPartitions("mark", "a", "x1", "x2", "h1", "h2", "s")
    return found.mapInArrow(fold_same, "a long, h1 long, h2 long, s long, e long")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n, z): every distinct text once, compressed, with its number of documents."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("z", pa.binary())])

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            yield to_batch({"h1": b.column(0), "h2": b.column(1), "z": [z.compress(t) for t in column_bytes(b, "text")]}, schema)

    rows = docs.select(*text_key(), "text").mapInArrow(squeeze, "h1 long, h2 long, z binary")
    return materialize(rows.groupBy("h1", "h2").agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("n")), "texts")


def anchor_counts(texts: DataFrame, length: int, least: int = PASSAGE) -> DataFrame:
    """(key, n): how often a gram is an anchor, of bytes or of words, where that is more than once."""

    def count(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", CACHED):
            buf, offs = join_texts([unzip.decompress(z) for z in b.column(0).to_pylist()])
            pre = prefix(buf)
            at = anchors(buf, pre, offs, length)[0]
            keys = np.concatenate((span_hash(pre, at, at + GRAM), word_anchors(buf, pre, offs, least, spans=False)[0]))
            a, n = np.unique(keys.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n)], names=["key", "n"])

    counted = texts.select("z").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return materialize(counted.filter("n > 1"), "anchor-counts")


def mark_repeats(texts: DataFrame, length: int = 400, shard_bytes: int = 2 << 20, counted: DataFrame | None = None) -> DataFrame:
    """(h1, h2, s, e): stretches of distinct texts covered by strings that also occur at another place.

    ``texts`` as from ``distinct_texts``. An anchor's surroundings are the bytes of the
    windows that choose it. Surroundings that are equal byte for byte
    are repeats as they are and one of them stands for all in the index, so a passage
    in a third of all documents costs one entry; the others go to shards by anchor. An
    anchor that still has over HOT of them (common lines in ever other order) would fill a
    shard by itself: there every string of ``length`` is matched by its hash, evenly dealt.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("mark", pa.bool_())])

    counted = anchor_counts(texts, length) if counted is None else counted
    often, twice = bloom_table(counted.filter(F.col("n") > OFTEN)), bloom_table(counted)

    def around(b, unzip):
        """(h1, h2, anchor, hashes of the surroundings, start, end) of a slice's anchors."""
        buf, offs = join_texts([unzip.decompress(z) for z in b.column(2).to_pylist()])
        pre = prefix(buf)
        at, s, e, moved = anchors(buf, pre, offs, length, often=lambda h: in_bloom(often.value, h))
        # A string that is there twice has its anchor twice; only anchors chosen past a common gram were not counted.
        some = np.flatnonzero(moved | in_bloom(twice.value, span_hash(pre, at, at + GRAM)))
        at, s, e = at[some], s[some], e[some]
        d = np.searchsorted(offs, at, "right") - 1
        x = span_hash(pre, s, e)
        cut = np.stack([at - s, e - at]).astype(np.uint64)  # where the anchor lies counts too
        x1, x2 = mix(x + cut[0] * np.uint64(1 << 32) + cut[1]), mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)) + span_hash(pre, at, e)
        return b.column(0).to_numpy()[d], b.column(1).to_numpy()[d], span_hash(pre, at, at + GRAM), x1, x2, s - offs[d], e - offs[d]

    def sample(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 20):
            parts = [around(x, unzip) for x in slices([b], "z", CACHED)]
            h1, h2, a, x1, x2, s, e = (np.concatenate(v) for v in zip(*parts, strict=True))
            # Equal surroundings within the slice are known repeats: they are marked here, and one goes on.
            yield to_batch(fold_slice({"h1": h1, "h2": h2, "a": a, "x1": x1, "x2": x2, "s": s, "e": e}), schema)

    found = texts.select("h1", "h2", "z").mapInArrow(sample, "h1 long, h2 long, a long, x1 long, x2 long, s long, e long, mark boolean")
    found = materialize(folded(found), "anchors")
    same = found.filter("a is null").filter(F.col("e") - F.col("s") >= length).select("h1", "h2", "s", "e")
    reps = found.filter("a is not null")
    several = reps.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chosen = materialize(reps.join(several, "a").select("a", "h1", "h2", "s", "e", (F.col("n") > HOT).alias("hot")), "anchor-reps")
    total = chosen.filter("not hot").agg(F.sum(F.col("e") - F.col("s"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    shard = F.when(F.col("hot"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("a"), F.lit(shards)))
    places = chosen.groupBy("h1", "h2").agg(F.collect_list(F.struct(shard.alias("k"), "s", "e")).alias("p"))
    cut_schema = pa.schema([("k", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("s", pa.int64()), ("text", pa.binary()), ("a", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64())])

    def strings(h1, h2, text, spans):
        """Every string of ``length`` within the spans, by the hashes of the whole and of both halves."""
        pre, half = prefix(np.frombuffer(text, dtype=np.uint8)), length // 2
        at = np.unique(np.concatenate([np.arange(s, e - length + 1) for s, e in spans] or [np.zeros(0, np.int64)]))
        x = [span_hash(pre, at, at + length), span_hash(pre, at, at + half), span_hash(pre, at + half, at + length)]
        n = len(at)
        return to_batch({"k": np.full(n, -1), "h1": np.full(n, h1), "h2": np.full(n, h2), "s": at, "text": pa.nulls(n, pa.binary()), **{c: v.view(np.int64) for c, v in zip(("a", "x1", "x2"), x, strict=True)}}, cut_schema)

    def cut(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 20):
            rows, strung = [], []
            for h1, h2, z, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = unzip.decompress(z)
                last = None
                if hot := [(x["s"], x["e"]) for x in p if x["k"] < 0]:
                    strung.append(strings(h1, h2, text, hot))
                for k, s, e in sorted((x["k"], x["s"], x["e"]) for x in p if x["k"] >= 0):
                    if last and last[0] == k and s <= last[2]:
                        last[2] = max(last[2], e)
                        continue
                    if last:
                        rows.append((last[0], h1, h2, last[1], text[last[1] : last[2]]))
                    last = [k, s, e]
                if last:
                    rows.append((last[0], h1, h2, last[1], text[last[1] : last[2]]))
            if strung:
                yield pa.concat_batches(strung)
            if rows:
                none = pa.nulls(len(rows), pa.int64())
                yield to_batch(dict(zip(cut_schema.names, zip(*rows, strict=True))) | {"a": none, "x1": none, "x2": none}, cut_schema)

    pieces = texts.select("h1", "h2", "z").join(places, ["h1", "h2"]).mapInArrow(cut, "k long, h1 long, h2 long, s long, text binary, a long, x1 long, x2 long")
    pieces = materialize(pieces, "repeat-pieces")
    strung = pieces.filter("k < 0").select("h1", "h2", "a", "x1", "x2", "s", (F.col("s") + length).alias("e"), F.lit(False).alias("mark"))
    strung = folded(strung).filter("a is null").select("h1", "h2", "s", "e")
    out_schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def search(table):
        h1, h2, s0 = (table.column(c).to_numpy() for c in ("h1", "h2", "s"))
        cols = {c: [] for c in out_schema.names}
        for i, (s, e) in enumerate(repeated_positions(table.column("text").to_pylist(), length)):
            cols["h1"] += [h1[i]] * len(s)
            cols["h2"] += [h2[i]] * len(s)
            cols["s"] += (s + s0[i]).tolist()
            cols["e"] += (e + s0[i]).tolist()
        return pa.table({c: pa.array(cols[c], pa.int64()) for c in cols}, schema=out_schema)

    indexed = pieces.filter("k >= 0").select("k", "h1", "h2", "s", "text").groupBy("k").applyInArrow(search, "h1 long, h2 long, s long, e long")
    return materialize(same.unionByName(indexed).unionByName(strung), "repeats")


def mark_passages(texts: DataFrame, least: int, counted: DataFrame) -> DataFrame:
    """(h1, h2, s, e): words of distinct texts in runs of ``least`` words that also stand at another place.

    Anchors that are there twice (``counted``) bring equal runs together; what surrounds them
    is a repeat as it is where it is equal, and otherwise each run is matched by its hashes.
    """
    twice = bloom_table(counted)
    schema = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "a", "x1", "x2", "s", "e")] + [("mark", pa.bool_())])
    types = "h1 long, h2 long, a long, x1 long, x2 long, s long, e long, mark boolean"

    def sample(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 20):
            parts = []
            for x in slices([b], "z", CACHED):
                buf, offs = join_texts([unzip.decompress(z) for z in x.column(2).to_pylist()])
                a, d, s, e, x1, x2 = word_anchors(buf, prefix(buf), offs, least)
                some = np.flatnonzero(in_bloom(twice.value, a))
                parts.append([x.column(0).to_numpy()[d[some]], x.column(1).to_numpy()[d[some]], *(v[some] for v in (a, x1, x2, s, e))])
            yield to_batch(fold_slice(dict(zip(schema.names, (np.concatenate(v) for v in zip(*parts, strict=True)), strict=False))), schema)

    found = materialize(folded(texts.select("h1", "h2", "z").mapInArrow(sample, types)), "word-anchors")
    same = found.filter("a is null").select("h1", "h2", "s", "e")
    reps = found.filter("a is not null")
    several = reps.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    places = reps.join(several, "a").groupBy("h1", "h2").agg(F.collect_list(F.struct("s", "e")).alias("p"))

    def runs(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 18):
            buf, offs = join_texts([unzip.decompress(z) for z in b.column(2).to_pylist()])
            begin, end, doc = words(buf, offs)
            own, first = span_hash(prefix(buf), begin, end), np.searchsorted(doc, np.arange(len(offs)))
            span = [(d, x["s"], x["e"] - least + 1) for d, p in enumerate(b.column(3).to_pylist()) for x in p]
            at = np.concatenate([np.arange(s, e) + first[d] for d, s, e in span])  # a run has one anchor, so it is there once
            d = doc[at]
            cols = {"h1": b.column(0).to_numpy()[d], "h2": b.column(1).to_numpy()[d], "s": at - first[d], "e": at - first[d] + least}
            cols |= {c: run_hash(own, k, at, at + least) for k, c in enumerate(("a", "x1", "x2"))}
            yield to_batch(fold_slice(cols), schema)

    strung = texts.select("h1", "h2", "z").join(places, ["h1", "h2"]).select("h1", "h2", "z", "p").mapInArrow(runs, types)
    return same.unionByName(folded(strung).filter("a is null").select("h1", "h2", "s", "e"))


def remove_repeats(docs: DataFrame, length: int = 400, least: int = PASSAGE) -> DataFrame:
    """Per document what is left without bytes covered by a ``length``-byte string that also starts elsewhere.

    n_repeat_words counts the words in runs of ``least`` words that also stand elsewhere, whatever
    their bytes: passages that are too short to be removed show there alone.
    Null text is empty; matches never cross documents; rows that repeat, with equal ids
    or not, are each a document, so all their text goes if it is long enough.
    """
    base = text_docs(docs)
    texts = distinct_texts(base)
    counted = anchor_counts(texts, length, least)
    marks = mark_repeats(texts, length, counted=counted).withColumn("words", F.lit(False)).unionByName(mark_passages(texts, least, counted).withColumn("words", F.lit(True)))
    marks = marks.groupBy("h1", "h2").agg(F.collect_list(F.struct("s", "e", "words")).alias("p"))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeat_words", pa.int64())])

    def cut(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 20):
            rows = []
            for h1, h2, z, n, p in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                text = unzip.decompress(z)
                spans = merge_spans([(0, len(text))] if n > 1 and len(text) >= length else [(x["s"], x["e"]) for x in p or [] if not x["words"]])
                kept = drop_spans(text, spans)
                again = size if n > 1 and (size := len(text.split())) >= least else sum(e - s for s, e in merge_spans([(x["s"], x["e"]) for x in p or [] if x["words"]]))
                rows.append((h1, h2, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), again))
            yield to_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    done = texts.select("h1", "h2", "z", "n").join(marks, ["h1", "h2"], "left").mapInArrow(cut, "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeat_words long")
    return base.select("doc_id", *text_key()).join(done, ["h1", "h2"]).drop("h1", "h2")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def drop_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])
