"""Language-model scores: a smoothed word unigram from the corpus, and the marginal
probability of each text over all its subword segmentations.

The subword vocabulary is an existing sentencepiece file, never trained here. A file
of merge-ordered pieces has the rank as its score, so a piece's probability is
Zipf-Mandelbrot in that rank; a file of log probabilities is used as it is. Each
word's probability sums all its segmentations by a forward recursion in log space;
every byte may also be spelt by its byte piece, so no text has probability zero.

What is learnt joins the lattice as one more arc over each whole word that training
texts have: with N training tokens of V kinds it weighs count / (N + V), and the
subword segmentations together V / (N + V). So frequent words have nearly their own
share, and unseen ones that of their pieces: in ``score`` the whole-word arc decides
most of a word that training texts have, the segmentations all of one they have not.
``lattice_score`` is the segmentations' part alone, with no arc learnt from the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, materialize, slices, text_docs, to_batch
from .kernels import LOWER, join_texts, prefix, span_hash, words

#: The end token's hash (words never have hash 0: see ``_hashes``).
END = 0
_PRESENCE = 22


class Vocabulary:
    """Pieces by hash with log10 probabilities; a word begins with the byte 32."""

    def __init__(self, path: str):
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        score = np.array([sp.get_score(i) for i in range(n)])
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        ranked = bool(len(normal)) and np.array_equal(score[normal], np.round(score[normal])) and np.ptp(score[normal]) >= len(normal) - 1
        spelt = [i for i in range(n) if sp.is_byte(i)]
        if ranked:  # bytes come after all the pieces
            w = 1.0 / (score[normal].max() - score[normal] + 2.7)
            rare = np.full(256, 1.0 / (len(normal) + 2.7))
        else:
            w = np.exp(score[normal])
            rare = np.full(256, w.min() * 0.1)
        end = rare[0]
        total = w.sum() + rare.sum() + end
        self.byte = float(np.log10(rare[0] / total))
        self.end = float(np.log10(end / total))
        pieces = [sp.id_to_piece(i).replace("▁", " ").encode() for i in normal]
        assert len(spelt) in (0, 256)
        buf, offs = join_texts(pieces)
        h = span_hash(prefix(buf), offs[:-1], offs[1:] - 1)
        order = np.argsort(h)
        self.hashes, self.logp = h[order], np.log10(w / total)[order]
        self.longest = max(map(len, pieces), default=1)
        self.present = np.zeros(1 << _PRESENCE, dtype=bool)
        self.present[(h >> np.uint64(64 - _PRESENCE)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """log10 probability of the piece with each hash, -inf if there is none."""
        out = np.full(len(h), -np.inf)
        at = np.flatnonzero(self.present[(h >> np.uint64(64 - _PRESENCE)).astype(np.int64)])
        if len(at):
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            ok = self.hashes[i] == h[at]
            out[at[ok]] = self.logp[i[ok]]
        return out

    def marginals(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of each word's probability over all segmentations.

        ``buf[start - 1]`` must be white space; it is the word's opening mark. Words of
        like length run together, one column of the forward table at a time.
        """
        mem = np.where((starts > 0), starts - 1, starts)
        marked = buf.copy()
        marked[mem] = 32
        pre = prefix(marked)
        out = np.empty(len(starts))
        size = ends - mem
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            n = int(size[order[lo]])
            room = max(1, (1 << 21) // (n + 1))
            hi = min(int(np.searchsorted(size[order], n, "right")), lo + room)
            who = order[lo:hi]
            out[who] = self._forward(pre, mem[who], n)
            lo = hi
        return out

    def _forward(self, pre: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        keep = min(n, self.longest) + 1
        ring = np.full((keep, len(at)), -np.inf)  # the last columns of the table
        ring[0] = 0.0
        for j in range(1, n + 1):
            best = ring[(j - 1) % keep] + self.byte
            for k in range(1, min(j, self.longest) + 1):
                p = self.lookup(span_hash(pre, at + (j - k), at + j))
                if (hit := p > -np.inf).any():
                    x = ring[(j - k) % keep][hit] + p[hit]
                    y = best[hit]
                    top = np.maximum(x, y)
                    best[hit] = top + np.log10(10.0 ** (x - top) + 10.0 ** (y - top))
            ring[j % keep] = best
        return ring[n % keep]


_VOCABULARY: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and worker process."""
    if path not in _VOCABULARY:
        _VOCABULARY[path] = Vocabulary(path)
    return _VOCABULARY[path]


def _hashes(texts: list[bytes]):
    """Lowered buffer (a space first), word starts, ends, text index and hashes (never END)."""
    buf, offs = join_texts([b"", *texts])
    buf = LOWER[buf]
    s, e, doc = words(buf, offs)
    h = span_hash(prefix(buf), s, e)
    return buf, s, e, doc - 1, np.where(h == END, np.uint64(1), h)


def word_counts(docs: DataFrame, held_out) -> DataFrame:
    """(w, c): how often each word (as a 64-bit hash, the end token as 0) occurs in training documents."""
    schema = pa.schema([("w", pa.int64()), ("c", pa.int64())])

    def run(batches):
        held: list[tuple] = []

        def fold():
            w = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            u, inv = np.unique(w, return_inverse=True)
            held[:] = [(u, np.bincount(inv, c, len(u)).astype(np.int64))]

        for b in slices(batches):
            held.append(np.unique(_hashes(column_bytes(b, "text"))[4], return_counts=True))
            held.append((np.array([END], dtype=np.uint64), np.array([b.num_rows])))
            if len(held) >= 16:
                fold()
                if len(held[0][0]) > 1 << 20:
                    yield to_batch({"w": held[0][0].view(np.int64), "c": held[0][1]}, schema)
                    held.clear()
        if held:
            fold()
            yield to_batch({"w": held[0][0].view(np.int64), "c": held[0][1]}, schema)

    return text_docs(docs, held_out).filter(~F.col("held_out")).select("doc_id", "text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words at or over the least count that at most ``most`` words reach: sorted hashes, counts."""
    steps = counts.groupBy(F.least("c", F.lit(1 << 14)).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()  # 16,384 rows at most
    least, total = None, 0
    for row in steps:
        total += row["n"]
        if total > most:
            break
        least = row["c"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = counts.filter(F.col("c") >= least).toArrow()
    w, c = t.column("w").to_numpy().view(np.uint64), t.column("c").to_numpy()
    order = np.argsort(w)
    return w[order], c[order]


def score(docs: DataFrame, path: str, folds: int = 5, fold: int = 1, frequent: int = 1 << 18) -> DataFrame:
    """Per document: held_out, token and known-token counts, N, base_score, score and lattice_score.

    Learns from documents whose crc32(doc_id) modulo ``folds`` is not ``fold``; null
    text is empty (one token, the end). Counts cover all training documents. At most
    ``frequent`` of the most frequent words are broadcast (16 bytes each); all others
    are looked up by a join on the word's hash, so no count is dropped or capped.
    Words of any length are summed whole. Rows that repeat, in doc_id or text, count
    and are scored each by itself (without doc_id: not held out); other columns, of
    any name, are not read; an empty table gives no row.
    """
    from .quality import held_out

    out = held_out("doc_id", folds, fold).alias("held_out")
    counts = materialize(word_counts(docs, out), "lm-counts")
    n_all, n_words = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_all, n_words = n_all or 0, n_words or 0
    known, known_c = _frequent(counts, frequent)
    shared = docs.sparkSession.sparkContext.broadcast((known, known_c))
    fields = [("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("lattice", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("spelt", pa.list_(pa.float64()))]
    schema = pa.schema(fields)
    escape, whole = (n_words / (n_all + n_words), 1 / (n_all + n_words)) if n_all else (1.0, 0.0)

    def run(batches):
        voc = vocabulary(path)
        known, known_c = shared.value
        value, cache = np.log10(known_c + 0.5), np.full(len(known), np.nan)
        end_known = bool(len(known)) and known[0] == END
        both = lambda c, lat: np.log10(c * whole + escape * 10.0**lat)  # noqa: E731  c is 1 or more
        key = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            n = b.num_rows
            buf, s, e, doc, h = _hashes(column_bytes(b, "text"))
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
            base = np.bincount(doc[hit], value[at[hit]], n)
            n_known = np.bincount(doc[hit], minlength=n)
            if end_known:
                base, n_known = base + value[0], n_known + 1
            lat = np.empty(len(h))
            new = np.unique(at[hit][np.isnan(cache[at[hit]])])
            if len(new):
                first = np.full(len(known), -1)
                where = np.flatnonzero(hit)[::-1]
                first[at[where]] = where
                cache[new] = voc.marginals(buf, s[first[new]], e[first[new]])
            lat[hit] = cache[at[hit]]
            off = np.flatnonzero(~hit)
            if len(off):
                _, one, inv = np.unique(h[off], return_index=True, return_inverse=True)
                lat[off] = voc.marginals(buf, s[off[one]], e[off[one]])[inv]
            total = np.bincount(doc[hit], both(known_c[at[hit]], lat[hit]), n) + (both(known_c[0], voc.end) if end_known else 0.0)
            alone = np.bincount(doc[hit], lat[hit], n) + (voc.end if end_known else 0.0)
            # Each document's words outside the broadcast ones, with their numbers.
            pair = np.lexsort((h[off], doc[off]))
            d, w, spelt = doc[off][pair], h[off][pair], lat[off][pair]
            if not end_known:
                d, w, spelt = np.concatenate((d, np.arange(n))), np.concatenate((w, np.full(n, END, np.uint64))), np.concatenate((spelt, np.full(n, voc.end)))
                pair = np.lexsort((w, d))
                d, w, spelt = d[pair], w[pair], spelt[pair]
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])))) if len(d) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(d))).astype(np.int32)
            cuts = pa.array(np.searchsorted(d[new], np.arange(n + 1)).astype(np.int32))
            cols = {
                "key": key + np.arange(n), "doc_id": b.column(0), "held_out": b.column(2), "n_tokens": np.bincount(doc, minlength=n) + 1, "n_known": n_known, "base": base, "score": total, "lattice": alone,
                "rare": pa.ListArray.from_arrays(cuts, pa.array(w[new].view(np.int64))), "times": pa.ListArray.from_arrays(cuts, pa.array(times)), "spelt": pa.ListArray.from_arrays(cuts, pa.array(spelt[new])),
            }
            key += n
            yield to_batch(cols, schema)

    sql = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, lattice double, rare array<long>, times array<int>, spelt array<double>"
    first = materialize(text_docs(docs, out).mapInArrow(run, sql), "lm-docs")
    rare = first.select("key", F.explode(F.arrays_zip("rare", "times", "spelt")).alias("x")).select("key", F.col("x.rare").alias("w"), F.col("x.times").alias("t"), F.col("x.spelt").alias("spelt"))
    c = F.coalesce("c", F.lit(0))
    lattice = F.when(c > 0, F.log10(c * F.lit(whole) + F.lit(escape) * F.pow(F.lit(10.0), F.col("spelt")))).otherwise(F.col("spelt") + F.lit(float(np.log10(escape))))
    looked = rare.join(counts, "w", "left").groupBy("key").agg(F.sum(F.col("t") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("t")).otherwise(0)).alias("seen"), F.sum(F.col("t") * lattice).alias("also"), F.sum(F.col("t") * F.col("spelt")).alias("pieces"))
    lead = float(np.log10(n_all + 0.5 * (n_words + 1)))
    return first.drop("rare", "times", "spelt").join(looked, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(lead)).alias("base_score"), (F.col("score") + F.coalesce("also", F.lit(0.0))).alias("score"),
        (F.col("lattice") + F.coalesce("pieces", F.lit(0.0))).alias("lattice_score"),
    )
