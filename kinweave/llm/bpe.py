"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up
in one token, so the text is certainly cut there. Words are split at all such pairs,
the fragments are encoded independently (each once, then remembered) and the ids are
concatenated. The result equals the tokenizers library's for byte-level BPE files.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, text_docs, to_batch

#: Texts of these characters alone are split by ``re``, whose classes agree with the
#: Unicode ones there; all others take the slower module with Unicode properties.
_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """Remembers what ``make`` gave for a key: at most ``limit`` entries and the ``limit`` before them."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class BoundaryBpe:
    """Encoder for a tokenizers JSON file with a byte-level BPE model.

    ``pieces(text)`` splits as the file's pre-tokenizer does (both families of
    public files are known: words with or without an end mark); ``encode_piece``
    gives the token strings of one piece.
    """

    def __init__(self, path: str, memo: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self._map = {i: c for i, c in enumerate(self.alphabet)}
        self.inside = {t[i : i + 2] for t in self._bare() for i in range(len(t) - 1)}
        self.lower = bool(spec.get("normalizer"))
        if self.lower:
            self._re = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
            self._regex = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        else:
            self._re = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
            self._regex = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self._same = re.compile("[!-~]+").fullmatch  # such bytes stand for themselves
        self._fragments = _Memo(self._merge, memo)

    def _bare(self):
        n = len(self.end)
        return (t[:-n] if n and t.endswith(self.end) else t for t in self.vocab)

    def normalize(self, text: str) -> str:
        if not self.lower or text.isascii():
            return text.lower() if self.lower else text
        # Capital sigma is lowered without regard to its place in the word.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        return (self._regex if _PLAIN.search(text) else self._re).findall(text)

    def runs(self, text: str):
        """(is_special, string) runs of a text: the special tokens' strings stand alone."""
        if self._special is None or "<|" not in text:
            return [(False, text)]
        return [(i % 2 == 1, x) for i, x in enumerate(self._special.split(text)) if x]

    def fragments(self, word: str) -> list[str]:
        """Cut the byte-level form of a piece at every pair that no token contains."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]
        if not cuts:
            return [word]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def encode_piece(self, piece: str) -> tuple[str, ...]:
        word = piece if self._same(piece) else piece.encode("utf-8").decode("latin-1").translate(self._map)
        parts = self.fragments(word)
        if self.end:
            parts[-1] += self.end
        if len(parts) == 1:
            return self._fragments[parts[0]]
        return tuple(t for p in parts for t in self._fragments[p])

    def _merge(self, fragment: str) -> tuple[str, ...]:
        if self.end and fragment.endswith(self.end):
            s = list(fragment[: -len(self.end)])
            s[-1] += self.end
        else:
            s = list(fragment)
        if len(s) > 200:
            return self._merge_long(s)
        rank, none = self.ranks.get, 1 << 60
        left = [rank(p, none) for p in zip(s, s[1:], strict=False)]
        while left and (best := min(left)) != none:
            at = left.index(best)
            s[at] += s.pop(at + 1)
            del left[at]
            if at < len(left):
                left[at] = rank((s[at], s[at + 1]), none)
            if at:
                left[at - 1] = rank((s[at - 1], s[at]), none)
        return tuple(s)

    def _merge_long(self, s: list[str]) -> tuple[str, ...]:
        """As ``_merge`` with a heap: near-linear for one fragment of any length."""
        import heapq

        n, ranks = len(s), self.ranks
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = nxt[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (s[x], s[y]) in ranks:
                    heapq.heappush(heap, (ranks[(s[x], s[y])], x, (s[x], s[y])))
        return tuple(x for x in s if x is not None)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, run in self.runs(text):
            if special:
                out.append(self.special[run])
            else:
                for p in self.pieces(self.normalize(run)):
                    out.extend(self.vocab[t] for t in self.encode_piece(p))
        return out

    def decode(self, ids: list[int]) -> str:
        """Files without a decoder join the token strings by spaces; others map bytes back."""
        if self.lower:
            return " ".join(self.tokens[i] for i in ids)
        back = {c: b for b, c in enumerate(self.alphabet)}
        return bytes(back[c] for i in ids for c in self.tokens[i]).decode("utf-8", "replace")


_LOADED: dict[str, BoundaryBpe] = {}


def load(path: str) -> BoundaryBpe:
    """One encoder for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = BoundaryBpe(path)
    return _LOADED[path]


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string) of every document; null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        bpe = load(path)
        for b in slices(batches):
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield to_batch({"doc_id": b.column(0), "n_tokens": list(map(len, ids)), "ids": ids, "decoded": list(map(bpe.decode, ids))}, schema)

    return text_docs(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, memo: int = 300_000) -> DataFrame:
    """Per document: token count and SHA-256 of its ids (decimal, one space) and decoded text.

    Null text counts as empty: no token, digests of the empty string. Rows with equal
    or null doc_id are kept as they are. Extra columns are ignored. Words are encoded
    once per worker and remembered (``memo`` entries at most).
    """

    def run(batches):
        bpe = load(path)

        def entry(piece):
            toks = bpe.encode_piece(piece)
            return " ".join([str(bpe.vocab[t]) for t in toks]), " ".join(toks)

        known = _Memo(entry, memo)
        for b in slices(batches):
            counts, ids_sha, dec_sha = [], [], []
            for text in b.column(1).to_pylist():
                got = []
                for special, run_ in bpe.runs(text):
                    if special:
                        got.append((str(bpe.special[run_]), run_))
                    else:
                        got.extend([known[p] for p in bpe.pieces(bpe.normalize(run_))])
                ids = " ".join([x for x, _ in got])
                counts.append(ids.count(" ") + 1 if got else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                if bpe.lower:
                    decoded = " ".join([x for _, x in got])
                else:
                    decoded = bpe.decode(list(map(int, ids.split()))) if got else ""
                dec_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield to_batch({"doc_id": b.column(0), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": dec_sha}, _DIGEST)

    return text_docs(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
