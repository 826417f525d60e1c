"""Operators 3 and 7 against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinweave.llm import bpe, packing

from ..conftest import SF
from .helpers import awkward, by_id, empty

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["", "a" * 3000, "Σας ΟΔΟΣ İx ẞ <|endoftext|> x <|startoftext|>'S 'll  \t\n  x  ²½ 12345 日本語 한국어 é \x1c a\x85b  ", "   lead  trail   ", "don't I'LL_we__ --", "🙂👍🏽" * 5, "Ǆ ǅ ﬁ Å Å K  x", "\n\n x"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    own, lib = bpe.BoundaryBpe(path, memo=5), Tokenizer.from_file(path)
    for text in HARD:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_forced_cuts_are_certain():
    own = bpe.BoundaryBpe(WORD)
    word = "thxqzkjble"
    parts = own.fragments(word)
    assert "".join(parts) == word and len(parts) > 1
    assert all(p[-1] + q[0] not in t for p, q in zip(parts, parts[1:]) for t in own.vocab)


def texts_of(df):
    return [r["text"] or "" for r in df.collect()]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_digests(spark, path):
    lib = Tokenizer.from_file(path)
    d = awkward(spark)
    got = [tuple(r) for r in bpe.encode_digests(d, path).collect()]
    want = []
    for r in d.collect():
        e = lib.encode(r["text"] or "", add_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(e.ids), sha(" ".join(map(str, e.ids))), sha(lib.decode(e.ids, skip_special_tokens=False))))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert bpe.encode_digests(empty(spark), path).count() == 0
    assert bpe.encode_documents(d, path).filter("doc_id = 8").first()["n_tokens"] == dict((w[0], w[1]) for w in want)[8]


def check_packing(df, pieces, size=1024):
    lib = Tokenizer.from_file(BYTE)
    ids = defaultdict(list)
    for r in df.collect():
        ids[r["doc_id"]].append(np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    left = {k: sum(map(len, v)) for k, v in ids.items()}
    windows = defaultdict(list)
    for p in pieces:
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in ids[p["doc_id"]])
        left[p["doc_id"]] -= p["length"]
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert not any(left.values())
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)
    return windows


def test_packing(spark):
    for d in (awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        check_packing(d, packing.pack(d, BYTE).collect())
    assert packing.pack(empty(spark), BYTE).count() == 0


def pieces_in(windows):
    return [p for w in windows for p in w]


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    for n in (6, 6, 3):
        p.put((0, 0, np.zeros(n), n))
    assert p.level[6] == 1 and p.level[9] == 1  # two windows at 6 cost most, so one of them grows
    (closed,) = p.put((0, 0, np.zeros(4), 4))
    assert sum(len(x[2]) for x in closed) == 10
    rng = np.random.default_rng(0)
    q = packing.SumOfSquares(64, most=10**6)
    for n in rng.integers(1, 64, 4000):
        q.put((0, 0, np.zeros(n), n))
    room = sum(64 - sum(len(x[2]) for x in w) for h in q.open for w in h)
    assert room < 64 * 4000**0.5  # the waste, in windows, grows as the square root of the pieces


def test_open_windows_are_bounded_and_every_id_is_placed_once():
    rng = np.random.default_rng(1)
    for most in (1, 2, 32):
        p, closed, want = packing.SumOfSquares(128, most), [], {}
        for doc, n in enumerate(rng.integers(1, 128, 3000)):
            want[doc] = np.arange(n)
            closed += p.put((doc, 0, want[doc], n))
            assert p.count == p.level.sum() <= most and p.level[128] == 0
        assert all(sum(len(x[2]) for x in w) == 128 for w in closed)
        got = defaultdict(list)
        for doc, start, ids, _ in pieces_in(closed) + p.rest():
            assert len(ids) and ids[0] == start
            got[doc].append(ids)
        assert all(np.array_equal(np.sort(np.concatenate(got[d])), want[d]) for d in want)


def test_level_array_places_all_but_the_last_windows():
    rng = np.random.default_rng(2)
    p, sizes = packing.SumOfSquares(1024), np.minimum(1023, rng.lognormal(5, 1, 5000).astype(int) + 1)
    closed = pieces_in(w for n in sizes for w in p.put((0, 0, np.zeros(n), n)))
    assert len(p.rest()) <= 10 * p.most  # of 5,000 remainders
    assert len(closed) + len(p.rest()) < 1.25 * len(sizes)  # few are cut
