"""Places in slices of more shingles or bytes than the usual bits hold."""

import numpy as np

from kinweave.llm import compact, suffix
from kinweave.llm.kernels import join_texts, prefix

from .helpers import prose


def test_places_beyond_the_usual_bits(monkeypatch):
    text = prose(12, 600).encode()
    h, first, *_ = compact.shingled([text])
    buf, offs = join_texts([text])
    want = compact.compact_windows(h, first, 0, 46), suffix.anchors(buf, prefix(buf), offs, 400)
    monkeypatch.setattr(compact, "_POS", 6)
    monkeypatch.setattr(suffix, "RANK", 57)
    got = compact.compact_windows(h, first, 0, 46), suffix.anchors(buf, prefix(buf), offs, 400)
    assert np.array_equal(got[0], want[0]) and all(np.array_equal(x, y) for x, y in zip(got[1], want[1], strict=True))
