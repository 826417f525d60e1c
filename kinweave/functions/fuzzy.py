"""Fuzzy string functions that Spark lacks, as Arrow-batched UDFs.

Each batch is worked column by column; equal pairs within a batch are computed once.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine-word step for each character of ``b``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """200 * LCS / (len a + len b); two empty strings are alike."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with each side's others; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = bool(shared)
    len_x, len_y = shared + gap + len(only_x), shared + gap + len(only_y)
    best = 100.0 * (1 - (len(only_x) + len(only_y) - 2 * lcs_length(only_x, only_y)) / (len_x + len_y))
    if shared:
        for n in (len_x, len_y):
            best = max(best, 200.0 * shared / (shared + n))
    return best


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of the longer one, windows over its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def _best_window(a: str, b: str) -> float:
    n, chars, best = len(a), set(a), 0.0
    for start in range(1 - n, len(b)):
        lo, hi = max(start, 0), min(start + n, len(b))
        # A window that grows at the front ends, and one that shrinks at the back begins, in a shared character.
        if (b[hi - 1] if start < len(b) - n else b[lo]) in chars:
            best = max(best, ratio_of(a, b[lo:hi]))
    return best


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity with 0.1 for each of up to four common first letters, once Jaro exceeds 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


_VOWELS = "aeiou"


def metaphone_of(word: str) -> str:
    """Metaphone code of one lower-case ASCII word."""
    w = "".join(c for i, c in enumerate(word) if c.isalpha() and (i == 0 or c == "c" or c != word[i - 1]))
    if w[:2] in ("kn", "gn", "pn", "wr", "ae"):
        w = w[1:]
    if w[:1] == "x":
        w = "s" + w[1:]
    if w[:2] == "wh":
        w = "w" + w[2:]
    out, i, n = [], 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c, nxt, step = w[i], at(i + 1), 1
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "b":
            if not (i == n - 1 and at(i - 1) == "m"):
                out.append("b")
        elif c == "c":
            if nxt == "i" and at(i + 2) == "a":
                out.append("x")
            elif nxt == "h":
                out.append("k" if at(i - 1) == "s" else "x")
                step = 2
            elif nxt in ("i", "e", "y") and nxt:
                if at(i - 1) != "s":
                    out.append("s")
            else:
                out.append("k")
        elif c == "d":
            if nxt == "g" and at(i + 2) in ("e", "i", "y") and at(i + 2):
                out.append("j")
                step = 2
            else:
                out.append("t")
        elif c == "g":
            if nxt == "h":
                if i + 2 >= n or at(i + 2) not in _VOWELS:
                    step = 2
                else:
                    out.append("k")
                    step = 2
            elif nxt == "n":
                if not (i + 2 >= n or w[i + 1 :] == "ned"):
                    out.append("k")
            elif nxt in ("e", "i", "y") and nxt and at(i - 1) != "g":
                out.append("j")
            else:
                out.append("k")
        elif c == "h":
            if nxt in _VOWELS and nxt and at(i - 1) not in ("c", "g", "p", "s", "t"):
                out.append("h")
        elif c == "k":
            if at(i - 1) != "c":
                out.append("k")
        elif c == "p":
            out.append("f" if nxt == "h" else "p")
            step = 2 if nxt == "h" else 1
        elif c == "q":
            out.append("k")
        elif c == "s":
            if nxt == "h":
                out.append("x")
                step = 2
            elif nxt == "i" and at(i + 2) in ("o", "a") and at(i + 2):
                out.append("x")
            else:
                out.append("s")
        elif c == "t":
            if nxt == "i" and at(i + 2) in ("o", "a") and at(i + 2):
                out.append("x")
            elif nxt == "h":
                out.append("0")
                step = 2
            elif not (nxt == "c" and at(i + 2) == "h"):
                out.append("t")
        elif c == "v":
            out.append("f")
        elif c in "wy":
            if nxt in _VOWELS and nxt:
                out.append(c)
        elif c == "x":
            out.append("ks")
        elif c == "z":
            out.append("s")
        else:
            out.append(c)
        i += step
    return "".join(out).upper()


def phonetic_of(text: str) -> str:
    """Each word's code; digits pass, and a word without a code stands for itself."""
    return " ".join(t if t.isdigit() else metaphone_of(t) or t for t in text.split())


#: Letters that do not come apart into a base letter and marks.
_LATIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i", "ŋ": "ng", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "₹": "Rs", "€": "EUR", "£": "PS", "№": "No"}
#: The scripts from Devanagari to Malayalam lie 128 code points apart with like letters at like places.
_INDIC_VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "R", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
_INDIC_SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "R", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
_INDIC_CONSONANTS = dict(enumerate("k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n nnn p ph b bh m y r rr l ll lll v sh ss s h".split(), 0x15))


def transliterate_of(text: str) -> str:
    """ASCII spelling: marks come off, Indic scripts are spelt by place, other scripts' letters go."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    out, i = [], 0
    while i < len(text):
        ch, code = text[i], ord(text[i])
        if code < 128:
            out.append(ch)
        elif ch in _LATIN:
            out.append(_LATIN[ch])
        elif 0x900 <= code < 0xD80:
            k = (code - 0x900) % 0x80
            if k in _INDIC_CONSONANTS:
                out.append(_INDIC_CONSONANTS[k])
                nxt = (ord(text[i + 1]) - 0x900) % 0x80 if i + 1 < len(text) and 0x900 <= ord(text[i + 1]) < 0xD80 else None
                if nxt not in _INDIC_SIGNS and nxt != 0x4D:
                    out.append("a")
            elif k in _INDIC_VOWELS:
                out.append(_INDIC_VOWELS[k])
            elif k in _INDIC_SIGNS:
                out.append(_INDIC_SIGNS[k])
            elif k in (0x01, 0x02):
                out.append("n")
            elif k == 0x03:
                out.append("h")
            elif 0x66 <= k <= 0x6F:
                out.append(str(k - 0x66))
        else:
            out.append("".join(_LATIN.get(c, c if ord(c) < 128 else "") for c in unicodedata.normalize("NFKD", ch)))
        i += 1
    return "".join(out)


def _pairwise(fn):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a.fillna(""), b.fillna(""), strict=True):
            if p not in known:
                known[p] = fn(*p)
            out.append(known[p])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, DoubleType())


def _single(fn):
    def run(a: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        out = []
        for x in a.fillna(""):
            if x not in known:
                known[x] = fn(x)
            out.append(known[x])
        return pd.Series(out, dtype="object")

    return F.pandas_udf(run, StringType())


ratio = _pairwise(ratio_of)
token_sort_ratio = _pairwise(token_sort_of)
token_set_ratio = _pairwise(token_set_of)
partial_ratio = _pairwise(partial_of)
jaro_winkler = _pairwise(jaro_winkler_of)
phonetic = _single(phonetic_of)
transliterate = _single(transliterate_of)


def _variants(a: pd.Series, a_vars: pd.Series, b: pd.Series, b_vars: pd.Series) -> pd.Series:
    out = []
    for x, xs, y, ys in zip(a.fillna(""), a_vars.fillna(""), b.fillna(""), b_vars.fillna(""), strict=True):
        left, right = [x, *filter(None, xs.split("|"))], [y, *filter(None, ys.split("|"))]
        out.append(max(token_set_of(p, q) for p in left for q in right))
    return pd.Series(out, dtype="float64")


#: Best token-set ratio over both names and all their variants.
variant_ratio = F.pandas_udf(_variants, DoubleType())
