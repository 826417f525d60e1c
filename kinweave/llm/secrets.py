"""Secret scans: fixed patterns, and assignment-aware lexing of names and literals.

The lexer reads source and configuration syntax into (name, literal) pairs, follows
names that were given literals before, joins literals that are added together, and
scores each literal by how sensitive its target name is and how random it looks.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections import Counter
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_docs, to_batch

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pair")

#: Least lengths: group 2 of an assignment, a whole access key, a whole hex run.
LEAST = {"assign": 6, "access": 20, "hex": 24}

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Words of names that hold secrets, with weights.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "secrets": 3, "token": 3, "credential": 3, "credentials": 3, "creds": 3, "apikey": 3, "privatekey": 3,
    "auth": 2, "authorization": 2, "bearer": 2, "pass": 2, "private": 2, "signing": 2, "encryption": 2, "cipher": 2, "salt": 2, "otp": 2, "jwt": 2, "oauth": 2,
    "api": 1, "key": 1, "access": 1, "client": 1, "session": 1, "login": 1, "master": 1, "account": 1, "database": 1, "db": 1,
}
#: Words of names whose literals only speak about secrets.
HARMLESS = {"length", "len", "policy", "hint", "label", "name", "type", "count", "max", "min", "field", "file", "path", "url", "uri", "expires", "expiry", "ttl", "placeholder", "description", "message", "prompt", "id"}
#: Words of literals that stand for a secret still to be filled in.
FILLERS = {"your", "my", "the", "some", "example", "sample", "test", "dummy", "fake", "changeme", "change", "replace", "replaceme", "insert", "todo", "none", "null", "nil", "true", "false", "undefined", "redacted", "hidden", "placeholder", "here"}
_TEMPLATE = re.compile(r"\$\{[^{}]*\}|\{\{[^{}]*\}\}|\$\([^()]*\)|%\([^()]*\)s|^<[^<>]*>$|^\{[^{}]*\}$|^\$[A-Za-z_]\w*$|^%[A-Za-z_]\w*%$")
_BLANK = re.compile(r"(?i)^(?:(.)\1*|[x*._-]{3,})$")
_PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_LITERAL = r"""(?:[bBrRuUfF]{0,2}"(?:[^"\\\n]|\\.)*"|[bBrRuUfF]{0,2}'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
_TARGET = re.compile(r"""(?:["']([A-Za-z_][\w .-]{0,63})["']|([A-Za-z_][\w.-]{0,127}))\]?(?:[ \t]*:[ \t]*(?:str|String|string|&str|const\s+char\s*\*))?[ \t]*$""", re.A)
_OPERATOR = re.compile(r":=|=>|<-|(?<![=!<>+*/%|&^~-])=(?!=)|(?<!:):(?!:|//)")
_VALUE = re.compile(r"[ \t]*(?:(" + _LITERAL + r")|([A-Za-z_][\w.]{0,127})(?![\w(./+=:@-])|([^\s\"'`,;(){}\[\]<>]+))", re.A)
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.|\.(?=[ \t]*[\"'])|(?=[\"']))[ \t]*(?:(" + _LITERAL + r")|([A-Za-z_][\w.]{0,127})(?![\w(]))", re.A)
_QUOTED = re.compile(_LITERAL)
_OTHERWISE = re.compile(r"(?:[^\n;\"'`=:]|" + _LITERAL + r")*?(?:\bor\b|\|\||\?\?|\?:)[ \t]*(" + _LITERAL + ")")
_HOLE = re.compile(r"\{([A-Za-z_][\w.]*)\}", re.A)
_NAME = r"([A-Za-z_][\w.-]{0,127})"
_CALL = re.compile(r"\(\s*[\"']" + _NAME + r"[\"']\s*,\s*(" + _LITERAL + ")", re.A)
_ELEMENT = re.compile(r"<" + _NAME + r"(?:\s[^<>]*)?>\s*([^<>\s][^<>]*?)\s*</\1\s*>", re.A)
_BLOCK = re.compile(r"^([ \t]*)(?:- )?[\"']?" + _NAME + r"[\"']?:[ \t]*[|>][+-]?[0-9]?[ \t]*\n((?:\1[ \t]+\S[^\n]*(?:\n|\Z))+)", re.A | re.M)
_ITEMS = re.compile(r"^([ \t]*)[\"']?" + _NAME + r"[\"']?:[ \t]*\n((?:\1[ \t]*- [^\n]*(?:\n|\Z))+)", re.A | re.M)
_LIST = re.compile(r"[\"']?\b" + _NAME + r"[\"']?\s*(?:=|:|:=|=>)\s*[\[({]\s*(" + _LITERAL + r"(?:\s*,\s*" + _LITERAL + r")*)\s*,?\s*[\])}]", re.A)
_LINE = re.compile(r"[^\s][^\n]*")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: At most so many characters before an operator can belong to its name.
_BACK = 200


def name_words(name: str) -> list[str]:
    """dbPassword2 and DB_PASSWORD alike as words in lower case."""
    return [w.lower() for w in _CAMEL.findall(name)]


def sensitivity(name: str) -> int:
    """Weight of a target name: 3 or more is a secret's name, 0 is none."""
    w = name_words(name)
    if not w or w[-1] in HARMLESS:
        return 0
    joined = {a + b for a, b in zip(w, w[1:], strict=False)}
    return sum(SENSITIVE.get(x, 0) for x in {*w, *joined})


def placeholder(value: str) -> bool:
    """Whether ``value`` is nothing but templates, blanks, or plain words with one that asks to be replaced."""
    if _BLANK.match(value):
        return True
    rest = _TEMPLATE.sub(" ", value)
    tokens = [w for w in re.split(r"[\s_.-]+", rest) if w]
    return all(map(_PLAIN.fullmatch, tokens)) and (rest != value or not FILLERS.isdisjoint(map(str.lower, tokens)))


@functools.cache
def _dictionary() -> frozenset:
    """Words that are one piece of the byte-level vocabulary, in lower case."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return frozenset(w[1:].lower() for w in vocab if w[0] == "\u0120" and w[1:].isalpha())


def _plain_words(value: str) -> bool:
    words = [w for w in re.split(r"[^A-Za-z0-9]+", value.lower()) if w]
    return all(w.isalpha() for w in words) and _dictionary().issuperset(words)


def randomness(value: str) -> float:
    """0 (a common word or a placeholder) to about 4: length, entropy and kinds of characters."""
    if len(value) < 4 or placeholder(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\sA-Za-z0-9]"))
    spaces = value.count(" ")
    return max(0.0, min(n, 24) / 12 + (entropy - 2.5) / 2 + (kinds - 1) / 2 - 0.8 * spaces)


def pairs(text: str):
    """(name, literal value, start, end of each literal part) for every assignment in ``text``.

    Quoted, typed, dotted and subscripted names; ``=``, ``:``, ``:=``, ``=>`` and
    ``<-``; quoted literals with escapes, bare configuration values, literals joined
    by ``+`` or standing side by side, names given a literal earlier in the text, such
    names inside f-strings, and defaults (``x or "v"``, ``x ?? "v"``).
    """
    constants: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    busy = 0
    for op in _OPERATOR.finditer(text):
        if op.start() < busy:
            continue
        lo = max(busy, op.start() - _BACK, text.rfind("\n", 0, op.start()) + 1)
        t = _TARGET.search(text[lo : op.start()])
        if not t:
            continue
        name = t[1] or t[2]
        v = _VALUE.match(text, op.end())
        if not v:
            continue
        if v[1]:
            q = v[1].lstrip("bBrRuUfF")
            parts, value, end = [(v.end(1) - len(q) + 1, v.end(1) - 1)], q[1:-1], v.end()
            if "{" in q and "f" in v[1][: len(v[1]) - len(q)].lower():  # what an f-string takes in
                for hole in _HOLE.findall(q):
                    parts += constants.get(hole, ("", []))[1]
                value = _HOLE.sub(lambda m: constants.get(m[1], (m[0],))[0], value)
        elif (d := _OTHERWISE.match(text, op.end())) and d[1]:  # x or "v": the value where x has none
            parts, end = [_inside(text, *d.span(1))], d.end()
            value = text[slice(*parts[0])]
            yield name, value, parts, True
            busy = end
            continue
        elif v[2] and v[2] in constants:
            value, parts = constants[v[2]]
            parts, end = list(parts), v.end()
        else:
            g = 2 if v[2] else 3
            raw = v[g].rstrip(".,;!?")
            value, parts, end = raw, [(v.start(g), v.start(g) + len(raw))], v.end()
            if not raw or (not v[2] and not re.search(r"\w", raw)):
                continue
        while v[1] or (v[2] and v[2] in constants):  # literals and constants that are added together
            m = _PLUS.match(text, end)
            if not m or not (m[1] or m[2] in constants):
                break
            if m[1]:
                q = m[1].lstrip("bBrRuUfF")
                value += q[1:-1]
                parts.append((m.end(1) - len(q) + 1, m.end(1) - 1))
            else:
                value += constants[m[2]][0]
                parts += constants[m[2]][1]
            end = m.end()
        if v[1] or (v[2] and v[2] in constants):
            constants[name] = (value, parts)
            constants.setdefault(name.rpartition(".")[2], (value, parts))
            busy = end
        yield name, value, parts, bool(v[1])


def _inside(text: str, lo: int, hi: int) -> tuple[int, int]:
    """``lo`` to ``hi`` without white space at its ends and without a literal's prefix and quotes."""
    while lo < hi and text[hi - 1].isspace():
        hi -= 1
    if m := _QUOTED.fullmatch(text, lo, hi):
        lo, hi = m.end() - len(m[0].lstrip("bBrRuUfF")) + 1, hi - 1
    return lo, hi


def structured(text: str):
    """As ``pairs``, where no operator stands between name and value.

    Calls with a quoted name and a literal (``setenv("K", "v")``), XML elements, YAML
    block scalars (their lines as one value) and YAML or bracketed lists under a name
    (each item a value).
    """
    if "(" in text:
        for m in _CALL.finditer(text):
            lo, hi = _inside(text, *m.span(2))
            yield m[1], text[lo:hi], [(lo, hi)], True
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield m[1], m[2], [m.span(2)], False
    if ":" in text and "\n" in text:
        for m in _BLOCK.finditer(text):
            parts = [_inside(text, x.start(), x.end()) for x in _LINE.finditer(text, *m.span(3))]
            yield m[2], "".join(text[a:b] for a, b in parts), parts, False
        for m in _ITEMS.finditer(text):
            for x in _LINE.finditer(text, *m.span(3)):
                lo, hi = _inside(text, x.start() + 2, x.end())
                yield m[2], text[lo:hi], [(lo, hi)], text[hi : hi + 1] in ("'", '"')
    if "[" in text or "(" in text or "{" in text:
        for m in _LIST.finditer(text):
            for x in _QUOTED.finditer(text, *m.span(2)):
                lo, hi = _inside(text, *x.span())
                yield m[1], text[lo:hi], [(lo, hi)], True


def find_pairs(text: str, least: float = 5.0) -> list[tuple[str, int, int]]:
    """Spans of literals whose name and value together score ``least`` or more.

    A name of weight under 2 never counts, and bare values need letters and digits.
    """
    found = set()
    for name, value, parts, quoted in chain(pairs(text), structured(text)):
        s = sensitivity(name)
        if s < 2:
            continue
        r = randomness(value)
        if not quoted and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value) and len(value) >= 8):
            continue
        if r >= 1 and s + r >= least:
            found.update(("pair", a, b) for a, b in parts if a < b)
    return sorted(found, key=lambda x: x[1:])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Fixed patterns, leftmost and non-overlapping for each kind, too short ones left out."""
    out = []
    if ":" in text or "=" in text:
        # A match never spans a line, so only lines with an operator are read.
        at = 0
        for line in text.split("\n"):
            if ":" in line or "=" in line:
                out += [("assign", at + m.start(), at + m.end()) for m in _ASSIGN.finditer(line) if len(m[2]) >= LEAST["assign"]]
            at += len(line) + 1
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind, in code points with exclusive ends."""
    return sorted(base_spans(text) + find_pairs(text), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``.

    An assignment whose value is a plain word or a placeholder (``secret: nobody``) stays.
    """
    out, last = [], 0
    for kind, a, b in spans(text):
        if kind == "assign":
            value = _ASSIGN.match(text, a)[2]
            if placeholder(value) or (randomness(value) < 1 and _plain_words(value)):
                continue
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_pair", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, in any number and order; null text is empty, with no span.

    base_sha256 covers the fixed patterns only; n_pair and spans also the lexer's.
    Texts are read whole, whatever their length (a name counts by the 128 characters
    next to its operator). Rows that repeat give rows that repeat; other columns, of
    any name, are not read; an empty table gives no row.
    """

    def run(batches):
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                base = sorted(base_spans(text), key=lambda x: (x[1], KINDS.index(x[0])))
                more = find_pairs(text)
                n = Counter(k for k, _, _ in base)
                every = sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                rows.append((n["assign"], n["access"], n["hex"], len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True))
            yield to_batch({"doc_id": b.column(0), **dict(zip(_FOUND.names[1:], cols, strict=True))}, _FOUND)

    return text_docs(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_pair long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; n_chars, if there, follows. Null text stays null."""

    def run(batches):
        for batch in batches:
            for b in slices([batch]):
                i = b.schema.get_field_index("text")
                new = [None if t is None else redact(t) for t in b.column(i).to_pylist()]
                yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
