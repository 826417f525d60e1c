"""Media columns: payloads cut where their content says so, each shared chunk stored once.

A gear hash rolls over the payload and cuts where its high bits are zero. Chunks are
named by digest. A chunk that occurs in more than one payload is kept once, in a
chunk table that Spark joins back by digest; the others stay with their payload. A
payload is rebuilt from its ordered chunk list and verified before features are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, materialize, slices, text_docs, to_batch
from .kernels import mix

UNIT = 192
LEAST, MOST, BITS = 512, 8192, 10
#: Hash prefix by which chunks are held against those known to be shared.
PREFIX = 22
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload(text: bytes) -> bytes:
    """Spaces are appended up to a positive multiple of 192 bytes."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def gear_cuts(payloads: list[bytes], least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[list[int]]:
    """For each payload the ends of its chunks, a function of the payload alone.

    The hash of a position covers the 32 bytes up to it, so all positions of many
    payloads are hashed together in five doubling steps; no cut lies within ``least``
    of the one before, so no hash reaches over a payload's start.
    """
    h = _GEAR[np.frombuffer(b"".join(payloads), dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):
        n = h.copy()
        n[k:] += h[:-k] << np.uint32(k)
        h = n
    marks = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    out, base = [], 0
    for p in payloads:
        end, at, cuts = base + len(p), base, []
        while end - at > least:
            i = bisect_left(marks, at + least)
            cut = min(marks[i] if i < len(marks) else end, at + most, end)
            cuts.append(cut - base)
            at = cut
        if at < end:
            cuts.append(end - base)
        out.append(cuts)
        base = end
    return out


def chunk_name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def container(digests: list[bytes], chunks: list[bytes]) -> bytes:
    """The stored form: magic, sample count, ordered chunk list (digest, length), 8-bit samples."""
    head = struct.pack("<4sII", b"KWM1", sum(map(len, chunks)), len(chunks))
    return head + b"".join(d + struct.pack("<I", len(c)) for d, c in zip(digests, chunks, strict=True)) + b"".join(chunks)


def read_container(media: bytes) -> bytes:
    """The samples of a stored form; raises ValueError if a chunk is not what its digest says."""
    magic, n, k = struct.unpack_from("<4sII", media)
    at, out = 12 + 20 * k, []
    for i in range(k):
        (size,) = struct.unpack_from("<I", media, 12 + 20 * i + 16)
        c = media[at : at + size]
        if chunk_name(c) != media[12 + 20 * i : 12 + 20 * i + 16]:
            raise ValueError("a chunk differs from its digest")
        out.append(c)
        at += size
    if magic != b"KWM1" or at != len(media) or sum(map(len, out)) != n:
        raise ValueError("not a whole container")
    return b"".join(out)


def feature(samples: bytes) -> str:
    """Mean, deviation and sign changes about 128 of the 8-bit samples, and eight shares."""
    x = np.frombuffer(samples, dtype=np.uint8)
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    turns = int(np.count_nonzero(np.diff((x > 128).astype(np.int8))))
    return f"mean={x.mean():.4f};std={x.std():.4f};turns={turns};hist=" + ",".join(f"{s:.4f}" for s in shares)


def _keyed(p: bytes) -> tuple[bytes, int, int]:
    sha = hashlib.sha256(p).digest()
    return sha, *struct.unpack("<qq", sha[:16])


def _cut(payloads: list[bytes]):
    """For each payload its chunks."""
    return [[p[a:b] for a, b in zip([0, *c], c, strict=False)] for p, c in zip(payloads, gear_cuts(payloads), strict=True)]


def _prefixes(digests: list[bytes]) -> list[int]:
    return [int.from_bytes(d[:4], "big") >> (32 - PREFIX) for d in digests]


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, m1, m2, digests): each document's payload key and ordered chunk digests."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("digests", pa.list_(pa.binary()))])

    def run(batches):
        for b in slices(batches):
            texts = column_bytes(b, "text")
            pay = [payload(t) for t in texts]
            keys = [_keyed(p) for p in pay]
            names = [[chunk_name(c) for c in cs] for cs in _cut(pay)]
            yield to_batch({"doc_id": b.column(0), "n_bytes": list(map(len, texts)), "m1": [k[1] for k in keys], "m2": [k[2] for k in keys], "digests": names}, schema)

    return text_docs(docs).mapInArrow(run, "doc_id long, n_bytes long, m1 long, m2 long, digests array<binary>")


def shared_digests(lists: DataFrame) -> DataFrame:
    """Digests that occur in more than one payload; a group of equal payloads counts as one."""
    c = lists.select("m1", F.explode("digests").alias("digest"))
    return c.groupBy("digest").agg(F.min("m1").alias("a"), F.max("m1").alias("b")).filter("a <> b").select("digest")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, chunks, media): chunk lists, the table of shared chunks, each payload's own chunks.

    ``chunks`` (digest, z) has each chunk once. Whether a chunk may be shared is seen
    from a bit table of its hash prefix (512 KB, whatever the corpus): a chance hit
    puts a chunk into the table needlessly and loses nothing. ``media`` (m1, m2,
    digests, inside, z) has one row per distinct payload; ``inside`` has the size of
    each listed chunk that lies in z, 0 for those in the table.
    """
    lists = materialize(chunk_lists(docs), "media-lists")
    pre = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - PREFIX)
    hits = shared_digests(lists).select(pre.cast("int").alias("p")).distinct().toArrow().column("p").to_numpy()  # 2**22 at most
    bits = np.zeros(1 << PREFIX, dtype=bool)
    bits[hits] = True
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    lent_schema = pa.schema([("digest", pa.binary()), ("z", pa.binary())])
    media_schema = pa.schema([("m1", pa.int64()), ("m2", pa.int64()), ("digests", pa.list_(pa.binary())), ("inside", pa.list_(pa.int32())), ("z", pa.binary())])

    def is_shared(names, seen):
        return [bool(seen[p >> 3] >> (7 - (p & 7)) & 1) for p in _prefixes(names)]

    def lend(batches):
        z, seen, sent = zstandard.ZstdCompressor(level=6), table.value, set()
        for b in slices(batches):
            rows = {}
            for cs in _cut([payload(t) for t in column_bytes(b, "text")]):
                names = [chunk_name(c) for c in cs]
                rows |= {n: c for n, c, s in zip(names, cs, is_shared(names, seen), strict=True) if s and n not in sent}
            if len(sent) < 1 << 17:  # what this task has sent already; more is merged by the shuffle
                sent.update(rows)
            yield to_batch({"digest": list(rows), "z": [z.compress(c) for c in rows.values()]}, lent_schema)

    def own(batches):
        z, seen, sent = zstandard.ZstdCompressor(level=6), table.value, set()
        for b in slices(batches):
            rows = []
            pay = [payload(t) for t in column_bytes(b, "text")]
            for p, cs in zip(pay, _cut(pay), strict=True):
                _, m1, m2 = _keyed(p)
                if (m1, m2) in sent:
                    continue
                if len(sent) < 1 << 17:
                    sent.add((m1, m2))
                names = [chunk_name(c) for c in cs]
                inside = [0 if s else len(c) for c, s in zip(cs, is_shared(names, seen), strict=True)]
                rows.append((m1, m2, names, inside, z.compress(b"".join(c for c, i in zip(cs, inside, strict=True) if i))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield to_batch(dict(zip(media_schema.names, cols, strict=True)), media_schema)

    text = text_docs(docs)
    chunks = materialize(text.mapInArrow(lend, "digest binary, z binary").groupBy("digest").agg(F.first("z").alias("z")), "media-chunks")
    media = text.mapInArrow(own, "m1 long, m2 long, digests array<binary>, inside array<int>, z binary")
    media = media.groupBy("m1", "m2").agg(F.first(F.struct("digests", "inside", "z")).alias("s")).select("m1", "m2", "s.*")
    return lists, chunks, media


def fetch(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """(m1, m2, parts array<(seq, z)>): the stored shared chunks of every distinct payload."""
    wanted = lists.groupBy("m1", "m2").agg(F.first("digests").alias("digests")).select("m1", "m2", F.posexplode("digests").alias("seq", "digest"))
    return wanted.join(chunks, "digest").groupBy("m1", "m2").agg(F.collect_list(F.struct("seq", "z")).alias("parts"))


def rebuild(media: DataFrame, parts: DataFrame) -> DataFrame:
    """(m1, m2, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), read back.

    Every container is rebuilt from the ordered chunk list, each chunk checked
    against its digest and the payload against its key; a mismatch fails the job.
    """
    schema = pa.schema([("m1", pa.int64()), ("m2", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 20):
            rows = []
            for m1, m2, names, inside, z, parts in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                lent = {p["seq"]: unzip.decompress(p["z"]) for p in parts or []}
                own, chunks, at = unzip.decompress(z), [], 0
                for k, size in enumerate(inside):
                    if size:
                        chunks.append(own[at : at + size])
                        at += size
                    else:
                        chunks.append(lent[k])
                stored = container(names, chunks)
                samples = read_container(stored)
                sha, k1, k2 = _keyed(samples)
                if (k1, k2) != (m1, m2):
                    raise ValueError("a rebuilt payload differs from what was stored")
                rows.append((m1, m2, len(samples), sha.hex(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            yield to_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    joined = media.join(parts, ["m1", "m2"], "left").select("m1", "m2", "digests", "inside", "z", "parts")
    return joined.mapInArrow(run, "m1 long, m2 long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document, from its media as read back; null text is empty (192 spaces).

    Equal texts have equal values; equal payloads are stored and rebuilt once.
    """
    lists, chunks, media = store(docs)
    back = rebuild(media, fetch(lists, chunks))
    return lists.select("doc_id", "n_bytes", "m1", "m2").join(back, ["m1", "m2"]).drop("m1", "m2")
