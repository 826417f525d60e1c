"""Helpers shared by the corpus operators: shared storage, stable text access, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether the shuffle files of a query go when it ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: log2 of the bits of a Bloom table (16 MB).
TABLE = 27


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a folder of our own is set: in the warehouse on a
    cluster, a temporary one only if everything runs in this very process's machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        one_machine = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        path = tempfile.mkdtemp(prefix="kinweave-shared-") if one_machine else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kinweave"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def clear_shared(spark: SparkSession) -> None:
    """Delete all that ``materialize`` has written; only when no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/kinweave")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (with ``options`` of the writer) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinweave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled for this table alone goes as soon as it is written
    try:
        df.select("*").write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_docs(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id long, text string) of any documents table; other columns go, null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def text_key(col="text"):
    """Two 64-bit hashes of a text: equal for equal texts, 128 bits together."""
    col = F.col(col) if isinstance(col, str) else col
    return F.xxhash64(F.lit(1), col).alias("h1"), F.xxhash64(F.lit("2"), col).alias("h2")


def free_names(taken, *names: str) -> list[str]:
    """``names``, each lengthened until it clashes with no column (case aside)."""
    out, used = [], {c.lower() for c in taken}
    for name in names:
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def slices(batches, column: str = "text", max_bytes: int = 4 << 20):
    """Cut Arrow batches into runs of rows with at most ``max_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        lo, total = 0, 0
        for i, s in enumerate(sizes):
            if i > lo and total + s > max_bytes:
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += s
        yield batch.slice(lo, n - lo)


def column_bytes(batch, name: str) -> list[bytes]:
    """A string or binary column as bytes objects, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [x or b"" for x in col.to_pylist()]


def to_batch(columns: dict, schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def bloom_table(counted: DataFrame):
    """A broadcast Bloom table of ``key``; its size is fixed, and a chance hit only costs a row or splits a class."""
    low = F.lit((1 << TABLE) - 1)
    key = F.col("key")
    probes = [F.shiftrightunsigned(key, 64 - TABLE), F.shiftrightunsigned(key, 10).bitwiseAND(low), key.bitwiseXOR(F.shiftrightunsigned(key, 29)).bitwiseAND(low)]
    slots = counted.select(F.explode(F.array(*probes)).alias("slot"))
    word = slots.groupBy((F.col("slot") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits"))
    got = word.toArrow()
    bits = np.zeros(1 << (TABLE - 6), dtype=np.uint64)
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return counted.sparkSession.sparkContext.broadcast(bits)


def in_bloom(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    low, hit = np.uint64((1 << TABLE) - 1), np.ones(len(key), dtype=bool)
    for p in (key >> np.uint64(64 - TABLE), key >> np.uint64(10) & low, (key ^ key >> np.uint64(29)) & low):
        hit &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over undirected ``edges`` of longs.

    Alternating large-star and small-star contraction; every round is one pair of
    grouped minima and is written to the shared folder, so nothing is held by the
    driver and a lost executor costs one round. Nodes without edges do not appear.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = materialize(e, "cc")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v")
        new = materialize(small.filter("u <> v").distinct(), "cc")
        total = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total(new)) == tuple(total(e)):
            break
        e = new
    roots = new.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
