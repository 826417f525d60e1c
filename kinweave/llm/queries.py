"""The registered query of each corpus operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, compact, embed_dedup, lattice, media, packing, quality, secrets, simhash, suffix

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secrets(spark, sf_dir):
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op2_embeddings(spark, sf_dir):
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_pack(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_media(spark, sf_dir):
    return media.media_digests(_read(spark, sf_dir, "documents"))


def op5_suffix(spark, sf_dir):
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op7_bpe(spark, sf_dir):
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_lattice(spark, sf_dir):
    return lattice.score(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op10_passages(spark, sf_dir):
    return compact.near_duplicate_passages(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secrets, op2_embeddings, op3_pack, op4_media, op5_suffix, op6_quality, op7_bpe, op8_simhash, op9_lattice, op10_passages)}


#: Links by all pairs of finite, non-zero vectors; components by walking to the least id reachable.
OP2_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.m AS component_id, v.vec_id = c.m AS kept FROM v JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = v.vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL can express the embedding join; the others are held against brute force in the tests."""
    return {"op2_embeddings": OP2_SQL}
