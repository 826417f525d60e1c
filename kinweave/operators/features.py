"""Pair features: context windows, string comparisons, weighted overlaps, stage-2 and sibling support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from . import vectors

SCORES = ["cos_full", "cos_name", "tf_word", "tf_char", "tf_addr"]
STAGE2_BASE = ["combo", "cos_full", "tf_word", "tf_addr", "tf_char", "n_cands", "n_rev", "is_s3", "cos_f", "r_f"]
#: Siblings: at most so many candidates with at least so much stage-1 probability.
SIBLINGS, SIBLING_P = 5, 0.5


def combo(df: DataFrame) -> DataFrame:
    """The mean of the five pair scores."""
    return df.withColumn("combo", sum((F.col(c) for c in SCORES[1:]), F.col(SCORES[0])) / len(SCORES))


def context(df: DataFrame, scores: list[str] | None = None) -> DataFrame:
    """Ranks and gaps of each pair among its S1's candidates and among its pool record's owners.

    Needs s1, p, source and the scores (``combo`` among them). All windows of one side
    share a partitioning, so each side is shuffled once.
    """
    scores = scores or [*SCORES, "combo"]
    a, b = Window.partitionBy("s1"), Window.partitionBy("p")
    cols = [F.count(F.lit(1)).over(a).cast("int").alias("n_cands"), (F.col("source") == "S3").cast("int").alias("is_s3")]
    for c in scores:
        cols += [F.rank().over(a.orderBy(F.desc(c))).alias(f"{c}_rank"), (F.max(c).over(a) - F.col(c)).alias(f"{c}_gap")]
    d = df.select("*", *cols)
    d = d.withColumn("combo_srank", F.rank().over(Window.partitionBy("s1", "is_s3").orderBy(F.desc("combo"))))
    d = d.withColumn("n_strong", F.sum((F.col("combo_gap") < 0.1).cast("int")).over(a).cast("int"))
    back = [F.count(F.lit(1)).over(b).cast("int").alias("n_rev")]
    for c in scores:
        back += [F.rank().over(b.orderBy(F.desc(c))).alias(f"{c}_rrank"), (F.max(c).over(b) - F.col(c)).alias(f"{c}_rgap")]
    d = d.select("*", *back)
    return d.withColumn("mutual_best", ((F.col("combo_rank") == 1) & (F.col("combo_rrank") == 1)).cast("int"))


def name_frequency(records: DataFrame, name: str = "name_core") -> DataFrame:
    """(doc, freq): how many records of the same table bear the name.

    Counted first and joined back, so that a name of very many records is split like any skewed join.
    """
    n = records.groupBy(name).agg(F.count(F.lit(1)).alias("freq")).withColumnRenamed(name, "_name")
    return records.join(n, F.col(name).eqNullSafe(F.col("_name"))).select("doc", "freq")


def state4(a: Column, b: Column) -> Column:
    """0 both missing, 1 equal, 2 one missing, 3 conflict."""
    no_a, no_b = a == "", b == ""
    return F.when(no_a & no_b, 0).when(no_a | no_b, 2).when(a == b, 1).otherwise(3)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words; -1 if a side is empty."""
    x, y = word_set(a), word_set(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when((a == "") | (b == ""), F.lit(-1.0)).otherwise(shared / (F.size(x) + F.size(y) - shared))


def conflict(a: Column, b: Column) -> Column:
    """1 if both sides have words and none in common."""
    return ((a != "") & (b != "") & ~F.arrays_overlap(word_set(a), word_set(b))).cast("int")


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def same_end(a: Column, b: Column, index: int) -> Column:
    """First (1) or last (-1) words are equal; two empty sides are."""
    return (F.element_at(F.split(a, " "), index) == F.element_at(F.split(b, " "), index)).cast("int")


def acronym_match(a_acronym: Column, a_compact: Column, b_acronym: Column, b_compact: Column) -> Column:
    return (((a_acronym != "") & (a_acronym == b_compact)) | ((b_acronym != "") & (b_acronym == a_compact))).cast("int")


def prefix3(a: Column, b: Column) -> Column:
    return ((a != "") & (b != "") & (F.substring(a, 1, 3) == F.substring(b, 1, 3))).cast("int")


def contained(part: Column, whole: Column) -> Column:
    return ((part != "") & F.contains(whole, part)).cast("int")


def any_number(numbers: Column, address: Column) -> Column:
    return ((numbers != "") & F.arrays_overlap(word_set(numbers), word_set(address))).cast("int")


def idf_overlap(pairs: DataFrame, idf: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` (s1, p, …) with seven weighted overlaps of the word sets of columns a and b.

    Words without a weight have the largest one. All seven are -1 if a side is empty.
    The words are joined to their weights by a shuffle, so the vocabulary may be of any size.
    """
    words = lambda c, side: pairs.select("s1", "p", F.explode(word_set(F.col(c))).alias("term")).withColumn(side, F.lit(1))
    both = words(a, "in_a").join(words(b, "in_b"), ["s1", "p", "term"], "full_outer").na.fill(0, ["in_a", "in_b"])
    most = idf.agg(F.coalesce(F.max("idf"), F.lit(0.0))).scalar()
    w = both.join(idf, "term", "left").withColumn("w", F.coalesce(F.col("idf"), most))
    shared, only_a, only_b = (F.col("in_a") + F.col("in_b") == 2), F.col("in_b") == 0, F.col("in_a") == 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0.0))
    top = lambda cond: F.coalesce(F.max(F.when(cond, F.col("w"))), F.lit(0.0))
    got = w.groupBy("s1", "p").agg(
        total(shared).alias("shared"), total(F.col("in_a") == 1).alias("all_a"), total(F.col("in_b") == 1).alias("all_b"), top(shared).alias("m"), top(only_a).alias("ma"), top(only_b).alias("mb"), F.sum(only_b.cast("int")).alias("nb"), F.max("in_a").alias("has_a"), F.max("in_b").alias("has_b"),
    )
    fine = F.coalesce((F.col("has_a") == 1) & (F.col("has_b") == 1), F.lit(False))
    pick = lambda x, name: F.when(fine, x).otherwise(-1.0).alias(name)
    return pairs.join(got, ["s1", "p"], "left").select(
        *[F.col(c) for c in pairs.columns], pick(F.col("shared") / F.col("all_a"), "idf_cov_a"), pick(F.col("shared") / F.col("all_b"), "idf_cov_b"), pick(F.col("m"), "idf_max_shared"),
        pick(F.col("ma"), "idf_max_only_a"), pick(F.col("mb"), "idf_max_only_b"), pick(F.col("nb").cast("double"), "n_only_b"), pick(F.col("shared"), "idf_shared_sum"),
    )


def string_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, idf: DataFrame) -> DataFrame:
    """``pairs`` (s1, p, …) with 53 comparisons of the normalised records (``doc`` and the 22 fields)."""
    side = lambda d, x: d.select(*[F.col(c).alias(f"{x}_{c}") for c in d.columns])
    d = pairs.join(side(s1, "a").withColumnRenamed("a_doc", "s1"), "s1").join(side(pool, "b").withColumnRenamed("b_doc", "p"), "p")
    d = idf_overlap(d, idf, "a_name_norm", "b_name_norm")
    A, B = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    two = lambda fn, c: fn(A(c), B(c))
    out = [
        two(fuzzy.ratio, "name_core").alias("n_ratio"), two(fuzzy.token_set_ratio, "name_core").alias("n_tset"), two(fuzzy.token_sort_ratio, "name_core").alias("n_tsort"), two(fuzzy.partial_ratio, "name_core").alias("n_partial"),
        two(fuzzy.jaro_winkler, "name_core").alias("n_jw"), two(fuzzy.ratio, "name_compact").alias("n_compact_ratio"), two(fuzzy.partial_ratio, "name_compact").alias("n_compact_partial"), two(fuzzy.token_set_ratio, "name_norm").alias("n_norm_tset"),
        two(fuzzy.ratio, "name_phon").alias("n_phon_ratio"), two(fuzzy.token_set_ratio, "name_phon").alias("n_phon_tset"), two(fuzzy.token_set_ratio, "name_skel").alias("n_skel_tset"), two(fuzzy.ratio, "name_skel").alias("n_skel_ratio"),
        fuzzy.variant_ratio(A("name_core"), A("name_vars"), B("name_core"), B("name_vars")).alias("n_var_max"),
        same_end(A("name_core"), B("name_core"), 1).alias("same_first"), same_end(A("name_core"), B("name_core"), -1).alias("same_last"), acronym_match(A("acronym"), A("name_compact"), B("acronym"), B("name_compact")).alias("acronym"),
        two(state4, "legal").alias("legal_state"), two(length_ratio, "name_core").alias("len_ratio"), F.length(A("name_core")).alias("len_a"), F.size(F.split(A("name_core"), " ")).alias("ntok_a"),
        A("is_web").alias("is_web_a"), B("is_web").alias("is_web_b"), A("nonlatin").alias("a_nonlatin"), B("nonlatin").alias("b_nonlatin"),
        two(fuzzy.token_set_ratio, "addr_core").alias("a_tset"), two(fuzzy.token_sort_ratio, "addr_core").alias("a_tsort"), two(fuzzy.ratio, "addr_core").alias("a_ratio"), two(fuzzy.token_set_ratio, "addr_words").alias("a_words_tset"), two(fuzzy.partial_ratio, "addr_core").alias("a_partial"),
        contained(A("city_guess"), B("addr_norm")).alias("city_in_b"), two(state4, "city_guess").alias("city_eq"), two(state4, "postcode").alias("post_state"), two(prefix3, "postcode").alias("post_pref3"), two(state4, "primary_num").alias("pnum_state"), B("addr_empty").alias("a_empty_b"),
    ]
    for name, c in (("hnum", "house_nums"), ("landmark", "landmark"), ("namenum", "name_nums"), ("phon", "name_phon"), ("awords", "addr_words")):
        out += [two(jaccard, c).alias(f"{name}_jac"), two(conflict, c).alias(f"{name}_conf")]
    out.append(any_number(A("house_nums"), B("addr_norm")).alias("hnum_any_in_b"))
    return d.select(*[c for c in d.columns if not c.startswith(("a_", "b_"))], *out)


def top_two(df: DataFrame, by: list[str], value: str, tie: str) -> tuple[Column, Column, Column]:
    """(largest, second or 0, row rank from 1) of ``value`` within groups; ties go by ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), F.asc(tie))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.max(value).over(Window.partitionBy(*by)), F.coalesce(F.nth_value(value, 2).over(whole), F.lit(0.0)), F.row_number().over(w)


def stage2(df: DataFrame) -> DataFrame:
    """Neighbours' probabilities of each pair: its S1's list, and its rivals for the pool record.

    Needs s1, p, is_s3 and p1. The rival is the best p1 of another owner, 0 if there is none.
    """
    largest, second, rank = top_two(df, ["s1"], "p1", "p")
    a, b = Window.partitionBy("s1"), Window.partitionBy("p")
    half = (F.col("p1") > 0.5).cast("double")
    d = df.select("*", largest.alias("s1_max"), second.alias("s1_second"), rank.alias("s1_rank"), F.sum("p1").over(a).alias("s1_sum"), F.sum(half).over(a).alias("s1_cnt50"))
    d = d.withColumn("s1_gap", F.col("s1_max") - F.col("p1")).withColumn("src_rank", F.row_number().over(Window.partitionBy("s1", "is_s3").orderBy(F.desc("p1"), "p")))
    largest, second, rank = top_two(d, ["p"], "p1", "s1")
    d = d.select("*", largest.alias("_max"), second.alias("_second"), rank.alias("p_rank"), F.sum(half).over(b).alias("p_cnt50"))
    d = d.withColumn("p_rival", F.when(F.col("p_rank") == 1, F.col("_second")).otherwise(F.col("_max"))).withColumn("p_margin", F.col("p1") - F.col("p_rival"))
    base = [c for c in STAGE2_BASE if c in df.columns]
    return d.select("s1", "p", "p1", "s1_max", "s1_second", "s1_rank", "s1_gap", "s1_sum", "s1_cnt50", "src_rank", "p_rival", "p_margin", "p_rank", "p_cnt50", *base)


def sibling_pairs(df: DataFrame) -> DataFrame:
    """(s1, p, sib, sib_p1): each candidate with its S1's confident candidates other than itself."""
    w = Window.partitionBy("s1").orderBy(F.desc("p1"), F.asc("p"))
    sure = df.withColumn("i", F.row_number().over(w)).filter((F.col("i") <= SIBLINGS) & (F.col("p1") >= SIBLING_P))
    sure = sure.select("s1", F.col("p").alias("sib"), F.col("p1").alias("sib_p1"))
    return df.select("s1", "p").join(sure, "s1").filter("p <> sib")


def sibling_features(df: DataFrame, spaces: dict[str, DataFrame], dense: DataFrame | None = None) -> DataFrame:
    """Support of each pair by its siblings: number, best and weighted best likeness in each space, close addresses.

    ``spaces`` are pool postings (doc, term, w); ``dense`` pool vectors (doc, v). -1
    where a pair has no sibling.
    """
    pairs = sibling_pairs(df)
    d = pairs
    for name, postings in spaces.items():
        p = postings.select(F.col("doc").alias("p"), "term", F.col("w").alias("wp"))
        s = postings.select(F.col("doc").alias("sib"), "term", F.col("w").alias("ws"))
        each = pairs.select("p", "sib").distinct()
        sim = each.join(p, "p").join(s, ["sib", "term"]).groupBy("p", "sib").agg(F.sum(F.col("wp") * F.col("ws")).alias(name))
        d = d.join(sim, ["p", "sib"], "left").na.fill(0.0, [name])
    if dense is not None:
        p, s = dense.select(F.col("doc").alias("p"), F.col("v").alias("vp")), dense.select(F.col("doc").alias("sib"), F.col("v").alias("vs"))
        d = d.join(p, "p").join(s, "sib").withColumn("emb", vectors.dot(F.col("vp"), F.col("vs"))).drop("vp", "vs")
    names = [*spaces, *(["emb"] if dense is not None else [])]
    aggs = [F.count(F.lit(1)).cast("double").alias("sib_n")]
    for n in names:
        aggs += [F.max(n).alias(f"sib_max_{n}"), F.max(F.col(n) * F.col("sib_p1")).alias(f"sib_wmax_{n}")]
    if "addr" in spaces:
        aggs.append(F.sum((F.col("addr") >= 0.8).cast("double")).alias("sib_n_addr80"))
    out = df.join(d.groupBy("s1", "p").agg(*aggs), ["s1", "p"], "left")
    return out.na.fill(0.0, ["sib_n", *(["sib_n_addr80"] if "addr" in spaces else [])]).na.fill(-1.0, [c for n in names for c in (f"sib_max_{n}", f"sib_wmax_{n}")])


def gated(df: DataFrame, score: str, name: str = "ce", least: float = 0.01, otherwise: float = -12.0) -> DataFrame:
    """An expensive score only where stage 1 sees a chance or the late pass found the pair; -12 elsewhere."""
    gate = F.col("p1") >= least
    if "r_f" in df.columns:
        gate |= F.col("r_f") < 999
    return df.withColumn(name, F.when(gate, F.col(score)).otherwise(otherwise))
