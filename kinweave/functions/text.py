"""Name and address normalisation as column expressions.

Everything runs inside the JVM but two per-record lookups that Spark has no function
for (transliteration of native scripts and phonetic codes), which are Arrow UDFs in
``fuzzy``. Empty text stands for missing text throughout; nulls are read as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuzzy, tables



def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for ``key``, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def latin(raw: Column, transliterate: bool = True) -> Column:
    """Lower-case ASCII form; with ``transliterate`` off the text must be ASCII already."""
    raw = F.coalesce(raw, F.lit(""))
    return F.lower(fuzzy.transliterate(raw) if transliterate else raw)


def basic(raw: Column, transliterate: bool = True) -> Column:
    """Lower-case ASCII with ``&`` and ``+`` spelt out and apostrophes removed."""
    spelt = F.replace(F.replace(latin(raw, transliterate), F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    return F.regexp_replace(spelt, "['`’]", "")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, as an array."""
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")


def spaced(array: Column) -> Column:
    return F.array_join(array, " ")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def is_digits(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def no_zeros(t: Column) -> Column:
    """A number without leading zeros."""
    return F.regexp_replace(t, "^0+(?=.)", "")


def legal_and_core(toks: Column, extra: dict[str, str] | None = None) -> Column:
    """struct(legal, core): the first legal form found, and the words that are none.

    Phrases are tried in list order and removed as they are found, then single words;
    stop-words go and abbreviations are spelt out, ``extra`` ones before the fixed ones.
    """
    text, legal = F.concat(F.lit(" "), spaced(toks), F.lit(" ")), F.lit(None).cast("string")
    for phrase, kind in tables.LEGAL_PHRASES:
        found = F.contains(text, F.lit(f" {phrase} "))
        legal = F.coalesce(legal, F.when(found, F.lit(kind)))
        text = F.replace(text, F.lit(f" {phrase} "), F.lit(" "))
    left = split_words(text)
    kinds = F.filter(F.transform(left, lambda t: lookup(tables.LEGAL_WORDS, t)), lambda k: k.isNotNull())
    single = F.get(kinds, F.lit(0))
    kept = F.filter(left, lambda t: ~t.isin(*tables.LEGAL_WORDS) & ~t.isin(*tables.NAME_STOP_WORDS))
    table = tables.NAME_ABBREVIATIONS | (extra or {})
    core = F.transform(kept, lambda t: F.coalesce(lookup(table, t), t))
    return F.struct(F.coalesce(legal, single, F.lit("")).alias("legal"), core.alias("core"))


def skeleton(token: Column) -> Column:
    """Consonant skeleton: repeats collapse, vowels and h after the first letter go, repeats collapse."""
    once = F.regexp_replace(token, r"(.)\1+", "$1")
    return F.regexp_replace(F.regexp_replace(once, "(?<=.)[aeiouyh]", ""), r"(.)\1+", "$1")


def acronym(core: Column) -> Column:
    """Initials of two words or more, else empty."""
    return F.when(F.size(core) > 1, F.array_join(F.transform(core, lambda t: F.substring(t, 1, 1)), "")).otherwise(F.lit(""))


def normalize_name(df: DataFrame, name: str = "business_name", extra: dict[str, str] | None = None, transliterate: bool = True) -> DataFrame:
    """``df`` with the twelve name columns."""
    keep = df.columns
    d = df.withColumn("_raw", F.coalesce(F.col(name), F.lit(""))).withColumn("_b", basic(F.col(name), transliterate))
    d = d.withColumn("_t", tokens(F.col("_b")))
    trimmed = F.regexp_replace(F.trim("_b"), "^[#@ ]+", "")
    d = d.withColumn("_web", F.regexp_extract(trimmed, tables.WEBSITE, 1)).withColumn("_lc", legal_and_core(F.col("_t"), extra))
    core = F.when(F.col("_web") != "", F.array(F.replace(F.col("_web"), F.lit("-"), F.lit("")))).otherwise(F.col("_lc.core"))
    d = d.withColumn("_core", F.when(F.size(core) > 0, core).otherwise(F.col("_t")))
    parts = F.split("_b", tables.ALIAS_SPLIT)
    aliases = F.when(F.size(parts) > 1, F.filter(parts, lambda p: F.trim(p) != "")).otherwise(F.array().cast("array<string>"))
    outside = F.regexp_replace("_b", tables.BRACKETED, " ")
    bracket = F.when(F.col("_b").rlike(tables.BRACKETED) & (F.trim(outside) != ""), F.array(outside)).otherwise(F.array().cast("array<string>"))
    variants = F.transform(F.concat(aliases, bracket), lambda v: spaced(legal_and_core(tokens(v), extra)["core"]))
    d = d.withColumn("name_norm", spaced(F.col("_t"))).withColumn("name_core", spaced(F.col("_core")))
    d = d.withColumn("_core", split_words(F.col("name_core")))
    c = F.col("_core")
    return d.select(
        *keep, "name_norm", "name_core", F.array_join(c, "").alias("name_compact"), spaced(F.array_sort(c)).alias("name_sorted"), F.col("_lc.legal").alias("legal"),
        F.array_join(F.filter(variants, lambda v: (v != "") & (v != F.col("name_core"))), "|").alias("name_vars"), acronym(c).alias("acronym"), fuzzy.phonetic(F.col("name_core")).alias("name_phon"),
        spaced(F.transform(F.col("_t"), skeleton)).alias("name_skel"), spaced(F.transform(F.filter(c, is_digits), no_zeros)).alias("name_nums"),
        ((F.col("_web") != "") | F.startswith(F.trim("_b"), F.lit("#"))).cast("int").alias("is_web"), F.col("_raw").rlike(r"[^\x{0000}-\x{024F}]").cast("int").alias("nonlatin"),
    )


def canonical(t: Column) -> Column:
    """An address token without leading zeros, ordinal words as numbers, abbreviations spelt out."""
    t = F.when(is_digits(t), no_zeros(t)).otherwise(t)
    t = F.coalesce(lookup(tables.ORDINAL_WORDS, t), t)
    return F.coalesce(lookup(tables.ADDRESS_ABBREVIATIONS, t), t)


def component_words(component: Column) -> Column:
    """Canonical words of one comma-separated part; one that is a state becomes its full name."""
    words = F.transform(tokens(component), canonical)
    return split_words(F.coalesce(F.when(F.size(words) <= 3, lookup(tables.STATES, spaced(words))), spaced(words)))


def normalize_address(df: DataFrame, address: str = "business_address", transliterate: bool = True, long_code: str = tables.POSTCODE_6) -> DataFrame:
    """``df`` with the ten address columns.

    The postcode is the last match of ``long_code``, or else the last five digits that stand alone.
    """
    keep = df.columns
    raw = F.regexp_replace(F.coalesce(F.col(address), F.lit("")), tables.NUMBER_SIGN, "no ")
    d = df.withColumn("_b", F.regexp_replace(latin(F.regexp_replace(raw, "[°º]", " "), transliterate), tables.ORDINAL_SUFFIX, "$1"))
    d = d.withColumn("landmark", spaced(tokens(F.array_join(F.regexp_extract_all("_b", F.lit(tables.LANDMARK), 1), " "))))
    parts = F.filter(F.transform(F.split(F.regexp_replace("_b", tables.LANDMARK, " "), ","), lambda c: F.trim(c)), lambda c: c != "")
    d = d.withColumn("_c", F.transform(parts, component_words)).withColumn("_t", F.flatten("_c"))
    codes = F.regexp_extract_all("_b", F.lit(long_code), 0)
    codes = F.when(F.size(codes) > 0, codes).otherwise(F.regexp_extract_all("_b", F.lit(tables.POSTCODE_5), 0))
    d = d.withColumn("postcode", F.coalesce(F.substring_index(F.get(F.reverse(codes), F.lit(0)), "-", 1), F.lit("")))
    code = F.regexp_replace("postcode", "^0+", "")
    d = d.withColumn("_n", F.filter("_t", lambda t: is_digits(t) & (t != code))).withColumn("_core", F.filter("_t", lambda t: ~t.isin(*tables.ADDRESS_DROP_WORDS)))
    full = sorted({*tables.STATES.values(), *tables.STATES_BY_NAME_ONLY})
    place = F.filter(F.reverse("_c"), lambda c: (F.size(c) > 0) & ~spaced(c).isin(*full) & ~F.array_join(c, "").rlike("[0-9]"))
    last = F.get(place, F.lit(0))
    return d.select(
        *keep, spaced(F.col("_t")).alias("addr_norm"), spaced(F.col("_core")).alias("addr_core"), spaced(F.filter("_core", lambda t: ~is_digits(t))).alias("addr_words"), "postcode",
        spaced(F.array_distinct("_n")).alias("house_nums"), F.coalesce(F.get("_n", F.lit(0)), F.lit("")).alias("primary_num"), "landmark",
        F.coalesce(spaced(F.slice(last, F.greatest(F.size(last) - 1, F.lit(1)), 2)), F.lit("")).alias("city_guess"),
        F.array_join(F.transform("_c", spaced), "|").alias("addr_comps"), (F.size("_t") == 0).cast("int").alias("addr_empty"),
    )


def normalize(df: DataFrame, transliterate: bool = True, extra: dict[str, str] | None = None) -> DataFrame:
    """Normalised records: entity_id, country, source and all 22 name and address columns."""
    d = normalize_address(normalize_name(df, extra=extra, transliterate=transliterate), transliterate=transliterate)
    return d.drop("business_name", "business_address")


def clean_raw(raw: Column) -> Column:
    """Text for encoders: junk punctuation and repeated white space go, scripts stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), tables.TEXT_JUNK, " "), r"\s+", " "))


def full_text(name: Column, address: Column) -> Column:
    return F.concat_ws(", ", clean_raw(name), clean_raw(address))


def pair_text(name: Column, address: Column) -> Column:
    return F.concat_ws(" | ", clean_raw(name), clean_raw(address))
