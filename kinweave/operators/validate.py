"""Checks of result files: every rule of the format as a DataFrame of issues."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import CANDIDATE_HEADER, MATCHING_HEADER, load_split

#: Examples that a message shows.
SHOWN = 5
ISSUE = "rule string, severity string, n long, examples string"


def summarise(offenders: DataFrame, column: str, rule: str, severity: str = "error") -> DataFrame:
    """(rule, severity, n, examples): one row, none without offenders; the first few in order."""
    d = offenders.select(F.col(column).cast("string").alias("x")).distinct()
    few = d.orderBy("x").limit(SHOWN).agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("examples"))
    n = d.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return n.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", few.scalar().alias("examples"))


def check_lists(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None, label: str = "matched") -> DataFrame:
    """Issues of a parsed file ``rows`` (s1, ids array): all rules that concern ids.

    ``required`` (s1) are the entities that need one row each; ``valid`` (p), where
    given, all ids that exist.
    """
    ids = rows.select("s1", F.explode("ids").alias("p"))
    repeated = rows.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own, known = F.startswith("p", F.lit("S1-")), F.startswith("p", F.lit("S2-")) | F.startswith("p", F.lit("S3-"))
    found = [
        summarise(repeated, "s1", f"{label}: duplicate row"),
        summarise(rows.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "s1", f"{label}: repeated id in a list"),
        summarise(ids.filter(own), "p", f"{label}: self-match"),
        summarise(ids.filter(~own & ~known), "p", f"{label}: wrong prefix"),
        summarise(required.join(rows.select("s1"), "s1", "left_anti"), "s1", f"{label}: required entity missing"),
        summarise(rows.join(required.select("s1"), "s1", "left_anti"), "s1", f"{label}: unexpected entity"),
    ]
    if valid is not None:
        found.append(summarise(ids.filter(known).join(valid.select("p"), "p", "left_anti"), "p", f"{label}: unknown id"))
    return reduce(lambda a, b: a.unionByName(b), found)


def check_subset(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning for entities with matches outside their candidates."""
    c = candidates.select("s1", F.col("ids").alias("c"))
    out = matched.join(c, "s1", "left").filter(F.size(F.array_except("ids", F.coalesce("c", F.array().cast("array<string>")))) > 0)
    return summarise(out, "s1", "matched outside candidates", "warning")


def issue(spark: SparkSession, rule: str, example: str, severity: str = "error") -> DataFrame:
    return spark.createDataFrame([(rule, severity, 1, example)], ISSUE)


def read_lists(spark: SparkSession, path: str, header: list[str], label: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows, issues) of a file or a folder of part files, each with a header: existence, headers and lines without a tab; rows is None after a fatal one."""
    none = spark.createDataFrame([], ISSUE)
    try:
        lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
        heads = lines.groupBy("file").agg(F.min(F.struct("at", "value")).alias("head")).select("head.*")
        plain = F.transform(F.split("value", "\t"), lambda c: F.lower(F.trim(c))) == F.array(*map(F.lit, header))
        first = heads.orderBy(plain, "at").first()  # a wrong one, if there is any
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None, issue(spark, f"{label}: file not found", path)
    if first is None:
        return None, issue(spark, f"{label}: file is empty", path)
    names = [c.strip().lower() for c in first["value"].split("\t")]
    if names != header:
        rule = "comma-separated header" if "\t" not in first["value"] and "," in first["value"] else "unexpected header"
        return None, issue(spark, f"{label}: {rule}", first["value"][:200])
    body = lines.join(heads.select("at"), "at", "left_anti")
    bad = summarise(body.filter(~F.contains("value", F.lit("\t")) & (F.trim("value") != "")), "value", f"{label}: row without a tab")
    good = body.filter(F.contains("value", F.lit("\t"))).select(F.substring_index("value", "\t", 1).alias("s1"), F.expr("substring(value, instr(value, '\\t') + 1)").alias("rest"))
    rows = good.select("s1", F.when(F.trim("rest") == "", F.array().cast("array<string>")).otherwise(F.split("rest", ",")).alias("ids"))
    return rows, none.unionByName(bad)


def validate(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """All issues of a result: the matching file, the candidate file if there is one, and their agreement."""
    rows, issues = read_lists(spark, matching, MATCHING_HEADER, "matched")
    if rows is not None:
        issues = issues.unionByName(check_lists(rows, required, valid, "matched"))
    if valid is None:
        issues = issues.unionByName(issue(spark, "ids are not held against the sources", "", "warning"))
    if candidate:
        cands, more = read_lists(spark, candidate, CANDIDATE_HEADER, "candidate")
        missing = more.filter(F.col("rule") == "candidate: file not found").limit(1).count()
        issues = issues.unionByName(more.withColumn("severity", F.lit("warning")) if missing else more)
        if cands is not None:
            issues = issues.unionByName(check_lists(cands, required, valid, "candidate"))
            if rows is not None:
                issues = issues.unionByName(check_subset(rows, cands))
    return issues


def main(argv: list[str] | None = None) -> int:
    """Check result files from the command line; prints the issues and returns the exit code."""
    a = argparse.ArgumentParser(description="Check the lists of a matching result.")
    a.add_argument("--matching", required=True)
    a.add_argument("--candidate")
    a.add_argument("--data-dir", required=True, help="folder of the split's source files")
    a.add_argument("--split", default="test")
    a.add_argument("--check-ids", action="store_true", help="also ask that every id exists in the sources")
    x = a.parse_args(argv)
    spark = SparkSession.builder.appName("kinweave-validate").getOrCreate()
    s1, pool = load_split(spark, x.data_dir, x.split)
    issues = validate(spark, x.matching, x.candidate, s1.select(F.col("entity_id").alias("s1")), pool.select(F.col("entity_id").alias("p")) if x.check_ids else None)
    for r in issues.orderBy("severity", "rule").collect():  # a row for each rule and list at most
        print(f"{r['severity']}: {r['rule']}" + (f" ({r['n']}): {r['examples']}" if r["examples"] else ""))
    return exit_code(issues)


def exit_code(issues: DataFrame) -> int:
    """1 if any issue is an error."""
    return int(issues.filter("severity = 'error'").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
