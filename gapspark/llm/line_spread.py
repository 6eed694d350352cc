"""Removal of lines that many sites share, by DataFrame functions alone.

A line is boilerplate if documents of at least ``min_sites`` different sites hold it beside text of their
own. Every line is known by a pair of 64-bit hashes. Lines that are rarer than ``min_sites``, or come
from one site only, drop out by plain counts. For the others HyperLogLog sketches of the site, one per
line hash, are built where the rows are and merge by aggregation; a line far from the threshold is
decided by its estimate, one within ``BAND`` of it by an exact distinct count.

Copies and near copies of one document on many sites are no frame around different pages, but all their
lines are shared. So only witnesses count: documents of which shared lines make up at most
``shared_share`` of the characters, line ends left out. The sites of shared lines are counted once more
over witnesses, again by sketches and exact counts. What is boilerplate then goes from every document,
however large its share there; a document that many sites carry keeps what no other page shares.

Defined cases: a null text stays null and an empty one empty; blank lines are never boilerplate; a
null site counts for no line, but lines of such a document are removed like others; a line repeated
inside a document counts its site once and goes everywhere; a text that is boilerplate alone becomes
empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import hash_pair, materialize

MIN_SITES = 10
#: The most of a witness that lines of many sites make up.
SHARED_SHARE = 0.5
#: Relative distance from the threshold within which lines are counted exactly: many times the
#: standard error of a sketch of 2**12 registers (1.6 per cent).
BAND = 0.25


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, site: str, text: str) -> DataFrame:
    """One row per line that is not blank: its hashes and length, its place, the site, and the text's
    hashes and length."""
    body = F.col(f"`{text}`")
    ta, tb = hash_pair(body)
    lines = docs.select(
        ta.alias("ta"), tb.alias("tb"), F.length(F.translate(body, "\n", "")).alias("whole"),
        F.col(f"`{site}`").alias("site"), F.posexplode(lines_of(body)).alias("pos", "line"))
    a, b = hash_pair(F.col("line"))
    return lines.where(F.trim("line") != "").select(
        a.alias("a"), b.alias("b"), "ta", "tb", "whole", "site", "pos", F.length("line").alias("size"))


def widespread(rows: DataFrame, min_sites: int) -> DataFrame:
    """Hashes (a, b) of the lines that at least ``min_sites`` sites share; ``rows`` has a, b, site."""
    known = rows.where(F.col("site").isNotNull())
    sketches = known.groupBy("a", "b").agg(F.hll_sketch_agg("site").alias("sketch"))
    spread = materialize(sketches.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    near = spread.where(F.col("sites").between(min_sites * (1 - BAND), min_sites * (1 + BAND)))
    exact = (
        known.join(near.select("a", "b"), ["a", "b"], "left_semi").dropDuplicates(["a", "b", "site"])
        .groupBy("a", "b").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    )
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND))
    return materialize(sure.select("a", "b").unionByName(exact.select("a", "b")), "widespread-lines")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, shared_share: float = SHARED_SHARE,
                site: str = "source", text: str = "text") -> DataFrame:
    """(ta, tb, pos): the boilerplate lines of every text, by the text's hashes."""
    rows = occurrences(docs, site, text)
    counted = rows.where(F.col("site").isNotNull()).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    common = counted.where(F.col("n") >= min_sites)
    if min_sites > 1:
        common = common.where(F.col("low") < F.col("high"))
    common = materialize(common.select("a", "b"), "common-lines")
    repeated = materialize(rows.join(common, ["a", "b"], "left_semi"), "repeated-lines")
    shared = materialize(repeated.join(widespread(repeated, min_sites), ["a", "b"], "left_semi"), "shared-lines")
    # a copy's lines count once each, however many rows hold the text
    once = shared.dropDuplicates(["ta", "tb", "pos"])
    own = once.groupBy("ta", "tb").agg(F.sum("size").alias("shared"), F.first("whole").alias("whole"))
    witnesses = materialize(own.where(F.col("shared") <= shared_share * F.col("whole")).select("ta", "tb"), "witnesses")
    seen = shared.join(witnesses, ["ta", "tb"], "left_semi").select("a", "b", "site")
    return once.join(widespread(seen, min_sites), ["a", "b"], "left_semi").select("ta", "tb", "pos")


def remove_widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES, shared_share: float = SHARED_SHARE,
                            site: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with the cleaned text in place, and the number of removed lines in ``n_removed_lines``
    (which takes the place of a column of that name)."""
    found = boilerplate(docs, min_sites, shared_share, site, text)
    # lines to remove depend on the text alone, so copies of a text share one row
    hits = materialize(
        found.groupBy("ta", "tb").agg(F.collect_set("pos").alias("gone")), "lines-to-remove")
    body = F.col(f"`{text}`")
    ta, tb = hash_pair(body)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_removed_lines")]
    keyed = docs.select(F.struct(*others).alias("row") if others else F.lit(0).alias("row"),
                        lines_of(body).alias("parts"), ta.alias("ta"), tb.alias("tb"))
    # the text crosses the join as its lines, so no line is looked up by splitting it again
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone")), lambda i: F.get("parts", i))
    result = keyed.join(hits, ["ta", "tb"], "left").select(
        "row", F.array_join(F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("parts")), "\n").alias("body"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("removed"))
    order = [F.col(f"row.`{c}`").alias(c) if c != text else F.col("body").alias(c)
             for c in docs.columns if c != "n_removed_lines"]
    return result.select(*order, F.col("removed").alias("n_removed_lines"))
