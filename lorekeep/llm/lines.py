"""Line dedup by site-relative frequency.

Method. Pages are grouped by host; for each line, the pages of the host that hold it are
divided by all pages of the host. Lines above the boilerplate ratio, on three pages at least,
are dropped from that host's pages. Counts are summed before the shuffle; lines travel as 128
bits of hash. As a page's distinct lines add up, a host has at most (lines of its average page
/ ratio) boilerplate lines, which bounds the list that each page is held against. That list
meets the pages by host and salt, so that a host with a third of all pages is dealt to many
tasks.

Defined results: null text has no lines; null host is a host of its own; a line that a page
repeats counts once for the page and goes at every place; repeated rows count as pages in the
pages table (its SQL says so), while documents of equal text count once for their source, so that
only lines which different texts share go; equal page ids don't matter; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
LEAST_PAGES = 3
SALTS = 32


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.concat(line, F.lit("\n")), F.lit(7)).alias("b"))


def boilerplate(pages: DataFrame, ratio: float, least: int, fold: bool = False) -> DataFrame:
    """(host, keys): the boilerplate lines of each host that has any, of pages (host, lines); fold counts equal pages of a host once."""
    if fold:
        content = line_key(F.array_join("lines", "\n")).alias("content")
        held = pages.select("host", content, F.explode(F.array_distinct("lines")).alias("line")).select("host", "content", line_key(F.col("line")).alias("key")).distinct()
        pages = pages.select("host", content).distinct()
    else:
        held = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", line_key(F.col("line")).alias("key"))
    counts = held.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    return (
        counts.join(totals.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host")))
        .filter(F.col("n") / F.col("n_pages") > ratio)
        .groupBy("host")
        .agg(F.collect_list("key").alias("keys"))
    )


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, fold: bool = False) -> DataFrame:
    """pages (host, lines array<string>, any others) with the columns kept and n_dropped added."""
    listed = boilerplate(pages, ratio, least, fold)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    listed = listed.select(F.col("host").alias("of_host"), F.col("keys").alias("boilerplate"), salt.alias("of_salt"))
    dealt = pages.withColumn("dealt", F.pmod(F.xxhash64("lines"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(listed, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("dealt") == F.col("of_salt")), "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), line_key(x))))
    return joined.withColumn("kept", kept).drop("of_host", "of_salt", "dealt", "boilerplate").withColumn("n_dropped", (F.size("lines") - F.size("kept")).cast("long"))


def html_lines(html: Column) -> Column:
    """The text between tags, a line for each run without a line break, trimmed, blank ones left out."""
    runs = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", "\n"), "\n")
    return F.filter(F.transform(runs, lambda x: F.trim(x)), lambda x: x != "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def clean_pages(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept text and its sha256, for each row of pages (page_id, url, html)."""
    lined = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    out = drop_boilerplate(lined, ratio, least)
    text = F.array_join("kept", "\n")
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), "n_dropped", text.alias("text"), F.sha2(text, 256).alias("kept_sha256"))


def clean_documents(documents: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """documents with their columns, less each source's boilerplate lines; n_chars follows the text."""
    columns = documents.columns
    lined = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("source").alias("host"), F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("lines"))
    out = drop_boilerplate(lined, ratio, least, fold=True)
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    fields = {"text": text, "n_chars": F.when(changed, F.length(text)).otherwise(F.col("row.n_chars")).cast("long")}
    return out.select(*[fields[c].alias(c) if c in fields else F.col(f"row.`{c}`").alias(c) for c in columns])
