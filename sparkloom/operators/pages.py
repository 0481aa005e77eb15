"""Health checks of a graph of knowledge pages: links, index, front matter, sizes.

``documents``: ``doc_id``, ``path`` and ``text``. A page is named by its first heading of level one, else
by its file. Names are compared in lower case and trimmed. Links are counted per target before any
join, so a target that many pages name is one row there.

Defined cases: null and empty texts are pages without words, links and front matter; pages of one
name count as one; a link of a page to itself doesn't save it from being an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.constants import PAGE_TYPES

THIN_WORDS = 100
OVERSIZED_WORDS = 2000
MISSING_PAGES = 3
INDEX = "index"
#: A wiki link; its target is the group.
LINK = r"\[\[([^\[\]|#\n]+)(?:[|#][^\]\n]*)?\]\]"


def body_of(text: Column) -> Column:
    """Text with one kind of line end and without a byte order mark."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "^﻿", "")


def front_matter(body: Column) -> Column:
    """Text between the marks at the start of a page; empty without them."""
    return F.regexp_extract(body, r"^---\n((?:[^\n]*\n)*?)---(?:\n|$)", 1)


def stripped(text: Column) -> Column:
    """Text without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def front_field(matter: Column, name: str) -> Column:
    return F.nullif(stripped(F.regexp_extract(matter, rf"(?md)^{name}:([^\n]*)$", 1)), F.lit(""))


def page_name(body: Column, path: Column) -> Column:
    heading = stripped(F.regexp_extract(body, r"(?md)^# +([^\n]+)$", 1))
    file = F.regexp_replace(F.regexp_extract(F.coalesce(path, F.lit("")), "[^/]*$", 0), r"\.[^.]+$", "")
    return F.lower(F.when(heading != "", heading).otherwise(file))


def word_count(body: Column) -> Column:
    return F.size(F.filter(F.split(body, "[ \t\n\f\r]+"), lambda w: w != ""))


def pages(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``name``, ``type``, ``created``, ``updated``, ``tags`` (array), ``words`` and ``body``."""
    body, matter = F.col("body"), F.col("matter")
    rows = documents.select("doc_id", "path", body_of(F.col("text")).alias("body")).withColumn("matter", front_matter(body))
    tags = F.split(F.regexp_replace(F.coalesce(front_field(matter, "tags"), F.lit("")), r"[\[\]]", ""), ",")
    return rows.select(
        "doc_id", page_name(body, F.col("path")).alias("name"), *[front_field(matter, n).alias(n) for n in ("type", "created", "updated")],
        F.filter(F.transform(tags, lambda t: stripped(t)), lambda t: t != "").alias("tags"), (matter != "").alias("has_front_matter"),
        front_field(matter, "title").isNotNull().alias("has_title"), word_count(body).alias("words"), "body",
    )


def links(table: DataFrame) -> DataFrame:
    """``doc_id``, ``name`` of the page and ``target`` of each wiki link."""
    found = F.regexp_extract_all("body", F.lit(LINK), 1)
    return table.select("doc_id", "name", F.explode(found).alias("target")).withColumn("target", F.lower(stripped(F.col("target")))).filter(F.col("target") != "")


def page_names(table: DataFrame) -> DataFrame:
    return table.filter(F.col("name") != "").select(F.col("name").alias("target")).distinct()


def broken_links(table: DataFrame) -> DataFrame:
    """Link targets without a page and the number of pages that name them."""
    targets = links(table).groupBy("target").agg(F.count_distinct("doc_id").alias("pages"))
    return targets.join(page_names(table), "target", "left_anti")


def mentioned_missing(table: DataFrame, least: int = MISSING_PAGES) -> DataFrame:
    """Missing pages that at least ``least`` pages name."""
    return broken_links(table).filter(F.col("pages") >= least)


def orphans(table: DataFrame) -> DataFrame:
    """Names of pages that no other page links to."""
    linked = links(table).filter(F.col("target") != F.col("name")).select("target").distinct()
    return page_names(table).join(linked, "target", "left_anti").select(F.col("target").alias("name"))


def index_drift(table: DataFrame) -> DataFrame:
    """Index entries without a page (``missing page``) and pages without an entry (``not listed``)."""
    found = F.regexp_extract_all("body", F.lit(LINK), 1)
    of_index = F.transform(found, lambda t: F.struct(F.lower(stripped(t)).alias("target"), F.lit(True).alias("listed")))
    own = F.array(F.struct(F.col("name").alias("target"), F.lit(False).alias("listed")))
    # one scan: a page gives its own name, the index what it lists
    rows = table.select(F.explode(F.when(F.col("name") == INDEX, of_index).otherwise(own)).alias("r")).select("r.*").filter(F.col("target") != "")
    sides = rows.groupBy("target").agg(F.bool_or("listed").alias("listed"), F.bool_or(~F.col("listed")).alias("there"))
    drift = F.when(F.col("listed") & ~F.col("there"), "missing page").when(F.col("there") & ~F.col("listed"), "not listed")
    return sides.select("target", drift.alias("drift")).filter("drift is not null")


def sizes(table: DataFrame) -> DataFrame:
    """Pages that are thin or oversized."""
    size = F.when(F.col("words") < THIN_WORDS, "thin").when(F.col("words") > OVERSIZED_WORDS, "oversized")
    return table.select("doc_id", "words", size.alias("size")).filter(F.col("size").isNotNull())


def format_issues(table: DataFrame) -> DataFrame:
    """``doc_id`` and ``issue`` of every breach of the page format."""
    issues = F.array(
        F.when(F.col("type").isNull(), F.lit("no type")).when(~F.col("type").isin(*PAGE_TYPES), F.lit("unknown type")),
        F.when(F.size("tags") == 0, F.lit("no tags")),
        F.when(F.col("has_title"), F.lit("title in front matter")),
        F.when(F.col("body").rlike(r"(?md)^# +[^\n]"), F.lit("heading of level one")),
        F.when(~F.col("body").rlike(r"(?md)^## Sources *$"), F.lit("no sources")),
    )
    return table.select("doc_id", F.explode(issues).alias("issue")).filter(F.col("issue").isNotNull())


def log_entries(table: DataFrame) -> DataFrame:
    """``doc_id``, ``date``, ``verb`` and ``subject`` of each log heading."""
    heading = r"(?md)^## \[(\d{4}-\d{2}-\d{2})\] (\w+) \| ([^\n]*)$"
    rows = table.select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(heading), 0)).alias("line"))
    return rows.select("doc_id", *[F.regexp_extract("line", heading, i + 1).alias(n) for i, n in enumerate(("date", "verb", "subject"))])


def tag_counts(table: DataFrame) -> DataFrame:
    """Pages of each tag; few of them mark a weak area."""
    return table.select("doc_id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("pages"))


def sources_of(table: DataFrame) -> DataFrame:
    """Links below the heading of sources: ``doc_id`` and ``source``."""
    below = F.regexp_extract("body", r"(?md)^## Sources *\n((?:[^\n]*\n?)*)", 1)
    return links(table.withColumn("body", below)).select("doc_id", F.col("target").alias("source")).distinct()


def undistilled(files: DataFrame, insights: DataFrame) -> DataFrame:
    """Source files (``dir``, ``name``) that no insight (``source``) names."""
    return files.filter(F.col("dir") == "archive/sources").join(insights.select(F.regexp_extract("source", "[^/]*$", 0).alias("name")).distinct(), "name", "left_anti")


def malformed_names(files: DataFrame) -> DataFrame:
    """Active insights whose file name isn't ``YYYY-MM-DD-slug.md``."""
    return files.filter((F.col("dir") == "insights") & ~F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}-[a-z0-9]+(-[a-z0-9]+)*\.md$"))


def duplicate_texts(documents: DataFrame) -> DataFrame:
    """Texts that several documents share: the least ``doc_id`` and the number of ``copies``.

    Texts meet by their hash, so none is shuffled.
    """
    hashed = documents.filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1").drop("digest")


def upserted(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with those of equal keys replaced by the changes."""
    return existing.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def archived(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files (``dir``, ``name``) with their ``status``: archived once they are ``processed`` (``name``), else what their
    directory says."""
    done = processed.select("name").distinct().withColumn("_done", F.lit(True))
    by_dir = F.when(F.col("dir").startswith("archive"), "archived").otherwise("active")
    return files.join(done, "name", "left").withColumn("status", F.when(F.col("_done"), "archived").otherwise(by_dir)).drop("_done")


def log_line(date: Column, verb: Column, subject: Column) -> Column:
    """Heading of an entry for the append-only log; write entries with mode ``append``."""
    return F.concat(F.lit("## ["), date, F.lit("] "), verb, F.lit(" | "), subject)
