"""Preference of subtitle candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.constants import FORMAT_SCORES
from sparkloom.functions.text import base_language, language_form


def language_score(language: Column, preferred: list[str], detected: str | None = None) -> Column:
    """300 less 20 per place for a preferred language, 260 likewise for the same base; else 220 or 180 for
    the detected language or its base; else 0."""
    own, base = language_form(language), base_language(language)

    def match(tag: str, exact: int, same_base: int) -> Column:
        form = tag.lower().replace("_", "-")
        return F.when(own == form, exact).when((base == form.split("-")[0]) | own.startswith(form.split("-")[0] + "-"), same_base).otherwise(0)

    best = F.greatest(F.lit(0), F.lit(0), *[match(tag, 300 - 20 * i, 260 - 20 * i) for i, tag in enumerate(preferred)])
    return F.coalesce(F.when(best > 0, best).otherwise(match(detected, 220, 180) if detected else F.lit(0)), F.lit(0))


def candidate_score(kind: Column, language: Column, extension: Column, preferred: list[str], detected: str | None = None) -> Column:
    """Manual before automatic, then language, then format; English itself gets 10 more."""
    formats = F.create_map(*[F.lit(x) for pair in FORMAT_SCORES.items() for x in pair])
    english = F.when(language_form(language) == "en", 10).otherwise(0)
    return F.when(kind == "manual", 1000).otherwise(500) + language_score(language, preferred, detected) + F.coalesce(formats[extension], F.lit(0)) + english


def subtitle_candidates(metadata: DataFrame) -> DataFrame:
    """Candidates of metadata with maps ``subtitles`` and ``automatic_captions`` of language to an array of
    (ext, url, name): one row each with ``source_kind``, ``language`` and ``ordinal``, manual ones first.

    Live chat, entries without URL and formats that can't be read are left out.
    """

    def of(column: str, kind: str) -> Column:
        entries = F.map_entries(F.coalesce(F.col(column), F.create_map().cast("map<string,array<struct<ext:string,url:string,name:string>>>")))
        return F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda v: F.struct(F.lit(kind).alias("source_kind"), e["key"].alias("language"), F.lower(v["ext"]).alias("ext"), v["url"].alias("url"), v["name"].alias("name")))))

    rows = metadata.select("id", F.posexplode(F.concat(of("subtitles", "manual"), of("automatic_captions", "automatic"))).alias("ordinal", "c")).select("id", "ordinal", "c.*")
    return rows.filter((F.col("language") != "live_chat") & (F.coalesce("url", F.lit("")) != "") & F.col("ext").isin(*FORMAT_SCORES))


def best_candidates(candidates: DataFrame, group: str, preferred: list[str], detected: str | None = None) -> DataFrame:
    """The candidate of the highest score of each group; of equal ones the first."""
    score = candidate_score(F.col("source_kind"), F.col("language"), F.col("ext"), preferred, detected)
    scored = candidates.withColumn("score", score)
    others = F.struct(*[c for c in scored.columns if c != group])
    return scored.groupBy(group).agg(F.max_by(others, F.struct("score", (-F.col("ordinal")).alias("first"))).alias("best")).select(group, "best.*")
