"""Normal forms of captions and other texts."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unescape_html(text: Column) -> Column:
    """Text with HTML entities resolved; Spark has no such function."""

    @F.arrow_udf(T.StringType())
    def unescape(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else html.unescape(t) if "&" in t else t for t in batch.to_pylist()], pa.string())

    return unescape(text)


def collapse_space(text: Column) -> Column:
    """White space, also of other scripts, collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tight_marks(text: Column) -> Column:
    """No white space before ``, . ; : ! ?``."""
    return F.regexp_replace(text, r"(?U)\s+([,.;:!?])", "$1")


def caption_text(text: Column) -> Column:
    """Normal form of a caption: entities resolved, tags taken out, white space collapsed."""
    return tight_marks(collapse_space(F.regexp_replace(unescape_html(text), "<[^>]+>", "")))


def spoken_text(text: Column) -> Column:
    """Normal form of a transcript text: white space collapsed, also inside brackets."""
    plain = tight_marks(collapse_space(text))
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)([(\[{])\s+", "$1"), r"(?U)\s+([)\]}])", "$1")


def caption_tokens(text: Column) -> Column:
    """Words of a text in lower case without marks; a mark alone gives an empty one."""
    words = F.filter(F.split(collapse_space(text), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"(?U)[^\w']+", ""))


def language_form(language: Column) -> Column:
    """Language tag in lower case with hyphens."""
    return F.replace(F.lower(language), F.lit("_"), F.lit("-"))


def base_language(language: Column) -> Column:
    """Part of a language tag before its first hyphen."""
    return F.substring_index(language_form(language), "-", 1)


def quoted(value: Column) -> Column:
    """A text as JSON string, for YAML."""
    wrapped = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def abbreviated(count: Column) -> Column:
    """1500 as 1.5K, 2300000 as 2.3M."""
    return (
        F.when(count >= 1_000_000, F.concat(F.format_string("%.1f", count / 1e6), F.lit("M")))
        .when(count >= 1_000, F.concat(F.format_string("%.1f", count / 1e3), F.lit("K")))
        .otherwise(count.cast("string"))
    )


def ellipsis(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substr(text, F.lit(1), F.lit(most - 1))), F.lit("…"))).otherwise(text)


def replace_first(text: Column, mark: str, value: Column) -> Column:
    """The first ``mark`` replaced by a value, taken literally."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), value, F.substr(text, at + len(mark)))).otherwise(text)


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """A template with the first ``{{name}}`` of each value filled; an empty value takes its mark and the two line
    ends behind it out, and leaves a mark without them as it is."""
    for name, value in values.items():
        mark = "{{" + name + "}}"
        kept = F.coalesce(value, F.lit(""))
        template = F.when(kept != "", replace_first(template, mark, kept)).otherwise(replace_first(template, f"{mark}\n\n", F.lit("")))
    return template
