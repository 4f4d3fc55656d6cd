"""Names, ends and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def component(text: Column) -> Column:
    """Safe as part of a path."""
    clean = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_"), r"\.{2,}", ".")
    clean = F.btrim(clean, F.lit("."))
    return F.when(clean == "", "unknown").otherwise(clean)


def carved_path(file_type: Column, start: Column, extension: Column) -> Column:
    """<type>/<type>_<start, twelve hex digits at least>.<ext>"""
    kind = component(file_type)
    return F.concat(kind, F.lit("/"), kind, F.lit("_"), F.format_string("%012X", start), F.lit("."), F.lower(component(extension)))


def global_end(start: Column, size: Column) -> Column:
    """The last byte; the start if there is none."""
    return F.when(size == 0, start).otherwise(start + size - 1)


def webkit_time(micros: Column) -> Column:
    """Microseconds since 1601; null when not positive or before 1970."""
    return unix_time(micros - F.lit(11644473600000000))


def unix_time(micros: Column) -> Column:
    """Microseconds since 1970; null when not positive."""
    return F.when(micros > 0, F.timestamp_micros(micros)).cast("timestamp_ntz")


# Names of the two browsers' visit types, by number.
TRANSITIONS = ("link", "typed", "auto_bookmark", "auto_subframe", "manual_subframe", "generated", "start_page", "form_submit", "reload", "keyword", "keyword_generated")
VISIT_TYPES = ("link", "typed", "bookmark", "embed", "redirect_permanent", "redirect_temporary", "download", "framed_link")


def transition_label(transition: Column) -> Column:
    """Of the low eight bits."""
    names = F.array(*map(F.lit, TRANSITIONS))
    kind = transition.bitwiseAND(F.lit(0xFF)).cast("int")
    return F.when(transition.isNotNull(), F.coalesce(F.get(names, kind), F.lit("other")))


def visit_type_label(kind: Column) -> Column:
    names = F.array(*map(F.lit, VISIT_TYPES))
    return F.when(kind.isNotNull(), F.coalesce(F.get(names, (kind - 1).cast("int")), F.lit("other")))


def pick(df, *names: str, kind: str = "string") -> Column:
    """The first column that the table has, in any case, else null."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[n.lower()] for n in names if n.lower() in have), None)
    return F.col(found).cast(kind) if found else F.lit(None).cast(kind)
