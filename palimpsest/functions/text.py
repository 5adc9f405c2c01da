"""Text and id expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 29 code points that Python's ``str.strip`` removes.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without Unicode white space at its ends; null is empty."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def char_len(text: Column) -> Column:
    return F.length(strip(text)).cast("long")


def digest(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def doc_name(doc_id: Column) -> Column:
    """The padded name ``shard_SSSSS_RRRRR`` of a numeric id, a thousand rows a shard."""
    return F.format_string("shard_%05d_%05d", F.floor(doc_id / 1000).cast("long"), F.pmod(doc_id, F.lit(1000)).cast("long"))


def shard_name(shard: Column, row: Column) -> Column:
    return F.format_string("shard_%05d_%05d", shard.cast("long"), row.cast("long"))


def packed(name: Column) -> Column:
    """shard * 100000 + row of a padded name."""
    return F.substring(name, 7, 5).cast("long") * 100_000 + F.substring(name, 13, 5).cast("long")


def unpadded(name: Column) -> Column:
    return F.regexp_replace(name, r"^(shard_[0-9]+)_0*([0-9]+)$", "$1_$2")


def padded(name: Column) -> Column:
    parts = F.split(name, "_")
    return F.when(name.rlike(r"^shard_[0-9]+_[0-9]+$"), F.concat_ws("_", F.lit("shard"), F.lpad(parts[1], 5, "0"), F.lpad(parts[2], 5, "0"))).otherwise(name)


def is_full_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^shard_[0-9]{5}_[0-9]+$"), F.lit(False))


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def preview(text: Column, size: int = 500) -> Column:
    """The start of a text with single spaces for white space."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, size)


def page(text: Column, offset: int = 0, limit: int = 200) -> Column:
    """``limit`` lines of a text from the line ``offset`` (from 0)."""
    return F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n", -1), offset + 1, limit), "\n")


def bucket_label(value: Column, edges: list[tuple[int, int | None]], dash: str = "-") -> Column:
    """The label ``lo-hi`` or ``lo+`` of the inclusive bucket that holds a value; null outside all."""
    out = None
    for lo, hi in edges:
        name = str(lo) if hi == lo else f"{lo}{dash}{hi}" if hi is not None else f"{lo}+"
        test = (value >= lo) & (value <= hi) if hi is not None else value >= lo
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def clean_clue(clue: Column, separator: str) -> Column:
    """What stands before the assistant's separator, stripped."""
    return strip(F.substring_index(clue, separator, 1))


def marker_index(marker: Column) -> Column:
    """A one-based marker such as ``3.0`` as an index from 0."""
    return marker.cast("double").cast("int") - 1


#: The headings of a final answer, in order.
SECTIONS = ("Answer", "Explanation", "Exact Answer", "Confidence")


def section(answer: Column, name: str, following: str | None) -> Column:
    """The part of a final answer under a heading, up to the heading that follows."""
    end = rf"(?=\n\s*{following}:)" if following else r"\z"
    return strip(F.regexp_extract(answer, rf"(?s)(?:^|\n)\s*{name}:(.*?){end}", 1))


def human_bytes(size: Column) -> Column:
    """A size with a unit, for reports."""
    out = F.format_string("%.0f B", size.cast("double"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(size >= 1000**power, F.format_string(f"%.1f {unit}", size / 1000**power)).otherwise(out)
    return out
