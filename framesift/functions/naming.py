"""Output names: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = '<>:"/\\|?*'


def _joined(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.nullif(p, F.lit("")) for p in parts])


def rank_text(rank: Column) -> Column:
    return F.when(rank < 1000, F.lpad(rank.cast("string"), 3, "0")).otherwise(rank.cast("string"))


def person_part(person_id: Column) -> Column:
    return F.when(person_id.isNotNull(), F.concat(F.lit("person_"), person_id.cast("string")))


def full_frame(video: Column, pose: Column, head: Column, shot: Column, rank: Column, person_id: Column, extension: str = "png") -> Column:
    return F.concat(_joined(video, person_part(person_id), pose, head, shot, rank_text(rank)), F.lit("." + extension))


def face_crop(video: Column, head: Column, rank: Column, person_id: Column, extension: str = "png") -> Column:
    return F.concat(_joined(video, person_part(person_id), F.lit("face"), head, rank_text(rank)), F.lit("." + extension))


def stem(name: Column) -> Column:
    """The name without its extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)


def with_suffix(name: Column, suffix: Column) -> Column:
    """The suffix before the extension."""
    return F.concat(stem(name), suffix, extension(name))


def crop_suffixed(name: Column) -> Column:
    return with_suffix(name, F.lit("_crop"))


def plain(text: Column) -> Column:
    """For names: lower case, spaces as dashes; null is empty."""
    return F.coalesce(F.lower(F.replace(text, F.lit(" "), F.lit("-"))), F.lit(""))


def is_valid(name: Column, video: Column) -> Column:
    """No reserved character, at most 255 characters, starts with the video's name, a whole number after `person`."""
    person = F.regexp_extract(name, r"_person_([^_]*)", 1)
    odd = F.contains(name, F.lit("_person_")) & ~person.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return (name != "") & ~name.rlike(r'[<>:"/\\|?*]') & (F.char_length(name) <= 255) & F.startswith(name, video) & ~odd


def sanitized(name: Column) -> Column:
    out = F.regexp_replace(F.translate(name, RESERVED, "_" * len(RESERVED)), r"^[. ]+|[. ]+$", "")
    return F.when(out == "", "unnamed").otherwise(out)
