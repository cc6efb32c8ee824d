"""Column expressions over file names, paths and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def part(name: Column, n: int, sep: str = "_") -> Column:
    return F.split_part(name, F.lit(sep), F.lit(n))


def individual(name: Column) -> Column:
    return F.upper(part(name, 1))


def individual_video(name: Column) -> Column:
    """First three parts of the upper-case stem, without separators."""
    return F.array_join(F.slice(F.split(F.upper(stem(name)), "_"), 1, 3), "")


def label_of(name: Column) -> Column:
    """The part before the first underscore, else before the first dash."""
    return F.when(name.contains("_"), part(name, 1)).otherwise(part(name, 1, "-"))


def group_of(individual_id: Column) -> Column:
    """The group of an individual; ids that are not four characters long are solitaries."""
    return F.when(F.length(individual_id) != 4, "SOLITARY").otherwise(F.substring(individual_id, 1, 2))


def recorded(name: Column) -> Column:
    return F.try_to_date(part(name, 3), "yyyyMMdd")


def clip(name: Column) -> Column:
    """Digits of the fourth part, as a number."""
    return F.regexp_replace(part(stem(name), 4), "[^0-9]", "").cast("int")


def source_video(name: Column) -> Column:
    """Lower-case base name (without extension) of the video that an image was cut from."""
    return F.lower(F.concat_ws("_", part(name, 2), part(name, 3), F.substring(part(stem(name), 4), 1, 3)))


def fold_number(folder: Column) -> Column:
    return F.element_at(F.split(folder, "-"), -1).cast("int")


def social_group(folder: Column) -> Column:
    """Group code of a folder named like `..._12 AB`; XX means none."""
    code = F.regexp_extract(folder, r"^.*?_\d+\s([A-Z]{2})$", 1)
    return F.nullif(F.nullif(code, F.lit("XX")), F.lit(""))


def crop_path(base: str, id_: Column) -> Column:
    return F.concat_ws("/", F.lit(base), (id_ % 256).cast("string"), (id_ % 65536).cast("string"), F.concat(id_.cast("string"), F.lit(".png")))


def hashed(id_: Column, seed: int) -> Column:
    """A stable pseudo-random order of ids below 2^31; ties are broken by the id."""
    return (id_ * 2654435761 + seed) % 4294967296
