"""Strings of configurations and headers: paths with formats, memory sizes, percentages, attribute stacks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The format tokens that sources and sinks are named by.
FORMATS = ("mha", "mhd", "nii", "nii.gz", "nrrd", "nrrd.gz", "gipl", "gipl.gz", "hdr", "img", "dcm", "dicom", "omezarr", "ome-zarr", "ome_zarr", "zarr", "tif", "tiff", "png", "jpg", "jpeg", "bmp", "h5", "itk.txt", "fcsv", "xml", "vtk", "npy")
FLAGS = ("a", "i")
UNITS = {"": 30, "b": 0, "k": 10, "kb": 10, "kib": 10, "m": 20, "mb": 20, "mib": 20, "g": 30, "gb": 30, "gib": 30, "t": 40, "tb": 40, "tib": 40}


def format_level(token: str) -> tuple[str, int]:
    """``omezarr@2`` -> its format and level; level 0 where none is named."""
    name, at, level = token.partition("@")
    if at and not level.isdigit():
        raise ValueError(f"{token!r}: a level is a number")
    return name, int(level or 0)


def path_spec(value: str, default: str = "mha", flags: tuple[str, ...] = FLAGS) -> tuple[str, str | None, str]:
    """``path[:flag]:format`` -> (path, flag, format). A drive letter's colon belongs to the path."""
    head = value[:2] if re.match(r"[A-Za-z]:[\\/]", value) else ""
    path, *rest = value[len(head) :].split(":")
    if len(rest) > 2:
        raise ValueError(f"{value!r}: expected path, flag and format")
    flag = None
    if rest and rest[0] in flags:
        flag = rest.pop(0)
    if len(rest) > 1:
        raise ValueError(f"{value!r}: a flag is one of {', '.join(flags)}")
    kind = rest[0] if rest else default
    if format_level(kind)[0] not in FORMATS:
        raise ValueError(f"{value!r}: unknown format {kind!r}")
    return head + path, flag, kind


def memory_bytes(text: Column) -> Column:
    """Bytes of ``24GB``, ``32 GiB``, ``512 mb``; a bare number counts GiB. Null where the text is no size."""
    clean = F.lower(F.trim(text))
    number = F.nullif(F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)\s*[a-z]*$", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(clean, r"^[0-9.]+\s*([a-z]*)$", 1)
    factor = F.create_map(*[F.lit(x) for name, power in UNITS.items() for x in (name, 2.0**power)])
    return F.floor(number * F.try_element_at(factor, unit))


def fraction(text: Column) -> Column:
    """``20%`` and ``0.2`` -> 0.2; null for anything else."""
    plain = F.trim(text)
    return F.when(plain.endswith("%"), F.rtrim(plain, F.lit("%")).try_cast("double") / 100).otherwise(plain.try_cast("double"))


def truth(text: Column) -> Column:
    """Whether a text is one of the words for true, null if for neither."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "yes", "on", "1"), True).when(word.isin("false", "no", "off", "0"), False)


def numbers(text: Column) -> Column:
    """``[1. 2. 3.]`` -> an array of doubles."""
    return F.transform(F.filter(F.split(F.regexp_replace(text, r"[\[\],]", " "), r"\s+"), lambda p: p != ""), lambda p: p.try_cast("double"))


# Attributes of a volume are stacks: key -> its values, the newest last. Keys with an underscore are no stacks.


def push(attributes: Column, key: str, value: Column) -> Column:
    """A new value on top of a key's stack; a key with an underscore is replaced."""
    held = F.coalesce(F.try_element_at(attributes, F.lit(key)), F.array().cast("array<string>"))
    stack = F.array(value.cast("string")) if "_" in key else F.concat(held, F.array(value.cast("string")))
    others = F.map_filter(attributes, lambda k, _: k != key)
    return F.map_concat(others, F.create_map(F.lit(key), stack))


def peek(attributes: Column, key: str) -> Column:
    """The newest value of a key, null without one."""
    return F.try_element_at(F.try_element_at(attributes, F.lit(key)), F.lit(-1))


def pop(attributes: Column, key: str) -> Column:
    """Without the newest value of a key; an empty stack goes."""
    shorter = F.transform_values(attributes, lambda k, v: F.when(k == key, F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))).otherwise(v))
    return F.map_filter(shorter, lambda _, v: F.size(v) > 0)
