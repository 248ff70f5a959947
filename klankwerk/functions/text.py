"""Text, byte and path functions. All take and return columns; null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from klankwerk.schemas import TEXT_LENGTH

AUDIO_SUFFIXES = ("mp3", "wav", "flac", "m4a", "aac", "ogg", "wma")


def strip(x: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def not_blank(x: Column) -> Column:
    """Whether there is anything but white space; false for null."""
    return F.coalesce(F.length(strip(x)) > 0, F.lit(False))


def strip_special_tokens(x: Column) -> Column:
    """Every ``<|...|>`` taken out, then white space off both ends."""
    return strip(F.regexp_replace(x, r"<\|.*?\|>", ""))


def tags_to_bytes(x: Column, speakers: int = 4) -> Column:
    """``[S1]`` to ``[S<speakers>]`` as the characters 1 to ``speakers``."""
    for k in range(1, speakers + 1):
        x = F.replace(x, F.lit(f"[S{k}]"), F.lit(chr(k)))
    return x


def byte_tokens(x: Column, length: int = TEXT_LENGTH, speakers: int = 4) -> Column:
    """UTF-8 bytes with speaker tags replaced, cut and zero-padded to ``length``; null and '' are all zeros.

    The cut is by bytes and may part a character. Bytes are cut before they become numbers, two hex digits each.
    """
    raw = F.substring(F.encode(tags_to_bytes(F.coalesce(x, F.lit("")), speakers), "UTF-8"), 1, length)
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), 1)
    return pad(F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int")), length)


def pad(x: Column, length: int, value: int = 0) -> Column:
    """An array cut and filled up to ``length``."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(value), length)), 1, length)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    """Name of the folder a path lies in; '' where there is none."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Last suffix in lower case, without the dot; '' where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def is_audio(path: Column, suffixes: tuple[str, ...] = AUDIO_SUFFIXES) -> Column:
    return suffix(path).isin(*suffixes)


def chunk_path(source: Column, chunk_file: Column) -> Column:
    """Where a chunk of a source lies: parent folder, stem, chunk file."""
    return F.concat_ws("/", parent_name(source), stem(source), file_name(chunk_file))


def object_key(path: Column) -> Column:
    """A listed path without scheme and bucket."""
    return F.regexp_replace(path, r"^[a-z0-9]+://[^/]+/", "")


def shard_name(stem_name: str, shard: Column, shards: Column, ending: str = ".parquet") -> Column:
    """``<stem>_shard_001<ending>`` for shard 0 of several; without a number where it is the only one."""
    number = F.lpad((shard + 1).cast("string"), F.greatest(F.lit(3), F.length((shard + 1).cast("string"))), "0")
    return F.when(shards == 1, F.lit(f"{stem_name}{ending}")).otherwise(F.concat(F.lit(f"{stem_name}_shard_"), number, F.lit(ending)))


def run_name(stem_name: str, at: Column) -> Column:
    """``<stem>_20240301-174500`` of a time, in the session's time zone."""
    return F.concat(F.lit(f"{stem_name}_"), F.date_format(at, "yyyyMMdd-HHmmss"))
