"""Names, paths and dictionaries as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def sanitize(name: Column) -> Column:
    """Every character but letters, digits, dot, underscore and hyphen becomes an underscore; empty gives one."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
    return F.when(clean == "", "_").otherwise(clean)


def with_extension(name: Column, extension: str) -> Column:
    """Forces an extension: keeps one that is equal but for case, replaces another, else appends."""
    found = F.regexp_extract(name, r"\.([^./]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    return F.when(F.lower(found) == extension.lower(), name).when(found != "", F.concat(stem, F.lit("." + extension))).otherwise(F.concat(name, F.lit("." + extension)))


def ordinal_path(folder: str, ordinal: Column, name: Column) -> Column:
    """folder/NNN-name; ordinals over 999 widen."""
    digits = ordinal.cast("string")
    return F.concat(F.lit(folder + "/"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), F.lit("-"), name)


def strip_ordinal(name: Column) -> Column:
    """Drops a numeric prefix and its hyphen."""
    return F.regexp_replace(name, "^[0-9]*-", "")


def scale_suffix(name: Column) -> tuple[Column, Column]:
    """(base, scale) of a name that may end in @1x, @2x or @3x; scale 1 without."""
    found = F.regexp_extract(name, "@([123])x$", 1)
    return F.regexp_replace(name, "@[123]x$", ""), F.when(found == "", 1).otherwise(found.try_cast("int"))


def encode_open(name: Column, known: Mapping[str, int], prefix: str) -> Column:
    """Id of a name: the dictionary's, or the number after ``prefix``, else null."""
    out = F.regexp_extract(name, f"^{prefix}([0-9]+)$", 1).try_cast("int")
    for text, code in known.items():
        out = F.when(name == text, F.lit(code)).otherwise(out)
    return out


def decode_open(code: Column, known: Mapping[str, int], prefix: str) -> Column:
    """Name of an id; unknown ids become ``prefix`` and the number."""
    out = F.concat(F.lit(prefix), code.cast("string"))
    for text, number in known.items():
        out = F.when(code == number, F.lit(text)).otherwise(out)
    return out


def hex_code(code: Column) -> Column:
    """0x and eight lower-case hexadecimal digits."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(code), 8, "0")))


def sniff(head: Column) -> Column:
    """Kind of a text payload by its first characters, vector text before containers."""
    start = F.ltrim(F.substring(head, 1, 16))
    return (
        F.when(start.startswith("<svg") | start.startswith("<?xml"), "svg")
        .when(F.lower(start).startswith("<!doctype"), "html")
        .when(head.startswith("%PDF"), "pdf")
        .when(start.startswith("{") | start.startswith("["), "json")
        .otherwise("text")
    )


def sniff_container(data: Column) -> Column:
    """svg, jpg, png, heic or pdf by a payload's first bytes; null for anything else."""
    start = lambda n, first=1: F.substring(data, first, n)
    text = F.ltrim(start(16).cast("string"))
    return (
        F.when(text.startswith("<svg") | text.startswith("<?xml"), "svg")
        .when(start(3) == F.lit(b"\xff\xd8\xff"), "jpg")
        .when(start(8) == F.lit(b"\x89PNG\r\n\x1a\n"), "png")
        .when((start(4, 5) == F.lit(b"ftyp")) & start(4, 9).isin(*[F.lit(x) for x in (b"heic", b"heix", b"hevc", b"mif1", b"msf1")]), "heic")
        .when(start(4) == F.lit(b"%PDF"), "pdf")
    )


def is_image_container(data: Column) -> Column:
    """Whether a payload is an image file of its own."""
    return F.coalesce(sniff_container(data).isin("jpg", "png", "heic"), F.lit(False))


def tag_of(text: Column) -> Column:
    """A record's tag from hexadecimal text, with or without 0x; null if it isn't one."""
    digits = F.regexp_extract(text, "^(?:0[xX])?([0-9A-Fa-f]{1,8})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def checked_hex(text: Column) -> Column:
    """Bytes of hexadecimal text; an odd number of digits or another character is an error."""
    wrong = F.when(F.length(text) % 2 == 1, "an odd number of digits").when(~text.rlike("^[0-9A-Fa-f]*$"), "not hexadecimal")
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("binary")).otherwise(F.unhex(text))
