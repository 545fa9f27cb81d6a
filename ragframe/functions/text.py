"""Text functions as Column expressions: normal forms, slugs, years, tokens, numbers."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without accents that carry no content, and characters that documents use as bullets.
STOPWORDS = ("la", "va", "cua", "cho", "theo", "nam", "tren", "duoc", "voi", "mot", "cac", "nhung", "trong", "tai", "co", "o", "tu", "ve", "thi", "do", "day")
BULLETS = "•➢"
INVISIBLE = "﻿​‌‍"


@cache
def accent_table() -> tuple[str, str]:
    """Letters that are one base letter under their accents, and these letters."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for c in map(chr, range(0x80, 0x2000)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if plain != c and len(plain) == 1:
            src.append(c)
            dst.append(plain)
    return "".join(src), "".join(dst)


def strip_accents(c: Column) -> Column:
    src, dst = accent_table()
    return F.regexp_replace(F.translate(c, src, dst), r"\p{Mn}", "")


def norm_match(c: Column) -> Column:
    """For matching: no accents, lower case, no punctuation, single spaces."""
    plain = F.lower(strip_accents(c))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case without accents; a barred d stays."""
    src, dst = accent_table()
    return F.lower(F.regexp_replace(F.translate(c, src[2:], dst[2:]), r"\p{Mn}", ""))


def normalize_line(c: Column) -> Column:
    """One line: invisible characters go, bullets at its start become a dash, others a space; single spaces."""
    t = F.regexp_replace(c, f"[{INVISIBLE}]", "")
    t = F.regexp_replace(t, f"^(?U)\\s*[{BULLETS}][{BULLETS}\\s]*", "- ")
    t = F.regexp_replace(t, f"[{BULLETS}]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_block(c: Column) -> Column:
    """Several lines: one line-feed form, no stray combining marks, no blanks at line ends."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    t = F.regexp_replace(t, "([ \t])[̀-ͯ]+", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+(?=\n|\z)", ""), r"^\s+|\s+\z", "")


def normalize_block_joined(c: Column) -> Column:
    """normalize_block(), with runs of blank lines joined to one."""
    return F.regexp_replace(normalize_block(c), r"\n(?:[ \t]*\n){2,}", "\n\n")


def _slug(c: Column, mark: str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", mark), F.lit(mark))


def slugify(c: Column) -> Column:
    return _slug(c, "-")


def slug_underscore(c: Column) -> Column:
    return _slug(c, "_")


def slug_from_url(url: Column) -> Column:
    """Slug of host and path, 120 characters at most; of a URL without either, a digest."""
    place = F.concat(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    unescaped = F.coalesce(F.try_url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))), place)
    slug = F.substring(slugify(unescaped), 1, 120)
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("link-"), F.substring(F.sha1(url.cast("binary")), 1, 12)))


def normalize_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\.txt$", "")


def title_from_stem(c: Column) -> Column:
    """Dashes and underscores become spaces; every letter after another kind of character is a capital."""
    return F.initcap(F.trim(F.regexp_replace(c, "[-_]+", " ")))


def _year_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x.rlike(r"^20\d{2}$"))


def _stem_year(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), r"(20\d{2})", 1), F.lit(""))


def guess_year(path: Column, otherwise: Column) -> Column:
    """The last path part that is a year, else the first year in the stem, else `otherwise`."""
    return F.coalesce(F.try_element_at(_year_parts(path), F.lit(-1)), _stem_year(path), otherwise)


def infer_year(path: Column) -> Column:
    """The first path part that is a year, else the first year in the stem, else 'unknown'."""
    return F.coalesce(F.try_element_at(_year_parts(path), F.lit(1)), _stem_year(path), F.lit("unknown"))


def tokens(c: Column) -> Column:
    """Words of the matching form."""
    return F.filter(F.split(norm_match(c), " "), lambda x: x != "")


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Distinct tokens of two characters or more that carry content, in order."""
    return F.array_except(F.filter(tokens(c), lambda x: F.length(x) > 1), F.array(*[F.lit(x) for x in STOPWORDS]))


def clean_name(c: Column) -> Column:
    """Single spaces, and no blanks, dashes or semicolons around."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" -;"))


def uuid5_url(name: Column) -> Column:
    """Version 5 UUID in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def safe_float(c: Column) -> Column:
    """A number, or 0 for nothing and for what is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))
