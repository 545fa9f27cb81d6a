"""Chunks: greedy packing of paragraphs and words, merging of small sections, and the emitted form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    least: int
    most: int
    merged: int


# Named presets.
PROFILES = {"balanced": Profile(120, 700, 2), "max": Profile(80, 550, 1), "graph": Profile(900, 2800, 5)}


def pack(blocks: Column, sep: str, most: int) -> Column:
    """Blocks joined from left to right while a part stays within `most` characters.

    The open part is held apart from the finished ones, so a step copies the open part alone.
    """
    zero = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("done"))

    def add(a: Column, b: Column) -> Column:
        fits = F.length(a["open"]) + len(sep) + F.length(b) <= most
        return F.when(a["open"].isNull(), F.struct(b.alias("open"), a["done"].alias("done"))).when(fits, F.struct(F.concat(a["open"], F.lit(sep), b).alias("open"), a["done"].alias("done"))).otherwise(F.struct(b.alias("open"), F.concat(a["done"], F.array(a["open"])).alias("done")))

    return F.aggregate(blocks, zero, add, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def packed(docs: DataFrame, text: str, sep: str, most: int) -> DataFrame:
    """docs with `parts`: blocks between separators, blank ones left out, packed."""
    blocks = F.filter(F.split(F.col(text), sep), lambda x: F.trim(x) != "")
    return docs.withColumn("parts", pack(blocks, sep, most))


def wrapped(docs: DataFrame, text: str, most: int) -> DataFrame:
    """docs with `parts`: words packed into lines."""
    words = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda x: x != "")
    return docs.withColumn("parts", pack(words, " ", most))


def emitted(docs: DataFrame, text: str, title: str, most: int) -> DataFrame:
    """A row for each chunk: doc_id, chunk_id (from 1), text with its context header, and counts."""
    x = packed(docs, text, "\n", most).select("doc_id", F.col(title).alias("title"), F.posexplode("parts").alias("i", "body"))
    head = F.concat(F.lit("<document_context>\nTài liệu: "), "title", F.lit("\n</document_context>\n"))
    full = F.concat(head, "body")
    return x.select("doc_id", (F.col("i") + 1).alias("chunk_id"), full.alias("text"), F.length(full).cast("long").alias("char_count"), F.size(F.filter(F.split(full, "\n"), lambda y: F.trim(y) != "")).cast("long").alias("line_count"))


def merged(sections: Column, profile: Profile, is_table: str = "is_table", text: str = "text") -> Column:
    """An array of sections (structs of text, anchor and is_table), in which a short one takes in those after it.

    A section takes in the next while it is shorter than the least length, has taken in fewer than `merged`, neither is a table and
    both have one anchor.
    """
    kind = "struct<text:string,anchor:string,is_table:boolean,used:int>"
    zero = F.array().cast(f"array<{kind}>")

    def add(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        one = F.struct(s[text].alias("text"), s["anchor"].alias("anchor"), s[is_table].alias("is_table"), F.lit(0).alias("used"))
        joins = (F.length(last["text"]) < profile.least) & (last["used"] < profile.merged) & ~last["is_table"] & ~s[is_table] & last["anchor"].eqNullSafe(s["anchor"])
        grown = F.struct(F.concat(last["text"], F.lit("\n\n"), s[text]).alias("text"), last["anchor"].alias("anchor"), last["is_table"].alias("is_table"), (last["used"] + 1).alias("used"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(one)))

    return F.aggregate(sections, zero, add)
