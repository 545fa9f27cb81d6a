"""Marked-up documents as sections and chunks, one document at a time in Arrow batches: no document's lines are shuffled.

A section has the path of headings above it and its lines. All that is cut to a length (paragraphs, lines, rows, words, numbered
items) goes through one packer, `groups`, which sees lengths alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.operators.chunking import Profile

# Forms of headings, tables, numbered items and facts, and the words of the emitted context.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
TABLE_NAME = re.compile(r"^Bang\s+\d+$", re.I)
ROMAN = re.compile(r"^[IVXLCDM]+$", re.I)
NUMBERED = re.compile(r"(?:(?<=^)|(?<=[\s;]))\d+\.\s")
FACT = re.compile(r"^([^:\n]{2,80}):\s*(.+)$")
EQUIPMENT = "cac trang thiet bi chinh"
OPEN, CLOSE, DOCUMENT, PART = "<document_context>", "</document_context>", "Tài liệu: ", "Mục: "


@dataclass(frozen=True)
class Section:
    """Headings (level, text) from the outermost, and the lines below them."""

    path: tuple[tuple[int, str], ...] = ()
    lines: tuple[str, ...] = ()
    table: bool = field(default=False, compare=False)

    @property
    def names(self) -> list[str]:
        return [t for _, t in self.path]

    def body(self, skip: int = 0) -> str:
        """Headings but the first `skip` as marked lines, then the lines."""
        return "\n".join([*(f"{'#' * n} {t}" for n, t in self.path[skip:]), *self.lines]).strip()


def is_row(line: str) -> bool:
    return line.strip().startswith("- ") and " | " in line


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("- ").split(" | ")]


def _filled(line: str) -> list[str]:
    return [c for c in cells(line) if c not in ("", "-")]


def is_group_row(line: str) -> bool:
    """A roman number first: it heads the rows below."""
    own = _filled(line)
    return bool(own) and ROMAN.match(own[0]) is not None


def is_header_row(line: str) -> bool:
    """Neither a digit nor a roman number first, and half of the cells, two at least, of letters alone."""
    own = _filled(line)
    if not own or re.search(r"\d", own[0]) or ROMAN.match(own[0]):
        return False
    plain = sum(1 for c in own if re.search(r"[^\W\d_]", c) and not re.search(r"\d", c))
    return plain >= max(2, len(own) // 2)


def is_table(s: Section) -> bool:
    return bool(s.path and s.lines) and TABLE_NAME.match(s.path[-1][1]) is not None and all(map(is_row, s.lines))


def is_source_only(s: Section) -> bool:
    """Nothing but a line that names the source."""
    own = [x for x in s.lines if x.strip()]
    return len(own) == 1 and own[0].strip().lower().startswith("source:")


def is_sparse(s: Section, least: int) -> bool:
    return len(s.body()) < least and sum(1 for x in s.lines if x.strip()) <= 2


def is_inline_fact(text: str) -> bool:
    return ":" in text and len(text) <= 120


def is_low_value(s: Section, markers: tuple[str, ...], folded: Callable[[str], str]) -> bool:
    """A table whose first three lines name the equipment, or hold all markers."""
    if not is_table(s):
        return False
    plain = lambda t: " ".join(re.split(r"[\W_]+", t.lower())).strip()
    head = "\n".join(s.lines[:3])
    return EQUIPMENT in folded(head) or bool(markers) and all(plain(m) in plain(head) for m in markers)


def _trimmed(lines: list[str]) -> tuple[str, ...]:
    full = [i for i, x in enumerate(lines) if x.strip()]
    return tuple(lines[full[0] : full[-1] + 1]) if full else ()


def _events(text: str) -> Iterator[tuple[str, int, str]]:
    """What each line is: a heading, a row, a blank or other line, with the heading's level and the text."""
    for raw in text.splitlines():
        line = raw.rstrip()
        m = HEADING.match(line)
        if m:
            yield "heading", len(m[1]), m[2].strip()
        else:
            yield "blank" if not line else "row" if is_row(line) else "line", 0, line


def nested_sections(text: str) -> list[Section]:
    """Sections under their whole path of headings (variant A).

    A heading of level k closes all of its level or below. One without lines gives no section, but as an inline fact below another it
    is a line of the section above. A table's heading holds for the rows after it alone.
    """
    out: list[Section] = []
    path: tuple[tuple[int, str], ...] = ()
    held: list[str] = []
    table = fresh = False

    def close() -> None:
        nonlocal held, table
        own = _trimmed(held)
        if own:
            out.append(Section(path, own, table))
        elif fresh and not held and len(path) > 1 and is_inline_fact(path[-1][1]):
            out.append(Section(path[:-1], (path[-1][1],)))
        held, table = [], False

    for kind, level, line in _events(text):
        if table and kind == "blank":
            continue
        if table and kind != "row":
            ended = bool(path) and TABLE_NAME.match(path[-1][1])
            fresh = False
            close()
            path = path[:-1] if ended else path
        if kind == "heading":
            close()
            path = (*(h for h in path if h[0] < level), (level, line))
            table = level >= 2 and TABLE_NAME.match(line) is not None
            fresh = not table
        else:
            held.append(line)
    close()
    return out


def flat_sections(text: str) -> list[Section]:
    """A section for each heading, with or without lines (variant B); what follows a table's rows is one without heading."""
    out: list[Section] = []
    path: tuple[tuple[int, str], ...] = ()
    held: list[str] = []
    table = False

    def close() -> None:
        nonlocal held, path
        own = Section(path, _trimmed(held), table)
        if own.body():
            out.append(own)
        held, path = [], ()

    for kind, level, line in _events(text):
        if table and kind == "blank":
            continue
        if kind == "heading" or table and kind != "row":
            close()
            table = kind == "heading" and level >= 2 and TABLE_NAME.match(line) is not None
        if kind == "heading":
            path = ((level, line),)
        else:
            held.append(line)
    close()
    return out


def shared(a: Section, b: Section) -> int:
    """Headings that both paths begin with."""
    return next((i for i, (x, y) in enumerate(zip(a.path, b.path, strict=False)) if x != y), min(len(a.path), len(b.path)))


def _title(s: Section) -> str:
    return s.path[0][1] if s.path and s.path[0][0] == 1 else ""


def merged_nested(sections: list[Section], least: int, most: int) -> list[Section]:
    """Sparse sections take in those after them, `most` in all, where two headings or more stand above both and neither is a table."""
    out: list[Section] = []
    used = 0
    for s in sections:
        last = out[-1] if out else None
        joins = last is not None and used < most and is_sparse(last, least) and not is_table(last) and not is_table(s) and _title(last) == _title(s) and shared(last, s) >= 2
        if joins:
            more = s.body(shared(last, s)).splitlines()
            gap = [""] if more and last.lines and last.lines[-1].strip() else []
            out[-1] = replace(last, lines=_trimmed([*last.lines, *gap, *more]), table=False)
        else:
            out.append(s)
        used = used + 1 if joins else 1
    return out


def merged_flat(sections: list[Section], least: int, most: int) -> list[Section]:
    """Sections shorter than `least` take in those after them, `most` in all; tables stand alone (variant B)."""
    out: list[Section] = []
    used = 0
    for s in sections:
        last = out[-1] if out else None
        joins = last is not None and used < most and len(last.body()) < least and not is_table(last) and not is_table(s)
        if joins:
            out[-1] = replace(last, lines=_trimmed([*last.lines, "", *s.body().splitlines()]))
        else:
            out.append(s)
        used = used + 1 if joins else 1
    return out


def groups(lengths: list[int], gap: int, most: int, before: int = 0) -> list[tuple[int, int]]:
    """Ranges of items that, joined by `gap` characters after a beginning of `before` (0: none), have `most` at the most; one item at least."""
    out, start, size = [], 0, before
    for i, n in enumerate(lengths):
        joined = size + n + (gap if size else 0)
        if i > start and joined > most:
            out.append((start, i))
            start, size = i, before
            joined = size + n + (gap if size else 0)
        size = joined
    return [*out, (start, len(lengths))] if lengths else []


def packed(items: list[str], sep: str, most: int, head: str = "") -> list[str]:
    """Items joined from left to right within `most` characters, each part after the same head."""
    return [sep.join([head, *items[a:b]] if head else items[a:b]) for a, b in groups([len(x) for x in items], len(sep), most, len(head))]


def wrapped_words(text: str, most: int) -> list[str]:
    """Words joined within `most` characters. A longer word is cut into slices where it begins a part; after a full part it stays whole."""
    text = text.strip()
    if len(text) <= most:
        return [text]
    out: list[str] = []
    open_words: list[str] = []
    size = 0
    for w in text.split():
        if open_words and size + 1 + len(w) > most:
            out.append(" ".join(open_words))
            open_words, size = [w], len(w)
        elif not open_words and len(w) > most:
            out += [w[i : i + most] for i in range(0, len(w), most)]
        else:
            size += len(w) + bool(open_words)
            open_words.append(w)
    return [*out, " ".join(open_words)] if open_words else out


def numbered_row(line: str, most: int) -> list[str]:
    """A row whose last cell numbers its items, as rows of some items each; none where it doesn't."""
    front, bar, last = line.rpartition(" | ")
    at = [m.start() for m in NUMBERED.finditer(last)] if bar else []
    items = [x for a, b in zip(at, [*at[1:], len(last)], strict=True) if (x := last[a:b].strip(" ;"))]
    if len(items) < 2:
        return []
    front += bar
    parts = [p for x in items for p in wrapped_words(x, max(most - len(front), 120))]
    return [(front + "; ".join(parts[a:b])).strip() for a, b in groups([len(p) for p in parts], 2, max(1, most - len(front)))]


def cut_line(line: str, most: int) -> list[str]:
    """A line as lines of `most` characters: by its numbered items if it is a row and they fit, else by words."""
    line = line.strip()
    if len(line) <= most:
        return [line]
    rows = numbered_row(line, most) if is_row(line) else []
    return rows if rows and max(map(len, rows)) <= most else wrapped_words(line, most)


def cut_table(s: Section, most: int) -> list[str]:
    """A table's rows in parts, each after the headings, the header rows and the group row that stands above it; none without header or data."""
    rows = [x.rstrip() for x in s.lines if is_row(x)]
    n = next((i for i, x in enumerate(rows) if not is_header_row(x)), len(rows))
    head, data = rows[:n], rows[n:]
    if not head or not data:
        return []
    top = [*(f"{'#' * k} {t}" for k, t in s.path), *head]
    out: list[str] = []
    at = [i for i, x in enumerate(data) if is_group_row(x)]
    starts = sorted({0, *at})
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        # the rows below one group row
        group = data[a : a + 1] if a in at else []
        own = data[a + len(group) : b]
        above = "\n".join([*top, *group])
        if own:
            out += packed(own, "\n", most, above)
        elif group:
            out.append(above)
    return out


def cut_section(s: Section, most: int, tables: bool = True) -> list[str]:
    """A section's text in parts of `most` characters: by paragraphs, else by lines after its first heading.

    With tables (variant A) a table is cut by its rows, and over-long lines are cut too; without, they stay.
    """
    text = s.body()
    if len(text) <= most:
        return [text]
    if tables and is_table(s) and (parts := cut_table(s, most)):
        return parts
    by_paragraph = packed([x for b in text.split("\n\n") if (x := b.strip())], "\n\n", most)
    if by_paragraph and max(map(len, by_paragraph)) <= most:
        return by_paragraph
    rest = [x.rstrip() for x in text.splitlines() if x.strip()]
    head = rest.pop(0) if rest and HEADING.match(rest[0]) else ""
    if tables:
        room = max(200, most - len(head) - 1 if head else most)
        rest = [y for x in rest for y in cut_line(x, room)]
    return [p.strip() for p in packed(rest, "\n", most, head)] if rest else [head] if head else []


def aliases(lines: list[str]) -> list[str]:
    """A sentence for each `key: value` line."""
    out = []
    for x in lines:
        m = FACT.match(x.removeprefix("- "))
        if m and " | " not in x and not re.search("https?://", x) and m[1].strip().lower() != "source" and m[1].strip() and m[2].strip():
            out.append(f"Tra cứu nhanh: {m[1].strip()} là {m[2].strip()}.")
    return out


def chunk_text(s: Section, part: str) -> str:
    """A part with what it belongs to before it, and its facts as sentences after it."""
    part = part.strip()
    if not part:
        return ""
    title = _title(s)
    context = [OPEN, *([DOCUMENT + title] if title else []), *([PART + " > ".join(s.names)] if s.path else []), CLOSE]
    facts = aliases(part.splitlines())
    return "\n".join([*context, part, *facts])


def table_records(s: Section) -> list[tuple[str, str]]:
    """(record type, text): of a table each data row, after the heading, two header lines and the group row above; else the section."""
    if not is_table(s):
        return [("section", s.body())]
    n = next((i for i, x in enumerate(s.lines) if is_row(x) and not is_header_row(x)), len(s.lines))
    top = [*(f"{'#' * k} {t}" for k, t in s.path), *s.lines[: min(n, 2)]]
    out, group = [], []
    for x in s.lines[n:]:
        if is_group_row(x):
            group = [x]
        else:
            out.append(("table_row", "\n".join([*top, *group, x])))
    return out or [("section", s.body())]


def folded(text: str) -> str:
    """Lower case without combining marks."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def nested_chunks(text: str, p: Profile, markers: tuple[str, ...] = ()) -> list[dict]:
    """Chunks of a document (variant A): worthless tables and lone sources go, sparse sections merge, large ones are cut."""
    kept = [s for s in nested_sections(text) if not is_low_value(s, markers, folded) and not is_source_only(s)]
    out = []
    for s in merged_nested(kept, p.least, p.merged):
        for part in cut_section(s, p.most):
            if full := chunk_text(s, part):
                out.append({"heading_path": s.names, "record_type": "table_row" if is_table(s) else "section", "text": full})
    return out


def flat_chunks(text: str, p: Profile, markers: tuple[str, ...] = ()) -> list[dict]:
    """Chunks of a document (variant B): short sections merge, tables go row by row, large sections are cut without cutting lines."""
    out = []
    for s in merged_flat(flat_sections(text), p.least, p.merged):
        for kind, part in table_records(s):
            for x in [part] if kind == "table_row" else cut_section(s, p.most, tables=False):
                if x:
                    out.append({"heading_path": s.names, "record_type": kind, "text": x})
    return out


CHUNK = "chunk_id int, heading_path array<string>, record_type string, text string, char_count long, line_count long"
_CHUNK = pa.list_(pa.struct([("chunk_id", pa.int32()), ("heading_path", pa.list_(pa.string())), ("record_type", pa.string()), ("text", pa.string()), ("char_count", pa.int64()), ("line_count", pa.int64())]))


def chunked(docs: DataFrame, p: Profile, variant: str = "a", key: str = "doc_id", text: str = "text", markers: tuple[str, ...] = ()) -> DataFrame:
    """key and a row for each chunk: chunk_id (from 1), heading_path, record_type, text, char_count (code points), line_count (with words).

    Null, empty and blank texts give no rows; repeated rows their chunks as often. Extra columns are left out.
    """
    make = {"a": nested_chunks, "b": flat_chunks}[variant]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                rows.append([x | {"chunk_id": i, "char_count": len(x["text"]), "line_count": sum(1 for y in x["text"].splitlines() if y.strip())} for i, x in enumerate(make(t or "", p, markers), 1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _CHUNK)], ["key", "chunks"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, chunks array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>")
    return found.select(F.col("key").alias(key), F.explode("chunks").alias("x")).select(key, "x.*")


def node_metadata(chunks: DataFrame, documents: DataFrame, key: str = "doc_id", path: Column | None = None) -> DataFrame:
    """chunks with `metadata`, a map of what a node carries beside its text; only the text is embedded. documents: key, title, source_url,
    year, source_group and relative_path."""
    doc = documents.select(key, "title", "source_url", "year", "source_group", "relative_path")
    joined = chunks.join(doc, key, "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fields = ["title", "source_url", "year", "source_group", "relative_path", "record_type", "chunk_id", "char_count", "line_count"]
    name = F.regexp_extract(text("relative_path"), r"([^/]*)$", 1)
    pairs = [x for f in fields for x in (F.lit(f), text(f))] + [F.lit("heading_path"), F.array_join("heading_path", " > "), F.lit("file_name"), name]
    return joined.select(*chunks.columns, F.create_map(*pairs).alias("metadata"))


def record_summary(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunk_count, total_chars and table_chunks (a heading that names a table) of each document."""
    named = F.exists("heading_path", lambda x: F.contains(x, F.lit("Bang")))
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("char_count").alias("total_chars"), F.count_if(named).alias("table_chunks"))
