"""Web pages and their tables."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions.lines import classify
from ragframe.functions.text import normalize_line, slug_from_url
from ragframe.operators.structure import finalized, rebalance

# Tags that hold content, tags that are left out with all they hold, and containers of content in order of preference.
CONTENT = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "table")
DROPPED = ("script", "style", "noscript", "svg", "canvas", "input", "button", "textarea", "select", "option")
CONTAINERS = (
    "section.our-agent-single",
    "div.ss_event",
    "div[id^='dnn_BText']",
    "div.DnnModule-HyperLinks",
    "div.DnnModule-Article",
    "div.DNNContainer_Title_h2",
    "div.DNNContainer_Title_h3",
    "div.contents.detail",
    "div.contents",
    "article",
    "main",
    "#dnn_ContentPane",
    "#content",
    ".entry-content",
    ".post",
    ".content",
)
# Fixed values of HTML: elements without an end, blocks that end a paragraph, and elements that end another within a scope.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
SCOPES = ("body", "table", "td", "th", "li", "div", "article", "main", "section", "blockquote")
ENDS = {"li": (("li",), ("ul", "ol")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
SEPARATOR = r"^:?-{3,}:?$"
_BLOCK = r"(?i)<(h[1-6]|p|li)[^>]*>([^<]*)"


def title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def blocks(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """key, pos, tag and line of headings, paragraphs and items by pattern, without repeats of the line before."""
    both = F.arrays_zip(F.regexp_extract_all(page, F.lit(_BLOCK), F.lit(1)).alias("tag"), F.regexp_extract_all(page, F.lit(_BLOCK), F.lit(2)).alias("raw"))
    x = pages.select(key, F.posexplode(both).alias("pos", "x")).select(key, "pos", F.lower("x.tag").alias("tag"), F.trim(F.regexp_replace("x.raw", r"\s+", " ")).alias("line")).filter("line <> ''")
    before = F.lag("line").over(Window.partitionBy(key).orderBy("pos"))
    return x.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("line"))).drop("_b")


def _matcher(selector: str):
    """A test of (tag, id, classes) for a selector of a tag, classes, an id and the beginning of an id."""
    tag, marks, begin = re.fullmatch(r"(\w*)((?:[.#][\w-]+)*)(?:\[id\^='([^']+)'\])?", selector).groups()
    classes = {m[1:] for m in re.findall(r"[.#][\w-]+", marks) if m[0] == "."}
    ident = next((m[1:] for m in re.findall(r"#[\w-]+", marks)), None)
    return lambda n: (not tag or n.tag == tag) and classes <= n.classes and (ident is None or n.ident == ident) and (begin is None or n.ident.startswith(begin))


_MATCHERS = [_matcher(s) for s in CONTAINERS]


class _Node:
    """An element: the events from `start` to `end` are within it."""

    __slots__ = ("tag", "ident", "classes", "attrs", "parent", "start", "end", "hidden")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None, start: int) -> None:
        self.tag, self.attrs, self.parent, self.start, self.end = tag, attrs, parent, start, start
        self.ident, self.classes = attrs.get("id") or "", set((attrs.get("class") or "").split())
        self.hidden = tag in DROPPED or (parent is not None and parent.hidden)


class _Page(HTMLParser):
    """Elements and texts of a page in order. Elements that HTML closes without a tag (paragraphs, items, rows, cells) end."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.clock = 0
        self.nodes: list[_Node] = []
        self.open: list[_Node] = []
        self.at: list[int] = []
        self.texts: list[str] = []
        self.feed(html)
        self.close()
        self._end(0)
        self.begins = [n.start for n in self.nodes]

    def _end(self, depth: int) -> None:
        for n in self.open[depth:]:
            n.end = self.clock
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended, within = ENDS.get(tag) or ((("p",), SCOPES) if tag in BLOCKS else ((), ()))
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag in within:
                break
            if self.open[depth].tag in ended:
                self._end(depth)
                break
        self.clock += 1
        node = _Node(tag, dict(attrs), self.open[-1] if self.open else None, self.clock)
        if not node.hidden:
            self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.clock += 1
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag), None)
        if depth is not None:
            self._end(depth)

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not (self.open and self.open[-1].hidden):
            self.clock += 1
            self.at.append(self.clock)
            self.texts.append(text)

    def pieces(self, node: _Node | None) -> list[str]:
        return self.texts if node is None else self.texts[bisect_left(self.at, node.start) : bisect_right(self.at, node.end)]

    def text(self, node: _Node | None) -> str:
        return " ".join(" ".join(self.pieces(node)).split())

    def inside(self, node: _Node | None) -> list[_Node]:
        """The elements within one, in order; begins must be sorted, as they are when the page has been read."""
        return self.nodes if node is None else self.nodes[bisect_right(self.begins, node.start) : bisect_right(self.begins, node.end)]

    def containers(self) -> list[_Node | None]:
        """Elements of the selectors in their order, none inside or around an earlier one; of these the rich, if any is; else the body."""
        picked: list[_Node] = []
        # picked elements lie apart, so that their neighbours by place tell of every overlap
        taken: list[tuple[int, int]] = []
        for match in _MATCHERS:
            for n in self.nodes:
                if match(n):
                    i = bisect_right(taken, (n.start, float("inf")))
                    if not (i and taken[i - 1][1] >= n.start) and not (i < len(taken) and taken[i][0] <= n.end):
                        taken.insert(i, (n.start, n.end))
                        picked.append(n)
        rich = [p for p in picked if sum(1 for n in self.inside(p) if n.tag in CONTENT) >= 3 or len(self.text(p)) >= 300]
        return rich or picked or [next((n for n in self.nodes if n.tag == "body"), None)]

    def grid(self, table: _Node) -> list[list[str]]:
        own = self.inside(table)
        cells = {id(n): [] for n in own if n.tag == "tr"}
        for n in own:
            if n.tag in ("th", "td") and n.parent is not None and id(n.parent) in cells:
                cells[id(n.parent)].append((self.text(n), _span(n.attrs.get("rowspan")), _span(n.attrs.get("colspan"))))
        full = [c for c in cells.values() if c]
        held = laid([(r, *c) for r, row in enumerate(full) for c in row], len(full) - 1)
        width = max((c for _, c in held), default=-1) + 1
        out = [[held.get((r, c), "") for c in range(width)] for r in range(len(full))]
        return [row for row in out if any(row)]

    def content(self) -> Iterator[tuple[str, str | None, list[list[str]] | None]]:
        """tag, text and grid of what the containers hold; the lines of their plain text if they hold nothing of the kind."""
        found, picked = False, self.containers()
        for c in picked:
            for n in self.inside(c):
                if n.tag not in CONTENT:
                    continue
                if n.tag == "table":
                    grid = self.grid(n)
                    if grid:
                        found = True
                        yield "table", None, grid
                elif not _inside_table(n):
                    text = self.text(n)
                    if text:
                        found = True
                        yield n.tag, text, None
        if not found:
            for c in picked:
                for text in self.pieces(c):
                    yield "#text", text, None


def _inside_table(n: _Node) -> bool:
    while n.parent is not None:
        n = n.parent
        if n.tag == "table":
            return True
    return False


def _span(value: str | None) -> int:
    """A span as a number from 1 to 1000; what is no number is 1."""
    text = (value or "1").strip()
    return min(1000, max(1, int(text))) if re.fullmatch(r"[+-]?[0-9]{1,9}", text) else 1


def dom_nodes(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """key, pos, tag, text and grid of the headings, paragraphs, items and tables (as rows of cells) of each page's containers.

    A page without any has a row `#text` for each piece of text; a null or empty page none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *x) for k, h in pdf.itertuples(index=False) if h for i, x in enumerate(_Page(h).content())]
            yield pd.DataFrame(rows, columns=[key, "pos", "tag", "text", "grid"])

    return pages.select(key, page).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, pos int, tag string, text string, grid array<array<string>>")


def dom_lines(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """key, ln (from 0) and line, in the light mark-up, of each page: items as bullets, other text by its form, tables numbered.

    A line equal to the one before it goes, but for rows of tables; headings move up so that the highest is of level 2.
    """
    w = Window.partitionBy(key).orderBy("pos")
    nodes = grid_lines(dom_nodes(pages, key, page).withColumn("_n", F.count("grid").over(w)))
    line = normalize_line(F.col("text"))
    marked = F.when(F.col("tag") == "li", F.concat(F.lit("- "), F.regexp_replace(line, "^[-*• ]+", ""))).when(F.col("tag") == "#text", line).otherwise(classify(F.col("text")))
    head = F.concat(F.lit("### Bang "), F.col("_n").cast("string"))
    own = F.when(F.col("grid").isNull(), F.when(line != "", F.array(marked))).when(F.size("_lines") > 0, F.concat(F.array(head), "_lines"))
    x = nodes.select(key, "pos", F.col("grid").isNotNull().alias("_t"), F.posexplode(own).alias("row", "line"))
    w = Window.partitionBy(key).orderBy("pos", "row")
    x = x.withColumn("_b", F.lag("line").over(w)).filter(F.col("_t") | F.col("_b").isNull() | (F.col("_b") != F.col("line")))
    return rebalance(x.select(key, (F.row_number().over(w) - 1).alias("ln"), "line"), key)


def grid_lines(df: DataFrame) -> DataFrame:
    """df with _lines, the lines of grid (rows of cells): as rendered(tidied()) gives them, for a table held in one row."""
    plain = F.transform("grid", lambda row: F.transform(row, lambda c: normalize_line(F.translate(F.coalesce(c, F.lit("")), "\n", " "))))
    filled = lambda row: F.coalesce(F.array_max(F.transform(row, lambda c, i: F.when(c != "", i + 1).otherwise(0))), F.lit(0))
    x = df.withColumn("_rows", plain).withColumn("_rows", F.transform("_rows", lambda row: F.slice(row, F.lit(1), filled(row))))
    x = x.withColumn("_rows", F.filter("_rows", lambda row: (F.size(row) > 0) & ~F.forall(row, lambda c: c.rlike(SEPARATOR))))
    x = x.withColumn("_width", F.array_max(F.transform("_rows", lambda row: F.size(row))))
    blank = lambda row, i: F.coalesce(F.get(row, F.lit(i)), F.lit("")) == ""
    # a row begins a line if it is the first or one of its first two cells is filled; the line takes all up to the next
    begins = F.filter(F.transform("_rows", lambda row, i: F.when((i == 0) | ~(blank(row, 0) & blank(row, 1)), i)), lambda i: i.isNotNull())
    x = x.withColumn("_begins", begins)
    last = lambda k: F.coalesce(F.get("_begins", k + 1), F.size("_rows"))
    x = x.withColumn("_groups", F.transform("_begins", lambda i, k: F.slice("_rows", i + 1, last(k) - i)))
    cell = lambda rows, c: F.array_join(F.filter(F.transform(rows, lambda row: F.get(row, c)), lambda v: v != ""), "; ")
    joined = F.transform("_groups", lambda rows: F.concat(F.lit("- "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda c: F.coalesce(F.nullif(cell(rows, c), F.lit("")), F.lit("-"))), " | ")))
    return x.withColumn("_lines", F.array_distinct(joined)).drop("_rows", "_width", "_begins", "_groups")


def unescaped(text: Column) -> Column:
    """Text with the characters that entities stand for."""

    def each(values: pd.Series) -> pd.Series:
        return values.map(unescape, na_action="ignore")

    return F.pandas_udf(each, "string")(text)


def page_title(page: Column, url: Column) -> Column:
    """A page's title as one line, else the slug of its address."""
    return F.coalesce(F.nullif(normalize_line(unescaped(title(page))), F.lit("")), slug_from_url(url))


def web_documents(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and error of each page: its title, source and lines as a finished text. A null or empty page has an error only."""
    full = pages.filter(F.coalesce(F.col(page), F.lit("")) != "")
    source = full.select(key, F.lit(-1).alias("ln"), F.concat(F.lit("Source: "), url).alias("line"))
    done = finalized(source.unionByName(dom_lines(full, key, page)), full.select(key, page_title(F.col(page), F.col(url)).alias("title")), key)
    return pages.select(key, url).join(done, key, "left").withColumn("error", F.when(F.col("text").isNull(), "empty page"))


def built(pages: DataFrame, page: str = "html") -> DataFrame:
    """total and written: pages without content are counted, not raised."""
    return pages.agg(F.count(F.lit(1)).alias("total"), F.count(F.nullif(F.col(page), F.lit(""))).alias("written"))


def tidied(grid: DataFrame) -> DataFrame:
    """table_id, row and cells: cells in normal form, without empty cells at a row's end, empty rows and separators, padded to one width."""
    plain = F.transform("cells", lambda c: normalize_line(F.translate(F.coalesce(c, F.lit("")), "\n", " ")))
    x = grid.select("table_id", "row", plain.alias("cells"))
    filled = F.array_max(F.transform("cells", lambda c, i: F.when(c != "", i + 1).otherwise(0)))
    x = x.withColumn("cells", F.slice("cells", 1, F.coalesce(filled, F.lit(0)))).filter((F.size("cells") > 0) & ~F.forall("cells", lambda c: c.rlike(SEPARATOR)))
    width = F.max(F.size("cells")).over(Window.partitionBy("table_id"))
    return x.withColumn("_w", width).select("table_id", "row", F.concat("cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("cells"))).alias("cells"))


def rendered(grid: DataFrame) -> DataFrame:
    """table_id, row and line: a row whose first two cells are empty continues the one before; equal lines of a table are one.

    grid: table_id, row, cells (equally long within a table).
    """
    first = F.when((F.get("cells", F.lit(0)) == "") & (F.get("cells", F.lit(1)) == ""), 0).otherwise(1)
    g = grid.withColumn("_g", F.sum(first).over(Window.partitionBy("table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    rows = g.groupBy("table_id", "_g").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("r"))
    cell = lambda i: F.array_join(F.filter(F.transform("r", lambda x: F.get(x["cells"], i)), lambda v: v != ""), "; ")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.size(F.col("r")[0]["cells"]) - 1), lambda i: F.when(cell(i) == "", "-").otherwise(cell(i))), " | ")
    out = rows.select("table_id", F.col("r")[0]["row"].alias("row"), F.concat(F.lit("- "), line).alias("line"))
    return out.groupBy("table_id", "line").agg(F.min("row").alias("row"))


def row_alias(header: Column, row: Column) -> Column:
    """A sentence that joins a table row with its header."""
    parts = F.filter(F.zip_with(header, row, lambda h, v: F.when(~v.isin("", "-"), F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull())
    return F.concat(F.lit("Tra cứu bảng: "), F.array_join(parts, "; "))


def laid(cells: list[tuple[int, str, int, int]], last: int) -> dict[tuple[int, int], str]:
    """(row, column) to value of cells (row, value, rowspan, colspan) in order: each goes to its row's next free columns."""
    held: dict[tuple[int, int], str] = {}
    row, col = -1, 0
    for r, value, down, over in cells:
        row, col = r, col if r == row else 0
        for i in range(over):
            while i == 0 and (r, col) in held:
                col += 1
            for j in range(min(down, last - r + 1)):
                held[r + j, col] = value if i == 0 else ""
            col += 1
    return held


def spans(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """key, row, col and value: a cell over several rows is repeated down, over several columns followed by blanks.

    cells: key, row, ord, value, rowspan, colspan; a span under 1 is 1, and none goes below the table's last row. A cell's place depends
    on the rows above, so a table is one row here, and many tables are laid out in one batch.
    """

    def lay(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tables:
            out = []
            for k, own in zip(pdf[key], pdf["cells"], strict=True):
                size = lambda n: max(1, n or 1)
                held = laid([(c["row"], c["value"], size(c["rowspan"]), size(c["colspan"])) for c in own], own[-1]["row"])
                out.extend((k, r, c, v) for (r, c), v in held.items())
            yield pd.DataFrame(out, columns=[key, "row", "col", "value"])

    own = F.struct(*[F.col(c).cast("int").alias(c) for c in ("row", "ord")], "value", *[F.col(c).cast("int").alias(c) for c in ("rowspan", "colspan")])
    one = cells.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("cells"))
    return one.mapInPandas(lay, f"{key} {cells.schema[key].dataType.simpleString()}, row int, col int, value string")
