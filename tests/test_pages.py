"""Printed pages on a worked example."""

from ragframe.operators import pages

LINES = [
    (0, "Cover"), (0, "I. Lost"), (0, "MỤC LỤC"), (0, "1.1. lost too"), (0, "II. Kept"), (0, "• a"),
    (1, "CAPS"), (1, "MORE CAPS"), (1, "EVEN MORE"), (1, "1.2.3. Deep"), (1, "LOW CAPS"), (1, "trang 2/3"), (2, "text"), (2, "text"), (2, "Q1. Why?"),
]


def rows(spark, lines, doc=1):
    return spark.createDataFrame([(doc, p, i, x) for i, (p, x) in enumerate(lines)], "doc long, page long, ln long, line string")


def tables(spark, *grids):
    return spark.createDataFrame([(1, p, t, r, c) for t, (p, grid) in enumerate(grids) for r, c in enumerate(grid)], "doc long, page long, table int, row int, cells array<string>")


def test_lines_of_pages(spark):
    got = [r.line for r in pages.page_lines(rows(spark, LINES), "doc").orderBy("page", "ln").collect()]
    # the first section starts the text, then contents are skipped up to the next section
    assert got == ["## Lost", "## Kept", "- a", "### CAPS", "#### MORE CAPS", "#### EVEN MORE", "##### Deep", "#### LOW CAPS", "text", "## Why?"]
    late = [r.line for r in pages.page_lines(rows(spark, [(0, "MUC LUC"), (0, "- x"), (1, "text"), (1, "1 Go"), (2, "III Start"), (2, "END")]), "doc").orderBy("ln").collect()]
    assert late == ["## Start", "### END"]


def test_tables_follow_their_page(spark):
    lines = pages.page_lines(rows(spark, [(0, "Cover"), (1, "I. A"), (2, "b")]), "doc")
    grids = ((0, [["lost"]]), (1, [["h", "k", ""], ["---", ":---:"], ["", "", "z"], [None, " "], ["p", "q\nr"], ["p", "q r"]]), (1, [["", ""]]), (2, [["last", "one"]]))
    got = [r.line for r in pages.with_tables(lines, tables(spark, *grids), "doc").orderBy("ln").collect()]
    assert got == ["## A", "### Bang 1", "- h | k | z", "- p | q r | -", "b", "### Bang 3", "- last | one"]


def test_built_documents(spark):
    text = rows(spark, [(0, "I. A"), (0, "b")], 1).unionByName(rows(spark, [(0, "cover alone")], 2))
    titles = spark.createDataFrame([(1, "T"), (2, "U"), (3, "V")], "doc long, title string")
    none = spark.createDataFrame([], "doc long, page long, table int, row int, cells array<string>")
    got = {r.doc: (r.text, r.reason) for r in pages.built(text, none, titles, "doc").collect()}
    assert got == {1: ("# T\n\n## A\nb\n", "ok"), 2: (None, "no_text"), 3: (None, "zero_pages")}
