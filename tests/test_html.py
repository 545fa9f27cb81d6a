"""Web pages on worked examples."""

from ragframe.operators import html


def lines(spark, *pages):
    got = html.dom_lines(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    return [[r.line for r in sorted(got, key=lambda r: r.ln) if r.page_id == i] for i in range(len(pages))]


def test_lines_in_the_mark_up(spark):
    page = "<html><nav><p>skip</p></nav><article><h1>1. Part</h1><p>a &amp; b<p>a &amp;  <b>b</b></p><script>x</script><ul><li>• c<li>d</ul><form><p>IN CAPITALS<button>no</button></p></form></article></html>"
    assert lines(spark, page, None, "", "<p> </p>") == [["### Part", "a & b", "- c", "- d", "## IN CAPITALS"], [], [], []]


def test_tables(spark):
    table = "<table><tr><th rowspan=2>a<th colspan='2'>b</tr><tr><td>c<td>d<tr><td colspan=x>a</td><td>c<td>d</td></tr><tr></tr><tr><td></td></tr></table>"
    page = f"<body><p>text</p>{table}<table><tr><td> </td></tr></table><p>- a | c | d</p><table><tr><td><p>x</p></td><td>y</td></tr></table></body>"
    assert lines(spark, page) == [["text", "### Bang 1", "- a | b | -", "- a | c | d", "### Bang 2", "- x | y"]]


def test_lines_of_a_grid(spark):
    grids = [[["", "", "z"], [None, " ", "y"], ["a", "b\nc"], ["---", ":---:"], ["", "", "q", ""], ["a", "b c", "q"]], [["----"]], [], [["one"], ["", "", "two"]]]
    x = spark.createDataFrame(list(enumerate(grids)), "id long, grid array<array<string>>")
    got = {r.id: r._lines for r in html.grid_lines(x).collect()}
    assert got == {0: ["- - | - | z; y", "- a | b c | q"], 1: [], 2: [], 3: ["- one | - | two"]}
    # the same as for rows that lie apart
    rows = x.selectExpr("id as table_id", "posexplode(grid) as (row, cells)")
    for i in (0, 3):
        assert [r.line for r in html.rendered(html.tidied(rows)).filter(f"table_id = {i}").orderBy("row").collect()] == got[i]


def test_containers(spark):
    long = "word " * 70
    # the first selector wins, what is inside or around a picked one doesn't count, and rich ones alone stay
    assert lines(spark, f"<main><p>out</p><div class='x contents'><p>{long}</p></div></main><article><p>poor</p></article>") == [[long.strip()]]
    assert lines(spark, "<div id='content'><p>one</p></div><p>two</p>", "<p>one</p><div class='contents'></div>") == [["one"], []]
    assert lines(spark, "<div id='dnn_BText_1'><p>b</p></div><section class='our-agent-single y'><p>a</p></section>") == [["a", "b"]]
    # plain text stands in where no element holds content
    assert lines(spark, "<body>some <b>bold</b> text</body>", "just text") == [["some", "bold", "text"], ["just text"]]


def test_many_elements_take_linear_time(spark):
    page = "".join(f"<div class='content'><p>{i}x</p></div>" for i in range(20000))
    assert len(lines(spark, page)[0]) == 20000


def test_web_documents(spark):
    rows = [(1, "https://a.b/c-d?q", "<title> T &amp;\n x&eacute; </title><h1>2. Deep</h1><p>text</p><table><tr><td>a<td>b</table>"), (2, "https://a.b/c-d", "<p>only</p>"), (3, "u", None), (4, "v", "")]
    got = {r.page_id: (r.text, r.error) for r in html.web_documents(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("# T & xé\n\nSource: https://a.b/c-d?q\n## Deep\ntext\n### Bang 1\n- a | b\n", None)
    assert got[2] == ("# a-b-c-d\n\nSource: https://a.b/c-d\nonly\n", None) and got[3] == got[4] == (None, "empty page")
