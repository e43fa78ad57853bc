import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from convspark.llm.html_text import extract, render
from tests.llm.fixtures import frame


def test_blocks_and_spacing():
    assert render("<h1>T</h1><p>One <b>two</b>\n three<p>Four<div>five</div>six") == "T\n\nOne two three\n\nFour\n\nfive\nsix"
    assert render("a<br>b<br><br>c<hr>d") == "a\nb\n\nc\n---\nd"
    assert render("<pre>  x\n   y</pre>z") == "x\n   y\n\nz".replace("x", "  x", 1)
    assert render("<blockquote>q<p>r</blockquote>") == "> q\n>\n> r"


def test_lists():
    assert render("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n\n  - c\n- d"
    assert render("<ol start=9><li>x<li>y<p>z</ol>") == "9. x\n10. y\n\n    z"
    assert render("<dl><dt>t<dd>d<dt>u<dd>e</dl>") == "t\n  d\nu\n  e"


def test_tables_are_aligned():
    html = "<table><caption>C</caption><thead><tr><th>name<th>n<tbody><tr><td>long name<td>1<tr><td>x<td>22</table>after"
    assert render(html) == "C\nname       n\nlong name  1\nx          22\n\nafter"
    assert render("<table><td>a<td>b<tr><td><table><tr><td>in</table><td>c</table>") == "a   b\nin  c"


def test_only_what_is_visible():
    assert render("<head><title>t</title><style>p{}</style><body>a<script>x</script><!-- n --><p hidden>h<p>b") == "a\n\nb"
    assert render("<div style='color:red; DISPLAY : none'>x</div><i aria-hidden=true>y</i>z &amp; &eacute;") == "z & é"
    assert render("<template>x</template><select><option>a<option>b</select><img alt='pic'>") == "pic"


def test_any_markup_gives_a_text():
    assert render(None) == render("") == render("<") .strip("<") == ""
    assert render("</p></div>a</b>") == "a"
    assert render("<b><p>x</b>y") == "x\n\ny" or render("<b><p>x</b>y") == "xy"
    for unit in ("<div>", "<table>", "<table><tr><td>", "<ul><li>", "<p><a>", "<blockquote>"):
        assert render(unit * 3000 + "deep") .endswith("deep")
    assert len(render("<p>" + "word " * 200_000).split()) == 200_000


def test_layout_and_visibility_at_any_depth():
    for deep in ("<font>" * 101, "<div>" * 3000):
        assert render(f"{deep}<script>x</script><i style='display:none'>y</i>a<ul><li>b<li>c</ul>") == "a\n\n- b\n- c"
        assert render(f"<div hidden>{deep}<div>x</div>y</div>").strip() == ""
        assert render(f"{deep}<table><tr><td>a<td>b<tr><td>cc<td>d</table>") == "a   b\ncc  d"
    assert render("<blockquote>" * 300 + "q") == "> " * 300 + "q"
    assert render("<ul><li>" * 150 + "a<li>b") == "- " * 150 + "a\n" + "  " * 149 + "- b"
    # indentation that would square the page keeps its innermost levels, and all text
    rows = render("<blockquote>x" * 5000).split("\n")
    assert [x[-1] for x in rows if x.endswith("x")] == ["x"] * 5000 and rows[-1] == "> " * 100 + "x"


def test_columns_are_as_wide_as_their_cells():
    long = "w" * 70
    assert render(f"<table><tr><td>{long}<td>1<tr><td>x<td>2</table>") == f"{long}  1\n{'x'.ljust(70)}  2"
    rows = render("<table><tr><td>" + "w" * 100_000 + "<td>1" + "<tr><td>x<td>2" * 500).split("\n")
    assert rows[1:] == ["x".ljust(40) + "  2"] * 500


def test_cells_that_span():
    assert render("<table><tr><th colspan=2>head<th>z<tr><td>aa<td>b<td>c</table>") == "head   z\naa  b  c"
    assert render("<table><tr><td rowspan=2>tall<td>q<tr><td>under<tr><td>x<td>y</table>") == "tall  q\n      under\nx     y"
    # a row group ends what a cell holds; no rows means all of the group
    assert render("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert render("<table><tr><td rowspan=3>a<td>b<tr><tr><td>c</table>") == "a  b\n   c"
    assert render("<table><tr><td colspan=0 rowspan=x>a<td colspan=99999999>b<tr><td>c</table>") == "a  b\nc"
    many = "<td rowspan=0>x" * 3000 + "<tr><td>y" * 3000
    assert render(f"<table><tr>{many}</table>").count("y") == 3000


def plain_table(rows):
    """Browser grid by a set of places, columns moved right until nothing overlaps, characters put on a canvas."""
    taken, cells = set(), []
    for y, row in enumerate(rows):
        x = 0
        for wide, high, text in row:
            while (y, x) in taken:
                x += 1
            cells.append((y, x, wide, text))
            taken |= {(y + j, x + i) for j in range(high) for i in range(wide)}
            x += wide
    starts = sorted({x for _, x, _, _ in cells})
    place = {x: 2 * i for i, x in enumerate(starts)}
    while True:
        moved = dict(place)
        for _, x, wide, text in cells:
            for other in starts:
                if other >= x + wide:
                    moved[other] = max(moved[other], moved[x] + len(text) + 2)
        for a, b in zip(starts, starts[1:]):
            moved[b] = max(moved[b], moved[a] + 2)
        if moved == place:
            break
        place = moved
    lines = []
    for y, row in enumerate(rows):
        if row:
            canvas = [" "] * 2000
            for _, x, _, text in (c for c in cells if c[0] == y):
                canvas[place[x] : place[x] + len(text)] = text
            lines.append("".join(canvas).rstrip())
    return "\n".join(lines).strip("\n")


@pytest.mark.parametrize("seed", range(6))
def test_tables_equal_a_canvas(seed):
    rng = random.Random(seed)
    for _ in range(60):
        size = lambda: rng.choice([1, 1, 1, 2, 3])
        rows = [
            [(size(), size(), "abcdefghijkl"[: rng.randrange(1, 12)]) for _ in range(rng.randrange(5))]
            for _ in range(rng.randrange(1, 7))
        ]
        cell = "<td colspan={} rowspan={}>{}"
        html = "".join("<tr>" + "".join(cell.format(*c) for c in row) for row in rows)
        assert render(f"<table>{html}</table>") == plain_table(rows), html


def plain_lines(node, seen):
    """Lines of a small well-formed subset, by recursion over another parser's tree."""
    lines, words, gap = [], "", False

    def flush():
        nonlocal words, gap
        if words.strip():
            put([" ".join(words.split())])
        words = ""

    def put(more):
        nonlocal gap
        if more:
            lines.extend(([""] if gap and lines else []) + more)
            gap = False

    def walk(part, seen, at=0):
        nonlocal words, gap
        words += (part.text or "") if seen else ""
        for child in part:
            inner = {"hidden": False, "visible": True}.get(child.get("style", "").removeprefix("visibility:"), seen)
            if child.get("style") == "display:none":
                pass
            elif child.tag == "b":
                walk(child, inner)
            elif child.tag in ("div", "p"):
                flush()
                gap |= child.tag == "p"
                walk(child, inner)
                flush()
                gap |= child.tag == "p"
            elif child.tag == "ul":
                flush()
                gap = True
                for item in child:
                    put([f"{'  ' if i else '- '}{x}".rstrip() for i, x in enumerate(plain_lines(item, inner) or ([""] if inner else []))] if inner
                        else [f"  {x}".rstrip() for x in plain_lines(item, inner)])
                gap = True
            words += (child.tail or "") if seen else ""

    walk(node, seen)
    flush()
    return lines


@pytest.mark.parametrize("seed", range(6))
def test_blocks_equal_another_renderer(seed):
    rng = random.Random(seed)

    def tree(depth, inside_p):
        out = [f"w{rng.randrange(99)}"] if rng.random() < 0.8 else []
        for _ in range(rng.randrange(4) if depth else 0):
            tag = rng.choice(["b"] if inside_p else ["b", "div", "p", "ul"])
            style = rng.choice(["", "", "", ' style="display:none"', ' style="visibility:hidden"', ' style="visibility:visible"'])
            if tag == "ul":
                body = "".join(f"<li>{tree(depth - 1, False)}</li>" for _ in range(rng.randrange(3)))
            else:
                body = tree(depth - 1, inside_p or tag in ("p", "b"))
            out.append(f"<{tag}{style}>{body}</{tag}>")
            if rng.random() < 0.5:
                out.append(f" t{rng.randrange(99)} ")
        return "".join(out)

    for _ in range(150):
        html = f"<div>{tree(4, False)}</div>"
        assert render(html) == "\n".join(plain_lines(ElementTree.fromstring(html), True)), html


def test_rows_and_columns(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "")]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    out = extract(pages)
    assert out.columns == ["page_id", "url", "html", "text"]
    assert sorted(r.text for r in out.collect()) == ["", "", "a", "a"]
    assert extract(pages.limit(0)).count() == 0
