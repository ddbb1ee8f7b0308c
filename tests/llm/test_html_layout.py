from hypothesis import given, settings
from hypothesis import strategies as st

from tierwave.llm.html_layout import extract, extract_text


def text(page):
    return extract(page)[1]


def test_blocks_and_spaces():
    assert text("a  b\n c") == "a b c"
    assert text("<p>One <b>two</b> three<p>Four<div>five</div>six<br>seven") == "One two three\n\nFour\n\nfive\nsix\nseven"
    assert text("<h1> Title </h1><span>a</span> <span>b</span><hr>c") == "Title\n\na b\n\nc"
    assert text("<pre>\n a\n   b\n</pre>x") == " a\n   b\n\nx"
    assert text("a&amp;b &eacute; &#x41; &nosuch; 1 < 2 <3") == "a&b é A &nosuch; 1 < 2 <3"
    assert text("<blockquote>q<p>r</blockquote>") == "    q\n\n    r"


def test_lists():
    page = "<ul><li>a<li>b<ol start=3><li>x<li value=9>y<li>z</ol><li><p>c</p><p>d</p></ul>t"
    assert text(page) == "- a\n- b\n  3. x\n  9. y\n  10. z\n- c\n\n  d\n\nt"
    assert text("<dl><dt>k<dd>v<dt>k2<dd>v2</dl>") == "k\n    v\nk2\n    v2"


def test_tables():
    assert text("<table><tr><th>name<th>n<tr><td>ab<br>c<td>1<tr><td colspan=2>a long one here<td>z</table>") == "name  n\nab    1\nc\na long one here  z"
    assert text("<table><caption>cap</caption><tr><td rowspan=2>r<td>1</tr><tr><td>2</tr></table>") == "cap\nr  1\n   2"
    assert text("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>") == "i  j  k"
    assert text("<table></table>x<table><tr></table>") == "x"


def test_visibility():
    page = "<html><head><title> T  t </title><style>.no, #x{color:red;display:none} p.y{display:none}</style><script>var a='</p>';</script></head><body>a<i hidden>b</i><i style='Display: NONE'>c</i>"
    page += "<i class='k no'>d</i><i id=x>e</i><noscript>f</noscript><template>g</template><!-- h --><details>i<summary>j</summary></details><details open>k</details><textarea>l</textarea><dialog>m</dialog><i style='visibility:hidden'>n</i></body></html>"
    assert extract(page) == ("T t", "a\nj\nk\nl")
    assert text("<head><title>t</title>shown<p>p") == "shown\n\np"


def test_broken():
    for page in (None, "", "<", "<p", "</", "<!--", "<!", "<script>x", "<a href='", "<style>", "</p></table></b>", "<td>a<tr>b", "<li>" * 9, "\x00"):
        extract(page)
    assert text("<b>x</i></b>y</div>") == "xy" and text("<!-- x") == "" and text("<script>var a") == ""
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<ul>" + "<li><ul>" * 3000 + "<li>deep").endswith("deep")
    assert text("w " * 200_000) == ("w " * 200_000).strip()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<form>", "</form>", "<tbody>", "<th>", "<caption>", "</tr>", "<dl>", "<dd>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<b>", "</b>", "<div>", "</div>", "<br>", "<pre>", "</pre>", "<ol>", "w1", " w2 ", "\n"])))
def test_all_text_is_kept(parts):
    found = text("".join(parts))
    assert found.count("w1") == parts.count("w1") and found.count("w2") == parts.count(" w2 ")


def test_outside_cells():
    assert text("<table><tr>w1<td>x") == "w1\n\nx"
    assert text("<table><thead><th>Name<th>Age<tbody><td>a<td>1</table>") == "Name  Age\na     1"
    assert text("<table><tr><form><td>a</form><td>b</table>c") == "a  b\n\nc"
    assert text("a<table><tbody><div>b<td>c</div><td>d</table>").split() == ["a", "b", "c", "d"]
    assert text("<div>x<table></div><tr><td>y</table>z</div>").split() == ["x", "y", "z"]
    assert text("<table><tr><td>a<table><tr>b<td>c</table>d</table>").split() == ["ab", "c", "d"]
    assert text("<table><table><td>a</table>").split() == ["a"]
    assert text("<ul><li><table><tr><td><li>a<td>b</table><li>c</ul>").split() == ["-", "-", "a", "b", "-", "c"]
    assert text("<table hidden><tr>a<td>b</table>") == "a"


def test_spans():
    row = lambda n: "<tr>" + "<td>x" * n
    assert text(f"<table><tr><td colspan=150>long<td>z{row(151)}</table>").split("\n")[0].endswith("  z")
    assert len(text(f"<table><tr><td rowspan=200>a<td>b{row(1) * 199}</table>").split("\n")) == 200
    assert text("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>") == "a  b\n   c\nd"


def test_sheets():
    page = "<style>{}</style><p class=nav>a<p>b"
    for hides in (".nav{display:none}", "@media screen{.nav{display:none}}", "@import 'x'; .nav , i{display:none}", "@media print{p{display:none}} .nav{display:none}", "@supports (x:y){@media all{.nav{display:none}}}"):
        assert text(page.format(hides)) == "b", hides
    for shows in ("@media print{.nav{display:none}}", "@media (max-width: 9px){.nav{display:none}}", "@media print{@media all{.nav{display:none}}}", "@keyframes k{from{display:none}}", ".nav{color:red}"):
        assert text(page.format(shows)) == "a\n\nb", shows


TREE = st.recursive(
    st.sampled_from(["w", "hidden", "br"]),
    lambda inner: st.tuples(st.sampled_from(["div", "p", "span", "b", "ul", "ol", "table", "section", "hide", "display", "dl", "pre"]), st.lists(inner, max_size=4)),
    max_leaves=25,
)


def written(tree, seen, words):
    """The tree as a page; words gets what a reader sees, in the order of the source."""
    if isinstance(tree, str):
        if tree == "br":
            return "<br>"
        word = f"q{len(words[0])}q"
        words[0].append(word)
        if tree == "w" and seen:
            words[1].append(word)
        return word + " " if tree == "w" else f"<i hidden>{word}</i>"
    tag, inner = tree
    if tag in ("hide", "display"):
        return f"<div {'hidden' if tag == 'hide' else 'style=display:none'}>" + "".join(written(t, False, words) for t in inner) + "</div>"
    wrap = {"ul": "<li>{}</li>", "ol": "<li>{}", "table": "<tr><td>{}</td></tr>", "dl": "<dt>{}<dd>"}.get(tag, "{}")
    tag = "div" if tag == "p" and any(isinstance(t, tuple) for t in inner) else tag
    return f"<{tag}>" + "".join(wrap.format(written(t, seen, words)) for t in inner) + f"</{tag}>"


@settings(max_examples=300, deadline=None)
@given(st.lists(TREE, max_size=4), st.sampled_from([0, 160, 700]))
def test_what_a_reader_sees(trees, deeper):
    words = [], []
    page = "<div>" * deeper + "".join(written(t, True, words) for t in trees) + "</div>" * deeper
    assert [w for w in text(page).split() if w.startswith("q")] == words[1]


def test_query(spark):
    pages = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, None)], "page_id long, html string, text string")
    got = extract_text(pages).collect()
    assert sorted(tuple(r.page) for r in got) == [("", ""), ("", "a"), ("", "a")]
    assert extract_text(pages.limit(0)).count() == 0


def test_cascade():
    rule = "<style>{}</style><p class='a b' id=c>x<p>y"
    for shows in (".a{display:none} .a{display:block}", "#c{display:block} .a{display:none}", ".b{display:inline!important} #c{display:none}", ".a{visibility:hidden} .b{visibility:visible}"):
        assert text(rule.format(shows)) == "x\n\ny", shows
    assert text(rule.format("p{display:none} .a{display:block}")) == "x" and text(rule.format("*{display:none} p{display:block}")) == ""
    for hides in (".a{display:block} .b{display:none}", ".a{display:none!important} #c{display:block}", "#c{DISPLAY : None}", ".b{visibility:collapse}"):
        assert text(rule.format(hides)) == "y", hides
    assert text("<style>.a{display:none}</style><p class=a style='display:block'>x") == "x"
    assert text("<style>.a{display:none!important}</style><p class=a style='display:block'>x") == ""
    assert text("<style>i{display:inline}</style><i hidden>x</i><dialog style='display:block'>y</dialog>") == "x\ny"
    assert text("<div style='visibility:hidden'>a<b style='visibility:visible'>b<i>c</i></b><p>d</div>e") == "bc\n\ne"
    assert text("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>") == "b"


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["noscript", "template", "iframe", "textarea"]), st.sampled_from(["head", "body"]), st.sampled_from([".a{display:none}", "p{visibility:hidden}", "*{display:none}"]))
def test_sheets_that_arent_applied(around, part, rule):
    page = f"<{part}><{around}><style>{rule}</style></{around}></{part}><p class=a>shown"
    assert text(page).endswith("shown")


def test_numbers():
    assert text("<ol start=-1><li>a<li>b<li>c</ol>") == "-1. a\n0. b\n1. c"
    assert text("<ol reversed><li>a<li>b<ol><li>i</ol><li>c</ol>") == "3. a\n2. b\n  1. i\n1. c".replace("  1.", "   1.")
    assert text("<ol reversed start=10><li>a<li>b</ol>") == "10. a\n9. b"
    assert text("<ol><li>a<div><li>b</div><div><li>c</div></ol>") == "1. a\n\n2. b\n\n3. c".replace("\n\n", "\n")
    assert text("<li>x<ul><li>y</ul>") == "- x\n  - y"


def test_large_and_broken_pages_take_linear_time():
    import time

    for page in ("<div>" * 200_000, "<b>" * 1_000 + "</i>" * 250_000, "<div>" * 20_000 + "</i>" * 200_000, "<ul><li>x" * 100_000, "<blockquote>x" * 75_000, "<table><tr><td>x" * 60_000, "<pre>x\n" * 100_000, "<table>" + "<b>x" * 150_000, "<ol reversed><li>x" * 50_000):
        began = time.time()
        extract(page)
        assert time.time() - began < 60, page[:30]
