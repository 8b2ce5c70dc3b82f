import pytest

from listwright.llm import html

P = "This is a sentence of the article, and it goes on for a while before it ends."


@pytest.mark.parametrize("page, texts", [
    (None, []), ("", []), ("<p></p><div> </div>", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>a <b>b</b>\n  c<br>d<p>e", ["a b c d", "e"]),
    ("<p>1 &lt; 2 &copy &#233; &amp;amp;</p>", ["1 < 2 © é &amp;"]),
    ("<script>var t='</p>';<p>no</script>yes<style>p{}</style><!-- <p>no -->", ["yes"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<a title='>'>x</a>y", ["xy"]),
    ("<div>a<div>b</div>c</div>", ["a", "b", "c"]), ("<P>A</P><p>cut <b cl", ["A", "cut"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("a</p></div>b", ["a", "b"]),
    ("<template><p>no</p></template><p>x</p>", ["x"]), ("<p>a < b</p>", ["a < b"]),
    ("<p class=it's>a<p>it's", ["a", "it's"]), ('<p class="x"">a</p><p>say "b"</p>', ["a", 'say "b"']),
    ("<p title = 'a > b' x=\"c > d\">e</p>", ["e"]), ('<p a=b"c>d</p>"', ["d", '"']), ('<p a"b>c</p>', ["c"]), ("<p =>c</p>", ["c"]),
    ("<p>a <x-term>b</x-term>, <ruby>c<rt>d</rt></ruby> <data value=1>e</data> <nobr>f</nobr> <output>g</output>.</p>", ["a b, cd e f g."]),
    ('<p class="open>a</p>', []),
])
def test_blocks(page, texts):
    assert [b.text for b in html.blocks(page)] == texts


def test_ancestors_and_names():
    block, = html.blocks('<body><div class="Side-bar x" id=main data-id=y><p><b>t</b></p></div>')
    assert [t for t, _ in block.path] == ["body", "div", "p"] and block.path[1][1] == {"side-bar", "x", "main"}
    names = ["share-price", "share-buttons", "site-footer", "comment_list", "ad", "menu", "nav-menu", "x1"]
    assert [html.kind(n) for n in names] == ["price", "share", "footer", "comment", "ad", "menu", "nav", "x"]


def site(i):
    body = "".join(f"<p>{P} It is number {i} {n}.</p>" for n in range(1 + i % 5))
    return (f"<html><head><title>T {i}</title></head><body><nav><ul><li><a href=x>Home</a><li><a>Two</a></ul></nav>"
            f"<article><h1>Title {i}</h1>{body}</article><footer>&copy; site</footer></body></html>")


@pytest.fixture(scope="module")
def field(spark):
    return html.train(spark.createDataFrame([(i, site(i)) for i in range(80)] + [(None, None), (99, "")], "page_id long, html string"))


def test_held_out_pages(field):
    for i in (101, 102, 104):
        assert field.main_text(site(i)) == "\n\n".join([f"Title {i}"] + [f"{P} It is number {i} {n}." for n in range(1 + i % 5)])


def test_furniture_that_the_sample_lacks(field):
    extra = ('<aside><p>Related things to read are listed here for you.</p></aside><form><p>Leave your name here.</p></form>'
             '<div class="comments"><p>I did like this article very much, thank you.</p></div><div class="cookie notice"><p>We use cookies.</p></div>'
             '<div class="sidebar"><p>Most read of the week.</p></div>')
    page = f"<body><header><p>The site of sites.</p></header><article><h1>Head</h1><p>{P}</p>{extra}<p>{P} Twice.</p></article></body>"
    assert field.main_text(page) == f"Head\n\n{P}\n\n{P} Twice."


def test_viterbi_is_the_best_of_all_labellings(field):
    import itertools

    page = html.blocks(site(3))
    rows = [field.emit[[field.index[f] for f in row if f in field.index]].sum(axis=0) for row in html.features(page)]

    def score(labels):
        return sum(r[k] for r, k in zip(rows, labels)) + sum(field.step[a][b] for a, b in zip(labels, labels[1:]))

    best = max(itertools.product((0, 1), repeat=len(page)), key=score)
    assert list(best) == field.decode(page)


def test_without_labelled_pages_and_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x")], "page_id long, html string")
    field = html.train(pages)
    rows = pages.select("page_id", html.main_text(pages["html"], field).alias("text")).collect()
    assert {r["page_id"]: r["text"] for r in rows if r["page_id"] < 3} == {1: "", 2: ""}
    assert html.train(pages.limit(0)).main_text(f"<article><p>{P}</p></article>") == P
    assert len(field.main_text(f"<article>{f'<p>{P}</p>' * 5000}</article>")) > 300_000


def test_formulas_and_fallback_texts_are_text():
    page = (
        "<article><p>Here <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>, as shown.</p>"
        "<p>Before <noscript>without scripts</noscript> after.</p><object data='a.pdf'><p>The file is a report.</p></object></article>"
    )
    found = html.blocks(page)
    assert [b.text for b in found] == [
        "Here x = 1 2, as shown.", "Before", "without scripts", "after.", "The file is a report.",
    ]
    tags = [[tag for tag, _ in b.path] for b in found]
    assert tags == [["article", "p"], ["article", "p"], ["article", "p", "noscript"], ["article", "p"], ["article", "object", "p"]]


def test_digits_are_sought_in_the_whole_block():
    rows = html.features(html.blocks(f"<p>{'word ' * 100}in 1984.</p><p>{'word ' * 100}</p>"))
    assert ["digits" in row for row in rows] == [True, False]


def plain(tag, inner):
    return f"<body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>{tag}{inner}</div><footer><p>&copy; site</p></footer></body>"


PARAGRAPHS = [f"{P} Part {n}." for n in range(8)]
TEXTS = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("tag", ['<div class="content">', "<div>", '<div id="post-17">', '<div class="story it\'s">'])
def test_pages_without_semantic_tags(field, tag):
    assert field.main_text(plain(tag, f"<h1>Head</h1>{TEXTS}")) == "\n\n".join(["Head", *PARAGRAPHS])


def test_short_lists_in_an_article(field):
    items = "<ul><li>Salt</li><li>Flour</li></ul>"
    for tag in ("<article>", "<main>"):
        page = f"<body><nav><ul><li><a href=x>Home</a></ul></nav>{tag}<h1>Bread</h1>{TEXTS}{items}{TEXTS}{tag.replace('<', '</')}</body>"
        assert field.main_text(page) == "\n\n".join(["Bread", *PARAGRAPHS, "Salt", "Flour", *PARAGRAPHS])


def test_names_that_only_begin_like_furniture(field):
    page = f"<article><h1>Head</h1>{TEXTS}<div class='share-price'><p>{P}</p></div><div class='share-buttons'><p>Share this page with friends.</p></div></article>"
    assert field.main_text(page) == "\n\n".join(["Head", *PARAGRAPHS, P])


@pytest.mark.parametrize("opened", ["<p class=it's>", '<p class="x"">', "<p data-a='b>c'>"])
def test_stray_quotes_lose_no_text(field, opened):
    body = TEXTS.replace("<p>", opened)
    assert field.main_text(f"<body><article><h1>Head</h1>{body}</article></body>") == "\n\n".join(["Head", *PARAGRAPHS])


def test_a_page_of_many_quotes_is_read_in_linear_time(field):
    import time

    start = time.time()
    assert field.main_text("<article><p>" + "<p a='b\"" * 20000 + f">{P}") is not None
    assert html.blocks("<p " + "a=b " * 200000 + f">{P}")[0].text == P
    assert time.time() - start < 20
