import pytest

from quillsift.llm import html_text as h

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>No title</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this long and wordy thing now, it is very good for you.</div>
<div class="cookie-notice">We use cookies for many long reasons.</div><form><label>Name</label><input></form>{}<aside>See also other things</aside>
<section id="comments"><article class="comment"><p>First comment by a reader, quite long indeed.</p></article></section><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    "article,text",
    [
        ("<article><h1>A &amp; B</h1><p><b>Bold  start<br>more\n text<p>Second &eacute;.</p><p>x</p></article>", "A & B\nBold start more text\nSecond é.\nx"),
        ("<article><header><h1>T</h1></header><ul><li>one<li>two</ul><div class='share'>Tweet</div><p>End.</article>", "T\none\ntwo\nEnd."),
        ("<main><p>only main</p><script>x</script></main>", "only main"),
        ("<div id='x'><p>Long text of a page that has no article at all.</p><p>And more of it, with <a href='#'>a link</a>.</p><p>Short.</p></div>", "Long text of a page that has no article at all.\nAnd more of it, with a link.\nShort."),
        ("<article><table><tr><td>a<td>b</table><pre>c  d</pre></article>", "a\nb\nc d"),
        ("<article></article>", ""),
        ("<article><p>hidden <span style='display: none'>trap</span>word</p><p hidden>no</p></article>", "hidden word"),
    ],
)
def test_main_text(article, text):
    assert h.extract(PAGE.replace("{}", article)) == text


def test_truncated_empty_and_null_pages(spark):
    assert h.extract(None) == h.extract("") == h.extract("<html><body>") == ""
    assert h.extract("<article><p>cut off here and th") == "cut off here and th"
    assert h.extract("just text &lt; no markup") == "just text < no markup"
    bare = PAGE.replace("{}", "")
    rows = [(1, "u", bare, "x"), (1, "u", bare, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [r.n_chars for r in h.main_text(df).collect()] == [0, 0, 0]
    assert h.main_text(df.limit(0)).count() == 0


def test_feeding_in_pieces_changes_nothing(monkeypatch):
    page = PAGE.replace("{}", "<article>" + "<p>Some words &amp; more.</p>" * 50 + "</article>")
    whole = h.extract(page)
    monkeypatch.setattr(h, "FEED", 7)
    assert h.extract(page) == whole and whole.count("\n") == 49


def test_clusters():
    assert h.threshold([1.0, 1.0, 9.0, 11.0]) > 1 and h.threshold([2.0, 2.0]) == 2.0
    assert h.smoothed([5.0] * 4) == pytest.approx([5.0] * 4)


def plain_pages(n=60):
    """(page, its main text): wrappers are nameless div elements; menus, teasers, notices and footers have no telling name either."""
    import random

    r = random.Random(4)
    said = lambda a, b: " ".join(r.choice(["tal", "mora", "en", "visu", "kel", "oder", "sam", "li"]) for _ in range(r.randint(a, b))) + "."
    for i in range(n):
        title = said(3, 8)
        paragraphs = [said(30, 120) if r.random() < 0.8 else said(2, 8) for _ in range(r.randint(4, 15))]
        paragraphs[0] = said(40, 80)
        menu = "<div>" + "".join(f"<div><a href='/{k}'>{said(1, 2)}</a></div>" for k in range(r.randint(4, 9))) + "</div>"
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        if i % 3 == 0:  # the heading and the lead stand beside a nested body
            main = f"<div><h1>{title}</h1><p>{paragraphs[0]}</p><div>" + "".join(f"<p>{x}</p>" for x in paragraphs[1:]) + "</div></div>"
        elif i % 3 == 1:
            main = f"<div><h1>{title}</h1>{body}</div>"
        else:
            main = f"<div><div><h1>{title}</h1></div><div>{body}</div></div>"
        teaser = f"<div><div><a href='#'>{said(2, 4)}</a> <span>{said(2, 4)}</span></div><div><a href='#'>{said(2, 4)}</a></div></div>"
        yield f"<html><body><div>{menu}{main}{teaser}<div>{said(3, 8)} <a href='/i'>{said(1, 2)}</a></div></div></body></html>", [title, *paragraphs]


def measured():
    found = wanted = both = 0
    for page, text in plain_pages():
        own = h.extract(page).split("\n")
        found, wanted = found + sum(map(len, own)), wanted + sum(map(len, text))
        both += sum(len(x) for x in text if x in own)
    return both / wanted, both / found


def test_recall_and_precision_where_no_name_tells():
    recall, precision = measured()
    assert recall > 0.97 and precision > 0.97


def test_smoothing_decides_the_region(monkeypatch):
    """A long line among links is no content, and short lines among long ones are; without smoothing the common parent is the region."""
    links = "".join(f"<div><a href='#'>link {i}</a></div>" for i in range(4))
    teaser = f"<div>{links}" + 4 * f"<div>{'One teaser among the links. ' * 6}</div>{links}" + "</div>"
    body = "<div>" + "".join(3 * f"<p>{'Long and plain talk of the town. ' * 7}</p>" + "<p>Short.</p>" for _ in range(4)) + "</div>"
    page = f"<html><body><div>{body}{teaser}</div></body></html>"
    text = h.extract(page)
    assert "teaser" not in text and "link" not in text and text.count("Short.") == 4
    monkeypatch.setattr(h, "smoothed", lambda values: values)
    assert "teaser" in h.extract(page)


def test_names_that_only_hint_are_decided_by_the_clusters():
    long = "<p>" + "Much is known about this matter by now. " * 6 + "</p>"
    page = f"<article id='notice-of-x'><h2 id='related-work'>Related work</h2><section id='social-effects'>{long}</section>{long}<div class='ad-slot'><a href='#'>Buy</a> <i>now</i></div></article>"
    text = h.extract(f"<html><body>{page}</body></html>")
    assert text.startswith("Related work\nMuch") and text.count("matter") == 12 and "Buy" not in text


def test_a_very_long_page_is_read_to_its_end():
    page = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(40_000)) + "</article>"
    assert h.extract(page).endswith("Paragraph 39999 of a long page.")
