import pytest

from lagloom.llm import html_text as H

LONG = "A paragraph of the article that is long enough to weigh something in its window."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("<p>", []),
        (f"<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>Short.<p>{LONG}</p>\n</article><footer>&copy; x</footer>", ["T & U", "Short.", LONG]),
        (f"<script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}  \n x&nbsp;y<br>z</p>", [f"{LONG} x y z"]),
        (f"<article><header><h1>Head</h1></header><div class='ad'>Buy</div><p>{LONG}</p><form><label>Mail</label><button>Send</button></form><section id='comments'><p>{LONG} no</p></section></article>", ["Head", LONG]),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG * 3}</p></article>", [LONG]),
        (f"<div class='cookie-notice'>{LONG}</div><ul><li><a>One link</a><li><a>Two link</a><li><a>Three link</a></ul><h1>Title</h1><div><p>{LONG}</p><p>End.</p></div><aside>{LONG}</aside>", ["Title", LONG, "End."]),
        ("<p>1 < 2 and a > b</p>", ["1 < 2 and a > b"]),
        (f"<main><p>{LONG}</main></div></p><p unclosed='", [LONG]),
        ("plain text without markup", ["plain text without markup"]),
    ],
)
def test_main_lines(page, want):
    assert H.main_lines(page) == want


def test_the_dive_ends_the_text_without_an_article():
    far = "".join(f"<div class='widget'>w{i}</div>" for i in range(4))
    assert H.main_lines(f"<div><p>{LONG}</p><p>{LONG}</p></div>{far}<p>tail</p>") == [LONG, LONG]


def test_extract(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "t"), (1, "u", f"<article><p>{LONG}</p></article>", "t"), (None, None, None, None), (2, "v", "<p>" + "x " * 200_000 + "</p>", ""), (3, "w", "<nav>only menu</nav>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"], r["text"][:20]) for r in H.extract_text(df).collect())
    assert got == [(0, 0, ""), (1, len(LONG), LONG[:20]), (1, len(LONG), LONG[:20]), (2, 399_999, "x x x x x x x x x x "), (3, 0, "")]
    assert H.extract_text(df.limit(0)).count() == 0


def test_pathological_markup_is_linear():
    H.main_lines("<a " + "x='" * 50_000)
    H.main_lines("<" * 100_000)
    H.main_lines("<div>" * 20_000 + "text" + "</p>" * 20_000)
