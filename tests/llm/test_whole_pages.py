from lagloom.llm import html_text as H

LONG = "A paragraph of the article that is long enough to weigh something in its window."
NOISE = "<div class='ad'>Buy</div><div class='related'>More</div><form>Mail</form>"


def test_boilerplate_inside_the_body_does_not_end_the_text():
    lines = [f"{LONG} {k}" for k in range(9)]
    text = [f"<p>{x}</p>" for x in lines]
    for before, after in (("<body>", "</body>"), ("<body><div>", "</div></body>")):
        assert H.main_lines(before + "".join(text[:5]) + NOISE + "".join(text[5:]) + after) == lines
    parts = "<section>" + "".join(text[:5]) + "</section>" + NOISE + "<section>" + "".join(text[5:]) + "</section>"
    assert H.main_lines(f"<body><div>{parts}</div></body>") == lines


def test_sibling_articles_are_one_text():
    page = f"<div><article><p>{LONG} 1</p></article><article><p>{LONG} 2</p></article><article class='comment'><p>{LONG}</p></article></div>"
    assert H.main_lines(page) == [f"{LONG} 1", f"{LONG} 2"]
