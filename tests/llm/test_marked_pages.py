import time

import pytest

from lagloom.llm import html_text as H
from lagloom.llm.markup import NOISE, scan
from marked_pages import accuracy, pages


def test_accuracy_on_pages_marked_by_hand():
    precision, recall = accuracy(H.main_lines)
    assert precision > 0.97
    assert recall > 0.99


def test_the_windows_decide():
    """Without sums over windows, and without any distribution, the text is worse."""
    whole = accuracy(H.main_lines)
    alone = accuracy(lambda page: H.main_lines(page, window=1))
    marks = accuracy(lambda page: [line.text for line in scan(page)[0] if line.mark != NOISE])
    assert alone[1] < whole[1] - 0.01
    assert marks[0] < whole[0] - 0.02


#: Pages of any size: what is repeated, how often at full size, then the middle, what is repeated after it, and the end.
BROKEN = [("<script ", 100_000, "", "", ""), ("<a ", 100_000, "", "", ""), ("<a x='", 100_000, "", "", ""), ("<", 300_000, "", "", ">"), ('<a x=">" ', 60_000, "", "", ""), ("<div>", 50_000, "x", "</p>", ""), ("<title>", 100_000, "", "", ">"), ("<span class=ad>", 50_000, "", "</b>", ">"), ("<p title=it's>Don't stop ", 30_000, "", "", ""), ("<div class=ad>x", 50_000, "", "", ""), ("<table><div>", 30_000, "", "</div>", ""), ("<!--", 100_000, "", "", ">")]


@pytest.mark.parametrize("bad", BROKEN)
def test_broken_markup_takes_linear_time(bad):
    """Twice the page takes less than three times as long, from a quarter to a half to the whole, on any machine."""
    unit, full, middle, after, end = bad

    def seconds(n):
        page, took = unit * n + middle + after * n + end, []
        for _ in range(3):
            at = time.process_time()
            H.main_lines(page)
            took.append(time.process_time() - at)
        return min(took)

    quarter, half, whole = (seconds(full // n) for n in (4, 2, 1))
    # Where a quarter takes no time to speak of, the whole must not either.
    assert half < max(3 * quarter, 0.05) and whole < max(3 * half, 0.1)


def test_an_unclosed_tag_is_text():
    assert H.main_lines("<p>1 <a and b") == ["1 <a and b"]
    assert H.main_lines("<title-card>Words in here</title-card>") == ["Words in here"]


def test_windows_are_sums_of_neighbours():
    import random

    rng = random.Random(3)
    for _ in range(50):
        x, k = [float(rng.randrange(9)) for _ in range(rng.randrange(12))], rng.randrange(1, 5)
        assert H.windows(x, k) == [sum(x[max(0, i - k + 1) : i + 1]) for i in range(len(x) + k - 1)]


def test_marks_are_whole():
    assert all(want and "⟦" not in page for _, page, want in pages())
