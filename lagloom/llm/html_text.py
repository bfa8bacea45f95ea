"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element (``markup.scan``). A line weighs as many characters as it has
outside links; containers weigh on it as stated below, and decide nothing else. The weights of all lines are summed over
sliding windows. The text surges where a window reaches the threshold and dives behind the last that does; between the
two every line stays, however short, but for those in menus, notices, forms and the like. The threshold is 40 characters
or half of the heaviest window, whatever is less.

The text's container is the page's articles, if they hold a third of its weight, or else its ``main`` element, or
else the element that holds most of the heaviest run, and what stands beside that with the same tag and class. Inside
it a line weighs so much more that each window of it, and an article of a line or two, reaches the threshold: nothing
of it is lost for being short. Outside it a line weighs a tenth beside articles, else two fifths, so that only
dense text surges there.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.arrow import Columns, map_columns
from lagloom.llm.markup import NOISE, SOFT, Line, scan

WINDOW, SURGE = 3, 40.0
#: Beside a container, lines of less weight than this at the ends of a run are cut off; lines inside it weigh more.
EDGE = 12.0


def windows(weights: list[float], window: int) -> list[float]:
    """The sums over ``window`` lines, the i-th ending with line i; the first and last windows are cut short."""
    out, total = [], 0.0
    for i in range(len(weights) + window - 1):
        total += weights[i] if i < len(weights) else 0
        total -= weights[i - window] if i >= window else 0
        out.append(total)
    return out


def runs(weights: list[float], window: int = WINDOW, surge: float = SURGE, edge: float = 1e-6) -> list[tuple[int, int]]:
    """(first line, line after the last) from each surge to its dive; lines lighter than ``edge`` at either end are cut off."""
    sums = windows(weights, window)
    least = max(min(surge, max(sums, default=0) / 2), 1e-6)
    out: list[tuple[int, int]] = []
    n = len(weights)
    for i, total in enumerate(sums):
        # A float sum of thirds may fall short of the threshold by a rounding error.
        if total + 1e-6 < least:
            continue
        first, last = max(0, i - window + 1), min(n, i + 1)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    trimmed = []
    for first, last in out:
        while first < last and weights[first] < edge:
            first += 1
        while last > first and weights[last - 1] < edge:
            last -= 1
        if first < last:
            trimmed.append((first, last))
    return trimmed


def _holders(lines: list[Line], boxes: list[tuple[int, str, str]], own: list[float]) -> set[int]:
    """The elements of the text's container where neither articles nor a main element tell it; empty for the page itself."""
    heaviest = max(runs(own), key=lambda r: (sum(own[r[0] : r[1]]), -r[0]), default=None)
    if heaviest is None:
        return set()
    held, half = [0.0] * len(boxes), sum(own[slice(*heaviest)]) / 2
    for line, w in zip(lines[slice(*heaviest)], own[slice(*heaviest)], strict=True):
        held[boxes[line.box][0] if boxes[line.box][1] in _LEAVES else line.box] += w
    # Elements are numbered after those around them: what the smaller hold goes up to the first that holds half.
    holder = 0
    for box in range(len(boxes) - 1, 0, -1):
        if held[box] >= half:
            holder = box
            break
        held[boxes[box][0]] += held[box]
    if boxes[holder][1] in ("", "html", "body"):
        return set()
    return {b for b, box in enumerate(boxes) if box == boxes[holder]}


_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption".split())


def _weighed(lines: list[Line], boxes: list[tuple[int, str, str]], strict: bool) -> tuple[list[float], list[bool], float]:
    """The weight of each line, whether it is boilerplate, and what a line at the ends must weigh. Unless ``strict``, class words and forms tell nothing."""
    noise = [line.mark == NOISE and (strict or not line.weak) for line in lines]
    # Three lines and more of nothing but links are a menu, whatever holds them; so is an article of links.
    links: Counter[int] = Counter()
    sizes: Counter[int] = Counter()
    for i, line in enumerate(lines):
        if not noise[i]:
            sizes[line.article] += len(line.text)
            links[line.article] += line.linked
    cards = {a for a in sizes if a and links[a] >= 0.9 * sizes[a]}
    run: list[int] = []
    for i, line in enumerate([*lines, None]):
        if line is not None and line.linked >= 0.9 * len(line.text) and (not line.article or line.article in cards):
            run.append(i)
            continue
        for k in run if len(run) >= 3 or (run and lines[run[0]].article) else ():
            noise[k] = True
        run = []
    own = [0.0 if noise[i] or line.mark == SOFT else float(len(line.text) - line.linked) for i, line in enumerate(lines)]
    total = sum(own)
    if sum(w for w, line in zip(own, lines, strict=True) if line.article and line.article not in cards) * 3 >= total > 0:
        inside, outside = [line.article if line.article not in cards else 0 for line in lines], 0.1
    elif sum(w for w, line in zip(own, lines, strict=True) if line.main) * 3 >= total > 0:
        inside, outside = [line.main for line in lines], 0.1
    else:
        holders, in_holder = _holders(lines, boxes, own), [0]
        for box, (around, _, _) in enumerate(boxes[1:], 1):
            in_holder.append(box if box in holders else in_holder[around])
        inside, outside = [in_holder[line.box] for line in lines], 0.4 if holders else 1.0
    many = Counter(x for x in inside if x)
    weights = []
    for i, line in enumerate(lines):
        if inside[i]:
            # Boilerplate inside the container must not part what stands around it.
            weights.append(SURGE / min(WINDOW, many[inside[i]]) + (0 if noise[i] else len(line.text)))
        else:
            noise[i] = noise[i] or line.mark == SOFT
            weights.append(outside * own[i] + (EDGE if own[i] and boxes[line.box][1] in ("h1", "h2") else 0))
    return weights, noise, EDGE if many else 1e-6


def main_lines(page: str, window: int = WINDOW) -> list[str]:
    """The lines between surge and dive of the page's line-block distribution, without boilerplate."""
    lines, boxes = scan(page)
    for strict in (True, False):
        weights, noise, edge = _weighed(lines, boxes, strict)
        kept = [lines[i].text for first, last in runs(weights, window, edge=edge) for i in range(first, last) if not noise[i]]
        if kept:
            return kept
    return []


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of ``pages``.

    A null or empty page, and a page without main text, gives an empty text. Null ids and urls and repeated rows stay;
    an empty table gives no rows; other columns of ``pages`` are not read. Broken markup never fails, and takes time in
    proportion to its length: unclosed elements end with the page, stray end tags are ignored, unclosed tags are text.
    """

    def make():
        def extract(c: Columns) -> Columns:
            texts = ["\n".join(main_lines(x)) if x else "" for x in c["html"]]
            return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return extract

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_columns(rows, make, "page_id long, url string, text string, n_chars long", rows=64)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
