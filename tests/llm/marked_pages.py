"""Pages marked by hand: what stands between ⟦ and ⟧ is the main text, a line each. Templates as they are met on the web."""

from __future__ import annotations

import html
import re

P = [
    "The harbour wall was rebuilt after the storm of that winter, and the town paid for it over nine years.",
    "Two engineers had warned of the undercut stones, but nobody wished to close the quay before the herring came.",
    "When the sea took the lamp house, the council met in the school and voted the money in a single evening.",
    "Granite came by rail from the north; the old blocks were left in place as a foundation for the new.",
    "Today the wall carries a road, a footpath and the pipes of the waterworks, and it is inspected twice a year.",
    "Visitors are told that it was never breached again, which is true if one does not count the spring of 1953.",
]

MARKED = {
    "blog with article": f"""<html><head><title>Wall</title></head><body><header class="site-header"><a href="/">Harbour blog</a><p>Notes from the coast</p></header>
<nav class="main-navigation"><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></nav>
<main><article class="post"><header class="entry-header"><h1>⟦The wall⟧</h1><p class="entry-meta">⟦By A. Mason⟧</p></header>
<p>⟦{P[0]}⟧</p><div class="ad-slot">Buy boots now, they are cheaper than ever before in this shop of ours.</div><p>⟦{P[1]}⟧</p><p>⟦So it went.⟧</p>
<div class="share-buttons"><a href=x>Share</a> <a href=y>Tweet</a></div></article>
<section id="comments"><h2>2 comments</h2><article class="comment"><p>{P[5]} I remember it well.</p></article><form><label>Your words</label><textarea>x</textarea></form></section></main>
<aside class="widget-area"><h3>Archive</h3><ul><li><a href=c>May</a></li></ul></aside><footer class="site-footer">All rights reserved by the harbour blog and its owners since the year 2001.</footer></body></html>""",
    "plain divs": f"""<body><div id="top"><div class="logo">Daily Quay</div><div class="menu"><a href=1>News</a> | <a href=2>Sport</a> | <a href=3>Tides</a></div></div>
<div id="story"><h1>⟦Wall reopened⟧</h1><div class="date">⟦4 May⟧</div><p>⟦{P[2]}⟧</p><p>⟦{P[3]}⟧</p><p>⟦No.⟧</p></div>
<div id="bottom"><div>Contact</div><div>Imprint</div><div>Terms</div></div></body>""",
    "no container at all": f"""<h1>⟦Wall⟧</h1><p>⟦{P[0]}⟧</p><p>⟦{P[1]}⟧</p><p>⟦Ah.⟧</p><p>⟦{P[2]}⟧</p>
<ul><li><a href=1>One page</a><li><a href=2>Two pages</a><li><a href=3>Three pages</a></ul><p>Page 7</p>""",
    "two articles": f"""<div class="list"><article><h2>⟦First⟧</h2><p>⟦{P[0]}⟧</p></article><div class="promo">Subscribe to us</div><article><h2>⟦Second⟧</h2><p>⟦{P[1]}⟧</p><p>⟦Yes.⟧</p></article></div>
<div>Weather: rain</div><div>Tide: low</div>""",
    "articles in different places": f"""<div><div><article><p>⟦{P[0]}⟧</p></article></div></div><nav><a href=x>Next</a></nav><section><article><p>⟦{P[1]}⟧</p></article></section>""",
    "page in one form": f"""<form id="aspnetForm"><div class="nav"><a href=1>Start</a></div><div id="content"><h2>⟦Report⟧</h2><p>⟦{P[3]}⟧</p><p>⟦{P[4]}⟧</p></div><div class="footer">Printed by the council</div></form>""",
    "topic words in classes": f"""<article><section class="social-policy"><p>⟦{P[0]}⟧</p></section><section id="comment-on-law"><p>⟦{P[1]}⟧</p></section><p class="promotion">⟦She was promoted.⟧</p><h2 id="comments">⟦Comments of the council⟧</h2><label>⟦Fig. 1⟧</label><p>⟦Let <math><mi>x</mi></math> be it.⟧</p><canvas>⟦A chart of tides⟧</canvas></article>""",
    "teasers are articles": f"""<body><div class="teasers"><article><a href=1>Boats for sale near you</a></article><article><a href=2>Nets mended while you wait</a></article><article><a href=3>Ropes</a></article></div>
<div class="body-copy"><p>⟦{P[4]}⟧</p><p>⟦{P[5]}⟧</p><p>⟦End.⟧</p></div></body>""",
    "table layout": f"""<table><tr><td><a href=1>Home</a><br><a href=2>Map</a></td><td><table><tr><td><p>⟦{P[0]}⟧<p>⟦{P[1]}⟧<p>⟦{P[2]}⟧</td></tr></table></td></tr><tr><td><font size=1>Best viewed at 800</font></td></tr></table>""",
    "quotes gone wrong": f"""<main><p title=it's>⟦Don't stop: {P[0]}⟧</p><title-card>⟦{P[1]}⟧</title-card><p data-x="a > b">⟦{P[2]}⟧</p><p>⟦1 < 2 &amp; so on⟧</p></main><footer>x</footer>""",
    "paragraph boxes": "<body><div class=brand>Quay</div><div class=strap>since 1900</div><div id=c>" + "".join(f"<div class=par><p>⟦{x}⟧</p></div>" for x in [*P[:3], "Oh.", *P[3:]]) + "</div><div class=colophon>Set in Bodoni</div></body>",
    "documentation": f"""<body><div role="banner">Docs</div><div role="navigation"><ul><li><a href=1>Intro</a></li><li><a href=2>API</a></li></ul></div><main id="main-content"><h1>⟦wall()⟧</h1><p>⟦{P[3]}⟧</p><pre>⟦wall(stone, height)⟧</pre><ul><li>⟦stone: which⟧</li><li>⟦height: in metres⟧</li></ul><table><tr><th>⟦Code⟧</th><td>⟦3⟧</td></tr></table><div class="pagination"><a href=4>Next</a></div></main><div class="cookie-banner">We use cookies to measure how this page is read by our many visitors.</div></body>""",
    "hidden and inline": f"""<article><p>⟦{P[0]}⟧</p><p hidden>{P[1]}</p><div style="display: none">{P[2]}</div><p>⟦Ends <span class="ad">buy</span>here.⟧</p><svg><title>icon</title></svg><noscript>Turn scripts on</noscript></article>""",
}


def pages() -> list[tuple[str, str, list[str]]]:
    """(name, page, lines of main text)."""
    out = []
    for name, page in MARKED.items():
        lines = [re.sub(r"<span class=\"ad\">.*?</span>", "", x) for x in re.findall("⟦(.*?)⟧", page, re.S)]
        lines = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", x)).split()) for x in lines]
        out.append((name, page.replace("⟦", "").replace("⟧", ""), lines))
    return out


def accuracy(extract) -> tuple[float, float]:
    """Precision and recall of ``extract`` in characters of lines, over all pages."""
    right = given = wanted = 0
    for _, page, want in pages():
        got, left = extract(page), list(want)
        given, wanted = given + sum(map(len, got)), wanted + sum(map(len, want))
        for line in got:
            if line in left:
                left.remove(line)
                right += len(line)
    return right / max(given, 1), right / wanted
