"""Page forms written by hand: the page and the blocks of its main text."""

S = "The council met on Tuesday evening to discuss the new bridge over the river. ".strip()
T = "Several residents spoke against the plan, which they say would bring more traffic through the old town."
U = "A final decision is expected in March, after the engineers have handed in their report."
def ps(n, leaf="p"): return "".join(f"<{leaf}>{x}</{leaf}>" for x in ([S, T, U] * 3)[:n])
def want(n): return ([S, T, U] * 3)[:n]
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 The Gazette. All rights reserved.</footer>"
FORMS = {}
for n in (1, 2, 3, 5):
    FORMS[f"article p {n}"] = (f"<article>{ps(n)}</article>", want(n))
    FORMS[f"main p {n}"] = (f"<main>{ps(n)}</main>", want(n))
    FORMS[f"nav main footer {n}"] = (f"{NAV}<main>{ps(n)}</main>{FOOT}", want(n))
    FORMS[f"div p {n}"] = (f"<div>{ps(n)}</div>", want(n))
    FORMS[f"article div {n}"] = (f"<article>{ps(n, 'div')}</article>", want(n))
    FORMS[f"bare p {n}"] = (ps(n), want(n))
    FORMS[f"one p of sentences {n}"] = (f"<article><p>{' '.join(want(n))}</p></article>", [" ".join(want(n))])
    FORMS[f"plain text {n}"] = (" ".join(want(n)), [" ".join(want(n))])
    FORMS[f"main one p {n}"] = (f"<main><p>{' '.join(want(n))}</p></main>", [" ".join(want(n))])
FORMS |= {
    "plain ten": (" ".join(want(9)), [" ".join(want(9))]),
    "header article div footer": (f"<header><h1>Site</h1></header><article><div>{' '.join(want(3))}</div></article>{FOOT}", [" ".join(want(3))]),
    "h1 in article": (f"{NAV}<article><h1>New bridge</h1>{ps(3)}</article>{FOOT}", ["New bridge", *want(3)]),
    "h1 bare": (f"<h1>New bridge</h1>{ps(3)}", ["New bridge", *want(3)]),
    "list of links inside": (f"<article>{ps(2)}<ul><li><a href='#'>The report of the engineers</a></li><li><a href='#'>The plan of the council</a></li></ul></article>", [*want(2), "The report of the engineers", "The plan of the council"]),
    "last is a link": (f"<article>{ps(2)}<p>See <a href='#'>the full report of the engineers on the new bridge</a></p></article>", [*want(2), "See the full report of the engineers on the new bridge"]),
    "comments inside": (f"<article>{ps(3)}<section class='comments'><h3>Comments</h3><div class='comment'><p>I never liked that bridge anyway, to be honest with you.</p></div></section></article>", want(3)),
    "comments outside": (f"{NAV}<article>{ps(3)}</article><section id='comments'><h3>Comments</h3><div class='comment'><p>I never liked that bridge anyway, to be honest with you.</p></div></section>{FOOT}", want(3)),
    "nav div p footer": (f"{NAV}<div>{ps(3)}</div>{FOOT}", want(3)),
    "content div": (f"{NAV}<div class='content'>{ps(3)}</div>{FOOT}", want(3)),
    "sidebar": (f"{NAV}<main>{ps(3)}</main><aside class='sidebar'><h3>Popular</h3><p>Ten ways to cook an egg, by our chef.</p></aside>{FOOT}", want(3)),
    "cookie notice": (f"<div class='cookie-notice'>We use cookies to improve your experience on this site.</div><article>{ps(3)}</article>", want(3)),
    "newsletter": (f"<article>{ps(3)}</article><form class='newsletter'><p>Subscribe to our newsletter for more stories.</p><label>Mail</label> <input><button>Go</button></form>", want(3)),
    "advert inside": (f"<article>{ps(1)}<div class='ad'>Buy the best shoes of the season now at half the price.</div><p>{T}</p></article>", [S, T]),
    "blockquote": (f"<main>{ps(1)}<blockquote><p>{T}</p></blockquote><p>{U}</p></main>", [S, T, U]),
    "table": (f"<article>{ps(2)}<table><tr><td>Length</td><td>200 m</td></tr></table></article>", [S, T, "Length", "200 m"]),
    "ordered list": (f"<article>{ps(1)}<ol><li>The first bridge was built of wood.</li><li>The second one was built of stone.</li></ol></article>", [S, "The first bridge was built of wood.", "The second one was built of stone."]),
    "section leaves": (f"{NAV}<main><section><h2>Plan</h2>{ps(2)}</section><section><h2>Cost</h2><p>{U}</p></section></main>{FOOT}", ["Plan", S, T, "Cost", U]),
    "header site and main": (f"<header><a href='/'>The Gazette</a>{NAV}</header><main><h1>New bridge</h1>{ps(3)}</main>{FOOT}", ["New bridge", *want(3)]),
    "pre": (f"<article>{ps(2)}<pre>x = 1 y = 2</pre></article>", [S, T, "x = 1 y = 2"]),
    "short paragraphs": ("<article><p>It rained.</p><p>We stayed in.</p><p>Nobody came.</p></article>", ["It rained.", "We stayed in.", "Nobody came."]),
    "short in main with nav": (f"{NAV}<main><p>It rained.</p><p>We stayed in.</p></main>{FOOT}", ["It rained.", "We stayed in."]),
    "unclosed p": (f"<body><article><p>{S}<p>{T}<p>{U}", [S, T, U]),
    "nested divs": (f"<div><div><div>{ps(3)}</div></div></div>", want(3)),
    "related after": (f"<article>{ps(3)}</article><section class='related'><h3>Related</h3><p>The old bridge turns one hundred this year.</p></section>{FOOT}", want(3)),
    "breadcrumbs": (f"<div class='breadcrumbs'><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></div><article>{ps(2)}</article>", want(2)),
    "cue words": (f"{NAV}<article><p>The share of cars in the traffic fell.</p><p>In reply, the council asked to read more of the plan before it would subscribe to it.</p></article>{FOOT}", ["The share of cars in the traffic fell.", "In reply, the council asked to read more of the plan before it would subscribe to it."]),
    "cue words bare": (f"<p>{S} Advertising on the bridge is not allowed.</p><p>{T}</p>", [f"{S} Advertising on the bridge is not allowed.", T]),
    "definition list": (f"<main>{ps(1)}<dl><dt>Span</dt><dd>The length between two pillars.</dd></dl></main>", [S, "Span", "The length between two pillars."]),
    "article in a wrapper": (f"<div id='wrap'>{NAV}<div id='page'><article>{ps(3)}</article></div>{FOOT}</div>", want(3)),
}
