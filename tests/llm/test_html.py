"""Hand-written pages of many layouts, none from the rules that make training pages, with their exact main text."""

import time

from lexgraph.llm import html

P1 = "The city council voted on Tuesday to build a new bridge over the river, ending a debate of nine years."
P2 = "It will open in May next year, if the weather holds. The mayor called it a good day for the town."
P3 = "Critics say that the money would be better spent on schools."
LOREM = "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium."

#: (name, html, main text)
PAGES = [
    ("plain div", f"<div><p>{P1}</p><p>{P2}</p></div>", f"{P1}\n{P2}"),
    ("neutral class", f'<div class="col-left"><p>{P1}</p><p>{P2}</p></div>', f"{P1}\n{P2}"),
    ("wiki", f'<div id="mw-content-text"><p>{P1}</p><ul><li>the old bridge</li><li>the new bridge</li></ul><p>{P2}</p></div>', f"{P1}\nthe old bridge\nthe new bridge\n{P2}"),
    ("small heading", f"<main><h4>A bridge at last</h4><p>{P1}</p></main>", f"A bridge at last\n{P1}"),
    ("columns", f'<div class="hd"><a href="/">The Daily</a></div><div class="col-left"><h2>A bridge at last</h2><p class="by">By Ann Smith</p><p>{P1}</p><ul><li>length: 300 metres</li><li>cost: 20 million</li></ul><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2019</td><td>12</td></tr></table><p>{P2}</p></div><div class="col-right"><h3>Related</h3><ul><li><a href="/1">Old bridge closes</a></li><li><a href="/2">Ferry returns</a></li></ul></div><div class="bottom">Copyright 2020 The Daily. All rights reserved.</div>',
     f"A bridge at last\nBy Ann Smith\n{P1}\nlength: 300 metres\ncost: 20 million\nYear\nCost\n2019\n12\n{P2}"),
    ("html5", f'<header><h1>The Daily</h1></header><nav><a href="/">Home</a> <a href="/news">News</a></nav><article><h1>A bridge at last</h1><p>{P1}</p><p>{P2}</p></article><aside><h3>Latest</h3><p><a href="/x">Ferry returns</a></p></aside><footer><p>&copy; 2020 The Daily</p></footer>', f"A bridge at last\n{P1}\n{P2}"),
    ("bootstrap", f'<div class="navbar"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></div><div class="container"><div class="row"><div class="col-md-8"><h1>A bridge at last</h1><p>{P1}</p><p>{P3}</p></div><div class="col-md-4 sidebar"><h4>Popular</h4><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div></div></div><footer class="footer"><p>All rights reserved.</p></footer>', f"A bridge at last\n{P1}\n{P3}"),
    ("tables", f'<table width="100%"><tr><td><a href="/">Home</a> | <a href="/faq">FAQ</a> | <a href="/links">Links</a></td></tr><tr><td><p>{P1}</p><p>{P2}</p></td></tr><tr><td>&copy; 1999 Ann Smith. All rights reserved.</td></tr></table>', f"{P1}\n{P2}"),
    ("comments", f'<article class="post"><h2>A bridge at last</h2><p>{P1}</p><p>{P2}</p></article><section id="comments"><h3>2 comments</h3><div class="comment"><b>Bob</b> says: <p>Great news for all of us!</p></div><div class="comment"><p>I do not agree.</p><a href="#">Reply</a></div></section>', f"A bridge at last\n{P1}\n{P2}"),
    ("cookie bar", f'<div id="cookie-banner">We use cookies. <button>Accept</button></div><div class="story"><h1>A bridge at last</h1><p>{P1}</p><p>{P3}</p></div>', f"A bridge at last\n{P1}\n{P3}"),
    ("advert inside", f'<article><p>{P1}</p><div class="ad">Buy two bridges and get one for free</div><p>{P2}</p></article>', f"{P1}\n{P2}"),
    ("newsletter inside", f'<div class="entry-content"><p>{P1}</p><div class="newsletter"><form><label>Your email</label><button>Subscribe</button></form></div><p>{P2}</p><p>{P3}</p></div>', f"{P1}\n{P2}\n{P3}"),
    ("breadcrumbs", f'<div class="breadcrumbs"><a href="/">Home</a> &raquo; <a href="/n">News</a></div><div id="content"><h1>A bridge at last</h1><p>{P1}</p></div>', f"A bridge at last\n{P1}"),
    ("scripts", f'<head><title>T</title><style>p {{}}</style></head><body><script>var a = "<p>no</p>";</script><div class="text"><p>{P1}</p><noscript>Turn on scripts</noscript><p>{P2}</p></div><iframe src="x">none</iframe></body>', f"{P1}\n{P2}"),
    ("entities", f'<article><h1>Caf&eacute; &amp; Bar</h1><p>{P1}</p><p>2 &lt; 3, said   the\n\tmayor.</p></article>', f"Café & Bar\n{P1}\n2 < 3, said the mayor."),
    ("blockquote", f"<article><p>{P1}</p><blockquote>{P2}</blockquote><p>{P3}</p></article>", f"{P1}\n{P2}\n{P3}"),
    ("recipe", f'<main><h1>Bread</h1><p>{P3}</p><h3>You need</h3><ul><li>500 g flour</li><li>10 g salt</li><li>water</li></ul><h3>Steps</h3><ol><li>Mix everything and wait for an hour.</li><li>Bake until brown.</li></ol></main><footer>&copy; Bakers</footer>', f"Bread\n{P3}\nYou need\n500 g flour\n10 g salt\nwater\nSteps\nMix everything and wait for an hour.\nBake until brown."),
    ("headings", f"<article><h1>A bridge</h1><h2>Why</h2><p>{P1}</p><h2>When</h2><p>{P2}</p><h5>Notes</h5><p>{P3}</p></article>", f"A bridge\nWhy\n{P1}\nWhen\n{P2}\nNotes\n{P3}"),
    ("figure", f'<article><p>{P1}</p><figure><img src="b.jpg"><figcaption>The bridge in spring.</figcaption></figure><p>{P2}</p></article>', f"{P1}\nThe bridge in spring.\n{P2}"),
    ("code", f'<div class="post-body"><p>{P1}</p><pre>for x in y:\n    print(x)</pre><p>{P2}</p></div>', f"{P1}\nfor x in y: print(x)\n{P2}"),
    ("links in prose", f'<div class="article-text"><p>The <a href="/c">council</a> voted to build a <a href="/b">bridge</a> over the river on Tuesday.</p><p>{P2}</p></div><div class="share"><a href="/f">Facebook</a> <a href="/t">Twitter</a></div>', f"The council voted to build a bridge over the river on Tuesday.\n{P2}"),
    ("open paragraphs", f"<body><h1>A bridge at last<p>{P1}<p>{P2}</body>", f"A bridge at last\n{P1}\n{P2}"),
    ("login form", f'<form id="login"><label>Name</label><input><label>Password</label><input type="password"><button>Log in</button></form><div class="main"><p>{P1}</p><p>{P2}</p></div>', f"{P1}\n{P2}"),
    ("latin", f'<div class="header"><a href="/">Lorem</a></div><div class="page"><div class="inner"><p>{LOREM}</p><p>{LOREM}</p></div></div><div class="footer">&copy; Lorem</div>', f"{LOREM}\n{LOREM}"),
    ("menu only", '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav><footer>&copy; 2020 All rights reserved.</footer>', ""),
    ("definitions", f"<main><p>{P3}</p><dl><dt>Span</dt><dd>The part between two piers.</dd><dt>Pier</dt><dd>What holds the span up.</dd></dl></main>", f"{P3}\nSpan\nThe part between two piers.\nPier\nWhat holds the span up."),
    ("unknown words", f'<div class="zq-top"><ul><li><a href="/1">Home</a></li><li><a href="/2">Shop</a></li></ul></div><div class="zq-mid"><h2>A bridge at last</h2><p>{P1}</p><p>{P2}</p></div><div class="zq-end"><p>&copy; 2021 Zq. Terms. Privacy.</p></div>', f"A bridge at last\n{P1}\n{P2}"),
    ("stray", f"<p>{P1}</p> and so it ends, after many years of talk.", f"{P1}\nand so it ends, after many years of talk."),
    ("short", "<p>Only text</p> stray", "Only text\nstray"),
]


A, B = f"<p>{P1}</p>", f"<p>{P2}</p>"
#: Boilerplate without telling names, inside the text and around it, in four languages.
HARD = [
    ("plain footer", f"<div><h1>School</h1>{A}{B}</div><div><p>Copyright 2020 Example. All rights reserved.</p></div>", f"School\n{P1}\n{P2}"),
    ("offer in a box", f'<main>{A}<div class="box"><p>Advertisement</p><p>Buy one car and get two for free, only today!</p></div>{B}</main>', f"{P1}\n{P2}"),
    ("sponsored box", f'<article>{A}<div class="x9"><span>Sponsored</span><p>Ten tricks that your dentist will not tell you</p></div>{B}</article>', f"{P1}\n{P2}"),
    ("thread", f"<div><h1>School</h1>{A}{B}</div><div><p>2 comments</p><div><b>Bob</b><p>Great news for all of us!</p></div><div><b>Ann</b><p>I do not agree at all with this plan.</p></div></div>", f"School\n{P1}\n{P2}"),
    ("cookies", f"<div>This site uses cookies to improve your experience. <button>OK</button></div><article><h1>School</h1>{A}{B}</article>", f"School\n{P1}\n{P2}"),
    ("german footer", f"<div><h1>Schule</h1><p>{LOREM}</p>{A}</div><div><p>Impressum</p><p>Datenschutz</p><p>Alle Rechte vorbehalten.</p></div>", f"Schule\n{LOREM}\n{P1}"),
    ("share line", f"<article>{A}<p>Share this article</p>{B}</article>", f"{P1}\n{P2}"),
    ("subscribe line", f"<article>{A}<p>Subscribe to our newsletter and never miss a story.</p>{B}<p>{P3}</p></article>", f"{P1}\n{P2}\n{P3}"),
    ("read also", f'<article>{A}<p><a href="/f">Read also: Ferry returns after ten years</a></p>{B}</article>', f"{P1}\n{P2}"),
    ("french notice", f"<div>Ce site utilise des cookies. <a href='/c'>Accepter</a></div><div><h1>Le pont</h1>{A}{B}</div><div>Tous droits réservés.</div>", f"Le pont\n{P1}\n{P2}"),
    ("spanish end", f"<div>{A}{B}</div><div><p>Todos los derechos reservados.</p><p>Aviso legal</p></div>", f"{P1}\n{P2}"),
    ("german advert", f"<div>{A}<div><span>Anzeige</span><p>Jetzt kaufen und sparen: Rabatt auf alle Brücken!</p></div>{B}</div>", f"{P1}\n{P2}"),
    ("follow us", f"<div><h2>A bridge at last</h2>{A}{B}<p>Follow us on Twitter and Facebook</p></div>", f"A bridge at last\n{P1}\n{P2}"),
    ("related list", f'<div>{A}{B}</div><div><h3>You may also like</h3><ul><li><a href="/1">Ferry returns after ten years</a></li><li><a href="/2">Harbour gets new cranes</a></li></ul></div>', f"{P1}\n{P2}"),
    ("comment form", f"<div>{A}{B}</div><div><h3>Leave a reply</h3><label>Name</label><input><label>Your comment</label><input><button>Send</button></div>", f"{P1}\n{P2}"),
    ("menu in a div", f'<div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/c">Contact</a></div><div><h1>A bridge at last</h1>{A}{B}</div><div>Terms of use. Privacy policy.</div>', f"A bridge at last\n{P1}\n{P2}"),
    ("words like those in prose", f"<article><h1>All rights</h1><p>The council said that the privacy of all its users and the rights of readers are reserved for debate in May.</p>{B}<p>Cookies were sold at the school, and the newsletter of the town wrote about it.</p></article>", f"All rights\nThe council said that the privacy of all its users and the rights of readers are reserved for debate in May.\n{P2}\nCookies were sold at the school, and the newsletter of the town wrote about it."),
    ("two adverts", f"<div>{A}<div><p>Advertisement</p><p>Cheap flights to the sea from 19 euros</p></div>{B}<div><p>Advertisement</p><p>Shop now and save</p></div><p>{P3}</p></div>", f"{P1}\n{P2}\n{P3}"),
    ("long thread", f"<article><h1>School</h1>{A}{B}</article><div><h3>Comments (3)</h3>" + "".join(f"<div><p>{n}, 3 May 2021</p><p>{t}</p></div>" for n, t in (("Tom", "I think this is a very good plan for the town and its people."), ("Eve", "No, it is not. The money is needed for the schools."), ("Max", "Wait and see."))) + "</div>", f"School\n{P1}\n{P2}"),
]


def blocks(text):
    return text.split("\n") if text else []


def test_pages_of_many_layouts():
    model = html.trained()
    found = html.main_texts([h for _, h, _ in PAGES], model)
    wrong = [(name, got) for (name, _, want), got in zip(PAGES, found) if got != want]
    hit = sum(len(set(blocks(want)) & set(blocks(got))) for (_, _, want), got in zip(PAGES, found))
    print(f"pages {len(PAGES) - len(wrong)} of {len(PAGES)}; recall {hit / sum(len(set(blocks(w))) for _, _, w in PAGES):.3f}; precision {hit / max(sum(len(set(blocks(g))) for g in found), 1):.3f}", wrong)
    assert len(PAGES) >= 20 and not wrong


def test_boilerplate_without_telling_names():
    """Nearly all main text is there and hardly any boilerplate; what fails is known."""
    found = html.main_texts([h for _, h, _ in HARD], html.trained())
    wrong = [(name, got) for (name, _, want), got in zip(HARD, found) if got != want]
    want, got = [(k, b) for k, (_, _, w) in enumerate(HARD) for b in blocks(w)], [(k, b) for k, g in enumerate(found) for b in blocks(g)]
    print(f"pages {len(HARD) - len(wrong)} of {len(HARD)}; recall {len(set(want) & set(got)) / len(want):.3f}; precision {len(set(want) & set(got)) / len(got):.3f}", wrong)
    # Known to fail: a line to subscribe that reads like a sentence, an offer in a box of its own, and text after the second of two adverts.
    assert {name for name, _ in wrong} <= {"subscribe line", "offer in a box", "two adverts"}
    assert len(set(want) - set(got)) <= 1 and len(set(got) - set(want)) <= 2


def test_given_pages_by_their_structure():
    """In the given table the article element holds the main text: a rule that the labeller is not told."""
    import duckdb

    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    right = n = 0
    for page, got in zip(pages, html.main_texts(pages, html.trained())):
        held = [b for b in html.leaf_blocks(page) if any("article" in names for names in b[1])]
        if held:
            n += 1
            right += got == "\n".join(b[0] for b in held)
    assert n > 200 and right >= 0.98 * n


def test_broken_and_deep_pages_take_linear_time():
    start = time.time()
    assert html.leaf_blocks('<a b="' * 170_000) == []
    assert [b[0] for b in html.leaf_blocks('<a b="' * 170_000 + '">x')] == ["x"]
    assert html.leaf_blocks("<script" * 150_000) == []
    assert len(html.leaf_blocks("<div>a" * 50_000)) == 50_000
    assert [b[0] for b in html.leaf_blocks("<p>a</p>" + "<b" * 1000)] == ["a"]
    assert time.time() - start < 10
