"""Generated pages with known main text, to train the extractor on.

Layouts vary: with or without article and main elements, with wrappers of many
class names, menus, headers, footers, sidebars, notices, adverts, forms and
reader comments.  Words of the main text start with a marker that occurs
nowhere else; features never see words, only lengths and punctuation.
"""

from __future__ import annotations

import random

MARK = "zq"


def training_pages(n: int, seed: int = 11):
    rng = random.Random(seed)
    for _ in range(n):
        yield _page(rng), MARK


def _words(rng, n: int, mark: str = "") -> str:
    out = []
    for k in range(n):
        w = mark + "".join(rng.choice(("an", "er", "th", "on", "re", "it", "st", "le", "qu", "io")) for _ in range(rng.randint(1, 4)))
        r = rng.random()
        out.append(w + ("." if r < 0.09 else "," if r < 0.14 else "!!" if r < 0.15 else "&amp;" if r < 0.16 else ""))
    return " ".join(out) + rng.choice((".", ".", ""))


def _link(rng, mark: str = "") -> str:
    return f'<a href="/{rng.randint(1, 999)}">{_words(rng, rng.randint(1, 3), mark)}</a>'


def _menu(rng) -> str:
    items = [_link(rng) for _ in range(rng.randint(2, 9))]
    inner = rng.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"))()
    return rng.choice(("<nav>%s</nav>", '<div class="menu">%s</div>', '<div id="navbar">%s</div>', '<ul class="nav">%s</ul>', '<div class="breadcrumb">%s</div>', "<nav class=x1>%s</nav>", "<div>%s</div>")) % inner


def _notice(rng) -> str:
    text = _words(rng, rng.randint(3, 30))
    return rng.choice(('<div class="ad">%s</div>', '<div class="advert">%s</div>', '<div id="cookie-notice"><p>%s</p><button>ok</button></div>', '<div class="banner promo">%s</div>', '<p class="notice">%s</p>', '<section class="newsletter signup"><p>%s</p></section>', '<aside class="ads">%s</aside>', '<div class="sponsored"><h3>%s</h3></div>', '<div role="alert">%s</div>', '<div class="consent-banner"><p>%s</p></div>')) % text


def _form(rng) -> str:
    return f'<form class="{rng.choice(("search", "login", "f", "contact"))}"><label>{_words(rng, 2)}</label><input name="q"><p>{_words(rng, rng.randint(1, 12))}</p><button>{_words(rng, 1)}</button></form>'


def _side(rng) -> str:
    inner = "".join(f"<p>{_words(rng, rng.randint(2, 25))}</p>" if rng.random() < 0.5 else f"<ul><li>{_link(rng)}</li><li>{_link(rng)}</li></ul>" for _ in range(rng.randint(1, 4)))
    if rng.random() < 0.6:
        inner = f"<h3>{_words(rng, 2)}</h3>" + inner
    return rng.choice(("<aside>%s</aside>", '<div class="sidebar">%s</div>', '<div id="sidebar" class="widget">%s</div>', '<div class="related">%s</div>', '<section class="social share">%s</section>')) % inner


def _comments(rng) -> str:
    one = lambda: rng.choice(('<div class="comment"><b>%s</b><p>%s</p></div>', "<li><p>%s</p><p>%s</p></li>", '<article class="comment"><p>%s</p><p>%s</p></article>')) % (_words(rng, 2), _words(rng, rng.randint(3, 60)))
    inner = "".join(one() for _ in range(rng.randint(1, 6)))
    return rng.choice(('<section class="comments"><h2>x</h2>%s</section>', '<div id="comments">%s</div>', '<ol class="commentlist">%s</ol>', '<div class="discussion replies">%s</div>')) % inner


def _footer(rng) -> str:
    inner = _words(rng, rng.randint(2, 25)) if rng.random() < 0.6 else "".join(f"<p>{_words(rng, rng.randint(2, 15))}</p>" for _ in range(2)) + _link(rng)
    return rng.choice(("<footer>%s</footer>", '<div class="footer">%s</div>', '<div id="footer"><small>%s</small></div>', "<footer class=bottom><div>%s</div></footer>")) % inner


def _header(rng) -> str:
    return rng.choice(("<header>%s</header>", '<div class="header">%s</div>', '<div id="masthead"><h2>%s</h2></div>', '<div class="topbar">%s</div>')) % (_words(rng, rng.randint(1, 8)) + (_menu(rng) if rng.random() < 0.4 else ""))


def _block(rng) -> str:
    w = lambda n: _words(rng, n, MARK)
    r = rng.random()
    if r < 0.66:
        text = w(rng.randint(1, 160) if rng.random() < 0.8 else rng.randint(1, 5))
        if rng.random() < 0.2:
            text = f"<b>{text}<br>" if rng.random() < 0.6 else f"{text} {_link(rng, MARK)} {w(4)}"
        return f"<p>{text}" + ("</p>" if rng.random() < 0.85 else "")
    if r < 0.74:
        return f"<h{(h := rng.choice((2, 3, 4)))}>{w(rng.randint(1, 7))}</h{h}>"
    if r < 0.80:
        return "<ul>" + "".join(f"<li>{w(rng.randint(1, 20))}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
    if r < 0.84:
        return f"<blockquote><p>{w(rng.randint(3, 40))}</p></blockquote>"
    if r < 0.88:
        return "<table>" + "".join(f"<tr><td>{w(rng.randint(1, 4))}</td><td>{w(rng.randint(1, 4))}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>"
    if r < 0.92:
        return f"<pre>{w(rng.randint(2, 30))}</pre>"
    return f"<div>{w(rng.randint(1, 90))}</div>"


def _page(rng) -> str:
    blocks = [_block(rng) for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9, 14, 25)))]
    if rng.random() < 0.75:
        blocks.insert(0, f"<h1>{_words(rng, rng.randint(1, 12), MARK)}</h1>")
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        blocks.insert(rng.randint(0, len(blocks)), rng.choice((_notice, _side, _form))(rng))
    main = rng.choice(("<article>%s</article>", "<article>%s</article>", "<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", '<div class="content">%s</div>', '<div id="main">%s</div>', '<div class="post entry">%s</div>', '<section class="story">%s</section>', '<div role="main"><div class="x9">%s</div></div>', "<div>%s</div>")) % "".join(blocks)
    parts = [rng.choice((_header, _menu))(rng) for _ in range(rng.choice((0, 1, 1, 2)))]
    parts += [_notice(rng) for _ in range(rng.choice((0, 1, 1, 2)))]
    if rng.random() < 0.2:
        parts.append(_side(rng))
    parts.append(main)
    for maker, chance in ((_side, 0.35), (_form, 0.2), (_comments, 0.35), (_notice, 0.25), (_footer, 0.85)):
        if rng.random() < chance:
            parts.append(maker(rng))
    body = "".join(parts)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(("page", "wrapper", "container", "site"))}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}" + ("</body></html>" if rng.random() < 0.9 else "")
