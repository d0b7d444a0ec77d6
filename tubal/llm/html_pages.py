"""Labelled pages to train the extractor on: made from page layouts with invented words.

Each page is a list of (html, label) parts in page order, of which every part is one or more blocks:
label 1 is the article, 0 everything else."""

from __future__ import annotations

import random

_SYLLABLES = "ba de ki lo mu na pe ri so tu va we xi yo za che dri fla gre sto".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _sentences(r: random.Random, low: int, high: int) -> str:
    return " ".join(_words(r, 4, 18).capitalize() + r.choice([".", ".", ".", "?", "!"]) for _ in range(r.randint(low, high)))


def _links(r: random.Random, low: int, high: int, around: str = "li") -> str:
    return "".join(f'<{around}><a href="/{_word(r)}">{_words(r, 1, 3)}</a></{around}>' for _ in range(r.randint(low, high)))


def _article(r: random.Random) -> list[str]:
    out = [f"<h1>{_words(r, 2, 12).capitalize()}{r.choice(['', '.', '?'])}</h1>"]
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        text = _sentences(r, 1, r.choice([1, 2, 6]))
        if kind < 0.55:
            out.append(f"<p>{text}</p>")
        elif kind < 0.65:
            out.append(f"<p><b>{text}<br>")
        elif kind < 0.72:
            out.append(f"<p>{text} <a href='/x'>{_words(r, 1, 4)}</a> {_sentences(r, 1, 2)}</p>")
        elif kind < 0.78:
            out.append(f"<h2>{_words(r, 1, 7).capitalize()}</h2>")
        elif kind < 0.83:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.88:
            out.append("<ul>" + "".join(f"<li>{_words(r, 2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.91:
            out.append(f"<pre>{_words(r, 3, 20)}</pre>")
        elif kind < 0.94:
            out.append(f"<table><tr><td>{_words(r, 1, 5)}</td><td>{_words(r, 1, 5)}</td></tr></table>")
        elif kind < 0.96:
            out.append(f"<figure><figcaption>{_words(r, 3, 12).capitalize()}.</figcaption></figure>")
        else:
            out.append(f"<p>{_words(r, 1, 2).capitalize()}.</p>")
    return out


def _around(r: random.Random, tag: str, names: str, inner: str) -> str:
    attribute = r.choice(["class", "id"])
    return f'<{tag} {attribute}="{names}">{inner}</{tag}>' if names else f"<{tag}>{inner}</{tag}>"


def _before(r: random.Random) -> list[str]:
    parts = [
        lambda: _around(r, "nav", r.choice(["", "navbar", "main-nav"]), f"<ul>{_links(r, 3, 9)}</ul>"),
        lambda: _around(r, "header", r.choice(["", "site-header", "masthead"]), f"<div>{_words(r, 1, 4)}</div><p>{_words(r, 3, 9)}</p>"),
        lambda: _around(r, "div", r.choice(["menu", "top-menu", "breadcrumb", "nav"]), f"<ul>{_links(r, 2, 8)}</ul>"),
        lambda: _around(r, "div", r.choice(["ad", "ads", "advert", "banner", "promo", "sponsored"]), r.choice(["{}", "<p>{}</p>"]).format(_sentences(r, 1, 3))),
        lambda: _around(r, "div", r.choice(["cookie-notice", "notice", "cookie-banner", "consent", "alert"]), f"<p>{_sentences(r, 1, 3)}</p><button>{_words(r, 1, 2)}</button>"),
        lambda: f"<form action='/s'><label>{_words(r, 1, 3)}</label><button>{_words(r, 1, 2)}</button></form>",
    ]
    return [r.choice(parts)() for _ in range(r.randint(1, 4))]


def _after(r: random.Random) -> list[str]:
    comment = lambda: f"<p>{_words(r, 1, 2)}</p><p>{_sentences(r, 1, 4)}</p>"
    parts = [
        lambda: _around(r, "footer", r.choice(["", "site-footer"]), r.choice(["{}", "<p>{}</p>"]).format("&copy; " + _words(r, 1, 4) + " &middot; " + _sentences(r, 1, 2))),
        lambda: _around(r, "aside", r.choice(["", "sidebar"]), f"<h3>{_words(r, 1, 3)}</h3><ul>{_links(r, 2, 6)}</ul><p>{_sentences(r, 1, 3)}</p>"),
        lambda: _around(r, "div", r.choice(["sidebar", "side", "widget", "right-sidebar"]), f"<h3>{_words(r, 1, 3)}</h3><p>{_sentences(r, 1, 3)}</p>"),
        lambda: _around(r, "section", r.choice(["comments", "comment-list", "replies", "discussion"]), f"<h3>{_words(r, 1, 2)}</h3>" + "".join(f'<div class="comment">{comment()}</div>' for _ in range(r.randint(1, 5)))),
        lambda: _around(r, "div", r.choice(["comments", "reader-comments", "disqus"]), "".join(f"<div>{comment()}</div>" for _ in range(r.randint(1, 5)))),
        lambda: _around(r, "div", r.choice(["related", "recommended", "share", "social", "newsletter", "subscribe"]), f"<h3>{_words(r, 1, 4)}</h3><ul>{_links(r, 2, 5)}</ul>"),
        lambda: f"<form class='{r.choice(['login', 'signup', 'search', 'contact'])}'><p>{_words(r, 2, 8)}</p><label>{_words(r, 1, 3)}</label><select><option>{_word(r)}</option></select></form>",
        lambda: _around(r, "div", r.choice(["footer", "bottom", "copyright", "legal"]), f"<p>{_sentences(r, 1, 2)}</p>"),
    ]
    return [r.choice(parts)() for _ in range(r.randint(1, 4))]


def labelled_pages(count: int = 400, seed: int = 1) -> list[list[tuple[str, int]]]:
    """Pages as parts; html between parts that holds no text of its own has label -1."""
    pages = []
    for k in range(count):
        r = random.Random(seed * 1_000_003 + k)
        opening, closing = r.choice([
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
            ('<div id="content">', "</div>"), ('<div class="post">', "</div>"), ('<div class="entry-content">', "</div>"),
            ('<div class="article-body">', "</div>"), ('<section class="story">', "</section>"), ("<div>", "</div>"),
        ])
        page = [("<!DOCTYPE html><html><head><title>x</title></head><body>", -1)]
        page += [(p, 0) for p in _before(r)]
        page.append((opening, -1))
        for i, p in enumerate(_article(r)):
            if i > 2 and r.random() < 0.05:
                tag, names = r.choice([("div", "ad"), ("div", "advert"), ("div", "promo"), ("div", "share"), ("aside", "related"), ("aside", ""), ("aside", "")])
                page.append((_around(r, tag, names, f"<p>{_sentences(r, 1, 2)}</p>"), 0))
            page.append((p, 1))
        page.append((closing, -1))
        page += [(p, 0) for p in _after(r)]
        page.append(("</body></html>", -1))
        pages.append(page)
    return pages
