"""Labelled web pages, from which the weights of HTML extraction are learned.

Each page has its main text between the marks of ``html_text``. Pages are laid out from the parts below: kinds of elements that
pages have beside their article, and ways to hold the article itself. Every name is on some page, alone, so that it gets a weight of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import cycle

from confab.llm.html_text import END_MAIN, MAIN

# Names that authors of web pages give to parts, by what these parts are.
MENUS = ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toolbar", "topbar", "tabs", "pagination", "pager", "skip", "dropdown"]
HEADERS = ["header", "masthead", "banner", "logo", "branding", "top"]
FOOTERS = ["footer", "colophon", "copyright", "contentinfo", "legal", "bottom", "credits"]
SIDEBARS = ["sidebar", "aside", "widget", "widgets", "related", "recommended", "recommendations", "popular", "trending", "archives", "categories", "tags", "tagcloud", "complementary", "rail", "more", "teaser", "teasers"]
NOTICES = ["notice", "cookie", "cookies", "consent", "gdpr", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "signup", "paywall", "disclaimer", "warning", "message", "toast", "privacy"]
ADVERTS = ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "promoted", "outbrain", "taboola", "affiliate", "adsense"]
FORMS = ["form", "search", "login", "contact", "survey", "poll"]
COMMENTS = ["comment", "comments", "disqus", "respond", "replies", "reply", "discussion", "reactions", "responses", "feedback"]
SHARING = ["share", "sharing", "social", "follow", "likes", "buttons"]
MAINS = ["content", "main", "article", "post", "entry", "story", "body", "text", "articleBody", "page", "container", "wrapper", "column"]

WORDS = "wind carried the sound of bells over harbour roofs while people walked home slowly and nobody asked why the lamps had been lit so early that year".split()


def _words(n: int, at: int) -> str:
    return " ".join(WORDS[(at + i) % len(WORDS)] for i in range(n)).capitalize() + "."


def _links(n: int, at: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{at + i}">{WORDS[(at + i) % len(WORDS)]}</a></li>' for i in range(n)) + "</ul>"


def _article(i: int) -> str:
    """Headings, paragraphs, lists, quotations, tables and figures, with links within sentences."""
    more = [
        f"<h2>{_words(3, i)}</h2>", f"<blockquote><p>{_words(12, i + 3)}</p></blockquote>", f"<ul><li>{_words(7, i)}</li><li>{_words(9, i + 1)}</li></ul>", f"<ol><li>{_words(6, i)}</li></ol>",
        f"<table><tr><th>{WORDS[i % 20]}</th></tr><tr><td>{_words(3, i)}</td></tr></table>", f"<figure><img src='x.png'><figcaption>{_words(6, i)}</figcaption></figure>", f"<pre><code>{_words(8, i)}</code></pre>",
        f"<div>{_words(20, i)}</div>", f"<h3>{_words(2, i)}</h3><p>{_words(14, i + 5)}</p>", f"<dl><dt>{WORDS[i % 9]}</dt><dd>{_words(9, i)}</dd></dl>", f"<section><h2>{_words(3, i)}</h2><p>{_words(18, i)}</p></section>", f"{_words(25, i)}<br>{_words(15, i + 2)}",
    ]
    paragraph = lambda k: f'<p>{_words(12, i + k)} <a href="/{k}">{_words(2, i + k + 7)}</a> <b>{_words(3, k)}</b> <em>{_words(2, k + 1)}</em> {_words(10, i + k + 3)}</p>'
    return f"<h1>{_words(5, i)}</h1>" + paragraph(0) + f"<p><b>{_words(4, i)}<br><p>{_words(20, i + 2)}</p>" + more[i % len(more)] + paragraph(4) + f"<p>{_words(2, i)}</p>" + more[(i + 5) % len(more)] + paragraph(9)


def _beside(names: Iterator[str], i: int, inside: str, element: str = "div") -> str:
    """A part with the next of the names, as its class, its id or its role in turn."""
    return f"<{element} {('class', 'id', 'class', 'role')[i % 4]}=\"{next(names)}\">{inside}</{element}>"


def pages(n: int = 330) -> list[str]:
    """``n`` pages; with 330, every name occurs in many settings."""
    menus, headers, footers, sidebars, notices, adverts, forms, comments, sharing = map(cycle, (MENUS, HEADERS, FOOTERS, SIDEBARS, NOTICES, ADVERTS, FORMS, COMMENTS, SHARING))
    out = []
    for i in range(n):  # the parts are made when they are chosen, so each name has its turn
        paragraphs = f"<p>{_words(16, i)}</p><p>{_words(9, i + 4)}</p>"
        fields = f'<label>{_words(2, i)}</label><input name="q"><p>{_words(6, i)}</p><button>{WORDS[i % 25]}</button>'
        reply = f"<h3>{_words(2, i)}</h3><ul><li><b>{WORDS[i % 25]}</b><p>{_words(15, i)}</p></li></ul><div>{_words(12, i + 1)}</div>"
        menu = [lambda: f"<nav>{_links(6, i)}</nav>", lambda: _beside(menus, i, _links(5, i)), lambda: _beside(menus, i, f'<a href="/">{WORDS[i % 25]}</a> <span>{WORDS[i % 7]}</span>', "nav")][i % 3]()
        header = [lambda: "", lambda: f"<header><h1>{_words(3, i)}</h1><p>{_words(6, i)}</p></header>", lambda: _beside(headers, i, f"<h2>{_words(3, i)}</h2><div>{_words(5, i)}</div>")][i % 3]()
        footer = [lambda: f"<footer>&copy; {_words(5, i)}</footer>", lambda: f"<footer><p>{_words(9, i)}</p>{_links(3, i)}</footer>", lambda: _beside(footers, i, f"<p>{_words(10, i)}</p>")][i % 3]()
        before = [lambda: _beside(notices, i, paragraphs), lambda: _beside(adverts, i, f"{_words(8, i)}"), lambda: _beside(sidebars, i, _links(6, i) + paragraphs), lambda: ""][i % 4]()
        after = [lambda: _beside(sidebars, i, f"<h3>{_words(2, i)}</h3>" + paragraphs), lambda: f"<aside><p>{_words(14, i)}</p>{_links(4, i)}</aside>", lambda: _beside(comments, i, reply), lambda: _beside(notices, i, paragraphs), lambda: _beside(adverts, i, paragraphs)][i % 5]()
        talk = [lambda: "", lambda: _beside(comments, i, reply, "section"), lambda: f"<form>{fields}</form>", lambda: _beside(forms, i, fields)][i % 4]()
        within = [lambda: "", lambda: _beside(adverts, i, f"<p>{_words(9, i)}</p>"), lambda: f"<aside>{_words(11, i)}</aside>", lambda: _beside(sharing, i, _words(3, i) + _links(3, i)), lambda: _beside(notices, i, f"<p>{_words(11, i)}</p>"), lambda: f"<nav>{_links(3, i)}</nav>"][i % 6]()
        article = f"{MAIN}{_article(i)}{END_MAIN}{within}{MAIN}<p>{_words(13, i)}</p>{_article(i + 1)}{END_MAIN}"
        name = MAINS[i % len(MAINS)]
        held = [
            f"<article>{article}{talk if i % 8 == 1 else ''}</article>", f"<main>{article}</main>", f'<div class="{name}">{article}</div>', article, f'<div id="{name}">{article}</div>',
            f"<main><article>{article}</article></main>", f'<div class="{name}"><div itemprop="{MAINS[(i + 5) % len(MAINS)]}">{article}</div></div>', f"<section>{article}</section>", f"<div><div>{article}</div></div>",
            f"<table><tr><td>{_links(4, i)}</td><td>{article}</td></tr></table>", f'<article><header>{MAIN}<h1>{_words(5, i)}</h1>{END_MAIN}</header>{article}<footer>{_words(4, i)}</footer></article>',
        ][i % 11]
        script = f'<script>var t="</p>";track({i});</script>' if i % 2 else ""
        style = "<style>p{margin:0}</style>" if i % 3 else ""
        out.append(f"<!DOCTYPE html><html><head><title>{_words(4, i)}</title>{style}{script}</head><body>{header}{menu}<!-- {i} -->{before}{held}{after}{talk}{footer}</body></html>")
    return out
