"""Training pages for the block labeller: layouts drawn at random, every block with its label.

The words of the texts come from a sample of real pages, so the labeller can't tell content from
the rest by what the sample happens to talk about; furniture keeps its own phrases (notices,
copyright lines, calls to subscribe), as on real pages.
"""

from __future__ import annotations

import random

CONTENT = [
    "<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">',
    '<section class="article-body">', '<div class="story">', '<article class="post">', '<div id="main"><div class="text">', "<div>", "<section>", '<div role="main">',
]
NAVS = ["<nav>", '<div class="menu">', '<div id="navbar">', '<ul class="nav">', '<div class="navigation">', '<nav class="breadcrumb">', '<div class="topbar">', "<div>", '<div role="navigation">']
HEADERS = ["<header>", '<div class="header">', '<div id="masthead">', '<header class="site-header">', '<div role="banner">']
FOOTERS = ["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div role="contentinfo">', '<div class="bottom">']
SIDES = ["<aside>", '<div class="sidebar">', '<aside class="widget">', '<div id="sidebar">', '<div class="related">', '<div class="rail">', '<section class="related-posts">', '<div role="complementary">', '<div class="tags">', '<div class="share-buttons">', '<div class="social">']
ADS = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="banner">', '<div class="sponsored">', '<div class="promo">', '<div id="ad-slot">', '<section class="advertisement">', '<aside class="ad">', '<div class="ad-box">', '<p class="ad">']
NOTICES = ['<div class="notice">', '<div class="cookie-notice">', '<div class="cookie-consent">', '<div class="alert">', '<div id="gdpr">', '<div class="popup">', '<div class="newsletter">', '<div class="subscribe">', '<div role="alert">', '<div class="modal">', '<p class="notice">', '<div class="paywall">', '<div class="disclaimer">', "<dialog>"]
COMMENTS = ['<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<div class="responses">', '<section id="disqus-thread">', '<div class="discussion">', '<div class="replies">']
WRAPS = ['<div class="wrapper">', '<div class="container">', '<div id="page">', '<div class="row">', '<div class="inner">', "<div>"]
PHRASES = {
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter", "Sign up for free", "This site uses cookies.", "Read our privacy policy", "Register to continue reading", "Nous utilisons des cookies", "Wir verwenden Cookies", "Usamos cookies"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Anzeige", "Publicité", "Publicidad", "Limited offer"],
    "footer": ["&copy; 2024 All rights reserved.", "Terms of use", "Privacy", "Contact", "Impressum", "Copyright 2023", "&copy; example.org &middot;"],
    "comment": ["Reply", "says:", "Comments", "Leave a comment", "3 responses", "Kommentare", "Commentaires", "Report"],
    "form": ["Search", "Your email", "Send", "Log in", "Password", "Name", "Suche", "Rechercher"],
    "side": ["Related articles", "Most read", "Share this", "Tags", "Recent posts", "Follow us", "More"],
}


#: Share of pages without any furniture of their own making.
PLAIN = 0.4
#: Share of texts with made-up words among those of the sample.
STRANGE = 0.3


def _end(start: str) -> str:
    return "".join(f"</{t.split('>')[0].split()[0]}>" for t in reversed(start.split("<")[1:]))


class Layouts:
    """Pages as HTML in which a block's first word, ``x1q`` or ``x0q``, is its label."""

    def __init__(self, words: list[str], seed: int):
        self.words, self.pick = words or ["word"], random.Random(seed)

    def text(self, low: int, high: int) -> str:
        """Words of the sample; in a share of the texts every other one is made up, as pages have words that no sample holds."""
        p = self.pick
        n, strange = p.randint(low, high), p.random() < STRANGE
        return " ".join(self.unheard() if strange and p.random() < 0.5 else p.choice(self.words) for _ in range(n))

    def unheard(self) -> str:
        return "".join(self.pick.choices("aeiounrstldmhcgbp", k=self.pick.randint(2, 9))) + self.pick.choice(["", "", "", "", ",", "."])

    def mark(self, label: int, text: str) -> str:
        return f"x{label}q {text}"

    def some(self, chance: float, part) -> str:
        return part() if self.pick.random() < chance else ""

    def around(self, starts: list[str], inside: str) -> str:
        start = self.pick.choice(starts)
        return start + inside + _end(start)

    def phrase(self, kind: str) -> str:
        p = self.pick
        return p.choice(PHRASES[kind]) if p.random() < 0.5 else self.text(1, 8) if p.random() < 0.5 else p.choice(PHRASES[kind]) + " " + self.text(1, 30)

    def links(self, low: int, high: int) -> str:
        p = self.pick
        items = [f'<a href="/x">{self.mark(0, self.text(1, 3))}</a>' for _ in range(p.randint(low, high))]
        if p.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items)

    def nav(self) -> str:
        return self.around(NAVS, self.links(2, 9))

    def header(self) -> str:
        return self.around(HEADERS, f"<h1>{self.mark(0, self.text(1, 4))}</h1>" * (self.pick.random() < 0.5) + f"<p>{self.mark(0, self.text(1, 9))}</p>" + self.some(0.4, self.form))

    def footer(self) -> str:
        p = self.pick
        body = self.mark(0, self.phrase("footer")) if p.random() < 0.6 else f"<p>{self.mark(0, self.phrase('footer'))}</p>" + self.links(1, 5)
        return self.around(FOOTERS, body)

    def ad(self) -> str:
        body = self.mark(0, self.text(3, 30) if self.pick.random() < 0.6 else self.phrase("ad"))
        return self.around(ADS, body if self.pick.random() < 0.6 else f"<p>{body}</p>")

    def notice(self) -> str:
        body = self.mark(0, self.phrase("notice") if self.pick.random() < 0.6 else self.text(3, 30))
        return self.around(NOTICES, body if self.pick.random() < 0.5 else f"<p>{body}</p><button>{self.mark(0, 'OK')}</button>")

    def form(self) -> str:
        p = self.pick
        kind = p.choice(["<form>", '<form class="search">', '<form id="login">', '<form class="signup">'])
        return kind + f"<label>{self.mark(0, self.phrase('form'))}</label><input><button>{self.mark(0, self.phrase('form'))}</button></form>"

    def side(self) -> str:
        p = self.pick
        head = f"<h3>{self.mark(0, self.phrase('side'))}</h3>" * (p.random() < 0.7)
        return self.around(SIDES, head + (self.links(2, 7) if p.random() < 0.6 else f"<p>{self.mark(0, self.text(3, 40))}</p>" * p.randint(1, 2)))

    def comments(self) -> str:
        p = self.pick
        one = p.choice(['<div class="comment">', "<li>", '<article class="comment">', "<div>", '<li class="comment">'])
        items = "".join(
            one + f"<p>{self.mark(0, self.text(1, 3))}</p>" * (p.random() < 0.4) + f"<p>{self.mark(0, self.text(3, 60))}</p>" + _end(one) for _ in range(p.randint(1, 6))
        )
        head = f"<h2>{self.mark(0, self.phrase('comment'))}</h2>" * (p.random() < 0.6)
        return self.around(COMMENTS, head + items + self.some(0.4, self.form))

    def paragraph(self) -> str:
        p, roll = self.pick, self.pick.random()
        if roll < 0.72:
            body = self.mark(1, self.text(*p.choice([(1, 4), (4, 20), (20, 80), (60, 160)])))
            if p.random() < 0.1:
                body += f' <a href="/y">{self.text(1, 4)}</a> {self.text(8, 12)}'
            return f"<p><b>{body}</b>" + "</p>" * (p.random() < 0.8) if p.random() < 0.15 else f"<p>{body}" + "</p>" * (p.random() < 0.9)
        if roll < 0.80:
            return f"<h2>{self.mark(1, self.text(1, 8))}</h2>" if p.random() < 0.6 else f"<h3>{self.mark(1, self.text(1, 8))}</h3>"
        if roll < 0.86:
            tag = p.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.mark(1, self.text(2, 20))}</li>" for _ in range(p.randint(2, 5))) + f"</{tag}>"
        if roll < 0.90:
            return f"<blockquote><p>{self.mark(1, self.text(5, 40))}</p></blockquote>"
        if roll < 0.93:
            return f"<pre>{self.mark(1, self.text(3, 20))}</pre>"
        if roll < 0.96:
            return f"<figure><img><figcaption>{self.mark(1, self.text(3, 12))}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{self.mark(1, self.text(1, 3))}</td><td>{self.mark(1, self.text(1, 4))}</td></tr>" for _ in range(p.randint(1, 3))) + "</table>"

    def article(self) -> str:
        p = self.pick
        title = f"<h1>{self.mark(1, self.text(1, 10))}</h1>"
        if p.random() < 0.25:
            title = f"<header>{title}</header>"
        body = ""
        for _ in range(p.randint(1, 14)):
            body += self.paragraph()
            body += self.some(0.04, self.ad) + self.some(0.03, self.side) + self.some(0.02, self.notice) + self.some(0.01, self.form)
        return self.around(CONTENT, title * (p.random() < 0.85) + body)

    def line_of_links(self) -> str:
        p = self.pick
        links = [f'<a href="/x">{self.text(1, 3)}</a>' for _ in range(p.randint(1, 8))]
        return f'<a href="/w">{self.mark(0, self.text(1, 2))}</a>' + "".join(p.choice([" | ", " ", "<br>", " - ", "<br>\n"]) + x for x in links)

    def plain_text(self) -> str:
        """The article as early and hand-made pages have it: without heading, class or section."""
        p, roll = self.pick, self.pick.random()
        lengths = p.choice([(1, 6), (5, 25), (10, 60), (40, 140)])
        n = p.choice([1, 1, 2, 3, 4, 6])
        if roll < 0.25:
            return self.mark(1, p.choice(["<br><br>", "<br>", "<br/><br/>\n"]).join(self.text(*lengths) for _ in range(n)))
        tag = "p" if roll < 0.75 else p.choice(["div", "td", "center", "li", "pre", "p"])
        if tag == "td":
            return "<table>" + "".join(f"<tr><td>{self.mark(1, self.text(*lengths))}</td></tr>" for _ in range(n)) + "</table>"
        return "".join(f"<{tag}>{self.mark(1, self.text(*lengths))}</{tag}>" for _ in range(n))

    def plain_page(self) -> str:
        p = self.pick
        title = p.choice([f"<h1>{self.mark(1, self.text(1, 8))}</h1>", f"<h2>{self.mark(1, self.text(1, 8))}</h2>", f"<p><b>{self.mark(1, self.text(1, 8))}</b></p>"]) * (p.random() < 0.3)
        article = title + self.plain_text() + (f"<p>{self.mark(1, self.text(5, 50))}</p>" + self.plain_text()) * (p.random() < 0.2)
        menu = self.line_of_links() if p.random() < 0.7 else self.links(2, 6)
        end = p.choice(["<p>", "<div>", "<center>", "<address>", "<small>", "<p><small>", '<p align="center">'])
        last = "<hr>" * (p.random() < 0.6) + end + self.mark(0, p.choice(PHRASES["footer"]) + (" " + self.text(1, 5)) * (p.random() < 0.5)) + _end(end)
        if p.random() < 0.3:
            cells = [f"<td>{menu}</td>", f"<td>{article}</td>"]
            if p.random() < 0.2:
                cells.reverse()
            row = "<tr>" + "".join(cells) + "</tr>" if p.random() < 0.7 else f"<tr>{cells[0]}</tr><tr>{cells[1]}</tr>"
            body = f"<table>{row}" + (f"<tr><td>{last}</td></tr></table>" if p.random() < 0.3 else "</table>" + last * (p.random() < 0.4))
        else:
            bar = p.choice(["<p>", "<div>", "<center>"])
            if p.random() < 0.5:
                article = self.around(p.choice([WRAPS, ["<div>"], ["<div><div>"], ["<section>"], ["<center>"]]), article)
            body = (bar + menu + _end(bar) + "<hr>" * (p.random() < 0.3)) * (p.random() < 0.3) + article + last * (p.random() < 0.4)
        return f"<html><body>{body}</body></html>"

    def page(self) -> str:
        p = self.pick
        if p.random() < PLAIN:
            return self.plain_page()
        parts = [self.some(0.25, self.notice), self.some(0.4, self.header), self.some(0.8, self.nav), self.some(0.2, self.side), self.some(0.5, self.ad)]
        if p.random() < 0.3:
            p.shuffle(parts)
        after = [self.some(0.3, self.comments), self.some(0.35, self.side), self.some(0.2, self.ad), self.some(0.12, self.notice), self.some(0.15, self.form)]
        p.shuffle(after)
        article = self.article()
        body = "".join(parts) + article + "".join(after)
        if p.random() < 0.4:
            body = self.around(WRAPS, body)
        return f"<html><body>{body}{self.some(0.9, self.footer)}</body></html>"
