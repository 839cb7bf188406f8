"""Labelled pages to train the extractor on.

There are no labelled pages among the tables, so they are made here: random
layouts of the ways in which pages mark their article and what surrounds it,
with random words. Every block's text is unique on its page, so its label is
found again after parsing.
"""

from __future__ import annotations

import random

# Element and class names that pages use for their parts.
MAIN = ["<article>", "<article class='post'>", "<main>", "<main id='main-content'>", "<div class='content'>",
        "<div id='content'>", "<div class='article-body'>", "<div class='entry-content'>", "<div class='post-content'>",
        "<section class='story'>", "<div class='story-text'>", "<div itemprop='articleBody' class='article__body'>",
        "<div id='main'>", "<section id='article'>", "<article id='story' class='hentry entry'>", "<div class='text'>"]
SIDE = ["<aside>", "<aside class='sidebar'>", "<div class='sidebar'>", "<div id='right-column' class='widget'>",
        "<section class='related-posts'>", "<div class='recommended'>", "<div class='widget-area'>", "<div id='secondary'>"]
NAV = ["<nav>", "<nav class='main-menu'>", "<div class='menu'>", "<div id='navigation'>", "<div class='breadcrumbs'>",
       "<ul class='nav'>", "<div role='navigation'>", "<div class='pagination'>", "<div class='topbar'>", "<menu>"]
HEAD = ["<header>", "<header class='site-header'>", "<div id='header'>", "<div class='masthead'>", "<div class='page-header'>"]
FOOT = ["<footer>", "<footer class='site-footer'>", "<div id='footer'>", "<div class='copyright'>", "<div class='legal'>"]
AD = ["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div id='ad-slot'>", "<div class='advertisement'>",
      "<div class='sponsored'>", "<div class='promo'>", "<aside class='ad'>", "<div class='banner'>", "<section class='sponsor'>",
      "<div class='ad-box'>"]
NOTICE = ["<div class='cookie-notice'>", "<div id='cookie-banner'>", "<div class='notice'>", "<div class='consent'>",
          "<div role='alert' class='alert'>", "<div class='gdpr'>", "<div class='popup modal'>", "<dialog>", "<noscript>",
          "<div class='cookies'>", "<div role='dialog'>"]
FORM = ["<form>", "<form class='newsletter'>", "<div class='subscribe'><form>", "<form id='search-form'>", "<form class='login'>"]
COMMENT = ["<section id='comments'>", "<div class='comments'>", "<div id='disqus_thread' class='comment-list'>",
           "<ol class='commentlist'>", "<section class='reader-comments'>", "<div class='responses'>", "<div class='replies'>",
           "<div class='discussion'>"]
SHARE = ["<div class='share'>", "<div class='social'>", "<ul class='share-buttons'>", "<div class='tags'>"]
COOKIE_WORDS = ["cookies", "cookie policy", "consent", "privacy policy"]


def closing(opening: str) -> str:
    tags = [t.split(">")[0].split(" ")[0] for t in opening.split("<") if t]
    return "".join(f"</{t}>" for t in reversed(tags))


class Page:
    def __init__(self, rng: random.Random):
        self.rng, self.labels = rng, {}

    def words(self, low: int, high: int, label: int, end: str = ".") -> str:
        r = self.rng
        n = r.randint(low, high)
        out = ["".join(r.choice(["ba", "en", "tio", "ra", "lu", "sch", "é", "or", "th", "in", "ox", "ni"])
                       for _ in range(r.randint(1, 4))) for _ in range(n)]
        for i in range(0, n, r.randint(6, 14)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += r.choice([".", ",", "."])
        text = " ".join(out)
        text += f" {r.randrange(10 ** 6)}" if n > 1 and r.random() < 0.2 else ""
        if text in self.labels:
            text += f" {r.randrange(10 ** 9)}"
        text += end
        self.labels[text] = label
        return text

    def links(self, opening: str, low: int = 2, high: int = 8) -> str:
        r = self.rng
        plain = r.random() < 0.3
        items = [f"<a href='/{i}'>{self.words(1, 4, 0, '')}</a>" for i in range(r.randint(low, high))]
        if opening.startswith("<ul") or not plain:
            body = "".join(f"<li>{x}</li>" for x in items)
            body = body if opening.startswith("<ul") else f"<ul>{body}</ul>"
        else:
            body = "".join(f"<div>{x}</div>" for x in items)
        return opening + body + closing(opening)

    def boiler(self, opening: str, low: int, high: int, blocks: int = 1) -> str:
        r = self.rng
        bare = r.random() < 0.5 and blocks == 1
        body = "".join(self.words(low, high, 0) if bare else f"<p>{self.words(low, high, 0)}</p>" for _ in range(blocks))
        return opening + body + closing(opening)

    def comments(self) -> str:
        r = self.rng
        opening = r.choice(COMMENT)
        one = r.choice(["<div class='comment'>", "<li class='comment'>", "<article class='comment'>", "<div>", "<li>"])
        body = f"<h3>{self.words(1, 3, 0, '')}</h3>" if r.random() < 0.6 else ""
        for _ in range(r.randint(1, 5)):
            who = f"<div class='author'>{self.words(1, 2, 0, '')}</div>" if r.random() < 0.4 else ""
            text = self.words(3, 70, 0)
            body += one + who + (f"<p>{text}</p>" if r.random() < 0.7 else text) + closing(one)
        return opening + body + closing(opening)

    def article(self) -> str:
        r = self.rng
        opening = r.choice(MAIN)
        wrap = r.choice(["<p>", "<p>", "<p>", "<p class='para'>", "<div>"])
        out = []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(2, 12, 1, '')}</h1>")
        for _ in range(r.choice([1, 2, 4, 6, 9, 14, 20])):
            k = r.random()
            if k < 0.74:
                t = self.words(*r.choice([(1, 3), (4, 15), (15, 60), (40, 140)]), 1)
                if r.random() < 0.1:
                    t2 = f"{t[:-1]} linked."
                    self.labels[t2] = 1
                    t = f"{t[:-1]} <a href='/x'>linked</a>."
                out.append(wrap + (f"<b>{t}<br>" if r.random() < 0.1 else t + (closing(wrap) if r.random() < 0.9 else "")))
            elif k < 0.82:
                out.append(f"<h2>{self.words(1, 8, 1, '')}</h2>")
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.words(1, 20, 1)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif k < 0.91:
                out.append(f"<blockquote>{self.words(5, 40, 1)}</blockquote>")
            elif k < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4, 1, '')}<td>{self.words(1, 4, 1, '')}" for _ in range(3)) + "</table>")
            elif k < 0.94:
                out.append(f"<pre>{self.words(3, 20, 1)}</pre>")
            elif k < 0.96:
                out.append(self.boiler(r.choice(AD), 2, 30))
            elif k < 0.97:
                out.append(self.links(r.choice(SHARE + SIDE)))
            elif k < 0.98:
                out.append(self.form())
            else:
                out.append(self.boiler(r.choice(NOTICE), 3, 30))
        if r.random() < 0.15:
            out.append(self.comments())
        return opening + "".join(out) + closing(opening)

    def form(self) -> str:
        opening = self.rng.choice(FORM)
        return (opening + f"<label>{self.words(1, 5, 0, '')}</label><input type='text'>"
                + (f"<p>{self.words(3, 25, 0)}</p>" if self.rng.random() < 0.5 else "")
                + f"<button>{self.words(1, 2, 0, '')}</button>" + closing(opening))

    def render(self) -> str:
        r = self.rng
        top, bottom = [], []
        title = f"<title>{self.words(2, 10, 0, '')}</title><style>p{{margin:0}}</style>" if r.random() < 0.9 else ""
        if r.random() < 0.5:
            h = r.choice(HEAD)
            top.append(h + f"<h1>{self.words(1, 4, 0, '')}</h1>" * (r.random() < 0.4)
                       + (f"<p>{self.words(2, 12, 0)}</p>" if r.random() < 0.6 else "") + closing(h))
        for _ in range(r.choice([0, 1, 1, 2])):
            top.append(self.links(r.choice(NAV)))
        for pool, place, chance, size in ((NOTICE, top, 0.3, (3, 60)), (AD, top, 0.5, (2, 60)), (AD, bottom, 0.3, (2, 60)),
                                          (SIDE, top, 0.15, (5, 70)), (SIDE, bottom, 0.4, (5, 70)), (NOTICE, bottom, 0.2, (3, 60))):
            if r.random() < chance:
                if pool is NOTICE and r.random() < 0.4:
                    text = self.words(4, 30, 0) + " " + r.choice(COOKIE_WORDS)
                    self.labels[text] = 0
                    place.append(f"<div>{text}</div>")
                else:
                    place.append(self.boiler(r.choice(pool), *size, blocks=r.choice([1, 1, 2, 3])))
        if r.random() < 0.4:
            bottom.append(self.links(r.choice(SIDE + SHARE)))
        if r.random() < 0.3:
            r.choice([top, bottom]).append(self.form())
        if r.random() < 0.4:
            bottom.append(self.comments())
        f = r.choice(FOOT)
        if r.random() < 0.85:
            words = self.words(2, 14, 0)
            text = f"© {words}"
            self.labels[text] = 0
            bottom.append(f + r.choice([f"&copy; {words}", f"<p>&copy; {words}</p>", words]) + closing(f))
        r.shuffle(top)
        body = "".join(top) + self.article() + "".join(bottom)
        if r.random() < 0.3:
            body = f"<div class='{r.choice(['wrapper', 'container', 'page', 'site'])}'>{body}</div>"
        return f"<!DOCTYPE html><html><head>{title}</head><body>{body}</body></html>"


def labelled_pages(count: int, seed: int):
    """Yield (html, {block text: 1 if main else 0})."""
    rng = random.Random(seed)
    for _ in range(count):
        page = Page(rng)
        source = page.render()
        yield source, page.labels
