"""Labelled pages for the extraction model, made by rule: data-main="1" opens main text, data-main="0" takes a part out of it; children inherit.

Layouts vary in boxes (with and without telling class names, tables, bare bodies),
in kinds of blocks, in what surrounds and interrupts the text, in length and in
language. Words are put together from syllables, so that no word of a table tells.
"""

from __future__ import annotations

import random

#: How a page without boxes begins whose own text is main text.
BARE = "<!-- main text -->"

SYLLABLES = {
    "en": "the of and to in ing er ed ation ly ment re con st ough sh th wh ter ness".split(),
    "de": "der die und zu den ein ich sch ung heit keit ver ge be aus ß ü ä ten lich".split(),
    "fr": "le la de des et en que tion ment eux è é ou pré par au ç ille eur ais".split(),
    "es": "el la de que y en los ción mente ado ñ ar es por con ía á ero dad tra".split(),
}
MENU_CLASSES = ("nav", "menu", "main-menu", "navbar", "top-nav", "breadcrumb", "")
EDGE_CLASSES = ("footer", "site-footer", "page-header", "masthead", "copyright", "", "", "", "")
SIDE_CLASSES = ("sidebar", "widget", "related-posts", "right-rail", "most-popular", "recommended")
AD_CLASSES = ("ad", "advert", "ad-slot", "sponsored", "promo", "advertisement", "ads banner")
NOTICE_CLASSES = ("cookie-notice", "notice", "consent-banner", "alert", "gdpr", "popup", "modal")
COMMENT_CLASSES = ("comments", "comment-list", "discussion", "replies", "reader-comments")
FORM_CLASSES = ("newsletter", "newsletter-signup", "subscribe-box", "login", "signup", "searchform")
SHARE_CLASSES = ("share", "social-links", "sharing")
MAIN_BOXES = (
    ("<article{}>", "</article>"), ("<main{}>", "</main>"), ("<div{}>", "</div>"), ('<div class="content"{}>', "</div>"), ('<div id="article-body" class="post"{}>', "</div>"),
    ('<main{}><article class="story">', "</article></main>"), ('<div id="page"><div class="entry-content"{}>', "</div></div>"), ("<section{}>", "</section>"),
    ("<table><tr><td{}>", "</td></tr></table>"), ('<div class="wrap"><div{}>', "</div></div>"), ("<div><div{}>", "</div></div>"), ("<main{}><div><section>", "</section></div></main>"), ('<div id="content"{}>', "</div>"), ('<div class="main"><div class="text"{}>', "</div></div>"),
)
#: Classes of parts of the text that say nothing against it.
INNER_CLASSES = ("warning", "note", "author-note", "links", "intro", "lead", "box", "highlight", "infobox", "step", "tip", "important", "example", "quote", "message", "meta")


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = SYLLABLES[self.r.choice(sorted(SYLLABLES))]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 3)))

    def sentence(self, least: int = 4, most: int = 16) -> str:
        words = [self.word() for _ in range(self.r.randint(least, most))]
        return (" ".join(words)).capitalize() + self.r.choice("...?!")

    def prose(self, n: int) -> str:
        return " ".join(self.sentence() for _ in range(n))

    def link(self) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 3)))}</a>'

    def named(self, tag: str, names: tuple[str, ...], body: str) -> str:
        name = self.r.choice(names)
        how = self.r.choice(("class", "id"))
        return f'<{tag} {how}="{name}">{body}</{tag}>' if name else f"<{tag}>{body}</{tag}>"

    # --- what is not main text

    def menu(self) -> str:
        links = [self.link() for _ in range(self.r.randint(3, 9))]
        own = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if self.r.random() < 0.6 else " | ".join(links)
        return f"<nav>{own}</nav>" if self.r.random() < 0.5 else self.named("div", MENU_CLASSES, own)

    def header(self) -> str:
        own = f"<h1>{self.sentence(1, 3)}</h1>" if self.r.random() < 0.4 else f'<div class="logo">{self.sentence(1, 3)}</div>'
        own += f"<p>{self.prose(1)}</p>" if self.r.random() < 0.5 else ""
        return f"<header>{own}</header>" if self.r.random() < 0.6 else f'<div id="{self.r.choice(("header", "site-header", "masthead"))}">{own}</div>'

    def footer(self) -> str:
        own = self.r.choice((f"&copy; 20{self.r.randint(10, 30)} {self.prose(1)}", f"© {self.prose(2)} {self.link()}", f"<p>Copyright {self.prose(1)}</p>{self.link()}", f"{self.link()} {self.link()} &copy; {self.sentence(1, 4)}", self.prose(1)))
        if "opy" not in own and "©" not in own:
            return f"<footer>{own}</footer>"
        return f"<footer>{own}</footer>" if self.r.random() < 0.5 else self.named("div", EDGE_CLASSES, own)

    def side(self) -> str:
        own = f"<h3>{self.sentence(1, 3)}</h3><p>{self.prose(self.r.randint(1, 2))}</p>"
        if self.r.random() < 0.6:
            own += "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        return f"<aside>{own}</aside>" if self.r.random() < 0.4 else self.named("div", SIDE_CLASSES, own)

    def advert(self) -> str:
        own = self.prose(self.r.randint(1, 3))
        return self.named(self.r.choice(("div", "div", "section", "p")), AD_CLASSES, own if self.r.random() < 0.6 else f"<p>{own}</p>{self.link()}")

    def notice(self) -> str:
        own = f"<p>{self.prose(self.r.randint(1, 2))}</p>" + ("<button>" + self.word() + "</button>" if self.r.random() < 0.6 else "")
        return self.named("div", NOTICE_CLASSES, own) if self.r.random() < 0.8 else f'<div role="alert">{own}</div>'

    def form(self) -> str:
        own = f'<label>{self.sentence(1, 3)}</label><input name="q"><select><option>{self.word()}</option><option>{self.word()}</option></select><button>{self.word()}</button>'
        if self.r.random() < 0.4:
            return self.named("div", FORM_CLASSES, f"<p>{self.prose(1)}</p>" + (f"<form>{own}</form>" if self.r.random() < 0.5 else ""))
        return f"<form>{own if self.r.random() < 0.6 else ''}<p>{self.prose(1)}</p></form>"

    def hidden(self) -> str:
        return f"<div {self.r.choice(('hidden', 'style=\"display: none\"', 'aria-hidden=\"true\"'))}><p>{self.prose(1)}</p></div>"

    def comments(self) -> str:
        each = [f'<div class="comment"><p>{self.prose(self.r.randint(1, 3))}</p></div>' if self.r.random() < 0.7 else f'<li class="comment">{self.prose(1)}</li>' for _ in range(self.r.randint(1, 5))]
        return self.named(self.r.choice(("section", "div", "ol")), COMMENT_CLASSES, f"<h3>{self.sentence(1, 2)}</h3>" + "".join(each))

    def share(self) -> str:
        return self.named("div", SHARE_CLASSES, " ".join(self.link() for _ in range(self.r.randint(2, 4))))

    # --- main text

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            k = self.r.randrange(len(words))
            words[k] = self.r.choice((f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", f'<a href="/x">{words[k]}</a>', f"<span>{words[k]}</span>", f"<code>{words[k]}</code>", f"<math><mi>{words[k]}</mi></math>"))
        return " ".join(words)

    def block(self, depth: int = 0) -> str:
        p = lambda n=None: f"<p>{self.inline(self.prose(n or self.r.choice((1, 1, 2, 3, 5, 9))))}</p>"
        kind = self.r.randrange(23)
        if kind == 22:
            return f"<p>{self.r.choice(('All rights reserved.', 'Copyright notice: ' + self.prose(1), '&copy; ' + self.sentence(1, 3)))}</p>"
        if kind < 9 or depth > 2:
            return p()
        if kind == 9:
            return f"<h{self.r.randint(2, 4)}>{self.sentence(1, 5)}</h2>"
        if kind == 10:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.prose(1))}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if kind == 11:
            return "<table>" + "".join(f"<tr><th>{self.word()}</th><td>{self.sentence(1, 6)}</td><td>{self.word()}</td></tr>" for _ in range(self.r.randint(1, 5))) + "</table>"
        if kind == 12:
            return f"<blockquote>{p()}</blockquote>"
        if kind == 13:
            return f"<details><summary>{self.sentence(1, 4)}</summary>{p()}{p()}</details>"
        if kind == 14:
            return f"<figure><img src=x><figcaption>{self.prose(1)}</figcaption></figure>"
        if kind == 15:
            return f"<dl><dt>{self.word()}</dt><dd>{self.prose(1)}</dd></dl>"
        if kind == 16:
            return f"<pre>{self.prose(1)}</pre>"
        if kind == 17:
            return self.r.choice((f"<noscript>{p()}</noscript>", f"<svg><text>{self.word()}</text></svg>", f"<xmp>{self.prose(1)}</xmp>", f"<template>{p()}</template>"))
        if kind < 20:
            return self.named("div", INNER_CLASSES, "".join(self.block(depth + 1) for _ in range(self.r.randint(1, 2))) if self.r.random() < 0.6 else self.prose(self.r.randint(1, 2)))
        return f"<{'div' if kind == 20 else 'section'}>" + "".join(self.block(depth + 1) for _ in range(self.r.randint(1, 3))) + f"</{'div' if kind == 20 else 'section'}>"

    def body(self) -> str:
        title = f"<h1>{self.sentence(2, 8)}</h1>"
        top = self.r.choice((title, title, f"<header>{title}</header>", "", f"<h2>{self.sentence(2, 6)}</h2>"))
        return top + "".join(self.block() for _ in range(self.r.choice((1, 1, 2, 4, 8, 16))))

    def page(self) -> str:
        some = lambda makers, most: [self.r.choice(makers)() for _ in range(self.r.randint(0, most))]
        front = some((self.menu, self.header, self.advert, self.notice, self.hidden), 4)
        back = some((self.footer, self.footer, self.side, self.comments, self.form, self.share, self.advert), 4)
        inset = [x.replace(">", ' data-main="0">', 1) for x in some((self.advert, self.side, self.form, self.comments, self.share, self.notice), self.r.choice((0, 0, 1, 3)))]
        if self.r.random() < 0.03:
            return BARE + "<br>".join(self.inline(self.prose(self.r.randint(1, 5))) for _ in range(self.r.randint(1, 4)))
        blocks, inset_at = self.body(), self.r.random() < 0.5
        body = "".join([*inset, blocks] if inset_at and self.r.random() < 0.3 else [blocks, *inset])
        if inset and inset_at:
            body += self.block()
        if self.r.random() < 0.15:  # no box at all: every block of the text is marked
            parts = "".join(f'<p data-main="1">{self.inline(self.prose(self.r.randint(1, 6)))}</p>' for _ in range(self.r.randint(1, 5)))
            own = (f'<h1 data-main="1">{self.sentence(2, 8)}</h1>' if self.r.random() < 0.6 else "") + parts
        else:
            opening, closing = self.r.choice(MAIN_BOXES)
            own = opening.format(' data-main="1"') + body + closing
        head = f"<html><head><title>{self.sentence(2, 6)}</title><style>p{{margin:0}}</style><script>var a=1;</script></head>" if self.r.random() < 0.7 else ""
        parts = f"{''.join(front)}{own}{''.join(back)}"
        if not head and self.r.random() < 0.6:
            return parts  # neither html nor body
        return f"{head}<body>{parts}</body>" + ("</html>" if head else "")


def labelled_pages(n: int = 500, first: int = 0) -> list[str]:
    """n pages; other numbers give other pages."""
    return [_Writer(1000 + first + i).page() for i in range(n)]
