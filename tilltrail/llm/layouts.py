"""Pages of many layouts whose main text is known, to train the extraction on.

Layouts differ in the elements around the article, in the names of classes, in what stands beside, inside and behind the article,
and in the length of its paragraphs. Elements that hold main text carry ``data-main="1"``, which the features do not see.
"""

from __future__ import annotations

import html
import random

# Class names that sites give to the parts of a page.
CONTENT = "article-body,post-content,entry-content,story,content,main-content,article__text,post,text,articleBody,prose,story-body".split(",")
PLAIN = "container,row,col-8,wrap,inner,grid,box,page,layout,css-1x2,block,clearfix,outer,columns,left,w-100,region,panel".split(",")
MENU = "nav,menu,main-nav,breadcrumbs,navbar,top-menu,pagination,toc,site-nav,topics".split(",")
ADVERT = "ad,ads,advert,ad-slot,sponsored,promo,banner,advertisement,partner-box,dfp-ad".split(",")
COMMENT = "comments,comment-list,replies,disqus_thread,discussion,reader-comments,responses,comment-thread".split(",")
SIDE = "sidebar,widget,related,recommended,side,more-stories,trending,rail,also-read,popular".split(",")
NOTICE = "cookie-notice,consent,alert,gdpr-banner,newsletter,subscribe-box,popup,paywall,notice,privacy-message".split(",")
SHARE = "share,social-links,share-bar,follow-us,tools,actions".split(",")
TOP = "header,site-header,masthead,topbar,logo-bar,page-header".split(",")
BOTTOM = "footer,site-footer,copyright,legal,imprint,colophon".split(",")
SYLLABLES = "ka lo mi ren tu sa vel do ni par".split()


class Writer:
    """One page: random, but the same for the same seed and words."""

    def __init__(self, seed: int, texts: list[str]):
        self.rng = random.Random(seed)
        self.texts = texts
        self.named = self.rng.random() < 0.65  # whether parts of the page have telling class names
        self.semantic = self.rng.random() < 0.5  # whether they are elements made for it

    def words(self, low: int, high: int) -> list[str]:
        n = self.rng.randint(low, high)
        found: list[str] = []
        while len(found) < n:
            if self.texts and self.rng.random() < 0.95:
                some = self.rng.choice(self.texts).split()
                start = self.rng.randrange(len(some))
                found += some[start : start + n]
            else:
                found += ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(8)]
        return found[:n]

    def sentence(self, low: int, high: int, stop: bool = True) -> str:
        text = " ".join(self.words(low, high))
        return html.escape(text.rstrip(".,") + "." if stop else text)

    def paragraph(self) -> str:
        r = self.rng.random()
        low, high = (1, 4) if r < 0.15 else (5, 25) if r < 0.45 else (25, 140)
        text = self.sentence(low, high, self.rng.random() < 0.9)
        if self.rng.random() < 0.2:
            parts = text.split(" ")
            at = self.rng.randrange(len(parts))
            kind = self.rng.choice(["b", "i", "em", 'a href="/x"', "code"])
            parts[at] = f"<{kind}>{parts[at]}</{kind.split()[0]}>"
            text = " ".join(parts)
        return text

    def names(self, some: list[str], chance: float = 0.9) -> str:
        if self.named and self.rng.random() < chance:
            name = self.rng.choice(some)
            if self.rng.random() < 0.3:
                name += " " + self.rng.choice(PLAIN)
            return f' {self.rng.choice(["class", "class", "id"])}="{name}"'
        return self.plain(0.5)

    def plain(self, chance: float = 0.6) -> str:
        return f' class="{self.rng.choice(PLAIN)}"' if self.rng.random() < chance else ""

    def element(self, semantic: str, some: list[str], inner: str) -> str:
        """A part of the page; without an element of its own it usually has a telling name."""
        if self.semantic and self.rng.random() < 0.8:
            return f"<{semantic}{self.names(some, 0.4)}>{inner}</{semantic}>"
        return f"<div{self.names(some)}>{inner}</div>"

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.sentence(low, high, False)}</a>'

    def links(self, low: int, high: int) -> str:
        items = [self.link() for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.rng.choice([" | ", " ", " &middot; "]).join(items)

    # Parts that are not main text.

    def menu(self) -> str:
        return self.element("nav", MENU, self.links(3, 12))

    def top(self) -> str:
        inner = f"<a href=\"/\">{self.sentence(1, 3, False)}</a>"
        inner += self.rng.choice(["", f"<p>{self.sentence(3, 10)}</p>", f"<h1>{self.sentence(1, 4, False)}</h1>", self.menu()])
        return self.element("header", TOP, inner)

    def advert(self) -> str:
        text = self.sentence(2, 30)
        inner = self.rng.choice([text, f"<p>{text}</p>", f"<b>{self.sentence(1, 3, False)}</b> {text} {self.link()}"])
        return f"<{(tag := self.rng.choice(['div', 'div', 'aside', 'section']))} class=\"{self.rng.choice(ADVERT)}\">{inner}</{tag}>"

    def notice(self) -> str:
        inner = f"<p>{self.sentence(6, 30)} {self.rng.choice(['', self.link()])}</p>" + self.rng.choice(["", "<button>OK</button>"])
        return f'<div class="{self.rng.choice(NOTICE)}">{inner}</div>'

    def share(self) -> str:
        return f'<div class="{self.rng.choice(SHARE)}">{self.links(2, 5)}</div>'

    def form(self) -> str:
        return f"<form{self.names(['search', 'newsletter-form', 'contact'], 0.5)}><label>{self.sentence(1, 6, False)}</label><input name=q><p>{self.sentence(3, 14)}</p><button>{self.sentence(1, 2, False)}</button></form>"

    def side(self) -> str:
        boxes = []
        for _ in range(self.rng.randint(1, 3)):
            inner = f"<h3>{self.sentence(1, 4, False)}</h3>"
            inner += self.rng.choice([self.links(3, 8), f"<p>{self.sentence(8, 40)}</p>", f'<article class="teaser"><h4>{self.link(3, 8)}</h4><p>{self.sentence(5, 20)}</p></article>'])
            boxes.append(f"<div{self.names(SIDE, 0.5)}>{inner}</div>")
        return self.element("aside", SIDE, "".join(boxes))

    def comments(self) -> str:
        tag = self.rng.choice(["li", "div", "article"])
        one = lambda: (
            f"<{tag}{self.names(['comment', 'reply', 'comment-item'], 0.8)}><{(by := self.rng.choice(['b', 'span', 'h4', 'cite']))}>{self.sentence(1, 2, False)}</{by}>"
            + self.rng.choice(["", f"<time>{self.rng.randrange(28)}.{self.rng.randrange(12)}.2021</time>"])
            + "".join(f"<p>{self.sentence(3, 60)}</p>" for _ in range(self.rng.randint(1, 2)))
            + self.rng.choice(["", '<a href="#">Reply</a>'])
            + f"</{tag}>"
        )
        many = "".join(one() for _ in range(self.rng.randint(1, 8)))
        many = f"<{self.rng.choice(['ol', 'ul'])}>{many}</ol>" if tag == "li" else many
        head = self.rng.choice(["", f"<h2>{self.sentence(1, 3, False)}</h2>", "<h3>Comments</h3>"])
        outer = self.rng.choice(["section", "div", "div"])
        return f'<{outer} {self.rng.choice(["class", "id"])}="{self.rng.choice(COMMENT)}">{head}{many}</{outer}>'

    def bottom(self) -> str:
        inner = self.rng.choice([f"&copy; {self.sentence(2, 8, False)}", f"<p>&copy; {self.sentence(3, 25)}</p>", self.links(2, 6) + f"<p>{self.sentence(4, 30)}</p>"])
        return self.element("footer", BOTTOM, inner)

    # The article.

    def body(self) -> str:
        kept = ' data-main="1"'
        parts = []
        if self.rng.random() < 0.8:
            level = self.rng.choice(["h1", "h1", "h2"])
            head = f"<{level}{kept}>{self.sentence(2, 12, False)}</{level}>"
            parts.append(f"<header{self.plain(0.2)}>{head}</header>" if self.rng.random() < 0.2 else head)
        if self.rng.random() < 0.15:
            parts.append(self.share())
        loose = self.rng.random() < 0.1
        tiny = self.rng.random() < 0.25
        for _ in range(self.rng.randint(1, 2 if tiny else 14)):
            if tiny:
                parts.append(f"<p{kept}>{self.sentence(1, 8)}</p>")
                continue
            r = self.rng.random()
            if r < 0.72:
                parts.append(self.paragraph() + "<br><br>" if loose else f"<p{kept}{self.plain(0.05)}>{self.paragraph()}</p>")
            elif r < 0.79:
                level = self.rng.choice(["h2", "h3"])
                parts.append(f"<{level}{kept}>{self.sentence(1, 8, False)}</{level}>")
            elif r < 0.85:
                items = "".join(f"<li{kept}>{self.sentence(2, 20, self.rng.random() < 0.5)}</li>" for _ in range(self.rng.randint(2, 6)))
                parts.append(f"<ul>{items}</ul>")
            elif r < 0.88:
                parts.append(f"<blockquote{kept}>{self.rng.choice([self.paragraph(), f'<p{kept}>{self.paragraph()}</p>'])}</blockquote>")
            elif r < 0.90:
                cells = "".join(f"<tr><td{kept}>{self.sentence(1, 4, False)}</td><td{kept}>{self.sentence(1, 4, False)}</td></tr>" for _ in range(3))
                parts.append(f"<table>{cells}</table>")
            elif r < 0.92:
                parts.append(f"<figure><img src=x><figcaption{kept}>{self.sentence(3, 15)}</figcaption></figure>")
            else:
                parts.append(self.rng.choice([self.advert, self.notice, self.share, self.side, self.form])())
        if self.rng.random() < 0.15:
            parts.append(self.comments())
        inner = "".join(parts)
        main = kept if loose else ""
        if self.semantic and self.rng.random() < 0.8:
            tag = self.rng.choice(["article", "article", "main"])
            names = self.names(CONTENT, 0.4)
        else:
            tag, names = self.rng.choice(["div", "div", "section", "td"]), self.names(CONTENT, 0.7)
        return f"<{tag}{names}{main}>{inner}</{tag}>"

    def page(self) -> str:
        pick = lambda some, low, high: [self.rng.choice(some)() for _ in range(self.rng.randint(low, high))]
        before = pick([self.menu, self.top, self.advert, self.notice, self.form, self.share], 0, 4)
        after = pick([self.side, self.comments, self.comments, self.advert, self.bottom, self.share, self.form], 0, 4)
        if self.rng.random() < 0.7:
            after.append(self.bottom())
        body = self.body()
        if self.rng.random() < 0.3:
            body = self.side() + body if self.rng.random() < 0.5 else body + self.side()
        for _ in range(self.rng.randint(0, 3)):
            body = f"<div{self.plain()}>{body}</div>"
        if self.rng.random() < 0.2 and before:
            before = [f"<div{self.plain()}>{''.join(before)}</div>"]
        return f"<html><head><title>{self.sentence(2, 8, False)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def pages(texts: list[str], n: int, seed: int = 0) -> list[str]:
    return [Writer(seed + i, texts).page() for i in range(n)]
