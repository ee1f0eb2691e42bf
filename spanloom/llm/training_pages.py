"""Labelled pages for the extraction model, made here from a seed: layouts vary, the labels are known."""

from __future__ import annotations

import html
import random

# Names that pages give to what is not their article, and to their article, by purpose.
SIDE_NAMES = {
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "adbox"),
    "notice": ("cookie", "cookie-notice", "consent", "notice", "banner", "alert", "gdpr", "popup", "modal", "paywall"),
    "sidebar": ("sidebar", "side", "widget", "rail", "aside", "right-column", "related", "recommended", "trending", "most-read"),
    "share": ("share", "social", "share-bar", "follow", "toolbar"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "reply", "respond", "disqus", "reader-comments", "responses", "feedback"),
    "menu": ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "pagination", "pager", "toc", "tags", "skip"),
    "head": ("header", "masthead", "site-header", "top", "logo", "branding"),
    "foot": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon"),
    "form": ("search", "login", "newsletter", "subscribe", "signup", "contact-form"),
}
BODY_NAMES = ("content", "article", "post", "post-content", "entry", "entry-content", "article-body", "main", "story", "text", "body", "page-content", "")
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an er in on ou th st re ch".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.label = rng, [], []

    def words(self, n: int) -> str:
        r = self.rng
        text = " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(max(1, n)))
        style = r.random()
        if style < 0.08:
            return text.upper().replace(" ", "!! ")
        if style < 0.14:
            return text.replace(" ", r.choice(("&&& ", "### ", " | ")))
        text = text.capitalize()
        return text + r.choice((".", ".", "!", "?", "", "...")) if n > 3 else text

    def prose(self) -> str:
        return " ".join(self.words(self.rng.randint(3, 14)) for _ in range(self.rng.choice((1, 1, 2, 3, 5, 9))))

    def inline(self, text: str) -> str:
        r, out = self.rng, html.escape(text)
        if r.random() < 0.3 and " " in out:
            a, b = out.split(" ", 1)
            tag = r.choice(("b", "i", "em", "strong", "span", "code"))
            out = f"<{tag}>{a}</{tag}> {b}"
        if r.random() < 0.15:
            out += f' <a href="/{self.words(1)}">{self.words(2)}</a>'
        return out

    def put(self, markup: str) -> None:
        self.parts.append(markup)

    def side(self, kind: str) -> None:
        """Something that is not the article."""
        r, plain = self.rng, html.escape
        name = r.choice(SIDE_NAMES[kind])
        tag = {"menu": "nav", "head": "header", "foot": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = tag if r.random() < 0.7 else r.choice(("div", "section"))
        semantic = tag not in ("div", "section")
        attr = f' {r.choice(("class", "id", "class"))}="{name}{r.choice(("", "-" + str(r.randint(1, 9)), " box"))}"' if not semantic or r.random() < 0.5 else ""
        links = lambda n: "".join(f'<li><a href="/{self.words(1)}">{plain(self.words(r.randint(1, 3)))}</a></li>' for _ in range(n))
        if kind == "menu":
            inner = f"<ul>{links(r.randint(2, 8))}</ul>" if r.random() < 0.7 else " &gt; ".join(f'<a href="#">{plain(self.words(1))}</a>' for _ in range(r.randint(2, 6)))
        elif kind == "head":
            inner = r.choice(("<h1>{}</h1>", "<a href='/'>{}</a>", "<p>{}</p>")).format(plain(self.words(3))) + (f"<p>{plain(self.words(6))}</p>" if r.random() < 0.5 else "")
        elif kind == "foot":
            inner = r.choice((f"&copy; {r.randint(1999, 2026)} {self.words(2)} &middot; ", f"<p>&copy; {self.words(3)}</p>", "")) + "\n".join(plain(self.words(r.randint(2, 9))) for _ in range(r.randint(1, 3))) + (f"<ul>{links(3)}</ul>" if r.random() < 0.4 else "")
        elif kind == "comments":
            row = r.choice(("<li>{}</li>", "<div class='comment'><b>{}</b></div>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>"))
            inner = f"<h3>{plain(self.words(1))}</h3>" * (r.random() < 0.6) + "".join(row.format(f"{plain(self.words(2))}: {plain(self.prose())}") for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{plain(self.words(3))}</label><input name=q><p>{plain(self.words(7))}</p><button>{plain(self.words(1))}</button>"
        elif kind == "sidebar":
            inner = f"<h3>{plain(self.words(2))}</h3>" + r.choice((f"<ul>{links(r.randint(2, 6))}</ul>", f"<p>{plain(self.prose())}</p>"))
        elif kind == "share":
            inner = "".join(f'<a href="#">{plain(self.words(1))}</a> ' for _ in range(r.randint(2, 4)))
        else:
            inner = r.choice(("{}", "<p>{}</p>", "<a href='/x'>{}</a>")).format(plain(self.prose()))
        self.mark(f"<{tag}{attr}>{inner}</{tag}>", 0)

    def mark(self, markup: str, label: int) -> None:
        self.parts.append((markup, label))

    def body(self) -> None:
        """The article, now and then with something else inside."""
        r = self.rng
        tag = r.choice(("article", "article", "article", "main", "div", "section", "td"))
        names = [n for n in BODY_NAMES if n or tag in ("article", "main")]
        name = r.choice(names) if r.random() < 0.7 or tag not in ("article", "main") else ""
        self.put(("<table><tr>" if tag == "td" else "") + f"<{tag}" + (f' {r.choice(("class", "id"))}="{name}"' if name else "") + ">")
        if r.random() < 0.75:
            self.mark(f"<h1>{self.inline(self.words(r.randint(2, 10)))}</h1>", 1)
        for _ in range(r.choice((1, 1, 2, 4, 7, 12))):
            kind = r.random()
            if kind < 0.62:
                end = "" if r.random() < 0.2 else "</p>"
                self.mark(f"<p>{self.inline(self.prose())}{'<br>' + self.inline(self.prose()) if r.random() < 0.2 else ''}{end}", 1)
            elif kind < 0.7:
                self.mark(f"<h{r.choice('234')}>{self.inline(self.words(r.randint(1, 6)))}</h3>", 1)
            elif kind < 0.78:
                self.mark("<ul>" + "".join(f"<li>{self.inline(self.words(r.randint(2, 12)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>", 1)
            elif kind < 0.83:
                self.mark(f"<blockquote>{self.inline(self.prose())}</blockquote>", 1)
            elif kind < 0.86:
                self.mark("<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(2)}</td></tr>" for _ in range(3)) + "</table>", 1)
            elif kind < 0.9:
                self.mark(f"<div>{self.inline(self.prose())}</div>", 1)
            else:
                self.side(r.choice(("ad", "share", "form", "sidebar", "notice", "comments")))
        if r.random() < 0.15:
            self.side("comments")
        self.put(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))


def labelled_page(seed: int) -> list[tuple[str, int | None]]:
    """A page as (markup, label) parts: 1 is the article, 0 is not, None has no text of its own."""
    p = _Page(random.Random(seed))
    r = p.rng
    title = html.escape(p.words(5))
    p.put("<!DOCTYPE html><html><head>")
    p.mark(f"<title>{title}</title>", 0)
    p.put('<style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
    wrapped = r.random() < 0.4
    p.put('<div id="page" class="wrapper container">' if wrapped else "")
    for kind in r.sample(("head", "menu", "menu", "notice", "ad", "form", "sidebar"), r.randint(0, 5)):
        p.side(kind)
    p.body()
    for kind in r.sample(("sidebar", "comments", "ad", "share", "form", "menu", "notice"), r.randint(0, 4)):
        p.side(kind)
    if r.random() < 0.8:
        p.side("foot")
    p.put("</div>" if wrapped else "")
    p.put("</body></html>")
    return [x if isinstance(x, tuple) else (x, None) for x in p.parts if x]
