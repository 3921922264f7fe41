"""Made-up pages whose main text is known, to train the extractor.

Layouts, tag choices, names of classes and lengths of texts vary; words are random
letters, so that only form can be learnt.
"""

from __future__ import annotations

import random

NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu site-nav pagination tabs toc skip-link lang-switch".split(),
    "header": "header site-header masthead topbar branding logo page-header banner-top head".split(),
    "footer": "footer site-footer colophon copyright legal bottom foot footnotes-links credits".split(),
    "sidebar": "sidebar aside widget related rail side-col secondary recommended trending popular more-stories right-col".split(),
    "notice": "cookie cookie-banner consent notice alert gdpr popup modal newsletter subscribe signup paywall overlay message privacy-notice".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner ad-slot dfp outbrain adsbygoogle partner".split(),
    "form": "form search login search-form contact-form subscribe-form poll signin".split(),
    "comments": "comments comment-list comment replies discussion disqus responses comment-body reader-comments respond".split(),
    "share": "share social sharing share-buttons follow tools tags post-meta-links".split(),
    "content": "article content post entry story main-content article-body post-content entry-content text body-text story-body page-content".split(),
    "plain": "row col container wrapper inner box section block group layout grid clearfix c1 x9 css-1abc".split(),
}
TAGS = {
    "menu": ["nav", "div", "ul", "nav"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "sidebar": ["aside", "div", "section"],
    "notice": ["div", "section", "dialog", "p"], "advert": ["div", "aside", "section", "p", "ins"], "form": ["form", "div"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul", "p"],
}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search"}
VOWELS, CONSONANTS = "aeiouéü", "bcdfghklmnprstvz"


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(CONSONANTS) + self.r.choice(VOWELS) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        w = [self.word() for _ in range(self.r.randint(3, 18))]
        if len(w) > 6 and self.r.random() < 0.5:
            w[self.r.randint(1, len(w) - 2)] += ","
        return " ".join(w).capitalize() + self.r.choice(".....?!")

    def paragraph(self, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def inline(self, text: str) -> str:
        w = text.split()
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            i = self.r.randrange(len(w))
            t = self.r.choice(["b", "i", "em", "strong", "a", "span"])
            w[i] = f"<{t}{' href=/x' if t == 'a' else ''}>{w[i]}</{t}>"
        return " ".join(w)

    def attrs(self, kind: str, named: float) -> str:
        r = self.r
        out = ""
        if r.random() < named:
            names = [r.choice(NAMES[kind])] + ([r.choice(NAMES["plain"])] if r.random() < 0.3 else [])
            out += f' {r.choice(["class", "class", "id"])}="{" ".join(names)}"'
        if kind in ROLES and r.random() < 0.2:
            out += f' role="{ROLES[kind]}"'
        return out

    def link_list(self, n: int) -> str:
        r = self.r
        items = [f'<a href="/{self.word()}">{self.words(r.randint(1, 4))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.75 else " | ".join(items)

    def bad(self, kind: str) -> str:
        """A block of a page that is not its main text; every element of it is marked."""
        r = self.r
        tag = r.choice(TAGS[kind])
        semantic = tag in ("nav", "header", "footer", "aside", "form")
        a = self.attrs(kind, 0.5 if semantic else 1.0)
        if kind == "menu":
            inner = self.link_list(r.randint(3, 12))
            if tag == "ul":
                inner = inner.removeprefix("<ul>").removesuffix("</ul>")
        elif kind == "header":
            inner = f'<a href="/">{self.words(2)}</a>' + (f"<h1>{self.words(2)}</h1>" if r.random() < 0.2 else "") + (f"<p>{self.words(5)}</p>" if r.random() < 0.5 else "")
            inner += self.link_list(5) if r.random() < 0.4 else ""
        elif kind == "footer":
            inner = r.choice(["&copy; ", "© 2020 ", "Copyright ", ""]) + self.word() + r.choice([" &middot; ", ". ", " | "]) + self.sentence()
            if r.random() < 0.5:
                inner = f"<p>{inner}</p>" + self.link_list(r.randint(2, 8))
        elif kind == "sidebar":
            inner = f"<h{r.choice('234')}>{self.words(2)}</h3>" + self.link_list(r.randint(2, 8)) + (f"<p>{self.paragraph(2)}</p>" if r.random() < 0.5 else "")
        elif kind == "notice":
            inner = self.paragraph(2) + (f" <button>{self.word()}</button>" if r.random() < 0.6 else "") + (f' <a href="/p">{self.words(2)}</a>' if r.random() < 0.4 else "")
            inner = f"<p>{inner}</p>" if r.random() < 0.5 and tag != "p" else inner
        elif kind == "advert":
            inner = r.choice([self.sentence(), f'<a href="http://x/">{self.sentence()}</a>', f"<p>{self.paragraph(2)}</p>" if tag != "p" else self.sentence(), "<img src=a>" + self.words(3)])
        elif kind == "form":
            inner = f"<label>{self.words(2)}</label><input name=q><button>{self.word()}</button>" + (f"<p>{self.sentence()}</p>" if r.random() < 0.4 else "")
        elif kind == "comments":
            one = lambda: f'<{"li" if tag in ("ol", "ul") else "div"}{self.attrs("comments", 0.6)}><b>{self.word()}</b> <p>{self.paragraph(3)}</p></{"li" if tag in ("ol", "ul") else "div"}>'
            inner = (f"<h3>{self.words(2)}</h3>" if tag not in ("ol", "ul") else "") + "".join(one() for _ in range(r.randint(1, 6)))
        else:
            inner = self.link_list(r.randint(2, 5)) if tag != "ul" else "".join(f"<li><a href=/s>{self.word()}</a></li>" for _ in range(3))
        return f'<{tag} data-kind="0"{a}>{inner}</{tag}>'

    def body(self) -> str:
        """The main text."""
        r = self.r
        out = [f"<h1>{self.words(r.randint(2, 9)).capitalize()}</h1>"] if r.random() < 0.9 else []
        if out and r.random() < 0.2:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            k = r.random()
            if k < 0.78:
                out.append(f"<p>{self.inline(self.paragraph(r.choice([1, 2, 4, 7])))}" + ("</p>" if r.random() < 0.9 else ""))
            elif k < 0.86:
                out.append(f"<h{r.choice('23')}>{self.words(r.randint(1, 6))}</h2>".replace("</h2>", f"</{'h2'}>"))
            elif k < 0.91:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{self.inline(self.sentence())}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif k < 0.94:
                out.append(f"<blockquote><p>{self.paragraph(2)}</p></blockquote>")
            elif k < 0.96:
                out.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif k < 0.98:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(r.randint(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<pre>{self.words(6)}</pre>")
        for kind in ("advert", "share", "notice", "sidebar", "form"):
            if r.random() < 0.15:
                out.insert(r.randint(1, len(out)), self.bad(kind))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        tag = r.choice(["article", "main", "div", "section", "div", "article"])
        main = f'<{tag}{self.attrs("content", 0.4 if tag in ("article", "main") else 0.85)}>{self.body()}</{tag}>'
        for _ in range(r.choice([0, 0, 1, 2])):
            t = r.choice(["div", "main", "section", "div"])
            main = f'<{t}{self.attrs("plain", 0.6)}>{main}</{t}>'
        above = [self.bad(k) for k in ("header", "menu", "notice", "advert", "form") if r.random() < (0.3 if k in ("notice", "form") else 0.6)]
        below = [self.bad(k) for k in ("sidebar", "comments", "advert", "share", "menu", "notice", "footer") if r.random() < (0.85 if k == "footer" else 0.35)]
        r.shuffle(above)
        body = "".join(above) + main + "".join(below)
        if r.random() < 0.3:
            body = f'<div{self.attrs("plain", 0.7)}>{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{body}<script>x('<p>')</script></body></html>"
