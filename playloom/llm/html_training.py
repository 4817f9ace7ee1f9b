"""Generated pages with a label for every block, to train the block labeller."""

from __future__ import annotations

import random

from playloom.llm.html_leaves import Leaf, leaves

#: Names that page authors give to the parts of a page.
ARTICLE_NAMES = "content post entry article body story text main page single blog".split()
CHROME = {
    "menu": ("nav", "nav menu navbar navigation breadcrumb breadcrumbs topbar toc links pagination pager skip".split()),
    "header": ("header", "header masthead logo top brand title site hero".split()),
    "footer": ("footer", "footer copyright legal bottom colophon credits".split()),
    "sidebar": ("aside", "sidebar side widget related recommended popular trending tags share social archive more author".split()),
    "notice": ("div", "cookie consent gdpr notice alert banner popup modal newsletter subscribe message overlay privacy paywall".split()),
    "advert": ("div", "ad ads advert advertisement sponsored promo adsense sponsor promotion".split()),
    "form": ("form", "form search login signup contact".split()),
    "comments": ("section", "comments comment responses discussion replies disqus reply".split()),
}
PHRASES = "Home|About us|Contact|Log in|Sign up|Privacy policy|Terms of use|All rights reserved|Read more|Accept cookies|We use cookies on this site.|Subscribe to our newsletter|Share|Follow us|Search|Submit|Next|Previous|Advertisement|Sponsored|Reply|Leave a comment|Great article, thanks!|Skip to content|Archive|Imprint|Help".split("|")
SYLLABLES = "an er in th on re at en ing tion ed ly ha es le de la que ment ou der ung sch ich keit cion ado os ar ta mo ri ne lu".split()


class _Author:
    """Draws one page; marks every text with its label in front, to be read back from the leaves."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(out).capitalize()
        if r.random() < 0.15:
            text = " ".join(w + r.choice(("***", "###", "!!", " |", "$$$")) for w in text.split())
        return text + r.choice((".", ".", ".", "", "!", "?"))

    def sentences(self, low: int, high: int) -> str:
        if self.rng.random() < 0.05:
            return " ".join([self.words(1, 2)] * self.rng.randint(2, 60))
        return " ".join(self.words(2, 25) for _ in range(self.rng.randint(low, high)))

    def marked(self, label: int, text: str) -> str:
        return f"\ue000{label}{text}"

    def tag(self, name: str, inner: str, marks: str = "") -> str:
        end = "" if name in ("p", "li") and not marks and self.rng.random() < 0.15 else f"</{name}>"
        return f"<{name}{marks}>{inner}{end}"

    def inline(self, text: str) -> str:
        r, words = self.rng, text.split(" ")
        if len(words) > 3 and r.random() < 0.4:
            k = r.randrange(len(words))
            name = r.choice(("b", "i", "em", "strong", "a", "span", "code"))
            words[k] = f"<{name}{' href=/x' if name == 'a' else ''}>{words[k]}" + ("" if r.random() < 0.1 else f"</{name}>")
        return " ".join(words)

    def article(self) -> str:
        r, parts = self.rng, []
        if r.random() < 0.85:
            parts.append(self.tag("h1", self.marked(1, self.words(1, 14))))
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14, 25))):
            kind = r.random()
            if kind < 0.72:
                text = self.inline(self.marked(1, self.sentences(1, 1) if r.random() < 0.3 else self.sentences(1, 9)))
                if r.random() < 0.15:
                    text += "<br>" + self.marked(1, self.words(1, 10))
                parts.append(self.tag("p", text) if r.random() < 0.9 else self.tag("div", text))
            elif kind < 0.8:
                parts.append(self.tag(r.choice(("h2", "h3", "h4")), self.marked(1, self.words(1, 8))))
            elif kind < 0.87:
                items = "".join(self.tag("li", self.marked(1, self.words(1, 20))) for _ in range(r.randint(1, 6)))
                parts.append(self.tag(r.choice(("ul", "ol")), items))
            elif kind < 0.91:
                parts.append(self.tag("blockquote", self.tag("p", self.marked(1, self.sentences(1, 3)))))
            elif kind < 0.94:
                rows = "".join(self.tag("tr", "".join(self.tag("td", self.marked(1, self.words(1, 3))) for _ in range(3))) for _ in range(r.randint(1, 4)))
                parts.append(f"<table>{rows}</table>")
            elif kind < 0.96:
                parts.append(self.tag("pre", self.marked(1, self.words(3, 20))))
            elif kind < 0.98:
                parts.append(f"<figure><img src=x><figcaption>{self.marked(1, self.words(2, 12))}</figcaption></figure>")
            else:
                parts.append(self.chrome(r.choice(("advert", "sidebar", "notice", "form"))))
        body = "\n".join(parts)
        name = r.choice(ARTICLE_NAMES)
        marks = r.choice(("", f' class="{name}"', f' class="{name}-{r.choice(ARTICLE_NAMES)}"', f' id="{name}"', f' class="{name} x{r.randint(1, 99)}"'))
        shape = r.random()
        if shape < 0.5:
            return self.tag("article", body, r.choice(("", "", marks)))
        if shape < 0.7:
            return self.tag("main", self.tag(r.choice(("article", "div", "section")), body, marks))
        return self.tag(r.choice(("div", "section", "main")), body, marks or f' class="{name}"')

    def chrome(self, kind: str) -> str:
        r = self.rng
        tag, names = CHROME[kind]
        own = r.random() < 0.5 and tag != "div"
        name = r.choice(names) + r.choice(("", "", "", f"-{r.choice(names)}", f"-{r.choice(('box', 'list', 'wrap', 'bar', 'top', 'item', 'inner'))}"))
        marks = "" if own and r.random() < 0.6 else r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} c{r.randint(1, 99)}"'))
        tag = tag if own else r.choice(("div", "div", "section", "ul", "p") if kind in ("menu", "advert", "notice") else ("div", "section"))

        def short() -> str:
            return self.marked(0, r.choice(PHRASES) if r.random() < 0.5 else r.choice((self.words(1, 1), self.words(1, 4), self.words(1, 3).rstrip("."), self.words(1, 2).lower())))

        def links(n: int) -> str:
            items = [f'<a href="/{r.randint(1, 99)}">{short()}</a>' for _ in range(n)]
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else " ".join(f"<span>{i}</span>" for i in items)

        if kind == "form":
            fields = "".join(f"<label>{short()}</label><input name=x>" for _ in range(r.randint(0, 3)))
            inner = fields + r.choice(("", f"<textarea>{short()}</textarea>", f"<select><option>{short()}<option>{short()}</select>", f"<legend>{short()}</legend>", f"<p>{short()}</p>")) + f"<button>{short()}</button>"
        elif kind == "comments":
            inner = self.tag(r.choice(("h2", "h3")), short()) if r.random() < 0.6 else ""
            for _ in range(r.randint(1, 6)):
                text = self.marked(0, self.sentences(1, 4))
                inner += r.choice((self.tag("div", self.tag("p", text), ' class="comment"'), self.tag("p", text), self.tag("li", text), self.tag("article", self.tag("p", text), ' class="comment"')))
        elif kind in ("advert", "notice"):
            text = self.marked(0, self.sentences(1, 3)) if r.random() < 0.7 else short()
            inner = r.choice((text, text, text, self.tag("p", text), self.tag("h4", short()) + self.tag("p", text), text + f"<button>{short()}</button>"))
        elif kind == "footer":
            inner = r.choice(("&copy; ", "", "&middot; ")) + self.marked(0, self.words(1, 12)) + (links(r.randint(1, 6)) if r.random() < 0.5 else "")
        elif kind == "header":
            inner = r.choice((self.tag("h1", short()), self.tag("div", short()), f"<a href=/>{short()}</a>")) + (self.chrome("menu") if r.random() < 0.5 else "") + (self.tag("p", self.marked(0, self.words(2, 10))) if r.random() < 0.4 else "")
        elif kind == "sidebar":
            inner = self.tag(r.choice(("h3", "h4")), short()) + r.choice((links(r.randint(2, 7)), self.tag("p", self.marked(0, self.sentences(1, 3)))))
        else:
            inner = links(r.randint(2, 9))
        return self.tag(tag, inner, marks)

    def page(self) -> str:
        r = self.rng
        above = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if r.random() < 0.4]
        below = [k for k in ("comments", "sidebar", "advert", "form", "menu", "notice") if r.random() < 0.35]
        r.shuffle(above)
        r.shuffle(below)
        if r.random() < 0.4:
            above += r.choices(("menu", "advert", "notice"), k=2)
        parts = [self.chrome(k) for k in above] + [self.article()] + [self.chrome(k) for k in below]
        if r.random() < 0.8:
            parts.append(self.chrome("footer"))
        if r.random() < 0.3:
            parts = [self.tag("div", "".join(parts), r.choice((' class="wrapper"', ' id="page"', ' class="container"', "")))]
        return "<html><body>" + "".join(parts) + "</body></html>"


def labelled_page(seed: int) -> tuple[list[Leaf], list[int]]:
    """Leaf blocks of one generated page and 1 for those of the article."""
    blocks, labels = [], []
    for leaf in leaves(_Author(seed).page()):
        parts = leaf.text.split("\ue000")
        marks = [p[0] for p in parts[1:]]
        text = " ".join(" ".join([parts[0], *[p[1:] for p in parts[1:]]]).split())
        if marks and text:
            blocks.append(Leaf(leaf.path, text, min(leaf.linked, len(text))))
            labels.append(int(marks[0]))
    return blocks, labels
