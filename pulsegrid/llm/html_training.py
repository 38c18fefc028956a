"""Training of the block labeller on generated pages.

Run as ``python -m pulsegrid.llm.html_training``; it writes the weights next to
:mod:`.html_labeller`. Pages are drawn from many layouts in which the role of
every block is known; words are drawn at random, so that the labeller leans on
structure, names and neighbours more than on vocabulary.
"""

from __future__ import annotations

import html
import random
import sys

import numpy as np

from .html_blocks import blocks
from .html_labeller import EMBED, HIDDEN, Features, Labeller, _sigmoid

#: Words by which sites name the parts of a page.
NAMES = {
    "main": "content main article post entry story body text page single prose markdown news blog hentry primary article-body post-content entry-content",
    "nav": "nav menu navigation navbar topbar breadcrumb breadcrumbs main-menu site-nav pager pagination links tabs toc",
    "header": "header masthead site-header top banner branding logo title-bar",
    "footer": "footer site-footer bottom colophon copyright legal foot",
    "side": "sidebar aside widget secondary rail related recommended popular trending recent-posts archive tags author-box more-stories",
    "notice": "notice cookie cookies consent gdpr alert popup modal message warning paywall disclaimer privacy banner-notice",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp ad-slot banner-ad partner",
    "form": "form search subscribe newsletter signup login contact-form search-form register feedback",
    "comments": "comments comment commentlist responses discussion replies reply disqus reader-comments thread respond feedback-list",
    "share": "share social sharing follow buttons toolbar",
}
SAID = {
    "nav": "Home,About,Contact,News,Sport,Archive,Next,Previous,More,Menu,Products,Blog,Help,Skip to content".split(","),
    "footer": "© 2024,All rights reserved,Privacy policy,Terms of use,Imprint,Powered by,Contact us,Copyright".split(","),
    "notice": "We use cookies,Accept all,This site uses cookies to improve your experience,Your browser is out of date,Please enable JavaScript,Read our privacy policy".split(","),
    "ad": "Advertisement,Sponsored,Buy now,Limited offer,Learn more,Special offer,Shop today".split(","),
    "form": "Search,Subscribe to our newsletter,Your e-mail,Submit,Sign up,Log in,Password,Send".split(","),
    "comments": "Reply,Leave a comment,3 comments,Posted by,says:,Log in to comment,Like,Report".split(","),
    "share": "Share,Tweet,Follow us,Print,E-mail this".split(","),
    "side": "Related articles,Most read,Recent posts,You may also like,Tags,About the author,Popular".split(","),
    "header": "Welcome,The daily,Your source,Subscribe".split(","),
}
_SYLLABLES = [
    "the th an on er re in nd ti es or at ed st ea ha en sh wh ing tion ly ble ou".split(),
    "le la de en re on ou ai tre ment que eux é è ê ch pa oi tion elle".split(),
    "der die sch ein en er ch ung keit ge be ver au zu ß ü ä tz pf lich".split(),
    "el la de os as ar es do ción ra rr ll ez ja mi ta co ga bo mente í ñ".split(),
]


class Site:
    """One page's random choices."""

    def __init__(self, r: random.Random):
        self.r = r
        self.syllables = r.choice(_SYLLABLES)
        self.main: list[str] = []
        self.odd = r.choice(["", "", "", "!!", "%%%", "###", "|", "&&&"])
        self.named = r.random()

    def word(self) -> str:
        w = "".join(self.r.choice(self.syllables) for _ in range(self.r.choice([1, 1, 1, 2, 2, 3, 4])))
        return w + self.odd if self.odd and self.r.random() < 0.8 else w

    def sentence(self, lo: int = 3, hi: int = 18) -> str:
        w = [self.word() for _ in range(self.r.randint(lo, hi))]
        w[0] = w[0][:1].upper() + w[0][1:]
        if len(w) > 6 and self.r.random() < 0.4:
            w[len(w) // 2] += ","
        return " ".join(w) + self.r.choice([".", ".", ".", ".", "?", "!", ""])

    def prose(self, short: float = 0.15) -> str:
        if self.r.random() < 0.02:
            return " ".join([self.word().capitalize()] * self.r.randint(5, 200))
        n = 1 if self.r.random() < short else self.r.randint(1, 7)
        return " ".join(self.sentence(1 if n == 1 else 3) for _ in range(n))

    def marked(self, text: str) -> str:
        """Escaped, and here and there with inline tags."""
        w = html.escape(text, quote=False).split(" ")
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            k, tag = self.r.randrange(len(w)), self.r.choice(["b", "i", "em", "strong", "a href='/x'", "code", "span"])
            if "<" not in w[k]:
                w[k] = f"<{tag}>{w[k]}</{tag.split(' ')[0]}>"
        if self.r.random() < 0.1:
            w[0] = "<b>" + w[0]  # never closed
        return " ".join(w)

    def attrs(self, kind: str, odds: float = 0.8) -> str:
        if self.r.random() > odds:
            return self.r.choice(["", "", ' class="row"', ' class="box inner"', ' id="c1"'])
        names = NAMES[kind].split()
        v = self.r.choice(names) if self.r.random() < 0.7 else f"{self.r.choice(['site', 'js', 'page', 'wp', 'block', 'x'])}-{self.r.choice(names)}"
        return f' {self.r.choice(["class", "class", "id"])}="{v}{self.r.choice(["", "", "-1", " clearfix", " wide"])}"'

    # parts; article parts carry the mark ‖ for main text -------------------

    def links(self, kind: str, n: int) -> str:
        text = [self.r.choice(SAID[kind]) if kind in SAID and self.r.random() < 0.4 else " ".join(self.word() for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        item = [f'<a href="/{k}">{html.escape(t)}</a>' for k, t in enumerate(text)]
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in item) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(item) if style < 0.8 else "".join(f"<div>{x}</div>" for x in item)

    def small(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.45:
            t = r.choice(SAID.get(kind, ["More"]))
        else:
            t = self.sentence(2, 14) if r.random() < 0.7 else self.prose()
        return self.marked(t)

    def box(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul", "menu"])
            inner = self.links("nav", r.randint(2, 9))
            return f"<{tag}{self.attrs(kind, 0.3 if tag == 'nav' else 0.95)}>{inner}</{tag}>"
        if kind == "header":
            inner = f"<{(h := r.choice(['h1', 'h2', 'div', 'p', 'span']))}>{self.small(kind)}</{h}>" + (f"<p>{self.small(kind)}</p>" if r.random() < 0.4 else "") + (self.box("nav") if r.random() < 0.4 else "")
            tag = r.choice(["header", "header", "div"])
            return f"<{tag}{self.attrs(kind, 0.4 if tag == 'header' else 0.95)}>{inner}</{tag}>"
        if kind == "footer":
            inner = r.choice([f"&copy; {self.small(kind)}", f"<p>{self.small(kind)}</p>", f"<p>&copy; x.example &middot; {self.small(kind)}</p>{self.links('footer', 3)}", f"<small>{self.small(kind)}</small>"])
            tag = r.choice(["footer", "footer", "footer", "div"])
            return f"<{tag}{self.attrs(kind, 0.3 if tag == 'footer' else 0.97)}>{inner}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            inner = "".join(
                r.choice([f"<h3>{self.small(kind)}</h3>", f"<p>{self.marked(self.prose())}</p>", self.links("side", r.randint(2, 6)), f"<div>{self.small(kind)}</div>"])
                for _ in range(r.randint(1, 4))
            )
            return f"<{tag}{self.attrs(kind, 0.4 if tag == 'aside' else 0.97)}>{inner}</{tag}>"
        if kind == "ad":
            inner = r.choice([self.marked(self.sentence(2, 16)), f"<p>{self.small(kind)}</p>", f"<a href='/buy'>{self.small(kind)}</a>", f"<span>{self.small(kind)}</span> {self.marked(self.prose())}"])
            tag = r.choice(["div", "div", "aside", "section", "p"])
            return f"<!-- ad --><{tag}{self.attrs(kind, 0.97)}>{inner}</{tag}>"
        if kind == "notice":
            inner = r.choice([f"<p>{self.small(kind)}</p><button>{r.choice(['OK', 'Accept'])}</button>", self.small(kind), f"<strong>{self.small(kind)}</strong> {self.small(kind)}"])
            tag = r.choice(["div", "section", "aside", "p", "dialog"])
            return f"<{tag}{self.attrs(kind, 0.97) or ' class=notice'}>{inner}</{tag}>"
        if kind == "form":
            return f"<form{self.attrs(kind, 0.5)}><label>{self.small(kind)}</label><input name=q>{r.choice(['', f'<p>{self.small(kind)}</p>', '<select><option>A<option>B</select>'])}<button>{r.choice(SAID[kind])}</button></form>"
        if kind == "comments":
            one = lambda: r.choice([f"<li><b>{self.word()}</b><p>{self.marked(self.prose())}</p></li>", f"<div{self.attrs(kind)}><p>{self.marked(self.prose())}</p></div>", f"<p>{self.marked(self.prose())}</p>", f"<article{self.attrs(kind)}><p>{self.marked(self.prose())}</p><span>{r.choice(SAID[kind])}</span></article>"])
            inner = (f"<h3>{self.small(kind)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
            tag = r.choice(["section", "div", "ol", "ul", "aside"])
            return f"<{tag}{self.attrs(kind, 1.0)}>{inner}</{tag}>" + (self.box("form") if r.random() < 0.3 else "")
        return f"<div{self.attrs('share', 0.97)}>{self.links('share', r.randint(2, 4))}</div>"

    def article(self) -> str:
        r = self.r
        m = lambda: "‖" + self.marked(self.prose())
        out = []
        title = "‖" + self.marked(self.sentence(2, 16))
        for k in range(r.choice([1, 2, 3, 4, 6, 8, 12, 18])):
            style = r.random()
            if style < 0.72:
                out.append(f"<p>{m()}</p>" if r.random() < 0.93 else f"<p>{m()}<br>{m()}")
            elif style < 0.78:
                out.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}>‖{self.marked(self.sentence(1, 8))}</{h}>")
            elif style < 0.84:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>‖{self.marked(self.sentence(1, 12))}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>")
            elif style < 0.88:
                out.append(f"<blockquote><p>{m()}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{m()}</blockquote>")
            elif style < 0.91:
                out.append(f"<pre>{m()}</pre>" if r.random() < 0.5 else f"<div>{m()}</div>")
            elif style < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>‖{self.marked(self.sentence(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif style < 0.96:
                out.append(f"<figure><img src=x><figcaption>‖{self.marked(self.sentence())}</figcaption></figure>")
            if k and r.random() < 0.12:
                out.append(self.box(r.choice(["ad", "ad", "side", "share", "form", "notice"])))
        head = f"<h1>{title}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        body = "".join(out)
        style = r.random()
        if style < 0.38:
            return f"<article{self.attrs('main', 0.3)}>{head}{body}</article>"
        if style < 0.5:
            return f"<main{self.attrs('main', 0.3)}>{head}{body}</main>"
        if style < 0.6:
            return f"<main><article>{head}{body}</article>{self.box('comments') if r.random() < 0.3 else ''}</main>"
        if style < 0.72:
            return f"{head}<div{self.attrs('main', 1.0)}>{body}</div>"
        if style < 0.84:
            return f"<div{self.attrs('main', 1.0)}>{head}{body}</div>"
        if style < 0.9:
            return f"<section{self.attrs('main', 0.9)}>{head}{body}</section>"
        if style < 0.94:
            return f"<table><tr><td>{head}{body}</td></tr></table>"
        return head + body

    def page(self) -> str:
        r = self.r
        before = [k for k in ("header", "nav", "notice", "ad", "form", "side", "share") if r.random() < {"nav": 0.8, "header": 0.5, "ad": 0.45}.get(k, 0.2)]
        after = [k for k in ("share", "ad", "comments", "side", "form", "notice", "footer") if r.random() < {"footer": 0.85, "comments": 0.45, "side": 0.35}.get(k, 0.2)]
        r.shuffle(before)
        parts = [self.box(k) for k in before], [self.box(k) for k in after]
        middle = self.article()
        if r.random() < 0.25 and after:
            inside = parts[1].pop(0)
            middle = f"<div{self.attrs('main', 0.4)}>{middle}{inside}</div>"
        if r.random() < 0.12 and middle.endswith("</article>"):
            middle = middle[: -len("</article>")] + self.box("comments") + "</article>"
        return (
            f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            + "\n" * r.randint(0, 1) + "".join(parts[0]) + middle + "".join(parts[1]) + "<script>x()</script></body></html>"
        )


def examples(n: int, seed: int) -> list[tuple[tuple, np.ndarray]]:
    """Features and labels of generated pages; a block is main text if it starts
    with the mark, which is taken off before the features are made."""
    out, features = [], Features()
    for k in range(n):
        found = blocks(Site(random.Random(f"{seed}:{k}")).page())
        y = np.array(["‖" in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace("‖", "") or "."
        if found:
            out.append((features.page(found), y))
    return out


def gradients(model: Labeller, pages: list[tuple], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the blocks and its gradient, by backpropagation
    through both directions."""
    x, mask = model.padded(pages)
    t, n, _ = x.shape
    y = np.zeros((t, n), np.float32)
    for j, v in enumerate(labels):
        y[: len(v), j] = v
    logit, (top, tape) = model.run(x, mask, keep=True)
    p = _sigmoid(logit)
    total = mask.sum()
    loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
    dl = (p - y) * mask / total
    g = {"V": np.tensordot(dl, top, 2), "c": np.array([dl.sum()])}
    dtop = dl[:, :, None] * model.p["V"]
    dx = dtop[:, :, 2 * HIDDEN :].copy()
    for s, d in enumerate("fb"):
        w, u = model.p[f"W{d}"], model.p[f"U{d}"]
        dout = dtop[:, :, s * HIDDEN : (s + 1) * HIDDEN]
        gz = np.zeros((t, n, 4 * HIDDEN), np.float32)
        gu = np.zeros_like(u)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for k, h, c, i, f, o, gg, tc in reversed(tape[s]):
            m = mask[k][:, None]
            dh = dh + dout[k]
            dnew = m * dc + m * dh * o * (1 - tc * tc)
            z = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), m * dh * tc * o * (1 - o), dnew * i * (1 - gg * gg)], axis=1)
            gz[k] = z
            gu += h.T @ z
            dh = z @ u.T + (1 - m) * dh
            dc = dnew * f + (1 - m) * dc
        g |= {f"W{d}": np.tensordot(x, gz, ([0, 1], [0, 1])), f"U{d}": gu, f"b{d}": gz.sum((0, 1))}
        dx += gz @ w.T
    de = np.concatenate([dx[: len(v), j] * (1 - x[: len(v), j] ** 2) for j, v in enumerate(labels)])
    g["e"] = de.sum(0)
    g["M"] = np.concatenate([q[3] for q in pages]).T @ de
    ge = np.zeros_like(model.p["E"])
    at = 0
    for q in pages:
        block = np.repeat(np.arange(len(q[2])), np.diff(np.append(q[2], len(q[0]))))
        np.add.at(ge, q[0], q[1][:, None] * de[at + block])
        at += len(q[2])
    return loss, g | {"E": ge}


def train(n: int = 9000, epochs: int = 8, batch: int = 48, seed: int = 3) -> Labeller:
    data = examples(n, seed)
    model, rng = Labeller.fresh(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step, steps = 0, epochs * -(-len(data) // batch)
    for e in range(epochs):
        total = []
        order = rng.permutation(len(data))
        order = np.concatenate(sorted(np.array_split(order, len(order) // (batch * 8) + 1), key=lambda x: x[0]))
        for a in range(0, len(order), batch):
            some = [data[k] for k in order[a : a + batch]]
            # names are dropped at times, so that structure alone must do
            pages = [(i, w * (rng.random(len(w)) > 0.12), o, f) for (i, w, o, f), _ in some]
            loss, g = gradients(model, pages, [y for _, y in some])
            total.append(loss)
            step += 1
            rate = 0.01 * (1 - step / (steps + 1))
            for k in model.p:
                gk = np.clip(g[k], -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {e}: loss {np.mean(total):.4f}", file=sys.stderr, flush=True)
    return model


def accuracy(model: Labeller, data: list[tuple[tuple, np.ndarray]]) -> tuple[float, float]:
    """Share of blocks, and of whole pages, that are labelled right."""
    right = [(p >= 0.5) == (y > 0.5) for p, (_, y) in zip(model.label([x for x, _ in data]), data, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    made = train()
    made.save()
    print("held out: blocks %.4f, pages %.4f" % accuracy(Labeller.load(), examples(800, 99)))
