"""Train the block labeller on made-up pages: ``python -m tidemark.llm.html_train``.

Pages are put together at random from templates (article containers, menus,
headers, footers, sidebars, notices, adverts, forms, comments, with and
without telling class names) and random words, so that the network learns
structure and not a vocabulary.  Main fragments carry a mark from which the
labels are read after parsing.  Everything is seeded.
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

from tidemark.llm.html_text import HIDDEN, INPUT, PATH_DIM, PATH_ROWS, WORD_DIM, WORD_ROWS, Block, Features, Labeller, blocks_of, reversal, sigmoid

MARK = ""
SYLLABLES = "th he an in er on re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la que ción ment sch ein ung é ê ñ ü ß".split()
PLATE = {
    "nav": "home about contact news products services blog login archive next previous more".split(),
    "footer": "copyright all rights reserved privacy policy terms imprint contact sitemap 2024 ©".split(),
    "notice": "we use cookies accept consent privacy settings subscribe newsletter sign up free trial".split(),
    "ad": "sponsored advertisement buy now offer sale discount promoted click here".split(),
    "form": "name email password submit search send login register your message".split(),
    "comments": "reply says comment posted like report ago thanks great commented".split(),
    "share": "share tweet print email facebook tags filed under related posts".split(),
}
KINDS = {
    "nav": ["<nav>{}</nav>", "<div class='menu'>{}</div>", "<ul class='nav'>{}</ul>", "<div id='navigation'>{}</div>", "<div role='navigation'>{}</div>", "<ol class='breadcrumb'>{}</ol>", "<menu>{}</menu>", "<div class='topbar'>{}</div>", "<div class='pagination'>{}</div>"],
    "header": ["<header>{}</header>", "<div id='header'>{}</div>", "<div class='site-header'>{}</div>", "<div class='masthead'>{}</div>", "<div class='banner'>{}</div>"],
    "footer": ["<footer>{}</footer>", "<div id='footer'>{}</div>", "<div class='site-footer'>{}</div>", "<div class='copyright'>{}</div>", "<div class='legal'>{}</div>"],
    "aside": ["<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div id='sidebar'>{}</div>", "<section class='related'>{}</section>", "<div class='widget'>{}</div>", "<div class='recommended'>{}</div>", "<aside class='sidebar'>{}</aside>"],
    "notice": ["<div class='cookie-notice'>{}</div>", "<div id='consent'>{}</div>", "<div class='notice'>{}</div>", "<div class='alert'>{}</div>", "<div class='newsletter'>{}</div>", "<dialog>{}</dialog>", "<div class='popup'>{}</div>", "<div class='banner cookie'>{}</div>", "<div class='subscribe'>{}</div>"],
    "ad": ["<div class='ad'>{}</div>", "<div class='ads'>{}</div>", "<div class='advert'>{}</div>", "<div class='sponsored'>{}</div>", "<div class='promo'>{}</div>", "<div id='ad-top'>{}</div>", "<section class='advertisement'>{}</section>", "<aside class='ad'>{}</aside>"],
    "form": ["<form>{}</form>", "<form class='search'>{}</form>", "<div class='search'>{}</div>", "<form id='login'><fieldset>{}</fieldset></form>"],
    "comments": ["<section id='comments'>{}</section>", "<div class='comments'>{}</div>", "<ol class='comment-list'>{}</ol>", "<div id='disqus'>{}</div>", "<section class='comments'>{}</section>", "<div class='reader-comments'>{}</div>", "<div class='responses'>{}</div>"],
    "share": ["<div class='share'>{}</div>", "<div class='social'>{}</div>", "<ul class='tags'>{}</ul>", "<div class='byline meta'>{}</div>"],
}
MAINS = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<div id='content'>{}</div>", "<div class='post'>{}</div>", "<div class='entry-content'>{}</div>", "<div class='article-body'>{}</div>", "<div id='main'><div class='story'>{}</div></div>", "<section class='article'>{}</section>", "<div>{}</div>", "<div class='text'>{}</div>", "<div id='main'>{}</div>", "<article class='post'><div class='body'>{}</div></article>", "<td>{}</td>"]


class Writer:
    """Random pages."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int = 2, high: int = 14) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        return words[0].capitalize() + "".join(self.r.choice([" ", " ", " ", ", "]) + w for w in words[1:]) + self.r.choice(".....!?")

    def prose(self, most: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def junk(self) -> str:
        """Text that is no prose: separators, symbols, capitals, one word again."""
        words = [self.word() for _ in range(self.r.randint(2, 40))]
        kind = self.r.randrange(4)
        return [" | ".join(words), " ".join(w + self.r.choice(["###", "$$$", "&amp;&amp;&amp;", "***", "%%%"]) for w in words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * len(words))][kind]

    def links(self, kind: str) -> str:
        words = PLATE.get(kind, [])
        item = lambda: self.r.choice(words) if words and self.r.random() < 0.5 else " ".join(self.word() for _ in range(self.r.randint(1, 4)))
        form = self.r.choice(["<li><a href='/x'>{}</a></li>", "<li>{}</li>", "<a href='/x'>{}</a> ", "<p><a href='/x'>{}</a></p>", "<div>{}</div>", "<li><a href='#'>{}</a>"])
        inside = "".join(form.format(item()) for _ in range(self.r.randint(1, 9)))
        return f"<ul>{inside}</ul>" if "<li>" in form and self.r.random() < 0.8 else inside

    def plate(self, kind: str) -> str:
        r = self.r
        words = PLATE.get(kind, [])
        if kind in ("nav", "header", "aside", "share") and r.random() < 0.7:
            inside = self.links(kind)
            if kind in ("header", "aside") and r.random() < 0.5:
                inside = f"<h{r.randint(1, 4)}>{self.sentence(1, 6)[:-1]}</h3>" + inside
        elif kind == "comments":
            one = r.choice(["<li><b>{}</b><p>{}</p></li>", "<div class='comment'><p>{}</p><p>{}</p></div>", "<p>{}: {}</p>", "<article class='comment'><h4>{}</h4><p>{}</p></article>"])
            inside = r.choice(["<h3>Comments</h3>", "<h2>" + self.sentence(1, 3) + "</h2>", ""]) + "".join(one.format(r.choice([self.word(), r.choice(words)]), self.prose(3)) for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inside = "".join(f"<label>{r.choice([self.word(), r.choice(words)])}</label><input name='q'>" for _ in range(r.randint(1, 4))) + f"<button>{r.choice(words)}</button>" + r.choice(["", "<select><option>" + self.word() + "<option>" + self.word() + "</select>"])
        else:
            text = r.choice([self.prose(2), " ".join(r.choice([self.word(), r.choice(words or ["x"])]) for _ in range(r.randint(1, 12)))])
            if kind == "footer":
                text = r.choice(["&copy; ", "© 2024 ", ""]) + self.word() + r.choice([".example.com &middot; ", " "]) + text
            inside = r.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<div><p>{}</p></div>"]).format(text)
        form = r.choice(KINDS[kind])
        # no telling name, where links, words or fields give the block away
        if r.random() < 0.3 and (kind in ("nav", "form", "share", "footer") or (kind in ("aside", "header") and "<a " in inside)):
            form = "<div" + self.blank_name() + ">{}</div>"
        return form.format(inside)

    def blank_name(self) -> str:
        """A class that says nothing: none, a random word, a grid or generated one."""
        r = self.r
        name = r.choice([self.word(), f"col-{r.choice(['md', 'sm', 'lg', 'xs'])}-{r.randint(1, 12)}", f"x{r.randint(1, 9)}", f"css-{r.randrange(16**6):06x}", "row", "inner", "block", "box", "wrap", "left", "right", "column"])
        return r.choice(["", f" class='{name}'", f" class='{name}'", f" id='{name}'"])

    def table(self) -> str:
        """Facts in rows."""
        cell = self.r.choice(["<td>{}</td>", "<td><p>{}</p></td>"])
        row = lambda: "<tr><th>" + MARK + self.word().capitalize() + "</th>" + cell.format(MARK + self.sentence(1, 4)[:-1]) + "</tr>"
        return "<table>" + "".join(row() for _ in range(self.r.randint(2, 6))) + "</table>"

    def bare(self) -> str:
        """A page of text with few tags or none."""
        r = self.r
        parts = [MARK + self.prose(r.choice([1, 3, 8])) for _ in range(r.randint(1, 5))]
        return r.choice(["{}", "<body>{}", "<html><body>{}</body></html>", "<pre>{}</pre>"]).format(r.choice(["\n", "<br><br>", "<p>", "\n\n"]).join(parts))

    def main(self) -> str:
        r, out = self.r, []
        style = self.junk if r.random() < 0.12 else lambda: self.prose(r.choice([1, 3, 8]))
        if r.random() < 0.8:
            title = f"<h1>{MARK}{self.sentence(2, 10)[:-1]}</h1>"
            out.append(r.choice([title, title, title, f"<header>{title}</header>"]))
        for _ in range(r.choice([1, 2, 4, 8, 12, 25])):
            kind = r.random()
            if kind < 0.7:
                out.append(f"<p>{MARK}{style()}</p>")
            elif kind < 0.78:
                out.append(f"<p><b>{MARK}{style()}<br>")
            elif kind < 0.83:
                out.append(f"<h{r.randint(2, 4)}>{MARK}{self.sentence(1, 6)[:-1]}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.sentence(1, 9)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{MARK}{self.prose(2)}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<p>{MARK}{self.word().capitalize()}.</p>")
            elif kind < 0.97:
                out.append(f"<p>{MARK}{self.prose(1)} <a href='/x'>{self.word()} {self.word()}</a> {self.sentence()}</p>")
            else:
                out.append(f"<pre>{MARK}{self.prose(1)}</pre>" if r.random() < 0.5 else f"<div>{MARK}{self.prose(3)}</div>")
            if r.random() < 0.03:
                out.append(self.table())
            if r.random() < 0.05:
                out.append(self.plate(r.choice(["ad", "share", "aside", "notice", "form"])))
        form = r.choice(MAINS)
        if r.random() < 0.25:
            form = r.choice(["<div{}>", "<div><div{}>", "<section{}>"]).format(self.blank_name())
            form += "{}" + "".join(f"</{t}>" for t in (["section"] if "section" in form else ["div"] * form.count("<div")))
        return form.format("".join(out))

    def page(self) -> str:
        r = self.r
        if r.random() < 0.05:
            return self.bare()
        before = [self.plate(k) for k in ("nav", "header", "notice", "ad", "form", "aside", "nav") if r.random() < 0.4]
        after = [self.plate(k) for k in ("share", "comments", "aside", "ad", "form", "notice", "nav") if r.random() < 0.3]
        r.shuffle(before)
        if r.random() < 0.8:
            after.append(self.plate("footer"))
        core = self.main()
        if r.random() < 0.08:
            core = ""  # a page without an article
        if r.random() < 0.2:  # columns side by side
            sides = [f"<div{self.blank_name()}>{self.plate('aside') if r.random() < 0.5 else '<h4>' + self.sentence(1, 4)[:-1] + '</h4>' + self.links('nav')}</div>"]
            columns = [f"<div{self.blank_name()}>{core}</div>", *sides]
            r.shuffle(columns)
            core = f"<div{self.blank_name()}>{''.join(columns)}</div>"
        body = "".join(before) + core + "".join(after)
        if r.random() < 0.2:
            body = f"<div class='{r.choice(['container', 'wrapper', 'page'])}'>{body}</div>"
        if r.random() < 0.1:
            body = f"<table><tr>{body}</tr></table>"
        head = r.choice(["<meta charset='utf-8'>", "", "<link rel='stylesheet' href='s.css'>"]) + r.choice(["", "<style>a{color:red}</style>", "<script>f('<b>')</script>"])
        text = f"<!DOCTYPE html><html lang='en'><head>{head}<title>{self.sentence()}</title></head><body>{body}"
        return text + ("" if r.random() < 0.1 else "</body></html>")


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    found = blocks_of(page)
    y = np.array([MARK in b.text for b in found], np.float32)
    for b in found:
        b.text = " ".join(b.text.replace(MARK, "").split()) or "x"
    return found, y


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    dense = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"path": np.zeros((PATH_ROWS, PATH_DIM), np.float32), "word": np.zeros((WORD_ROWS, WORD_DIM), np.float32)}
    for d in "fb":
        w |= {f"w{d}": dense(INPUT, 4 * HIDDEN), f"u{d}": dense(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
    return w | {"v": dense(2 * HIDDEN, 1), "d": np.zeros(1, np.float32)}


def _run(x, mask, w, u, b):
    """Padded forward pass, keeping what the backward pass needs."""
    n, steps, _ = x.shape
    h, c, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), []
    out = np.zeros((n, steps, HIDDEN), np.float32)
    for t in range(steps):
        g = x[:, t] @ w + h @ u + b
        s, z = sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        c2 = f * c + i * z
        tc = np.tanh(c2)
        h2 = o * tc
        m = mask[:, t, None]
        kept.append((h, c, i, f, o, z, tc, m))
        h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
        out[:, t] = h * m
    return out, kept


def _back(x, kept, dout, w, u):
    n, steps, _ = x.shape
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32), np.zeros_like(x)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, z, tc, m = kept[t]
        dh_t = dh + dout[:, t] * m
        a, d = dh_t * m, dc * m
        d = d + a * o * (1 - tc * tc)
        g = np.concatenate([d * z * i * (1 - i), d * c * f * (1 - f), a * tc * o * (1 - o), d * i * (1 - z * z)], axis=1)
        dw += x[:, t].T @ g
        du += h.T @ g
        db += g.sum(0)
        dx[:, t] = g @ w.T
        dh = g @ u.T + dh_t * (1 - m)
        dc = d * f + dc * (1 - m)
    return dw, du, db, dx


def train(n_pages: int = 8000, epochs: int = 6, batch: int = 48, rate: float = 4e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the mean cross entropy of blocks."""
    writer = Writer(seed)
    data = [p for p in (labelled(writer.page()) for _ in range(n_pages)) if len(p[0])]
    w = initial()
    state = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in w.items()}
    rng, step = np.random.default_rng(seed), 0
    data.sort(key=lambda p: len(p[0]))
    batches = [data[i : i + batch] for i in range(0, len(data), batch)]
    for epoch in range(epochs):
        loss, right, total = 0.0, 0, 0
        for k in rng.permutation(len(batches)):
            part = batches[k]
            f = Features([p[0] for p in part])
            y = np.concatenate([p[1] for p in part])
            flat = Labeller(w).inputs(f)
            n, steps = len(part), int(f.lengths.max())
            row = np.repeat(np.arange(n), f.lengths)
            col = np.arange(len(y)) - np.repeat(np.cumsum(f.lengths) - f.lengths, f.lengths)
            turn = reversal(f.lengths)
            mask = np.zeros((n, steps), np.float32)
            mask[row, col] = 1
            xf = np.zeros((n, steps, INPUT), np.float32)
            xb = np.zeros_like(xf)
            xf[row, col], xb[row, col] = flat, flat[turn]
            of, kf = _run(xf, mask, w["wf"], w["uf"], w["bf"])
            ob, kb = _run(xb, mask, w["wb"], w["ub"], w["bb"])
            both = np.concatenate([of[row, col], ob[row, col][turn]], axis=1)
            p = sigmoid(both @ w["v"] + w["d"])[:, 0]
            loss -= float((y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).sum())
            right, total = right + int(((p >= 0.5) == (y > 0.5)).sum()), total + len(y)
            dz = ((p - y) / len(y))[:, None].astype(np.float32)
            g = {"v": both.T @ dz, "d": dz.sum(0)}
            dboth = dz @ w["v"].T
            df, dbk = np.zeros_like(of), np.zeros_like(ob)
            df[row, col], dbk[row, col] = dboth[:, :HIDDEN], dboth[turn, HIDDEN:]
            g["wf"], g["uf"], g["bf"], dxf = _back(xf, kf, df, w["wf"], w["uf"])
            g["wb"], g["ub"], g["bb"], dxb = _back(xb, kb, dbk, w["wb"], w["ub"])
            dx = dxf[row, col] + dxb[row, col][turn]
            g["path"], g["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
            np.add.at(g["path"], f.path, np.repeat(dx[:, :PATH_DIM] / f.path_len[:, None], f.path_len, 0))
            np.add.at(g["word"], f.word, np.repeat(dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / f.word_len[:, None], f.word_len, 0))
            step += 1
            for k2, a in w.items():
                m, v = state[k2]
                m += 0.1 * (g[k2] - m)
                v += 0.001 * (g[k2] * g[k2] - v)
                a -= rate * (1 - epoch / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / total:.4f}, accuracy {right / total:.4f}", file=sys.stderr, flush=True)
    return w


def accuracy(weights: dict[str, np.ndarray], n_pages: int = 500, seed: int = 99) -> float:
    """Share of blocks labelled right on pages of another seed."""
    writer = Writer(seed)
    data = [p for p in (labelled(writer.page()) for _ in range(n_pages)) if len(p[0])]
    y = np.concatenate([p[1] for p in data]) > 0.5
    return float(((Labeller(weights).scores(Features([p[0] for p in data])) >= 0.5) == y).mean())


if __name__ == "__main__":
    made = train()
    print("held-out accuracy", accuracy(made))
    np.savez_compressed(Path(__file__).with_name("html_weights.npz"), **{k: a.astype(np.float16).astype(np.float32) for k, a in made.items()})
