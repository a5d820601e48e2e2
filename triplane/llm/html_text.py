"""HTML extraction by a recurrent block labeller: a bidirectional LSTM in numpy.

A page is cut into blocks at block-level tags. Each block gives a vector of its tag path (names, classes and ids,
hashed), of its words (hashed) and of a few rates. The network reads a page's blocks in both directions and labels
every block main text or not, so each label depends on the whole page. It is trained on pages made from a seeded
rule, in a few seconds, once in a driver's life.
"""

from __future__ import annotations

import collections
import functools
import html
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

PATH_DIM, WORD_DIM, RATES, HIDDEN = 192, 24, 7, 16
#: Padded blocks that one pass of the network takes at once; longer pages pass by themselves.
PASS_BLOCKS = 4096
#: What no reader sees: comments, declarations, scripts, styles and templates. All else is a block for the labeller.
RAW = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>")
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
ATTR = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mspace mpadded mphantom mtable mtr mtd semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag of these closes an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())


class Block:
    """Text of a block, the letters of it in links, and the slots of its tag path."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: np.ndarray, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


@functools.lru_cache(maxsize=200_000)
def _slot(word: str, dim: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % dim


@functools.lru_cache(maxsize=20_000)
def _slots(tag: str, attrs: str) -> tuple:
    """Slots of a tag's name and of the words of its class, id and role."""
    words = [w for m in ATTR.finditer(attrs) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w]
    return tuple(_slot(name, PATH_DIM) for name in ("t:" + tag, *("c:" + w for w in words)))


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page with text, in page order; character references decoded, white space as one space.

    The path is kept as counts of its slots, so a block costs the same however deep it lies.
    """
    page = RAW.sub("", page)
    out, open_, text, linked, in_link, at = [], [], [], 0, 0, 0
    counts, of_tag, path = np.zeros(PATH_DIM, np.int32), collections.Counter(), None

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            s = html.unescape(raw)
            text.append(s)
            linked += len(s.strip()) if in_link else 0

    def close() -> None:
        nonlocal linked, path
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                if path is None:
                    path = np.flatnonzero(counts).astype(np.uint8)
                out.append(Block(path, joined, linked))
            text.clear()
        linked = 0

    def move(tag: str, slots: tuple, by: int) -> None:
        nonlocal path
        for k in slots:
            counts[k] += by
        of_tag[tag] += by
        path = None

    def leave() -> str:
        tag, slots = open_.pop()
        move(tag, slots, -1)
        return tag

    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at, tag = m.end(), m[2].lower()
        if tag not in INLINE:
            close()
        elif tag == "br":
            text.append(" ")
        if tag == "a":
            in_link = 0 if m[1] else 1
        if tag in VOID or tag in INLINE:
            continue
        if m[1]:
            while of_tag[tag] and leave() != tag:
                pass
        else:
            if tag in SELF_CLOSING and open_ and open_[-1][0] == tag:
                leave()
            open_.append((tag, _slots(tag, m[3])))
            move(*open_[-1], 1)
    add(page[at:])
    close()
    return out


def vectors(blocks: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """A row for each block of a page, or of a part of it."""
    part = blocks[lo:hi]
    x = np.zeros((len(part), PATH_DIM + WORD_DIM + RATES), np.float32)
    for i, b in enumerate(part):
        x[i, b.path] = 1
        words = b.text.lower().split()
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([_slot(w, WORD_DIM) for w in words], minlength=WORD_DIM) / len(words)
        size = len(b.text)
        x[i, PATH_DIM + WORD_DIM :] = (
            min(1.0, b.linked / size), math.log1p(size) / 8, sum(map(b.text.count, ".,;:")) / len(words) / 2, (lo + i) / len(blocks),
            min(len(blocks), 200) / 200, 1.0 if "©" in b.text else 0.0, 1.0,
        )
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Lstm:
    """One direction: weights of (input, state) to the four gates."""

    def __init__(self, dim: int, rng):
        self.w = (rng.standard_normal((dim, 4 * HIDDEN)) * 0.1).astype(np.float32)
        self.u = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False, state: tuple | None = None):
        """States (time, page, HIDDEN); past a page's end the state stays as it is. ``state``: what an earlier part ended with."""
        steps, n = mask.shape
        z = x @ self.w
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, tape = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            g = z[t] + h @ self.u
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN] + b) for k, b in ((0, 0), (1, 1), (2, 0)))
            a, m = np.tanh(g[:, 3 * HIDDEN :]), mask[t][:, None]
            c_new = f * c + i * a
            tc = np.tanh(c_new)
            if keep:
                tape.append((h, c, i, f, o, a, tc, m))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            out[t] = h
        self.ended = h, c
        return out, tape

    def back(self, x: np.ndarray, tape: list, d_out: np.ndarray):
        """Gradients of w and u."""
        gu, dg_all = np.zeros_like(self.u), np.zeros((*d_out.shape[:2], 4 * HIDDEN), np.float32)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(tape) - 1, -1, -1):
            h0, c0, i, f, o, a, tc, m = tape[t]
            dh = dh + d_out[t]
            d_o, d_cn = dh * tc * m, dh * o * (1 - tc**2) * m + dc * m
            dg = np.concatenate([d_cn * a * i * (1 - i), d_cn * c0 * f * (1 - f), d_o * o * (1 - o), d_cn * i * (1 - a**2)], 1).astype(np.float32)
            dg_all[t] = dg
            gu += h0.T @ dg
            dh, dc = dg @ self.u.T + dh * ~m, d_cn * f + dc * ~m
        return x.reshape(-1, x.shape[-1]).T @ dg_all.reshape(-1, 4 * HIDDEN), gu


class BlockLabeller:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        dim = PATH_DIM + WORD_DIM + RATES
        self.ahead, self.behind = Lstm(dim, rng), Lstm(dim, rng)
        self.v = (rng.standard_normal(2 * HIDDEN + dim) * 0.1).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    @staticmethod
    def padded(pages: list[np.ndarray]):
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
        mask = np.zeros((steps, len(pages)), bool)
        for j, p in enumerate(pages):
            x[: len(p), j], mask[: len(p), j] = p, True
        return x, mask

    def _forward(self, x, mask, keep=False):
        a, tape_a = self.ahead.run(x, mask, keep)
        b, tape_b = self.behind.run(x[::-1], mask[::-1], keep)
        both = np.concatenate([a, b[::-1], x], 2)
        return both, _sigmoid(both @ self.v + self.shift[0]), tape_a, tape_b

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page's blocks: True for those of the main text. A pass takes PASS_BLOCKS blocks, padding included."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            take = 1
            while take < len(order) and (take + 1) * len(pages[order[take]]) <= PASS_BLOCKS:
                take += 1
            part, order = order[:take], order[take:]
            if len(pages[part[0]]) > PASS_BLOCKS:
                out[part[0]] = self._long(pages[part[0]]) >= 0.5
                continue
            _, p, _, _ = self._forward(*self.padded([vectors(pages[i]) for i in part]))
            for j, i in enumerate(part):
                out[i] = p[: len(pages[i]), j] >= 0.5
        return out

    def _long(self, blocks: list[Block]) -> np.ndarray:
        """Probabilities of one long page: parts in both directions, each starting where the last one ended."""
        parts = [(lo, min(lo + PASS_BLOCKS, len(blocks))) for lo in range(0, len(blocks), PASS_BLOCKS)]
        states = np.empty((len(blocks), 2 * HIDDEN), np.float32)
        for net, order, step, cols in ((self.ahead, parts, 1, slice(0, HIDDEN)), (self.behind, parts[::-1], -1, slice(HIDDEN, None))):
            state = None
            for lo, hi in order:
                x = vectors(blocks, lo, hi)[::step, None]
                got, _ = net.run(x, np.ones(x.shape[:2], bool), state=state)
                states[lo:hi, cols], state = got[::step, 0], net.ended
        return np.concatenate([_sigmoid(np.concatenate([states[lo:hi], vectors(blocks, lo, hi)], 1) @ self.v + self.shift[0]) for lo, hi in parts])

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, batch: int = 24, rate: float = 0.01) -> BlockLabeller:
        rng = np.random.default_rng(2)
        params = [self.ahead.w, self.ahead.u, self.behind.w, self.behind.u, self.v, self.shift]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                x, mask = self.padded([pages[i] for i in pick])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(pick):
                    y[: len(labels[i]), j] = labels[i]
                both, p, tape_a, tape_b = self._forward(x, mask, True)
                d = ((p - y) * mask / mask.sum()).astype(np.float32)
                g_v, g_both = both.reshape(-1, both.shape[2]).T @ d.ravel(), d[..., None] * self.v
                ga = self.ahead.back(x, tape_a, g_both[..., :HIDDEN])
                gb = self.behind.back(x[::-1], tape_b, g_both[::-1, :, HIDDEN : 2 * HIDDEN])
                t += 1
                for k, g in enumerate((*ga, *gb, g_v, d.sum(keepdims=True).reshape(1))):
                    g = g + 2e-5 * params[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= (rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


# Pages to learn from, made by a rule. Names that pages commonly give their parts, main text and the rest.
MAIN_NAMES = "content article post entry story body main text page single blog news maintext articlebody postcontent".split()
REST_NAMES = "ad ads advert advertisement banner sponsor promo sidebar aside menu nav navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice popup modal newsletter subscribe social share related recommended comments comment reply respond login search form widget pagination tags meta copyright toolbar topbar bottom links".split()
REST_WORDS = "home about contact login register search menu more next previous share tweet subscribe newsletter cookies accept privacy policy terms reply comments comment sponsored advertisement related read copyright rights reserved".split()


def _made_page(r: random.Random) -> str:
    """A page whose blocks start with their label: "1" (main text) or "0", then the sign U+0001."""
    word = lambda: "".join(r.choice("aeiouybcdfghlmnprstv") for _ in range(r.randint(1, 10)))

    def prose(lo: int, hi: int) -> str:
        decorate = r.random()
        out = []
        for _ in range(r.randint(lo, hi)):
            w = word() + (r.choice([".", ",", "."]) if r.random() < 0.15 else "")
            w = w.upper() + "!!" if decorate < 0.08 else w + r.choice(["***", "###", "&amp;&amp;&amp;", "$$$", "%%%"]) if decorate < 0.16 else w
            out.append(w)
        return " ".join(out)

    mark = lambda label, s: f"{label}\u0001 {s}"
    name = lambda names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)}-{word()}"', f' class="{word()} {r.choice(names)}"'])
    link = lambda: f'<a href="/{word()}">{mark(0, r.choice([word(), r.choice(REST_WORDS), prose(1, 3)]))}</a>'

    def rest() -> str:
        kind = r.randrange(10)
        if kind == 9:
            return r.choice([
                f"<noscript>{mark(0, prose(2, 20))}</noscript>", f"<iframe{name(REST_NAMES)}>{mark(0, prose(1, 9))}</iframe>", f"<form><textarea>{mark(0, prose(1, 12))}</textarea></form>",
                f"<svg><title>{mark(0, prose(1, 4))}</title><text>{mark(0, prose(1, 2))}</text></svg>", f"<object{name(REST_NAMES)}>{mark(0, prose(1, 9))}</object>",
            ])
        if kind == 0:
            return f"<nav{r.choice(['', name(REST_NAMES)])}><ul>{''.join(f'<li>{link()}</li>' for _ in range(r.randint(2, 8)))}</ul></nav>"
        if kind == 1:
            return f"<{(t := r.choice(['div', 'section', 'aside', 'p', 'div']))}{name(REST_NAMES)}>{mark(0, prose(1, 25))}</{t}>"
        if kind == 2:
            return f"<aside{r.choice(['', name(REST_NAMES)])}><h3>{mark(0, prose(1, 4))}</h3><p>{mark(0, prose(3, 40))}</p></aside>"
        if kind == 3:
            return f"<form{r.choice(['', name(REST_NAMES)])}><label>{mark(0, prose(1, 3))}</label><input><button>{mark(0, r.choice(REST_WORDS))}</button></form>"
        if kind == 4:
            return f"<{(t := r.choice(['section', 'div', 'ol', 'ul']))}{name(['comments', 'comment', 'commentlist', 'replies', 'discussion', 'respond'])}>" + "".join(f"<{(u := r.choice(['div', 'p', 'li', 'article']))}{r.choice(['', name(['comment', 'reply'])])}><p>{mark(0, prose(2, 60))}</p></{u}>" for _ in range(r.randint(1, 4))) + f"</{t}>"
        if kind == 5:
            return f"<div{name(REST_NAMES)}><h4>{mark(0, prose(1, 4))}</h4><ul>{''.join(f'<li>{link()}</li>' for _ in range(r.randint(1, 6)))}</ul></div>"
        if kind == 6:
            return f"<div{name(REST_NAMES)}><p>{mark(0, prose(4, 40) + ' ' + r.choice(REST_WORDS))}</p></div>"
        if kind == 7:
            return f"<div{name(REST_NAMES)}>{link()} {link()}</div>"
        return f'<div role="{r.choice(["banner", "navigation", "complementary", "contentinfo", "dialog", "alert"])}">{mark(0, prose(1, 20))}</div>'

    def body() -> str:
        out = [f"<h1>{mark(1, prose(1, 12))}</h1>"] if r.random() < 0.75 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            if kind < 0.72:
                out.append(f"<p>{r.choice(['', '', '<b>'])}{mark(1, prose(1, r.choice([3, 30, 120])))}" + r.choice(["</p>", "</p>", "<br>", ""]))
            elif kind < 0.8:
                out.append(f"<h2>{mark(1, prose(1, 8))}</h2>")
            elif kind < 0.86:
                out.append(f"<ul>{''.join(f'<li>{mark(1, prose(1, 14))}</li>' for _ in range(r.randint(1, 5)))}</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{mark(1, prose(3, 40))}</blockquote>")
            elif kind < 0.93:
                out.append(f"<table><tr><td>{mark(1, prose(1, 6))}</td><td>{mark(1, prose(1, 6))}</td></tr></table>")
            elif kind < 0.96:
                out.append(f"<pre>{mark(1, prose(2, 20))}</pre>")
            else:
                out.append(rest())
        if r.random() < 0.08:
            return "".join(out)
        tag = r.choice(["article", "article", "main", "div", "section"])
        inner = f"<{tag}{name(MAIN_NAMES) if tag in ('div', 'section') else r.choice(['', name(MAIN_NAMES)])}>{''.join(out)}</{tag}>"
        return f"<main>{inner}</main>" if tag == "article" and r.random() < 0.3 else f"<div{name(MAIN_NAMES)}>{inner}</div>" if r.random() < 0.2 else inner

    head = f"<header{r.choice(['', name(REST_NAMES)])}>{r.choice([f'<h1>{mark(0, prose(1, 4))}</h1>', f'<div>{mark(0, prose(1, 6))}</div>', link()])}</header>" if r.random() < 0.5 else ""
    foot = f"<footer{r.choice(['', name(REST_NAMES)])}>{r.choice(['', '<p>'])}{mark(0, r.choice(['&copy; ', '', '© ']) + prose(2, 25))}</footer>" if r.random() < 0.85 else ""
    if r.random() < 0.05:
        return body()
    parts = [head, *(rest() for _ in range(r.randint(0, 3))), body(), *(rest() for _ in range(r.randint(0, 3))), foot]
    if r.random() < 0.15:
        parts = [f'<div class="{word()}">', *parts, "</div>"]
    title = f"<head><title>{mark(0, prose(1, 12))}</title></head>" if r.random() < 0.6 else ""
    return f"<html>{title}<body>{''.join(parts)}</body></html>"


@functools.lru_cache(maxsize=1)
def trained(pages: int = 1500, seed: int = 20) -> BlockLabeller:
    """The labeller, trained on ``pages`` made pages; the same for the same arguments."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        blocks = blocks_of(_made_page(r))[:400]
        ys.append(np.array(["1\u0001" in b.text for b in blocks], np.float32))
        for b in blocks:
            b.text = re.sub("[01]\u0001 ?", "", b.text) or "x"
        if blocks:
            xs.append(vectors(blocks))
        else:
            ys.pop()
    return BlockLabeller().train(xs, ys)


def extract(pages: list[str], model: BlockLabeller) -> list[str]:
    """Main text of each page: its blocks in page order, joined by a line feed."""
    blocks = [blocks_of(p) for p in pages]
    return ["\n".join(b.text for b, k in zip(bs, keep, strict=True) if k) for bs, keep in zip(blocks, model.label(blocks), strict=True)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Null and empty html give an empty text; repeated rows each get a row; other columns are ignored; an empty table
    gives an empty result. A line break tag inside a block is white space.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained())  # some 30 thousand numbers

    def setup():
        return lambda texts: (extract(texts, sent.value),)

    rows = pages.select("page_id", "url", "html")
    return per_text(rows, "html", ["page_id", "url"], setup, "text string").withColumn("n_chars", F.length("text").cast("long"))
