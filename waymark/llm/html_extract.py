"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks. Each block is a vector: the mean embedding of its hashed tag-path tokens
(tags, class, id and role words of all ancestors), the mean embedding of its hashed words, and a few measures. A
bidirectional LSTM in numpy reads the sequence both ways, so every block is classified with the whole page as context.

The labeller is trained here, on pages that `PageMaker` writes with known main text: semantic and plain markup, class
vocabularies, omitted end tags, and every kind of boilerplate in and around the article. Training has a fixed seed and
takes seconds; a process trains once.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks

SLOTS, PATH_DIM, WORD_DIM, HIDDEN = 4096, 16, 8, 24
MEASURES = 7


@lru_cache(maxsize=200_000)
def _slot(token: str) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) % SLOTS


class _WordSlots(dict):
    """The slot of every word met of late."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = crc32(f"w:{word.strip('.,:;!?()\"\'')}".encode("utf-8", "surrogatepass")) % SLOTS
        return found


_word_slots = _WordSlots()


def _summed(slot: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The rows of each of n slots, summed."""
    return np.stack([np.bincount(slot, rows[:, k], minlength=n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


class Features:
    """Vectors of the blocks of pages, flat. Elements are nodes of trees, so blocks share the paths above them."""

    def __init__(self, pages: list[list[Block]]):
        self.sizes = np.array([len(p) for p in pages], np.int64)
        token, token_node, parent, depth, count = [], [], [], [], []
        node_of, leaf, word, word_n, measures = [], [], [], [], []
        for page in pages:
            total, number = max(1, len(page)), {}
            for k, b in enumerate(page):
                fresh, node = [], b.node
                while node is not None and id(node) not in number:
                    fresh.append(node)
                    node = node.parent
                for node in reversed(fresh):
                    up = -1 if node.parent is None else number[id(node.parent)]
                    number[id(node)] = len(parent)
                    token += [_slot("p:" + t) for t in node.tokens]
                    token_node += [len(parent)] * len(node.tokens)
                    depth.append(0 if up < 0 else depth[up] + 1)
                    count.append(len(node.tokens) + (0 if up < 0 else count[up]))
                    parent.append(up)
                node_of.append(-1 if b.node is None else number[id(b.node)])
                leaf.append(_slot("p:none" if b.node is None else f"p:leaf {b.node.tokens[-1]}"))
                words = b.text.lower().split()
                word += map(_word_slots.__getitem__, words)
                word_n.append(len(words))
                n = len(b.text)
                measures.append((np.log1p(n) / 6, np.log1p(len(words)) / 5, min(1.0, b.linked / n), float(b.text[-1] in ".!?:\"'"), k / total, float("©" in b.text), float(n < 25)))
        self.token, self.token_node, self.parent, self.node_of, self.leaf, self.word, self.word_n = (np.array(x, np.int64) for x in (token, token_node, parent, node_of, leaf, word, word_n))
        by = np.argsort(np.array(depth, np.int64), kind="stable")
        self.levels = np.split(by, np.flatnonzero(np.diff(np.array(depth, np.int64)[by])) + 1) if len(by) else []
        self.path_n = (np.append(np.array(count, np.int64), 0)[self.node_of] + 1).astype(np.float32)
        self.measures = np.array(measures, np.float32).reshape(len(node_of), MEASURES)

    def path_means(self, table: np.ndarray) -> np.ndarray:
        """Mean embedding of the tokens of each block's path and its leaf: sums run down the trees level by level."""
        total = np.zeros((len(self.parent) + 1, table.shape[1]), np.float32)  # the last row stands for no element
        if len(self.token):
            total[:-1] = np.add.reduceat(table[self.token], np.searchsorted(self.token_node, np.arange(len(self.parent))), axis=0)
        for own in self.levels[1:]:
            total[own] += total[self.parent[own]]
        return (total[self.node_of] + table[self.leaf]) / self.path_n[:, None]

    def path_gradient(self, d: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Of the embeddings, from that of path_means; the same trees upwards."""
        d = d / self.path_n[:, None]
        nodes = len(self.parent) + 1
        total = _summed(self.node_of % nodes, d, nodes)
        for own in reversed(self.levels[1:]):
            np.add.at(total, self.parent[own], total[own])
        return _summed(self.token, total[self.token_node], shape[0]) + _summed(self.leaf, d, shape[0])

    def word_means(self, table: np.ndarray) -> np.ndarray:
        if not len(self.word_n):
            return np.zeros((0, table.shape[1]), np.float32)
        return np.add.reduceat(table[self.word], np.cumsum(self.word_n) - self.word_n, axis=0) / self.word_n[:, None].astype(np.float32)

    def word_gradient(self, d: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        return _summed(self.word, np.repeat(d / self.word_n[:, None], self.word_n, axis=0), shape[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs and a logistic output; parameters are float32 arrays by name."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        wide = PATH_DIM + WORD_DIM + MEASURES
        self.p = {
            "path": rng.normal(0, 0.3, (SLOTS, PATH_DIM)), "word": rng.normal(0, 0.05, (SLOTS, WORD_DIM)), "out": rng.normal(0, 0.2, (2 * HIDDEN + wide,)), "bias": np.zeros(1),
            **{f"{d}{k}": v for d in "fb" for k, v in (("w", rng.normal(0, 0.2, (wide + HIDDEN, 4 * HIDDEN))), ("b", np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)))},
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([f.path_means(self.p["path"]), f.word_means(self.p["word"]), f.measures], axis=1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; x: (time, page, input)."""
        w, b = self.p[d + "w"], self.p[d + "b"]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
        ahead = x @ w[: x.shape[2]] + b
        for t in steps:
            g = ahead[t] + h @ w[x.shape[2] :]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def _back(self, d: str, x: np.ndarray, dout: np.ndarray, kept: list, grad: dict) -> np.ndarray:
        w = self.p[d + "w"]
        wide = x.shape[2]
        dx = np.zeros_like(x)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        gw, gb = np.zeros_like(w), np.zeros_like(self.p[d + "b"])
        for t, h0, c0, i, f, o, u, tc, m in reversed(kept):
            dh = dh + dout[t]
            do, dnew = m * dh * tc, m * dc + m * dh * o * (1 - tc**2)
            dg = np.concatenate([dnew * u * i * (1 - i), dnew * c0 * f * (1 - f), do * o * (1 - o), dnew * i * (1 - u**2)], axis=1)
            gw[:wide] += x[t].T @ dg
            gw[wide:] += h0.T @ dg
            gb += dg.sum(axis=0)
            dx[t] = dg @ w[:wide].T
            dc = dnew * f + (1 - m) * dc
            dh = dg @ w[wide:].T + (1 - m) * dh
        grad[d + "w"], grad[d + "b"] = gw, gb
        return dx

    @staticmethod
    def _pad(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0, np.int64)
        page = np.repeat(np.arange(len(sizes)), sizes)
        mask = np.zeros((int(sizes.max()), len(sizes)), np.float32)
        mask[t, page] = 1
        return t, page, mask

    def logits(self, f: Features) -> np.ndarray:
        """Of every block: above 0 it is main text."""
        out = np.zeros(int(f.sizes.sum()), np.float32)
        x = self.inputs(f)
        start = np.cumsum(f.sizes) - f.sizes
        order = np.argsort(f.sizes, kind="stable")
        order = order[f.sizes[order] > 0]
        at = 0
        while at < len(order):  # pages of like length together, in groups of bounded size
            end = at + 1
            while end < len(order) and (end - at + 1) * f.sizes[order[end]] <= 16_384:
                end += 1
            own = order[at:end]
            t, page, mask = self._pad(f.sizes[own])
            place = start[own][page] + t
            grid = np.zeros((*mask.shape, x.shape[1]), np.float32)
            grid[t, page] = x[place]
            h = np.concatenate([self._run("f", grid, mask)[t, page], self._run("b", grid, mask)[t, page], x[place]], axis=1)
            out[place] = h @ self.p["out"] + self.p["bias"]
            at = end
        return out

    def train(self, pages: list[list[Block]], labels: list[list[bool]], epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        groups = np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch))
        ready = [(Features([pages[i] for i in own]), np.array([v for i in own for v in labels[i]], np.float32)) for own in groups]
        for epoch in range(epochs):
            for k in rng.permutation(len(ready)):
                f, y = ready[k]
                x = self.inputs(f)
                t, page, mask = self._pad(f.sizes)
                grid = np.zeros((*mask.shape, x.shape[1]), np.float32)
                grid[t, page] = x
                kept: dict[str, list] = {"f": [], "b": []}
                h = np.concatenate([self._run(d, grid, mask, kept[d])[t, page] for d in "fb"] + [x], axis=1)
                err = (_sigmoid(h @ self.p["out"] + self.p["bias"]) - y) / len(y)
                grad = {"out": h.T @ err, "bias": err.sum(keepdims=True)}
                dh = err[:, None] * self.p["out"][None, :]
                dx = dh[:, 2 * HIDDEN :].copy()
                for k, d in enumerate("fb"):
                    dout = np.zeros((*mask.shape, HIDDEN), np.float32)
                    dout[t, page] = dh[:, k * HIDDEN : (k + 1) * HIDDEN]
                    dx += self._back(d, grid, dout, kept[d], grad)[t, page]
                grad["path"] = f.path_gradient(dx[:, :PATH_DIM], self.p["path"].shape)
                grad["word"] = f.word_gradient(dx[:, PATH_DIM : PATH_DIM + WORD_DIM], self.p["word"].shape)
                step += 1
                now = rate * (1 - epoch / epochs * 0.7)
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class PageMaker:
    """Writes training pages: html and the set of its main blocks."""

    #: Words of class names and ids for each part of a page (fixed values).
    MAIN = "article post entry content story main body text article-body post-content entry-content story-body main-content page-content".split()
    CHROME = {
        "menu": "nav menu navbar navigation topnav main-nav site-nav breadcrumb breadcrumbs menu-list".split(),
        "header": "header site-header masthead top topbar banner page-header logo branding".split(),
        "footer": "footer site-footer bottom copyright page-footer foot colophon legal".split(),
        "sidebar": "sidebar side aside widget related related-posts recommended more-stories trending popular tags rail".split(),
        "notice": "cookie cookie-notice consent gdpr notice cookie-banner privacy-notice alert popup modal overlay toast".split(),
        "ad": "ad ads advert advertisement ad-slot banner-ad sponsored sponsor promo promotion adbox commercial".split(),
        "form": "form login signup newsletter subscribe search search-form contact newsletter-signup register".split(),
        "comments": "comments comment comment-list discussion replies reader-comments disqus comment-body responses feedback reply".split(),
        "share": "share social sharing share-buttons social-links follow author-bio byline-links".split(),
    }
    TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside"],
            "ad": ["div", "aside", "section", "p"], "form": ["form", "div"], "comments": ["section", "div", "ol", "aside"], "share": ["div", "ul", "section"]}
    #: Words that boilerplate says (fixed values).
    SAYS = {
        "menu": "Home About Contact News Products Blog Archive Inicio Startseite Accueil".split(), "header": "Welcome Login Search Subscribe".split(),
        "footer": "© Copyright rights reserved Privacy Terms Imprint Impressum Contact".split(), "sidebar": "Related Popular More Trending Recent Read".split(),
        "notice": "cookies Accept privacy policy consent cookie settings".split(), "ad": "Advertisement Sponsored Buy Sale offer Anzeige Publicité".split(),
        "form": "Email Name Submit Subscribe Password Register newsletter".split(), "comments": "Reply Comment Posted Report comment wrote Like".split(), "share": "Share Tweet Follow Facebook Like".split(),
    }

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.part = ["".join(self.r.choice("aeiouäéíöü" if k % 2 else "bcdfghlmnrstvwz") for k in range(self.r.randint(1, 4))) for _ in range(300)]

    def words(self, n: int) -> str:
        out = ["".join(self.r.choice(self.part) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        odd = self.r.random()
        if odd < 0.05:
            out = [w for w in out for _ in range(self.r.randint(1, 12))]
        elif odd < 0.1:
            out = [w.upper() + "!!" for w in out]
        if self.r.random() < 0.1:
            out = [w + self.r.choice(["&amp;&amp;", "***", "###", "%%", "$$", " |"]) for w in out]
        text, since = [], 0
        for w in out:
            since += 1
            if since > self.r.randint(4, 16):
                w, since = w + self.r.choice([".", ".", ",", "!", "?"]), 0
            text.append(w)
        return " ".join(text).capitalize() + self.r.choice([".", ".", ".", "", "!", ":"])

    def attribute(self, names: list[str], chance: float) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names)
        extra = self.r.choice(["", "", " clearfix", " wrapper", " col-md-8", f" {self.r.choice(names)}", " container"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}{extra}"'

    def chrome(self, kind: str) -> str:
        r, tag = self.r, self.r.choice(self.TAGS[kind])
        says = lambda: " ".join(r.sample(self.SAYS[kind], min(len(self.SAYS[kind]), r.randint(1, 4))))
        plain = tag in ("div", "section", "p", "ul", "ol")
        start = f"<{tag}{self.attribute(self.CHROME[kind], 1.0 if plain else 0.5)}>"
        text = lambda lo, hi: self.words(r.randint(lo, hi)) if r.random() < 0.7 else f"{says()} {self.words(r.randint(lo, hi))}"
        h = r.choice(["h1", "h2", "h3", "h3", "h4"])
        if kind in ("menu", "share") or kind in ("sidebar", "footer", "header") and r.random() < 0.4:
            items = "".join(f'<li><a href="/{k}">{self.words(r.randint(1, 3)) if r.random() < 0.7 else says()}</a>' + "</li>" * (r.random() < 0.8) for k in range(r.randint(2, 9)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f"<label>{text(1, 4)}</label><input type=text><p>{text(2, 12)}</p>" + r.choice(["", f"<button>{says()}</button>"])
        elif kind == "comments":
            item = "li" if tag == "ol" else r.choice(["div", "p", "li"])
            inner = "".join(f"<{item}{self.attribute(['comment', 'reply', 'comment-body'], 0.4)}>" + r.choice(["", f"<b>{says()}</b> "]) + f"{text(3, 60)}</{item}>" for _ in range(r.randint(1, 6)))
            inner = r.choice(["", f"<{h}>{says()}</{h}>", f"<{h}>{text(1, 4)}</{h}>"]) + inner
        elif tag == "p":
            inner = text(3, 40)
        else:
            inner = r.choice([text(2, 40), f"<p>{text(3, 60)}</p>", f"<{h}>{text(1, 5)}</{h}>", f"<{h}>{says()}</{h}><p>{text(3, 30)}</p>", f"<p>{text(3, 30)}</p><p>{text(3, 30)}</p>"])
        return f"{start}{inner}</{tag}>"

    def page(self) -> tuple[str, set[str]]:
        r = self.r
        main: list[str] = []
        inner: list[str] = []
        title = self.words(r.randint(2, 10))
        if r.random() < 0.85:
            inner.append(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<div class=title>{}</div>"]).format(title))
            main.append(title)
        scale, lone = r.choice([12, 40, 80, 120]), r.choice([0.05, 0.15, 0.3, 0.6])
        for k in range(r.choice([1, 2, 4, 8, 14, 25])):
            text = title if k == 0 and r.random() < 0.3 else self.words(r.randint(1, 3) if r.random() < lone else r.randint(3, scale))
            form = r.choice(["<p>{}</p>"] * 8 + ["<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"])
            inner.append(form.format(text if r.random() < 0.8 else text.replace(" ", ' <a href="#">', 1) + "</a>"))
            main.append(text)
            if r.random() < 0.06:
                inner.append(self.chrome(r.choice(["ad", "form", "notice", "share", "sidebar"])))
        if r.random() < 0.15:
            inner.append(self.chrome(r.choice(["comments", "share", "sidebar"])))
        style = r.random()
        tag = "article" if style < 0.65 else r.choice(["main", "div", "section", "div"])
        body = f"<{tag}{self.attribute(self.MAIN, 0.35 if tag in ('article', 'main') else 0.95)}>{''.join(inner)}</{tag}>"
        if r.random() < 0.35:  # boilerplate beside the article, in one element with it
            own = ["comments", "sidebar", "share", "ad", "form", "notice"]
            outer = r.choice(["main", "main", "div", "section"])
            first, then = ("".join(self.chrome(k) for k in r.sample(own, r.randint(lo, 2))) for lo in (0, 1))
            body = f"<{outer}{self.attribute(['wrapper', 'container', 'content', 'page', 'layout', 'main'], 0.5)}>{first if r.random() < 0.5 else ''}{body}{then}</{outer}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<{r.choice(['div', 'div', 'section', 'main'])}{self.attribute(['wrapper', 'container', 'row', 'page', 'content', 'layout', 'site'], 0.6)}>{body}</div>"
        kinds = list(self.CHROME)
        before = "".join(self.chrome(k) for k in r.sample(["menu", "header", "notice", "ad", "form", "sidebar", "share"], r.randint(0, 4)))
        after = "".join(self.chrome(k) for k in r.sample(kinds, r.randint(0, 5)))
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>" if r.random() < 0.9 else ""
        html = head + r.choice(["", "<!-- ad -->", "<script>var a='<p>';</script>"]) + before + body + after + ("</body></html>" if r.random() < 0.8 else "")
        return html, {t for m in main for t in (b.text for b in blocks(f"<p>{m}</p>"))}


def training_pages(n: int, seed: int) -> tuple[list[list[Block]], list[list[bool]]]:
    maker = PageMaker(seed)
    pages, labels = [], []
    while len(pages) < n:
        html, main = maker.page()
        own = blocks(html)
        if own:
            pages.append(own)
            labels.append([b.text in main for b in own])
    return pages, labels


@lru_cache(maxsize=2)
def trained(pages: int = 3000, seed: int = 11) -> Labeller:
    model = Labeller()
    model.train(*training_pages(pages, seed))
    return model


def extract_main_text(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", batch_pages: int = 256) -> DataFrame:
    """For each row of pages: id_col, url_col, text (its main blocks joined by line ends), n_chars, n_blocks, n_main.

    A null or empty html, or one without main blocks, has the text "". Repeated rows get equal rows; other columns are
    never read; an empty table gives none. The model (under 1 MB) goes to every worker.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_pages):
                b = whole.slice(at, batch_pages)
                found = [blocks(h or "") for h in b.column(2).to_pylist()]
                f = Features(found)
                good = (shared.value.logits(f) > 0) if len(f.measures) else np.zeros(0, bool)
                end = np.cumsum(f.sizes)
                texts = ["\n".join(x.text for x, g in zip(own, good[e - len(own) : e].tolist(), strict=True) if g) for own, e in zip(found, end.tolist(), strict=True)]
                kept = np.diff(np.r_[0, np.r_[0, np.cumsum(good)][end]])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(f.sizes), pa.array(kept.astype(np.int64))], ["id", "url", "text", "n_chars", "n_blocks", "n_main"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long, n_blocks long, n_main long").withColumnsRenamed({"id": id_col, "url": url_col})
