"""HTML extraction (9): a tree-structured graphical model over DOM blocks.

Each block element is a node with a hidden label (main content or not). A node's label depends on its parent's, and its
tag, class and id words, text length and link share depend on its label. Sum-product messages go up from the leaves and
down from the root, and give each node's marginal; the text of nodes with a marginal over one half is the result.
The tables are counted from labelled pages (`labelled_pages` writes some in many layouts; others may be given).

Scripts, styles, comments and other elements that are never shown are no nodes. Inline elements belong to their block, and
so does what formulas and embedded media hold. Reading a page takes time in proportion to its length.
Defined cases: null or empty html, and pages without content, give the empty string; unclosed and stray tags are
repaired as browsers do (a block closes an open paragraph, an unknown end tag is ignored); whole pages are read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Element kinds of HTML.
RAW = {"script", "style", "title", "noscript", "template", "iframe", "svg", "textarea", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "head", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "button",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "menu"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class and id attributes that the model looks at.
CLUES = (
    "nav", "menu", "header", "head", "footer", "foot", "sidebar", "side", "aside", "widget", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "consent", "notice", "alert", "popup",
    "modal", "newsletter", "subscribe", "signup", "login", "form", "search", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment", "comments", "respond", "reply", "disqus",
    "copyright", "legal", "toolbar", "tags", "meta", "article", "content", "main", "post", "entry", "story", "body", "text", "page", "wrapper", "container", "site", "top", "bottom",
)
_CLUES = frozenset(CLUES)
#: A comment, a tag (slash, name, attributes: blanks, slashes, names, and values in quotes or up to a blank) or a
#: declaration. No part gives back what it has taken, so the time is linear.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[\s/]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^\s/>=]++)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S
)
_NAMES = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")


class Open:
    """The open blocks, with counts by name: of all, and of those inside of the innermost list or table.

    A block is looked for only if it is open, and what is passed on the way to it is closed, so each block is passed once.
    """

    def __init__(self, tag: list[str]):
        self.tag, self.stack, self.names, self.inside = tag, [0], Counter(), [Counter()]

    def top(self) -> int:
        return self.stack[-1]

    def push(self, node: int) -> None:
        name = self.tag[node]
        self.stack.append(node)
        self.names[name] += 1
        if name in SCOPE:
            self.inside.append(Counter())
        else:
            self.inside[-1][name] += 1

    def pop(self) -> str:
        name = self.tag[self.stack.pop()]
        self.names[name] -= 1
        if name in SCOPE:
            self.inside.pop()
        else:
            self.inside[-1][name] -= 1
        return name

    def close(self, name: str) -> None:
        """An end tag: closes the innermost block of that name and all in it; without one it is ignored."""
        if self.names[name]:
            while self.pop() != name:
                pass

    def make_room(self, name: str) -> None:
        """What a start tag closes: an open paragraph or heading, and list items, cells and rows before it."""
        last = self.tag[self.stack[-1]]
        if last == "p" or last in HEADINGS and name != "p":
            self.pop()
        shut = CLOSES.get(name)
        if shut and any(self.inside[-1][x] for x in shut):
            while self.pop() not in shut:
                pass


class Page:
    """Blocks in document order (a parent before its children), and runs of text with their block."""

    def __init__(self, source: str | None):
        self.parent, self.tag, self.clues = [-1], ["#root"], [()]
        self.chars, self.linked = [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack, parts, links, at, end = Open(self.tag), [], 0, 0, len(source)

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.runs.append((stack.top(), text))

        def add(text: str) -> None:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            n = len(text) - text.count(" ")
            self.chars[stack.top()] += n
            if links:
                self.linked[stack.top()] += n

        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                add(source[at:])
                break
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name in BLOCK:
                    flush()
                    links = 0
                    stack.close(name)
                elif name == "a":
                    links = max(0, links - 1)
                continue
            if name in RAW:
                found = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = found.end() if found else end
            elif name == "br" or name == "hr":
                flush()
            elif name in VOID:
                continue
            elif name in BLOCK:
                flush()
                links = 0
                stack.make_room(name)
                self.parent.append(stack.top())
                self.tag.append(name)
                words = [w for x in _NAMES.findall(m[3]) for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(x)))] if m[3] else ()
                self.clues.append(tuple({w.lower() for w in words} & _CLUES) if words else ())
                self.chars.append(0)
                self.linked.append(0)
                stack.push(len(self.tag) - 1)
            elif name == "a":
                links += 1
        flush()

    def features(self) -> list[tuple[str, ...]]:
        chars, linked = self.chars[:], self.linked[:]
        for i in range(len(chars) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        out = []
        for i, tag in enumerate(self.tag):
            n = chars[i]
            own = self.chars[i]
            length = "len" + (str(min(8, own.bit_length() - 2 if own >= 8 else 0)) if own else "-")
            link = "link-" if not n else f"link{round(3 * linked[i] / n)}"
            out.append((f"<{tag}>" + "." * bool(self.clues[i]), length, link, *[f".{c}" for c in self.clues[i]]))
        return out


class Model:
    """The tables of the graphical model: P(label | parent's label, tag) and log P(feature | content) / P(feature | other)."""

    def __init__(self, pages: list[tuple[Page, list[int]]], smooth: float = 0.5):
        step, seen, total = Counter(), (Counter(), Counter()), [0, 0]
        for page, labels in pages:
            for i, f in enumerate(page.features()):
                y = labels[i]
                total[y] += 1
                seen[y].update(f)
                if i:
                    step["", labels[page.parent[i]], y] += 1
                    step[page.tag[i], labels[page.parent[i]], y] += 1

        def rows(tag: str, back: list[list[float]]) -> list[list[float]]:
            """A tag's table leans on the table of all tags as if that had been seen a few times."""
            return [[(step[tag, q, y] + 4 * back[q][y]) / (step[tag, q, 0] + step[tag, q, 1] + 4) for y in (0, 1)] for q in (0, 1)]

        self.step = {"": rows("", [[0.5, 0.5], [0.5, 0.5]])}
        self.step |= {tag: rows(tag, self.step[""]) for tag in {t for t, _, _ in step} - {""}}
        self.weight = {f: math.log((seen[1][f] + smooth) / (total[1] + 2 * smooth)) - math.log((seen[0][f] + smooth) / (total[0] + 2 * smooth)) for f in {*seen[0], *seen[1]}}

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node, by messages up to the root and down again."""
        steps = [self.step.get(t, self.step[""]) for t in page.tag]
        n = len(page.tag)
        weight, parent = self.weight, page.parent
        own = []
        for f in page.features():
            x = sum([weight.get(k, 0.0) for k in f])
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
            own.append((1 - p, p))
        b0, b1 = [x for x, _ in own], [x for _, x in own]  # belief from the node and all below it
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            (s00, s01), (s10, s11) = steps[i]
            m0, m1 = s00 * b0[i] + s01 * b1[i], s10 * b0[i] + s11 * b1[i]
            z = m0 + m1
            up[i] = m0, m1 = m0 / z, m1 / z
            q = parent[i]
            x0, x1 = b0[q] * m0, b1[q] * m1
            z = x0 + x1
            b0[q], b1[q] = x0 / z, x1 / z
        out = [0.0] * n
        full0, full1 = [0.0] * n, [0.0] * n
        full0[0], full1[0] = b0[0] / (b0[0] + b1[0] * 1e-3), b1[0] * 1e-3 / (b0[0] + b1[0] * 1e-3)  # the root itself is no content
        for i in range(1, n):
            (s00, s01), (s10, s11) = steps[i]
            q = parent[i]
            c0, c1 = full0[q] / up[i][0], full1[q] / up[i][1]  # the parent's belief without this child
            x0, x1 = b0[i] * (c0 * s00 + c1 * s10), b1[i] * (c0 * s01 + c1 * s11)
            z = x0 + x1
            full0[i], full1[i] = x0 / z, x1 / z
            out[i] = x1 / z
        return out

    def text(self, source: str | None) -> str:
        page = Page(source)
        p = self.marginals(page)
        return "\n".join([t for i, t in page.runs if p[i] > 0.5])


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages in many layouts; with each, the words that mark its content (every run starts with a word of its own)."""
    rng = random.Random(seed)
    count = 0

    def words(least: int, most: int) -> str:
        text = " ".join("".join(rng.choices("aeiounrstldm", k=rng.randint(2, 9))) for _ in range(rng.randint(least, most)))
        return text + rng.choice([".", ".", ".", "", "!", "?"])

    def mark(kind: str) -> str:
        nonlocal count
        count += 1
        return f"{kind}{count}q"

    def links(k: int) -> str:
        items = [f'<a href="/{words(1, 1)}">{mark("x")} {words(1, 3)}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def named(tag: str, name: str) -> str:
        kind = rng.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{rng.choice(["", "site-", "page-", "main-", "block "]) + name}">'

    def junk(where: str) -> str:
        tag, names, body = {
            "nav": ("nav", ["nav", "menu", "breadcrumb"], lambda: links(rng.randint(2, 8))),
            "header": ("header", ["header", "top", "banner"], lambda: f"{mark('x')} {words(1, 6)}" + (links(rng.randint(2, 6)) if rng.random() < 0.5 else "")),
            "footer": ("footer", ["footer", "copyright", "legal"], lambda: rng.choice(["<p>", "", "&copy; "]) + f"{mark('x')} {words(2, 25)}"),
            "side": ("aside", ["sidebar", "widget", "related", "recommended"], lambda: (f"<h3>{mark('x')} {words(1, 4)}</h3>" if rng.random() < 0.6 else "") + rng.choice([links(rng.randint(2, 7)), f"<p>{mark('x')} {words(5, 40)}</p>"])),
            "ad": ("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"], lambda: rng.choice(["", "<p>"]) + f"{mark('x')} {words(2, 40)}"),
            "notice": ("div", ["cookie", "consent notice", "alert", "popup", "newsletter", "modal", "subscribe"], lambda: rng.choice(["", "<p>"]) + f"{mark('x')} {words(4, 40)} <button>{mark('x')} {words(1, 2)}</button>"),
            "form": ("form", ["form", "search", "login", "signup"], lambda: f"<p>{mark('x')} {words(1, 12)}</p><input name=q><button>{mark('x')} {words(1, 2)}</button>"),
            "share": ("div", ["share", "social", "tags", "meta", "toolbar", "pagination"], lambda: links(rng.randint(1, 5))),
            "comments": ("section", ["comments", "comment", "respond", "disqus"], lambda: f"<h3>{mark('x')} {words(1, 3)}</h3>" + "".join(rng.choice(['<div class="comment">'] * 3 + ["<div>"] * 3 + ["<article class=comment>"]) + f"<p>{mark('x')} {words(3, 60)}</p></div>" for _ in range(rng.randint(1, 5)))),
        }[where]
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        return (f"<{tag}>" if plain else named(tag if rng.random() < 0.4 else "div", rng.choice(names))) + body() + f"</{tag}>" * plain + "</div>" * (not plain)

    def content() -> str:
        out = [f"<h1>{mark('y')} {words(2, 12)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            r = rng.random()
            size = rng.choice([(1, 3), (1, 12), (8, 40), (30, 120)])
            inner = f"{mark('y')} {words(*size)}"
            if r < 0.1:
                out.append(f"<h{(k := rng.randint(2, 4))}>{mark('y')} {words(1, 8)}</h{k}>")
            elif r < 0.18:
                out.append("<ul>" + "".join(f"<li>{mark('y')} {words(1, 20)}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.23:
                out.append(f"<blockquote><p>{inner}</p></blockquote>")
            elif r < 0.27:
                out.append("<table>" + "".join(f"<tr><td>{mark('y')} {words(1, 3)}</td><td>{mark('y')} {words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.30:
                out.append(f"<pre>{inner}</pre>")
            elif r < 0.35:
                out.append(f'<p>{inner} <a href="/x">{words(1, 4)}</a> {words(1, 10)}</p>')
            elif r < 0.40:
                out.append(f"<p><b>{inner}<br>")
            elif r < 0.44:
                out.append(f"<div>{inner}</div>")
            else:
                out.append(f"<p>{inner}" + rng.choice(["</p>", "</p>", "</p>", ""]))
            if rng.random() < 0.05:
                out.append(junk(rng.choice(["ad", "share", "form", "side"])))
        return "".join(out)

    pages = []
    for _ in range(n):
        first = "".join(junk(x) for x in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.55)
        last = "".join(junk(x) for x in ("share", "comments", "side", "ad", "form", "footer") if rng.random() < 0.5)
        r = rng.random()
        body = content()
        if r < 0.4:
            body = f"<article>{body}</article>"
        elif r < 0.55:
            body = f"<main>{body}</main>"
        elif r < 0.65:
            body = f"<main><article>{body}</article></main>"
        elif r < 0.95:
            tag = rng.choice(["div", "div", "section"])
            body = named(tag, rng.choice(["content", "article", "post", "entry", "story", "main text", "body"])) + body + f"</{tag}>"
        whole = first + body + last
        if rng.random() < 0.3:
            whole = named("div", rng.choice(["wrapper", "container", "page"])) + whole + "</div>"
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{whole}</body></html>")
    return [(p, set(re.findall(r"\by\d+q\b", p))) for p in pages]


def labels_of(page: Page, marks: set[str]) -> list[int]:
    """A block is content if it holds content text and no other kind; a container of both is not."""
    good, bad = [0] * len(page.tag), [0] * len(page.tag)
    for i, text in page.runs:
        (good if any(w in marks for w in text.split()) else bad)[i] += 1
    own_bad = bad[:]
    for i in range(len(page.tag) - 1, 0, -1):
        good[page.parent[i]] += good[i]
        bad[page.parent[i]] += bad[i]
    return [int(good[i] > 0 and (bad[i] == 0 or page.tag[i] not in ("#root", "html", "body") and own_bad[i] == 0 and good[i] > 2 * bad[i])) for i in range(len(page.tag))]


def trained(pages: list[tuple[str, set[str]]] | None = None) -> Model:
    read = [(Page(p), marks) for p, marks in (labelled_pages() if pages is None else pages)]
    return Model([(p, labels_of(p, marks)) for p, marks in read])


def extracted(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    store.ship(pages.sparkSession)
    store.small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [model.text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    df = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"))
    return df.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained())
