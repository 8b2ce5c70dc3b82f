"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: the text between two block-level tags, with its ancestors. Scripts,
styles, templates, comments and markup are no blocks. A block's features are its ancestors' tags
and class or id words, how deep it is, and its text: length, punctuation, links, digits. Labels
are main text and the rest; Viterbi decoding gives the labels of all blocks of a page together.

The field is trained on labelled pages, by gradient steps on the likelihood. Labelled pages come
from a bounded sample of the table, `sample_pages` pages with the smallest hash of their id, whose
own semantic markup labels them: blocks in an `article` or `main` are main text unless furniture
surrounds them. As a sample may lack kinds of furniture, lists in articles, or pages without semantic
tags, each sampled page is learned in five copies: as it is; with furniture put around and between
its blocks, also inside the article; with short lists in its text and furniture; and the last two
with plain elements in place of `article` and `main`.

Defined cases: null and empty pages, and pages without text, give the empty string; unclosed,
crossed and cut-off tags are taken as browsers take them, roughly; repeated pages give repeated
rows; without labelled pages the field is trained on the furniture alone.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_PAGES = 300
CHAIN = 40

# As browsers read a tag: a quote opens a value only after an equals sign; else ">" ends the tag.
_VALUE = r"(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*+)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    rf"(?P<attrs>(?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*=\s*{_VALUE})?)*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "template", "iframe", "svg", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that begin and end blocks; all others, known or not, are within the text that they are in.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "col", "colgroup", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4",
    "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "noscript", "object",
    "ol", "optgroup", "option", "p", "plaintext", "pre", "search", "section", "select", "summary", "table", "tbody", "td",
    "textarea", "tfoot", "th", "thead", "title", "tr", "ul", "xmp",
}
#: Elements of formulas whose texts are told apart.
MATH = {
    "annotation", "annotation-xml", "maction", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover",
    "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup",
    "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics",
}
#: An opening tag closes an open one of these.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "aside", "nav", "form", "object"}

#: Tags and words of classes and ids that mark what is not main text; also used to label.
FURNITURE_TAGS = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select"]
FURNITURE_NAMES = [
    "ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "nav", "menu", "sidebar", "breadcrumb",
    "header", "footer", "notice", "alert", "cookie", "consent", "popup", "modal", "newsletter", "subscribe", "login",
    "comment", "comments", "reply", "replies", "disqus", "related", "share", "social", "widget", "pagination",
    "navigation", "contentinfo", "complementary", "search", "form",
]
#: Last words of names that say how something is laid out.
LAYOUT = {
    "area", "bar", "block", "box", "button", "buttons", "column", "container", "content", "group", "icons", "inner", "item",
    "items", "left", "link", "links", "list", "menu", "outer", "panel", "posts", "right", "row", "section", "widget", "wrap",
    "wrapper",
}


@dataclass
class Block:
    path: tuple[tuple[str, frozenset[str]], ...]  # of each ancestor its tag and names
    text: str
    linked: int  # characters within links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in its order."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    run: list[str] = []
    linked = links = 0

    def flush():
        nonlocal run, linked
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            found.append(Block(tuple(stack), text, linked))
        run, linked = [], 0

    def close(tag: str, scopes: set[str] = frozenset()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                flush()
                del stack[i:]
                return
            if stack[i][0] in scopes:
                return

    def take(text: str):
        nonlocal linked
        run.append(text)
        if links:
            linked += len(text)

    page = page or ""
    place = 0
    while (token := _TOKEN.search(page, place)) is not None:
        if token.start() > place:
            take(page[place:token.start()])
        place = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not token["end"] and not token["attrs"].endswith("/"):
                end = re.compile(f"</{tag}\\s*>", re.IGNORECASE).search(page, place)
                place = end.end() if end else len(page)
            run.append(" ")
            continue
        if tag not in BLOCKS:
            if tag == "a":
                links = 0 if token["end"] else 1
            elif tag in ("br", "img", "input") or tag in MATH and not token["end"]:
                run.append(" ")
            continue
        if token["end"]:
            if tag == "p" and not any(t == "p" for t, _ in stack):
                flush()
            close(tag)
            flush()
            links = 0
            continue
        flush()
        links = 0
        if tag not in ("noscript", "object"):  # these can be within a paragraph
            close("p", SCOPES)
        for other in CLOSES.get(tag, ()):
            close(other, SCOPES)
        if tag in VOID:
            continue
        names = frozenset(
            n for m in _NAMES.finditer(token["attrs"]) for n in (m[1] or m[2] or m[3] or "").lower().split()
        )
        stack.append((tag, names))
    take(page[place:])
    flush()
    return found


def kind(name: str) -> str:
    """What a class or id names: the last word before those of layout. "site-footer", "share-buttons"."""
    words = _WORD.findall(name)
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    return words[-1] if words else ""


def furnished(block: Block) -> bool:
    """Whether an ancestor says that the block is not main text."""
    return any(tag in FURNITURE_TAGS or tag in ("head", "title") or any(kind(n) in FURNITURE_NAMES for n in names)
               for tag, names in block.path)


def markup_labels(page: list[Block]) -> list[int] | None:
    """1 for main text by the page's own markup; None where it has none."""
    def inside(b: Block) -> bool:
        return any(tag in ("article", "main") for tag, _ in b.path)

    if not any(inside(b) for b in page):
        return None
    return [int(inside(b) and not furnished(b)) for b in page]


def with_furniture(page: list[Block], labels: list[int], number: int) -> tuple[list[Block], list[int]]:
    """The page with furniture before, within and after it. Each page shows other kinds."""
    kinds = [(t, frozenset()) for t in FURNITURE_TAGS] + [("div", frozenset([n])) for n in FURNITURE_NAMES]
    outer = (("html", frozenset()), ("body", frozenset()))
    texts = [b.text for b in page] or ["Read more", "Leave a reply."]
    made, marks, step = [], [], 5 * number
    article = next((b.path for b, k in zip(page, labels) if k), (*outer, ("article", frozenset())))
    article = tuple(e for e in article if e[0] not in ("p", "li"))

    def add(above):
        nonlocal step
        text = texts[step % len(texts)]
        leaf = ("li" if step % 3 == 0 else "p", frozenset())
        for _ in range(1 + step % 2):
            made.append(Block((*above, kinds[step % len(kinds)], leaf), text, len(text) if step % 3 == 0 else 0))
            marks.append(0)
        step += 1

    add(outer)
    for place, (block, label) in enumerate(zip(page, labels)):
        made.append(block)
        marks.append(label)
        if label and place % 3 == number % 3:
            add(article)
    add(article)
    add(outer)
    return made, marks


def with_lists(page: list[Block], labels: list[int], number: int) -> tuple[list[Block], list[int]]:
    """The page with short list items, some of them links, among its main text, some of which is in elements of its own."""
    made, marks = [], []
    for place, (block, label) in enumerate(zip(page, labels)):
        if label and place % 4 == number % 4:
            own = (("div", "section", "figure")[number % 3], frozenset([(), ("lead",), ("quote",), ("x17",)][place // 4 % 4]))
            block = Block((*block.path[:-1], own, *block.path[-1:]), block.text, block.linked)
        made.append(block)
        marks.append(label)
        if label and place % 3 == number % 3:
            above = tuple(e for e in block.path if e[0] not in ("p", "li", "h1", "h2", "h3"))
            words = block.text.split()[:12]
            for n in range(1 + (place + number) % 4):
                text = " ".join(words[2 * n:2 * n + 1 + (n + number) % 3]) or words[0]
                leaf = (("ol" if number % 2 else "ul", frozenset()), ("li", frozenset()))
                made.append(Block((*above, *leaf), text, len(text) if number % 4 == 0 else 0))
                marks.append(1)
    return made, marks


def without_semantics(page: list[Block], number: int) -> list[Block]:
    """The page with plain elements, some of them with a name, in place of `article` and `main`."""
    names = [(), ("content",), ("post",), ("entry-content",), ("story",), ("page", "text"), ("body-text",)]
    plain = ("div" if number % 3 else "section", frozenset(names[number % len(names)]))
    return [Block(tuple(plain if tag in ("article", "main") else (tag, own) for tag, own in b.path), b.text, b.linked) for b in page]


def training_copies(page: list[Block], labels: list[int], number: int) -> list[tuple[list[Block], list[int]]]:
    """A labelled page as it is, with furniture, with lists and furniture, and the last two without semantic tags."""
    furniture = with_furniture(page, labels, number)
    both = with_furniture(*with_lists(page, labels, number), number + 1)
    return [(page, labels), furniture, both, *((without_semantics(own, number), marks) for own, marks in (furniture, both))]


def features(page: list[Block]) -> list[list[str]]:
    rows = []
    for block in page:
        words = block.text.count(" ") + 1
        row = ["bias", f"words<{next((n for n in (3, 8, 20, 60) if words < n), 'more')}"]
        row.append("ends" if block.text[-1] in ".!?:;…\"'”’»)" else "open")
        row.append(f"links{min(3, 4 * block.linked // max(1, len(block.text)))}")
        if any(map(str.isdigit, block.text)):
            row.append("digits")
        tags = [tag for tag, _ in block.path]
        row += [f"in:{t}" for t in set(tags)]
        row += [f"at:{tags[-1]}"] if tags else ["at:none"]
        names = {n for _, own in block.path for n in own}
        row += [f"kind:{n}" for n in {kind(n) for n in names} if n]
        row += [f"name:{n}" for n in names if n != kind(n)]
        if furnished(block):
            row.append("furniture")
        rows.append(row)
    return rows


@dataclass
class Field:
    """Weights of each feature for both labels, and of each pair of neighbouring labels."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def decode(self, page: list[Block]) -> list[int]:
        """Labels of all blocks by Viterbi."""
        if not page:
            return []
        scores = [self.emit[[self.index[f] for f in row if f in self.index]].sum(axis=0) for row in features(page)]
        (aa, ab), (ba, bb) = self.step.tolist()
        a, b = scores[0].tolist()
        back = []
        for x, y in (s.tolist() for s in scores[1:]):
            from_a, from_b = (0 if a + aa >= b + ba else 1), (0 if a + ab >= b + bb else 1)
            back.append((from_a, from_b))
            a, b = max(a + aa, b + ba) + x, max(a + ab, b + bb) + y
        label = int(b > a)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, label in zip(found, self.decode(found)) if label)


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, penalty: float = 1e-5) -> Field:
    """Maximum likelihood over chains of at most `CHAIN` blocks, all chains stepped together."""
    chains = [
        (rows[i:i + CHAIN], labels[i:i + CHAIN]) for rows, labels in pages for i in range(0, len(rows), CHAIN)
    ]
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in chains for row in rows for f in row}))}
    n, length = len(chains), max(len(c[1]) for c in chains)
    size = np.array([len(c[1]) for c in chains])
    gold = np.zeros((n, length), int)
    for i, (_, labels) in enumerate(chains):
        gold[i, :len(labels)] = labels
    real = np.arange(length) < size[:, None]
    cells = [(i * length + j, index[f]) for i, (rows, _) in enumerate(chains) for j, row in enumerate(rows) for f in row]
    where, which = np.array(cells).T
    emit, step = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen = np.stack([np.bincount(which, (gold.ravel() == k)[where], len(index)) for k in (0, 1)], axis=1)
    pair = np.zeros((2, 2))
    np.add.at(pair, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    total = real.sum()
    memory = [np.zeros_like(emit), np.zeros_like(step)]
    for _ in range(rounds):
        score = np.stack([np.bincount(where, emit[which, k], n * length) for k in (0, 1)], axis=1).reshape(n, length, 2)
        ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = score[:, 0]
        for j in range(1, length):
            ahead[:, j] = np.where(
                real[:, j, None], np.logaddexp.reduce(ahead[:, j - 1, :, None] + step, axis=1) + score[:, j], ahead[:, j - 1]
            )
        for j in range(length - 2, -1, -1):
            later = np.logaddexp.reduce(step + (score[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(real[:, j + 1, None], later, 0)
        norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - norm[:, None, None]) * real[:, :, None]
        both = np.exp(
            ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - norm[:, None, None, None]
        ) * real[:, 1:, None, None]
        flat = p.reshape(-1, 2)
        expected = np.stack([np.bincount(which, flat[where, k], len(index)) for k in (0, 1)], axis=1)
        slopes = [(seen - expected) / total - penalty * emit, (pair - both.sum(axis=(0, 1))) / total - penalty * step]
        for value, slope, sums in zip((emit, step), slopes, memory):
            sums += slope**2
            value += 0.5 * slope / (np.sqrt(sums) + 1e-8)
    return Field(index, emit, step)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Field:
    """The field, from the pages of the sample that have semantic markup. At most `sample_pages`
    pages reach the driver, as features."""
    chosen = pages.filter("html is not null").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    chosen = chosen.select(F.pmod(F.xxhash64("page_id"), F.lit(10_000)).alias("number"), "html")

    def labelled(batches):
        for part in batches:
            rows = []
            for number, page in zip(part["number"].tolist(), part["html"]):
                found = blocks(page)
                labels = markup_labels(found)
                if labels is None:
                    continue
                for own, marks in training_copies(found, labels, number):
                    rows.append(([" ".join(row) for row in features(own)], marks))
            if rows:
                yield pd.DataFrame(rows, columns=["features", "labels"])

    table = chosen.mapInPandas(labelled, "features array<string>, labels array<int>").collect()
    known = sorted(([f.split(" ") for f in r["features"]], list(r["labels"])) for r in table)
    if not known:
        text = Block((("html", frozenset()), ("body", frozenset()), ("article", frozenset()), ("p", frozenset())),
                     "A sentence of the main text, long enough to be one.", 0)
        known = [(features(own), marks) for i in range(60) for own, marks in training_copies([text] * 4, [1] * 4, i)]
    return fit(known)


def main_text(page: Column, field: Field) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([field.main_text(p) for p in pages], dtype=object)

    return of(page)
