"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks, decoded by Viterbi.

A page becomes a sequence of leaf blocks (runs of text that no block tag
interrupts).  A block's features are its tag, its ancestors' tags and the words
of their class and id, and properties of its text.  The chain is trained on
labelled pages that a seeded generator writes (see ``labelled_pages``).

Defined cases: null or empty html gives the empty text; text in head, scripts,
styles, comments and controls is never a block; a tag that the page's end cuts
off is dropped, as are unmatched end tags; character references are decoded as
HTML5 has it; a > inside quotes doesn't end a tag, but behind a tag whose quotes
never close it does; repeated rows are extracted each; null ids and urls stay.
A page takes time in proportion to its length; about a million characters of
pages are held at a time, or one page.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rosterlake.llm import crf
from rosterlake.llm.common import groups_of

_MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_MAY_HIDE = re.compile(r"hidden|display", re.IGNORECASE)
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.IGNORECASE)

# Names of HTML elements.
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head button select option svg datalist".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

Block = tuple[tuple[str, ...], str]


def _hides(attrs: str) -> bool:
    """Whether the attributes hidden, style or aria-hidden, by their own names and values, hide an element."""
    if not _MAY_HIDE.search(attrs):
        return False
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), entities.unescape("".join(values))
        if name == "hidden" or (name == "style" and _NO_DISPLAY.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
    return False


def _text_features(text: str, linked: int) -> tuple[str, ...]:
    words = text.count(" ") + 1
    share = linked / len(text)
    return (
        f"words:{min(words.bit_length(), 7)}",
        "links:all" if share > 0.8 else "links:some" if share > 0.2 else "links:none",
        "ends:stop" if text[-1] in ".!?\"'»”" else "ends:open",
        "has:mark" if "©" in text[:40] or "(c)" in text[:40].lower() else "has:no_mark",
    )


def markup(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of comments and declarations (no name) and tags, in page order; a name that starts raw text takes it along.

    A tag that the page's end cuts off ends the walk, as (start, -1, ...).
    """
    at, end, quotes = 0, len(page), True
    while m := _MARKUP.search(page, at):
        comment, cdata, other, slash, name = m.groups()
        if not name:
            mark = "-->" if comment else "]]>" if cdata else ">"
            stop = page.find(mark, m.end())
            at = end if stop < 0 else stop + len(mark)
            yield m.start(), at, False, "", ""
            continue
        found = _ATTRS.match(page, m.end()) if quotes else None
        if found:
            at = found.end()
        else:
            quotes = False
            at = page.find(">", m.end()) + 1
            if not at:
                yield m.start(), -1, False, "", ""
                return
        attrs, name = page[m.end() : at - 1], name.lower()
        if name in RAW and not slash:
            stop = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
            close = page.find(">", stop.start()) if stop else -1
            at = end if close < 0 else close + 1
        yield m.start(), at, bool(slash), name, attrs


class _Open:
    """The open elements: tag, features, dropped, inside a link; and how often each tag is open."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...], bool, bool]] = [("", (), False, False)]
        self.count: Counter[str] = Counter()

    def push(self, *element) -> None:
        self.stack.append(element)
        self.count[element[0]] += 1

    def close(self, names: tuple[str, ...], stops) -> None:
        """Close the innermost element of ``names`` and all inside it, unless an element of ``stops`` is nearer."""
        if not any(self.count[n] for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in names:
                self.count.subtract(e[0] for e in self.stack[k:])
                del self.stack[k:]
                return
            if tag in stops:
                return

    def block(self) -> str:
        return next((e[0] for e in reversed(self.stack) if e[0] in BLOCK), "")


def leaf_blocks(page: str | None) -> list[Block]:
    """(features, text) of each leaf block in page order."""
    page = page or ""
    out: list[Block] = []
    opened = _Open()
    pieces: list[str] = []
    owner, owner_block, owner_is_set, linked, at = opened.stack[0], "", False, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(((f"tag:{owner_block}", *owner[1], *_text_features(text, linked)), text))
            pieces.clear()
            linked = 0

    for start, stop, closing, name, attrs in chain(markup(page), [(len(page), -1, False, "", "")]):
        if start > at and not opened.stack[-1][2]:
            raw, top = page[at:start], opened.stack[-1]
            if not pieces or not owner_is_set:  # the first text that isn't white space says where the block is
                owner, owner_block, owner_is_set = top, opened.block(), not raw.isspace()
            pieces.append(entities.unescape(raw) if "&" in raw else raw)
            if top[3]:
                linked += len(pieces[-1].strip())
        if stop < 0:
            break
        at = stop
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name == "br" and pieces:
            pieces.append(" ")
        if closing:
            opened.close((name,), () if name in BLOCK else BLOCK)
            continue
        if name in RAW or name in VOID:
            continue
        if name not in IN_HEAD:  # content ends an open head
            opened.close(("head",), ())
        if name in BLOCK:  # a block ends an open paragraph
            opened.close(("p",), BLOCK - {"p"})
        if name in SAME_ENDS:
            opened.close(SAME_ENDS[name], HOLDS[name])
        _, features, dropped, link = opened.stack[-1]
        if attrs and not attrs.isspace():
            named = {w for g in _NAMED.findall(attrs) for w in re.split(r"[^a-z0-9]+", "".join(g).lower()) if w}
            features = (*features, *(f for w in sorted(named) if (f := f"name:{w}") not in features))
            dropped = dropped or _hides(attrs)
        if name in BLOCK and f"in:{name}" not in features:
            features = (*features, f"in:{name}")
        if not attrs.endswith("/") or name in BLOCK:
            opened.push(name, features, dropped or name in DROPPED, link or name == "a")
    flush()
    return out


# ---------------------------------------------------------------------------------------------------------------------
# Labelled pages

# Names that sites give to the parts of a page.
MAIN_NAMES = "content article post entry story main body text".split()
REST_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager skip".split(),
    "header": "header masthead top branding logo site".split(),
    "footer": "footer bottom copyright legal colophon imprint".split(),
    "aside": "sidebar aside widget related recommended popular trending rail secondary".split(),
    "ad": "ad ads advert advertisement adverts banner promo sponsored sponsor promotion".split(),
    "notice": "notice cookie cookies consent gdpr alert modal popup overlay toast banner".split(),
    "form": "form login search subscribe newsletter signup contact".split(),
    "comments": "comments comment replies reply discussion disqus respond reader".split(),
    "share": "share social sharing follow tags meta byline author".split(),
}


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(html, a label for each leaf block: 1 = main text) of ``n`` generated pages."""
    rnd = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rnd.choice("aeioubdfglmnprst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(low, high)))

    def sentence(low: int = 4, high: int = 40) -> str:
        return words(low, high).capitalize() + rnd.choice(["."] * 6 + ["", "!"])

    def page() -> tuple[str, list[int]]:
        labels: list[int] = []

        def block(tag: str, label: int, text: str) -> str:
            labels.append(label)
            if rnd.random() < 0.1:
                text = f"<b>{text}</b>"
            return f"<{tag}>{text}" + ("" if tag in ("p", "li") and rnd.random() < 0.3 else f"</{tag}>")

        def links(k: int) -> str:
            return "<ul>" + "".join(block("li", 0, f'<a href="/x">{words(1, 3)}</a>') for _ in range(k)) + "</ul>"

        def rest(kind: str) -> str:
            name = rnd.choice(REST_NAMES[kind])
            attr = rnd.choice([f'class="{name}"', f'id="{name}"', f'class="{name}-{rnd.choice(["box", "area", "wrap", "1"])}"', f"class={name}"])
            own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
            tag = own if own and rnd.random() < 0.7 else rnd.choice(["div", "div", "section"])
            head = f"<{tag} {attr}>" if tag != own or rnd.random() < 0.5 else f"<{tag}>"
            if kind == "nav" or rnd.random() < 0.2:
                inner = links(rnd.randint(1, 7))
            elif rnd.random() < 0.3:
                labels.append(0)
                inner = rnd.choice(["", "&copy; "] if kind == "footer" else [""]) + sentence()
            else:
                inner = "".join(block(rnd.choice(["p", "p", "div", "h3"]), 0, sentence()) for _ in range(rnd.randint(1, 3)))
            return f"{head}{inner}</{tag}>"

        def main() -> str:
            tag = rnd.choice(["article", "article", "main", "div"])
            head = f'<{tag} class="{rnd.choice(MAIN_NAMES)}">' if tag == "div" or rnd.random() < 0.4 else f"<{tag}>"
            parts = [block("h1", 1, sentence(2, 14))]
            if rnd.random() < 0.1:
                parts[0] = f"<header>{parts[0]}</header>"
            for _ in range(rnd.randint(1, 8)):
                parts.append(block(rnd.choice(["p"] * 6 + ["h2", "blockquote", "li", "pre", "div"]), 1, sentence(1, 60)))
                if rnd.random() < 0.12:
                    parts.append(rest(rnd.choice(["ad", "share", "aside", "form", "notice"])))
            if rnd.random() < 0.2:
                parts.append(rest("comments"))
            return head + "".join(parts) + f"</{tag}>"

        before = [rest(k) for k in ("notice", "header", "nav", "ad", "form") if rnd.random() < 0.5]
        middle = main()
        after = [rest(k) for k in ("comments", "aside", "ad", "share", "form", "footer") if rnd.random() < 0.5]
        return f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>", labels

    return [page() for _ in range(n)]


class Extractor:
    """The trained chain."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def blocks(self, page: str | None) -> list[tuple[str, int]]:
        found = leaf_blocks(page)
        if not found:
            return []
        get = self.weights.get
        bias = get("bias", 0.0)
        emit = np.array([bias + sum(get(f, 0.0) for f in dict.fromkeys(features)) for features, _ in found])
        return list(zip((t for _, t in found), crf.viterbi(emit, self.trans), strict=True))

    def text(self, page: str | None) -> str:
        return " ".join(t for t, label in self.blocks(page) if label)


def train(pages: list[tuple[str, list[int]]] | None = None) -> Extractor:
    """Fit the chain on labelled pages, by default on generated ones."""
    parsed = [([f for f, _ in leaf_blocks(html)], labels) for html, labels in (pages or labelled_pages())]
    if any(len(a) != len(b) for a, b in parsed):
        raise ValueError("a page's labels don't match its leaf blocks")
    names = {"bias": 0}
    for blocks, _ in parsed:
        for features in blocks:
            for f in features:
                names.setdefault(f, len(names))
    wide = max(len(b) for b, _ in parsed)
    labels, mask = np.zeros((len(parsed), wide), int), np.zeros((len(parsed), wide), bool)
    columns, rows = [], []
    for r, (blocks, truth) in enumerate(parsed):
        labels[r, : len(truth)], mask[r, : len(truth)] = truth, True
        for c, features in enumerate(blocks):
            own = [0, *(names[f] for f in dict.fromkeys(features))]
            columns += own
            rows += [r * wide + c] * len(own)
    fitted = crf.fit(np.array(columns), np.array(rows), len(names), labels, mask, rounds=80, rate=0.1)
    return Extractor({f: float(fitted.weights[i]) for f, i in names.items()}, fitted.trans)


def extract(pages: DataFrame, model: Extractor | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of ``pages``."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, pages in ((b, at, t) for b in batches for at, t in groups_of(b.column("html").to_pylist(), 1 << 20)):
            texts = [model.text(h) for h in pages]
            batch = batch.slice(start, len(pages))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
