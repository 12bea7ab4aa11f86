"""Main text of HTML pages by a recurrent block labeller.

A page becomes its leaf blocks in order: runs of text between block-level tags, with the path of open tags (names,
classes, ids) above them. A numpy bidirectional LSTM reads the sequence of blocks; each is a vector of its hashed tag
path, what kinds of elements and names the path holds, its hashed words and a few counts, and each gets a probability of
being main text from all blocks of the page.

The labeller is trained here, on a bounded sample of pages by hash of page_id. A page with an article or main element
trains with the labels that its structure gives. From the texts of every sampled page, further pages are composed: its
main text in containers of many kinds, with menus, headers, footers, sidebars, notices, adverts, forms and comments in
varied elements, classes and places, so that the net meets every kind whatever the table holds. Names mislead on some of
them: main text in classes made of a boilerplate word and another word, menus and notices in made-up classes or none, or
in cells of a table. While training, parts of the tag paths are hidden at random, so that neighbours and words count as
well. Script, style and other raw-text
elements, comments and tags are never blocks. Nor is the text of drawings, media, lists of options and buttons: these end
with their end tag, that of an element around them, or their own tag if it is self-closed. Text of formulas is kept.

Pages are read in one forward pass whose time grows with their length, however they are formed. A quote opens a value
only behind an equals sign; a tag that never ends as quoted ends at the next ">", and so do all after it.

Defined results: null or blank html and pages without main text give an empty text; a page's text is its main blocks
joined by a newline, each with character references decoded and white space runs as one space; pages of any length are
read whole, long ones in windows that hand on the net's state; repeated rows give equal texts; an empty table gives no rows; without a training page every block outside the
boilerplate elements is kept; columns but page_id, url and html, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices, span_hashes, word_spans

# Names of HTML elements, by kind, and words that name parts of a page in classes and ids.
RAW = "script style noscript iframe textarea title"
UNSEEN = "template svg object canvas audio video select option button annotation annotation-xml"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img math semantics mrow mi mn mo ms mtext mspace mstyle mpadded mphantom mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd"
SIDE = "nav header footer aside form menu dialog"
SIDE_WORDS = "ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead topbar footer colophon comment comments reply replies respond cookie cookies gdpr notice notices consent alert popup modal related recommended trending share sharing social widget newsletter subscribe subscription signup login search form pagination pager disclaimer copyright"
MAIN_WORDS = "article content entry post story body main text page"
#: Beside a boilerplate word these keep its sense; with any other word it makes a name of its own.
HOLDERS = "area bar block body box container holder inner left links list page panel right section site slot top widget wrap wrapper"

RAW_SET, UNSEEN_SET, VOID_SET, INLINE_SET, SIDE_SET, SIDE_WORD_SET, MAIN_WORD_SET, HOLDER_SET = (frozenset(x.split()) for x in (RAW, UNSEEN, VOID, INLINE, SIDE, SIDE_WORDS, MAIN_WORDS, HOLDERS))
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_SET}
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")

#: What a path holds, as bits of a block's kind.
SIDE_ELEMENT, SIDE_WORD, ARTICLE, MAIN_WORD, INNER_HEADER, HEADING, PARAGRAPH, ITEM, CELL = (1 << i for i in range(9))
#: How a boilerplate word stands in a name: as all of it, as a part, as a part beside a word that keeps its sense.
WHOLE, PART, HELD = (1 << i for i in range(9, 12))
READ = (SIDE_ELEMENT, ARTICLE, MAIN_WORD, INNER_HEADER, HEADING, PARAGRAPH, ITEM, CELL, WHOLE, PART, HELD)  # by the net
KINDS = len(READ)
OF_NAME = {"p": PARAGRAPH, "li": ITEM, "dd": ITEM, "dt": ITEM, "td": CELL, "th": CELL} | {f"h{i}": HEADING for i in range(1, 7)}
PATH_DIM, WORD_DIM, COUNTS, HIDDEN = 512, 24, 6, 24
DIM = PATH_DIM + KINDS + WORD_DIM + COUNTS
WINDOW = 4096  # blocks of a page that the net reads at once

#: (hashed path as a bit set, kind, text, characters of it inside links)
Block = tuple[int, int, str, int]


def tag_end(page: str, at: int, quoted: bool, last: dict[str, int]) -> tuple[int, bool]:
    """Where the tag whose name ends at `at` has its ">", and whether quotes still count."""
    start = at
    while quoted:
        m = STOP.search(page, at)
        if not m:
            quoted = False
        elif m[0] == ">":
            return m.start(), True
        elif page[start : m.start()].rstrip()[-1:] == "=" if m.start() - start < 64 else page[m.start() - 64 : m.start()].rstrip()[-1:] == "=":
            if m.end() > last[m[0]]:
                quoted = False
            else:
                at = page.index(m[0], m.end()) + 1
        else:
            at = m.end()
    return page.find(">", start), False


def words_of(name: str, attributes: str) -> tuple[list[str], list[str]]:
    """The words in the class, id and role of a tag, and how the net reads them: ".word" for a whole name, "-word" for a
    part of one. Those of body and of negated or stated classes don't count."""
    out: list[str] = []
    read: list[str] = []
    if not attributes or name in ("html", "body"):
        return out, read
    for found in NAMED.findall(attributes):
        for token in "".join(found).split():
            parts = [w.lower() for w in PARTS.split(token) if w]
            if parts and parts[0] not in ("has", "no", "with", "is") and (name not in ("article", "main") or len(parts) == 1):
                out += parts
                read += ["." + parts[0]] if len(parts) == 1 else ["-" + w for w in parts]
    return out, read


def names_of(read: list[str]) -> int:
    """WHOLE, PART and HELD as the words of a tag's names, given as words_of() reads them, have it."""
    side = [w for w in read if w[1:] in SIDE_WORD_SET]
    parts = [w for w in side if w[0] == "-"]
    held = len(parts) > 1 or any(w[0] == "-" and w[1:] in HOLDER_SET for w in read)
    return WHOLE * (len(parts) < len(side)) | PART * bool(parts) | HELD * (bool(parts) and held)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with visible text, in order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, int, int]] = []  # name, hashed path and kind down to here
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, at, size, quoted = 0, 0, len(page), True
    last = {c: page.rfind(c) for c in ">\"'"}
    unseen = -1  # place in the stack of the outermost element without visible text
    path, kind = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((path, kind, text, linked))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal path, kind, linked
        if not parts:
            _, path, kind = stack[-1] if stack else ("", 0, 0)
        parts.append(text)
        if opened.get("a"):
            linked += len(text)

    def close(i: int) -> None:
        for name, _, _ in stack[i:]:
            opened[name] -= 1
        del stack[i:]

    while at < size:
        lt = page.find("<", at)
        while lt >= 0 and not (page[lt + 1 : lt + 2] in ("!", "?") or NAME.match(page, lt + 1) or (page[lt + 1 : lt + 2] == "/" and NAME.match(page, lt + 2))):
            lt = page.find("<", lt + 1)  # a sign in the text
        if unseen < 0 and at < (lt if lt >= 0 else size):
            add(page[at : lt if lt >= 0 else size])
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page[lt + 1] in "!?":
            end = page.find(">", lt) if lt < last[">"] else -1
            at = size if end < 0 else end + 1
            continue
        if lt > last[">"]:
            break  # a tag that never ends
        closing = page[lt + 1] == "/"
        m = NAME.match(page, lt + 1 + closing)
        name = m[0].lower()
        end, quoted = tag_end(page, m.end(), quoted, last)
        attributes = page[m.end() : end]
        at = end + 1
        self_closed = attributes.endswith("/")
        if name in RAW_SET and not closing:
            stop = RAW_END[name].search(page, at)
            close_at = page.find(">", stop.end()) if stop else -1
            at = size if close_at < 0 else close_at + 1
            continue
        if name == "br":
            parts.append(" ") if parts else None
            continue
        if closing:
            i = -1
            if opened.get(name):
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
            if name not in INLINE_SET and name not in UNSEEN_SET and (unseen < 0 or 0 <= i < unseen):
                flush()
            if i >= 0:
                close(i)
                unseen = -1 if i <= unseen else unseen
            continue
        _, path_now, kind_now = stack[-1] if stack else ("", 0, 0)
        if unseen >= 0 or name in UNSEEN_SET:
            if name not in VOID_SET and not self_closed:
                unseen = len(stack) if unseen < 0 else unseen
                stack.append((name, path_now, kind_now))
                opened[name] = opened.get(name, 0) + 1
            continue
        if name not in INLINE_SET:
            flush()
        if name in VOID_SET or self_closed:
            continue
        if name not in INLINE_SET:  # a new paragraph or item ends an open one
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (stack[i][0] == name and name in ("li", "dt", "dd", "td", "th", "tr")):
                    close(i)
                    break
                if stack[i][0] not in INLINE_SET:
                    break
            _, path_now, kind_now = stack[-1] if stack else ("", 0, 0)
            kind_now = kind_now & ~(HEADING | PARAGRAPH | ITEM | CELL) | OF_NAME.get(name, 0)
        words, read = words_of(name, attributes)
        path_now |= 1 << bucket(name, PATH_DIM)
        for w in read:
            path_now |= 1 << bucket(w, PATH_DIM)
        if name in ("article", "main"):
            kind_now |= ARTICLE
        elif name == "header" and kind_now & ARTICLE:
            kind_now |= INNER_HEADER
        elif name in SIDE_SET:
            kind_now |= SIDE_ELEMENT
        if not SIDE_WORD_SET.isdisjoint(words):
            kind_now |= SIDE_WORD | names_of(read)
        if not MAIN_WORD_SET.isdisjoint(words):
            kind_now |= MAIN_WORD
        stack.append((name, path_now, kind_now))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def is_side(kind: int) -> bool:
    """Whether a block lies in boilerplate by its path alone; of an article's own header the heading is main text."""
    return bool(kind & (SIDE_ELEMENT | SIDE_WORD)) or (bool(kind & INNER_HEADER) and not kind & HEADING)


def structure_labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks of an article or main element outside boilerplate; None if the page has no such element."""
    if not any(kind & ARTICLE for _, kind, _, _ in page):
        return None
    return np.array([int(bool(kind & ARTICLE) and not is_side(kind)) for _, kind, _, _ in page])


# How the composed pages write each kind of part; {} stands for its blocks.
MAIN_PARTS = ("<article>{}</article>", "<main>{}</main>", '<main><div class="page">{}</div></main>', '<div class="content">{}</div>', '<div class="post">{}</div>', '<div id="story">{}</div>', '<section class="entry-content">{}</section>', '<div id="main"><div class="article-body">{}</div></div>', "<div>{}</div>", "{}", '<article><div class="text">{}</div></article>')
SIDE_PARTS = {
    "menu": ("<nav>{}</nav>", '<ul class="menu">{}</ul>', '<div class="navbar">{}</div>', '<div id="nav">{}</div>', '<div class="breadcrumbs">{}</div>', '<nav class="main-nav"><ul>{}</ul></nav>', "<menu>{}</menu>"),
    "header": ("<header>{}</header>", '<div id="header">{}</div>', '<div class="site-header">{}</div>', '<div class="masthead">{}</div>', '<header class="top"><div>{}</div></header>'),
    "footer": ("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="site-footer">{}</div>', '<div class="copyright">{}</div>', '<footer><div class="links">{}</div></footer>'),
    "sidebar": ("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="widget">{}</div>', '<section class="related">{}</section>', '<div class="trending-posts">{}</div>', '<aside class="right"><div>{}</div></aside>'),
    "notice": ('<div class="cookie-notice">{}</div>', '<div id="gdpr">{}</div>', "<dialog>{}</dialog>", '<div class="alert">{}</div>', '<div role="alert" class="consent">{}</div>', '<div class="popup">{}</div>'),
    "advert": ('<div class="ad">{}</div>', '<div class="advert">{}</div>', '<section class="sponsored">{}</section>', '<div class="promo-box">{}</div>', '<div id="banner">{}</div>', '<div class="ads"><div>{}</div></div>'),
    "form": ("<form>{}</form>", '<form class="search"><div>{}</div></form>', '<div class="newsletter">{}</div>', '<div class="login">{}</div>', '<form action="/s">{}</form>'),
    "comments": ('<section id="comments">{}</section>', '<div class="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div class="replies">{}</div>', '<div id="respond">{}</div>', '<section class="comments"><article class="comment">{}</article></section>'),
}
NEUTRAL = "area body box content inner item left list main page right row site text top wrap".split()
STOCK = "Home|About|Contact|Search|Log in|Subscribe|Accept all cookies|Read more|Share|Privacy policy|Terms of use|Related posts|Advertisement|Sponsored|Leave a reply|Your name|Your e-mail|Next page|Back to top|All rights reserved|We use cookies on this site.|Sign up for our newsletter|Nice post!|Thanks for this.|I do not agree.|Buy now".split("|")


def compose(rng: np.random.Generator, main: list[str], side: list[str]) -> tuple[str, list[int]]:
    """A page from main texts and others, with a label per block in order."""
    pieces: list[str] = []
    labels: list[int] = []
    misleading = rng.random() < 0.35
    side_words = SIDE_WORDS.split()

    def made_up() -> str:
        return "".join(rng.choice(list("abcdefghiklmnoprstuvw"), int(rng.integers(3, 9))))

    def misnamed() -> str:
        parts = [str(rng.choice(side_words)), made_up()]
        return "-".join(parts if rng.random() < 0.8 else parts[::-1])

    def wrapped(text: str) -> str:
        return f'<div class="{rng.choice(NEUTRAL)}">{text}</div>' if rng.random() < 0.3 else text

    def put(template: str, inner: list[str], label: int) -> None:
        pieces.append(wrapped(template.replace("{}", wrapped("".join(inner)))))
        labels.extend([label] * len(inner))

    def side_part() -> tuple[str, list[str]]:
        """A part whose name tells its kind, or one without such a name and of texts that tell it."""
        kind = str(rng.choice(list(SIDE_PARTS)))
        template = str(rng.choice(SIDE_PARTS[kind]))
        named = not misleading or rng.random() < 0.5
        if not named:
            template = str(rng.choice([f'<div class="{made_up()}">{{}}</div>', "<div>{}</div>", "<ul>{}</ul>", "<table><tr><td>{}</td></tr></table>", f'<section id="{made_up()}-{made_up()}">{{}}</section>']))
        elif rng.random() < 0.5:
            word, form = str(rng.choice(side_words)), rng.random()
            name = f"{word}-{rng.choice(HOLDERS.split())}" if form < 0.4 else f"{rng.choice(side_words)}-{word}" if form < 0.6 else f"{rng.choice(HOLDERS.split())}-{word}" if form < 0.8 else word
            element = str(rng.choice(["div", "ul", "section", "aside", "form", "nav", "header", "footer"], p=[0.65] + [0.05] * 7))
            template = f'<{element} {rng.choice(["class", "class", "id", "role"])}="{name}">{{}}</{element}>'
        links = "<ul" in template or "<ol" in template or kind == "menu" or (not named and rng.random() < 0.7)
        inner = []
        for _ in range(int(rng.integers(1, 5 if rng.random() < 0.5 else 2))):
            source = rng.random()
            text = str(rng.choice(main)) if named and source < (0.7 if kind == "comments" else 0.3) else str(rng.choice(side)) if named and side and source < 0.6 else str(rng.choice(STOCK))
            if links and rng.random() < 0.3:
                text = " ".join(str(rng.choice(main)).split()[: int(rng.integers(1, 4))]) or text
            text = html.escape(text)
            if "<ul" in template or "<ol" in template:
                inner.append(f"<li><a href='#'>{text}</a></li>")
            elif links:
                inner.append(str(rng.choice(["<p><a href='#'>{}</a></p>", "<div><a href='#'>{}</a></div>", "<li><a href='#'>{}</a></li>"])).replace("{}", text))
            else:
                inner.append(str(rng.choice(["<p>{}</p>", "<div>{}</div>", "<p><a href='#'>{}</a></p>", "<h3>{}</h3>"])).replace("{}", text))
        return template, inner

    def some_sides(most: int) -> None:
        for _ in range(int(rng.integers(0, most + 1))):
            put(*side_part(), 0)

    some_sides(4)
    container = str(rng.choice(MAIN_PARTS))
    if rng.random() < 0.4:
        word = str(rng.choice(MAIN_WORDS.split()))
        name = str(rng.choice([f"{word}-{made_up()}", f"{made_up()}-{word}", made_up(), f"{made_up()}-{made_up()}", word]))
        container = str(rng.choice([f'<div class="{name}">{{}}</div>', f'<div id="{name}">{{}}</div>', f'<section class="{name}">{{}}</section>', f'<article class="{name}">{{}}</article>']))
    opening, ending = container.split("{}")
    if rng.random() < 0.15:  # a table that lays out the page
        pieces.append("<table><tr><td>")
        put(*side_part(), 0)
        opening, ending = "</td><td>" + opening, ending + "</td></tr></table>"
    pieces.append(opening)
    if rng.random() < 0.3:
        some_sides(1)
    for i, text in enumerate(main):
        form = str(rng.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<p>{}</p>", "<header><h1>{}</h1></header>" if "<article" in opening or "<main" in opening else "<h1>{}</h1>"] if not i else ["<p>{}</p>"] * 6 + ["<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", "<p><b>{}</b></p>"]))
        if rng.random() < 0.1:
            text = " ".join(text.split()[: int(rng.integers(1, 6))]).rstrip(".,") + "."
        if misleading and rng.random() < 0.3:
            if rng.random() < 0.5:
                element = rng.choice(["div", "section"])
                form = f'<{element} class="{misnamed()}">{form}</{element}>'
            else:
                form = re.sub(r"^<(\w+)", lambda m: f'<{m[1]} class="{misnamed()}"', form)
        put(form, [html.escape(text)], 1)
        if rng.random() < 0.12:
            put(*side_part(), 0)
    if rng.random() < 0.3:
        some_sides(2)
    pieces.append(ending)
    some_sides(4)
    return "<body>" + "".join(pieces) + "</body>", labels


def bucket(token: str, dim: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % dim


def vectors(page: list[Block], first_block: int = 0, total: int = 0) -> np.ndarray:
    """One row per block: hashed tag path, kinds, hashed words of the whole text, counts; of a window of a page, from
    first_block on, if `total` gives the page's blocks."""
    n = len(page)
    x = np.zeros((n, DIM), np.float32)
    if not n:
        return x
    bits = b"".join(path.to_bytes(PATH_DIM // 8, "little") for path, _, _, _ in page)
    x[:, :PATH_DIM] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").reshape(n, PATH_DIM)
    kinds = np.array([kind for _, kind, _, _ in page])
    x[:, PATH_DIM : PATH_DIM + KINDS] = (kinds[:, None] & np.array(READ)) > 0
    texts = [text for _, _, text, _ in page]
    counts = np.zeros(n)
    for first, raw, offs in slices(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary())):
        starts, ends, rows = word_spans(raw, offs)
        m = len(offs) - 1
        owner = np.repeat(np.arange(m), np.diff(rows))
        hashed = np.bincount(owner * WORD_DIM + (span_hashes(raw, starts, ends) % np.uint64(WORD_DIM)).astype(np.int64), minlength=m * WORD_DIM)
        counts[first : first + m] = np.diff(rows)
        x[first : first + m, -COUNTS - WORD_DIM : -COUNTS] = hashed.reshape(m, WORD_DIM) / np.maximum(np.diff(rows), 1)[:, None]
    x[:, -6] = counts <= 3
    x[:, -5] = np.log1p(counts) / 5
    x[:, -4] = [min(1.0, linked / max(len(text), 1)) for _, _, text, linked in page]
    x[:, -3] = [t[-1] in ".!?;:" for t in texts]
    x[:, -2] = np.arange(first_block, first_block + n) / (total or n)
    x[:, -1] = 1
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """A bidirectional LSTM with a logistic output per step, on padded batches with a mask."""

    def __init__(self, dim: int = DIM, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.1, (dim + hidden, 4 * hidden))
            self.p["b" + d] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])
        self.p["wo"], self.p["bo"] = rng.normal(0, 0.1, 2 * hidden), np.zeros(1)
        self.p["wx"] = np.zeros(dim)  # from a step's own vector

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """The outputs of one direction and its state behind them."""
        n, steps, dim = x.shape
        k = self.hidden
        w, b = self.p["w" + d].astype(x.dtype), self.p["b" + d].astype(x.dtype)
        h, c = state or (np.zeros((n, k), x.dtype), np.zeros((n, k), x.dtype))
        out = np.zeros((n, steps, k), x.dtype)
        of_x = x @ w[:dim] + b
        for t in range(steps) if d == "f" else reversed(range(steps)):
            xh = np.concatenate([x[:, t], h], axis=1) if keep is not None else None
            z = of_x[:, t] + h @ w[dim:]
            f, i, o, g = sigmoid(z[:, :k]), sigmoid(z[:, k : 2 * k]), sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            on = mask[:, t : t + 1]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if keep is not None:
                keep.append((t, xh, f, i, o, g, c, tanh_c, on))
            c = np.where(on, new_c, c)
            h = np.where(on, o * tanh_c, h)
            out[:, t] = h
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        hs = []
        for d in "fb":
            trace = None if keep is None else keep.setdefault(d, [])
            hs.append(self._run(x, mask, d, trace)[0])
        h = np.concatenate(hs, axis=2)
        if keep is not None:
            keep["h"] = h
        return h @ self.p["wo"].astype(x.dtype) + x @ self.p["wx"].astype(x.dtype) + self.p["bo"].astype(x.dtype)

    def logits_in_windows(self, page: list[Block], window: int = WINDOW) -> np.ndarray:
        """The logits of one page of any length; only a window's vectors are held, its state goes on to the next."""
        n = len(page)
        z = np.full(n, self.p["bo"][0], np.float32)
        for at, d in enumerate("fb"):
            w, state = self.p["wo"][at * self.hidden : (at + 1) * self.hidden].astype(np.float32), None
            starts = range(0, n, window)
            for s in starts if d == "f" else reversed(starts):
                x = vectors(page[s : s + window], s, n)[None]
                h, state = self._run(x, np.ones(x.shape[:2], dtype=bool), d, None, state)
                z[s : s + window] += h[0] @ w if d == "b" else h[0] @ w + x[0] @ self.p["wx"].astype(np.float32)
        return z

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        keep: dict = {}
        p = sigmoid(self.logits(x, mask, keep))
        total = max(mask.sum(), 1)
        loss = -np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / total
        dz = (np.where(mask, p - y, 0) / total).astype(x.dtype)
        grad = {"wo": np.einsum("nt,nth->h", dz, keep["h"]), "bo": np.array([dz.sum()]), "wx": dz.ravel() @ x.reshape(-1, x.shape[2])}
        k = self.hidden
        for at, d in enumerate("fb"):
            w = self.p["w" + d].astype(x.dtype)
            gw, gb = np.zeros_like(w), np.zeros(4 * k)
            dh_next, dc_next = np.zeros((len(x), k), x.dtype), np.zeros((len(x), k), x.dtype)
            out_w = self.p["wo"][at * k : (at + 1) * k].astype(x.dtype)
            for t, xh, f, i, o, g, c, tanh_c, on in reversed(keep[d]):
                dh_all = dh_next + dz[:, t : t + 1] * out_w
                dh = np.where(on, dh_all, 0)
                dc = np.where(on, dc_next, 0) + dh * o * (1 - tanh_c**2)
                da = np.concatenate([dc * c * f * (1 - f), dc * g * i * (1 - i), dh * tanh_c * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                gw += xh.T @ da
                gb += da.sum(axis=0)
                dxh = da @ w.T
                dh_next = dxh[:, -k:] + np.where(on, 0, dh_all)
                dc_next = np.where(on, dc * f, dc_next)
            grad["w" + d], grad["b" + d] = gw, gb
        return float(loss), grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], steps: int = 1200, batch: int = 16, rate: float = 0.015, hide: float = 0.15, seed: int = 7) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, loss = 0, 0.0
        while step < steps:
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x, mask = pad([pages[i] for i in rows])
                y = pad([labels[i][:, None].astype(np.float32) for i in rows])[0][:, :, 0]
                x[:, :, :PATH_DIM] *= rng.random((len(rows), 1, PATH_DIM)) >= hide * rng.random((len(rows), 1, 1))
                x[:, :, PATH_DIM : PATH_DIM + KINDS] *= rng.random((len(rows), 1, KINDS)) >= hide * rng.random((len(rows), 1, 1))
                loss, grad = self.gradients(x, mask, y)
                step += 1
                if step > steps:
                    break
                now = rate * (1 - (step - 1) / steps)
                for name, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return loss


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), steps, rows[0].shape[1]), rows[0].dtype), np.zeros((len(rows), steps), dtype=bool)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, True
    return x, mask


def label_pages(model: dict | None, pages: list[list]) -> list[np.ndarray]:
    """For each page, which blocks are main text; pages of like length share a batch."""
    if model is None:
        return [np.array([not is_side(kind) for _, kind, _, _ in page], dtype=bool) for page in pages]
    net = BiLstm()
    net.p = model
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if 0 < len(pages[i]) <= WINDOW), key=lambda i: len(pages[i]))
    for i, page in enumerate(pages):
        if len(page) > WINDOW:
            out[i] = net.logits_in_windows(page) > 0
    at = 0
    while at < len(order):
        size = max(1, min(128, 20_000 // len(pages[order[min(at + 127, len(order) - 1)]])))
        rows = order[at : at + size]
        x, mask = pad([vectors(pages[i]) for i in rows])
        z = net.logits(x, mask)
        for i, r in zip(rows, z, strict=True):
            out[i] = r[: len(pages[i])] > 0
        at += size
    return out


def training_pages(page: str, seed: int, composed: int, max_blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of a page, if its structure labels it, and of pages composed from its texts."""
    found = blocks(page)
    y = structure_labels(found)
    rng = np.random.default_rng(seed)
    if y is not None:
        at = seed % max(1, len(y) - max_blocks + 1)
        yield vectors(found)[at : at + max_blocks], y[at : at + max_blocks]
    kept = y if y is not None else np.array([not is_side(kind) for _, kind, _, _ in found])
    main = [text for (_, _, text, _), k in zip(found, kept, strict=True) if k]
    side = [text for (_, _, text, _), k in zip(found, kept, strict=True) if not k]
    for _ in range(composed if main else 0):
        at = int(rng.integers(0, max(1, len(main) - 30)))
        made, labels = compose(rng, main[at : at + int(rng.integers(1, 31 if rng.random() < 0.5 else 6))], side)
        again = blocks(made)
        if len(again) == len(labels):
            yield vectors(again)[:max_blocks], np.array(labels[:max_blocks])


def train(pages: DataFrame, max_pages: int = 300, max_blocks: int = 400, composed: int = 5) -> dict | None:
    """Weights from a sample of pages and `composed` times max_pages more made from them, the more from each the fewer
    there are; a sampled page longer than max_blocks trains on a window of it."""
    rows = pages.where("html is not null").select(F.col("page_id").cast("long"), "html").orderBy(F.xxhash64("page_id"), "page_id", F.md5("html")).limit(max_pages)
    each = -(-max_pages * composed // max(1, rows.count()))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, page in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for i, (x, y) in enumerate(training_pages(page, zlib.crc32(f"{page_id}".encode()), each, max_blocks)):
                    out.append({"page_id": page_id, "i": i, "x": x.astype(np.float16).tobytes(), "y": y.astype(np.int8).tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("i", pa.int32()), ("x", pa.binary()), ("y", pa.binary())]))

    # At most max_pages * (1 + composed) * max_blocks vectors of 2 bytes a number.
    got = rows.mapInArrow(featurize, "page_id long, i int, x binary, y binary").collect()
    got.sort(key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["i"], r["x"]))
    xs = [np.frombuffer(r["x"], np.float16).reshape(-1, DIM).astype(np.float32) for r in got]
    ys = [np.frombuffer(r["y"], np.int8) for r in got]
    if not xs:
        return None
    net = BiLstm()
    net.fit(xs, ys)
    return net.p


def extract(pages: DataFrame, model: dict | None) -> DataFrame:
    """page_id, url and text of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [blocks(page) for page in part.column("html").to_pylist()]
                kept = label_pages(sent.value, found)
                text = ["\n".join(t for (_, _, t, _), k in zip(page, keep, strict=True) if k) for page, keep in zip(found, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
