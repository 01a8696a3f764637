"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a list of text blocks in page order.  Every block has the kind
of region it stands in, its number of words and its link density (the share of
its words inside links), and takes over words and link density of the blocks
before and after it.  A decision tree fitted to a small labelled table decides
which blocks are main text; what stands between two kept blocks of one stretch
goes with them.  Only what is never main text by its element is
not put to it: navigation, forms, hidden elements and reader comments.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: regions; the tree sees the first three, blocks of OUT are never main text
OPEN, MAIN, SIDE, OUT = 0, 1, 2, 3

#: Page outlines written and labelled by hand.  A block is its region (O, M, S; X for OUT), its
#: words, its link density in per cent if any, and + if it is main text.
_PAGES = """
X1/100 X1/100 S9 M7+ M60+ M45+ M80+ S14
X3/100 M6+ M3+ M120+ M25/10+ S4/100 S12
X2/100 S2/100 S3/100 M9+ M30+ M1+ M1+ M2+ M40+ S1
M4+ M5+ M1+ M12+ M8+
M1+
M40+
M6+ M1+
M1+ M6+
M200+ M3+ M90/20+ M150+
M5+ M50/30+ M2+ M35/45+ M60+
M8/100+ M55+ M6/100+ M70+ M9/90+ M45+ M2/100 M2/100 M3/100
M5+ M80+ M30+ M4/100 M5/100 M6/100 M7/100 S10
M6+ M40+ M2/100 M5/100 M8/100 M12/100 M20/90 S3
M7/100 M9/100 M6/100 M8/100 M3/100
M60+ M3/100
M4+ M20+ M2/100
M3/100 M4/100 M12+ M30+
M10+ M14/20+ M22/30+ M30/80 M40/90
M30/80 M5/100 M8/100
S3/100 S2/100 O5+ O40+ O60/10+ O30+ O3/100 O4/100 S12
O2/100 O3/100 O2/100 O6+ O45+ O12+ O80+ O9+ O30+ O1/100 O1/100
O8 O3/100 O4/100 O9/100 O5/100
O1 O4 O2/100
O4
O9
O1
O14+
O25+
O30+ O3+ O1/100
O4 O9 O14+
O3 O5
O7+ O60+ O8+ O50+ O4+ O30/10+
O1+ O60+ O1+
O60+ O30/80 O40+
O20/10+ O5/50 O30+ O6/100 O30/80 O120/70
O2/100 O40+ O3/100 O50+ O2/100
O9 O3/100 O14/20+ O2/100
O3/100 O4 O4/100
O3/100 O9 O2/100
O4/100 O120+ O4/100
S4/100 S8/100 S10/100 S20 S3
S13 M1+ M2+
S22 M50+ M40+ S18 S20
S9 S22 S14 S3/100
S1 S5 S2
S16 O60+ O50+ S22 S19
S45+ S60+ S80/10+ S40+
S120+
S40+
S50+ S8 S70+ S15 S45+
M60+ S55+ M40+
M50+ S20 M60+ S12 M45+ S6/100
M6+ S70+ S45/20+ S90+ S15/60
O6+ S60+ S48+ S3/100
S40/80 S60/90 S120/70 S30/100
M30+ S45/70 M40+
S42+ S5/100 S6/100 S200+
X40 S12 S18 S60/100 X2
"""
_BLOCK = re.compile(r"([OMSX])(\d+)(?:/(\d+))?(\+?)$")


def labelled_blocks() -> list[tuple]:
    """The labelled table: region, words and link density of a block, words and
    link density of the block before and of the block after it (0 at a page's
    edge), and whether it is main text."""
    rows = []
    for line in _PAGES.split("\n"):
        cells = [_BLOCK.match(c).groups() for c in line.split()]
        x = block_features([("", "OMSX".index(r), int(w), int(w) * int(k or 0) / 100) for r, w, k, _ in cells])
        rows += [(*f, int(c[3] == "+")) for f, c in zip(x.tolist(), cells) if c[0] != "X"]
    return rows


#: elements whose content is no text
_DROPPED = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select datalist".split())
_CODE = frozenset(("script", "style"))          # these run to the page's end without an end tag
_CODE_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _CODE}
#: elements that never hold main text
_OUT_TAGS = frozenset("nav form menu dialog button fieldset".split())
#: those that some pages put around everything
_WRAPPERS = frozenset(("form", "fieldset"))
_OUT_ROLES = frozenset("navigation search form alert dialog alertdialog menu menubar".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: with these parts a name of comments says something of an article
_NO_COMMENTS = frozenset("has no open closed enabled disabled allowed count link links".split())
#: elements that seldom do
_SIDE_TAGS = frozenset("footer aside".split())
_SIDE_ROLES = frozenset("banner contentinfo complementary".split())
#: parts of class names and identifiers of such elements
_SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar toolbar cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies reply "
    "related recommended share sharing social pagination pager copyright legal disclaimer skip".split())
_MAIN_TAGS = frozenset(("article", "main"))
_MAIN_WORDS = frozenset("article story post entry content main body text".split())
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an opening tag ends these open elements
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?/]")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: a closing slash that is no part of an unquoted value
_EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$")
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class TagEnds:
    """Where tags end, quoted attribute values considered.  A tag whose quotes
    do not pair up ends at the next ``>``.  The places between values that led
    nowhere are remembered, so that all tags of a page take linear time."""

    def __init__(self, page: str):
        self.page, self.astray = page, set()

    def __call__(self, start: int) -> tuple[int, bool]:
        """(end of the tag whose attributes begin at ``start``, whether its quotes pair up)."""
        page, at, seen = self.page, start, []
        while m := _MARK.search(page, at):
            if m[0] == ">":
                return m.end(), True
            if m.start() in self.astray:
                break
            seen.append(m.start())
            end = page.find(m[0], m.end())
            if end < 0:
                break
            at = end + 1
        self.astray.update(seen)
        end = page.find(">", start)
        return (len(page) if end < 0 else end + 1), False


def _after(page: str, what: str, start: int) -> int:
    end = page.find(what, start)
    return len(page) if end < 0 else end + len(what)


def _code_end(page: str, tag: str, start: int) -> int:
    """End of a script or style: at its end tag, or the page's."""
    m = _CODE_END[tag].search(page, start)
    return _after(page, ">", m.end()) if m else len(page)


def _region(tag: str, attrs: str, outer: int, wrapped: bool = False) -> int:
    """Region inside an element that stands in region ``outer``; with
    ``wrapped`` the page stands in a form."""
    if tag in ("html", "body") or wrapped and tag in _WRAPPERS:
        return outer
    if tag in _OUT_TAGS:
        return OUT
    side = OUT if outer == OUT else SIDE
    hint = outer
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return OUT
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return OUT
            if name == "role" and value.lower() in _OUT_ROLES:
                return OUT
            if name == "role" and value.lower() in _SIDE_ROLES:
                return side
            if name in ("class", "id"):
                if tag not in _MAIN_TAGS and _holds_comments(value):
                    return OUT
                words = {w.lower() for w in _PARTS.split(value) if w}
                if tag not in _MAIN_TAGS and words & _SIDE_WORDS and not (outer == MAIN and words & {"header"}):
                    return side
                if words & _MAIN_WORDS and outer == OPEN:
                    hint = MAIN
            if name == "role" and value.lower() in ("main", "article"):
                hint = MAIN
    if tag in _MAIN_TAGS:
        # an article among reader comments is a comment; a region that was never closed doesn't matter
        return MAIN
    if tag in _SIDE_TAGS or tag == "header" and outer != MAIN:
        return side
    return hint


def _holds_comments(value: str) -> bool:
    """Whether one of the names in a class or id attribute is of reader comments."""
    parts = [{w.lower() for w in _PARTS.split(name)} for name in value.split()]
    return any(p & _COMMENTS and not p & _NO_COMMENTS for p in parts)


def _ends_of(page: str, tag: str, tag_end: TagEnds) -> dict[int, int]:
    """Where the dropped elements ``tag`` end, by the place of their opening
    tag: at the end tag that belongs to them; one without is empty."""
    ends: dict[int, int] = {}
    open_at: list[int] = []
    mark = re.compile(rf"<!--|<(/?)({tag}|script|style)(?=[\s/>])", re.I)
    at = 0
    while m := mark.search(page, at):
        if m[2] is None:
            at = _after(page, "-->", m.end())
            continue
        at, _ = tag_end(m.end())
        name = m[2].lower()
        empty = bool(_EMPTY.search(page[m.end():at - 1]))
        if name in _CODE:
            if not m[1] and not empty:
                at = _code_end(page, name, at)
        elif m[1]:
            if open_at:
                ends[open_at.pop()] = at
        elif not empty:
            open_at.append(m.start())
    return ends


def text_blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, region, words, words inside links) of a page's blocks, in order.  A
    form that holds most of a page's words is the page and no form."""
    blocks, in_forms = _blocks(page, False)
    if 2 * in_forms > sum(b[2] for b in blocks):
        blocks, _ = _blocks(page, True)
    return blocks


def _blocks(page: str, wrapped: bool) -> tuple[list[tuple[str, int, int, int]], int]:
    """The blocks, and how many of their words stand in forms."""
    blocks: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int, bool]] = []       # (tag, region inside, holds comments)
    region = OPEN
    parts: list[str] = []
    linked = 0
    in_link = 0
    comments = 0                                # open elements that hold reader comments
    is_open: Counter = Counter()                # elements on the stack, by tag
    in_forms = 0
    tag_end = TagEnds(page)

    def close():
        nonlocal linked, in_forms
        if parts:
            words = "".join(parts).split()
            if words:
                in_forms += len(words) * (is_open["form"] + is_open["fieldset"] > 0)
                blocks.append((" ".join(words), region, len(words), min(linked, len(words))))
            parts.clear()
        linked = 0

    def text(raw: str):
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw.split())

    at = 0
    dropped: dict[str, dict[int, int]] = {}     # ends by element
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at:m.start()])
        if m[2] is None:
            at = _after(page, "-->" if m[0] == "<!--" else ">", m.end())
            continue
        tag, end_tag = m[2].lower(), bool(m[1])
        at, paired = tag_end(m.end())
        attrs = page[m.end():at - 1] if paired else ""
        if tag in _DROPPED:
            if not end_tag:
                if tag not in _CODE:
                    if tag not in dropped:
                        dropped[tag] = _ends_of(page, tag, tag_end)
                    at = max(at, dropped[tag].get(m.start(), at))
                elif not _EMPTY.search(attrs):
                    at = _code_end(page, tag, at)
            continue
        if not paired:
            continue
        if tag == "a":
            in_link = 0 if end_tag else 1
            continue
        block = tag in _BLOCK_TAGS
        if block:
            close()
        if end_tag:                             # it closes what is open inside its element
            if is_open[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if not block:
                    close()
                comments -= sum(1 for _, _, c in stack[i:] if c)
                is_open.subtract(t for t, _, _ in stack[i:])
                del stack[i:]
                region = stack[-1][1] if stack else OPEN
                in_link = 0 if block else in_link
            continue
        if tag in _VOID:
            continue
        if block and stack:
            ends = _ENDS.get(tag, ())
            if stack[-1][0] == "p" or stack[-1][0] in ends:
                comments -= bool(stack[-1][2])
                is_open[stack.pop()[0]] -= 1
                region = stack[-1][1] if stack else OPEN
        inside = _region(tag, attrs, region, wrapped)
        speaks = inside == OUT and any(n.lower() in ("class", "id") and _holds_comments(v.strip("\"'")) for n, v in _ATTR.findall(attrs))
        if comments:
            inside = OUT
        if block or inside != region:
            if inside != region:
                close()
            stack.append((tag, inside, speaks))
            is_open[tag] += 1
            comments += speaks
            region = inside
    if at < len(page):
        text(page[at:])
    close()
    return blocks, in_forms


def block_features(blocks: list[tuple[str, int, int, int]]) -> np.ndarray:
    own = np.array([(r, w, k / w) for _, r, w, k in blocks], float).reshape(-1, 3)
    before = np.zeros((len(own), 2))
    after = np.zeros((len(own), 2))
    before[1:], after[:-1] = own[:-1, 1:], own[1:, 1:]
    return np.concatenate([own, before, after], axis=1)


class DecisionTree:
    """A binary classification tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, max_depth: int = 8):
        self.nodes: list[tuple] = []            # (feature, threshold, left, right) or (label,)
        self._grow(np.asarray(x, float), np.asarray(y, int), max_depth)

    def _grow(self, x, y, depth) -> int:
        at = len(self.nodes)
        self.nodes.append((int(y.mean() * 2 >= 1) if len(y) else 0,))
        if depth == 0 or len(set(y.tolist())) < 2:
            return at
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= t
                p, q = y[left].mean(), y[~left].mean()
                gini = left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q)
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, t)
        if best is None:
            return at
        _, f, t = best
        left = x[:, f] <= t
        a = self._grow(x[left], y[left], depth - 1)
        b = self._grow(x[~left], y[~left], depth - 1)
        self.nodes[at] = (f, t, a, b)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        out = np.zeros(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            rest = []
            for k in np.unique(node[live]):
                rows = live[node[live] == k]
                n = self.nodes[k]
                if len(n) == 1:
                    out[rows] = bool(n[0])
                else:
                    node[rows] = np.where(x[rows, n[0]] <= n[1], n[2], n[3])
                    rest.append(rows)
            live = np.concatenate(rest) if rest else live[:0]
        return out


def fit_tree(labelled=None) -> DecisionTree:
    t = np.array(labelled_blocks() if labelled is None else labelled, float)
    return DecisionTree(t[:, :-1], t[:, -1])


def kept(x: np.ndarray, tree: DecisionTree) -> np.ndarray:
    """Which blocks are main text, from their features."""
    return tree.predict(x) & (x[:, 0] != OUT)


def joined_up(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """A page's kept blocks with what stands between two of them in one stretch
    of an article, or of unmarked text if it is not made of links: lists of
    references, short paragraphs and headings inside a text belong to it."""
    keep = keep.copy()
    region = x[:, 0]
    edge = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]])).tolist()
    for a, b in zip(edge, edge[1:]):
        if region[a] in (OPEN, MAIN) and (inside := np.flatnonzero(keep[a:b])).size > 1:
            part = slice(a + inside[0], a + inside[-1] + 1)
            keep[part] |= (x[part, 2] < 0.5) | (region[a] == MAIN)
    return keep


def main_text(page: str, tree: DecisionTree) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    x = block_features(blocks)
    keep = joined_up(x, kept(x, tree))
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def _extract(tree: DecisionTree):
    def run(batches):
        import pyarrow as pa
        for rb in batches:
            html_col = rb.column("_html")
            texts = []
            blocks, sizes = [], []
            for page in html_col.to_pylist():
                b = text_blocks(page or "")
                sizes.append(len(b))
                blocks.append(b)
            full = [block_features(b) for b in blocks if b]
            keep = kept(np.concatenate(full), tree) if full else np.zeros(0, bool)
            at, features = 0, iter(full)
            for b in blocks:
                own = joined_up(next(features), keep[at:at + len(b)]) if b else ()
                texts.append("\n".join(x[0] for x, k in zip(b, own) if k))
                at += len(b)
            yield pa.RecordBatch.from_arrays(
                [*[rb.column(i) for i in range(rb.num_columns - 1)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int32())],
                names=[*rb.schema.names[:-1], "text", "n_chars", "n_blocks"])
    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html",
            labelled=None) -> DataFrame:
    """Columns ``keep`` of every page with text (its main text, one line per
    block), n_chars (code points of text) and n_blocks (blocks looked at).

    Character references are decoded, white space within a block becomes one
    space.  ``labelled`` replaces the table that the tree is fitted to (see
    :func:`labelled_blocks`).  NULL or empty html, and a page without main text, give an empty
    text; identifiers may be NULL or repeated, every row is extracted; an empty
    table gives an empty result, and other columns are not read."""
    tree = fit_tree(labelled)
    src = pages.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(html_col).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_html")
    fields += ", " if fields else ""
    out = src.mapInArrow(_extract(tree), f"{fields}text string, n_chars long, n_blocks int")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars", "n_blocks")
