"""Main text of web pages by tag-path ratios.

A page is read into text nodes with their path of tags from the root. For every
path two ratios are aggregated over its nodes: characters per node and
punctuation marks per node. The sequence of nodes takes its path's ratios, both
are smoothed along the page with a Gaussian and fused by product, and nodes at
or above a share of the spread of the fused ratio are content nodes.

Boilerplate goes first: elements known as such by tag, role or class words, or
mostly made of links. Words that name a part of many articles too (`search`,
`header`, `related`, ...) count only where the links or form fields agree, and
outside an article also where the ratios do. What is left of an article
or main element that holds nearly all content nodes is the text, whole. On other
pages it is the smallest block element around all content nodes, without
containers beside the one that holds nearly all, and with the headings and
paragraphs that stand directly before and behind it; of the body itself, what
lies between the first and the last content node.

Pages are independent, so this is one narrow pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas audio video map datalist".split())
DROPPED = frozenset("nav header footer aside form button select textarea dialog menu fieldset".split())
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                    "h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
INLINE = frozenset("a abbr b big cite code em font i kbd label mark q s small span strong sub sup u tt".split())
INNER = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th tr ul ol dl table".split())
#: A start tag of the second kind ends an open element of the first.
ENDS = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
        "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "h1": HEADINGS, "h2": HEADINGS, "h3": HEADINGS,
        "h4": HEADINGS, "h5": HEADINGS, "h6": HEADINGS}
#: What may stand in a head; any other start tag, and text, ends an open one.
HEAD = frozenset("head html base basefont bgsound link meta noscript script style template title".split())
#: Elements that stop the search for one to end.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
FURNITURE = frozenset((
    "ad ads adv advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets menu menus nav navbar "
    "navigation breadcrumb breadcrumbs header masthead topbar footer foot comment comments disqus respond replies reply share sharing social related "
    "recommended recommendations trending pagination pager toolbar skip copyright disclaimer search form").split())
#: Words of these that name parts of articles as well.
COMMON = frozenset(("search form header masthead notice notices share sharing social related recommended recommendations trending widget widgets menu menus "
                    "promotion promoted subscription copyright foot skip").split())
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
CONTROLS = frozenset("input button select textarea".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = re.compile("[.,;:!?…。，；：！？、،؟।]")
SPACE = re.compile(r"\s+")
SMOOTH, SHARE, HOLDS, LINKED = 1.0, 0.5, 0.85, 0.6


#: Open elements that a start tag may end, by that tag.
CLOSES = {tag: [was for was, ends in ENDS.items() if tag in ends] for tag in frozenset().union(*ENDS.values())}


class _Page(HTMLParser):
    """Elements (tag, parent, path number, attributes) and text nodes (element, block number, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.paths, self.notes = ["#root"], [-1], [0], [{}]
        self.open, self.nodes, self.block, self.controls = [0], [], 0, []
        self.still = Counter()  # open elements by tag, so that the open ones are searched only for what is there
        self.known: dict[tuple[int, str], int] = {}

    def _in_head(self):
        return self.still["head"] > 0

    def _close(self, at):
        self.still.subtract(self.tags[e] for e in self.open[at:])
        del self.open[at:]

    def _end_head(self):
        """Close a head that is open without an end tag; inside its own elements only a body tag closes it."""
        if self._in_head():
            self._close([self.tags[e] for e in self.open].index("head"))
            self.block += 1

    def handle_starttag(self, tag, attrs):
        if tag == "body" or self.tags[self.open[-1]] == "head" and tag not in HEAD or (
                self.tags[self.open[-1]] == "noscript" and tag not in HEAD and self._in_head()):
            self._end_head()
        if tag == "br":
            self._put(" ")
            return
        if tag in BLOCKS:
            self.block += 1
        for at in range(len(self.open) - 1, 0, -1) if any(self.still[was] for was in CLOSES.get(tag, ())) else ():
            was = self.tags[self.open[at]]
            if tag in ENDS.get(was, ()):
                self._close(at)
                break
            if was in WALLS.get(tag, ()) or was in ("article", "section", "div", "table", "body") and tag not in WALLS:
                break
        if tag in CONTROLS:
            self.controls.append(self.open[-1])
        if tag in ("html", "body") and self.still[tag] or tag in VOID:
            return
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.paths.append(self.known.setdefault((self.paths[self.open[-1]], tag), len(self.known) + 1))
        self.notes.append(dict(attrs))
        self.still[tag] += 1
        self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe", "object", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.block += 1
        for at in range(len(self.open) - 1, 0, -1) if self.still[tag] else ():
            was = self.tags[self.open[at]]
            if was == tag:
                self._close(at)
                break
            if was in ("table", "td", "th", "article", "body") and tag not in BLOCKS:
                break

    def handle_data(self, data):
        if self.tags[self.open[-1]] == "head" and data.strip():
            self._end_head()
        self._put(data)

    def _put(self, data):
        if self.nodes and self.nodes[-1][0] == self.open[-1] and self.nodes[-1][1] == self.block:
            self.nodes[-1][2].append(data)
        else:
            self.nodes.append((self.open[-1], self.block, [data]))


def _smoothed(values: list[float]) -> list[float]:
    kernel = [math.exp(-i * i / (2 * SMOOTH * SMOOTH)) for i in range(3)]
    out = []
    for i in range(len(values)):
        near = [(kernel[abs(j)], values[i + j]) for j in range(-2, 3) if 0 <= i + j < len(values)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def _content_weights(paths: list[int], texts: list[str]) -> list[float]:
    """The weight of each node: its length where the fused ratio of its path passes the threshold, else 0."""
    chars, marks, number = {}, {}, {}
    for path, text in zip(paths, texts):
        chars[path] = chars.get(path, 0) + len(text)
        marks[path] = marks.get(path, 0) + len(MARKS.findall(text))
        number[path] = number.get(path, 0) + 1
    long = _smoothed([chars[p] / number[p] for p in paths])
    dotted = _smoothed([marks[p] / number[p] for p in paths])
    fused = [a * (b + 0.1) for a, b in zip(long, dotted)]
    if not fused:
        return []
    mean = sum(fused) / len(fused)
    least = min(SHARE * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)), max(fused))
    return [float(len(t)) if f >= least else 0.0 for f, t in zip(fused, texts)]


def main_text(html: str) -> str:
    """Blocks of the main text, one per line; empty if there is none."""
    page = _Page()
    page.feed(html)
    page.close()
    tags, parents, notes = page.tags, page.parents, page.notes
    n = len(tags)
    unseen, path = [False] * n, page.paths
    for e in range(1, n):
        note = notes[e]
        hidden = "hidden" in note or note.get("aria-hidden") == "true" or "display:none" in (note.get("style") or "").replace(" ", "").lower()
        unseen[e] = unseen[parents[e]] or tags[e] in UNSEEN or hidden
    nodes = [(e, b, "".join(parts)) for e, b, parts in page.nodes if not unseen[e]]
    bare = [SPACE.sub(" ", t).strip() for _, _, t in nodes]
    seen = [i for i, t in enumerate(bare) if t]
    weight = dict(zip(seen, _content_weights([path[nodes[i][0]] for i in seen], [bare[i] for i in seen])))

    def totals(of) -> list[float]:
        out = [0.0] * n
        for i in seen:
            out[nodes[i][0]] += of(i)
        for e in range(n - 1, 0, -1):
            out[parents[e]] += out[e]
        return out

    inside, body, link, block_of = [False] * n, [False] * n, [False] * n, [0] * n
    for e in range(1, n):
        inside[e] = inside[parents[e]] or tags[e] == "article"
        body[e] = body[parents[e]] or tags[e] in ("article", "main")
        link[e] = link[parents[e]] or tags[e] == "a"
        block_of[e] = e if tags[e] in BLOCKS else block_of[parents[e]]
    holds_article = [t in ("article", "main") for t in tags]
    links, controls = [0] * n, [0] * n
    for e in page.controls:
        controls[e] += 1
    for e in range(n - 1, 0, -1):
        holds_article[parents[e]] |= holds_article[e]
        links[e] += tags[e] == "a"
        links[parents[e]] += links[e]
        controls[parents[e]] += controls[e]
    content, letters = totals(lambda i: weight[i]), totals(lambda i: len(bare[i]))
    linked = totals(lambda i: len(bare[i]) if link[nodes[i][0]] else 0)
    gone = [False] * n
    for e in range(1, n):
        tag, note = tags[e], notes[e]
        gone[e] = gone[parents[e]]
        if gone[e] or tag in ("html", "body", "main"):
            continue
        words = set(re.findall("[a-z]+", f"{note.get('class') or ''} {note.get('id') or ''}".lower()))
        most = holds_article[e] or content[e] > 0.5 * content[0] > 0
        furniture, thin = words & FURNITURE, 2 * content[e] <= letters[e]
        if tag in DROPPED:
            gone[e] = not (tag == "header" and inside[e]) and not (tag == "form" and most)
        elif tag == "article" and words & COMMENTS:
            gone[e] = True
        elif (note.get("role") or "").lower() in ROLES or furniture:
            handles = linked[e] > LINKED * letters[e] or controls[e] > 0
            if tag in INLINE:
                gone[e] = tag in ("span", "a") and bool(words & {"ad", "ads", "advert", "share", "skip", "sponsored"})
            elif most or tag in HEADINGS:
                gone[e] = False
            elif furniture and furniture <= COMMON:
                gone[e] = handles or thin and not inside[e] and not letters[e] == content[e]
            else:
                gone[e] = bool(furniture) or not inside[e] or thin
        elif tag in ("ul", "ol", "div", "section", "table", "p") and links[e] >= 3 and linked[e] > LINKED * letters[e] and not (
                body[e] or most or not thin):
            gone[e] = True
    for i in list(weight):
        if gone[nodes[i][0]]:
            weight[i] = 0.0
    content = totals(lambda i: weight[i])
    chosen = _chosen(tags, parents, gone, content, [nodes[i][0] for i in seen], [weight[i] for i in seen])
    stays = {i for i, good in zip(seen, chosen.around(block_of, lambda e: linked[e] > LINKED * letters[e])) if good}
    lines, current = [], None
    for i, (e, block, text) in enumerate(nodes):
        if i in stays or not bare[i] and block == current:
            if block != current:
                lines.append([])
                current = block
            lines[-1].append(text)
    blocks = (SPACE.sub(" ", "".join(parts)).strip() for parts in lines)
    return "\n".join(b for b in blocks if b)


class _Chosen:
    """The element of the main text, and which text nodes (by their elements) belong to it."""

    def __init__(self, tags, parents, gone, owners, weights, at, whole):
        self.tags, self.gone, self.owners, self.weights, self.whole = tags, gone, owners, weights, whole
        self.within = [False] * len(tags)
        for e in range(at, len(tags)):
            self.within[e] = e == at or (e > 0 and self.within[parents[e]])
        self.bound = tags[at] in ("#root", "html", "body")
        self.parents, self.above = parents, {at}
        while at > 0:
            at = parents[at]
            self.above.add(at)

    def around(self, block_of, of_links) -> list[bool]:
        """For each node whether it is main text: in the element, or a heading or paragraph directly beside it."""
        out = [self.within[e] and not self.gone[e] for e in self.owners]
        if self.whole:
            return out
        if self.bound:  # the body: from the first to the last content node
            full = [i for i, w in enumerate(self.weights) if w > 0]
            out = [good and full[0] <= i <= full[-1] for i, good in enumerate(out)] if full else out
        held = [i for i, good in enumerate(out) if good]
        for places, passes in ((range(held[0] - 1, -1, -1), True), (range(held[-1] + 1, len(out)), False)) if held else ():
            for i in places:
                block = block_of[self.owners[i]]
                if self.gone[self.owners[i]]:
                    if passes:  # an advert between title and text
                        continue
                    break
                holder = block
                while holder and self.tags[holder] in INNER:
                    holder = block_of[self.parents[holder]]
                if holder == block or holder not in self.above or of_links(block):  # of another container
                    break
                out[i] = True
        return out


def _chosen(tags, parents, gone, content, owners, weights) -> _Chosen:
    n, total = len(tags), content[0]
    for kind in ("article", "main"):  # elements stand before those inside them, so the last one is the innermost
        found = [e for e in range(n) if tags[e] == kind and not gone[e] and content[e] >= HOLDS * total and total]
        if found:
            return _Chosen(tags, parents, gone, owners, weights, found[-1], True)
    at = max((e for e in range(n) if content[e] == total and not gone[e]), default=0) if total else 0
    children: dict[int, list[int]] = {}
    for e in range(1, n):
        if content[e] and not gone[e]:
            children.setdefault(parents[e], []).append(e)
    while at in children:
        best = max(children[at], key=lambda c: content[c])
        others = [c for c in children[at] if c != best]
        beside = sum(content[c] for c in others) + content[best] < content[at]  # text of its own
        if beside or tags[best] in INNER | INLINE or content[best] < HOLDS * content[at] or any(tags[c] in INNER | INLINE or tags[c] not in BLOCKS for c in others):
            break
        at = best
    while at and (tags[at] not in BLOCKS or tags[at] in INNER):
        at = parents[at]
    return _Chosen(tags, parents, gone, owners, weights, at, False)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row, from the whole html.

    A null or empty html has an empty text. Repeated rows are read one by one;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h.as_py()) for h in b.column(2)], pa.string())], ["page_id", "url", "text"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(F.col(html_col)).alias("h"))
    return source.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
