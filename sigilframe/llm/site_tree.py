"""Main text of HTML pages by a site style tree.

The pages of a host are merged: elements with the same path of tags and classes are one node. Two entropies measure a
node. Of presentation: how the node's children vary over the m pages that have it, in logarithms to base m. Of
content: each text under the node, seen on k pages, has the entropy log k / log m, and content is one less their mean,
so a text that every page repeats counts 0 and one of a single page counts 1. What a node's text is worth is also told
by where it stands: its setting is the presentation of its parent, or its share of the host's text against VOLUME if
that is more, and 1 for headings. A template's slots stand in the same place on all pages and hold little, so their
setting is near 0 though their words may vary; an article's paragraphs differ in number and hold most of the text. The
importance of a node is content * (GAMMA + (1 - GAMMA) * setting), less the share of its text that is links if it is
outside an article. In a page the importances are averaged, weighted by length, from the blocks up the branches. Blocks
and branches of low importance are removed: below LEAST, below LEAST_BESIDE beside the page's <article> or <main>, below
LEAST_INSIDE inside of it, the latter two on evidence of MIN_PAGES pages or more.

What a page says of itself is a prior: branches that are menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, styles or comments by their tag, role, class or id, or that aren't shown, are removed too, for a host of one
page has no tree. A class or id doesn't remove the branch that holds the page's <article> or <main>, and a word such as
in `no-sidebar` counts only beside those. Inside of them a class or id removes a branch by itself only if it is a name of
noise as a whole (`share-buttons`, not `market-share`; on elements of running text, only one that says nothing else);
where it may be the article's own, the branch goes if the tree finds it repeated (importance below LEAST_BESIDE) or half
of its text is links.

Copies of a page repeat each other without being a template. So a text counts as repeated only if the pages that
share it differ in their longest text of another path; an article of which more than half would go is kept whole; and
a page without <article> or <main> keeps texts that vary where more than half of its text would go with them.

Pages are parsed where they lie, in time linear in their length. Only hashes of paths and texts are shuffled, and
summed before. The low nodes of each host are broadcast to the pages if they are few in all, else joined by shuffling.
A host may hold any share of the pages.

Defined results: null html counts as empty and gives an empty text; a null url is a host of its own; repeated rows get
equal results; broken markup is read as far as it goes; extra columns are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, map_rows, texts

#: Fixed lists of HTML: elements without an end, those that begin a block, those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote br caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav optgroup "
    "ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that end an open <p>.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption html body".split())
#: Elements that are no part of an article.
NOISE_TAGS = frozenset(
    "nav footer aside script style noscript template iframe object embed applet canvas svg button select option textarea "
    "input label head title menu dialog audio video map xmp noembed noframes search".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A prior: words of classes and ids that name parts outside the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "sponsors subscribe subscription tagcloud toolbar topbar widget widgets".split()
)
#: Words before or after these in a class or id that deny it, name a state, or belong to the article.
BEFORE = frozenset("no not without non hide has have with is".split())
AFTER = frozenset("free less off hidden content wrapper container layout page".split())
OWN = frozenset("entry post article story page title".split())
ANCHORS = frozenset(("article", "main"))
#: Words that only say how a part is made or where it stands: with a noise word alone they make a name of noise, while in
#: any other company, as in `market-share`, the word may well be the article's own.
FILLER = frozenset(
    "a area bar block body bottom box btn button buttons by col column component container content div entry fixed for global "
    "grid group icon icons id in inline inner item items js latest left link links list main mobile module more my of on outer "
    "page panel popular post posts primary right row secondary section site sticky stories story text the title to top us wide "
    "widget wp wrap wrapper your".split()
)
#: Elements of running text, and the words that name noise even on them; others may be the text's own, as in a notice.
TEXTUAL = HEADINGS | frozenset("p li dd dt td th tr blockquote figcaption pre caption".split())
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense comment comments commentlist consent cookie cookies disqus "
    "gdpr newsletter promoted replies reply share sharing sponsor sponsored sponsors subscribe".split()
)
#: Words that name reader comments on most sites and a part of the article on some.
SPLIT = frozenset("discussion discussions".split())

TAG = re.compile(r"<(?:[!?]|(/?)([a-zA-Z][^\s/>]*+))")
STOP = re.compile(r">|=\s*+([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WORDED = re.compile(r"[^<]*+</button", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]++|[A-Z]++")
GAMMA, VOLUME, LEAST = 0.3, 0.25, 0.35
LEAST_BESIDE, LEAST_INSIDE, MIN_PAGES = 0.6, 0.2, 3

#: What an element says of itself: nothing, a noise word that may be none (beside an article it is), one, noise for sure.
PLAIN, MAYBE, NAMED, SURE = range(4)


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _word(value: str, inside: bool, tag: str) -> int:
    """What a class or id says. inside: an <article> or <main> is open; there a word counts for sure only if it is the
    whole name, but for filler, and names noise on such an element."""
    found = PLAIN
    for token in value.split():
        parts = [p.lower() for p in PARTS.findall(token)]
        noisy = (NOISE_WORDS | SPLIT).intersection(parts)
        if noisy == {"header"} and inside and (tag == "header" or not OWN.isdisjoint(parts)):
            continue
        if noisy:
            doubt = parts[0] in BEFORE or parts[-1] in AFTER or noisy == {"header"} and not OWN.isdisjoint(parts) or noisy <= SPLIT
            if inside:
                doubt |= not (noisy | FILLER).issuperset(parts) or tag in TEXTUAL and noisy.isdisjoint(STRONG)
            found = max(found, MAYBE if doubt else NAMED)
    return found


def _describe(tag: str, attributes: str, inside: bool) -> tuple[str, int]:
    """Tag with classes, and what the element says of itself. inside: an <article> or <main> is open."""
    own, told = tag, PLAIN
    if tag in NOISE_TAGS:
        told = SURE
    elif tag == "form" or tag == "header" and not inside:
        told = NAMED
    if attributes and TELLING.search(attributes):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class":
                own = tag + "." + ".".join(sorted(value.split()))
            if tag in ("html", "body"):
                continue
            if name in ("class", "id"):
                told = max(told, _word(value, inside, tag))
            elif (
                name == "hidden"
                or name == "role" and value.lower() in NOISE_ROLES
                or name == "aria-hidden" and value.lower() == "true"
                or name == "style" and UNSEEN.search(value.lower())
            ):
                told = SURE
    return own, told


class Cache:
    """Of a worker: numbers of paths and of lists of children, and what elements say."""

    def __init__(self, kept: int = 200_000):
        self.kept, self.paths, self.told = kept, {}, {}

    def path(self, parent: int, own: str) -> int:
        key = parent, own
        got = self.paths.get(key)
        if got is None:
            if len(self.paths) >= self.kept:
                self.paths.clear()
            got = number(f"{parent}/{own}")
            if len(own) <= 256:
                self.paths[key] = got
        return got

    def describe(self, tag: str, attributes: str, inside: bool) -> tuple[str, int]:
        if len(attributes) > 256:
            return _describe(tag, attributes, inside)
        key = tag, attributes, inside
        got = self.told.get(key)
        if got is None:
            if len(self.told) >= self.kept:
                self.told.clear()
            got = self.told[key] = _describe(tag, attributes, inside)
        return got


_cache = Cache()


class Block(NamedTuple):
    """state: 1 inside the page's <article> or <main>, 0 outside, -1 noise by its own markup. element: the innermost
    that begins a block. links: characters of the text that are links. doubt: a class or id above it, inside the article,
    may name noise."""

    path: int
    element: int
    state: int
    text: str
    links: int
    heading: bool
    doubt: bool = False


class Open(NamedTuple):
    """sure: noise for sure, of the element or one above. named: the innermost of those that classes or ids name.
    mute: inside an element that stands in a line and isn't shown."""

    tag: str
    path: int
    element: int
    sure: bool
    named: int
    anchor: int
    mute: bool


class Page:
    """blocks, in page order. up: of each element the one above. children: of each path the elements that follow in it."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.parents: dict[int, int] = {0: 0}
        self.children: dict[int, list[str]] = {}
        self.up, self.holds = [0], [True]  # element 0 stands for the page; holds: an anchor, or is one
        self.open = [Open("", 0, 0, False, 0, 0, False)]
        self.where: dict[str, list[int]] = {}
        # of each element that a class or id names, from 1: the one above, how many stand above, sure of it or not
        # and the <article> or <main> that it is in
        self.above, self.depth, self.certain, self.within = [0], [0], [True], [0]
        # of each <article> or <main>, from 1: tag, what is named above it, characters of its own text
        self.anchors: list[list] = [["", 0, 0]]
        self.raw: list[tuple] = []
        self.parts: list[str] = []
        self.links, self.link = 0, 0  # of the block; where in `open` a link began
        self.simple = False
        self.read(source)
        self.end_block()
        self.judge()

    def judge(self) -> None:
        """What is named inside or beside the branches that hold the page's text is noise; inside of them, what may be
        named so is in doubt."""
        held = self.held()
        bad, doubt = [False], [False]
        for i in range(1, len(self.above)):
            above, own = self.above[i], i not in held
            inside = self.within[i] > 0 and self.anchors[self.within[i]][0] == self.chosen
            bad.append(bad[above] or own and (self.certain[i] or self.anchored and not inside))
            doubt.append(doubt[above] or own and inside and not self.certain[i])
        for path, element, sure, named, anchor, text, links, heading in self.raw:
            state = -1 if sure or bad[named] else int(anchor > 0)
            self.blocks.append(Block(path, element, state, text, links, heading, state == 1 and doubt[named]))

    def held(self) -> set[int]:
        """Named elements above the page's text: its <article>s below the fewest of them, or the <main> if that has as
        much text of its own below fewer."""
        least: dict[str, list] = {}
        for tag, named, size in self.anchors[1:]:
            if size:
                depth, total, below = least.setdefault(tag, [self.depth[named], 0, []])
                if self.depth[named] < depth:
                    least[tag] = [self.depth[named], size, [named]]
                elif self.depth[named] == depth:
                    least[tag][1] += size
                    below.append(named)
        article, main = least.get("article"), least.get("main")
        if article and main and main[0] < article[0] and main[1] >= article[1]:
            article = None
        chosen = article or main
        self.anchored, self.chosen = chosen is not None, "article" if article else "main"
        held: set[int] = set()
        for named in chosen[2] if chosen else ():
            while named and named not in held:
                held.add(named)
                named = self.above[named]
        return held

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                at = self.open[-1]
                self.raw.append((at.path, at.element, at.sure, at.named, at.anchor, text, min(self.links, len(text)), at.tag in HEADINGS))
                if not at.sure and at.named == self.anchors[at.anchor][1]:
                    self.anchors[at.anchor][2] += len(text)
        self.links = 0

    def push(self, entry: Open) -> None:
        self.where.setdefault(entry.tag, []).append(len(self.open))
        self.open.append(entry)

    def pop_to(self, i: int) -> None:
        """Closes what is open from place i on."""
        if any(not x.mute for x in self.open[i:]):
            self.end_block()
        for x in self.open[i:]:
            self.where[x.tag].pop()
        del self.open[i:]
        if self.link >= i:
            self.link = 0

    def last(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        i = self.last(tag)
        if i and (tag in TABLE or i > self.last("td", "th", "caption")):
            self.pop_to(i)
        elif tag in BLOCK and not self.open[-1].mute:
            self.end_block()

    def start(self, tag: str, attributes: str) -> None:
        block, at = tag in BLOCK, self.open[-1]
        if block and not at.mute:
            self.end_block()
        if block:
            last = self.last
            if tag in ENDS_P and last("p") > last("td", "th", "caption", "button", "object"):
                self.pop_to(last("p"))
            elif tag == "li" and last("li") > last("ul", "ol", "menu"):
                self.pop_to(last("li"))
            elif tag in ("dt", "dd") and last("dt", "dd") > last("dl"):
                self.pop_to(last("dt", "dd"))
            elif tag in ("td", "th") and last("td", "th") > last("table"):
                self.pop_to(last("td", "th"))
            elif tag == "tr" and (last("tr") > last("table") or last("td", "th") > last("table")):
                self.pop_to(last("tr") if last("tr") > last("table") else last("td", "th"))
            at = self.open[-1]
        own, told = _cache.describe(tag, attributes, at.anchor > 0)
        void = tag in VOID or attributes.endswith("/") and tag in ("svg", "path")
        if not block:
            if void:
                return
            if tag == "a":
                self.link = len(self.open) - 1 or 1
            if at.mute or told:  # pushed, so that its end is known; others that stand in a line leave no trace
                self.push(at._replace(tag=tag, mute=True))
            return
        if not at.mute:
            self.children.setdefault(at.path, []).append(own)
        if void:
            return
        sure, named, anchor = at.sure, at.named, at.anchor
        if tag == "body":
            sure, named = False, 0
        if told == SURE:
            sure = True
        elif told and not sure:
            self.above.append(named)
            self.depth.append(self.depth[named] + 1)
            self.certain.append(told == NAMED)
            self.within.append(anchor)
            named = len(self.above) - 1
        path = _cache.path(at.path, own)
        self.parents[path] = at.path
        element = len(self.up)
        self.up.append(at.element)
        self.holds.append(tag in ("html", "body"))
        if tag in ANCHORS and not sure and not at.mute:
            self.anchors.append([tag, named, 0])
            anchor = len(self.anchors) - 1
            while not self.holds[element]:
                self.holds[element] = True
                element = self.up[element]
            element = len(self.up) - 1
        self.push(Open(tag, path, element, sure, named, anchor, at.mute))

    def end_of_tag(self, source: str, at: int) -> int:
        """The place of the > that ends a tag, not in quotes. Where quotes leave a tag without an end, it and the rest
        of the page are read as if there were none."""
        place = at
        while not self.simple:
            m = STOP.search(source, place)
            if m and not m[1]:
                return m.start()
            place = source.find(m[1], m.end()) + 1 if m else 0
            self.simple = not place
        end = source.find(">", at)
        return len(source) if end < 0 else end

    def say(self, text: str) -> None:
        if not self.open[-1].mute:
            text = entities.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.link:
                self.links += len(text)

    def read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self.say(source[at:])
                break
            here = m.start()
            if here > at:
                self.say(source[at:here])
            if m[2] is None:
                mark = "-->" if source.startswith("<!--", here) else ">"
                end = source.find(mark, here + 2)
                at = n if end < 0 else end + len(mark)
                continue
            tag, end = m[2].lower(), self.end_of_tag(source, m.end())
            at = end + 1
            if m[1]:
                self.close(tag)
                continue
            if tag == "button" and self.open[-1].anchor and self.open[-1].tag in TEXTUAL and WORDED.match(source, at):
                continue  # named in a sentence
            attributes = source[m.end() : end].strip()
            self.start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                after = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = after.start() if after else n


def site_evidence(pages: DataFrame) -> DataFrame:
    """Per page: its host, and once each (path, parent, kind, value): kind 0 how its children follow, 1 a text of it.

    beside: of a text, the longest other one of its page that isn't noise, of another path. flags: 1 for a heading, 2
    inside an <article> or <main>."""
    names = ["host", "path", "parent", "kind", "value", "beside", "size", "links", "flags"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in names]
        add = [c.append for c in columns]
        numbers: dict[str, int] = {}

        def numbered(text: str) -> int:
            if len(text) > 256:
                return number(text)
            if text not in numbers:
                numbers[text] = number(text)
            return numbers[text]

        for host, source in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
            page = Page(source or "")
            own = {b.path for b in page.blocks}
            rows = {(p, 0, numbered(" ".join(page.children.get(p, ())))): [None, 0, 0, 0] for p in own | {page.parents[p] for p in own}}
            plain = [(len(b.text), b.text, b.path) for b in page.blocks if b.state >= 0]
            first = max(plain, default=(0, "", None))
            second = max((x for x in plain if x[2] != first[2]), default=(0, "", None))
            longest, next_longest = numbered(first[1]), numbered(second[1])
            for b in page.blocks:
                beside = next_longest if b.path == first[2] else longest
                row = rows.setdefault((b.path, 1, numbered(b.text)), [beside, 0, 0, 0])
                row[1] += len(b.text)
                row[2] += b.links
                row[3] |= b.heading | 2 * (b.state == 1)
            for (path, kind, value), rest in rows.items():
                for put, v in zip(add, (host, path, page.parents[path], kind, value, *rest), strict=True):
                    put(v)
        kinds = [pa.string(), *[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 4, pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "host string, path bigint, parent bigint, kind int, value bigint, beside bigint, size bigint, links bigint, flags int"
    return map_rows(pages.select(host_of().alias("host"), "html"), run, schema)


def host_of():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def importance(evidence: DataFrame, gamma: float = GAMMA, volume: float = VOLUME) -> DataFrame:
    """Of each node that has a text: host, path, pages m, content, importance."""
    ensure_checkpoint_dir(evidence.sparkSession)
    k = evidence.groupBy("host", "path", "parent", "kind", "value").agg(
        F.count(F.lit(1)).alias("k"),
        F.min("beside").alias("low"),
        F.max("beside").alias("high"),
        F.sum("size").alias("size"),
        F.sum("links").alias("links"),
        F.bit_or("flags").alias("flags"),
    )
    style, text = F.col("kind") == 0, F.col("kind") == 1
    copied = F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    node = k.groupBy("host", "path", "parent").agg(
        F.sum(F.when(style, F.col("k"))).cast("double").alias("m"),
        F.sum(F.when(style, F.col("k") * F.log("k"))).alias("klogk"),
        F.count(F.when(text, 1)).alias("texts"),
        F.sum(F.when(text, F.when(copied, 0.0).otherwise(F.log("k")))).alias("logk"),
        F.sum("size").alias("size"),
        F.sum("links").alias("links"),
        F.bit_or("flags").alias("flags"),
    )
    several = F.col("m") > 1
    presentation = F.when(several, 1 - F.col("klogk") / (F.col("m") * F.log("m"))).otherwise(1.0)
    content = F.when(several, F.greatest(F.lit(0.0), 1 - F.col("logk") / (F.col("texts") * F.log("m")))).otherwise(1.0)
    # written once: read again for what stands above, and for the text of the host
    node = node.withColumns({"presentation": presentation, "content": content}).checkpoint()
    above = node.select("host", F.col("path").alias("parent"), F.col("presentation").alias("above"))
    host = node.groupBy("host").agg(F.sum("size").alias("held"))
    share = F.col("size") / (volume * F.col("held"))
    heading, inside = F.col("flags").bitwiseAND(1) > 0, F.col("flags").bitwiseAND(2) > 0
    setting = F.when(heading | ~several, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.coalesce("above", F.lit(1.0)), share)))
    links = F.when(inside | ~several, 0.0).otherwise(F.col("links") / F.col("size"))
    worth = F.col("content") * (gamma + (1 - gamma) * setting) * (1 - links)
    return node.filter("texts > 0").join(above, ["host", "parent"], "left").join(host, "host").select("host", "path", "m", "content", worth.alias("importance"))


def low_nodes(pages: DataFrame) -> DataFrame:
    """Per host, the nodes that any of the bounds may remove; at most the number of its nodes."""
    found = importance(site_evidence(pages)).filter((F.col("importance") < max(LEAST, LEAST_BESIDE, LEAST_INSIDE)) & (F.col("m") > 1))
    row = F.struct("path", "importance", "content", (F.col("m") >= MIN_PAGES).alias("sure"))
    return found.groupBy("host").agg(F.collect_list(row).alias("low"))


def prune(page: Page, low: dict[int, tuple[float, float, bool]]) -> tuple[list[bool], list[bool]]:
    """Of each block, whether it stays, and whether the tree takes it for noise, whatever the markup says."""
    least = LEAST_BESIDE if page.anchored else LEAST
    size, worth = [0] * len(page.up), [0.0] * len(page.up)
    gone = []
    for b in page.blocks:
        value, _, sure = low.get(b.path, (1.0, 1.0, True))
        if b.state == 1:
            # a name that is in doubt counts where the tree or the links agree
            gone.append(sure and value < (LEAST_BESIDE if b.doubt else LEAST_INSIDE) or b.doubt and 2 * b.links >= len(b.text))
        else:
            gone.append(value < (least if sure else LEAST))
        if b.state < 1:
            size[b.element] += len(b.text)
            worth[b.element] += len(b.text) * value
    if low:
        # elements stand after the one above them
        for e in range(len(size) - 1, 0, -1):
            size[page.up[e]] += size[e]
            worth[page.up[e]] += worth[e]
        branch = [False] * len(size)
        for e in range(1, len(size)):
            branch[e] = branch[page.up[e]] or not page.holds[e] and size[e] > 0 and worth[e] < LEAST * size[e]
        gone = [g or b.state < 1 and branch[b.element] for g, b in zip(gone, page.blocks, strict=True)]
    tree = list(gone)
    total, lost = [0, 0], [0, 0]
    varied = [b.state == 1 or low.get(b.path, (1.0, 1.0))[1] >= 0.5 for b in page.blocks]
    for b, g, v in zip(page.blocks, gone, varied, strict=True):
        if b.state >= 0:
            total[b.state] += len(b.text)
            lost[b.state] += g and v and len(b.text)
    spared = (not page.anchored and 2 * lost[0] > total[0], 2 * lost[1] > total[1])
    kept = [b.state >= 0 and (not g or v and spared[b.state]) for b, g, v in zip(page.blocks, gone, varied, strict=True)]
    return kept, tree


def extract_text(pages: DataFrame, small: int = 200_000) -> DataFrame:
    """Per page: page_id, url, text, n_chars; n_blocks, n_removed, and of these n_tree that the tree finds, with or
    without the prior. small: low nodes of all hosts up to which they are broadcast."""
    ensure_checkpoint_dir(pages.sparkSession)
    # written once, so that the join may deal out both sides and split the pages of a large host
    low = low_nodes(pages).checkpoint()
    nodes = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("n")).first()["n"]
    if nodes <= small:
        low = F.broadcast(low)  # at most that many numbers and hosts; the pages stay where they are
    joined = pages.select("page_id", "url", "html", host_of().alias("host")).join(low, "host", "left")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        hosts: dict[str, dict] = {}
        for i, (host, source) in enumerate(zip(texts(batch.column(3)), texts(batch.column(2)), strict=True)):
            if host not in hosts:
                if len(hosts) >= 64:
                    hosts.clear()
                hosts[host] = {x["path"]: (x["importance"], x["content"], x["sure"]) for x in batch.column(4)[i].as_py() or ()}
            page = Page(source or "")
            kept, tree = prune(page, hosts[host])
            text = " ".join(b.text for b, k in zip(page.blocks, kept, strict=True) if k)
            n = sum(kept)
            out.append((text, len(text), len(kept), len(kept) - n, sum(t and not k for t, k in zip(tree, kept, strict=True))))
        kinds = (pa.string(), *[pa.int64()] * 4)
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_chars", "n_blocks", "n_removed", "n_tree"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars bigint, n_blocks bigint, n_removed bigint, n_tree bigint"
    return map_rows(joined.select("page_id", "url", "html", "host", "low"), run, schema)
