"""Main text of web pages through wrappers: union-free regular expressions inferred from the pages of a host.

A page is a token stream (tags, text). The streams of a host's pages are aligned level by level: tokens that match stay, a run of like
siblings becomes a repeated group, what a stream lacks becomes an optional group, and texts become slots. What comes out is a
union-free regular expression, whatever the order of the pages. A slot is known by its path; an element without a class or id is told
from others by whether its text stands in links.

A page's text is what the wrapper's slots hold, on every page. The slots below an article or main element of the wrapper come first.
Pages without text there have it in the slots that vary:
a slot is template if most of its text stands there on half of the host's pages or more, on different pages; repeated groups whose
text stands in links are menus; and the article lies below the innermost element of the wrapper that has most of the text that varies.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import by_bytes, filled, materialise, table

#: Paths and templates of all hosts go to the workers by broadcast up to so many bytes, else by a join.
BROADCAST_BYTES = 32 << 20
#: Wrappers (or skeletons of pages) that are aligned in one group, and what a task holds before it passes them on.
TOGETHER, HELD = 1000, 20_000
#: Levels with more pairs of tokens than this between two anchors are aligned without counting all common subsequences.
PAIRS = 40_000
#: A text on this share of a host's pages is template; an element with this share of the varying text holds the article; a group with this share in links is a menu.
TEMPLATE_SHARE, ARTICLE_SHARE, LINK_SHARE = 0.5, 0.8, 0.8
#: A host's pages differ in their articles if the text that varies is at least this share of the text that does not; else nothing is template.
DIFFER_SHARE = 0.25

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</?[a-zA-Z](?:"[^"]*+"|'[^']*+'|[^'">])*+>|</?[a-zA-Z][^>]*+>""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<=[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that hold others without saying what they are.
BOXES = frozenset("div section span td ul ol li table tr tbody center".split())
# Elements that are no part of an article, and words of class, id or role that say so of others.
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe svg object button select textarea input menu dialog title".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts sidebar aside menu menus nav navbar navigation navigations breadcrumb breadcrumbs header masthead topbar footer bottombar comment comments commentlist reply replies respond disqus form search searchbox login signin signup subscribe subscription newsletter share sharing social related recommended widget widgets popup modal overlay toolbar pager pagination complementary contentinfo".split()
)


@lru_cache(maxsize=1 << 14)
def start_tag(source: str) -> tuple[str, str, bool]:
    """Name, path element (the name, and class or id words that tell it from others) and whether it is dropped."""
    name = NAME.match(source)[1].lower()
    words: set[str] = set()
    marks = []
    for m in ATTRIBUTE.finditer(source):
        value = htmllib.unescape(m[2] or m[3] or m[4] or "").strip()
        if value:
            marks.append("_".join(re.sub(r"\d+", "0", value).split()))
            words |= {w.lower() for w in SPLIT.split(value) if w}
    dropped = name in DROPPED or name not in ("html", "body", "main", "article") and not words.isdisjoint(DROPPED_WORDS)
    if name == "article" and not words.isdisjoint({"comment", "comments", "reply"}):
        dropped = True
    if name in INLINE and not dropped:
        marks = []
    return name, ".".join([name, *marks]).replace("/", "|"), dropped


class Node:
    """An element of a page or wrapper, or a wrapper's slot (sig "#"). children: nodes, and texts as strings (pages only).

    links and chars: a page's text below, in links and in all.
    """

    __slots__ = ("sig", "name", "dropped", "optional", "repeated", "children", "links", "chars")

    def __init__(self, sig: str, name: str, dropped: bool = False, optional: bool = False, repeated: bool = False):
        self.sig, self.name, self.dropped, self.optional, self.repeated, self.children = sig, name, dropped, optional, repeated, []
        self.links = self.chars = 0


def in_order(root: Node) -> list[Node]:
    """All elements that aren't dropped, parents first."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in x.children if isinstance(c, Node) and not c.dropped]
    return out


def weigh(x: Node) -> None:
    """Text below x, once its children are weighed; an element without marks gets its kind: L (text in links), T (other text) or nothing."""
    for c in x.children:
        if isinstance(c, str):
            x.chars += len(c) if not c.isspace() else 0
        elif not c.dropped:
            x.chars += c.chars
            x.links += c.chars if c.name == "a" else c.links
    if x.sig == x.name and x.name in BOXES and x.chars:
        x.sig += "~L" if x.links >= LINK_SHARE * x.chars else "~T"


def parse(page: str) -> Node:
    """The page's tokens as a tree. Missing and stray end tags are put right as far as the element's content model says."""
    root = Node("", "", False)
    stack = [root]
    open_names: Counter[str] = Counter()

    def cut(k: int) -> None:
        for x in stack[k:]:
            open_names[x.name] -= 1
        del stack[k:]

    def close(names: set[str], within: set[str]) -> None:
        if not any(open_names[x] > 0 for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                cut(k)
                return
            if stack[k].name in within:
                return

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(s)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, token = m.end(), m[0]
        if token[1] in "!?":
            continue
        if token[1] == "/":
            name = NAME.match(token)[1].lower()
            for k in range(len(stack) - 1, 0, -1) if open_names[name] > 0 else ():
                if stack[k].name == name:
                    cut(k)
                    break
                if stack[k].name in ("article", "main", "body", "table") and (name in INLINE or name in ("p", "li")):
                    break
            continue
        name, sig, dropped = start_tag(token)
        if name in CLOSES_P:
            close({"p"}, {"article", "main", "body", "div", "section", "td", "li", "blockquote", "aside", "nav", "form"})
        if name in CLOSES:
            for _ in range(3):
                close(*CLOSES[name])
        if name in ("article", "main") and not dropped:  # an end tag is missing
            for k in range(len(stack) - 1, 0, -1) if any(open_names[x] > 0 for x in ("nav", "header", "footer", "head")) else ():
                if stack[k].name in ("nav", "header", "footer", "head"):
                    cut(k)
        if name == "body":
            close({"head"}, set())
        node = Node(sig, name, dropped)
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID:
            stack.append(node)
            open_names[name] += 1
    for x in reversed(in_order(root)):
        weigh(x)
    return root


# --- wrappers -----------------------------------------------------------------------------------------------------------------


class Column:
    """Tokens of a level that match: members by stream, in how many streams they are, and whether one has several."""

    __slots__ = ("sig", "name", "members", "seen", "optional", "repeated")

    def __init__(self, child: Node | str):
        is_text = isinstance(child, str)
        self.sig, self.name = ("#", "#") if is_text else (child.sig, child.name)
        self.members = [] if is_text else [child]
        self.seen, self.optional, self.repeated = 1, not is_text and child.optional, not is_text and child.repeated

    def add(self, other: Column, same_stream: bool) -> None:
        self.members += other.members
        self.seen = max(self.seen, other.seen) if same_stream else self.seen + other.seen
        self.optional, self.repeated = self.optional or other.optional, self.repeated or other.repeated or same_stream and self.sig != "#"


def level(x: Node) -> list[Column]:
    """The tokens below x as columns of one stream."""
    return folded([Column(c) for c in x.children if (not c.isspace() if isinstance(c, str) else not c.dropped)])


def folded(columns: list[Column]) -> list[Column]:
    """Runs of like siblings as one repeated group; a text between two of them (or elements between texts) belongs to the run."""
    out: list[Column] = []
    for c in columns:
        if out and out[-1].sig == c.sig:
            out[-1].add(c, True)
        elif len(out) >= 3 and out[-2].sig == c.sig and out[-1].sig == out[-3].sig:  # x y x y: the pair is repeated
            out[-2].add(c, True)
        else:
            out.append(c)
    return out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal tokens, ascending in both: like beginnings and ends, then what occurs once on either side as anchors, and
    the longest common subsequence between them (or, of a stretch with too many pairs, each token's next occurrence)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= PAIRS:
            out += common(a, b, i, m, j, n)
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        place = {x: j + k for k, x in enumerate(b[j:n])}
        once = [(i + k, place[x]) for k, x in enumerate(a[i:m]) if ca[x] == 1 and cb[x] == 1]
        anchors = rising(once)
        if anchors:
            for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
                todo.append((p + 1, r, q + 1, s))
            out += anchors
            continue
        where: dict[str, list[int]] = {}
        for k in range(j, n):
            where.setdefault(b[k], []).append(k)
        at = j
        for k in range(i, m):
            found = where.get(a[k], ())
            f = bisect_left(found, at)
            if f < len(found) and found[f] - at <= max(64, 2 * (k - i)):
                out.append((k, found[f]))
                at = found[f] + 1
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that ascends in the second, too."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, q) in enumerate(pairs):
        f = bisect_left(tails, q)
        tails[f : f + 1] = [q]
        last[f : f + 1] = [k]
        before[k] = last[f - 1] if f else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common(a: list[str], b: list[str], i: int, m: int, j: int, n: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a[i:m] and b[j:n]."""
    best = [[0] * (n - j + 1) for _ in range(m - i + 1)]
    for p in range(m - i - 1, -1, -1):
        row, below = best[p], best[p + 1]
        for q in range(n - j - 1, -1, -1):
            row[q] = below[q + 1] + 1 if a[i + p] == b[j + q] else max(below[q], row[q + 1])
    out, p, q = [], 0, 0
    while p < m - i and q < n - j:
        if a[i + p] == b[j + q]:
            out.append((i + p, j + q))
            p, q = p + 1, q + 1
        elif best[p + 1][q] >= best[p][q + 1]:
            p += 1
        else:
            q += 1
    return out


def aligned(a: list[Column], b: list[Column]) -> list[Column]:
    """Two levels as one: columns that match are joined, others stay in the order of both."""
    pairs = matches([x.sig for x in a], [x.sig for x in b])
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += a[i:p] + b[j:q]
        if p < len(a):
            a[p].add(b[q], False)
            out.append(a[p])
        i, j = p + 1, q + 1
    return folded(out)


def wrapper_of(trees: list[Node]) -> Node:
    """The wrapper that matches whatever one of the trees (pages or wrappers) matches."""
    root = Node("", "")
    todo: list[tuple[Node, list[Node]]] = [(root, trees)]
    while todo:
        x, sources = todo.pop()
        columns: list[Column] = []
        for k, source in enumerate(sources):
            columns = aligned(columns, level(source)) if k else level(source)
        for c in columns:
            child = Node(c.sig, c.name, False, c.optional or c.seen < len(sources), c.repeated)
            x.children.append(child)
            if c.members:
                todo.append((child, c.members))
    return root


def written(root: Node) -> str:
    """A wrapper as text: a line for each node with its depth, flags, name and sig."""
    lines, todo = [], [(x, 0) for x in reversed(root.children)]
    while todo:
        x, depth = todo.pop()
        lines.append(f"{depth} {x.optional:d}{x.repeated:d} {x.name} {x.sig}")
        todo += [(c, depth + 1) for c in reversed(x.children)]
    return "\n".join(lines)


def read(text: str) -> Node:
    """The wrapper of written()."""
    root = Node("", "")
    path = [root]
    for line in text.split("\n") if text else ():
        depth, flags, name, sig = line.split(" ")
        x = Node(sig, name, False, flags[0] == "1", flags[1] == "1")
        del path[int(depth) + 1 :]
        path[-1].children.append(x)
        path.append(x)
    return root


def expression(root: Node) -> str:
    """The wrapper as a regular expression over tokens: (x)? optional, (x)+ repeated, (x)* both, #text a slot."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(root.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.sig == "#":
            out.append("#text" + "?" * x.optional)
        else:
            mark = ("*" if x.optional else "+") if x.repeated else "?" * x.optional
            out.append(f"({'<'}{x.sig}>" if mark else f"<{x.sig}>")
            todo += [f"</{x.name}>" + (f"){mark}" if mark else ""), *reversed(x.children)]
    return "".join(out)


def step(path: int, sig: str) -> int:
    """The path of an element's child, as a 64-bit hash."""
    return xxhash.xxh64_intdigest(sig, path)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_of(root: Node) -> Iterator[tuple[int, bool, str, int]]:
    """Path of the block, whether it lies in an article or main, its text, and how many of its characters stand in links, for each block that isn't dropped."""
    words: list[str] = []
    links, where, inside = 0, 0, False
    todo: list[tuple[object, int, bool, bool]] = [(root, 0, False, False)]
    while todo:
        x, path, home, link = todo.pop()
        if isinstance(x, str):
            if not words:
                where, inside = path, home
            words.append(htmllib.unescape(x))
            links += len(x) * link
            continue
        if x is None or x.name not in INLINE:
            if text := " ".join("".join(words).split()):
                yield where, inside, text, min(links, len(text))
            words.clear()
            links = 0
        if x is None or x.dropped:
            continue
        if x.name == "br":
            if not words:
                where, inside = path, home
            words.append(" ")
        home, link = home or x.name in ("article", "main"), link or x.name == "a"
        if x.name not in INLINE:
            todo.append((None, path, home, link))
        for c in reversed(x.children):
            block = isinstance(c, Node) and not c.dropped and c.name not in INLINE
            todo.append((c, step(path, c.sig) if block else path, home, link))
    if text := " ".join("".join(words).split()):
        yield where, inside, text, min(links, len(text))


def article_slots(wrapper: Node, varying: dict[int, int], links: dict[int, int]) -> tuple[set[int], set[int]]:
    """Paths of the slots that hold the article on pages without an article or main element, and of all that are no menu. varying, links: characters by path that are no template, and those of them in links."""
    order: list[tuple[Node, int, int]] = []  # node, path, place of its parent
    todo = [(wrapper, 0, -1)]
    while todo:
        x, path, parent = todo.pop()
        order.append((x, path, parent))
        todo += [(c, path if c.name in INLINE else step(path, c.sig), len(order) - 1) for c in x.children if c.sig != "#"]
    block = [x.name not in INLINE for x, _, _ in order]  # texts of inline elements are their block's
    mass, in_links = ([of.get(p, 0) * is_block for (_, p, _), is_block in zip(order, block, strict=True)] for of in (varying, links))
    for k in range(len(order) - 1, 0, -1):
        mass[order[k][2]] += mass[k]
        in_links[order[k][2]] += in_links[k]
    menu = [False] * len(order)
    below: list[list[int]] = [[] for _ in order]
    for k, (x, _, parent) in enumerate(order):
        inside = any(c.repeated for c in x.children) or x.repeated
        menu[k] = parent >= 0 and (menu[parent] or inside and x.name not in INLINE and mass[k] > 0 and in_links[k] >= LINK_SHARE * mass[k])
        if parent >= 0:
            below[parent].append(k)
    weight = [0 if menu[k] else m for k, m in enumerate(mass)]
    splits = [any(c.sig != "#" and c.name not in INLINE for c in x.children) and not any(c.sig == "#" for c in x.children) for x, _, _ in order]
    at = 0
    while inner := [k for k in below[at] if splits[k] and weight[k] > 0 and weight[k] >= ARTICLE_SHARE * weight[0]]:
        at = inner[0]

    def no_menus(k: int) -> set[int]:
        out, todo = set(), [k]
        while todo:
            k = todo.pop()
            if not menu[k]:
                out.add(order[k][1])
                todo += below[k]
        return out

    return no_menus(at), no_menus(0)


def home_slots(wrapper: Node) -> set[int]:
    """Paths of the slots below the wrapper's article and main elements."""
    out, todo = set(), [(wrapper, 0, False)]
    while todo:
        x, path, home = todo.pop()
        home = home or x.name in ("article", "main")
        for c in x.children:
            if c.sig != "#":
                todo.append((c, path if c.name in INLINE else step(path, c.sig), home))
            elif home:
                out.add(path)
    return out


def main_text(root: Node, slots: set[int], others: set[int], home: set[int] = frozenset()) -> str:
    """The text of a page's blocks in slots of its host's wrapper, in lines: in those below article and main; of a page without text there, in the slots given; if there is none either, in the others."""
    blocks = list(blocks_of(root))
    for of in (home, slots, others):
        if lines := [text for path, _, text, _ in blocks if path in of]:
            return "\n".join(lines)
    return ""


def host_of(url) -> F.Column:
    """Lower-case host with its port; "" for null or what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def read_pages(pages: DataFrame) -> DataFrame:
    """What pages (host, html) tell of their hosts: skeletons (host, skeleton, n pages), and of pages without article or main each text (host, path, text, n, its characters and whether in links, and the least and greatest hash of the pages that have it; path 0 and text null: of the pages themselves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeletons: dict[tuple[str, str], int] = {}
        texts: dict[tuple[str, int, int | None], list[int]] = {}

        def out() -> pa.RecordBatch:
            a, b = list(skeletons.items()), list(texts.items())
            columns = [[k[0] for k, _ in a] + [k[0] for k, _ in b], [k[1] for k, _ in a] + [None] * len(b), [None] * len(a) + [k[1] for k, _ in b], [None] * len(a) + [k[2] for k, _ in b], [n for _, n in a] + [v[0] for _, v in b]]
            columns += [[None] * len(a) + [v[i] for _, v in b] for i in (1, 2, 3, 4)]
            skeletons.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)], names)

        for batch in batches:
            for part in by_bytes(batch, "html"):
                for host, page in zip(part.column("host").to_pylist(), filled(part.column("html")).to_pylist(), strict=True):
                    root = parse(page)
                    key = host, written(wrapper_of([root]))
                    skeletons[key] = skeletons.get(key, 0) + 1
                    blocks = list(blocks_of(root))
                    if not any(inside for _, inside, _, _ in blocks):
                        this = signed(xxhash.xxh64_intdigest(page))
                        seen: dict[tuple[int, int | None], tuple[int, int]] = {(0, None): (0, 0)}
                        for path, _, text, linked in blocks:
                            chars, links = seen.get(at := (signed(path), signed(xxhash.xxh64_intdigest(text))), (0, 0))
                            seen[at] = chars + len(text), links + linked
                        for (path, text), (chars, links) in seen.items():
                            have = texts.setdefault((host, path, text), [0, 0, 0, this, this])
                            have[:] = have[0] + 1, have[1] + chars, have[2] + links, min(have[3], this), max(have[4], this)
                if len(skeletons) + len(texts) > HELD:
                    yield out()
        yield out()

    names = ["host", "skeleton", "path", "text", "n", "chars", "links", "low", "high"]
    schema = "host string, skeleton string, path long, text long, n long, chars long, links long, low long, high long"
    return pages.select("host", "html").mapInArrow(run, schema)


def infer_wrappers(skeletons: DataFrame) -> DataFrame:
    """host and wrapper (as written()) from skeletons (host, skeleton): TOGETHER at a time are aligned, in an order of their own, until each host has one."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "skeleton": [written(wrapper_of([read(x) for x in sorted(group["skeleton"])]))]})

    rows = materialise(skeletons.groupBy("host", "skeleton").count().drop("count"), "skeletons")
    while True:
        sizes = materialise(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_parts")).withColumnRenamed("host", "_host"), "sizes")
        last = sizes.where("_parts > 1").isEmpty()
        parted = rows.join(sizes, F.col("host") == F.col("_host")).select("host", "skeleton", F.pmod(F.xxhash64("skeleton"), F.col("_parts")).alias("part"))
        rows = materialise(parted.groupBy("host", "part").applyInPandas(join, "host string, skeleton string"), "wrappers")
        if last:
            return rows.withColumnRenamed("skeleton", "wrapper")


def article_places(found: DataFrame) -> DataFrame:
    """_host and the paths of its wrapper's slots: home (below article and main), and for pages that lack text there slots and others."""
    texts = found.where("skeleton IS NULL").groupBy("host", "path", "text").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("low").alias("low"), F.max("high").alias("high"))
    texts = materialise(texts, "texts")
    pages = texts.where("text IS NULL").select(F.col("host").alias("_host"), F.col("n").alias("_pages"))
    texts = texts.where("text IS NOT NULL").join(pages, F.col("host") == F.col("_host"))
    same = (F.col("n") >= TEMPLATE_SHARE * F.col("_pages")) & (F.col("low") != F.col("high"))
    of = lambda c, which: F.sum(F.when(which, F.col(c)).otherwise(0)).alias
    mass = texts.groupBy("host", "path").agg(of("chars", ~same)("chars"), of("links", ~same)("links"), of("chars", same)("same"))
    wrappers = infer_wrappers(found.where("skeleton IS NOT NULL").select("host", "skeleton"))

    def place(w: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if w.empty:
            return pd.DataFrame({"_host": [], "slots": [], "others": [], "home": []})
        wrapper = read(w["wrapper"].iloc[0])
        if (m["chars"] - m["links"]).sum() < DIFFER_SHARE * m["same"].sum():
            m = m.assign(chars=m["chars"] + m["same"], same=0)
        m = m[m["chars"] >= m["same"]]
        paths = [p % (1 << 64) for p in m["path"].tolist()]
        slots, others = article_slots(wrapper, dict(zip(paths, m["chars"].tolist(), strict=True)), dict(zip(paths, m["links"].tolist(), strict=True)))
        return pd.DataFrame({"_host": [w["host"].iloc[0]], **{c: [sorted(map(signed, x.intersection(paths)))] for c, x in (("slots", slots), ("others", others))}, "home": [sorted(map(signed, home_slots(wrapper)))]})

    return wrappers.groupBy("host").cogroup(mass.groupBy("host")).applyInPandas(place, "_host string, slots array<long>, others array<long>, home array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row.

    Null html and pages without an article's text: "". Null urls and urls without a host make up one host. Repeated rows are extracted one by
    one, and copies of a page make none of its texts template. Pages of any length, depth and width are read whole. Empty table: no rows.
    Other columns are not read.
    """
    rows = pages.select("page_id", "url", F.col("html"), host_of(F.col("url")).alias("host"))
    places = materialise(article_places(materialise(read_pages(rows), "pages")), "places")
    size = places.agg(F.coalesce(F.sum(F.length("_host") + 8 * (F.size("slots") + F.size("others") + F.size("home"))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        places = F.broadcast(places)
    joined = rows.join(places, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "slots", "others", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html"):
                paths = ([{p % (1 << 64) for p in at or ()} for at in part.column(c).to_pylist()] for c in ("slots", "others", "home"))
                texts = [main_text(parse(page), *at) for page, *at in zip(filled(part.column("html")).to_pylist(), *paths, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
