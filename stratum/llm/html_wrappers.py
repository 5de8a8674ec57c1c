"""Operator 8: main text of web pages by inferred site wrappers.

A wrapper is a union-free regular expression over a host's markup, kept as a tree: an
element with its signature (tag, classes, id), whether it is optional or repeated, and its
children; and text slots. It is inferred by aligning pages one after the other. Where the
streams disagree on text, the text becomes a slot; where they disagree on an element, the
element becomes optional, or, if it stands again beside itself, a repeated group. Nothing
is ever a union of alternatives.

Inference covers every page of a host. Pages are aligned inside their partition first, so
one small wrapper per host and batch is all that is shuffled; those are aligned in groups
of at most ``FAN_IN`` per round, so a host with a third of all pages meets in no single
task. Wrappers then go to the pages by a join on host, which Spark broadcasts only when
the wrappers' table is below its size limit.
"""

from __future__ import annotations

import functools
import html
import json
import operator
import re
import zlib
from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import read_table, stage
from stratum.llm.url_rules import url_parts

FAN_IN = 64
OPTIONAL, REPEATED = 1, 2
TEXT, GROUP = "#", "()"
#: Longest run of siblings that is looked for as a repeated group.
GROUP_SIZES = (1, 2, 3, 4)
#: Elements open inside one another at most; what is nested deeper stands beside its parent.
DEPTH = 150
#: Sibling lists whose sizes multiply to more are aligned by their next common elements, not by the most common ones.
ALIGN_CELLS = 1_000_000
#: Constant text is template text only when so many pages were aligned.
CONSTANT_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "noscript", "template")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section "
                   "summary table tbody td tfoot th thead title tr ul".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "title"}
LEFT_OUT = frozenset("head nav header footer aside form button select option dialog menu iframe object svg canvas".split())
LEFT_OUT_WORDS = re.compile(
    r"^(ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|menu\w*|nav\w*|breadcrumb\w*|footer\w*|header|masthead"
    r"|cookie\w*|consent\w*|notice\w*|alert\w*|popup\w*|modal\w*|newsletter\w*|subscri\w*|share|sharing|social\w*|related\w*"
    r"|comments?|commentlist|disqus\w*|repl(?:y|ies)|search\w*|login|complementary|contentinfo|navigation)$")
MAIN = re.compile(r"^(article|main)$")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    # a quote opens a value only behind an equals sign; a stray one is a character like others
    r"""|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>=]+|=)*)(?:>|\Z)""", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _signature(tag: str, attrs: str) -> str:
    words = set()
    for name, a, b, c in _ATTR.findall(attrs):
        words.update(re.sub(r"\d+", "9", w.lower()) for w in (a or b or c).split())
    return ".".join([tag, *sorted(words)])


def parse(page: str) -> list:
    """The page as a tree: [signature, children] and text strings; scripts, styles and comments are gone."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    too_deep: Counter[str] = Counter()
    at = 0

    def close(tags: frozenset | set, until: frozenset | set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    def text(s: str) -> None:
        if s.strip():
            stack[-1][1].append(s)
        elif s and stack[-1][1]:
            stack[-1][1].append(" ")

    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if too_deep[tag]:
                too_deep[tag] -= 1
            else:
                close({tag}, set())
            continue
        if tag in CLOSES_P:
            close({"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            close(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "tbody", "thead"})
        kids: list = []
        stack[-1][1].append([_signature(tag, m[4]), kids])
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            if len(stack) < DEPTH:
                stack.append((tag, kids))
            else:
                too_deep[tag] += 1
    text(page[at:])
    return root


# ---------------------------------------------------------------- wrapper inference
# an element is [signature, flags, children]; a group [GROUP, flags, children];
# a text slot [TEXT, flags, lowest hash, highest hash of its texts, pages that have it at least]


def text_hash(text: str) -> int:
    return zlib.crc32(" ".join(html.unescape(text).split()).encode())


def wrapper_of(tree: list) -> list:
    """The wrapper of one page, its repeated siblings already folded."""
    out = []
    for node in tree:
        if isinstance(node, str):
            if node.strip():
                h = text_hash(node)
                out.append([TEXT, 0, h, h, 1])
        else:
            out.append([node[0], 0, wrapper_of(node[1])])
    return fold(out)


def _join(a: list, b: list, pages=operator.add) -> list:
    """Two aligned nodes as one; ``pages`` is max where both may be of the same pages."""
    if a[0] == TEXT:
        return [TEXT, a[1] | b[1], min(a[2], b[2]), max(a[3], b[3]), pages(a[4], b[4])]
    return [a[0], a[1] | b[1], align(a[2], b[2], pages)]


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != GROUP or [x[0] for x in a[2]] == [x[0] for x in b[2]])


def fold(nodes: list) -> list:
    """Runs of equal siblings, or of equal stretches of siblings, as repeated groups."""
    for size in GROUP_SIZES:
        if len(nodes) < 2 * size:
            break
        out: list = []
        for node in nodes:
            out.append(node)
            if size == 1:
                if len(out) > 1 and node[0] != TEXT and _same(out[-2], node):
                    last = out.pop()
                    out[-1] = _join(out[-1], last, max)
                    out[-1][1] |= REPEATED
                continue
            tail = out[-size:]
            if len(tail) == size and len(out) > size and out[-size - 1][0] == GROUP and len(out[-size - 1][2]) == size \
                    and all(_same(x, y) for x, y in zip(out[-size - 1][2], tail, strict=True)):
                del out[-size:]
                out[-1] = [GROUP, out[-1][1], [_join(x, y, max) for x, y in zip(out[-1][2], tail, strict=True)]]
            elif len(out) >= 2 * size and all(x[0] != GROUP and _same(x, y) for x, y in
                                              zip(out[-2 * size:-size], tail, strict=True)):
                pairs = list(zip(out[-2 * size:-size], tail, strict=True))
                del out[-2 * size:]
                out.append([GROUP, REPEATED, [_join(x, y, max) for x, y in pairs]])
        nodes = out
    return nodes


def align(a: list, b: list, pages=operator.add) -> list:
    """Two sibling lists as one: common nodes joined in order, the others optional."""
    if [x[0] for x in a] == [x[0] for x in b] and all(_same(x, y) for x, y in zip(a, b, strict=True)):
        return [_join(x, y, pages) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    if n * m > ALIGN_CELLS:
        return fold(_align_long(a, b, pages))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and _same(a[i], b[j]):
            out.append(_join(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], a[i][1] | OPTIONAL, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], b[j][1] | OPTIONAL, *b[j][2:]])
            j += 1
    return fold(out)


def _shape(node: list) -> tuple:
    return node[0], tuple(x[0] for x in node[2]) if node[0] == GROUP else ()


def _align_long(a: list, b: list, pages) -> list:
    """Long sibling lists as one, in memory of their length: at a difference the list goes on in which
    the other's element comes sooner."""
    at_a: dict[tuple, list[int]] = {}
    at_b: dict[tuple, list[int]] = {}
    for places, nodes in ((at_a, a), (at_b, b)):
        for k, node in enumerate(nodes):
            places.setdefault(_shape(node), []).append(k)

    def ahead(places: dict, node: list, start: int) -> float:
        some = places.get(_shape(node), [])
        k = bisect_left(some, start)
        return some[k] - start if k < len(some) else float("inf")

    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b):
            if _same(a[i], b[j]):
                out.append(_join(a[i], b[j], pages))
                i, j = i + 1, j + 1
                continue
            # to drop a[i] pays off where b[j] stands soon in a
            from_a = ahead(at_a, b[j], i) <= ahead(at_b, a[i], j)
        else:
            from_a = i < len(a)
        node = a[i] if from_a else b[j]
        out.append([node[0], node[1] | OPTIONAL, *node[2:]])
        i, j = (i + 1, j) if from_a else (i, j + 1)
    return out


# ---------------------------------------------------------------- extraction


@functools.lru_cache(maxsize=4096)
def left_out(signature: str) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment by tag or class."""
    tag, *words = signature.split(".")
    if tag in LEFT_OUT:
        return True
    if tag in ("body", "html", "main"):
        return False
    if tag != "article":  # an article may say in parts of its class names what it has
        words = [part for word in words for part in (word, *re.split("[-_]", word))]
    return any(map(LEFT_OUT_WORDS.match, words))


def is_main(signature: str) -> bool:
    tag, *_ = signature.split(".")
    return bool(MAIN.match(tag)) or "main" in signature.split(".")[1:]


@functools.lru_cache(maxsize=4096)
def is_region(signature: str) -> bool:
    """Whether an element is left out by its tag, or by a class that is or begins with such a word.

    "sidebar-left" is a sidebar, while "has-sidebar" may be what surrounds it and the article.
    """
    tag, *words = signature.split(".")
    return tag in LEFT_OUT or tag not in ("body", "html", "main") and any(
        LEFT_OUT_WORDS.match(part) for word in words for part in (word, re.split("[-_]", word)[0]))


def find_main(nodes: list, opened: set[int], every: bool = False) -> tuple[bool, bool]:
    """Whether a page has a main element outside the regions that are left out, and one that is no region itself.

    Left-out elements around one of the latter are added to ``opened`` by ``id``: those that only
    mention a region, and with ``every`` all but the tags that are always left out (a form
    may be around the whole page).
    """
    found = proper = False
    for node in nodes:
        if isinstance(node, str):
            continue
        inner, own = find_main(node[1], opened, every), is_main(node[0])
        solid = inner[1] or own and not is_region(node[0])
        if left_out(node[0]):
            tag = node[0].split(".")[0]
            if not solid or is_region(node[0]) and not (every and (tag == "form" or tag not in LEFT_OUT)):
                continue
            opened.add(id(node))
        found, proper = found or own or inner[0], proper or solid
    return found, proper


def varies(wrapper: list) -> bool:
    """Whether any text slot outside the left-out regions differs between pages."""
    return any(x[2] != x[3] if x[0] == TEXT else (x[0] == GROUP or not left_out(x[0])) and varies(x[2]) for x in wrapper)


def is_template(slot: list, text: str) -> bool:
    """Whether a text is its slot's only one, on enough pages."""
    return slot[4] >= CONSTANT_PAGES and slot[2] == slot[3] == text_hash(text)


def _flat(wrapper: list) -> list:
    return [y for x in wrapper for y in (_flat(x[2]) if x[0] == GROUP else [x])]


def extract(tree: list, wrapper: list, n_pages: int) -> str:
    """The main text of a page that the wrapper matches, a line for each block.

    A page with a main element gives the text of that, any other all that is no template text.
    """
    opened: set[int] = set()
    main, _ = find_main(tree, opened)
    out = _text(tree, wrapper, n_pages, main, opened)
    if not out:  # the article may stand inside an element that is named like a region
        main, proper = find_main(tree, opened, every=True)
        out = _text(tree, wrapper, n_pages, main, opened) if proper else out
    return out


def _text(tree: list, wrapper: list, n_pages: int, inside_main: bool, opened: set[int]) -> str:
    drop_constant = not inside_main and n_pages >= CONSTANT_PAGES and varies(wrapper)
    blocks: list[list[str]] = [[]]

    def walk(nodes: list, slots: list, main: bool) -> None:
        slots, at = _flat(slots), 0
        for node in nodes:
            name = TEXT if isinstance(node, str) else node[0]
            # the wrapper's next place for this node; a repeated group begins anew
            places = [k for k in range(len(slots)) if slots[k][0] == name]
            place = next((k for k in places if k >= at), places[0] if places else None)
            if isinstance(node, str):
                if main or not inside_main and not (drop_constant and place is not None and node.strip()
                                                    and is_template(slots[place], node)):
                    blocks[-1].append(node)
                at = at if place is None else place
                continue
            tag = name.split(".")[0]
            if tag in BLOCKS:
                blocks.append([])
            elif tag == "br":
                blocks[-1].append(" ")
            if not left_out(name) or id(node) in opened:
                walk(node[1], slots[place][2] if place is not None else [], main or is_main(name))
            if tag in BLOCKS:
                blocks.append([])
            at = at if place is None else place

    walk(tree, wrapper, False)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


# ---------------------------------------------------------------- on Spark

_WRAPPER_DDL = "host string, n_pages long, wrapper string"


def _aligned(items: list[tuple[int, list]]) -> tuple[int, list]:
    n, out = items[0]
    for more, other in items[1:]:
        n, out = n + more, align(out, other)
    return n, out


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper per host from ``host, html``: ``host, n_pages, wrapper`` (JSON)."""

    def within_batch(batches):
        for batch in batches:
            found: dict[str, tuple[int, list]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = wrapper_of(parse(page.as_py()))
                n, out = found.get(host, (0, own))
                found[host] = (n + 1, align(out, own) if n else own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([n for n, _ in found.values()], pa.int64()),
                 pa.array([json.dumps(w) for _, w in found.values()], pa.string())], names=["host", "n_pages", "wrapper"])

    def together(key, pdf):
        pdf = pdf.sort_values(["n_pages", "wrapper"])
        n, out = _aligned([(int(n), json.loads(w)) for n, w in zip(pdf["n_pages"], pdf["wrapper"], strict=True)])
        return pd.DataFrame({"host": [key[0]], "n_pages": [n], "wrapper": [json.dumps(out)]})

    table = stage(pages.select("host", "html").mapInArrow(within_batch, _WRAPPER_DDL))
    while True:
        most = table.groupBy("host").count().agg(F.max("count").alias("n")).first()["n"] or 0
        if most <= 1:
            return table
        salts = -(-most // FAN_IN)
        salted = table.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)) if salts > 1 else F.lit(0))
        table = stage(salted.groupBy("host", "salt").applyInPandas(together, _WRAPPER_DDL))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``.

    Defined cases: a null or empty html has an empty text; pages without a host (null url,
    or none in it) share one wrapper; markup that is cut off or badly nested is read as far
    as it goes; null ids stay null; repeated rows give repeated results; an empty table
    gives an empty result; further columns are ignored.
    """
    host, _, _ = url_parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host.alias("host"),
                        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    wrappers = infer_wrappers(rows)
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("page_id", "url")}

    def run(batches):
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, wrapper, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                source = wrapper.as_py() or "[]"
                if source not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[source] = json.loads(source)
                texts.append(extract(parse(page.as_py()), known[source], n or 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper", "n_pages")
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html_wrappers(spark, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
