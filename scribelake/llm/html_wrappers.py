"""Main text of web pages by wrappers inferred per host.

A page's token stream (block tags and texts; inline tags are no tokens) is folded into a union-free expression: adjacent equal runs
become repeated groups. Streams of one host are aligned one after another; where they differ, the tokens of one side become optional or
a repeated group, and differing texts become slots. A text that nearly all pages of a host hold at the same kind of element is part of its
template: a literal token of the expression, like a tag. What comes out is the host's wrapper: an expression without unions that all its
pages match. It tells where the varying text is: the path that holds it is extracted from each page, without the parts that are menus,
notices and so on by tag or name, without hidden elements, and without the template's own texts.

Streams are aligned inside each task first, page by page; equal partial wrappers of a host are then counted once, and the others are
merged in two steps (``SALTS`` groups per host, then one), so no host's pages meet in one task. Names (classes and ids) that are on
fewer than ``SHARE`` of a host's pages are no part of its template and are left out before, so the number of names in a wrapper is
bounded by what a page holds and not by the number of pages. Nothing recurses: a page may nest as deep as it likes.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scribelake.session import checkpointed

SALTS = 32
#: Measured size up to which the hosts' paths are sent to all executors instead of moving the pages.
BROADCAST_BYTES = 8 << 20
#: Wrappers a task keeps before it passes them on.
HOSTS_HELD = 2_000
#: Share of a host's pages that a label with a name must be on; a host's kept labels are at most 1 / SHARE times those of a mean page.
SHARE = 0.05
#: Share of a host's pages that a text must be on to be part of its template, of at least so many pages.
TEMPLATE = 0.95
TEMPLATE_PAGES = 20
#: Sequences whose alignment table would have more cells are aligned by looking ahead.
CELLS = 1 << 20
AHEAD = 64
#: Labels a task counts before it passes them on.
LABELS_HELD = 200_000
#: Share of a container's varying text that one child must hold for the search to go on inside it.
MOST = 0.7

# Elements by role, as in the HTML standard.
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
NOT_TEXT = set("head script style noscript template iframe object svg math canvas nav aside footer form button select menu dialog audio video".split())
#: An opening tag ends an open element of the same kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Never outside by name: their classes speak of the whole page.
WHOLE = set("html body main article".split())
#: What may stand beside such a word in a compound (ad-slot, cookie-notice-inner); any other word makes it a name of its own.
HOLDERS = set("area bar block box button buttons container form header inner item items link links list outer section site slot unit wrap wrapper".split())
#: Class tokens, ids and roles that name parts outside the article.
OUTSIDE = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus respond replies share sharing "
    "social related recommended newsletter subscribe subscription signup login search pagination pager widget".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPEAKING = re.compile(r"class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORDS = re.compile(r"[^\W\d_]+")


def _outside(names: str) -> bool:
    """Whether one of the names is, as a whole, a word of ``OUTSIDE`` or a compound of such words and ``HOLDERS``; digits are no words."""
    for name in names.split():
        words = set(_WORDS.findall(name))
        if words & OUTSIDE and words <= OUTSIDE | HOLDERS:
            return True
    return False


def _attributes(html: str, at: int) -> tuple[str, int]:
    """The attributes after a tag's name, and the place behind its end; a > in quotes does not end it."""
    stop, quote = at, ""
    while True:
        end = html.find(">", stop)
        if end < 0:
            return html[at:], len(html)
        for c in re.findall(r"[\"']", html[stop:end]):
            quote = "" if c == quote else quote or c
        stop = end + 1
        # A quote that is never closed ends with the tag.
        if not quote or html.find(quote, stop) < 0:
            return html[at:end], stop


def _spoken(attributes: str) -> tuple[str, bool]:
    """The names (class, id, role) of a tag's attributes, in lower case, and whether they hide the element."""
    names, unseen = [], False
    if _SPEAKING.search(attributes):
        for key, value in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            value = value.strip("\"'")
            if key in ("class", "id", "role"):
                names.append(value.lower())
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
                unseen = True
    return " ".join(names), unseen


def events(html: str) -> Iterator[tuple[str, str, bool]]:
    """``("open", label, outside)``, ``("close", label, False)`` and ``("text", text, False)`` in page order, well nested; ``("hide", "",
    True)`` and ``("show", "", False)`` around inline elements that are no article text.

    A label is the tag with its class or id, digits aside; ``outside`` marks elements that are no article text.
    """
    open_: list[tuple[str, str, str]] = []  # tag, label, and what to say when it ends
    count: dict[str, int] = {}  # open elements by tag

    def push(tag: str, label: str, end: str) -> None:
        open_.append((tag, label, end))
        count[tag] = count.get(tag, 0) + 1

    def pop() -> tuple[str, str, str]:
        top = open_.pop()
        count[top[0]] -= 1
        return top

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            yield "text", text, False
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        attributes, at = _attributes(html, at)
        if m[1]:
            if count.get(tag):
                while True:
                    t, label, end = pop()
                    if end:
                        yield end, label, False
                    if t == tag:
                        break
            continue
        names, unseen = _spoken(attributes) if "=" in attributes or "hidden" in attributes.lower() else ("", False)
        if tag in INLINE:
            if tag == "br":
                yield "text", " ", False
            elif unseen or _outside(names):
                push(tag, "", "show")
                yield "hide", "", True
            elif count.get(tag):  # inside a hidden one of its kind: its end is not that one's
                push(tag, "", "")
            continue
        while open_ and (open_[-1][0] in SIBLINGS.get(tag, ()) or (open_[-1][0] == "p" and tag in ENDS_P)):
            yield "close", pop()[1], False
        label = tag + ("." + re.sub(r"\d+", "0", names.split()[0]) if names.split() else "")
        outside = tag in NOT_TEXT or (tag not in WHOLE and _outside(names)) or (unseen and tag not in ("html", "body"))
        outside = outside or (tag == "header" and not (count.get("article") or count.get("main")))
        yield "open", label, outside
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in RAW:
            yield "close", label, False
        elif tag in RAW:
            close = re.compile(rf"</{tag}\s*>|</{tag}\b[^>]*>|\Z", re.I).search(html, at)
            at = close.end()
            yield "close", label, False
        else:
            push(tag, label, "close")
    while open_:
        _, label, end = pop()
        if end:
            yield end, label, False


def _block(words: list[str]) -> str:
    return " ".join(unescape("".join(words)).split())


def text_key(label: str, block: str) -> str:
    """A text as a token of a template: a digest of it and of the tag it stands in."""
    import xxhash

    return "=" + xxhash.xxh3_64_hexdigest(label.split(".")[0].rstrip("!") + "\n" + block)


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) | 1 << 32


# A wrapper is a list of nodes [label, optional, repeated, text, chars, below]. Text has label "#" and its hash, 0 for a slot; a text of the
# template has its key as label; chars counts varying characters. ``below`` lists sequences of nodes that are still to be aligned with each
# other; when a wrapper is settled, every node has one.


def _join(a: list, b: list) -> None:
    """Take ``b`` into ``a``, whose list of sequences is its own."""
    slot = a[0] == "#" and (a[3] == 0 or a[3] != b[3])
    a[1:5] = a[1] or b[1], a[2] or b[2], 0 if slot else a[3], a[4] + b[4]
    a[5].extend(b[5])


def _joined(a: list, b: list) -> list:
    out = [*a[:5], list(a[5])]
    _join(out, b)
    return out


def _folded(nodes: list) -> list:
    """Adjacent equal runs of up to three nodes become one repeated group."""
    for period in (1, 2, 3):
        out, i = [], 0
        while i < len(nodes):
            run = nodes[i : i + period]
            j = i + period
            while len(run) == period and [x[0] for x in nodes[j : j + period]] == [x[0] for x in run] and (period > 1 or run[0][0] != "#"):
                if j == i + period:
                    run = [[*x[:5], list(x[5])] for x in run]
                for x, y in zip(run, nodes[j : j + period]):
                    _join(x, y)
                j += period
            if j > i + period:
                if period == 1:
                    run[0][2] = True
                    out += run
                else:
                    out.append(["(" + " ".join(x[0] for x in run) + ")", False, True, 0, 0, [run]])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal labels, rising on both sides: as many as there can be, or found by looking ahead where that takes too long."""
    n, m, found = len(a), len(b), []
    if n * m > CELLS:
        i = j = 0
        while i < n and j < m:
            # The nearest equal labels, by what is skipped on both sides together; none near: one label of each is skipped.
            near = ((i + k, j + d - k) for d in range(AHEAD) for k in range(d + 1) if i + k < n and j + d - k < m and a[i + k] == b[j + d - k])
            i, j = next(near, (-i - 1, -j - 1))
            if i < 0:
                i, j = -i, -j
            else:
                found.append((i, j))
                i, j = i + 1, j + 1
        return found
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def _level(a: list, b: list) -> list:
    """Two sequences as one: common labels in order are joined, all others become optional."""
    left, right = [x[0] for x in a], [x[0] for x in b]
    if left == right:
        return [_joined(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for k, l in [*_common(left, right), (len(a), len(b))]:
        out += [[x[0], True, *x[2:]] for x in (*a[i:k], *b[j:l])]
        if k < len(a):
            out.append(_joined(a[k], b[l]))
        i, j = k + 1, l + 1
    return _folded(out)


def aligned(*sequences: list) -> list:
    """Wrappers as one, level by level."""
    root: list = []
    work = [(root, list(sequences))]
    while work:
        below, todo = work.pop()
        level = todo[0]
        for other in todo[1:]:
            level = _level(level, other)
        below[:] = [level]
        work += [(x[5], list(x[5])) for x in level if x[5]]
    return root[0]


def to_json(wrapper: list) -> str:
    """Nodes with the place of their parent (-1 for none), parents first."""
    rows: list[list] = []
    work = [(x, -1) for x in reversed(wrapper)]
    while work:
        node, parent = work.pop()
        rows.append([parent, *node[:5]])
        at = len(rows) - 1
        work += [(x, at) for x in reversed(node[5][0] if node[5] else [])]
    return json.dumps(rows, separators=(",", ":"))


def from_json(text: str) -> list:
    root: list = []
    nodes: list[list] = []
    for parent, *own in json.loads(text):
        nodes.append([*own, []])
        if parent < 0:
            root.append(nodes[-1])
        elif nodes[parent][5]:
            nodes[parent][5][0].append(nodes[-1])
        else:
            nodes[parent][5].append([nodes[-1]])
    return root


def _known(label: str, names: set[str] | None) -> str:
    """The label, or its bare tag if its name is not among the host's; without ``names`` all are."""
    return label if names is None or label in names else label.split(".")[0]


def page_wrapper(html: str, names: set[str] | None = None, template: frozenset[str] | set[str] = frozenset()) -> list:
    """One page's expression; names other than ``names`` are left out, texts of the ``template`` are literal tokens."""
    stack: list[list] = [["", []]]
    words: list[str] = []
    unseen = 0

    def end_text() -> None:
        text = _block(words) if words else ""
        words.clear()
        if text:
            key = text_key(stack[-1][0], text) if template else ""
            stack[-1][1].append([key, False, False, 0, 0, []] if key in template else ["#", False, False, hash_of(text), len(text), []])

    for kind, value, outside in events(html):
        if kind == "text":
            if not unseen:
                words.append(value)
            continue
        if kind in ("hide", "show"):
            unseen += 1 if kind == "hide" else -1
            continue
        end_text()
        if kind == "open":
            stack.append([_known(value, names) + ("!" if outside else ""), []])
        else:
            label, parts = stack.pop()
            stack[-1][1].append([label, False, False, 0, 0, [_folded(parts)] if parts else []])
    end_text()
    return aligned(_folded(stack[0][1]))


def main_path(wrapper: list) -> list[str]:
    """Labels from the root to the container of the article.

    The widest article or main element is one if it holds at least half of the varying text; otherwise the search goes down while one child
    holds most of it.
    """
    nodes: list[list] = []
    above: list[int] = []
    work = [(x, -1) for x in reversed(wrapper)]
    while work:
        node, parent = work.pop()
        nodes.append(node)
        above.append(parent)
        at = len(nodes) - 1
        work += [(x, at) for x in reversed(node[5][0] if node[5] else [])]
    weight = [x[4] if x[0] == "#" and x[3] == 0 else 0 for x in nodes]
    below: list[list[int]] = [[] for _ in nodes]
    top: list[int] = []
    for at in range(len(nodes) - 1, -1, -1):
        if nodes[at][0].endswith("!"):
            weight[at] = 0
        (below[above[at]] if above[at] >= 0 else top).append(at)
        if above[at] >= 0:
            weight[above[at]] += weight[at]
    total = sum(weight[at] for at in top)
    # Inside an element that is no article text, or inside an article already found.
    shut = [False] * len(nodes)
    best = None
    for at, node in enumerate(nodes):
        shut[at] = (above[at] >= 0 and shut[above[at]]) or node[0].endswith("!")
        if not shut[at] and node[0].split(".")[0] in ("article", "main"):
            shut[at] = True
            if best is None or weight[at] > weight[best]:
                best = at
    path: list[str] = []
    if best is not None and 2 * weight[best] >= total:
        while best >= 0:
            if nodes[best][0][0] != "(":
                path.append(nodes[best][0])
            best = above[best]
        return path[::-1]
    while True:
        within = sum(weight[at] for at in top)
        most = max((at for at in reversed(top) if nodes[at][0] != "#"), key=weight.__getitem__, default=None)
        if most is None or not within or weight[most] < MOST * within or nodes[most][2]:
            return path
        # A text block is part of what is looked for; only containers are gone into.
        if 2 * sum(weight[at] for at in below[most] if nodes[at][0] == "#") > weight[most]:
            return path
        if nodes[most][0][0] != "(":
            path.append(nodes[most][0])
        top = below[most]


def extract(html: str | None, path: list[str], names: set[str] | None = None, template: frozenset[str] | set[str] = frozenset()) -> str:
    """The blocks of a page under ``path`` (or its own article, or all of it), joined by an empty line.

    Texts of the ``template`` are left out, unless they are more than half of what there is: then the page is a copy of others rather than
    made from a template. If all text is outside by name, it is that of the widest element so named: a page is not emptied by a class.
    """
    if not html:
        return ""
    texts: dict[str, list[tuple[str, bool]]] = {"path": [], "article": [], "page": []}
    named: list[list[str]] = []
    words: list[str] = []
    stack: list[tuple[bool, bool, bool]] = []
    labels: list[str] = []
    hidden = inside = articles = never = unseen = 0

    def end_block() -> None:
        block = _block(words) if words else ""
        words.clear()
        if not block:
            return
        if hidden:
            named[-1].append(block)
            return
        item = (block, bool(template) and text_key(labels[-1] if labels else "", block) in template)
        texts["page"].append(item)
        if articles:
            texts["article"].append(item)
        if inside:
            texts["path"].append(item)

    for kind, value, outside in events(html):
        if kind == "text":
            if not unseen and not never:
                words.append(value)
            continue
        if kind in ("hide", "show"):
            unseen += 1 if kind == "hide" else -1
            continue
        end_block()
        tag = value.split(".")[0]
        if kind == "open":
            labels.append(_known(value, names) + ("!" if outside else ""))
            article = tag in ("article", "main") and not outside
            on_path = bool(path) and len(labels) == len(path) and labels == path
            stack.append((outside, on_path, article))
            if outside and not hidden:
                named.append([])
            never += tag in NOT_TEXT
            hidden, inside, articles = hidden + outside, inside + on_path, articles + article
        else:
            labels.pop()
            never -= tag in NOT_TEXT
            outside, on_path, article = stack.pop()
            hidden, inside, articles = hidden - outside, inside - on_path, articles - article
    end_block()
    chosen = next((texts[k] for k in ("path", "article", "page") if texts[k]), [])
    own = [block for block, fixed in chosen if not fixed]
    if 2 * sum(map(len, own)) < sum(len(block) for block, _ in chosen):
        own = [block for block, _ in chosen]
    return "\n\n".join(own or max(named, key=lambda blocks: sum(map(len, blocks)), default=[]))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in rows.sort_values("wrapper")["wrapper"]:
        whole = from_json(text) if whole is None else aligned(whole, from_json(text))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [to_json(whole)]})


def page_tokens(html: str) -> set[str]:
    """What may be part of a template: labels with a name, and keys of the texts outside hidden parts."""
    found: set[str] = set()
    words: list[str] = []
    stack: list[tuple[str, bool]] = []
    hidden = unseen = 0

    def end_block() -> None:
        block = _block(words) if words else ""
        words.clear()
        if block:
            found.add(text_key(stack[-1][0] if stack else "", block))

    for kind, value, outside in events(html):
        if kind == "text":
            if not hidden and not unseen:
                words.append(value)
        elif kind in ("hide", "show"):
            unseen += 1 if kind == "hide" else -1
        else:
            end_block()
            if kind == "open":
                stack.append((value, outside))
                hidden += outside
                if "." in value:
                    found.add(value)
            else:
                hidden -= stack.pop()[1]
    end_block()
    return found


def template_tokens(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, names, template``, JSON arrays, stored: labels with a name on at least ``SHARE`` of a host's pages, and keys of the texts on
    at least ``TEMPLATE`` of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], int] = {}

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame({"host": [k[0] for k in held], "label": [k[1] for k in held], "n": list(held.values())})
            held.clear()
            return out

        for batch in batches:
            for host, html in zip(batch["host"], batch["html"]):
                if html:
                    # The empty label counts the pages.
                    for label in {"", *page_tokens(html)}:
                        held[host, label] = held.get((host, label), 0) + 1
                    if len(held) >= LABELS_HELD:
                        yield passed_on()
        if held:
            yield passed_on()

    plain = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    counts = checkpointed(plain.mapInPandas(count, "host string, label string, n bigint").groupBy("host", "label").agg(F.sum("n").alias("n")).where("n > 1 OR label NOT LIKE '=%'"))
    total = checkpointed(counts.where("label = ''").select("host", F.col("n").alias("pages")))
    is_text = F.col("label").startswith("=")
    enough = F.when(is_text, (F.col("n") >= TEMPLATE * F.col("pages")) & (F.col("pages") >= TEMPLATE_PAGES)).otherwise(F.col("n") >= SHARE * F.col("pages"))
    often = total.join(counts, "host").where((F.col("label") == "") | enough)
    kept = F.sort_array(F.collect_list("label"))
    names, texts = F.filter(kept, lambda x: (x != "") & ~x.startswith("=")), F.filter(kept, lambda x: x.startswith("="))
    return checkpointed(often.groupBy("host").agg(F.to_json(names).alias("names"), F.to_json(texts).alias("template")))


def _with_host(rows: DataFrame, facts: DataFrame, spread_by: list[str]) -> DataFrame:
    """Rows joined with the one row of their host."""
    size = facts.agg(F.sum(sum((F.octet_length(c) for c in facts.columns), F.lit(64)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), "host", "left")
    # Pages of a host are spread over SALTS keys; its one short row goes to each.
    spread = rows.withColumn("salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
    each = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    return spread.join(each, ["host", "salt"], "left").drop("salt")


def _sets(column: pd.Series) -> dict[str, set[str]]:
    return {x: set(json.loads(x)) for x in column.dropna().unique()}


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", tokens: DataFrame | None = None) -> DataFrame:
    """``host, wrapper``: one wrapper (JSON) per host; pages without a host share the empty one."""
    tokens = template_tokens(pages, url_col, html_col) if tokens is None else tokens

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame({"host": list(held), "wrapper": [to_json(w) for w in held.values()]})
            held.clear()
            return out

        for batch in batches:
            names, template = _sets(batch["names"]), _sets(batch["template"])
            for host, html, own, fixed in zip(batch["host"], batch["html"], batch["names"], batch["template"]):
                if html:
                    one = page_wrapper(html, names.get(own, set()), template.get(fixed, set()))
                    held[host] = aligned(held[host], one) if host in held else one
                    if len(held) >= HOSTS_HELD:
                        yield passed_on()
        if held:
            yield passed_on()

    schema = "host string, wrapper string"
    hosted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    partial = _with_host(hosted, tokens, ["url", "html"]).select("host", "html", "names", "template").mapInPandas(infer, schema).distinct()
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return salted.groupBy("host", "salt").applyInPandas(_merge_group, schema).groupBy("host").applyInPandas(_merge_group, schema)


@F.pandas_udf(StringType())
def _paths(wrapper: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(main_path(from_json(w))) for w in wrapper], dtype=object)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text`` for every row of ``pages``; a null or empty page has an empty text.

    Elements that their attributes hide (``hidden``, ``aria-hidden``, ``display: none``) are no text; nor are texts that nearly all pages of a
    host of ``TEMPLATE_PAGES`` pages or more hold in the same kind of element, unless they are most of a page. A page may nest to any depth.
    Repeated rows and null ids are rows like any other; an empty input gives an empty result. Other columns are not read.
    """
    tokens = template_tokens(pages, url_col, html_col)
    # One short row per host.
    paths = checkpointed(wrappers(pages, url_col, html_col, tokens).select("host", _paths("wrapper").alias("path")).join(tokens, "host"))

    @F.pandas_udf(StringType())
    def text_of(html: pd.Series, path: pd.Series, names: pd.Series, template: pd.Series) -> pd.Series:
        paths = {p: json.loads(p) for p in path.dropna().unique()}
        known, fixed = _sets(names), _sets(template)
        rows = zip(html, path, names, template)
        return pd.Series([extract(h, paths.get(p, []), known.get(x, set()), fixed.get(t, set())) for h, p, x, t in rows], dtype=object)

    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    hosted = plain.withColumn("host", host_of(F.col("url")))
    return _with_host(hosted, paths, ["id", "url"]).select("id", "url", text_of("html", "path", "names", "template").alias("text"))
