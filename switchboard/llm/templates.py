"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A page is a sequence of tokens: tags (with class or id) and text nodes.  Tokens of a host with the
same occurrence vector (how often each page has them) form a class.  Classes that are
large and frequent, whose tokens come in one order on all pages, and which nest in one another on
all pages are the host's template; what stands between template tokens are the slots.  A page's text
are all slots whose content varies, or those of the article's element if the template has one.

Occurrence vectors are never stored: pages add a hash of (page, count) to two sums for
each token, and equal vectors have equal sums, so a host with a third of all pages needs
no more room than another.  Orders are compared as hashes, by their least and greatest.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard.llm import words as W
from switchboard.session import materialise

#: share of a host's pages that must have a tag, and a text node, of the template
TAG_SUPPORT, TEXT_SUPPORT = 0.5, 0.9
#: a template of so many hosts at most is broadcast, more are joined by a shuffle
BROADCAST_HOSTS = 20_000
#: what a token is
PAGE, TEXT, TAG, MAIN_TAG = range(4)
#: an order that no other equals
NO_ORDER = (-1 << 63, (1 << 63) - 1)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul").split())
ASIDE = frozenset("head title nav aside footer script style noscript template iframe button select option textarea menu dialog svg object".split())
MAIN = frozenset("article main".split())
WHOLE = frozenset("html body".split()) | MAIN
CONTAINERS = frozenset("html body div section center table tbody tr td fieldset details".split()) | MAIN
ASIDE_WORDS = frozenset(("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header "
                         "login menu modal nav navbar navigation newsletter notice popup promo related search share sharing sidebar social sponsor sponsored "
                         "subscribe toolbar widget respond replies").split())
#: asides that never hold an article, however long they are; elements that no name makes an aside inside an article; marks of other elements' names
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 header hgroup section".split())
NOT_OWN = frozenset("has no with without".split())


class Tag:
    """An opening or closing tag; ``key`` is its token, ``words`` those of its names that aside elements have."""

    __slots__ = ("close", "key", "name", "words")

    def __init__(self, close: bool, name: str, attributes: str) -> None:
        self.close, self.name = close, name
        words, parts = [], set()
        if attributes and not close:
            for _, value in NAMED.findall(attributes):
                words += value.strip("\"'").lower().split()
            for word in words:
                own = re.split(r"[^a-z]+", word)
                if own[0] not in NOT_OWN:
                    parts.update(w for before, w in zip(["", *own], own) if before not in NOT_OWN)
        self.key = ("</" if close else "<") + name + "".join(f".{w}" for w in words if not any(c.isdigit() for c in w))
        self.words = parts & ASIDE_WORDS if parts and name not in WHOLE else frozenset()


def tokens(page: str) -> Iterator[Tag | str]:
    """Tags and decoded text nodes in order; comments, scripts, styles and declarations are left out."""
    place = 0
    for m in TOKEN.finditer(page):
        if m.start() > place:
            yield html.unescape(page[place:m.start()])
        place = m.end()
        if m[3]:
            yield Tag(bool(m[2]), m[3].lower(), m[4])
    if place < len(page):
        yield html.unescape(page[place:])


def plain(text: str) -> str:
    return " ".join(text.split())


def token_keys(page: str) -> Counter:
    keys: Counter = Counter()
    for token in tokens(page):
        if isinstance(token, Tag):
            keys[token.key] += 1
        elif text := plain(token):
            keys["=" + text] += 1
    return keys


def key_kind(key: str) -> int:
    return TEXT if key[0] == "=" else MAIN_TAG if re.split(r"[.]", key.lstrip("</"), maxsplit=1)[0] in MAIN else TAG


def key_hash(keys: list[str]) -> np.ndarray:
    data, at = W.text_bytes(pa.array(keys, pa.string()))
    return W.hash_spans(data, at[:-1], at[1:]) if len(data) else np.zeros(len(keys), np.uint64)


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (host, page hash, html) as sums for each (host, token) of a batch: pages, total, and two of the vector.

    The empty token stands for the page itself.
    """
    for batch in batches:
        hosts, pages, texts = (c.to_pylist() for c in batch.columns)
        rows: list[tuple[str, str, int, int, int]] = []
        for host, page, text in zip(hosts, pages, texts, strict=True):
            rows.append((host, "", page, 1, PAGE))
            rows += [(host, key, page, n, key_kind(key)) for key, n in token_keys(text or "").items()]
        table = pa.table({"host": [r[0] for r in rows], "token": pa.array(key_hash([r[1] for r in rows]).view(np.int64)),
                          "kind": pa.array([r[4] for r in rows], pa.int32())})
        mark = W.mix(np.array([r[2] for r in rows], np.int64).view(np.uint64) + np.array([r[3] for r in rows], np.uint64) * np.uint64(W.ODD))
        table = table.append_column("n", pa.array([r[3] for r in rows], pa.int64()))
        for k in (0, 1):  # 31 bits each: sums of thousands of millions of pages fit a long
            table = table.append_column(f"v{k}", pa.array(((mark >> np.uint64(33 * k)) & np.uint64(0x7FFFFFFF)).astype(np.int64)))
        # sums by host and token, so that a large host sends few rows
        found = table.group_by(["host", "token", "kind"]).aggregate([("n", "count"), ("n", "sum"), ("v0", "sum"), ("v1", "sum")])
        yield from found.rename_columns(["host", "token", "kind", "pages", "total", "v0", "v1"]).to_batches()


OCCURRENCE = "host string, token long, kind int, pages long, total long, v0 long, v1 long"


def order_of(found: list[int]) -> tuple[list[int], int] | None:
    """The order of a class's tokens on a page and its hash; None if the order is not the same throughout the page."""
    first = list(dict.fromkeys(found))
    if found != first * (len(found) // len(first)):
        return None
    return first, int.from_bytes(hashlib.blake2b(np.array(first, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)


def crossing(walk: list[tuple[int, int]], length: dict[int, int], rank: list) -> set[int]:
    """Classes to be given up so that the others nest, from the (class, place in its order) of a page's tokens.

    Of two classes that cross the one of the smaller rank goes.
    """
    gone: set[int] = set()
    inside: list[list[int]] = []  # classes whose tokens have begun and not ended, and the places that come next
    for number, place in walk:
        if number in gone:
            continue
        if place:
            at = next(k for k in range(len(inside) - 1, -1, -1) if inside[k][0] == number)
            for other, _ in inside[at + 1:]:
                gone.add(min(number, other, key=rank.__getitem__))
                if number in gone:
                    break
            inside = [e for e in inside if e[0] not in gone]
            if number in gone:
                continue
            inside[-1][1] += 1
        else:
            inside.append([number, 1])
        if inside[-1][1] == length[number]:
            inside.pop()
    return gone


def class_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (host, html, classes) as the least and greatest order of each class, with and without its texts, and whether it crosses others."""
    known: dict[str, tuple] = {}
    for batch in batches:
        seen: dict[tuple[str, int], list] = {}
        for at, (host, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                given = batch.column(2)[at].as_py()
                known[host] = ({t["token"]: (k, t["kind"]) for k, c in enumerate(given) for t in c["tokens"]}, [c["class"] for c in given],
                               [(len(c["tokens"]), -c["class"]) for c in given])
            member, numbers, rank = known[host]
            keys = ["=" + plain(t) if isinstance(t, str) else t.key for t in tokens(page or "")]
            own = [(k, *member[k]) for k in key_hash(keys).view(np.int64).tolist() if k in member]
            whole: dict[int, list[int]] = {}
            tags: dict[int, list[int]] = {}
            for key, number, kind in own:
                whole.setdefault(number, []).append(key)
                if kind != TEXT:
                    tags.setdefault(number, []).append(key)
            orders = {number: (order_of(found), order_of(tags.get(number, found))) for number, found in whole.items()}
            place = {key: k for _, order in orders.values() if order for k, key in enumerate(order[0])}
            walk = [(number, place[key]) for key, number, _ in own if key in place]
            gone = crossing(walk, {number: len(order[0]) for number, (_, order) in orders.items() if order}, rank)
            for number, both in orders.items():
                row = seen.setdefault((host, numbers[number]), [NO_ORDER[1], NO_ORDER[0], NO_ORDER[1], NO_ORDER[0], False])
                for k, order in enumerate(both):
                    least, most = (order[1], order[1]) if order else NO_ORDER
                    row[2 * k], row[2 * k + 1] = min(row[2 * k], least), max(row[2 * k + 1], most)
                row[4] |= number in gone
        yield pa.RecordBatch.from_pylist([dict(zip(ORDERS.names, (*key, *row), strict=True)) for key, row in seen.items()], ORDERS)


ORDERS = pa.schema([("host", pa.string()), ("class", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("tags_least", pa.int64()),
                    ("tags_most", pa.int64()), ("crosses", pa.bool_())])
ORDER = "host string, class long, least long, most long, tags_least long, tags_most long, crosses boolean"


def few_hosts(hosts: DataFrame) -> DataFrame:
    return F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of the host's large and frequent classes that keep their order and nest.

    A class needs at least two tokens: a tag alone says nothing of a template's structure.  If only a class's texts
    break its order, its tags stay; of other classes that fail no tag but ``MAIN`` stays.
    """
    sums = pages.select("host", F.xxhash64("url", "html").alias("page"), "html").mapInArrow(occurrences, OCCURRENCE)
    sums = sums.groupBy("host", "token", "kind").agg(*(F.sum(c).alias(c) for c in ("pages", "total", "v0", "v1")))
    sums = materialise(sums.where(f"pages >= 2 or kind = {PAGE}"), "page-tokens")
    size = sums.where(f"kind = {PAGE}").select("host", F.col("pages").alias("of"))
    frequent = sums.where(f"kind <> {PAGE}").join(size, "host").where(
        F.col("pages") >= F.when(F.col("kind") == TEXT, TEXT_SUPPORT).otherwise(TAG_SUPPORT) * F.col("of"))
    classes = frequent.groupBy("host", "pages", "total", "v0", "v1").agg(
        F.collect_list(F.struct("token", "kind")).alias("tokens")).where(F.size("tokens") >= 2)
    classes = materialise(classes.select("host", F.xxhash64("pages", "total", "v0", "v1").alias("class"), "tokens"), "page-classes")
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("class", "tokens")).alias("classes"))
    orders = pages.select("host", "html").join(few_hosts(by_host), "host").mapInArrow(class_orders, ORDER)
    orders = orders.groupBy("host", "class").agg(*((F.min if "least" in c else F.max)(c).alias(c) for c in ORDERS.names[2:]))
    whole = (F.col("least") == F.col("most")) & ~F.col("crosses")
    tags = (F.col("tags_least") == F.col("tags_most")) & ~F.col("crosses")
    valid = classes.join(orders, ["host", "class"]).select("host", F.transform(F.filter("tokens", lambda t: F.when(
        t["kind"] == MAIN_TAG, True).when(t["kind"] == TAG, tags).otherwise(whole)), lambda t: t["token"]).alias("tokens"))
    return valid.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


class Element:
    """An open element: asides by name around it, the article it is in, its node."""

    __slots__ = ("hard", "main", "name", "node")

    def __init__(self, name: str, hard: int, main: int, node: int) -> None:
        self.name, self.hard, self.main, self.node = name, hard, main, node


class Main:
    """An article or main element: its node, asides by name around it, the article around it (-1: none),
    whether a form or an element named as an aside stands between the two, and characters of text."""

    __slots__ = ("beside", "hard", "name", "node", "outer", "size")

    def __init__(self, name: str, node: int, hard: int, outer: int, beside: bool) -> None:
        self.name, self.node, self.hard, self.outer, self.beside, self.size = name, node, hard, outer, beside, 0


def main_text(page: str, template: frozenset[int] | None) -> str:
    """The blocks of the article, or of all slots that vary, joined by line breaks; without a template every tag counts as one of it.

    A text of the template goes outside articles, unless its template element has text of the page's own as well, whatever the
    number of pages.  A page that would have no text keeps those of the template.

    What may be an aside (a form, a header, or a class, id or role of ``ASIDE_WORDS``) never is one if it holds most of
    the text around it, and never for an article inside it.  Inside an article such names count only for elements of the host's template.
    """
    items = list(tokens(page))
    keys = key_hash([t.key if isinstance(t, Tag) else "=" + plain(t) for t in items]).view(np.int64).tolist()
    fixed = [template is None or k in template for k in keys]
    stack: list[Element] = []
    # of slots: node, text or None at a block's border, asides by name, article, whether it is of the template
    pieces: list[tuple[int, str | None, int, int, bool]] = []
    parents, soft = [-1], [0]  # of nodes: the node around it; 1 for what may be an aside, 2 if it can't hold an article
    mains: list[Main] = []
    size, shared_size = [0], [0]  # characters of text in a node: of its own, of the template
    for item, is_fixed in zip(items, fixed, strict=True):
        top = stack[-1] if stack else Element("", 0, -1, 0)
        if isinstance(item, str):
            shared = bool(stack) and is_fixed and template is not None and bool(item.strip()) and top.main < 0
            pieces.append((top.node, item, top.hard, top.main, shared))
            if top.hard == (mains[top.main].hard if top.main >= 0 else 0):
                (shared_size if shared else size)[top.node] += len(plain(item))
            continue
        if item.name in BLOCK:
            pieces.append((top.node, None, 0, -1, False))
        elif item.name == "br":
            pieces.append((top.node, " ", top.hard, top.main, False))
        if item.name in VOID:
            continue
        if item.close:
            if any(e.name == item.name for e in stack):
                while stack.pop().name != item.name:
                    pass
            continue
        if item.name in BLOCK:  # a block ends an open paragraph
            for k, e in enumerate(stack):
                if e.name == "p":
                    del stack[k:]
                    break
            top = stack[-1] if stack else Element("", 0, -1, 0)
        inside = top.main >= 0
        is_main = is_fixed and item.name in MAIN
        aside = 0
        if item.name == "form" or (item.name == "header" and not inside):
            aside = 1
        elif item.words and not (inside and (item.name in TITLES or template is None or not is_fixed or item.words == {"header"})):
            aside = 2 if item.words & COMMENT_WORDS else 1
        hard = top.hard + (item.name in ASIDE)
        node, main = top.node, top.main
        if aside or is_main or (is_fixed and item.name in CONTAINERS):  # slots nest in it
            node = len(parents)
            parents.append(top.node)
            soft.append(aside)
            size.append(0)
            shared_size.append(0)
        if is_main:
            beside = any(soft[k] for k in path(parents, top.node, mains[main].node if inside else 0))
            mains.append(Main(item.name, node, hard, main, beside))
            main = len(mains) - 1
        stack.append(Element(item.name, hard, main, node))
    for node in range(len(parents) - 1, 0, -1):
        size[parents[node]] += size[node]
        shared_size[parents[node]] += shared_size[node]
    for m in mains:
        m.size = size[m.node]
    # articles inside nav, aside and the like count if there are no others; those inside one another count once
    depth = min((m.hard for m in mains if m.size), default=-1)
    chosen = {k for k, m in enumerate(mains) if m.size and m.hard == depth and not any(mains[o].hard == depth for o in outer(mains, k))}
    lone = {k for k in range(len(mains)) if not any(m.outer == k and m.size and not m.beside and m.hard == mains[k].hard for m in mains)}

    def kept(node: int, hard: int, main: int, shared: bool) -> bool:
        if not chosen:
            return hard == 0 and not (shared and not size[node]) and not any(is_aside(k, 0) for k in path(parents, node, 0))
        while main >= 0:
            own = mains[main]
            if hard != own.hard or any(is_aside(k, own.node) for k in path(parents, node, own.node)):
                return False
            if main in chosen:
                return True
            # an article beside another one's text: a comment, or a link to another page
            around = mains[own.outer] if own.outer >= 0 else None
            if own.beside and around and (around.name == "article" or own.outer not in lone) and any(
                    is_aside(k, around.node) for k in path(parents, parents[own.node], around.node)):
                return False
            node, main = around.node if around else 0, own.outer
        return False

    def is_aside(node: int, around: int) -> bool:
        return soft[node] == 2 or (soft[node] == 1 and 2 * size[node] <= size[around])

    def text_of(with_shared: bool) -> str:
        blocks, block = [], []
        for node, text, hard, main, shared in pieces:
            if text is None:
                blocks.append("".join(block))
                block = []
            elif kept(node, hard, main, shared and not with_shared):
                block.append(text)
        blocks.append("".join(block))
        return "\n".join(b for b in map(plain, blocks) if b)

    text = text_of(False)
    if not text and shared_size[0]:
        for node, more in enumerate(shared_size):
            size[node] += more
        text = text_of(True)
    return text


def path(parents: list[int], node: int, end: int) -> Iterator[int]:
    """``node`` and the nodes around it, up to ``end`` and without it."""
    while node >= 0 and node != end:
        yield node
        node = parents[node]


def outer(mains: list[Main], main: int) -> Iterator[int]:
    while (main := mains[main].outer) >= 0:
        yield main


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (page_id, url, html, host, template) as (page_id, url, text, n_chars)."""
    known: dict[str, frozenset[int] | None] = {}
    for batch in batches:
        texts = []
        for at, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = frozenset(batch.column(4)[at].as_py() or ()) or None
            texts.append(main_text(page or "", known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    Null or empty html gives an empty text; null or odd urls share one host.  A host whose pages show no
    template (a single page, say) is read by its own tags.  Repeated rows stay rows of their own; other
    columns are ignored.
    """
    own = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    templates = few_hosts(materialise(host_templates(own), "page-templates"))
    kind = dict(own.dtypes)["page_id"]
    found = own.join(templates, "host", "left").select("page_id", "url", "html", "host", "template").mapInArrow(
        extracted, f"page_id {kind}, url string, text string, n_chars long")
    return found.withColumnsRenamed({"page_id": id_column, "url": url_column})
