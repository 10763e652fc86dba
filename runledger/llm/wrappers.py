"""Main text of pages by union-free regular expressions, inferred for each host.

A page becomes a token stream (tags with their class and role, texts) and, with the end tags that HTML lets out put in, a
tree. An expression is inferred by aligning streams: equal neighbours, or equal runs of up to ``RUN`` neighbours,
are a repeated group (a)+; what one side lacks is optional (a)?; texts that differ are a slot #. Sentences that are equal on
all pages are constants: a block keeps the hashes of its sentences, a repeated group has those of all its members, and
what an aligned page lacks is struck out, so that the sentences of all pages are left. Digits in names count as one,
and of ids only those count that tell what a part is, as others differ from page to page and would never align. Aligning two
expressions works alike, so those of a host are aligned in groups of at most ``GROUP`` until one is left, its wrapper,
and no host needs one task for its pages. An expression also sums up how much text its parts hold.

In the wrapper, parts whose tag or class names them as menus, adverts, forms and the like are left out; those so named
by a class, and forms, only if they hold less than most of the host's text. Articles and main parts are then the
content, also those in such a part if there are no others; where a host has none, it is the smallest part with most of the text. Each page is
matched with the wrapper of its host, and the texts in slots of the content are its main text. Constants are left out if
the host has ``PAGES`` different pages or more and they hold less than most of its content; headings stay, and so do blocks of
fewer than ``SENTENCE`` words, as cells of tables and words between marks are equal by chance.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import map_batches
from runledger.session import written

RUN = 4
GROUP = 64
DEPTH = 150  # elements nested deeper are kept side by side, as browsers do at a depth of their own
MOST = 0.7  # of the text of a part: the share that makes one of its children the content
KEPT = 0.5  # of the unlinked text of a host: the share above which a part is not left out for its class
LINKS = 0.5  # the share of linked text above which a part is a menu
PAGES = 10  # different pages with text that a host has at least, if equal sentences are to be constants
SENTENCE = 4  # words

# Elements of HTML by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: An element that the start tag of another one (the value) closes.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"},
    "th": {"td", "th", "tr", "tbody"}, "option": {"option"},
    "p": set("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav footer header main form blockquote pre figure hr address fieldset".split()),
}
#: Elements that such a closing does not reach beyond.
SCOPE = frozenset("html body table ul ol dl article section div main aside nav footer header form td th blockquote figure".split())
SKIPPED = frozenset("head nav footer aside form button select dialog menu svg canvas object script style noscript iframe template textarea title".split())
CUES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement banner sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended comment comments disqus reply replies widget toolbar pagination pager copyright".split()
)
#: Cues that say nothing about a block inside an article.
OUTSIDE = frozenset("header masthead banner notice alert".split())
#: Parts of a class name that make a cue before them name a box of that kind (share-buttons, unlike share-price).
BOXES = frozenset(
    "area areas bar bars block blocks body bottom box boxes btn btns button buttons container content form group header holder icon icons inner item items "
    "left link links list lists main outer panel post posts right row section slot stories top unit wrap wrapper".split()
)
#: Parts of a class name that make it tell of another element, or of one that is not there.
STATES = frozenset("active disabled enabled has have hidden hide is no non not off on open show with without".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    """An element of a page: key (tag, and class where it has one), tag, children (nodes and texts)."""

    __slots__ = ("key", "tag", "children")

    def __init__(self, key: str, tag: str):
        self.key, self.tag, self.children = key, tag, []


def names_of(attributes: str) -> list[str]:
    """The names that an element aligns by: classes, roles, and ids that are cues or the main part."""
    found = set()
    for kind, *values in NAMES.findall(attributes):
        for name in re.sub("[0-9]+", "0", "".join(values).lower()).split():
            if kind.lower() != "id" or name == "main" or is_cue(name, CUES):
                found.add(name)
    return sorted(found)


def parse(page: str | None) -> Node:
    """The tree of a page; character references in texts are decoded."""
    root = Node("", "")
    stack, at, page = [root], 0, page or ""

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].children.append(html.unescape(page[at:upto]))

    find = TAG.search
    while m := find(page, at):
        text(m.start())
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag in INLINE:
                    break
            continue
        for i in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                del stack[i:]
                break
            if stack[i].tag in SCOPE:
                break
        node = Node(".".join([tag, *names_of(rest)]), tag)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif tag not in VOID and not rest.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    text(len(page))
    return root


def is_cue(name: str, cues: frozenset) -> bool:
    """Whether a class, id or role is a cue: as a whole, by its last word, or by its first one before words for boxes."""
    words = [w for w in re.split("[^a-z]+", name) if w]
    if not words or STATES & set(words):
        return False
    return words[-1] in cues or words[0] in cues and all(w in BOXES or len(w) == 1 for w in words[1:])


def fixed(key: str, inside: bool) -> bool:
    """Whether an element is never part of the content; ``inside``: of an article, which may have a header."""
    tag = key.split(".")[0]
    return tag != "form" and tag in SKIPPED or tag == "header" and not inside


def named(key: str, inside: bool) -> bool:
    """Whether an element is called no part of the content, which may be wrong."""
    tag, *names = key.split(".")
    if tag in ("html", "body", "article", "main"):
        return False
    return tag == "form" or any(is_cue(n, CUES - OUTSIDE if inside else CUES) for n in names)


def plain(part: list) -> int:
    """The text of a part that is not linked and may be content."""
    if part[0] == "#":
        return part[3] - part[4]
    return 0 if fixed(part[0], True) else sum(map(plain, part[5]))


def skipped(part: list, inside: bool, total: int) -> bool:
    """Whether a part is left out; ``total``: the plain text of the host."""
    return fixed(part[0], inside) or named(part[0], inside) and plain(part) <= KEPT * total


def words_of(node: Node) -> list[str] | None:
    """The words of a block that holds texts and inline elements only; None for other blocks."""
    texts, stack = [], [node]
    while stack:
        child = stack.pop()
        if not isinstance(child, Node):
            texts.append(child)
        elif child is node or child.tag in INLINE:
            stack.extend(reversed(child.children))
        else:
            return None
    return "".join(texts).split()


def sentence(node: Node) -> tuple[str, int] | None:
    """Hash and length of the text of a block that may be a constant."""
    if node.tag in INLINE or node.tag in HEADINGS or (words := words_of(node)) is None or len(words) < SENTENCE:
        return None
    text = " ".join(words)
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass")), len(text)


def merged(a: list, b: list, pages: bool = True) -> list:
    """The expression of two: [key, repeated, optional, text, linked text, parts, sentences].

    ``pages``: the two are of different pages, so only sentences of both are left; else they are members of a group.
    A whole page has its number of pages and the first ``PAGES`` hashes of different ones at the end; one without text
    has nothing to align.
    """
    if len(a) > 7 and not (a[3] and b[3]):
        return a if a[3] else b
    same = {h: n for h, n in a[6].items() if h in b[6]} if pages else a[6] | b[6]
    out = [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], a[4] + b[4], aligned(a[5], b[5], pages), same]
    if len(a) > 7:
        out.append([a[7][0] + b[7][0], sorted({*a[7][1], *b[7][1]})[:PAGES]])
    return out


def unsaid(part: list) -> list:
    """A part without its sentences."""
    return [*part[:5], [unsaid(p) for p in part[5]], {}]


def aligned(a: list, b: list, pages: bool = True) -> list:
    """Parts of two elements, those with equal keys matched in order, all others optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merged(x, y, pages) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0

    def optional(x):
        x = unsaid(x) if pages else x
        return [x[0], x[1], True, *x[3:]]

    while i < n and j < m:
        if a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return folded(out + [optional(x) for x in a[i:] + b[j:]])


def folded(parts: list) -> list:
    """``parts`` with equal neighbouring runs of up to ``RUN`` parts made one, which is repeated."""
    for size in range(1, RUN + 1):
        out: list = []
        for part in parts:
            out.append(part)
            while len(out) >= 2 * size and all(x[0] == y[0] for x, y in zip(out[-2 * size:-size], out[-size:])):
                run = [merged(x, y, False) for x, y in zip(out[-2 * size:-size], out[-size:])]
                out[-2 * size:] = [[x[0], True, *x[2:]] for x in run]
        parts = out
    return parts


def expression(page: Node) -> list:
    """The expression of one page."""

    def inferred(node, linked):
        parts, linked = [], linked or node.tag == "a"
        for child in node.children:
            if isinstance(child, Node):
                parts.append(inferred(child, linked))
            elif size := len(child.strip()):
                parts.append(["#", False, False, size, size * linked, [], {}])
        said = sentence(node) if parts and node is not page else None
        return [node.key, False, False, sum(p[3] for p in parts), sum(p[4] for p in parts), folded(parts), dict([said]) if said else {}]

    tree = inferred(page, False)
    return [*tree, [1, [xxhash.xxh3_64_hexdigest(json.dumps(tree))]]]


def shown(part: list) -> str:
    """An expression as text."""
    inner = f"{part[0]}({' '.join(map(shown, part[5]))})" if part[5] else part[0]
    return f"({inner}){'+' * part[1]}{'?' * part[2]}" if part[1] or part[2] else inner


def contents(wrapper: list, total: int) -> list[list]:
    """The outermost articles and main parts that are not left out; without any text in them, those in parts that are."""
    found, others = [], []

    def look(part, out):
        if fixed(part[0], False):
            return
        out = others if skipped(part, False, total) else out
        tag, *names = part[0].split(".")
        if tag in ("article", "main") or "main" in names:
            out.append(part)
            return
        for inner in part[5]:
            look(inner, out)

    look(wrapper, found)
    return others if any(map(plain, others)) and not any(map(plain, found)) else found


def useful(part: list, total: int) -> int:
    """The text of a part without what is left out."""
    if part[0] == "#":
        return part[3]
    return 0 if skipped(part, False, total) else sum(useful(p, total) for p in part[5])


def has_blocks(part: list) -> bool:
    return any(p[0] != "#" and p[0].split(".")[0] not in INLINE | VOID for p in part[5])


def equal_text(part: list) -> int:
    """The length of the sentences of a part that all pages have."""
    return sum(part[6].values()) + sum(map(equal_text, part[5]))


def marked(wrapper: list) -> dict:
    """The wrapper as {k: key, m: whether its text is content, c: its constants, p: parts}, for matching pages."""
    total = plain(wrapper)
    found = contents(wrapper, total)
    semantic = bool(found)
    if not found:
        top = wrapper
        while True:
            size = useful(top, total)
            inner = next((p for p in top[5] if size and has_blocks(p) and not p[1] and useful(p, total) >= MOST * size), None)
            if not inner:
                break
            top = inner
        found = [top]
    roots = {id(x) for x in found}
    pages, different = wrapper[7]
    constant = len(different) >= PAGES and pages * sum(map(equal_text, found)) <= KEPT * sum(useful(x, total) for x in found)

    def mark(part, main):
        main = main or id(part) in roots
        keep = main and (id(part) in roots or not skipped(part, semantic, total))
        if keep and not semantic and id(part) not in roots and part[0] != "#" and part[0].split(".")[0] not in INLINE:
            keep = part[4] <= LINKS * part[3]
        return {"k": part[0], "m": keep, "c": set(part[6]) if constant else (), "p": [mark(p, main and keep) for p in part[5]]}

    return mark(wrapper, False)


def main_text(page: Node, wrapper: dict) -> str:
    """Texts of the page that match slots of the content, not constants: white space made single, blocks joined by blanks."""
    blocks, now = [], []

    def end():
        if block := " ".join("".join(now).split()):
            blocks.append(block)
        now.clear()

    def walk(node, expr):
        parts, at = expr["p"], 0
        for child in node.children:
            key = child.key if isinstance(child, Node) else "#"
            n = len(parts)
            # a part repeats where it stands, or the next one of its name follows; a run begins again from the start
            hit = next((j % n for j in range(at, at + n) if parts[j % n]["k"] == key), None) if n else None
            if hit is not None:
                at = hit
            if not isinstance(child, Node):
                if expr["m"]:
                    now.append(child)
                continue
            block = child.tag not in INLINE
            if block:
                end()
            if hit is not None and not (parts[hit]["c"] and (said := sentence(child)) and said[0] in parts[hit]["c"]):
                walk(child, parts[hit])
            if block:
                end()

    walk(page, wrapper)
    end()
    return " ".join(blocks)


def host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree): the wrapper of each host as JSON; pages without an address share one."""

    def infer(batch):
        found: dict = {}
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree = expression(parse(page))
            known = found.get(name)
            found[name] = merged(known, tree) if known else tree
        return {"host": list(found), "tree": [json.dumps(t) for t in found.values()]}

    def merge(frame):
        tree, *rest = map(json.loads, sorted(frame["tree"]))
        for other in rest:
            tree = merged(tree, other)
        return pd.DataFrame({"host": frame["host"][:1].to_numpy(), "tree": [json.dumps(tree)]})

    trees = written(map_batches(pages.select(host().alias("host"), "html"), infer, "host string, tree string"), "op5-trees")
    while True:
        sizes = written(trees.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "op5-sizes")
        most = sizes.agg(F.max("n")).first()[0]
        if not most or most == 1:
            return trees
        share = F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / GROUP)).cast("int").alias("share")
        trees = written(
            trees.join(sizes, "host").select("host", "tree", share).groupBy("host", "share").applyInPandas(merge, "host string, tree string"), "op5-trees")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null page counts as empty, a null or malformed address as one host of its own; null identifiers stay null,
    repeated rows give repeated results, an empty table gives no rows. A page without any text in its host's content
    is matched with its own expression instead. Columns other than page_id, url and html are not returned.
    """
    wrappers = host_wrappers(pages).withColumnRenamed("host", "_host")
    named = pages.select("page_id", "url", "html", host().alias("_host"))
    joined = named.join(wrappers, "_host", "left").select("page_id", "url", "html", "tree")

    def read(batch):
        ids, urls, pages_in, trees = (batch.column(c).to_pylist() for c in range(4))
        known: dict = {}
        texts = []
        for page, tree in zip(pages_in, trees):
            if tree not in known:
                known[tree] = marked(json.loads(tree))
            parsed = parse(page)
            texts.append(main_text(parsed, known[tree]) or main_text(parsed, marked(expression(parsed))))
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(joined, read, "page_id long, url string, text string, n_chars long")
