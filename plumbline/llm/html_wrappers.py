"""Main text of web pages by union-free wrappers inferred per host.

Contract: one row per page with page_id, url, text and n_chars: the article's blocks in page order,
joined by one line feed, without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, markup and reader comments. Character references are decoded, white space inside a block
becomes one space, ends are trimmed, nothing else is dropped or capped. A class, id or role drops an
element only by a whole token that is a word of DROPPED_WORDS or is made of such words; never html, body,
main or a page's article, nothing around them, and no heading or prose of an article. Null html gives an empty text;
pages without a url share a host of their own; repeated rows stay; an empty table gives no rows.

Method: a page is a stream of tags and texts. Streams of one host are aligned one after the other: at
equal positions tags must agree and texts become slots; where they do not agree, groups of tags that
only some pages have become optional, and groups that follow each other become one repeated group.
The result is the host's wrapper, a regular expression without unions. Every slot knows its path of
tags, how many different pages it was seen in and whether its text ever changed, so the wrapper tells template text
from content and whether the host has an article element at all. Pages of a host in one batch are
folded into a wrapper before anything is shuffled; wrappers merge per host in two levels, so a host
with a third of all pages is never gathered. Pages then meet their host's slots by a merge join that
adaptive execution can split, and every text of a page is kept or dropped by its slot.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches, stored

SALTS = 64
DEEPEST = 48
SEEN_PAGES = 3
#: Fixed values of HTML: elements without content, elements in a line, elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ENDED_BY = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
#: Elements and words of class or id that hold no main text.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select option textarea dialog menu".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted recommended related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
DROPPED_OUTSIDE = frozenset({"header"})
MAIN = frozenset({"article", "main"})
#: Elements whose text is prose and so is kept in an article even where it never changes.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<raw>script|style|textarea|title|noscript|iframe|template)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
NAMED = frozenset({"class", "id", "role"})
WORD = re.compile(r"[a-z]+")
JOINT = re.compile(r"[-_]+")
#: Mark of a key whose element is dropped by its class, id or role; no word holds it.
OUT = ".!"


def tag_key(name: str, rest: str) -> str:
    """A tag's name with the words of its class, id and role, and OUT if a whole token of them holds no main text."""
    if "=" not in rest:
        return name
    values = ["".join(found).lower() for key, *found in ATTRIBUTE.findall(rest) if key.lower() in NAMED]
    words = sorted({w for value in values for w in WORD.findall(value)})
    out = any(DROPPED_WORDS.issuperset(JOINT.split(token)) for value in values for token in value.split())
    return ".".join([name, *words]) + (OUT if out else "")


def events(page: str) -> list[tuple[str, str]]:
    """The token stream with OUT only where it may drop: not on html, body and main, on an article that is in
    no other, on prose of an article, and around an article or main without OUT."""
    found = list(tokens(page))
    around: list[tuple[int, bool, bool]] = [(-1, False, False)]
    for at, (kind, value) in enumerate(found):
        if kind == "close":
            around.pop()
        if kind != "open":
            continue
        name = value.split(".")[0]
        _, inside, in_article = around[-1]
        if value.endswith(OUT):
            if name in ("html", "body", "main") or (name == "article" and not in_article) or (inside and name in PROSE):
                found[at] = (kind, value.removesuffix(OUT))
        elif name in MAIN and not inside:
            for i, *_ in around[1:]:
                found[i] = (found[i][0], found[i][1].removesuffix(OUT))
        around.append((at, inside or name in MAIN, in_article or name == "article"))
    return found


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """Token stream of a page as ("open", key), ("close", name), ("void", name) and ("text", decoded text).

    Unclosed paragraphs, items and cells end where HTML ends them; a closing tag without its start is
    passed over, and one that skips open tags closes them.
    """
    stack: list[tuple[str, str]] = []
    for token in TOKEN.finditer(page):
        text = token["text"] or token["cdata"]
        if text:
            yield "text", html.unescape(text) if token["text"] else text
            continue
        if not token["name"]:
            continue
        name = token["name"].lower()
        if token["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                while len(stack) > depth:
                    yield "close", stack.pop()[0]
            continue
        if name in VOID:
            yield "void", name
            continue
        ended = ENDED_BY.get(name, frozenset())
        if name not in INLINE:
            inside = len(stack) - 1
            while inside >= 0 and stack[inside][0] in INLINE:
                inside -= 1
            if inside >= 0 and (stack[inside][0] in ended or stack[inside][0] == "p"):
                while len(stack) > inside:
                    yield "close", stack.pop()[0]
        key = tag_key(name, token["rest"])
        stack.append((name, key))
        yield "open", key
    while stack:
        yield "close", stack.pop()[0]


# A wrapper is a list of nodes. A slot is ["#", optional, smallest text hash, largest, pages, marks], where
# marks are the smallest SEEN_PAGES hashes of the main texts of pages with the slot and pages is their number,
# so copies of a page and repeats within one count once; a group is [key, optional, repeated, nodes], where
# the key "()" stands for a repeated group of several tags.


def same(a: list, b: list) -> bool:
    return a[0] == b[0]


def seen_in(a: list[int], b: list[int]) -> list[int]:
    """Marks of the pages in either list, as many as are asked for."""
    return a if a == b else sorted({*a, *b})[:SEEN_PAGES]


def merged(a: list, b: list) -> list:
    """One node that matches what either node matches."""
    if a[0] == "#":
        marks = seen_in(a[5], b[5])
        return ["#", a[1] | b[1], min(a[2], b[2]), max(a[3], b[3]), len(marks), marks]
    return [a[0], a[1] | b[1], a[2] | b[2], aligned(a[3], b[3])]


def optional(node: list) -> list:
    return [node[0], 1, *node[2:]]


def aligned(a: list, b: list) -> list:
    """Align two streams of nodes: agreeing nodes merge, others become optional, in their order."""
    if len(a) == len(b) and all(map(same, a, b)):
        return [merged(x, y) for x, y in zip(a, b)]
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if same(a[i], b[j]) else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if same(a[i], b[j]):
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif longest[i + 1][j] >= longest[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return folded(out + [optional(x) for x in a[i:] + b[j:]])


def folded(nodes: list) -> list:
    """Make repeated groups of nodes, or of two or three nodes in turn, that follow each other."""
    out: list[list] = []
    for node in nodes:
        if out and same(out[-1], node):
            out[-1] = merged(out[-1], node)
            if node[0] != "#":
                out[-1][2] = 1
            continue
        out.append(node)
        for period in (2, 3):
            tail, before = out[-period:], out[-2 * period : -period]
            keys = [x[0] for x in tail]
            group = out[-period - 1] if len(out) > period else ["", 0, 0, []]
            if len(before) == period and all(map(same, before, tail)) and keys[0] != "#":
                out[-2 * period :] = [["()", 0, 1, aligned(before, tail)]]
            elif group[0] == "()" and [x[0] for x in group[3]] == keys:
                out[-period - 1 :] = [["()", group[1], 1, aligned(group[3], tail)]]
    return out


def wrapper_of(page: str) -> list:
    """The wrapper that a single page is."""
    levels: list[list] = [[]]
    keys: list[str] = []
    stream = events(page)
    marks = [zlib.crc32(text_of(stream, frozenset()).encode("utf-8", "surrogatepass"))]
    for kind, value in stream:
        if kind == "text":
            if value.strip():
                mark = zlib.crc32(" ".join(value.split()).encode("utf-8", "surrogatepass"))
                levels[-1].append(["#", 0, mark, mark, 1, marks])
        elif kind == "open":
            keys.append(value)
            levels.append([])
        elif kind == "close":
            nodes, key = folded(levels.pop()), keys.pop()
            if len(keys) < DEEPEST:
                levels[-1].append([key, 0, 0, nodes])
            else:
                levels[-1].extend(nodes)
    return folded(levels[0])


def boilerplate(keys: list[str]) -> bool:
    """Whether a path of tags leads out of the main text."""
    inside = False
    for key in keys:
        name = key.split(".")[0]
        inside = inside or name in MAIN
        if name in DROPPED or (not inside and name in DROPPED_OUTSIDE) or key.endswith(OUT):
            return True
    return False


def slots(wrapper: list, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], list]]:
    """Every slot of a wrapper with its path of tags."""
    for node in wrapper:
        if node[0] == "#":
            yield path, node
        else:
            yield from slots(node[3], path if node[0] == "()" else (*path, node[0]))


def template_paths(wrapper: list) -> list[str]:
    """Paths whose text is the template's: it was seen on several pages of different main text and never
    changed, while other text of the host did, and it is no prose of an article."""
    found: dict[tuple[str, ...], list] = {}
    for path, node in slots(wrapper):
        kept = found.setdefault(path, [node[2], node[3], []])
        found[path] = [min(kept[0], node[2]), max(kept[1], node[3]), seen_in(kept[2], node[5])]
    content = {p: v for p, v in found.items() if not boilerplate(list(p))}
    if not any(low != high for low, high, _ in content.values()):
        return []
    names = {p: {k.split(".")[0] for k in p} for p in content}
    return sorted(">".join(p) for p, (low, high, marks) in content.items() if low == high and len(marks) >= SEEN_PAGES and not (names[p] & MAIN and names[p] & PROSE))


def main_text(page: str, template: frozenset[str]) -> str:
    """Text of a page without boilerplate and template slots; with an article, only what is in it."""
    return text_of(events(page), template)


def text_of(stream: list[tuple[str, str]], template: frozenset[str]) -> str:
    """The text of ``main_text`` from a page's token stream."""
    blocks: dict[bool, list[list[str]]] = {True: [[]], False: [[]]}
    path: list[str] = []
    states: list[tuple[bool, bool]] = [(False, False)]
    had_article = False
    for kind, value in stream:
        dropped, inside = states[-1]
        if kind == "text":
            if not dropped and not (template and value.strip() and ">".join(path) in template):
                blocks[inside][-1].append(value)
            continue
        name = value.split(".")[0]
        if kind == "void":
            blocks[inside][-1].append(" ")
            if name == "hr":
                blocks[inside].append([])
            continue
        if name not in INLINE:
            for part in blocks.values():
                part.append([])
        if kind == "open":
            path.append(value)
            states.append((dropped or boilerplate([value] if not inside else ["main", value]), inside or name in MAIN))
            had_article = had_article or (name in MAIN and not states[-1][0])
        else:
            path.pop()
            states.pop()
    lines = (" ".join("".join(parts).split()) for parts in blocks[had_article])
    return "\n".join(line for line in lines if line)


def host_of(url: str) -> F.Column:
    """Host of a url in lower case, without user, port and path; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def merge_rows(wrappers: Iterator[str]) -> str:
    whole: list | None = None
    for text in wrappers:
        part = json.loads(text)
        whole = part if whole is None else aligned(whole, part)
    return json.dumps(whole or [])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """Columns (host, wrapper): one wrapper per host, from all of its pages."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = wrapper_of(page.as_py() or "")
                found[host] = aligned(found[host], part) if host in found else part
            columns = [pa.array(list(found)), pa.array([json.dumps(w) for w in found.values()])]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [merge_rows(iter(sorted(rows["wrapper"])))]})

    parts = pages.select(host_of("url").alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(per_batch, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    level = salted.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return level.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def page_texts(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, text, n_chars."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["\n".join(template_paths(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["known", "paths"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [frozenset(p.split("\n")) if p else frozenset() for p in batch.column(3).to_pylist()]
            texts = [main_text(page.as_py() or "", template) for page, template in zip(batch.column(2), known)]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    known = stored(host_wrappers(bounded_batches(pages)).mapInArrow(paths, "known string, paths string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    joined = rows.join(known.hint("merge"), F.col("host") == F.col("known"), "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
