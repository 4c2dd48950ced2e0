"""Main text of web pages by consensus host paths.

First every page scores its containers: text that stands in a container's own blocks counts whole, that of child containers
half, both less the share inside links. From the best container it goes up: to the article or main element around it, else to ancestors that
at most double the text, as long as what is added isn't mostly links; never to the body or out of an article. The container reached votes for its path of tag.class steps, digits generalised. Spark
sums the votes of each host; paths with WINNING of a host's votes win. Then every page is extracted again: all containers on the best of its
host's winning paths that it has, else the page's own best container. Boilerplate elements, by tag, role or words of class and id, are left
out wherever they stand, so no path can bring them back.

Null html gives an empty text. A page without url belongs to the host "". Equal rows get equal texts; ties between paths go
to the smaller hash. Extra columns are ignored. Markup is read as browsers read it, in one pass: a quote counts only where an attribute's value
begins, a tag that never ends takes the rest of the page with it, and elements may be nested as deeply as they like. A header inside an article is a header like any other.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import lean, small, written

#: Share of a host's votes that makes a path win; so a host has 1 / WINNING winners at most.
WINNING = 0.05
#: Hosts whose winning paths are broadcast; beyond, the pages are joined by host.
BROADCAST_HOSTS = 50_000
#: Rows of a host that are joined in one place where winners aren't broadcast.
SALTS = 16

# a tag from its name on; possessive, so that nothing is read twice
TAG = re.compile(r"([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed iframe".split())
CONTAINERS = frozenset("html body main article section div td blockquote center".split())
BLOCKS = CONTAINERS | frozenset("address caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre summary table tbody tfoot th thead tr ul nav header footer aside form".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe svg button select option textarea dialog menu title object canvas audio video xmp noembed input label".split())
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies disqus
    footer foot gdpr header masthead menu modal nav navbar navigation newsletter notice notification alert pager pagination paywall popup promo
    promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
    toolbar topbar widget widgets login form overlay""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NEGATED = frozenset("no with has without".split())


class Node:
    __slots__ = ("tag", "path", "parent", "score", "container", "off", "link", "size", "linked")

    def __init__(self, tag, path, parent, container, off, link):
        self.tag, self.path, self.parent, self.container, self.off, self.link = tag, path, parent, container, off, link
        self.score, self.size, self.linked = 0.0, 0, 0


def _noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROPPED or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in re.split(r"\s+", f"{attributes.get('class', '')} {attributes.get('id', '')}"):
        parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if not NEGATED & set(parts) and NOISE & set(parts):
            return True
    return False


def _step(tag: str, attributes: dict[str, str]) -> str:
    return ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split())])


@lru_cache(1 << 16)
def _key(above: int, step: str) -> int:
    """A path as a number, made of that of the container above and of its own step."""
    return int.from_bytes(hashlib.blake2b(step.encode(errors="replace"), digest_size=8, key=above.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


@lru_cache(64)
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I)


def parsed(source: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(blocks outside boilerplate: container and text, containers) in page order; containers have their scores and sizes."""
    root = Node("", 0, None, None, False, False)
    root.container = root
    stack, blocks, containers = [root], [], [root]
    words: list[str] = []
    linked, at, open_ = [0], 0, Counter()

    def flush():
        if words:
            if text := re.sub(r"\s+", " ", "".join(words)).strip():
                node = stack[-1].container
                gain = max(0.0, len(text) - 1.5 * linked[0])
                blocks.append((node, text))
                node.score += gain
                node.size += len(text)
                node.linked += linked[0]
                if node.parent is not None:
                    node.parent.container.score += gain / 2
            words.clear()
        linked[0] = 0

    def say(text: str):
        top = stack[-1]
        if text and not top.off:
            text = html.unescape(text)
            words.append(text)
            if top.link:
                linked[0] += len(text.strip())

    def close(k: int):
        for node in stack[k:]:
            if node.tag in BLOCKS:
                flush()
                break
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    def opened(tags: tuple[str, ...], stop: frozenset[str]) -> int:
        if any(open_[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return k
                if stack[k].tag in stop:
                    break
        return 0

    size = len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            say(source[at:])
            break
        after = source[start + 1 : start + 3]
        ends = after[:1] == "/"
        name = after[ends : ends + 1]
        if not (name.isascii() and name.isalpha()):
            if ends and not name or not ends and name not in ("!", "?"):
                # a mark like any other
                say(source[at : start + 1])
                at = start + 1
                continue
            say(source[at:start])
            comment = source.startswith("!--", start + 1)
            end = source.find("-->" if comment else ">", start + 4 if comment else start + 2)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        say(source[at:start])
        found = TAG.match(source, start + 1 + ends)
        if not found:
            break
        at = found.end()
        tag, rest = found[1].lower(), found[2]
        if ends:
            if k := opened((tag,), frozenset()):
                close(k)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS:
            if k := opened(("p",), CONTAINERS | {"li", "th"}):
                close(k)
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and (k := opened(("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,), frozenset(("ul", "ol", "dl", "table")))):
                close(k)
            flush()
        if tag in VOID or rest.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        attributes = {a.lower(): v[1:-1] if v[:1] in ("'", '"') and v[:1] == v[-1:] and len(v) > 1 else v for a, v in reversed(ATTRIBUTE.findall(rest))} if rest.strip() else {}
        if tag in RAW:
            # nothing inside is markup
            end = closing(tag).search(source, at)
            at = end.end() if end else size
            continue
        top = stack[-1]
        off = top.off or _noise(tag, attributes)
        if off and not top.off:
            flush()
        node = Node(tag, top.path, top, top.container, off, top.link or tag == "a")
        if tag in CONTAINERS:
            node.path = _key(top.path, _step(tag, attributes))
            node.container = node
            if not off:
                containers.append(node)
        stack.append(node)
        open_[tag] += 1
    flush()
    # from here on, of all text below
    for node in reversed(containers[1:]):
        up = node.parent.container
        up.size += node.size
        up.linked += node.linked
    return blocks, containers


BONUS = {"article": 1.6, "main": 1.4}


def _best(containers: list[Node]) -> Node:
    best = up = max(containers, key=lambda n: n.score * BONUS.get(n.tag, 1.0))
    plain = True
    while up.tag != "article" and up.parent is not None and (up := up.parent.container).tag not in ("", "html", "body"):
        poor = 1.5 * (up.linked - best.linked) <= up.size - best.size
        if up.tag in ("article", "main"):
            best = up if poor else best
        elif plain := plain and poor and up.size <= 2 * best.size:
            best = up
    return best


def inside(blocks: list[tuple[Node, str]], chosen: set[Node]) -> str:
    known: dict[Node, bool] = {}

    def within(node: Node) -> bool:
        trail = []
        while node is not None and node not in known and node not in chosen:
            trail.append(node)
            node = node.parent.container if node.parent is not None else None
        hit = node is not None and (node in chosen or known[node])
        known.update((x, hit) for x in trail)
        return hit

    return "\n".join(text for node, text in blocks if within(node))


def extracted(source: str | None, paths: list[int] | None) -> str:
    """The main text of a page, given its host's winning paths, best first."""
    if not source:
        return ""
    blocks, containers = parsed(source)
    for path in paths or ():
        chosen = {n for n in containers if n.path == path}
        if chosen and (text := inside(blocks, chosen)):
            return text
    return inside(blocks, {_best(containers)})


def _votes(batches):
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, source in zip(batch.column("host"), batch.column("html"), strict=True):
            if source.is_valid:
                node = _best(parsed(source.as_py())[1])
                if node.score > 0:
                    hosts.append(host.as_py())
                    paths.append(node.path)
                    scores.append(1.0)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(scores, pa.float64())], ["host", "path", "vote"])


def _extract(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            text = [extracted(s.as_py(), p) for s, p in zip(part.column("html"), part.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths that win at each host, best first."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path long, vote double").groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    votes = written(votes, "votes")
    most = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(most, "host").where(F.col("votes") >= WINNING * F.col("total"))
    return won.groupBy("host").agg(F.expr("transform(array_sort(collect_list(struct(-votes as v, path))), x -> x.path)").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    source = lean(pages).select("page_id", "url", "html", host.alias("host"))
    won = written(winning_paths(source), "paths")
    if small(won, BROADCAST_HOSTS):
        pages_won = source.join(F.broadcast(won), "host", "left")
    else:
        # a host's winners are some numbers, so they are copied; its pages are dealt over SALTS tasks
        own = won.select("host", "paths", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        pages_won = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.substring("html", 1, 1000), F.length("html")), F.lit(SALTS)).cast("int")).join(own, ["host", "salt"], "left")
    kind = dict(pages.dtypes)["page_id"]
    text = pages_won.select("page_id", "url", "html", "paths").mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
