"""Main-text extraction by equivalence classes of template tokens.

Pages of one host come from one template.  A *token* of a page is an element path
(``html/body/article``), the class and id of the last element included, or a block of text
at its path.

1. *Occurrence vectors.*  For each (host, token) the vector of its counts over the pages
   of the host is folded into a fingerprint, the sum over pages of
   ``hash(page, count)``: a distributed aggregate that is combined before the shuffle, so
   a host may hold any share of all pages.  All pages count; exact copies of a page are one.
2. *Equivalence classes.*  Tokens of a host with the same fingerprint form a class.
   Template tokens occur once on each of at least LEAST pages.  An element is a template
   container; a text is template text where an element of its own class encloses it.
3. *Template and slots.*  Containers on most pages of the host make the template tree.
   What varies below a container is its text without template text.  From the root down,
   the container with over half of what varies is taken, until none has so much, or only
   headings would be left outside.  Names are no condition: text below a name of menus,
   headers, footers, sidebars, notices, adverts, forms or comments weighs a quarter, no
   container without a telling name is taken below one that has it, and where no container
   holds most, a telling name decides.
4. *Extraction.*  Each page yields the blocks inside the chosen slot, without those in
   named junk below the slot (a heading in a box named as a header is not junk there) and
   those in containers below it where nothing varies.

Text tokens are whole blocks, so fixed words in a block that varies stay.  Hosts of fewer
than LEAST different pages have no template; their pages fall back as below.

White space inside a block becomes one space, blocks join by a line feed, character
references are decoded.  Null html counts as empty; a page without the host's slot falls
back to its own largest slot; a page without text has an empty string.  Repeated rows each
give a row; a null url is a host of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.skew import join_on_key

# fixed values: elements by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object video audio".split())
DROPPED = RAW | frozenset("nav header footer aside form button select option menu dialog head fieldset input".split())
P_CLOSERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
SELF_CLOSERS = frozenset("li dt dd tr td th option".split())
MAIN = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd tr td th pre blockquote figcaption caption".split())
LEAST = 3  # pages on which a template token occurs
CONTENT_NAME = re.compile(r"(?:^|[-_\s.#])(?:article|content|entry|post|story|main|body|text)(?:$|[-_\s.#])", re.I)
JUNK_NAME = re.compile(
    r"(?:^|[-_\s.#])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|comments?|respond|replies|disqus|sidebar\w*|menu\w*|nav\w*|breadcrumbs?|header|footer|masthead|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter\w*|subscribe\w*|signup|login|social|share\w*|sharing|related|recommend\w*|widget\w*|pagination|pager|toolbar|copyright|legal)(?:$|[-_\s.#])",
    re.I,
)
HEADER_NAME = re.compile(r"(?:^|[-_\s.#])(?:header|masthead)(?:$|[-_\s.#])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")


def _step(name: str, attrs: str) -> str:
    if not attrs.strip():
        return name
    got = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
    marks = [got[k] for k in ("class", "id", "role") if got.get(k)]
    marks = [re.sub(r"\d+", "0", html.unescape(m)) for m in marks]
    return ".".join([name, *" ".join(marks).replace("/", "_").split()])


def blocks(page: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Element paths in page order, and (path of the enclosing element, text) blocks."""
    stack: list[tuple[str, str]] = []
    paths: list[str] = []
    out: list[tuple[str, str]] = []
    text: list[str] = []
    where = ""

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((where, joined))
            text.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if name in INLINE:
            continue
        if name in ("br", "wbr"):
            if name == "br":
                text.append(" ")
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in P_CLOSERS and stack and stack[-1][0] == "p":
                stack.pop()
            if name in SELF_CLOSERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            step = _step(name, m[3])
            path = (stack[-1][1] + "/" if stack else "") + step
            paths.append(path)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            elif name not in VOID and not m[3].rstrip().endswith("/"):
                stack.append((name, path))
        where = stack[-1][1] if stack else ""
    flush()
    return paths, out


def excluded(step: str) -> bool:
    """Whether a path step is a menu, header, footer, sidebar, notice, advert, form or comments."""
    name, _, marks = step.partition(".")
    if name in DROPPED:
        return True
    return name not in ("html", "body", *MAIN) and bool(marks) and any(JUNK_NAME.search(m) for m in marks.split("."))


def _outside(steps: list[str]) -> bool:
    """Whether a block below the chosen slot is not of the article: a heading in a box that is only
    named as a header is the article's own."""
    if any(x.partition(".")[0] in HEADINGS for x in steps):
        steps = [x for x in steps if x.partition(".")[0] in DROPPED or not HEADER_NAME.search(x)]
    return any(map(excluded, steps))


def rank(path: str) -> int:
    """How article-like the last step of a path is; -1 inside an excluded slot."""
    steps = path.split("/")
    if any(map(excluded, steps)):
        return -1
    name, _, marks = steps[-1].partition(".")
    if name in MAIN or "main" in marks.split("."):
        return 3 if name == "article" else 2
    return 1 if any(CONTENT_NAME.search(m) for m in marks.split(".") if m) and name != "body" else 0


def _containers(path: str) -> list[str]:
    steps = path.split("/") if path else []
    return ["/".join(steps[: k + 1]) for k in range(len(steps))]


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) or 1


def _weights(path: str, chars: int) -> tuple[int, int]:
    """What a text counts for: outside headings, and in them."""
    steps = path.split("/")
    weight = chars * (1 if any(map(excluded, steps)) else 4)
    return (0, weight) if any(x.partition(".")[0] in HEADINGS for x in steps) else (weight, 0)


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, path, mark, page key, count, characters) for each page; mark is 0 for an element, else the hash of a text block."""

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for host, key, page in zip(frame["host"], frame["page_key"], frame["html"], strict=True):
                paths, found = blocks(page)
                count: dict[tuple[str, int], int] = defaultdict(int)
                chars: dict[tuple[str, int], int] = defaultdict(int)
                for p in paths:
                    count[p, 0] += 1
                for p, text in found:
                    at = (p, _mark(text))
                    count[at] += 1
                    chars[at] += len(text)
                rows += [(host, *at, key, c, chars.get(at, 0)) for at, c in count.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "mark", "page_key", "n", "chars"])

    return pages.select("host", "page_key", "html").mapInPandas(tokens, "host string, path string, mark bigint, page_key bigint, n bigint, chars bigint")


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(host, token, path, mark, class, support, once, chars): token classes of equal occurrence vectors; tokens of under LEAST pages are one row for each path, without a class."""
    token = ["host", "path", "mark"]
    each = page_tokens(pages).groupBy(*token, "page_key").agg(F.max("n").alias("n"), F.max("chars").alias("chars"))
    vec = each.groupBy(*token).agg(
        # the sum is taken modulo a power of ten, so that it can't overflow
        (F.sum(F.pmod(F.xxhash64("page_key", "n"), F.lit(1_000_000_000_000)).cast("decimal(38,0)")) % F.lit(10**15)).cast("bigint").alias("class"),
        F.count(F.lit(1)).alias("support"), F.count_if(F.col("n") == 1).alias("once"), F.sum("chars").alias("chars"),
    )
    often = F.col("support") >= LEAST
    kept = [F.when(often, F.col(c)).alias(c) for c in ("mark", "class", "support", "once")]
    vec = vec.select("host", "path", *kept, "chars").groupBy("host", "path", "mark", "class", "support", "once").agg(F.sum("chars").alias("chars"))
    name = F.when(F.col("mark") == 0, F.col("path")).otherwise(F.concat_ws("\t", "path", F.coalesce(F.col("mark").cast("string"), F.lit(""))))
    return vec.select("host", name.alias("token"), "path", "mark", "class", "support", "once", "chars")


def choose(below: dict[str, tuple[int, int]]) -> str:
    """The container that holds the article, from the weights of the text below each ("" is the root)."""
    at = ""
    while True:
        kids = [c for c in below if c != at and (not at or c.startswith(at + "/"))]
        most = [c for c in kids if 2 * sum(below[c]) > sum(below[at])]
        named = rank(at) if at else 0
        if most:
            kid = min(most, key=len)
            if named > 0 and max(map(rank, most)) <= named:
                return at
            if below[kid][0] == below[at][0] and below[kid][1] < below[at][1]:
                return at
        else:
            kids = [c for c in kids if rank(c) > 0 and sum(below[c])] if named <= 0 else []
            if not kids:
                return at
            kid = max(kids, key=lambda c: (rank(c), sum(below[c]), len(c), c))
        at = kid


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, fixed, pages): the article slot of each host's template, and the containers below it where nothing varies, by line feeds."""
    classes = equivalence_classes(pages).checkpoint()
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    different = pages.select("host", "page_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("different"))
    once = classes.filter("support = once")
    element = once.filter("mark = 0")
    around = element.groupBy("host", "class").agg(F.collect_set("path").alias("around"))
    encloses = F.exists("around", lambda p: (F.col("path") == p) | F.startswith("path", F.concat(p, F.lit("/"))))
    fixed = once.filter("mark <> 0").join(around, ["host", "class"]).filter(encloses).select("host", "path", (-F.col("chars")).alias("varies"))
    texts = classes.filter("mark IS NULL OR mark <> 0").select("host", "path", F.col("chars").alias("varies"))
    texts = texts.unionByName(fixed).groupBy("host", "path").agg(F.sum("varies").alias("varies")).filter("varies > 0")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(h, c, *_weights(p, n)) for h, p, n in zip(frame["host"], frame["path"], frame["varies"], strict=True) for c in ("", *_containers(p))]
            yield pd.DataFrame(rows, columns=["host", "path", "weight", "heads"])

    below = texts.mapInPandas(spread, "host string, path string, weight bigint, heads bigint").groupBy("host", "path").agg(F.sum("weight").alias("weight"), F.sum("heads").alias("heads"))
    tree = element.join(different, "host").filter("2 * support > different").select("host", "path")
    tree = tree.unionByName(different.select("host", F.lit("").alias("path")))
    held = tree.join(below, ["host", "path"], "left").fillna(0, ["weight", "heads"])

    def pick(rows) -> tuple[str, str]:
        found = {r["path"]: (r["weight"], r["heads"]) for r in rows}
        slot = choose(found)
        same = [c for c, w in found.items() if slot and c.startswith(slot + "/") and not sum(w) and c.split("/")[-1].partition(".")[0] not in LEAVES]
        return slot, "\n".join(sorted(same))

    best = held.groupBy("host").agg(F.collect_list(F.struct("path", "weight", "heads")).alias("rows"))
    best = best.withColumn("best", F.udf(pick, "slot string, fixed string")("rows"))
    return sizes.join(best, "host", "left").select("host", F.coalesce("best.slot", F.lit("")).alias("slot"), F.coalesce("best.fixed", F.lit("")).alias("fixed"), "pages")


def main_text(page: str, slot: str, fixed: str = "") -> str:
    """Blocks of the slot, or of the page's own best slot where the host's is missing."""
    paths, found = blocks(page)
    if not slot or slot not in paths:
        count: dict[str, int] = defaultdict(int)
        for p in paths:
            count[p] += 1
        below: dict[str, tuple[int, int]] = {c: (0, 0) for c in ("", *(p for p, n in count.items() if n == 1))}
        for p, t in found:
            w, h = _weights(p, len(t))
            for c in ("", *_containers(p)):
                if c in below:
                    below[c] = (below[c][0] + w, below[c][1] + h)
        slot, fixed = choose(below), ""
    same = tuple(fixed.split("\n")) if fixed else ()
    inside = [(p, t) for p, t in found if not slot or p == slot or p.startswith(slot + "/")]
    inside = [(p, t) for p, t in inside if not any(p == c or p.startswith(c + "/") for c in same)]
    named = [(p, t) for p, t in inside if not _outside(p[len(slot) :].strip("/").split("/"))]
    return "\n".join(t for _, t in named or inside)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    keyed = rows.withColumn("page_key", F.xxhash64("html"))
    joined = join_on_key(rows, templates(keyed).checkpoint(), "host", weight="pages")

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [main_text(p, s, x) for p, s, x in zip(frame["html"], frame["slot"], frame["fixed"], strict=True)]
            frame["n_chars"] = frame["text"].map(len)
            yield frame[["page_id", "url", "text", "n_chars"]]

    return joined.select("page_id", "url", "html", "slot", "fixed").mapInPandas(texts, "page_id bigint, url string, text string, n_chars bigint")
