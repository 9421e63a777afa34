"""Main text of web pages by consensus of each host's pages on where it stands."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encodelens.llm.common import named, written

# Fixed values of HTML: elements without an end tag, elements whose content is no markup, elements that start a
# block, start tags that close an open <p>, and elements that never hold the article's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html title".split())
OUT = frozenset("nav aside footer form button select option input label menu dialog head iframe object embed canvas audio video".split())
CONTAINER = frozenset("article main section div body td blockquote center details".split())
#: Roles and words in class names and ids of what is no article text.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
SIDE = frozenset(
    "ad adbox ads adslot adunit advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related recommended replies respond "
    "rss share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets hidden sidenav reply responses copyright alert overlay teaser".split()
)
#: Words that no element of an article has as a whole name, and those that a container within an article may have.
NEVER = frozenset("ad adbox ads adslot adunit advert adverts advertisement advertising adsense comment comments consent cookie cookies disqus gdpr newsletter promo promoted promotion reply replies sponsor sponsored subscribe subscription".split())
INNER = frozenset("header masthead banner overlay".split())
#: Words that say what kind of box a name means and nothing of its matter: comment-list and share-buttons are all furniture, related-work is not.
BOXES = frozenset("area bar block box button buttons card cards container content group icon icons inner item items left link links list module outer panel post posts right row section slot thread top bottom unit wrap wrapper".split())
COMMENTLIKE = frozenset("commentlist commentslist commentarea commentsarea commentthread replylist".split())
TEXTUAL = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dd dt figure figcaption span b i em strong a".split())
#: Tags of one name that close an open element of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_TAG_END = re.compile(r"=\s*([\"'])|>")
#: Elements looked at from the innermost out when a tag closes others, and steps of a path; what is deeper counts as there.
DEPTH = 64
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_GAP = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


def _aside(tag: str, attr: dict[str, str], names: bool = True, inner: bool = False) -> bool:
    """Whether an element holds none of the article's text, by its kind, role, being hidden, and class and id names.

    inner: within an article or main element, where names tell less: its paragraphs, quotes and headings go by a whole
    name alone that only adverts, comments and the like have; its containers by a name whose every word speaks of
    furniture or of the box around it, so that sections on related work or social history stay, and may be headers.
    """
    if tag in OUT or "hidden" in attr or attr.get("aria-hidden") == "true" or attr.get("role", "").lower() in ROLES:
        return True
    if "display:none" in attr.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("article", "main", "body", "html") or not names:
        return False
    named = f"{attr.get('class', '')} {attr.get('id', '')}"
    if named == " ":
        return False
    if inner and tag in TEXTUAL:
        return not NEVER.isdisjoint(named.lower().split())
    if inner:
        return any(_furniture({w.lower() for w in _WORD.findall(name)}) for name in named.split())
    words = {w.lower() for w in _WORD.findall(named)}
    return not (SIDE | COMMENTLIKE).isdisjoint(words)


def _furniture(words: set[str]) -> bool:
    """Whether all words of one name speak of furniture or boxes, and one of furniture that an article can do without."""
    speaking = words - BOXES
    return bool(speaking) and speaking <= SIDE | COMMENTLIKE and not speaking <= INNER


def _tag_end(html: str, at: int) -> int:
    """Where the tag ends whose name ends at `at`: at the first > outside quoted values; a quote never closed is none.

    A text without that end is all tag. Each character is looked at a bounded number of times.
    """
    while (m := _TAG_END.search(html, at)) is not None:
        if m[1] is None:
            return m.start()
        close = html.find(m[1], m.end())
        at = m.end() if close < 0 else close + 1
    return len(html)


def general(tag: str, attr: dict[str, str]) -> str:
    """A tag with its classes, without what numbers pages or posts: div.post-12 and div.post-7 are both div.post-#."""
    names = sorted({re.sub(r"\d+", "#", c) for c in attr.get("class", "").split()})
    return ".".join([tag, *names])


def blocks(html: str | None, names: bool = True, spared: frozenset[int] = frozenset(), marks: list | None = None) -> Iterator[tuple[str, str, int]]:
    """(path, text, link characters) of each block of text outside scripts, menus and the like, in page order.

    The path names the containers around the block, from the outermost in, as generalised tag-class steps. With
    names=False class and id names put no element aside, nor do those of elements that start at an offset of spared.
    marks gets, for each block, the elements around it with such names: (offset, path), from the outermost in.
    """
    if not html:
        return
    # tag, whether it is aside, the path down to it, its depth in containers, where an open <p> is that a block
    # closes, and whether an article or main element is around
    stack: list[tuple[str, bool, str, int, int, bool]] = []
    opened: dict[str, int] = {}
    named: list[tuple[int, int, str]] = []  # place in stack, offset, path of open elements that only their names put aside
    text: list[str] = []
    links, at, end = 0, 0, len(html)
    off = 0  # open elements that are aside

    def flush() -> tuple[str, str, int] | None:
        nonlocal text, links
        joined, n = _GAP.sub(" ", "".join(text)).strip(), links
        text, links = [], 0
        if joined and marks is not None:
            marks.append([(o, p) for _, o, p in named])
        return (stack[-1][2] if stack else "", joined, n) if joined else None

    def closed(upto: int) -> None:
        nonlocal off
        for x in stack[upto:]:
            off -= x[1]
            opened[x[0]] -= 1
        del stack[upto:]
        while named and named[-1][0] >= upto:
            named.pop()

    def innermost(tags: tuple[str, ...] | str, stops, least: int) -> int:
        for i in range(len(stack) - 1, max(least, -1), -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stops:
                break
        return -1

    in_link = 0
    while at < end:
        m = _OPEN.search(html, at)
        stop = m.start() if m else end
        if stop > at and not off:
            piece = html[at:stop]
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            links += len(piece.strip()) if in_link else 0
        if not m:
            break
        if m[1] or m[2]:  # comments, doctypes and the like leave the text as it is
            close = "-->" if m[1] else "]]>"
            at = html.find(close, m.end())
            at = end if at < 0 else at + len(close)
            continue
        if m[3]:
            at = html.find(">", m.end())
            at = end if at < 0 else at + 1
            continue
        tag = m[5].lower()
        close = _tag_end(html, m.end()) if not m[4] else html.find(">", m.end())
        raw, at = html[m.end() : close], end if close < 0 else min(end, close + 1)
        if not m[4]:
            if close >= end:
                break  # a tag without an end
            if tag in RAW:
                done = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
                at = done.end() if done else end
                continue
            if tag in BLOCK or tag == "br":
                if tag == "br":
                    text.append(" ")
                elif (b := flush()) is not None:
                    yield b
            if tag in CLOSES_P and stack and stack[-1][4] >= 0:
                closed(stack[-1][4])
            if tag in SIBLINGS and (i := innermost(SIBLINGS[tag], STOPS[tag], len(stack) - 1 - DEPTH)) >= 0:
                closed(i)
            if tag == "a":
                in_link += 1
            if tag in VOID or raw.endswith("/") and tag not in BLOCK:
                continue
            attr = _attributes(raw)
            up = stack[-1] if stack else ("", False, "", 0, -1, False)
            aside = _aside(tag, attr, names and m.start() not in spared, up[5]) or tag == "header" and not up[5]
            off += aside
            holds = tag in CONTAINER
            deep = holds and up[3] < DEPTH
            path = f"{up[2]}/{general(tag, attr)}".lstrip("/") if deep else up[2]
            stack.append((tag, aside, path, up[3] + deep, len(stack) if tag == "p" else -1 if holds else up[4], up[5] or tag in ("article", "main")))
            opened[tag] = opened.get(tag, 0) + 1
            if marks is not None and not aside and tag in BLOCK and len(named) < DEPTH and _aside(tag, attr, inner=up[5]):
                named.append((len(stack) - 1, m.start(), path))
        else:
            if tag in BLOCK and (b := flush()) is not None:
                yield b
            if tag == "a":
                in_link = max(0, in_link - 1)
            if opened.get(tag):
                # a stray inline end tag closes no block
                i = innermost((tag,), () if tag in BLOCK else BLOCK, -1 if tag in BLOCK else len(stack) - 1 - DEPTH)
                if i >= 0:
                    closed(i)
    if (b := flush()) is not None:
        yield b


_ARTICLE = re.compile(r"(?:^|/)(?:article|main)(?=[./]|$)")


def page_blocks(html: str | None) -> list[tuple[str, str, int]]:
    """blocks(), with the articles and main elements under elements that names put aside if the page has no others.

    A page with neither spares the named elements that hold most of its running text in containers of their own: those
    wrap the page. Text that stands in a named element itself stays aside, as do named elements within a wrapper.
    """
    found = list(blocks(html))
    if not html or any(_ARTICLE.search(p) for p, _, _ in found):
        return found
    marks: list[list[tuple[int, str]]] = []
    every = list(blocks(html, names=False, marks=marks))
    if not any(marks):
        return found
    # an article under fewer named elements is the page's; those of its comments lie deeper
    held = [m for (p, _, _), m in zip(every, marks) if m and _ARTICLE.search(p)]
    if held:
        least, again = min(map(len, held)), []
        wraps = frozenset(o for m in held if len(m) == least for o, _ in m)
        every = list(blocks(html, spared=wraps, marks=again))
        return [b for b, m in zip(every, again) if not m or _ARTICLE.search(b[0])]
    sizes = [max(0, len(t) - 3 * n) for _, t, n in every]
    inside: dict[tuple[int, str], int] = {}
    nested = set()
    for n, around, (p, _, _) in zip(sizes, marks, every):
        for at in around:
            inside[at] = inside.get(at, 0) + n
            if p != at[1]:
                nested.add(at)
    spared = {at[0] for at in nested if 2 * inside[at] > sum(sizes)}
    return list(blocks(html, spared=frozenset(spared))) if spared else found


def scores(found: list[tuple[str, str, int]]) -> dict[str, float]:
    """Per container path, the characters of running text directly in it, less three times those in links."""
    out: dict[str, float] = {}
    for path, text, links in found:
        out[path] = out.get(path, 0.0) + len(text) - 3 * links
    return out


def under(path: str, root: str) -> bool:
    return path == root or path.startswith(root + "/")


def best_path(found: dict[str, float]) -> str | None:
    """The vote of a page: the innermost container that holds four fifths of all the page's running text."""
    positive = {p: s for p, s in found.items() if s > 0}
    if not positive:
        return None
    total, best = sum(positive.values()), max(positive, key=lambda p: (positive[p], p))
    steps = best.split("/")
    for n in range(len(steps), 0, -1):
        root = "/".join(steps[:n])
        if sum(s for p, s in positive.items() if under(p, root)) >= 0.8 * total:
            return root
    return steps[0] if best else ""


def whole(root: str | None) -> str | None:
    """A container path cut at its outermost article, or else its innermost main, so that headings and leads beside its text stay."""
    steps = (root or "").split("/")
    kinds = [s.split(".")[0] for s in steps]
    if "article" in kinds:
        return "/".join(steps[: kinds.index("article") + 1])
    return "/".join(steps[: len(steps) - kinds[::-1].index("main")]) if "main" in kinds else root


def extract(html: str | None, root: str | None) -> str:
    """The text blocks under a host's container path, joined by blank lines, in page order.

    With less than half the running text there that the page's own vote has (another layout), those of its vote come too.
    """
    found = page_blocks(html)
    votes = scores(found)
    own, roots = whole(best_path(votes)), [root] if root is not None else []
    held = [sum(s for p, s in votes.items() if s > 0 and r is not None and (under(p, r) or not r)) for r in (root, own)]
    if own is not None and held[0] < 0.5 * held[1]:
        roots.append(own)
    kept = [t for p, t, _ in found if any(under(p, r) for r in roots) or own in roots and not own]
    return "\n\n".join(kept)


def host_of(url: str = "url"):
    """The host of a URL in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(named(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the container path that most of a host's pages vote for; ties go to the longer, then by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str, str], int] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = whole(best_path(scores(page_blocks(html))))
                if path is not None:
                    votes[host, path] = votes.get((host, path), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "n"])

    votes = pages.select(host_of(url_col).alias("host"), named(html_col).alias("html")).mapInArrow(run, "host string, path string, n long")
    votes = votes.groupBy("host", "path").agg(F.sum("n").alias("n"))
    return votes.groupBy("host").agg(F.max(F.struct("n", F.length("path").alias("l"), "path")).alias("best")).select("host", "best.path")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, url, text, path) of each page: the main text, from the container its host's pages agree on.

    Each page votes; votes are summed per host before the shuffle, and the winners, a row a host, go back to all pages:
    by broadcast while their text is under broadcast_bytes, else by a join on the host, in which a host's pages are
    dealt out by salt. A page with less than half its text there (another layout) adds what its own vote has. Null html
    counts as empty and gives empty text; a null url belongs to the empty host; repeated rows are pages each and vote
    each; of paths with equal votes the longer wins, then the greater by name; other columns are ignored. Containers
    more than DEPTH deep count as their ancestor at that depth.
    """
    paths = written(host_paths(pages, url_col, html_col), "host-paths")
    weight = paths.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0]
    rows = pages.select(named(id_col).alias("id"), named(url_col).alias("url"), host_of(url_col).alias("host"), named(html_col).alias("html"))
    if weight <= broadcast_bytes:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts))).join(paths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["host", "_salt"], "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), b.column(3)], ["id", "url", "text", "path"])

    return joined.select("id", "url", "html", "path").mapInArrow(run, f"id {kind}, url string, text string, path string")
