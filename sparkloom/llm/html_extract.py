"""Main text of web pages: each page scores its containers, the pages of a host vote, winning paths extract."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from .common import with_columns, written
from .url_filter import host_of

#: Markup, without backing up: an unclosed quotation mark is a character like others.
TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open comment or declaration at the end of a page; the end of each element whose content isn't markup.
OPEN = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?][^>]*+", re.S)
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
CONTAINER = frozenset("article main section div td".split())
DROPPED = frozenset("head nav aside footer form script style noscript template iframe svg canvas object button select input textarea dialog menu audio video map".split())
#: Parts of a class or id that make an element suspect of not being the article, by what it may be. What it holds decides.
READERS = frozenset("comment comments commentlist disqus respond replies".split())
ANSWERS = frozenset("reply".split())
FURNITURE = frozenset("nav navbar navigation menu menubar sidebar aside footer header masthead topbar breadcrumb breadcrumbs toolbar pagination pager copyright disclaimer skip hidden widget".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion".split())
NOTICES = frozenset("banner notice notices alert popup modal overlay".split())
CONSENT = frozenset("cookie cookies consent gdpr".split())
ASKING = frozenset("newsletter subscribe subscription signup login search".split())
ELSEWHERE = frozenset("share sharing social related recommended recommendations".split())
SUSPECT = READERS | ANSWERS | FURNITURE | ADVERTS | NOTICES | CONSENT | ASKING | ELSEWHERE
#: Parts that say nothing of what an element is, and parts that speak of a page's state: a name with one of these isn't a suspect's.
COMMON = frozenset("area bar block box column container frame group inner item items link links list outer panel row section site slot small large top bottom left right unit wrap wrapper zone".split())
STATE = frozenset("open opened closed enabled disabled off on count has no with without is".split())
#: Parts that, beside one of ELSEWHERE, mean other articles; parts of the site's own header inside an article.
OTHERS = frozenset("posts articles stories news content reading videos topics pages".split())
SITE = frozenset("site global masthead topbar nav navbar".split())
#: Characters of sentences from which on an element is an article about advertising or cookies, and not one of these.
LONG = 600
#: Elements that names don't take out: headings, and what stands inside a line.
NAMED = frozenset("h1 h2 h3 h4 h5 h6 hgroup a abbr b bdi bdo cite code data del dfn em i ins kbd mark math q rp rt ruby s samp small strong sub sup time u var".split())
#: Elements that a reader fills in or presses.
CONTROLS = frozenset("form input button select textarea".split())
#: Parts that mark the article itself.
MAIN = frozenset("article content main post entry story body text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

#: Least share of a host's votes for a path to win, beside the path with the most votes.
SHARE = 0.1


SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*$")


def _pieces(word: str) -> frozenset[str]:
    return frozenset(p for p in re.split(r"[^a-z]+", word) if p)


def _names(attributes: str) -> tuple[list[str], list[frozenset[str]], bool]:
    """Generalised class and id parts (digits and ids of chance removed), the pieces of the suspect ones, and whether the element is hidden or has a role beside the article."""
    parts, suspect, hidden = [], [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for word in value.split():
                parts.append(re.sub(r"[0-9]+", "#", word))
                if (pieces := _pieces(word)) & SUSPECT and not pieces & STATE:
                    suspect.append(pieces)
        elif key == "role":
            hidden |= value.strip() in ROLES
        elif key == "hidden" or "display:none" in value.replace(" ", ""):
            hidden |= key in ("hidden", "style")
    return parts, suspect, hidden


def _whole(pieces: frozenset[str]) -> bool:
    """Nothing in the name but what makes it suspect."""
    return pieces <= SUSPECT | COMMON


def unwanted(pieces: frozenset[str], tag: str, text: int, linked: int, sentences: int, controls: int, alike: int) -> bool:
    """Whether an element with a suspect name is not of the article, by its characters, those inside links and those of sentences, its form controls, and the elements like it beside it."""
    prose = sentences > 0 and 2 * sentences >= text and 5 * linked < 2 * text
    if pieces & READERS:
        return True
    if pieces & FURNITURE and _whole(pieces):
        return True
    if pieces & ADVERTS:
        return _whole(pieces) or sentences < LONG
    if pieces & CONSENT:
        return sentences < LONG
    if pieces & NOTICES:
        return not prose or tag != "p" and _whole(pieces) and sentences < LONG
    if pieces & ASKING:
        return controls > 0 or not prose or "form" in pieces or bool(pieces & {"newsletter", "signup", "login"}) and sentences < LONG // 2
    if pieces & ANSWERS:
        return controls > 0 or alike > 1 or not prose
    return pieces & ELSEWHERE != frozenset() and (bool(pieces & OTHERS) or not prose)


class Page:
    """Blocks of text, each with the container around it; containers have a generalised tag-class path.

    Container 0 is the page's body, there from the start to the end; html and body tags only name it. Containers are
    numbered in page order, each after the one around it, and a path is its last part with a hash of all parts, so
    that time and memory grow with the page, however deep or broken its markup is.
    """

    def __init__(self, html: str):
        self.paths: list[str] = [self._path("", "body", [])]
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["body"]
        self.names: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self._suspects: list[list] = []  # pieces, tag, container around, suspect around, first block, block after the last, form controls
        self._open: list[int] = []
        self._controls = 0
        self._read(html)
        self._judge()

    def _judge(self) -> None:
        """Leave out the blocks of suspect elements that turn out not to be of the article, inner ones first; sums over blocks are taken once."""
        if not self._suspects:
            return
        text, linked, sentences = [0], [0], [0]
        for _, t, n in self.blocks:
            text.append(text[-1] + len(t))
            linked.append(linked[-1] + min(n, len(t)))
            sentences.append(sentences[-1] + (len(t) if SENTENCE_END.search(t[-8:]) and t.count(" ") >= 2 else 0))
        like = Counter((around, tag, pieces) for pieces, tag, around, *_ in self._suspects)
        edges, gone = [0] * (len(self.blocks) + 1), [[0, 0, 0, 0] for _ in self._suspects]
        for k in range(len(self._suspects) - 1, -1, -1):  # what stands inside comes later
            pieces, tag, around, outer, lo, hi, controls = self._suspects[k]
            whole = [text[hi] - text[lo], linked[hi] - linked[lo], sentences[hi] - sentences[lo], controls]
            out = any(unwanted(p, tag, *[w - g for w, g in zip(whole, gone[k], strict=True)], like[around, tag, pieces]) for p in pieces)
            if out:
                edges[lo] += 1
                edges[hi] -= 1
            if outer >= 0:
                gone[outer] = [a + b for a, b in zip(gone[outer], whole if out else gone[k], strict=True)]
        kept, depth = [], 0
        for block, edge in zip(self.blocks, edges, strict=False):
            depth += edge
            if not depth:
                kept.append(block)
        self.blocks = kept

    @staticmethod
    def _path(around: str, tag: str, names: list[str]) -> str:
        part = ".".join([tag, *sorted(set(names))])
        return f"{part}:{xxh64_hexdigest(around + '>' + part)}" if around else part

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, -1)]  # tag, container, dropped, in a link, in an article, suspect
        opened: Counter[str] = Counter()
        text: list[str] = []
        linked = 0

        def close_block() -> None:
            nonlocal linked
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                if joined:
                    self.blocks.append((stack[-1][1], joined, linked))
                text.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                if stack[-1][0] in BLOCK:
                    close_block()
                gone = stack.pop()
                opened[gone[0]] -= 1
                if gone[5] >= 0:
                    self._open.pop()
                    suspect = self._suspects[gone[5]]
                    suspect[5:] = [len(self.blocks), self._controls - suspect[6]]

        at, end, last = 0, len(html), html.rfind(">") + 1
        while at < end:
            # Beyond the last > there is no tag, but there may be an open comment.
            m = TOKEN.search(html, at) if at < last else OPEN.search(html, at)
            stop = m.start() if m else end
            if stop > at and not stack[-1][2]:
                piece = html[at:stop]
                text.append(piece)
                linked += len(piece) if stack[-1][3] else 0
            if not m:
                break
            at = m.end()
            if m.re is OPEN or m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in ("br", "hr"):
                    text.append(" ")
                if opened[tag]:
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    pop_to(depth)
                continue
            if tag in ("html", "body"):
                close_block()
                if tag == "body" and len(self.paths) == 1 and not self.names[0]:
                    self.names[0] = _names(m[3])[0]
                    self.paths[0] = self._path("", "body", self.names[0])
                continue
            if tag in BLOCK:
                like = tag in ("li", "dt", "dd", "option", "tr", "td", "th")
                if opened["p"] or like and opened[tag]:
                    for i in range(len(stack) - 1, 0, -1):  # an open p ends where a block starts; li, dt, dd, tr, td, option end at their like
                        if stack[i][0] == "p" or like and stack[i][0] == tag:
                            pop_to(i)
                            break
                        if stack[i][0] in CONTAINER or stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                            break
                close_block()
            _, around, dropped, link, inside, _ = stack[-1]
            self._controls += tag in CONTROLS
            if tag in VOID:
                text.append(" ")
                continue
            if tag in RAW:
                close = RAW_END[tag].search(html, at)
                if tag == "xmp" and not dropped:  # its text stands as it is, without markup and references
                    close_block()
                    text.append(html[at : close.start() if close else end].replace("&", "&amp;"))
                    close_block()
                at = close.end() if close else end
                continue
            suspect = -1
            if not dropped:
                names, suspects, hidden = _names(m[3])
                own = tag in ("article", "main") or tag == "header" and inside  # the article, and its heading part
                dropped = tag in DROPPED or hidden or tag == "header" and (not inside or any(p & SITE for p in suspects))
                if suspects and not dropped and not own and tag not in NAMED:
                    if tag in BLOCK:  # judged when the page has been read
                        suspect = len(self._suspects)
                        self._suspects.append([tuple(suspects), tag, around, self._open[-1] if self._open else -1, len(self.blocks), 0, self._controls])
                        self._open.append(suspect)
                    else:
                        dropped = any(map(_whole, suspects))
                if tag in CONTAINER and not dropped:
                    self.paths.append(self._path(self.paths[around], tag, names))
                    self.parents.append(around)
                    self.tags.append(tag)
                    self.names.append(names)
                    around = len(self.paths) - 1
            if m[3].rstrip().endswith("/") and tag not in BLOCK:
                continue
            stack.append((tag, around, dropped, link or tag == "a", inside or tag in ("article", "main"), suspect))
            opened[tag] += 1
        pop_to(1)
        close_block()

    def scores(self) -> dict[int, float]:
        """Characters outside links; half of a container's score counts for the one around it. Names and tags of articles weigh more."""
        total, held = [0.0] * len(self.paths), [False] * len(self.paths)
        for container, text, linked in self.blocks:
            total[container] += max(0.0, len(text) - 3.0 * linked)
            held[container] = True
        out: dict[int, float] = {}
        for c in range(len(self.paths) - 1, -1, -1):  # what stands inside comes later
            if not held[c]:
                continue
            if c:
                total[self.parents[c]] += 0.5 * total[c]
                held[self.parents[c]] = True
            pieces = {p for n in self.names[c] for p in re.split(r"[^a-z]+", n)}
            out[c] = total[c] * (4.0 if self.tags[c] in ("article", "main") else 2.0 if pieces & MAIN else 0.5 if self.tags[c] == "body" else 1.0)
        return out

    def best(self) -> int:
        scores = self.scores()
        return max(scores, key=lambda c: (scores[c], -c), default=-1)

    def _under(self, chosen: set[int]) -> list[bool]:
        under: list[bool] = []
        for c, around in enumerate(self.parents):
            under.append(c in chosen or around >= 0 and under[around])
        return under

    def text(self, paths: set[str]) -> str:
        """Blocks under the containers with one of these paths; without such a container, under the page's own best one."""
        under = self._under({i for i, p in enumerate(self.paths) if p in paths})
        if not any(under[c] for c, _, _ in self.blocks):
            under = self._under({self.best()})
        return "\n".join(t for c, t, _ in self.blocks if under[c])


def _voted(html: str | None) -> str | None:
    page = Page(html) if html else None
    best = page.best() if page else -1
    return page.paths[best] if best >= 0 else None


def _extracted(html: str | None, paths) -> str:
    return Page(html).text(set(paths) if paths is not None else set()) if html else ""


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """host, paths: the path with the most votes of a host's pages, and others with at least ``share`` of them (so at most 1/share)."""

    @F.pandas_udf("string")
    def vote(htmls: pd.Series) -> pd.Series:
        return htmls.map(_voted)

    votes = pages.select(host_of(F.col(url_col)).alias("host"), vote.asNondeterministic()(html_col).alias("path")).where("path is not null").groupBy("host", "path").count()
    totals = votes.groupBy("host").agg(F.sum("count").alias("all"), F.max_by("path", F.struct("count", "path")).alias("top"))
    won = votes.join(totals, "host").where((F.col("count") >= share * F.col("all")) | (F.col("path") == F.col("top")))
    return won.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """pages with ``text``, the article of the page.

    Every page votes for the generalised tag-class path of its best container, votes are counted by host in Spark,
    and every page is read again with its host's winning paths; a page that has none of them uses its own best
    container. White space inside a block becomes one space, blocks are joined in page order by a line feed; nothing
    else is dropped or capped. A br is white space in its block.

    Nulls: a null or empty html has an empty text; a null url counts as the empty host. Repeated rows vote each and
    get equal texts. Empty table: empty result. An input column named text is replaced; others pass through.
    """

    @F.pandas_udf("string")
    def extract(htmls: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([_extracted(h, p) for h, p in zip(htmls, paths, strict=True)], index=htmls.index, dtype=object)

    # Written, so that its size is known before the join is planned: pages are shuffled only if it is large.
    winners = written(winning_paths(pages, url_col, html_col, share), "paths").withColumnsRenamed({"host": "__host", "paths": "__paths"})
    joined = pages.withColumn("__of", F.coalesce(host_of(F.col(url_col)), F.lit(""))).join(winners, F.col("__of") == F.col("__host"), "left")
    return with_columns(joined.withColumn("__text", extract.asNondeterministic()(html_col, "__paths")), {"text": F.col("__text")}).drop("__of", "__host", "__paths", "__text")
