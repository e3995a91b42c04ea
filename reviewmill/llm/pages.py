"""Main text of web pages, with the templates of their sites removed.

A page is read into blocks of text and the elements around them.  Menus, forms and
other parts that say what they are are left out at once.  Every other element
has a hash of its subtree; Spark counts on how many pages of a host it stands,
and subtrees that recur across many pages of the host are deleted.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm import common
from reviewmill.llm.urls import host
from reviewmill.operators import duplicates

#: A subtree is a template if it frames so many different pages of a host or of a section of it, and such a
#: share of them; the second share is for containers inside an article.
LEAST_PAGES, LEAST_SHARE, INSIDE_SHARE = 5, 0.05, 0.2

_TOKEN = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z)))",
    re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)\b", re.S)
_WORD = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr "
    "script style noscript template svg canvas iframe object button select textarea input audio video map".split())
_LEFT_OUT = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea iframe "
    "svg canvas object dialog menu title input datalist xmp noembed noframes audio video map".split())
#: Words in class, id or role by which an element says that it is not the article.
_MARKERS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead share sharing social related recommended recommendations comment comments "
    "disqus replies newsletter subscribe subscription login search complementary contentinfo dialog pagination "
    "pager widget toolbar".split())
#: Words by which a class says that something else is marked.
_DENIALS = frozenset("has no not with without".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Why an element is left out; articles open again in the first two, headings of an article in the first.
_HEADER, _MARKED, _GONE = 1, 2, 3
#: A block is in main, in an article, in one inside a marked element of main, or of the page.
_BODY, _ARTICLE, _AGAIN, _ALONE = 1, 2, 3, 4
#: Elements that are closed by the start of one of these.
_P_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split())
_SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
_BARRIERS = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
    "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",),
}
#: Inside an article, prose is content even where it recurs; containers may be templates.
_CONTAINERS = frozenset("div section ul ol dl table figure fieldset details center".split())


def _marks(token: str) -> str:
    """The marker word that a class, id or role begins or ends with, unless it says has-, no- or with-."""
    parts = _WORD.findall(token)
    if parts and parts[0] in _MARKERS:
        return parts[0]
    if parts and parts[-1] in _MARKERS and _DENIALS.isdisjoint(parts):
        return parts[-1]
    return ""


def _says_no(tag: str, rest: str) -> int:
    """Whether an element says that it is not the article: as a header, by a word, or for good."""
    if tag in _LEFT_OUT:
        return _HEADER if tag == "header" else _GONE
    if tag in _MAIN and "comment" not in rest and "hidden" not in rest or tag in ("html", "body"):
        return 0
    if "=" not in rest and "hidden" not in rest:
        return 0
    found = 0
    for name, a, b, c, hidden in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if hidden or name == "hidden" or name == "aria-hidden" and (a or b or c).lower() == "true":
            return _GONE
        if name in ("class", "id", "role"):
            for token in (a or b or c).lower().split():
                if word := _marks(token):
                    found = max(found, _HEADER if word in ("header", "masthead") else _MARKED)
    return found


class _Element:
    __slots__ = ("tag", "inline", "out", "main", "number", "kind", "hash")

    def __init__(self, tag, inline, out, main, number, kind):
        self.tag, self.inline, self.out, self.main, self.number = tag, inline, out, main, number
        self.kind = kind
        self.hash = None if out else xxhash.xxh64(tag.encode())


class Page:
    """Blocks of a page: their text, the kind of article they are in, and the element around."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.kinds: list[int] = []
        self.around: list[int] = []
        self.hashes: list[int] = []  # of elements that may be templates; 0: never one
        self.parents: list[int] = []
        self._open = [_Element("", False, 0, False, -1, 0)]
        self._pieces: list[str] = []
        self._counts: dict[str, int] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            token = _TOKEN.search(source, at)
            if token is None:
                self._text(source[at:])
                break
            if token.start() > at:
                self._text(source[at:token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["close"]:
                self._close(tag)
                continue
            rest = token["rest"]
            if not rest.endswith(">") and at >= end:
                break  # a tag cut off by the end of the page
            self._start(tag, rest)
            if tag in _RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = stop.start() if stop else end
        self._flush()
        while len(self._open) > 1:
            self._pop()

    def _text(self, text: str) -> None:
        if not self._open[-1].out:
            self._pieces.append(html.unescape(text) if "&" in text else text)

    def _flush(self) -> None:
        """The end of a block: its words, one space between."""
        if not self._pieces:
            return
        text = " ".join("".join(self._pieces).split())
        self._pieces.clear()
        if not text:
            return
        inner = next((e for e in reversed(self._open) if not e.inline), self._open[0])
        if inner.hash:
            inner.hash.update(b"\x00" + text.encode("utf-8", "surrogatepass") + b"\x01")
        self.texts.append(text)
        self.kinds.append(inner.kind)
        self.around.append(inner.number)

    def _start(self, tag: str, rest: str) -> None:
        if tag in _INLINE:
            if tag in _VOID:
                self._text(" " if tag == "br" else "")
            elif out := max(_says_no(tag, rest), self._open[-1].out):
                self._push(tag, True, out)
            return
        if tag in _P_ENDS and self._counts.get("p"):
            self._close_within(("p",), ("article", "section", "div", "table", "body", "td", "li"))
        if tag in _SIBLINGS:
            self._close_within(_SIBLINGS[tag], _BARRIERS[tag])
        self._flush()
        if tag not in _VOID:
            own, above = _says_no(tag, rest), self._open[-1]
            opens = not own and (tag in _MAIN and above.out in (_HEADER, _MARKED)
                                 or tag in _HEADINGS and above.out == _HEADER and above.main)
            self._push(tag, False, 0 if opens else max(own, above.out))

    def _push(self, tag: str, inline: bool, out: int) -> None:
        above = self._open[-1]
        if out or inline:
            number = above.number
        else:
            number = len(self.hashes)
            self.hashes.append(0)
            self.parents.append(above.number)
        kind = above.kind
        if not out and tag in _MAIN and kind not in (_AGAIN, _ALONE):
            kind = (_AGAIN if above.main else _ALONE) if above.out else _ARTICLE if tag == "article" else kind or _BODY
        self._open.append(_Element(tag, inline, out, above.main or not out and tag in _MAIN, number, kind))
        self._counts[tag] = self._counts.get(tag, 0) + 1

    def _pop(self) -> None:
        element = self._open.pop()
        self._counts[element.tag] -= 1
        if element.inline or element.out:
            return
        digest = element.hash.digest()
        inner = next((e for e in reversed(self._open) if not e.inline and not e.out), self._open[0])
        if inner.hash:
            inner.hash.update(digest)
        loose = not element.main and element.tag not in ("html", "body", "")
        if loose or element.tag in _CONTAINERS and inner.main:
            # The last bit says whether the element stands inside an article; 0 is no hash.
            number = int.from_bytes(digest, "big", signed=True) >> 1 << 1 or 2
            self.hashes[element.number] = number + (not loose)

    def _close(self, tag: str) -> None:
        """Close up to the nearest open element of this name; a stray end is passed over."""
        if tag in ("p", "br") and not self._counts.get("p"):
            self._text(" ")
        if tag in _INLINE:
            if self._open[-1].inline and self._counts.get(tag):
                while self._open[-1].inline and self._open.pop().tag != tag:
                    pass
                self._recount()
            return
        if not self._counts.get(tag):
            return
        self._flush()
        while self._open[-1].tag != tag:
            self._pop()
        self._pop()

    def _close_within(self, tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        """Close the outermost open element of `tags` that no barrier hides."""
        if not any(self._counts.get(t) for t in tags):
            return
        last = None
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag in tags:
                last = i
                if len(tags) == 1:
                    break
            elif self._open[i].tag in barriers:
                break
        if last is not None:
            self._flush()
            while len(self._open) > last:
                self._pop()

    def _recount(self) -> None:
        self._counts = {}
        for element in self._open:
            self._counts[element.tag] = self._counts.get(element.tag, 0) + 1

    def main_blocks(self) -> list[int]:
        """Numbers of the blocks of the article, or of all blocks if none is marked as one.

        Articles inside marked elements are teasers where there are others.
        """
        for first, chosen in ((_ARTICLE, (_BODY, _ARTICLE)), (_AGAIN, (_BODY, _AGAIN)), (_BODY, (_BODY,)),
                              (_ALONE, (_ALONE,))):
            if first in self.kinds:
                return [i for i, kind in enumerate(self.kinds) if kind in chosen]
        return list(range(len(self.texts)))


def _signed(columns: list) -> pa.Array:
    return pa.array(columns, pa.list_(pa.int64()))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
           html_col: str = "html") -> DataFrame:
    """(id, url, host, section, texts, around, hashes, parents): blocks with their element, elements with hash and parent."""
    schema = common.struct(
        (id_col, common.id_type(pages, id_col)), (url_col, "string"), ("host", "string"), ("section", "string"),
        ("texts", "array<string>"), ("around", "array<int>"), ("hashes", "array<bigint>"),
        ("parents", "array<int>"))

    def run(batch: pa.RecordBatch) -> dict:
        texts, around, hashes, parents = [], [], [], []
        for source in batch.column(4).to_pylist():
            page = Page(source or "")
            chosen = page.main_blocks()
            texts.append([page.texts[i].encode("utf-8", "replace").decode() for i in chosen])
            around.append([page.around[i] for i in chosen])
            hashes.append(page.hashes)
            parents.append(page.parents)
        return {id_col: batch.column(0), url_col: batch.column(1), "host": batch.column(2),
                "section": batch.column(3), "texts": pa.array(texts, pa.list_(pa.string())),
                "around": pa.array(around, pa.list_(pa.int32())),
                "hashes": _signed(hashes), "parents": pa.array(parents, pa.list_(pa.int32()))}

    section = F.coalesce(F.regexp_extract(url_col, "://[^/?#]*/([^/?#]*)/", 1), F.lit(""))
    read = pages.select(F.col(id_col), F.col(url_col), host(F.col(url_col)).alias("host"),
                        section.alias("section"), F.col(html_col))
    return common.map_rows(read, schema, run)


def recurring(blocks: DataFrame, least_pages: int) -> DataFrame:
    """(row, host, section, hash) of the subtrees that stand on several pages of their host, copies or not.

    Counts are combined before the shuffle; subtrees on very many pages find them by broadcast (`attach_groups`).
    """
    on_page = blocks.where("host <> ''").select(
        "row", "host", "section", F.explode(F.array_distinct("hashes")).alias("hash")).where("hash <> 0")
    return _marked(on_page, on_page.groupBy("host", "hash").agg(F.count("*").alias("copies"))
                   .where(F.col("copies") >= least_pages))


def _key() -> Column:
    return F.encode(F.concat_ws(" ", "hash", "host"), "utf-8")


def _marked(on_page: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of `on_page` whose (host, hash) is among those of `chosen`, which says how many rows that are."""
    groups = common.staged(chosen.select(
        _key().alias("dup_key"), F.lit(0).cast("bigint").alias("first_id"), "copies"), "page-subtrees")
    found = duplicates.attach_groups(on_page.withColumn("_key", _key()), groups, "_key", row_id="row")
    return found.where("_copies IS NOT NULL").drop("_first_id", "_copies")


def _kept(texts: list[str], around: list[int], hashes: list[int], parents: list[int],
          deleted: set[int]) -> list[str]:
    if not deleted:
        return texts
    gone: dict[int, bool] = {-1: False}
    for i, h in enumerate(hashes):  # an element comes after the one it is in
        gone[i] = h in deleted or gone[parents[i]]
    return [t for t, i in zip(texts, around) if not gone[i]]


def framing(blocks: DataFrame, found: DataFrame, least_pages: int, least_share: float,
            inside_share: float) -> DataFrame:
    """(host, hash, copies) of the templates among the recurring subtrees `found`.

    What is left of a page without any of them is its rest.  Pages with one rest are
    copies and count once, as do repeated rows; pages without a rest say nothing.  A template has enough
    rests, and enough of all rests of its host or of one of the host's sections.
    """
    schema = common.struct(("row", "bigint"), ("host", "string"), ("section", "string"), ("rest", "binary"))

    def run(batch: pa.RecordBatch) -> dict:
        columns = [c.to_pylist() for c in batch.columns[3:]]
        left = ["\n".join(_kept(t, a, h, p, set(d or ()))) for t, a, h, p, d in zip(*columns)]
        return {"row": batch.column(0), "host": batch.column(1), "section": batch.column(2), "rest": [
            xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) if x else None for x in left]}

    candidates = found.groupBy("row").agg(F.collect_list("hash").alias("candidates"))
    joined = blocks.where("host <> ''").join(candidates, "row", "left").select(
        "row", "host", "section", "texts", "around", "hashes", "parents", "candidates")
    rests = common.staged(common.map_rows(joined, schema, run).where("rest IS NOT NULL"), "page-rests")
    votes = found.select("row", "hash").join(rests, "row")

    def shares(*of: str) -> DataFrame:
        """(host, hash, copies) by hosts or by sections."""
        sizes = rests.select(*of, "rest").distinct().groupBy(*of).agg(F.count("*").alias("size"))
        cast = votes.groupBy(*of, "hash", "rest").agg(F.count("*").alias("rows")).groupBy(*of, "hash").agg(
            F.count("*").alias("rests"), F.sum("rows").alias("copies")).where(F.col("rests") >= least_pages)
        share = F.when(F.pmod("hash", F.lit(2)) == 1, inside_share).otherwise(least_share)
        return cast.join(sizes, [*of]).where(F.col("rests") >= share * F.col("size")).select(
            "host", "hash", "copies")

    return shares("host").unionByName(shares("host", "section")).groupBy("host", "hash").agg(
        F.max("copies").alias("copies"))


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE,
              inside_share: float = INSIDE_SHARE, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of `pages`, from the whole page.

    The text is the article if one is marked, else the page without the parts that
    name themselves something else; in both, templates are deleted: subtrees that frame at least
    `least_pages` different pages of their host, or of a section of it (by the first part of the path), and
    `least_share` of them; `inside_share` in an article, where only containers can be templates and prose
    stays.  Pages that are equal but for recurring subtrees are copies and count once, so a
    page alone and the same page many times have the same text.  Blocks are joined
    by a line feed, white space in a block is one space, character references are
    decoded.  Missing or empty pages have an empty text; a page without a host
    has no templates.  Repeated rows give repeated results.
    Other columns are left out.  Broken markup never fails: stray ends are passed
    over, open elements end with the page.
    """
    blocks = common.staged(
        parsed(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()),
        "page-blocks")
    found = common.staged(recurring(blocks, least_pages), "page-recurring")
    deleted = _marked(found, framing(blocks, found, least_pages, least_share, inside_share))
    deleted = common.staged(
        deleted.groupBy("row").agg(F.collect_list("hash").alias("deleted")), "page-templates")
    schema = common.struct((id_col, common.id_type(pages, id_col)), (url_col, "string"),
                           ("text", "string"), ("n_chars", "bigint"))

    def run(batch: pa.RecordBatch) -> dict:
        columns = [c.to_pylist() for c in batch.columns[2:]]
        out = ["\n".join(_kept(t, a, h, p, set(d or ()))) for t, a, h, p, d in zip(*columns)]
        return {id_col: batch.column(0), url_col: batch.column(1), "text": out,
                "n_chars": [len(t) for t in out]}

    joined = blocks.join(deleted, "row", "left").select(
        id_col, url_col, "texts", "around", "hashes", "parents", "deleted")
    return common.map_rows(joined, schema, run)
