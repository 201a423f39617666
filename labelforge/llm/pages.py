"""Main text of web pages by removal of their sites' templates.

Every page's tree is read, and each block element gets a hash of its subtree
(tags and text, no attributes). Spark counts for each host how many different
pages have a subtree; one that recurs on ``SHARE`` of them, and on ``LEAST`` at
least, belongs to the site's template and is cut out of each page. Pages of one
title and headline count as one, so copies of an article don't make it a
template. Inside the part that a page itself marks as its article, or beside
prose that does not recur, recurring paragraphs are the author's and stay.

What recurs nowhere (an advert shown once, a site of one page) is told by what
the page says of it: the element's tag, role, or a word of its class or id
(``TAGS``, ``ROLES``, ``NAMES``).

Results for odd rows: a null html or one without text gives an empty text, a
null url is a host of its own, repeated rows are repeated in the result, other
columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from labelforge.llm.common import bounded_batches, saved, sorted_join

#: A subtree is a template's if it stands on this share of its host's pages, and
#: on so many. The share bounds a host's templates: with E subtrees on its mean
#: page there are E / SHARE at most.
SHARE, LEAST = 0.02, 3
#: Pages of one host that meet in one task, about: a 1,000th of all, or so many.
SALTED = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr br img".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption "
                  "hr address details summary".split())
#: Elements that are never the article's text.
TAGS = frozenset("script style noscript template head title iframe object embed svg math canvas audio video form button select input "
                 "textarea option datalist dialog nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert status form menu menubar toolbar".split())
#: Words of a class or id that name such an element.
NAMES = re.compile(r"(?:^|[^a-z])(?:ads?|advert(?:s|isements?|ising)?|adsense|adsbygoogle|sponsor(?:ed|s)?|promos?|promotions?|banners?|"
                   r"nav|navbar|navigation|menus?|submenu|breadcrumbs?|sidebars?|aside|footers?|masthead|topbar|toolbar|pagination|pager|"
                   r"cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|"
                   r"social|share|sharing|sharebar|related|recommend(?:ed|ations)?|teasers?|trending|popular|widgets?|search|searchform|"
                   r"comments?|commentlist|respond|replies|disqus|skip|hidden|outbrain|taboola)(?:$|[^a-z])")
#: Names of the page's head, which inside an article may hold its headline.
HEADS = re.compile(r"(?:^|[^a-z])(?:header|site-header|page-header|head)(?:$|[^a-z])")

#: Names, at a word's start, of elements beside the article: an article in one of
#: them is a comment or a teaser (a ``has-sidebar`` around the page isn't one).
BESIDE = re.compile(r"(?:^|\s)(?:comment|repl(?:y|ies)|respond|disqus|related|recommend|teaser|trending|popular|sidebar|widget)")

#: An open element that a start tag ends, and where the search for it stops.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "hash", "chars", "linked")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.hash = self.chars = self.linked = 0

    def up(self) -> Iterator[Node]:
        n = self
        while n is not None:
            yield n
            n = n.parent


#: A comment, tag or declaration; quotes count only behind an equals sign.
MARKUP = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
#: Elements whose content is no markup, and those of them that hold text.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
RAW_TEXT = ("textarea", "title")
#: Start tags of blocks end an open paragraph, unless one of these holds it.
HOLDS_P = frozenset("div section article main td th li blockquote button object form".split())


def tree(html: str) -> list[Node]:
    """The elements of a page in page order; missing end tags are supplied, and
    a tag that the page's end cuts off is left out."""
    top = Node("", {}, None)
    nodes, open_ = [top], [top]
    at = 0

    def end(tags, stops) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                del open_[k:]
                return
            if open_[k].tag in stops:
                return

    def say(text: str) -> None:
        if text:
            open_[-1].kids.append(unescape(text) if "&" in text else text)

    while found := MARKUP.search(html, at):
        say(html[at:found.start()])
        at = found.end()
        closes, tag, rest = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closes:
            if tag in VOID or tag in ("body", "html"):
                continue
            if open_[-1].tag == tag and len(open_) > 1:
                open_.pop()
            else:
                end((tag,), {n.tag for n in open_ if n.tag not in INLINE} if tag in INLINE else ())
            continue
        if tag in ENDED_BY:
            end(*ENDED_BY[tag])
        if tag not in INLINE and (tag not in VOID or tag == "hr"):
            end(("p",), HOLDS_P)
        if tag == "body":
            end(("head",), ())
        attrs = {k.lower(): v1 or v2 or v3 for k, v1, v2, v3 in ATTRIBUTE.findall(rest)} if "=" in rest or "hidden" in rest else {}
        node = Node(tag, attrs, open_[-1])
        open_[-1].kids.append(node)
        nodes.append(node)
        if tag in RAW:
            stop = RAW[tag].search(html, at)
            if tag in RAW_TEXT:
                node.kids.append(unescape(html[at:stop.start() if stop else len(html)]))
            at = stop.end() if stop else len(html)
        elif tag not in VOID:
            open_.append(node)
    rest = html[at:]
    cut = CUT_OFF.search(rest)
    say(rest[:cut.start()] if cut else rest)
    return nodes


def tidy(text: str) -> str:
    return " ".join(text.split())


class Page:
    """A page's tree, its subtrees' hashes, and the parts marked as its article."""

    def __init__(self, html: str | None):
        import xxhash

        self.nodes = tree(html or "")
        for n in reversed(self.nodes):  # a node comes before its descendants
            said = [n.tag]
            for kid in n.kids:
                if isinstance(kid, str):
                    text = tidy(kid)
                    n.chars += len(text)
                    said.append(text)
                else:
                    n.chars += kid.chars
                    n.linked += kid.chars if kid.tag == "a" else kid.linked
                    said.append(f"\1{kid.hash:x}")
            n.hash = xxhash.xxh3_64_intdigest("\0".join(said).encode("utf-8", "surrogatepass"))
        # what holds the headline or the largest article isn't judged by its names
        beside = {id(n) for n in self.nodes if n.tag in ("aside", "footer", "nav") or n.attrs and BESIDE.search(self._names(n))}
        keys = [n for n in self.nodes if n.chars and n.tag in ("h1", "main", "article") and not any(id(u) in beside for u in n.up())]
        articles = sorted((n for n in keys if n.tag == "article"), key=lambda n: -n.chars)[1:]
        holds = {id(u) for n in keys if n not in articles for u in n.up()}
        self.said = {id(n) for n in self.nodes if n.tag in TAGS and not (n.tag == "form" and id(n) in holds)
                     or n.attrs and id(n) not in holds and self._says(n)}
        marks = (lambda n: n.tag == "article", lambda n: n.attrs.get("itemprop", "").lower() == "articlebody",
                 lambda n: n.tag == "main" or n.attrs.get("role", "").lower() == "main")
        self.roots = next((r for m in marks if (r := [n for n in self.nodes if n.chars and m(n) and not any(id(u) in self.said for u in n.up())
                                                      and not any(m(u) for u in n.parent.up())])), [])
        self.holds = {id(u) for n in self.roots for u in n.up()}
        self.inside, roots = set(), {id(r) for r in self.roots}
        for n in self.nodes[1:]:
            if id(n.parent) in self.inside or id(n.parent) in roots:
                self.inside.add(id(n))

    @staticmethod
    def _says(n: Node) -> bool:
        if n.tag in ("html", "body"):
            return False
        a = n.attrs
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
            return True
        if "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        return bool(NAMES.search(Page._names(n)))

    @staticmethod
    def _names(n: Node) -> str:
        return f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()

    def named(self) -> str:
        """What tells the page from others: title and headline, else its longest paragraph."""
        heads = [next((tidy(self.text([n], set())) for n in self.nodes if n.tag == t), "") for t in ("title", "h1")]
        return "\n".join(heads) if any(heads) else max((tidy("".join(k for k in n.kids if isinstance(k, str))) for n in self.nodes), key=len)

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that may be a template's."""
        return {n.hash for n in self.nodes if self._may_go(n)}

    def _may_go(self, n: Node) -> bool:
        return (n.chars > 0 and n.tag not in INLINE and n.tag not in ("", "html", "body", "head", "title")
                and id(n) not in self.holds and not (id(n) in self.inside and n.tag in PROSE))

    def main(self, templates: set[int]) -> tuple[str, int]:
        """The main text, and how many subtrees went as the site's."""
        recurs = {id(n) for n in self.nodes if n.hash in templates and self._may_go(n)}
        if not self.roots:  # prose beside prose of the page's own stays
            own = {id(n.parent) for n in self.nodes if n.tag in PROSE and n.chars and id(n) not in recurs and id(n) not in self.said}
            recurs -= {id(n) for n in self.nodes if n.tag in PROSE and id(n.parent) in own and n.parent.tag not in ("", "html", "body")}
        cut = recurs | self.said
        heads = {id(u) for n in self.nodes if n.tag == "h1" for u in n.up()}
        for n in self.nodes:
            if n.tag == "header" or n.attrs and n.tag not in ("html", "body") and HEADS.search(self._names(n)):
                if id(n) not in self.inside and id(n) not in self.holds and (self.roots or id(n) not in heads):
                    cut.add(id(n))
            elif not self.roots and n.tag in ("ul", "ol", "div", "section", "table") and n.chars and 10 * n.linked > 6 * n.chars and id(n) not in heads:
                cut.add(id(n))  # mostly links: a menu
        gone = sum(id(n) in recurs and not any(id(u) in cut for u in n.parent.up()) for n in self.nodes if id(n) in recurs)
        return self.text(self.roots or self.nodes[:1], cut), gone

    def text(self, roots: list[Node], cut: set[int]) -> str:
        blocks, part = [], []

        def close():
            if text := tidy("".join(part)):
                blocks.append(text)
            part.clear()

        for root in roots:
            todo = [iter(root.kids)]
            ends = [True]
            while todo:
                kid = next(todo[-1], None)
                if kid is None:
                    todo.pop()
                    if ends.pop():
                        close()
                elif isinstance(kid, str):
                    part.append(kid)
                elif kid.tag == "br":
                    part.append(" ")
                else:
                    block = kid.tag not in INLINE and kid.tag not in VOID or kid.tag == "hr"
                    if block:
                        close()
                    if id(kid) not in cut:
                        todo.append(iter(kid.kids))
                        ends.append(block)
        return "\n\n".join(blocks)


def host(url):
    """A url's host, lower-cased, without user and port; else the empty string."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit(""))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, subtrees): hashes of the subtrees of each host's template."""
    bounded_batches(pages.sparkSession)

    def hashes(batches):
        import xxhash

        for b in batches:
            hosts, names, found = [], [], []
            for where, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = Page(html)
                hosts.append(where)
                names.append(xxhash.xxh3_64_intdigest(page.named().encode("utf-8", "surrogatepass")) - (1 << 63))
                found.append([h - (1 << 63) for h in page.subtrees()])
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                  ["host", "page", "found"])

    one = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(
        hashes, "host string, page long, found array<long>")
    one = saved(one, "subtrees")
    many = one.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = one.select("host", "page", F.explode("found").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    kept = sorted_join(seen.where(F.col("n") >= least), many, "host").where(F.col("n") >= F.lit(share) * F.col("pages"))
    return kept.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))


def main_text(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates): each page's main text, its
    blocks joined by an empty line, its code points, and the subtrees that were
    cut as the site's."""
    spark = pages.sparkSession
    bounded_batches(spark)
    given = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    found = saved(templates(pages, share, least), "templates")
    # a large host's pages are dealt over tasks: 1,000 such hosts at most
    per_host = saved(given.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    piece = max(SALTED, (per_host.agg(F.sum("n")).first()[0] or 0) // 1000)
    large = F.broadcast(per_host.where(F.col("n") > piece).select("host", F.ceil(F.col("n") / piece).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    moved = given.join(large, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), salts).cast("int")).drop("salts")
    spread = found.join(large, "host", "left").select("host", "subtrees", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

    def pack(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = [None if h is None else z.compress(h.encode("utf-8", "surrogatepass")) for h in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), b.column("host"), b.column("salt"), pa.array(packed, pa.binary())],
                                  ["page_id", "url", "host", "salt", "html"])

    def cut(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            texts, gone = [], []
            for html, known in zip(b.column("html"), b.column("subtrees")):
                page = Page(z.decompress(html.as_py()).decode("utf-8", "surrogatepass") if html.is_valid else None)
                text, n = page.main({h + (1 << 63) for h in known.as_py() or ()})
                texts.append(text)
                gone.append(n)
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                                   pa.array(gone, pa.int32())], out.names)

    packed = StructType([pages.schema["page_id"], pages.schema["url"], StructField("host", StringType()), StructField("salt", IntegerType()),
                         StructField("html", BinaryType())])
    out = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType()),
                      StructField("n_templates", IntegerType())])
    joined = sorted_join(moved.mapInArrow(pack, packed), spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "subtrees").mapInArrow(cut, out)
