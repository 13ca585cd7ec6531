"""Main text of web pages by a site style tree (Yi, Liu and Li, 2003).

The pages of a host are merged by style: a style node is the path of tags and classes from the root. For each node the
entropy of its presentation (which children follow) and that of its content (which texts it holds) over the host's
pages are taken by grouped aggregation, smoothed towards the same node over all hosts, so that a host of few pages is
judged by what such branches are elsewhere. A branch is cut from every page of its host if the evidence says so: its
importance; what it declares itself to be (navigation, advert, comments), which is evidence and no verdict; whether it
stands outside of an article; and how much of the pages' text it holds, so that a wrapper isn't cut for its name. The
plain paragraphs of an article are no branches, since a host may publish copies.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise, table, text_batches

#: Weight of presentation against content in a branch's importance.
PRESENTATION = 0.1
#: Pages that what a node is over all hosts counts for, and what is believed of a node never seen.
INHERITED, UNKNOWN = 4.0, 0.5
#: Evidence in log odds that a branch is no content: by declaration (elements and roles, words of a class or id, none),
#: for standing outside of an article, for each unit of the pages' text that it holds, and of importance below a half.
ELEMENT, WORD, PLAIN, OUTSIDE, HELD, ALIKE = 5.0, 1.5, -1.5, 6.0, -3.0, 7.0

#: Elements whose content is raw, and those that are never content.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
NO_CONTENT = frozenset(
    "head nav footer aside form button select option datalist input label menu dialog noscript template object embed "
    "svg canvas audio video map".split()
) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Words of a class or id, and roles, that declare a branch to be no content.
DECLARED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup "
    "modal overlay comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "newsletter subscribe subscription signup login search pagination pager widget skip toolbar masthead topbar".split()
)
OUTSIDE_ARTICLES = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class that only say what else is on the page.
LAYOUT = frozenset("has with no without layout page wrapper container hide js".split())
#: Elements that are branches wherever they stand outside of an article, also without a class.
BRANCHES = BLOCKS - frozenset("body html p h1 h2 h3 h4 h5 h6 li td th tr tbody thead tfoot dd dt hr legend caption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*)>|<[!?/][^>]*>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-z0-9]+")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def declared_word(tokens: list[str]) -> bool:
    """Whether a class or id says that the branch is no content. Forms like has-sidebar say it of another branch."""
    return any(not words & LAYOUT and words & DECLARED for words in (set(SPLIT.split(t)) for t in tokens))


class Page:
    """Elements of a page in order, each with its parent, style and evidence, and the blocks of text between.

    An element of no content whatever a page looks like (script, style, a field of a form) has no blocks.
    """

    def __init__(self, source: str):
        self.parent, self.style, self.main, self.boxed, self.name = [-1], [0], [False], [False], [""]
        self.prior, self.out, self.gone = [PLAIN], [False], [False]
        self.children: list[list[str]] = [[]]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self._read(source)
        # articles beside what declares itself no content come before those inside it
        inside_out = [False] * len(self.parent)
        for i in range(1, len(self.parent)):
            inside_out[i] = self.out[i] or inside_out[self.parent[i]]
        main = [i for i, m in enumerate(self.main) if m and not self.out[i]]
        chosen = set([i for i in main if not inside_out[i]] or main)
        self.main = [i in chosen for i in range(len(self.main))]
        self.holds_main = [False] * len(self.parent)
        for i in range(len(self.parent) - 1, 0, -1):
            if self.holds_main[i] or self.main[i]:
                self.holds_main[self.parent[i]] = True
        self._judge()

    def _judge(self) -> None:
        """Which elements are branches that the tree judges, and the nearest such one of each element."""
        apart = self.holds_main[0]
        n = len(self.parent)
        self.branch, inside = [-1] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            inside[i] = self.main[i] or inside[up]
            self.branch[i] = self.branch[up]
            if self.main[i] or self.holds_main[i]:
                continue  # an article and what surrounds it are never cut whole
            outside = apart and not inside[i]
            if self.out[i] or self.boxed[i] or outside and self.name[i] in BRANCHES:
                self.branch[i] = i
                self.prior[i] += OUTSIDE * outside
        # text beside an article, in what surrounds it
        self.beside = {i: _hash(f"{self.style[i]}#") for i in range(n) if apart and not inside[i] and self.branch[i] < 0}

    def _open(self, stack: list[tuple[str, int]], name: str, attrs: str) -> None:
        up = stack[-1][1]
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)} if attrs.strip() else {}
        classes = sorted(found.get("class", "").lower().split())
        inside = any(self.main[i] for _, i in stack)
        tokens = [*classes, *found.get("id", "").lower().split()]
        unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        element = name in NO_CONTENT or name in OUTSIDE_ARTICLES and not inside or found.get("role", "").lower() in ROLES or unseen
        word = declared_word(tokens) or not inside and any(set(SPLIT.split(t)) & OUTSIDE_ARTICLES for t in tokens)
        whole = name in ("html", "body")
        label = f"{name}.{' '.join(classes)}" if classes else name
        self.parent.append(up)
        self.name.append(name)
        self.style.append(_hash(f"{self.style[up]}>{label}") if name in BLOCKS or classes or element else self.style[up])
        self.out.append((element or word) and not whole)
        self.gone.append(name in RAW or unseen)
        self.prior.append(ELEMENT if element and not whole else WORD if word and not whole else PLAIN)
        article = name in ("article", "main") or found.get("role", "").lower() in ("main", "article")
        self.main.append(article and not inside)  # an article in an article is part of it
        self.boxed.append(bool(tokens) and not whole)
        self.children.append([])
        self.children[up].append(label)
        if name not in VOID:
            stack.append((name, len(self.parent) - 1))

    def _read(self, source: str) -> None:
        stack, run, at, home = [("", 0)], [], 0, 0
        pos = 0

        def flush():
            if any(not piece.isspace() for _, piece in run):
                self.blocks.append((home, list(run)))
            run.clear()

        def add(piece: str):
            """Text of the nearest block, marked with the outermost element of the line that may be none of it."""
            nonlocal home
            part = -1
            for name, i in reversed(stack):
                if name in BLOCKS or not i:
                    home = i
                    break
                if self.out[i]:
                    part = i
            run.append((part, references.unescape(piece) if "&" in piece else piece))

        while m := TAG.search(source, pos):
            if m.start() > at:
                add(source[at : m.start()])
            pos = at = m.end()
            if not m["name"]:
                continue
            name = m["name"].lower()
            if name == "br":
                run.append((-1, " "))
            elif m["end"]:
                if name in BLOCKS:
                    flush()
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if depth:
                    del stack[depth:]
            else:
                if name in BLOCKS:
                    flush()
                    gone = CLOSED_BY.get(name, ())
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p" or stack[i][0] in gone:
                            del stack[i:]
                        elif stack[i][0] in BLOCKS:
                            break
                self._open(stack, name, m["attrs"])
                if name in RAW:
                    close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, pos)
                    pos = at = close.end() if close else len(source)
                    stack.pop()
        if at < len(source):
            add(source[at:])
        flush()

    def nodes_of(self, home: int) -> Iterator[tuple[int, int]]:
        """(style, element) of the branches around a block, innermost first."""
        if home in self.beside:
            yield self.beside[home], home
        at = self.branch[home]
        while at >= 0:
            yield self.style[at], at
            at = self.branch[self.parent[at]]

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """Blocks, and parts of their lines, left when the branches of low importance are cut."""
        cut = lambda i: any(self.gone[k] or style in low for style, k in self.nodes_of(i))
        verdict = {i: cut(i) for i in {h for h, _ in self.blocks} | {i for _, run in self.blocks for i, _ in run if i >= 0}}
        kept = (joined(piece for i, piece in run if i < 0 or not verdict[i]) for home, run in self.blocks if not verdict[home])
        return "\n".join(filter(None, kept))

    def plain_text(self) -> str:
        """The text as one page shows it, without a tree: what declares itself no content or stands beside an article goes."""
        return self.text(frozenset(style for style, _, prior, *_ in self.styles() if prior > 0))

    def styles(self) -> Iterator[tuple[int, int, float, float, list[tuple[int, int]]]]:
        """(style, hash of the child styles, prior, share of the page's text, texts as hash and length) of each node.

        Branches of one style are one node of the page; a text that comes again in a node counts once.
        """
        held: dict[int, dict[int, int]] = {}
        size: dict[int, int] = {}
        prior: dict[int, float] = {}
        look: dict[int, list[str]] = {}
        for i in range(1, len(self.parent)):
            if self.branch[i] == i:
                style = self.style[i]
                look.setdefault(style, []).append(" ".join(self.children[i]))
                prior[style] = max(prior.get(style, PLAIN), self.prior[i])
        pieces = []
        for home, run in self.blocks:
            pieces.append((home, joined(piece for i, piece in run if i < 0)))
            pieces += [(i, joined([piece])) for i, piece in run if i >= 0]
        pieces = [(i, text) for i, text in pieces if text]
        for i, text in pieces:
            own, n = _hash(text), len(text)
            for style, at in self.nodes_of(i):
                if at in self.beside:
                    prior[style], look[style] = PLAIN + OUTSIDE, []
                held.setdefault(style, {})[own] = n
                size[style] = size.get(style, 0) + n
        total = sum(len(text) for _, text in pieces) or 1
        for style, children in look.items():
            yield style, _hash("|".join(children)), prior[style], min(1.0, size.get(style, 0) / total), sorted(held.get(style, {}).items())


def joined(pieces) -> str:
    return " ".join("".join(pieces).split())


def host_of(url: str = "url"):
    """Lower-cased host of an address; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_nodes(pages: DataFrame) -> DataFrame:
    """(page, host, style, look, prior, share, texts) of the style nodes of each row; page is a hash of the row."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("text", pa.int64()), ("size", pa.int64())])))
        for batch in rows:
            out = [(p, h, *s) for p, h, source in zip(*(c.to_pylist() for c in batch.columns)) for s in Page(source).styles()]
            columns = list(zip(*out)) or [[]] * len(kinds)
            columns[-1] = [[{"text": t, "size": n} for t, n in own] for own in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page", "host", "style", "look", "prior", "share", "texts"])

    text_batches(pages.sparkSession)
    sources = pages.select(page_key().alias("page"), host_of().alias("host"), html_of().alias("html"))
    return sources.mapInArrow(batches, "page long, host string, style long, look long, prior double, share double, texts array<struct<text:long,size:long>>")


def html_of() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def page_key() -> Column:
    """A hash of what a page's verdicts depend on: rows of one key have the same host and the same html."""
    return F.xxhash64(host_of(), html_of())


def importance(nodes: DataFrame, keys: list[str], texts: DataFrame) -> DataFrame:
    """keys, n, held (mean share), prior (mean) and importance of the nodes merged by keys; null on a single page.

    ``texts`` has the keys, text, pages and size. Entropies are in units of log n. A look's is taken from how often each
    one comes, a text's from on how many of the n pages it is: 0 says alike on all pages and 1 different on each.
    """
    looks = nodes.groupBy(*keys, "look").agg(F.count("*").cast("double").alias("c"), F.sum("share").alias("share"), F.sum("prior").alias("prior"))
    looks = looks.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("cc"), F.sum("share").alias("share"), F.sum("prior").alias("prior"))
    common = texts.groupBy(*keys).agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.log("pages")).alias("spread"))
    n, log_n = F.col("n"), F.log("n")
    look = (log_n - F.col("cc") / n) / log_n
    content = F.coalesce(1 - F.col("spread") / F.col("size") / log_n, look)
    merged = F.when(n > 1, PRESENTATION * look + (1 - PRESENTATION) * content)
    return looks.join(common, keys, "left").select(*keys, "n", (F.col("share") / n).alias("held"), (F.col("prior") / n).alias("prior"), merged.alias("importance"))


def style_tree(nodes: DataFrame) -> DataFrame:
    """(host, style, n, importance, held, noise) of the merged nodes; noise is the log odds that a node is no content.

    Counts of equal looks and texts are summed before and after the shuffle, so a host of most pages is no hot key.
    """
    one = nodes.select("host", "style", F.explode("texts").alias("t")).select("host", "style", "t.text", "t.size")
    by_host = materialise(one.groupBy("host", "style", "text").agg(F.count("*").alias("pages"), F.sum("size").cast("double").alias("size")))
    overall = by_host.groupBy("style", "text").agg(F.sum("pages").alias("pages"), F.sum("size").alias("size"))
    own = importance(nodes, ["host", "style"], by_host)
    every = importance(nodes, ["style"], overall)
    every = every.select("style", F.col("n").alias("all_n"), F.col("held").alias("all_held"), F.col("importance").alias("all_importance"))
    smooth = lambda value, seen, above: (F.coalesce(value, F.lit(0.0)) * seen + INHERITED * above) / (seen + INHERITED)
    general = smooth(F.col("all_importance"), F.col("all_n") - 1, F.lit(UNKNOWN))
    both = own.join(every, "style")
    both = both.withColumn("importance", smooth(F.col("importance"), F.col("n") - 1, general))
    both = both.withColumn("held", smooth(F.col("held"), F.col("n"), F.col("all_held")))
    noise = F.col("prior") + HELD * F.col("held") + ALIKE * (0.5 - F.col("importance"))
    return both.select("host", "style", F.col("n").cast("long").alias("n"), "importance", "held", noise.alias("noise"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row; null html gives an empty text, repeated rows stay.

    A page meets the verdicts on its own nodes only, so no list of a host is gathered: its nodes are joined to the tree
    and their low ones collected by page, then joined to the page, both by keys that Spark broadcasts where the written
    size is small. An attribute whose quote is never closed ends with its tag.
    """
    nodes = materialise(page_nodes(pages))
    low = materialise(style_tree(nodes).where("noise > 0").select("host", "style"))
    cut = nodes.select("page", "host", "style").join(low, ["host", "style"]).groupBy("page").agg(F.collect_set("style").alias("low"))
    cut = materialise(cut)
    sources = pages.select("page_id", "url", html_of().alias("html"), page_key().alias("page"))
    joined = sources.join(cut, "page", "left").select("page_id", "url", "html", "low")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [Page(source).text(frozenset(low or ())) for source, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    text_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(batches, f"page_id {kind}, url string, text string, n_chars long")


def op10_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
