"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of presentation nodes: paths of block elements with their classes and ids.
Pages of a host that show the same text in the same nodes are copies and count once. For each node the tree knows on how
many pages m it stands, how often each of its contents recurs and how often each of its presentations (the sequence of
its child elements):

- a content that stands on k of the m pages has the entropy log k / log m; the importance of a node's own text is 1 less
  the mean entropy of its contents;
- the importance of a presentation is its entropy over the m pages, to the base m;
- the importance of a branch with l presentations is (1 - DECAY^l) times the mean importance of what it holds, by pages,
  and DECAY^l times that of its presentation.

Text goes where its own importance is low, and whole branches go of which every node, rare ones too, is of low importance.
A single content that stands on at least half of its node's pages, and on `least`, goes as well, also inside an article.
Elements and classes that say what they are (menus, forms, adverts and the like) go beforehand and have no place in the
tree; inside an article a class must say so with all its parts. Near copies are no boilerplate: where low nodes and common
contents hold more than COPIED of a host's text, a page of which they would take more than half keeps all that it has left
inside its article (on unmarked pages: common contents, of what low nodes left).

Only one row per page with the hashes of its contents is shuffled, then counts. The nodes of one host meet in one row.
Pages stay where they are unless the table of what goes (one row per host that has any) is too large to broadcast.

Defined results: a null or empty page, or one with no text left, gives an empty text; a null URL belongs to the host '';
a branch seen on fewer than `least` pages of a host goes only as part of a larger one; a page is read once from left to right,
however long or malformed, and what a cut-off tag or comment would have held is dropped; repeated rows are extracted one by
one; empty tables give no rows; extra columns are ignored. Contents are known by 64-bit hashes, paths of more than
PATH_CHARS characters by 128-bit hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import picked
from meterlake.llm.urls import host_and_path
from meterlake.session import durable

# Elements and words of classes and ids by what they hold.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html li main menu nav noscript ol option p pre script search section select style summary table tbody td "
    "template textarea tfoot th thead title tr ul iframe button label legend svg canvas object video audio math".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset(
    "head title script style noscript template iframe nav menu header footer aside form button select option textarea label legend "
    "fieldset dialog search svg canvas object video audio".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices gdpr popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments reply replies disqus respond related recommended "
    "pagination pager toolbar copyright disclaimer skip search form".split()
)
FILLERS = frozenset("area bar block box button buttons container group holder item items link links list panel post posts section slot thread unit wrap wrapper".split())
RAW = frozenset("script style iframe xmp noembed noframes textarea title".split())  # what holds text only
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th figcaption".split())
ROOTS = frozenset(("article", "main"))
CLOSES = {  # an opening element ends these open ones, up to the elements that hold them
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("nav menu header footer aside form fieldset".split())  # of the noise, what ends a paragraph
ARTICLE_NOISE = frozenset("comment comments reply ad advert".split())  # classes of articles that are none
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
NUMBERS = re.compile(r"\d{3,}")  # as in ids of single posts
KEPT, UNSURE, DROPPED = 1, 0, -1
LEAST_PAGES = 4
THRESHOLD = 0.7
DECAY = 0.9
COPIED = 0.25
PATH_CHARS = 500


MARKUP = re.compile(r"<!--|<[!?]|</?[A-Za-z]|</")
TAG = re.compile(r"""</?([A-Za-z][^\t\n\f\r />]*+)((?:=[\t\n\f\r ]*+(?:"[^"]*"|'[^']*')|[^>])*+)>""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\t\n\f\r "'>/=]++)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+("[^"]*"|'[^']*'|[^\t\n\f\r "'>]*+))?""")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\t\\n\\f\\r />])", re.I) for tag in RAW}


def attributes(written: str) -> dict[str, str]:
    """By name, the first of each counts."""
    out: dict[str, str] = {}
    for found in ATTRIBUTE.finditer(written):
        value = found[2] or ""
        out.setdefault(found[1].lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def names_noise(word: str) -> bool:
    """Whether a class or id says that its element is no part of the article it stands in: of its parts, some name noise and
    all others say nothing. A share-price is no share button."""
    parts = [x for x in re.split(r"[^a-z]+", word) if x]
    return any(x in NOISE_WORDS for x in parts) and all(x in NOISE_WORDS or x in FILLERS for x in parts)


class Blocks:
    """The text blocks of a page: node path, text and what elements and classes say about it.

    One scan from left to right; open elements are known by name, so that closing one takes no search. As in browsers, a
    comment or a tag that the page's end cuts off is dropped."""

    def __init__(self):
        self.open: list[tuple[str, str, bool]] = []  # element, node path, whether it is noise
        self.places: dict[str, list[int]] = defaultdict(list)  # where in `open` an element stands
        self.found: list[tuple[str, str, int, bool]] = []
        self.above: dict[str, str | None] = {"": None}  # node paths that are no noise, by those of their parents
        self.below: dict[str, list[str]] = {"": []}  # the child elements of each
        self.text: list[str] = []
        self.roots = 0

    def read(self, html: str) -> None:
        at = 0
        while found := MARKUP.search(html, at):
            start, kind = found.start(), found[0]
            if start > at:
                self.text.append(unescape(html[at:start]))
            if len(kind) == 4:
                end = COMMENT_END.search(html, start + 2)  # also <!--> and <!--->
                at = end.end() if end else len(html)
            elif kind[-1] in "!?/":
                end = html.find(">", start)
                at = end + 1 if end >= 0 else len(html)
            elif tag := TAG.match(html, start):
                name, at = tag[1].lower(), tag.end()
                if kind[1] == "/":
                    self.end(name)
                else:
                    self.start(name, tag[2])
                    if name in RAW:
                        end = RAW_END[name].search(html, at)
                        at = end.start() if end else len(html)
            else:
                at = len(html)
        if at < len(html):
            self.text.append(unescape(html[at:]))
        self._end_block()

    def _end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        element, path, noise = self.open[-1] if self.open else ("", "", False)
        rooted = any(self.places[e] for e in ROOTS)
        sure = DROPPED if noise else KEPT if rooted and (element in CONTENT or element in ROOTS) else UNSURE
        self.roots += rooted and not noise
        self.found.append((path, text, sure if rooted or noise else UNSURE, rooted))

    def _pop_to(self, at: int) -> None:
        self._end_block()
        for element, _, _ in self.open[at:]:
            self.places[element].pop()
        del self.open[at:]

    def _last(self, elements) -> int:
        return max((self.places[e][-1] for e in elements if self.places[e]), default=-1)

    def start(self, tag: str, written: str) -> None:
        if tag in ("br", "hr", "img", "input"):
            self.text.append(" ")
        if tag in VOID or tag not in BLOCKS:
            return
        self._end_block()
        if tag not in NOISE or tag in ENDS_P:
            self._close({"p"}, {"article", "div", "section", "td", "li"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        given = attributes(written) if written else {}
        marks = " ".join(v for k in ("class", "id", "role") if (v := given.get(k))).lower()
        _, above, noise = self.open[-1] if self.open else ("", "", False)
        if not noise:
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
            nested = tag == "article" and bool(self.places["article"])  # articles in articles are comments
            noise = hidden or nested or tag in NOISE or (bool(marks) and self._named(tag, marks))
        if not noise:
            mark = NUMBERS.sub("0", ".".join(sorted(marks.split()))).replace(">", "}")
            step = tag + (f".{mark}" if mark else "")
            path = f"{above}>{step}"
            if len(path) > PATH_CHARS:
                path = "#" + blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            self.above[path] = above
            self.below.setdefault(above, []).append(step)
            self.below.setdefault(path, [])
        else:
            path = above
        self.places[tag].append(len(self.open))
        self.open.append((tag, path, noise))

    def _named(self, tag: str, marks: str) -> bool:
        """Inside an article whole names count, and none on its paragraphs but adverts; elsewhere every part of a name."""
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return not ARTICLE_NOISE.isdisjoint(re.split(r"[^a-z]+", marks))
        if self._last(ROOTS) >= 0:
            return not ADVERTS.isdisjoint(marks.split()) if tag in CONTENT else any(map(names_noise, marks.split()))
        return not NOISE_WORDS.isdisjoint(re.split(r"[^a-z]+", marks))

    def _close(self, ended: set[str], holders: set[str]) -> None:
        """End the innermost open element of `ended`, unless one of `holders` stands between."""
        at = self._last(ended)
        if at > self._last(holders):
            self._pop_to(at)

    def end(self, tag: str) -> None:
        if tag not in BLOCKS:
            return
        if self.places[tag]:
            self._pop_to(self.places[tag][-1])
        else:
            self._end_block()


def parsed(html: str | None) -> Blocks:
    page = Blocks()
    page.read(html or "")
    return page


def hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def main_text(html: str | None, low: set[str], common: set[tuple[str, int]] = frozenset(), copied: bool = True) -> str:
    """The blocks that stay, joined by a space. A page that marks its article has its main text there.

    `low`: paths whose text goes; `common`: paths and hashes of single contents that go; `copied`: whether pages of the host
    may be near copies."""
    page = parsed(html)
    left = [(p, t) for p, t, sure, rooted in page.found if sure != DROPPED and (rooted or (not page.roots and p not in low))]
    stays = [t for p, t in left if p not in low and (not common or (p, hashed(t)) not in common)]
    if copied and 2 * sum(map(len, stays)) < sum(len(t) for _, t in left):
        stays = [t for _, t in left]
    return " ".join(stays)


NODE = pa.struct([("path", pa.string()), ("parent", pa.string()), ("style", pa.int64()), ("contents", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page that has text: its host, a hash of its texts with their paths, and its nodes."""
    for batch in batches:
        hosts, same, nodes = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = parsed(html)
            contents = defaultdict(dict)
            for path, text, sure, _ in page.found:
                if sure != DROPPED:
                    contents[path][hashed(text)] = len(text)
            if not contents:
                continue
            held = sorted((p, sorted(c.items())) for p, c in contents.items())
            hosts.append(host)
            same.append(blake2b(repr(held).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            nodes.append([])
            for path, above in sorted(page.above.items()):
                own = sorted(contents.get(path, {}).items())
                style = hashed(" ".join(page.below[path]))
                nodes[-1].append({"path": path, "parent": above, "style": style, "contents": [v for v, _ in own], "sizes": [n for _, n in own]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(same, pa.binary()), pa.array(nodes, pa.list_(NODE))], names=["host", "same", "nodes"]
        )


def _counted(pages: DataFrame) -> DataFrame:
    """On how many distinct pages of its host each node has each content, of n_chars, and each presentation. Written, so that
    pages are parsed once for it."""
    kind = "host string, same binary, nodes array<struct<path:string,parent:string,style:bigint,contents:array<bigint>,sizes:array<bigint>>>"
    once = pages.select("host", "html").mapInArrow(_nodes, kind).groupBy("host", "same").agg(F.min("nodes").alias("nodes"))
    node = once.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    of = lambda text, v, n: F.struct(F.lit(text).alias("is_text"), v.alias("value"), n.alias("n_chars"))
    texts = F.zip_with("contents", "sizes", lambda c, n: of(True, c, n))
    values = F.concat(F.array(of(False, F.col("style"), F.lit(0).cast("long"))), texts)
    by = ["host", "path", "parent", "v.is_text", "v.value"]
    counts = F.count("*").alias("k"), F.max("v.n_chars").alias("n_chars")
    return durable(node.select("host", "path", "parent", F.explode(values).alias("v")).groupBy(*by).agg(*counts))


def _by_node(counted: DataFrame) -> DataFrame:
    """`own`: importance of a node's own text, null if it has none; `shape`: importance of its presentation."""
    style, text = F.when(~F.col("is_text"), F.col("k")), F.when(F.col("is_text"), F.col("k"))
    sums = counted.groupBy("host", "path", "parent").agg(
        F.sum(style).alias("pages"), F.count(style).alias("styles"), F.sum(style * F.log(style)).alias("ordered"), F.avg(F.log(text)).alias("spread")
    )
    several = F.col("pages") > 1
    own = F.when(F.col("spread").isNotNull(), F.when(several, 1 - F.col("spread") / F.log("pages")).otherwise(1.0))
    shape = F.when(several, 1 - F.col("ordered") / F.col("pages") / F.log("pages")).otherwise(1.0)
    return sums.select("host", "path", "parent", "pages", "styles", own.alias("own"), shape.alias("shape"))


def judged(nodes: list[dict], threshold: float, least: int) -> list[tuple[str, int, float, bool]]:
    """(path, pages, importance, whether its own text goes) of all nodes of a host that have text at or below them."""
    at, kids = {n["path"]: n for n in nodes}, defaultdict(list)
    for n in nodes:
        kids[n["parent"]].append(n["path"])
    order = kids[None][:]
    for path in order:  # grows meanwhile: parents come before their children
        order += kids.get(path, ())
    importance, worst = {}, {}
    for path in reversed(order):
        n = at[path]
        held = [(at[c]["pages"], importance[c]) for c in kids.get(path, ()) if c in importance]
        inner = bool(held)
        if n["own"] is not None:
            held.append((n["pages"], n["own"]))
        if not held:
            continue
        mean = sum(m * i for m, i in held) / sum(m for m, _ in held)
        decay = DECAY ** n["styles"] if inner else 0.0
        importance[path] = (1 - decay) * mean + decay * n["shape"]
        worst[path] = max(importance[path], n["own"] or 0.0, *(worst[c] for c in kids.get(path, ()) if c in worst), 0.0)
    gone, out = set(), []
    for path in order:
        if path in importance:
            n = at[path]
            enough = n["pages"] >= least
            if n["parent"] in gone or (enough and worst[path] < threshold):
                gone.add(path)
            low = n["own"] is not None and (path in gone or (enough and n["own"] < threshold))
            out.append((path, n["pages"], importance[path], low))
    return out


def style_tree(pages: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_PAGES) -> DataFrame:
    """`pages` has host and html. One row per host and node: host, path, pages, importance, low."""
    return _judged(_by_node(_counted(pages)), threshold, least)


def _judged(by_node: DataFrame, threshold: float, least: int) -> DataFrame:
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, nodes in zip(batch.column("host").to_pylist(), batch.column("nodes").to_pylist()):
                out = judged(nodes, threshold, least)
                yield pa.RecordBatch.from_pydict(
                    {"host": pa.array([host] * len(out), pa.string())}
                    | {name: pa.array([o[i] for o in out], kind) for i, (name, kind) in enumerate((("path", pa.string()), ("pages", pa.int64()), ("importance", pa.float64()), ("low", pa.bool_())))}
                )

    by_host = by_node.groupBy("host").agg(F.collect_list(F.struct("path", "parent", "pages", "styles", "own", "shape")).alias("nodes"))
    return by_host.mapInArrow(trees, "host string, path string, pages long, importance double, low boolean")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, read = [], {}
        for host, html, low, common, copied in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "low", "common", "copied"))):
            if host not in read:
                read[host] = set(low or ()), {(c["path"], c["value"]) for c in common or ()}, bool(copied)
            texts.append(main_text(html, *read[host]))
        columns = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text"])


def extract(
    pages: DataFrame,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    threshold: float = THRESHOLD,
    least: int = LEAST_PAGES,
) -> DataFrame:
    """`id`, `url` and text: the main text of every page."""
    rows = picked(pages, id=id, url=url, html=html)
    rows = rows.withColumn("host", host_and_path(F.col("url"))[0])
    counted = _counted(rows)
    by_node = durable(_by_node(counted))
    low = durable(_judged(by_node, threshold, least).where("low").select("host", "path", "low"))
    texts = counted.where("is_text").join(by_node.select("host", "path", "pages"), ["host", "path"]).join(low, ["host", "path"], "left")
    texts = texts.withColumn("low", F.col("low").isNotNull()).withColumn("common", (F.col("k") >= least) & (2 * F.col("k") >= F.col("pages")))
    chars = F.col("k") * F.col("n_chars")
    goes = durable(
        texts.groupBy("host").agg(
            F.collect_set(F.when(F.col("low"), F.col("path"))).alias("low"),
            F.collect_list(F.when(F.col("common"), F.struct("path", "value"))).alias("common"),
            (F.sum(F.when(F.col("low") | F.col("common"), chars).otherwise(0)) > COPIED * F.sum(chars)).alias("copied"),
        ).where("size(low) + size(common) > 0")
    )
    ready = rows.join(goes, "host", "left").select("id", "url", "html", "host", "low", "common", "copied")
    kind = rows.schema["id"].dataType.simpleString()
    out = ready.mapInArrow(_extract, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text")
