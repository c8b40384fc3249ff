"""HTML extraction by equivalence-class template deduction.

A page is a list of differentiated tokens: element openings told apart by their path of elements (with
class and id), and whole text blocks told apart by path. Over the pages of a host each token has an
occurrence vector, its count on every page (copies of a page are one page). Tokens with equal vectors form
an equivalence class; a class found on at least half of the host's pages (and on two) is frequent. Vectors
are compared by an order-free hash and support, aggregated per (host, token), so a host of any size is only
ever counts.

Classes are taken or left whole. Elements of classes that are once on each page bound slots, repeated ones
(list items, paragraphs) lie within a slot. Text blocks of a class of several tokens are fixed text; a text
that shares its vector with nothing is data, however frequent. Within an article named so, the fixed text
is that of the article element's own class, which is there as often as the article: a notice. Where that
text is most of the article, the pages are copies of each other and it is data. What remains in a slot is
data. The article is taken from the slot that the template names so
(article, main); without such an element, from the innermost slot with most of the host's data outside
slots named as menus, headers, footers, sidebars, notices, adverts, forms or comments. Hosts with too few
pages to tell use the classes of all pages together, and a page that lacks the template's slot is read by
its own elements.

Cases: a null or empty html has an empty text; a null url's host is empty; cut-off pages and unclosed
elements are read to the end; character references are decoded once, white space in a block becomes one
space, blocks are joined by newlines in page order; nothing else is dropped.
"""

from __future__ import annotations

import dataclasses
import html as references
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import settled, small_side, table


@dataclasses.dataclass(frozen=True)
class Settings:
    #: A class is valid from this share of a host's pages, and from so many pages.
    share: float = 0.5
    pages: int = 2
    #: Hosts with fewer pages use the template of all hosts.
    own_pages: int = 4
    #: Share of a host's data that the main slot must hold where no element is named for it.
    main_share: float = 0.6
    #: Tokens of a class whose texts are fixed, at least.
    members: int = 2


# Elements by their part in HTML.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]), "p": frozenset(), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
}
LISTS = frozenset("ul ol table dl body article section div".split())
ASIDE_TAGS = frozenset("head nav footer aside form script style button dialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion "
    "related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_TAGS = frozenset(["article", "main"])

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
PARTS = re.compile(r"[^a-z]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _label(tag: str, attributes: str) -> str:
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in NAMED.finditer(attributes)} if "=" in attributes else {}
    name = tag
    for key, mark in (("class", "."), ("id", "#"), ("role", "@")):
        if found.get(key):
            name += mark + re.sub(r"\d+", "0", "_".join(sorted(found[key].split())))
    return name.replace("/", "_")


def blocks(html: str) -> list[tuple[str, str]]:
    """(path, text) of every opening (text empty) and text block of a page, in order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = [("", "")]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", references.unescape("".join(held))).strip(" ")
            if text:
                out.append((stack[-1][1], text))
            held.clear()

    def close(tags: frozenset[str], within: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>"))
            continue
        closing = bool(m[1] or m[4])
        if tag in RAW and not closing:
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                shut = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = shut.end() if shut else end
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            continue
        if stack[-1][0] == "p":  # a block ends an open paragraph
            stack.pop()
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], LISTS)
        path = stack[-1][1] + "/" + _label(tag, m[3] or m[6] or "")
        stack.append((tag, path))
        out.append((path, ""))
    flush()
    return out


def _tag(label: str) -> str:
    return re.split(r"[.#@]", label, maxsplit=1)[0]


def _aside(label: str) -> bool:
    tag = _tag(label)
    if tag in ASIDE_TAGS:
        return True
    if tag in ("body", "html") or tag in MAIN_TAGS:
        return False
    return any(w in ASIDE_WORDS for w in PARTS.split(label[len(tag) :]))


def aside(path: str) -> bool:
    """Whether an element of the path is a menu, header, footer, advert, form, comment or the like."""
    labels = path.split("/")[1:]
    inside = False
    for label in labels:
        tag = _tag(label)
        if tag == "header" and not inside:
            return True
        if _aside(label):
            return True
        inside = inside or tag in MAIN_TAGS
    return False


def is_main(path: str) -> bool:
    last = path.rpartition("/")[2]
    return _tag(last) in MAIN_TAGS or last.endswith("@main")


def _fixed(path: str, text: str) -> str:
    return f"{path}\n{xxhash.xxh64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


@dataclasses.dataclass(frozen=True)
class Template:
    main: str
    fixed: frozenset[str]


def nested(classes: Sequence[dict], settings: Settings) -> Template:
    """The template of a host's frequent classes: rows of token, vector, pages, total and chars."""
    grouped: dict[tuple, list[dict]] = {}
    for r in classes:
        grouped.setdefault((r.get("vector"), r["pages"], r["total"]), []).append(r)
    once = {r["token"]: members for (_, n, total), members in grouped.items() if n == total for r in members if "\n" not in r["token"]}
    named = sorted((p for p in once if is_main(p) and not aside(p)), key=lambda p: (p.count("/"), p))
    if named:
        main = named[0]
        inside = [r for r in classes if _within(r["token"].partition("\n")[0], main) and not aside(r["token"].partition("\n")[0])]
        own = {r["token"] for r in once[main]}
        texts = [r for r in inside if "\n" in r["token"] and r["token"] in own]
        whole = sum(r["chars"] for r in inside if "\n" not in r["token"])
        if sum(r["chars"] for r in texts) > (1 - settings.main_share) * whole:
            texts = []  # copies of one article
        return Template(main, frozenset(r["token"] for r in texts))
    fixed = frozenset(r["token"] for members in grouped.values() if len(members) >= settings.members for r in members if "\n" in r["token"])
    data: dict[str, int] = {}
    for r in classes:  # data of an element counts in every slot around it
        if "\n" not in r["token"] and not aside(r["token"]):
            labels = r["token"].split("/")
            for i in range(2, len(labels) + 1):
                slot = "/".join(labels[:i])
                data[slot] = data.get(slot, 0) + r["chars"]
    whole = max(data.values(), default=0)
    held = [p for p in once if whole and data.get(p, 0) >= settings.main_share * whole]
    return Template(max(held, key=lambda p: (p.count("/"), p), default=""), fixed)


def _within(path: str, main: str) -> bool:
    return not main or path == main or path.startswith(main + "/")


def extract(html: str, template: Template) -> str:
    found = blocks(html)
    main = template.main
    paths = {p for p, t in found if not t}
    if main not in paths:  # the page differs from its host's template
        own = [p for p, t in found if not t and is_main(p) and not aside(p)]
        main = own[0] if own else ""
    kept = []
    for path, text in found:
        if not text or aside(path) or not _within(path, main) or _fixed(path, text) in template.fixed:
            continue
        kept.append(text)
    return "\n".join(kept)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def tokens(pages: DataFrame) -> DataFrame:
    """(host, token, n, chars, page): every page's tokens with their counts and characters of data."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "token", "n", "chars", "page"]
        for batch in batches:
            rows: list[tuple] = []
            for where, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                seen: dict[str, list[int]] = {"": [1, 0]}
                for path, text in blocks(html or ""):
                    if text:
                        seen.setdefault(path, [0, 0])[1] += len(text)
                        path = _fixed(path, text)
                        seen.setdefault(path, [0, 0])[1] += len(text)
                    seen.setdefault(path, [0, 0])[0] += 1
                rows += [(where, token, n, chars, page) for token, (n, chars) in seen.items()]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names)

    return distinct_pages(pages).mapInArrow(listed, "host long, token string, n long, chars long, page long")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, page, html) of one copy of every page of a host; only pages with copies are shuffled."""
    rows = pages.select(F.xxhash64("host").alias("host"), F.xxhash64("html", "host").alias("page"), "html")
    copied = small_side(settled(rows.groupBy("page").agg(F.count("*").alias("copies")).where("copies > 1").select("page")))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.join(copied, "page", "left_semi").dropDuplicates(["page"]).repartition(tasks, "page")
    return rows.join(copied, "page", "left_anti").unionByName(one).select("host", "page", "html")


def templates(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(of_host, classes): the valid classes of each host; host 0 stands for all hosts together."""
    vector = F.bit_xor(F.xxhash64("page", "n"))
    measures = lambda n: (F.sum(n).alias("pages"), F.sum("total").alias("total"), F.sum("chars").alias("chars"))
    each = settled(
        tokens(pages)
        .groupBy("host", "token")
        .agg(F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("chars").alias("chars"), vector.alias("vector"))
        .where((F.col("pages") > 1) | ~F.col("token").contains("\n"))  # a text of one page is data
    )
    pooled = each.groupBy("token").agg(*measures("pages"), F.bit_xor("vector").alias("vector")).withColumn("host", F.lit(0).cast("long"))
    every = each.unionByName(pooled)
    size = every.where("token = ''").select(F.col("host").alias("sized"), F.col("pages").alias("host_pages"))
    valid = every.join(size, F.col("host") == F.col("sized")).where(
        (F.col("pages") >= settings.share * F.col("host_pages"))
        & (F.col("pages") >= settings.pages)
        & ((F.col("host_pages") >= settings.own_pages) | (F.col("host") == 0))
        & (F.col("token") != "")
    )
    members = F.collect_list(F.struct("token", "vector", "pages", "total", "chars"))
    return valid.groupBy(F.col("host").alias("of_host")).agg(members.alias("classes"))


def extracted(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    found = settled(templates(rows, settings))
    common = found.where("of_host = 0").select("classes").collect()  # one row: tokens on half of all pages
    shared = [r.asDict() for r in common[0]["classes"]] if common else []
    own = small_side(found.where("of_host <> 0"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known = nested(shared, settings), {}
        for batch in batches:
            texts = []
            ways, htmls, lists = (batch.column(c) for c in ("host", "html", "classes"))
            for i in range(batch.num_rows):
                where = ways[i].as_py()
                if where not in known:
                    if len(known) > 10_000:
                        known.clear()
                    classes = lists[i].as_py()
                    known[where] = nested(classes, settings) if classes else common
                texts.append(extract(htmls[i].as_py() or "", known[where]))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    joined = rows.withColumn("key", F.xxhash64("host")).join(own, F.col("key") == F.col("of_host"), "left")
    return joined.select("page_id", "url", "html", "host", "classes").mapInArrow(read, f"{kinds}, text string, n_chars long")


def op6_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
