"""Main text of web pages, by a template deduced from all pages of a host.

Tokens are tags, each with its path (the elements around it, counted among
equals), and runs of text, each with the element that holds it. A token's
occurrence vector says on which of the host's pages it stands; tokens with the
same vector are an equivalence class. A path holds the path of what is around
it, so classes nest: the class of the element is within that of its parent.
A class must be frequent (SUPPORT) and be seen on three pages that are not all
the same. Text in the class of the element that holds it belongs to the template;
what else an element holds is a slot. Slots whose text other pages mark as the
article are the main text; where no page marks one, all slots with text that
varies and is not links are.

Vectors are added up as sums of page hashes for each (host, path, text), so
neither a host's pages nor its vectors ever meet in one task. A page is then
read once more, with its host's template joined to it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

#: A class stands on this share of the host's pages at least, and on two. It bounds a template by the length of a page.
SUPPORT = 0.01
#: Bytes of templates that are sent to all tasks; beyond, pages and templates are joined by a shuffle with split hot hosts.
SENT = 64 << 20
SALT = 32
#: Templates that a worker keeps unpacked.
KEPT = 256

_VALUE = r"""\"(?:[^\"<]|<(?![a-zA-Z/!]))*\"|'(?:[^'<]|<(?![a-zA-Z/!]))*'"""
_PIECE = re.compile(
    rf"<!--.*?(?:-->|$)|<(script|style)\b(?:{_VALUE}|[^>\"'])*>.*?(?:</\1\s*>|$)|<(noscript|template|textarea|title|svg|iframe)\b(?:{_VALUE}|[^>\"'])*>.*?</\2\s*>"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:{_VALUE}|[^>\"'])*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*>|</?[a-zA-Z][^<>]*$",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
#: Tags that stand within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that may stay open, so that they do not nest.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option hr img input meta link br col area base wbr source track".split()) | INLINE
#: Tags that nest but are part of a text's flow, not of a template.
FLOW = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure figcaption caption hgroup address details summary".split())
#: Regions that are not the article's text.
ASIDE = frozenset("nav footer button select menu head noscript".split())
#: The same, unless the element holds most of a page's text where nothing outside of it is marked as the article.
SOFT_ASIDE = frozenset("aside form dialog".split())
#: The same by a class, id or role all of whose words are of this list or of the next, and one of this.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer ad ads advert advertisement adverts banner cookie cookies consent notice gdpr promo comment comments reply replies respond disqus related recommended share sharing social newsletter subscribe subscription signup breadcrumb breadcrumbs popup modal overlay sponsor sponsored widget login search toolbar pagination pager skip complementary contentinfo".split()
)
_NEUTRAL = frozenset("box container wrapper wrap list section block bar area item items inner outer top bottom left right site page global primary secondary links link button buttons form panel slot row col column group holder unit text title icon icons the js widget main header".split())
MAIN_TAGS = {"article": 3, "main": 2}
MAIN_WORDS = frozenset("article content main post entry story articlebody".split())


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace")) >> 1


class Block:
    """A block of text: how much of it is links, the path of its element, the weight of the article's mark, whether it is an aside."""

    __slots__ = ("aside", "link", "path", "soft", "text", "weight")

    def __init__(self, text, link, path, weight, aside, soft):
        self.text, self.link, self.path, self.weight, self.aside, self.soft = text, link, path, weight, aside, soft

    def key(self) -> int:
        return _hash(self.path, self.text)


def _aside_words(value: str) -> bool:
    for name in value.split():
        words = _WORDS.findall(name)
        if any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in _NEUTRAL for w in words):
            return True
    return False


def read_page(html: str) -> tuple[list[Block], set[int]]:
    """The blocks of a page, in order, and the paths of its elements."""
    blocks: list[Block] = []
    paths = {0}
    # open elements: tag, weight, aside, number if a soft aside, path, its children by label
    stack: list[list] = [["", 0, False, 0, 0, Counter()]]
    parts: list[str] = []
    linked, in_link, n_soft = 0, 0, 0
    weight, aside, soft = 0, False, ()

    def close():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, min(1.0, linked / len(text)), stack[-1][4], weight, aside, soft))
        parts.clear()
        linked = 0

    at = 0
    for m in _PIECE.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        end, name, rest = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = 0 if end else 1
            continue
        close()
        in_link = 0
        if name in LOOSE:
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            named = sorted((a.lower(), (b or c or d).lower()) for a, b, c, d in _NAMED.findall(rest)) if rest else []
            words = {w for _, v in named for w in _WORDS.findall(v)}
            own = MAIN_TAGS.get(name, 2 if "main" in words and name not in ("body", "html") else 1 if words & MAIN_WORDS and name in ("div", "section", "td") else 0)
            marked = any(s[1] for s in stack)
            out = name in ASIDE or (name == "header" and not marked)
            by_word = name in SOFT_ASIDE or (name not in ("html", "body", "article", "main") and any(_aside_words(v) for _, v in named)) or ("header" in words and not marked)
            n_soft += by_word
            if own >= 2 and name in MAIN_TAGS and not any(s[1] == 3 for s in stack):
                for s in stack:  # an article is not part of what was left open
                    s[2], s[3] = False, 0
            path, children = stack[-1][4:]
            if name not in FLOW and name not in MAIN_TAGS and name not in ("html", "body"):
                label = name + "".join(f" {a}={_DIGITS.sub('', v)}" for a, v in named if a != "id")
                children[label] += 1
                path, children = _hash(path, label, children[label]), Counter()
                paths.add(path)
            stack.append([name, own, out, n_soft if by_word else 0, path, children])
        weight = max(s[1] for s in stack)
        aside = any(s[2] for s in stack)
        soft = tuple(s[3] for s in stack if s[3])
    if at < len(html):
        parts.append(html[at:])
    close()
    _settle_asides(blocks)
    return blocks, paths


def _settle_asides(blocks: list[Block]) -> None:
    """A soft aside that holds most of the text of a page that marks no article elsewhere is none."""
    free = [b for b in blocks if not b.aside]
    total = sum(len(b.text) for b in free)
    held: Counter = Counter()
    for b in free:
        for k in b.soft:
            held[k] += len(b.text)
    marked = any(b.weight and not b.soft for b in free)
    main = set() if marked else {k for k, n in held.items() if 2 * n > total}
    for b in blocks:
        b.aside = b.aside or bool(set(b.soft) - main)


TOKENS = "host long, path long, text long, page long, chars long, marked long"


def page_tokens(html: str) -> dict[tuple[int, int], tuple[int, int]]:
    """(path, text) of the tokens on a page, text 0 for the element itself: characters beside links, and those in the marked article less the others."""
    blocks, paths = read_page(html)
    out = {(p, 0): (0, 0) for p in paths}
    rest = [b for b in blocks if not b.aside]
    best = max((b.weight for b in rest), default=0)
    for b in rest:
        chars = round(len(b.text) * (1 - b.link))
        marked = 0 if not best else len(b.text) if b.weight == best else -len(b.text)
        for token in ((b.path, 0), (b.path, b.key())):
            c, m = out.get(token, (0, 0))
            out[token] = (c + chars, m + marked)
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = _hash(html or "") & 0x7FFFFFFF
            rows += [(host, *token, page, *n) for token, n in page_tokens(html or "").items()]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])


def templates(pages: DataFrame) -> DataFrame:
    """host, fixed, main, free: of each host's template the texts, the slots marked as the article, and all that vary.

    pages has host and html. Texts are named by Block.key(), slots by their paths.
    """
    tokens = pages.select("host", "html").mapInArrow(_tokens, TOKENS).groupBy("host", "path", "text")
    # equal sums over the pages' hashes and equal numbers stand for equal occurrence vectors
    tokens = S.staged(tokens.agg(F.count("*").alias("n"), F.sum("page").alias("vector"), F.min("page").alias("low"), F.max("page").alias("high"), F.sum("chars").alias("chars"), F.sum("marked").alias("marked")), "html-tokens")
    whole = tokens.where("path = 0 and text = 0").select("host", F.greatest(F.lit(2.0), F.col("n") * SUPPORT).alias("least"))
    elements = tokens.where("text = 0 and n >= 2").join(whole, "host").where("n >= least").drop("least", "text")
    texts = tokens.where("text != 0 and n >= 3 and low < high")
    same = texts.select("host", "path", "text", "n", "vector", F.col("chars").alias("own_chars"), F.col("marked").alias("own_marked"))
    fixed = S.staged(same.join(elements.select("host", "path", "n", "vector"), ["host", "path", "n", "vector"]), "html-fixed")
    less = fixed.groupBy("host", "path").agg(F.sum("own_chars").alias("own_chars"), F.sum("own_marked").alias("own_marked"))
    slots = elements.join(less, ["host", "path"], "left").select(
        "host", "path", (F.col("chars") - F.coalesce("own_chars", F.lit(0))).alias("chars"), (F.col("marked") - F.coalesce("own_marked", F.lit(0))).alias("marked")
    )
    rows = slots.where("chars > 0 or marked > 0").select("host", F.lit(None).cast("long").alias("fixed"), F.when(F.col("marked") > 0, F.col("path")).alias("main"), F.when(F.col("chars") > 0, F.col("path")).alias("free"))
    rows = rows.union(fixed.select("host", "text", F.lit(None).cast("long"), F.lit(None).cast("long")))
    return rows.groupBy("host").agg(*(F.collect_list(c).alias(c) for c in ("fixed", "main", "free")))  # bounded by SUPPORT


def main_text(html: str, fixed: set[int], main: set[int], free: set[int]) -> str:
    """The main text of a page of a host with this template."""
    rest = [b for b in read_page(html)[0] if not b.aside]
    best = max((b.weight for b in rest), default=0)
    here = {b.path for b in rest if best and b.weight == best}
    # where the page itself marks a part of a slot, that part; else the slots that other pages mark
    region = [b for b in rest if (b.weight == best if b.path in here else b.path in main)]
    if not region:
        region = [b for b in rest if b.path in free] or rest
    # a page all of whose marked text stands on every page keeps it
    chosen = [b for b in region if b.key() not in fixed] or [b for b in region if best]
    return "\n\n".join(b.text for b in chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: OrderedDict[int, tuple[set[int], ...]] = OrderedDict()
    for batch in batches:
        page, url, html, host, *lists = batch.columns
        texts = []
        for k, (h, name) in enumerate(zip(html.to_pylist(), host.to_pylist(), strict=True)):
            if name not in kept:
                kept[name] = tuple(set(x[k].as_py() or ()) for x in lists)
                if len(kept) > KEPT:
                    kept.popitem(last=False)
            texts.append(main_text(h or "", *kept[name]))
        yield pa.record_batch([page, url, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of each page.

    pages has page_id, url and html; other columns are not read. Blocks are
    joined by two line feeds; within a block, white space is one space and
    character references are decoded. A null or empty html gives an empty text;
    a page whose url is null or names no host is a host of its own; rows that
    repeat a page are each extracted, and count as one page where it is asked
    whether pages differ. An empty table gives no rows.
    """
    S.prepare(pages.sparkSession)
    name = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    host = F.when(F.length(name) > 0, F.xxhash64(F.lit("host"), name)).otherwise(F.xxhash64(F.lit("page"), "page_id", "html"))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    known = S.staged(templates(rows), "html-templates")
    size = known.agg(F.sum(8 * (F.size("fixed") + F.size("main") + F.size("free")) + 64)).head()[0] or 0
    if size <= SENT:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "host", "fixed", "main", "free").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
