"""HTML extraction: text lines of a page are compared with those of its nearest neighbours by URL on the same host; shared lines go."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialize, small_batches
from gleanery.llm.url_filter import host_of, path_of

# Names of HTML elements and words of class, id and role by what they hold.
RAW = "script|style|textarea|title|iframe|xmp|noframes|noembed|svg|math|template|select|object|canvas|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
JUNK = frozenset("nav footer aside form button menu dialog noscript fieldset label datalist head".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
JUNK_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup sidebar aside widget widgets nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager footer masthead comment comments commentlist respond reply replies disqus share sharing social related recommended toolbar login search skip".split())
HEADER_WORDS = frozenset("header topbar".split())
OWN_WORDS = frozenset("article entry post story content page main".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>{RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: A neighbour with this share of a page's lines is a copy of it and says nothing of its template.
MIRROR = 0.8
#: Pairs of lines from which the alignment splits a page rather than keep all its bit rows.
LARGE = 1 << 27


def _kind(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is other than main text, and whether it holds the article; a header ``inside`` the article is the article's."""
    junk, own = name in JUNK or (name == "header" and not inside), name in ("article", "main")
    if not rest or rest == "/":
        return junk, own
    words: set[str] = set()
    for key, *values in _NAMED.findall(rest):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key == "role":
            junk |= value.lower() in JUNK_ROLES
            own |= value.lower() in ("main", "article")
        elif key == "itemprop":
            own |= value.lower() == "articlebody"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            junk = True
        elif key in ("class", "id"):
            words |= {x.lower() for x in _WORD.findall(value)}
    if name in ("html", "body", "main"):
        return False, own
    if name == "article":
        return junk or bool(words & COMMENT_WORDS), own
    return junk or bool(words & JUNK_WORDS) or (bool(words & HEADER_WORDS) and not inside and not words & OWN_WORDS and name not in HEADINGS), own


def page_lines(source: str | None) -> tuple[list[str], list[int]]:
    """The text blocks of a page in order, and of each whether it is junk by its element (0), open (1) or inside the article (2).

    Tags that end a block are those of block elements; character references are decoded, white space inside a block
    becomes one space. Unclosed elements end with the element around them; end tags without a start are ignored.
    """
    lines: list[str] = []
    kinds: list[int] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    state, junk, own = 1, 0, 0

    def flush() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                lines.append(line)
                kinds.append(state)

    at, source = 0, source or ""
    for token in _TOKEN.finditer(source):
        if token.start() > at:
            parts.append(source[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            if token["raw"]:
                parts.append(" ")
            continue
        if name not in BLOCKS:
            if name in ("br", "td", "th", "img", "input"):
                parts.append(" ")
            if name in VOID:
                continue
        else:
            flush()
            if name == "hr":
                continue
        if token["close"]:
            if any(x[0] == name for x in stack):
                while True:
                    popped = stack.pop()
                    junk -= popped[1]
                    own -= popped[2]
                    if popped[0] == name:
                        break
        else:
            if name in BLOCKS and stack and stack[-1][0] == "p":
                stack.pop()
            elif name in ("li", "dd", "dt", "option", "tr") and stack and stack[-1][0] == name:
                popped = stack.pop()
                junk -= popped[1]
                own -= popped[2]
            is_junk, is_own = _kind(name, token["rest"], own > 0)
            if is_junk and name not in BLOCKS:
                flush()
            if not token["rest"].endswith("/") or name in BLOCKS:
                stack.append((name, is_junk, is_own))
                junk += is_junk
                own += is_own
        new = 0 if junk else 2 if own else 1
        if new != state:
            flush()
            state = new
    parts.append(source[at:])
    flush()
    return lines, kinds


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """Bit-parallel longest common subsequence: after each element of y, a number whose zero bits are the places of x where the length grows."""
    where: dict[int, int] = {}
    for k, value in enumerate(x):
        where[value] = where.get(value, 0) | 1 << k
    full = (1 << len(x)) - 1
    row = full
    for value in y:
        used = row & where.get(value, 0)
        row = ((row + used) | (row - used)) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the common subsequence of y and every prefix of x."""
    row = (1 << len(x)) - 1
    for row in _rows(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(x) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(x)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def aligned(x: list[int], y: list[int]) -> list[int]:
    """Places of x in a longest common subsequence with y."""
    low, high = 0, 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
        high += 1
    ends = [*range(low), *range(len(x) - high, len(x))]
    x, y = x[low : len(x) - high], y[low : len(y) - high]
    if not x or not y:
        return ends
    if len(x) * len(y) > LARGE and len(y) > 1:
        half = len(y) // 2
        first, second = _lengths(x, y[:half]), _lengths(x[::-1], y[half:][::-1])[::-1]
        cut = int((first + second).argmax())
        inner = aligned(x[:cut], y[:half]) + [cut + k for k in aligned(x[cut:], y[half:])]
    else:
        rows, inner = list(_rows(x, y)), []
        i, j = len(x) - 1, len(y) - 1
        while i >= 0 and j >= 0:
            if rows[j] >> i & 1:
                i -= 1
            elif j and not rows[j - 1] >> i & 1:
                j -= 1
            else:
                inner.append(i)
                i, j = i - 1, j - 1
    return sorted(ends + [low + k for k in inner])


_PARSED = "page_id long, url string, host string, path string, key long, lines array<string>, kinds array<int>, hashes array<long>"


def _parse(pages: DataFrame) -> DataFrame:
    """Of every page the lines that are not junk by their element, with kinds and hashes; key stands for host, path and all its lines."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts, kinds, hashes, keys = [], [], [], []
                for source, host, path in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "path")), strict=True):
                    lines, kind = page_lines(source)
                    hashed = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], dtype=np.uint64).view(np.int64)
                    texts.append([x for x, k in zip(lines, kind, strict=True) if k])
                    kinds.append([k for k in kind if k])
                    hashes.append(hashed[np.array(kind) > 0] if kind else hashed)
                    keys.append(np.uint64(xxhash.xxh3_64_intdigest(f"{host}\n{path}\n".encode() + hashed.tobytes())).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "path")), pa.array(keys, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], names=["page_id", "url", "host", "path", "key", "lines", "kinds", "hashes"])

    return named.mapInArrow(parse, _PARSED)


def _shared(ordered: DataFrame) -> DataFrame:
    """For each page the lines it shares with its neighbours in its partition's order (key, shared; a row for each neighbour that is no copy), and the pages at the partition's ends (shared null).

    The page before and the page after are asked; where the page before is a copy, the last page before the run of
    copies is asked as well, so that a run of any length still meets its template. Two pages are held at a time.
    """
    plain = ordered.withColumn("part", F.spark_partition_id())

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = first = distinct = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "host", "path", "hashes", "part", "from")), strict=True))
            out = []

            def meet(one, other, out=out) -> bool:
                """Note what ``one`` shares with ``other``; whether that is a copy of it."""
                if one[1] != other[1] or (one[5] is not None and one[5] == other[5]):
                    return False
                common = aligned(one[3], other[3])
                copy = len(common) >= MIRROR * len(one[3])
                if not copy:
                    out.append((one[0], None, None, None, one[4], common))
                return copy

            for row in rows:
                if first is None:
                    first = row
                if before is not None:
                    meet(before, row)
                    if meet(row, before):
                        if distinct is not None:
                            meet(row, distinct)
                    else:
                        distinct = before
                before = row
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)
        ends = {r[0]: r for r in (first, distinct, before) if r is not None}.values()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((*r[:5], None) for r in ends), strict=True) if ends else [[]] * len(schema), schema, strict=True)], schema=schema)

    schema = pa.schema([("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("part", pa.int32()), ("shared", pa.list_(pa.int32()))])
    return plain.mapInArrow(pair, "key long, host string, path string, hashes array<long>, part int, shared array<int>")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    A page's lines are its text blocks without scripts, styles and markup. Lines inside a menu, header, footer,
    sidebar, notice, advert, form or comments are left out whatever the neighbours say. Differencing decides about the
    others, of all pages: pages are ordered by path within their host, each is compared with the page before and the
    one after, what is left of their lines is aligned by longest common subsequence, and shared lines are deleted. A
    neighbour that shares ``MIRROR`` of a page's lines counts as its copy; then the last page before the copies is
    asked. A check follows where a page marks its article (article, main, role or itemprop): lines inside that were
    deleted come back, as one article at several URLs shares its lines with its copies; and where no neighbour but
    copies could be asked, which tells nothing of the template, lines outside go.

    Pages of any length count whole, and lines of any number are aligned. Null and empty html give an empty text; null urls belong to a nameless host and are compared like others. Rows of
    equal host, path and lines are one page in the order, so repeated rows don't delete each other. Pages are dealt by
    ranges of (host, path), so a large host is spread; the two pages at each range's ends are compared across
    ranges afterwards.
    """
    small_batches(pages.sparkSession)
    parsed = materialize(_parse(pages), "parsed")
    order = ["host", "path", "key"]
    light = parsed.select(*order, "hashes").dropDuplicates(["key"]).withColumn("from", F.lit(None).cast("int"))
    paired = materialize(_shared(light.repartitionByRange(*order).sortWithinPartitions(*order)), "paired")
    ends = paired.where("shared is null").select(*order, "hashes", F.col("part").alias("from"))
    across = _shared(ends.coalesce(1).sortWithinPartitions(*order)).where("shared is not null")
    shared = paired.where("shared is not null").union(across).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))
    # Texts are shuffled only of pages with lines outside a mark; where all are inside, all that was deleted comes back.
    outside = F.exists("kinds", lambda kind: kind == 1)
    whole = parsed.where(~outside).select("page_id", "url", F.array_join("lines", "\n").alias("text"))
    rest = parsed.where(outside).select("page_id", "url", "key", "lines", "kinds").join(materialize(shared, "shared"), "key", "left").drop("key")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lines, kinds, gone in zip(*(batch.column(c).to_pylist() for c in ("lines", "kinds", "shared")), strict=True):
                unknown = gone is None and 2 in kinds
                gone = set(gone or ())
                texts.append("\n".join(line for k, (line, kind) in enumerate(zip(lines, kinds, strict=True)) if kind == 2 or not (unknown or k in gone)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return whole.union(rest.mapInArrow(kept, "page_id long, url string, text string")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
