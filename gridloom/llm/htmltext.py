"""Main text of web pages by differencing pages with near URLs.

Pages are ordered by host and URL path, so that pages made by one template stand together. Each page is paired with the
neighbour of its host whose path shares the longer prefix with its own; the text lines of the two are aligned by longest common
subsequence, and lines that both have are the template's: they are deleted. Two things need more than that. A
template's elements with a text of their own on each page (adverts, breadcrumbs) are known by their markup and go as well: navigation, footers and
asides by their tag or role, forms, headers and whole class words such as "sidebar" unless they hold at least half of the page's article text, as
wrappers of a whole page do. And
articles may repeat passages of other pages, which differencing alone would take for template lines; so a shared line comes back
where the page marks it as its article's (article, main, or a body role).

Neighbours on one host with equal lines (captures of one page) are one run, and a page's neighbours are the last page of the run
before its own and the first page of the run after it: held against its twin, a page would lose every line.

The order is a range partitioning, so a host with a third of all pages is spread over many tasks. Of the runs at the ends of each
range (four at most) a digest of the lines goes to one small task that finds their neighbours over the borders, so results don't depend on how the ranges
were cut; the lines themselves are joined to that by the runs' numbers. At either end of a host only one run is looked at; a host of one run has no neighbour, and its pages keep all lines.

Defined results: a null html is an empty page with an empty text. A null url is a host of its own. Pages with equal
ids or urls each get a row. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, slices, written

# Elements of HTML by what they mean for a text.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option datalist button input textarea".split())
CHROME = frozenset("nav footer aside menu dialog".split())
#: Elements that are chrome unless they wrap the article.
WRAPPERS = frozenset(["form", "header"])
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can stand in a head; the start of any other ends a head whose end tag is left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr"
    " header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted related reply replies"
    " respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words of readers' comments: chrome however much of the page they are.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: Begins of class names that tell of a page's state and not what an element is.
STATES = frozenset("has hide is js no not show with without".split())
#: Elements of running text. In an article no class or id makes them chrome.
TEXT_TAGS = frozenset("a abbr b blockquote caption cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li mark p pre q s small span strong sub sup td th time u var".split())
_NAME_PARTS = re.compile(r"[-_]+")
_TELLING = frozenset(["class", "id", "role", "hidden", "aria-hidden", "itemprop"])
#: Elements that an opening tag of the same kind closes when they were left open.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCKS - {"br"}


@dataclass(frozen=True)
class Line:
    text: str
    chrome: bool  # its markup says that it isn't the article
    inside: bool  # it is in an element that is the article


class _Element:
    """An open or closed element: what it inherits and says of itself, and how much article text is in it."""

    __slots__ = ("tag", "parent", "unseen", "chrome", "marked", "comments", "inside", "holds", "size")

    def __init__(self, tag: str, parent: _Element | None, unseen: bool, chrome: bool, marked: bool, comments: bool, inside: bool):
        self.tag, self.parent, self.unseen, self.chrome, self.marked, self.comments, self.inside = tag, parent, unseen, chrome, marked, comments, inside
        self.holds, self.size = False, 0


def _marks(tag: str, named: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether class or id words say that an element is chrome, and whether they say that it holds comments."""
    if tag in ("body", "html", "article", "main"):
        return False, False
    words = set()
    for name in [*named.get("class", "").split(), named.get("id", "").strip()]:
        if name in CHROME_WORDS:
            words.add(name)
        elif not inside and len(parts := _NAME_PARTS.split(name)) > 1 and parts[0] not in STATES:
            words |= CHROME_WORDS.intersection((parts[0], parts[-1]))
    if not words or inside and tag in TEXT_TAGS:
        return False, False
    return True, bool(words & COMMENT_WORDS)


class _Lines(HTMLParser):
    """Places of open elements are kept by tag, so that a tag costs the same at any depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, _Element | None]] = []
        self._text: list[str] = []
        self._elements: list[_Element] = []  # parents before what they hold
        self._open: list[_Element] = []
        self._at: defaultdict[str, list[int]] = defaultdict(list)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't wanted

    def lines(self) -> list[Line]:
        """What was found. An element that its classes or its tag (form, header) mark is chrome unless it holds an article and half of all article text."""
        for text, e in self.found:
            if e and e.inside:
                e.size += len(text)
        total = sum(e.size for e in self._elements)
        for e in reversed(self._elements):
            if e.parent:
                e.parent.size += e.size
        for e in self._elements:
            wraps = e.holds and not e.comments and 2 * e.size >= total > 0
            e.chrome = e.chrome or e.marked and not wraps or bool(e.parent and e.parent.chrome)
        return [Line(text, bool(e and e.chrome), bool(e and e.inside)) for text, e in self.found]

    def flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            self.found.append((text, self._open[-1] if self._open else None))

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, -1 without any."""
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=-1)

    def _cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        for e in self._open[k:]:
            self._at[e.tag].pop()
        del self._open[k:]

    def _pop(self, tags: set[str], within: frozenset = frozenset("table ul ol dl".split())) -> None:
        k = self._last(tags)
        if k >= 0 and k >= self._last(within):
            self._cut(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "body":
            self._pop({"head"}, frozenset(["template"]))
        elif tag not in IN_HEAD and self._open and self._open[-1].tag == "head":
            self._cut(len(self._open) - 1)
        if tag in _ENDS_P:
            self._pop({"p"}, frozenset("table td th button".split()))
        if tag in _CLOSES:
            self._pop(_CLOSES[tag])
        if tag in VOID:
            return
        parent = self._open[-1] if self._open else None
        unseen, inside = bool(parent and parent.unseen) or tag in UNSEEN, bool(parent and parent.inside)
        chrome, marked, comments, starts = tag in CHROME, tag in WRAPPERS, False, tag in ("article", "main")
        named = {k: (v or "").lower() for k, v in attrs if k in _TELLING}
        if named:
            role = named.get("role", "")
            words, comments = _marks(tag, named, inside)
            chrome, marked = chrome or role in CHROME_ROLES, marked or words or role == "form"
            unseen = unseen or "hidden" in named or named.get("aria-hidden") == "true"
            starts = starts or role in ("main", "article") or named.get("itemprop") == "articlebody"
        if starts:
            up = parent
            while up and not up.holds:
                up.holds, up = True, up.parent
        made = _Element(tag, parent, unseen, chrome, marked, comments, inside or starts)
        self._at[tag].append(len(self._open))
        self._open.append(made)
        self._elements.append(made)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        k = self._last((tag,))
        if k >= 0 and (tag in ("html", "body") or k >= self._last(("article", "main", "body"))):
            self._cut(k)

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1].tag == "head" and data.strip():
            self._cut(len(self._open) - 1)
        if not (self._open and self._open[-1].unseen):
            self._text.append(data)


def page_lines(page: str | None) -> list[Line]:
    """The text lines of a page in order, one a block; character references are decoded, white space is one space."""
    if not page:
        return []
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.lines()


#: Cells of an alignment that are kept as bits for walking back; larger ones are halved first.
CELLS = 1 << 28


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    out = set(range(begin)) | set(range(len(a) - end, len(a)))
    # Lines that only one of them has can't be common.
    both = set(a[begin : len(a) - end]).intersection(b[begin : len(b) - end])
    at = [k for k in range(begin, len(a) - end) if a[k] in both]
    if at:
        out.update(at[k] for k in _aligned([a[k] for k in at], [x for x in b[begin : len(b) - end] if x in both]))
    return out


def _rows(x: list[str], y: list[str]) -> Iterator[int]:
    """For each begin of x, its longest common subsequences with the begins of y as bits: bit j is 0 where that with y[:j + 1] is longer by one than that with y[:j]."""
    masks: dict[str, int] = {}
    for j, line in enumerate(y):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for line in x:
        met = row & masks.get(line, 0)
        row = ((row + met) | (row - met)) & full
        yield row


def _lengths(x: list[str], y: list[str]) -> np.ndarray:
    """The length of a longest common subsequence of x and y[:j] for each j."""
    row = deque(_rows(x, y), maxlen=1).pop()
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), count=len(y), bitorder="little")
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _aligned(x: list[str], y: list[str]) -> list[int]:
    """Places in x of a longest common subsequence, by bit-parallel rows: lines times lines / 64 steps, however often a line repeats."""
    if not x or not y:
        return []
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        j = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _aligned(x[:half], y[:j]) + [half + k for k in _aligned(x[half:], y[j:])]
    rows = [(1 << len(y)) - 1, *_rows(x, y)]
    out, j = [], len(y)
    for i in range(len(x), 0, -1):
        below = (1 << j) - 1
        now = rows[i] & below
        if now.bit_count() < (rows[i - 1] & below).bit_count():  # the sequence is longer with line i
            out.append(i - 1)
            j = (now ^ below).bit_length() - 1
    return out[::-1]


def article(lines: list[Line], neighbour: list[Line] | None) -> str:
    """The page's text without lines that its neighbour has too, unless its article is marked to have them, and without those that their markup tells from the article."""
    shared = common_lines([x.text for x in lines], [x.text for x in neighbour]) if neighbour else set()
    return "\n".join(x.text for k, x in enumerate(lines) if not x.chrome and (x.inside or k not in shared))


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _digest(texts: list[str]) -> bytes:
    return hashlib.sha256(b"".join(b"%d:" % len(t) + t for t in (x.encode("utf-8", "replace") for x in texts))).digest()


class _Run:
    """Neighbouring pages of one host with equal text lines. The lines are held once, and each kind of markup flags once."""

    __slots__ = ("host", "texts", "members", "variants", "first", "last")

    def __init__(self, host: str, texts: list[str]):
        self.host, self.texts = host, texts
        self.members: list[tuple] = []  # page_id, url, path, number of its variant
        self.variants: dict[bytes, int] = {}
        self.first = self.last = None  # path, page_id

    def add(self, k: int | None, u: str | None, path: str, lines: list[Line]) -> None:
        flags = bytes(x.chrome + 2 * x.inside for x in lines)
        self.members.append((k, u, path, self.variants.setdefault(flags, len(self.variants))))
        self.first, self.last = self.first or (path, k), (path, k)


def _choices(texts: list[str], flags: bytes, near: list[tuple]) -> list[tuple]:
    """(path, page_id, text) for each neighbour (path, page_id, its texts) that the page may be held against; without any: one of nulls and the text."""
    lines = [Line(t, bool(f & 1), bool(f & 2)) for t, f in zip(texts, flags, strict=True)]
    return [(path, k, article(lines, [Line(t, False, False) for t in other])) for path, k, other in near] or [(None, None, article(lines, None))]


def _chosen(choices: list[tuple], path: str) -> tuple:
    return max(choices, key=lambda c: _prefix(c[0] or "", path))


def _near(before, host: str, after) -> list[tuple]:
    return [(*at, r.texts) for r, at in ((before, before and before.last), (after, after and after.first)) if r and r.host == host]


_MADE = "page_id long, url string, text string, partner long, path string, run long, variant long, host string, first_path string, first long, last_path string, last long, texts array<string>, variants array<binary>, digest binary"
_MADE_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _MADE.split(", "))])
_NEAR_ARROW = pa.schema([("run", pa.int64()), ("variant", pa.int64()), ("near", pa.list_(pa.struct([("path", pa.string()), ("partner", pa.int64()), ("text", pa.string())])))])
_NEAR = "run long, variant long, near array<struct<path:string,partner:long,text:string>>"


def _filled(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about a MB from (size, row)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 100
        if size > 1 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages compressed, so that moving them takes less than the table has; a null page is an empty one."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches, 2):
        yield batch.set_column(2, "h", pa.array([pack((h or "").encode("utf-8", "replace")) for h in batch.column(2).to_pylist()], pa.binary()))


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of pages in order: the finished pages; those of its first and last run, whose neighbours may be in other ranges, without
    a text; and the two runs at either end, with their lines. A run's number is four times the partition's and its place: 0, 1, 2, 3."""
    base = 4 * TaskContext.get().partitionId()

    def runs() -> Iterator[_Run]:
        now = None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 2, 1 << 19):
            for k, u, h, host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = page_lines(unpack(h).decode())
                texts = [x.text for x in lines]
                if now is None or now.host != host or now.texts != texts:
                    if now:
                        yield now
                    now = _Run(host, texts)
                now.add(k, u, path, lines)
        if now:
            yield now

    def border(run: _Run, place: int) -> tuple[int, dict]:
        ends = {"first_path": run.first[0], "first": run.first[1], "last_path": run.last[0], "last": run.last[1]}
        return sum(map(len, run.texts)), {"run": base + place, "host": run.host, "texts": run.texts, "variants": list(run.variants), "digest": _digest(run.texts), **ends}

    def waiting(run: _Run, place: int) -> Iterator[tuple[int, dict]]:
        yield border(run, place)
        for k, u, path, variant in run.members:
            yield 0, {"page_id": k, "url": u, "path": path, "run": base + place, "variant": variant}

    def each() -> Iterator[tuple[int, dict]]:
        before = now = None
        n = -1  # now's place among the runs
        for after in runs():
            if n == 0:
                yield from waiting(now, 0)
            elif n > 0:
                if n == 1:
                    yield border(now, 1)
                near = _near(before, now.host, after)
                made = [_choices(now.texts, flags, near) for flags in now.variants]
                for k, u, path, variant in now.members:
                    _, partner, text = _chosen(made[variant], path)
                    yield len(text), {"page_id": k, "url": u, "text": text, "partner": partner}
            if now:
                now.members = []
            before, now, n = now, after, n + 1
        if n > 2:
            yield border(before, 2)
        if now:
            yield from waiting(now, 3 if n else 0)

    return _filled(each(), _MADE_ARROW)


_SIDES = "run long, before long, before_path string, before_id long, after long, after_path string, after_id long"
_SIDES_ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in _SIDES.split(", "))])


def _over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the border runs of all ranges in order, without their lines: for each that waits the runs before and after it, with the
    nearest page of either. Equal runs on both sides of a border are one."""

    def runs() -> Iterator[dict]:
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["host"] != r["host"] or now["digest"] != r["digest"]:
                    if now:
                        yield now
                    now = r | {"waiting": []}
                now["last_path"], now["last"] = r["last_path"], r["last"]
                if r["run"] % 4 in (0, 3):
                    now["waiting"].append(r["run"])
        if now:
            yield now

    def done(before: dict | None, now: dict, after: dict | None) -> Iterator[tuple[int, dict]]:
        at = {}
        for side, r, end in (("before", before, "last"), ("after", after, "first")):
            same = r is not None and r["host"] == now["host"]
            at |= {side: r["run"] if same else None, f"{side}_path": r[f"{end}_path"] if same else None, f"{side}_id": r[end] if same else None}
        return ((0, {"run": run, **at}) for run in now["waiting"])

    def each() -> Iterator[tuple[int, dict]]:
        before = now = None
        for after in runs():
            if now:
                yield from done(before, now, after)
            before, now = now, after
        if now:
            yield from done(before, now, None)

    return _filled(each(), _SIDES_ARROW)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of waiting runs with their lines and those of the runs beside them: for each variant, what its pages may be held against."""

    def each() -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                near = [(r[f"{side}_path"], r[f"{side}_id"], r[f"{side}_texts"]) for side in ("before", "after") if r[side] is not None]
                for variant, flags in enumerate(r["variants"]):
                    found = [{"path": path, "partner": k_, "text": text} for path, k_, text in _choices(r["texts"], flags, near)]
                    yield sum(len(x["text"]) for x in found), {"run": r["run"], "variant": variant, "near": found}

    return _filled(each(), _NEAR_ARROW)


_OUT = "page_id long, url string, text string, partner long"
_OUT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("partner", pa.int64())])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[tuple[int, dict]]:
        for batch in slices(batches, 1, 1 << 20):
            for k, u, path, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, partner, text = _chosen([(x["path"], x["partner"], x["text"]) for x in near], path)
                yield len(text), {"page_id": k, "url": u, "text": text, "partner": partner}

    return _filled(each(), _OUT_ARROW)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, and partner: the id of the page it was held against (null without any). A row for each page."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"), host.alias("host"), path.alias("path"))
    packed = rows.mapInArrow(_packed, "k long, u string, h binary, host string, path string")
    ordered = packed.repartitionByRange("host", "path", "k").sortWithinPartitions("host", "path", "k", "u", "h")
    # Written, because a second run of the range partitioning may cut other ranges.
    made = written(ordered.mapInArrow(_in_range, _MADE), "pages")
    # At most four short rows for each range: their number follows the number of partitions, not the pages.
    ends = made.where("texts is not null")
    light = ends.select("run", "host", "first_path", "first", "last_path", "last", "digest").repartition(1).sortWithinPartitions("run")
    sides = light.mapInArrow(_over_borders, _SIDES)
    for side in ("before", "after"):
        sides = merged(sides, ends.select(F.col("run").alias(side), F.col("texts").alias(f"{side}_texts")), side, "left")
    near = merged(ends.select("run", "texts", "variants"), sides, "run").mapInArrow(_compared, _NEAR)
    waiting = made.where("variant is not null").select("page_id", "url", "path", "run", "variant").join(near.hint("merge"), ["run", "variant"])
    late = waiting.select("page_id", "url", "path", "near").mapInArrow(_choose, _OUT)
    out = made.where("run is null").select("page_id", "url", "text", "partner").unionByName(late)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "partner")
