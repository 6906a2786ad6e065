"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, with DataFrame functions only.

A paragraph is a line; a line of more than PIECE words is taken as consecutive paragraphs of PIECE words, so that a text
of one line has several too. A paragraph's digest has 44 bits of a hash and 20 check bits made from them. The fingerprint
of a text is a sketch of its distinct digests: three rows of eight cells, each digest xored into one cell of each row, which
three octal digits of it name. Subtracting two versions' sketches (xor again) cancels what they share. Peeling then takes
digests out of cells that hold a single one - its check bits and its place are right - which may leave others alone, until
nothing is left: these are the differing digests. Before its cells, a fingerprint has the number of its digests, so that two
fingerprints alone give the likeness: shared paragraphs over all paragraphs of either.

When peeling fails, it retries larger: the digests are dealt by further bits to so many sketches that each is expected to
hold LOAD of them, those that fail are dealt again, and so on; a very long text only makes more sketches of the same
size. Digests that RETRIES rounds leave unresolved are compared as sets, so the number of differences is always exact.

Defined results: a null text is an empty one; it has no paragraphs and the empty sketch. Two texts without paragraphs are
alike (1), one without and one with are not (0). Equal texts have equal fingerprints. Rows with equal doc_id share the
next document, and where several rows have the next doc_id, the text with the least hash counts. A null doc_id has no next:
its edited text takes nothing in, and near_next is null. Alone in the table, a document is its own next. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import next_in_order, written

#: Words of a paragraph at most, rows and cells of a row of a sketch.
PIECE, ROWS, WIDTH = 32, 3, 8
CELLS = ROWS * WIDTH
#: Digests that a sketch of a retry is expected to hold, retries, and bits of a digest that each deals by at most.
LOAD, RETRIES, BITS = 10, 5, 5
#: Times that peeling goes over the cells.
PASSES = 2
_HASH_BITS = (1 << 44) - 1


def _checked(low: str) -> str:
    """A digest: 44 bits and, above them, 20 bits of their hash."""
    return f"({low} | shiftleft(xxhash64({low}), 44))"


def paragraphs(text: str = "text", piece: int = PIECE) -> str:
    """SQL for the distinct digests of a text's paragraphs."""
    split = rf"regexp_extract_all({text}, '(?:[^\\s]++[^\\S\\n]*+){{1,{piece}}}+', 0)"
    return f"array_distinct(transform({split}, p -> {_checked(f'(xxhash64(rtrim(p)) & {_HASH_BITS}L)')}))"


def sketch(digests: str, shift: int = 0) -> str:
    """SQL for a sketch, array<bigint>: each cell is the exclusive or of the digests whose octal digit in its row names it.

    The digits are those from bit `shift` on; retries take others, so that digests that share their cells part.
    """
    cell = "aggregate({d}, 0L, (a, d) -> if((shiftright(d, {s}) & 7L) = {c}L, a ^ d, a))"
    return "array(" + ", ".join(cell.format(d=digests, s=3 * r + shift, c=c) for r in range(ROWS) for c in range(WIDTH)) + ")"


def numbered(digests: str) -> str:
    """SQL for a fingerprint, array<bigint>: the number of digests, then the cells of their sketch."""
    return f"concat(array(cast(size({digests}) as bigint)), {sketch(digests)})"


def cells(fingerprint_: str) -> str:
    return f"slice({fingerprint_}, 2, {CELLS})"


def to_text(sketched: str) -> str:
    """SQL for the string of a fingerprint: 16 hex digits a number."""
    return f"lower(array_join(transform({sketched}, e -> lpad(hex(e), 16, '0')), ''))"


def subtract(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> x ^ y)"


def peel(sketched: str, shift: int = 0) -> str:
    """SQL for struct<s, n>: what is left of the sketch, and the number of digests recovered from it.

    It goes over the cells PASSES times; a cell that holds one digest gives it up, and the digest leaves its other cells at once.
    """
    cell = f"cast(r % {CELLS} as int)"
    alone = f"v = {_checked(f'(v & {_HASH_BITS}L)')} and (shiftright(v, {shift} + 3 * cast(r % {CELLS} div {WIDTH} as int)) & 7L) = r % {WIDTH}"
    without = f"transform(a.s, (e, i) -> if((shiftright(v, {shift} + 3 * cast(i div {WIDTH} as int)) & 7L) = i % {WIDTH}, e ^ v, e))"
    step = f"if(a.s[{cell}] = 0L, a, transform(array(a.s[{cell}]), v -> if({alone}, struct({without} as s, a.n + 1 as n), a))[0])"
    return f"aggregate(sequence(0, {CELLS * PASSES - 1}), struct({sketched} as s, 0 as n), (a, r) -> {step})"


def empty(sketched: str) -> str:
    return f"not exists({sketched}, e -> e <> 0L)"


_NO = "cast(array() as array<bigint>)"


def _dealt(group: str, retry: int) -> str:
    """SQL for the parts that a failed group's digests go to, by bits of theirs that no earlier retry looked at."""
    want = f"(size({group}.x) + size({group}.y)) / {LOAD}.0D"
    parts = f"cast(pow(2, least({BITS}, greatest(2, ceil(log2({want}))))) as bigint)"
    own = f"(shiftright(d, {44 - BITS * (retry + 1)}) & (m - 1))"
    each = f"transform(sequence(0L, m - 1), b -> struct(-1 as n, filter({group}.x, d -> {own} = b) as x, filter({group}.y, d -> {own} = b) as y))"
    return f"transform(array({parts}), m -> {each})[0]"


def _result(sketched: str, failed: str, shift: int = 0) -> str:
    """SQL: a group without digests and with its number of differences, or `failed`."""
    return f"transform(array({peel(sketched, shift)}), p -> if({empty('p.s')}, struct(p.n as n, {_NO} as x, {_NO} as y), {failed}))[0]"


def differing(df: DataFrame, left: str, right: str, first: str, out: str, retries: int = RETRIES) -> DataFrame:
    """df with the number of differing paragraphs of two digest arrays; `first` is the subtracted fingerprint's cells.

    n is -1 in a group that isn't resolved; groups that no retry resolves are compared as sets.
    """
    df = df.withColumn(out, F.expr(f"array({_result(first, f'struct(-1 as n, {left} as x, {right} as y)')})"))
    for retry in range(retries):
        shift = 0 if retry % 2 else 9
        tried = f"transform({_dealt('g', retry)}, t -> {_result(subtract(sketch('t.x', shift), sketch('t.y', shift)), 't', shift)})"
        df = df.withColumn(out, F.expr(f"flatten(transform({out}, g -> if(g.n >= 0, array(g), {tried})))"))
    left_over = "if(g.n >= 0, g.n, size(array_except(g.x, g.y)) + size(array_except(g.y, g.x)))"
    return df.withColumn(out, F.expr(f"aggregate({out}, 0L, (n, g) -> n + {left_over})"))


def likeness(n_left: str, n_right: str, n_differing: str) -> Column:
    """Shared over all: of n_left + n_right paragraphs, the differing ones stand in one text each and the rest in both."""
    return F.expr(f"case when {n_left} + {n_right} = 0 then 1.0D else ({n_left} + {n_right} - {n_differing}) / cast({n_left} + {n_right} + {n_differing} as double) end")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the fingerprint of each row's text."""
    own = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("d", F.expr(paragraphs("t")))
    return own.select(key, F.expr(to_text(numbered("d"))).alias("fingerprint"))


_CUT = "cast(floor(length(t) / 3) as int)"


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t and, of the next document, its digests (d_next) and as many characters as any row of the doc_id needs (head).

    The texts are moved once, by doc_id. Keys and lengths say before that which document needs how much of which, so what a
    document gives to the one before it is cut off where it lies, and only heads and digests are moved again.
    """
    # Names that no input column keeps: both uses of the texts are one exchange only if their plans are alike to the letter.
    t = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    known = t.where("_k is not null")
    needs = written(known.groupBy(F.col("_k").alias("doc_id")).agg(F.max(F.expr(_CUT)).alias("need")), "lengths")
    order = next_in_order(needs).select(F.col("next_doc_id").alias("_k"), F.col("doc_id").alias("to"), "need")
    given = known.join(order, "_k").select("to", F.struct(F.xxhash64("t").alias("h"), F.expr("substring(t, 1, need)").alias("head"), F.expr(paragraphs("t")).alias("d")).alias("g"))
    # The least of equal keys' texts by hash; with one row a key only the sort that the join needs anyway.
    given = given.groupBy(F.col("to").alias("_k")).agg(F.min("g").alias("g"))
    met = known.join(given, "_k", "left").select(F.col("_k").alias("doc_id"), "t", F.col("g.head").alias("head"), F.col("g.d").alias("d_next"))
    alone = t.where("_k is null").select(F.col("_k").alias("doc_id"), "t", F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<bigint>").alias("d_next"))
    return met.unionByName(alone)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row of docs."""
    both = versions(docs, key, text).withColumn("n_chars", F.length("t").cast("long"))
    both = both.withColumn("e", F.expr(f"concat(substring(t, 1, length(t) - {_CUT}), substring(coalesce(head, ''), 1, {_CUT}))"))
    both = both.withColumns({"d_t": F.expr(paragraphs("t")), "d_e": F.expr(paragraphs("e")), "edited_sha256": F.sha2(F.col("e").cast("binary"), 256), "has_next": F.col("head").isNotNull()}).drop("t", "e", "head")
    both = both.withColumn("d_next", F.coalesce("d_next", F.expr(_NO)))
    for name in ("t", "e", "next"):
        both = both.withColumn(f"s_{name}", F.expr(numbered(f"d_{name}")))
    both = differing(both, "d_t", "d_e", subtract(cells("s_t"), cells("s_e")), "x_edited")
    both = differing(both, "d_t", "d_next", subtract(cells("s_t"), cells("s_next")), "x_next")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(to_text("s_t")).alias("fingerprint"),
        F.expr(to_text("s_e")).alias("edited_fingerprint"),
        likeness("s_t[0]", "s_e[0]", "x_edited").alias("near_edited"),
        F.when(F.col("has_next"), likeness("s_t[0]", "s_next[0]", "x_next")).alias("near_next"),
    )
