"""Fill-in-the-middle rows, cut by a learned index over line ends.

The ends of all lines of a batch of texts are one ascending array of byte offsets. A RankIndex holds it as line
segments: each covers as many ends in a row as one slope can predict within ERROR, and a residual of 16 bits is stored for each end.
A cut after k lines is a look-up of a rank: the segment's prediction plus the stored residual, exact and without
scanning the text. Cuts are drawn from the key's hash, so they don't depend on partitions.

A row's text is its lines [0, a), [a, b), [b, n) as prefix, middle and suffix, with markers between them; plain rows keep their text.
restored() rebuilds the text from output and form alone.

Defined results: a null text is empty; an empty text, and one that has a marker in it, is plain with null cut sizes (n still counts
its lines). A null key is hashed as an empty number. Rows with equal keys each get a row (equal texts then have equal cuts). An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
#: Bytes by which a segment may miss a line end; residuals fit in 16 bits.
ERROR = 4095


class RankIndex:
    """An ascending array of integers as error-bounded line segments with residuals: [k] is the k-th of them."""

    def __init__(self, first: np.ndarray, base: np.ndarray, slope: np.ndarray, residuals: np.ndarray):
        self.first, self.base, self.slope, self.residuals = first, base, slope, residuals

    @classmethod
    def fit(cls, values: np.ndarray, error: int = ERROR) -> RankIndex:
        """Segments from left to right, each as long as some slope from its first value keeps all others within the error."""
        values = np.asarray(values, np.int64)
        n, first, slope = len(values), [], []
        begin = 0
        while begin < n:
            low, high, end, step = -np.inf, np.inf, begin + 1, 32
            while end < n:
                stop = min(n, end + step)
                run, rise = np.arange(end - begin, stop - begin), values[end:stop] - values[begin]
                lows, highs = np.maximum(np.maximum.accumulate((rise - error) / run), low), np.minimum(np.minimum.accumulate((rise + error) / run), high)
                out = np.flatnonzero(lows > highs)
                fits = int(out[0]) if len(out) else len(run)
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                end += fits
                if len(out):
                    break
                step *= 2
            first.append(begin)
            slope.append((low + high) / 2 if end > begin + 1 else 0.0)
            begin = end
        at, slopes = np.array(first, np.int64), np.array(slope)
        made = cls(at, values[at], slopes, np.zeros(n, np.int16))
        residuals = values - made._predicted(np.arange(n))
        made.residuals = residuals.astype(np.int16)
        if not np.array_equal(made.residuals, residuals):
            raise ValueError("a residual doesn't fit: the error is too large")
        return made

    def _predicted(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[at] + np.rint(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def __len__(self) -> int:
        return len(self.residuals)

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        return self._predicted(ranks) + self.residuals[ranks]


def line_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all lines of the texts data[offsets[i]:offsets[i + 1]], ascending; a line never goes on into the next text."""
    feeds = np.flatnonzero(data == 10) + 1
    return np.union1d(feeds, offsets[1:][np.diff(offsets) > 0])


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """The number of lines of each text, and the offsets of its two cuts. draws: two numbers a text."""
    ends = line_ends(data, offsets)
    index = RankIndex.fit(ends, error)
    before = np.searchsorted(ends, offsets, "right")
    n = np.diff(before)
    lines = np.sort(draws % (n[:, None] + 1), axis=1)
    at = np.broadcast_to(offsets[:-1, None], lines.shape).copy()
    some = lines > 0
    at[some] = index[(before[:-1, None] + lines - 1)[some]]
    return n, at


def hash_words(key: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers of the sha256 of seed:key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, key: str = "doc_id", text: str = "text", error: int = ERROR) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output: a row for each row of docs.

    rate: of 100 texts, those that are transformed; spm: of 100 of these, those with the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for batch in slices(batches, 1):
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = memoryview(texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
            offsets = offsets - offsets[0]
            data = np.frombuffer(raw, np.uint8)
            h = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)], axis=1)
            n, at = cuts(data, offsets, h[:, :2], error)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            plain = (np.diff(offsets) == 0) | pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False) | (h[:, 2] % 100 >= rate)
            first = h[:, 3] % 100 < spm
            out = []
            for a, b, c, d, as_is, turned in zip(offsets[:-1].tolist(), *at.T.tolist(), offsets[1:].tolist(), plain.tolist(), first.tolist(), strict=True):
                if as_is:
                    out.append(bytes(raw[a:d]))
                elif turned:
                    out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                else:
                    out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
            form = np.where(plain, "plain", np.where(first, "spm", "psm"))
            sizes = [pa.array(chars[y] - chars[x], pa.int64(), mask=plain) for x, y in ((offsets[:-1], at[:, 0]), (at[:, 0], at[:, 1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *sizes, pa.array(out, pa.binary()).view(pa.string())], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), *hash_words(F.col(key), seed)).mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Each marker is in a transformed row once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The rows of op11."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: DuckDB SQL for the rows of op11, from the contract's own words.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text,'') AS t, ends_with(coalesce(text,''), chr(10)) AS e, string_split(coalesce(text,''), chr(10)) AS w, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR),'')) AS x FROM documents),
h AS (SELECT *, CAST('0x' || substr(x,1,8) AS BIGINT) AS h1, CAST('0x' || substr(x,9,8) AS BIGINT) AS h2, CAST('0x' || substr(x,17,8) AS BIGINT) AS h3, CAST('0x' || substr(x,25,8) AS BIGINT) AS h4,
  CASE WHEN t='' THEN 0 ELSE len(w) - CASE WHEN e THEN 1 ELSE 0 END END AS n FROM d),
c AS (SELECT *, least(h1%(n+1), h2%(n+1)) AS a, greatest(h1%(n+1), h2%(n+1)) AS b FROM h),
p AS (SELECT *, CASE WHEN a=0 THEN '' ELSE array_to_string(w[1:a], chr(10)) || CASE WHEN a<n OR e THEN chr(10) ELSE '' END END AS pre,
  CASE WHEN b=0 THEN '' ELSE array_to_string(w[1:b], chr(10)) || CASE WHEN b<n OR e THEN chr(10) ELSE '' END END AS upto FROM c),
q AS (SELECT *, substr(upto, length(pre)+1) AS mid, substr(t, length(upto)+1) AS suf,
  CASE WHEN t='' OR contains(t,'<P>') OR contains(t,'<S>') OR contains(t,'<M>') OR h3%100>=100 THEN 'plain' WHEN h4%100<50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form<>'plain' THEN length(pre) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form<>'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>'||pre||'<S>'||suf||'<M>'||mid ELSE '<S>'||suf||'<P>'||pre||'<M>'||mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM q
"""
