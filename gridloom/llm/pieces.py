"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets its dummy prefix, spaces become the meta symbol, and it is cut where no piece of the vocabulary can reach
across: before a run of meta symbols and, inside a word, between two characters that stand side by side in no piece. The words
of a batch are flat arrays of symbols; each round finds the best-scored pair of every word by segmented minima, merges
its places leftmost first in all words at once and compacts. Characters without a piece become byte pieces. Equal words are encoded once.

Defined results: a null text counts as empty and has only the begin and end ids. Repeated rows each get a row; extra
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import TIGHT, chunked, gathered
from .common import slices
from .merging import Kept, MergeTable, merge

META = "▁"
#: Kinds of pieces in the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A BPE model file with byte fallback and without normalization rules; other files are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or kinds & {USER_DEFINED, UNUSED} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalization and normal pieces are supported")
        self.prefix = META if how.add_dummy_prefix else ""
        names = [p.piece for p in model.pieces]
        kind = np.array([p.type for p in model.pieces])
        ids = {p: k for k, p in enumerate(names) if kind[k] == NORMAL}
        if any(re.search(f"[^{META}]{META}", p) for p in ids):
            raise ValueError("a piece crosses the begin of a word")
        self.begin, self.end = names.index("<s>"), names.index("</s>")
        self.byte_ids = np.array([names.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # Symbols are ids; a character that occurs in pieces and isn't one itself gets a number beyond them.
        extra = {c for p in ids for c in p} - ids.keys()
        symbol = ids | {c: len(names) + k for k, c in enumerate(sorted(extra))}
        self.n_ids = len(names)
        self.of_char = np.full(0x110000, -1, np.int32)
        for text, k in symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = k
        scores = np.array([p.score for p in model.pieces])
        order = {s: k for k, s in enumerate(sorted(set(scores[kind == NORMAL].tolist()), reverse=True))}
        rows = [(symbol[p[:k]], symbol[p[k:]], order[scores[i].item()], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, rank, merged = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        self.table = MergeTable(left, right, rank, merged, len(symbol) + len(names))
        beside = {(ord(p[k]), ord(p[k + 1])) for p in ids for k in range(len(p) - 1)}
        self.beside = np.sort(np.array([a * 0x110000 + b for a, b in beside], np.int64))
        self.line_alone = not any("\n" in p and len(p) > 1 for p in ids)
        self.bytes_of = [p.replace(META, " ").encode() if k == NORMAL else b"" for p, k in zip(names, kind.tolist(), strict=True)]
        for b, k in enumerate(self.byte_ids.tolist()):
            self.bytes_of[k] = bytes([b])
        self.bytes_of[int(np.flatnonzero(kind == UNKNOWN)[0])] = model.trainer_spec.unk_surface.encode()
        self.byte_of_id = {k: b for b, k in enumerate(self.byte_ids.tolist())}
        self.kept = Kept(self._encode_words)

    def words(self, text: str) -> list[str]:
        """The prepared text in pieces that no merge crosses."""
        if not text:
            return []
        text = self.prefix + text.replace(" ", META)
        out: list[str] = []
        for n, line in enumerate(text.split("\n") if self.line_alone else [text]):
            if n:
                out.append("\n")
            if META + META in line:
                out += re.findall(f"{META}+[^{META}]*|[^{META}]+", line)
            else:
                first, *rest = line.split(META)
                if first:
                    out.append(first)
                out += [META + w for w in rest]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        lengths = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        # Cut words further where two neighbours stand side by side in no piece.
        pairs = chars[:-1] * 0x110000 + chars[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        cut = np.append(True, (self.beside[at] != pairs) | (owner[1:] != owner[:-1]))
        starts = np.flatnonzero(cut)
        symbols = self.of_char[chars]
        unknown = symbols < 0
        symbols = np.where(unknown, -1 - chars, symbols).astype(np.int64)
        merged, counts = merge(self.table, symbols, np.diff(np.append(starts, len(chars))))
        of_word = np.repeat(owner[starts], counts)
        odd = np.flatnonzero((merged < 0) | (merged >= self.n_ids))
        if len(odd):
            # Characters without a piece: as many byte pieces as UTF-8 has bytes.
            spelled = {}
            for s in np.unique(merged[odd]).tolist():
                char = chr(-1 - s) if s < 0 else self._char_of(s)
                spelled[s] = self.byte_ids[np.frombuffer(char.encode(), np.uint8)]
            times = np.ones(len(merged), np.int64)
            times[odd] = [len(spelled[s]) for s in merged[odd].tolist()]
            out = np.repeat(merged, times)
            where = np.concatenate([[0], np.cumsum(times)])
            for k in odd.tolist():
                out[where[k] : where[k + 1]] = spelled[int(merged[k])]
            merged, of_word = out, np.repeat(of_word, times)
        ends = np.cumsum(np.bincount(of_word, minlength=len(words)))
        data = merged.astype(np.uint16 if self.n_ids <= 1 << 16 else np.uint32)
        return [data[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def _char_of(self, symbol: int) -> str:
        return chr(int(np.flatnonzero(self.of_char == symbol)[0]))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids with the begin and end ids around, as little-endian unsigned 32-bit numbers.

        Texts in which spaces stand alone are cut and their words counted by Arrow, the others one by one by words().
        """
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, f"{TIGHT}|^ |{META}"), pa.scalar(not self.line_alone))
        plain = texts.filter(pc.invert(odd))
        distinct, codes, bounds = chunked(plain)
        # The prefix stands before a text's first chunk, if the text isn't empty.
        k, first = len(distinct), bounds[:-1]
        codes = codes.astype(np.int64)
        codes[first[pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0]] += k
        used = np.bincount(codes, minlength=2 * k) > 0
        names = [self.prefix + distinct[c - k] if c >= k else META + distinct[c][1:] if distinct[c].startswith(" ") else distinct[c] for c in np.flatnonzero(used).tolist()]
        rows = [self.words(t) for t in texts.filter(odd).to_pylist()]
        place: dict[str, int] = {}
        at = np.array([place.setdefault(w, len(place)) for w in names], np.int64)
        cut = np.cumsum([0, *map(len, rows)])
        flat = np.array([place.setdefault(w, len(place)) for row in rows for w in row], np.int64)
        place.pop("", None)
        known = dict(zip(place, self.kept.of(list(place)), strict=True)) | {"": b""}
        # By place: an empty chunk has one as well.
        values = [b""] * (len(known) + 1)
        for w, c in [*place.items()]:
            values[c] = known[w]
        kind = np.dtype(np.uint16 if self.n_ids <= 1 << 16 else np.uint32)
        pool, sizes = np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // kind.itemsize
        begins = np.cumsum(sizes) - sizes
        out: list = [None] * len(texts)
        dense = at[(np.cumsum(used) - 1)[codes]] if len(codes) else np.zeros(0, np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        for where, own, ends in ((np.flatnonzero(~is_odd), dense, bounds), (np.flatnonzero(is_odd), flat, cut)):
            ids = pool[gathered(own, begins, sizes)]
            stops = np.append(0, np.cumsum(sizes[own]))[ends].tolist()
            for k, a, b in zip(where.tolist(), stops, stops[1:], strict=False):
                whole = np.empty(b - a + 2, "<u4")
                whole[0], whole[-1], whole[1:-1] = self.begin, self.end, ids[a:b]
                out[k] = whole
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8, one leading space of the dummy prefix taken off."""
        table, listed = self.bytes_of, ids.tolist()
        data = b"".join([table[k] for k in listed])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        # The dummy prefix is the meta symbol of the first piece; a space spelled as a byte isn't one.
        first = next((table[k] for k in listed if table[k]), b"") if self.prefix and text.startswith(" ") else b""
        return text[1:] if len(first) > 1 or first == b" " and ids[ids > self.end][:1].tolist() != [int(self.byte_ids[32])] else text

    def _decode_runs(self, ids: np.ndarray) -> str:
        """Byte pieces that are no UTF-8: each wrong byte gives a replacement character."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for k in ids.tolist():
            if k in self.byte_of_id:
                run.append(self.byte_of_id[k])
            else:
                flush()
                out.append(self.bytes_of[k].decode())
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def _worker_model(path: str | None) -> PieceModel:
    return _model(os.fspath(path) if path else default_model())


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary()), ("decoded", pa.string())])


def round_trip(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers with begin and end) and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker_model(model)
        for batch in slices(batches, 1):
            ids = pieces.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([pieces.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, hashed by Spark from round_trip()'s columns."""
    made = round_trip(docs, model, key, text)
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def brute_force(texts: list[str | None], path: str | None = None) -> list[tuple[int, str, str]]:
    """The same by the library, for tests."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    out = []
    for t in texts:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out
