"""Cutting texts where no token of a byte-level tokenizer can cross, so that equal pieces are encoded once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BEFORE_WORD = re.compile(r"(?= \S)")
#: White space but the line feed. Two such side by side, three line feeds, or two at the end belong to tokens of their own kind.
_WHITE = "\t\x0b\x0c\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TIGHT = rf"[{_WHITE}][{_WHITE}\n]|\n[{_WHITE}]|\n\n\n|\n\n\z"
_TIGHT_PY = re.compile(TIGHT.replace(r"\z", r"\Z"))


def space_chunks(text: str) -> list[str]:
    """The text in pieces; all but the first begin at a space before a word, or are a line feed or what follows one.

    The usual pre-tokenization takes a space together with the word after it and ends every token before such a space, and a
    line feed between words is a token of its own, so a cut there never divides a token.
    """
    if _TIGHT_PY.search(text):
        return [c for c in _BEFORE_WORD.split(text) if c]
    out: list[str] = []
    for n, line in enumerate(text.split("\n")):
        if n:
            out.append("\n")
        first, *rest = line.split(" ")
        if first:
            out.append(first)
        out += [f" {p}" for p in rest]
    return out


def chunked(texts: pa.Array, special: list[str] = ()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """space_chunks() of many texts: the distinct chunks, the chunks of all texts as places in that list, and where each text begins among them.

    Arrow cuts and counts the words; only texts with special strings (each a chunk of its own) or with white space side by side
    are cut one by one. The list may have an empty chunk.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, TIGHT)
    for s in special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    is_odd = odd.to_numpy(zero_copy_only=False)
    plain = texts.filter(pc.invert(odd)) if is_odd.any() else texts
    parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
    bounds, coded = parts.offsets.to_numpy().astype(np.int64), parts.values.dictionary_encode()
    words = coded.dictionary
    at = coded.indices.to_numpy(zero_copy_only=False)
    # Bare of a space before it: a text's first part, a line feed, and the part after it.
    bare = np.zeros(len(at), bool)
    bare[bounds[:-1]] = True
    feed = at == pc.index(words, "\n").as_py()
    bare |= feed
    bare[1:] |= feed[:-1]
    at = 2 * at + bare
    used = np.bincount(at, minlength=2 * len(words)) > 0
    codes = (np.cumsum(used, dtype=np.int32) - 1)[at]
    where = np.flatnonzero(used)
    distinct = [w if b else f" {w}" for w, b in zip(words.take(pa.array(where >> 1)).to_pylist(), (where & 1).tolist(), strict=True)]
    if not is_odd.any():
        return distinct, codes, bounds
    known = {w: k for k, w in enumerate(distinct)}
    split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    rows = []
    for t in texts.filter(odd).to_pylist():
        cut = split.split(t) if split else [t]
        rows.append([known.setdefault(c, len(known)) for k, part in enumerate(cut) for c in ([part] if k % 2 else space_chunks(part)) if c])
    sizes = np.zeros(len(texts), np.int64)
    sizes[~is_odd], sizes[is_odd] = np.diff(bounds), [len(r) for r in rows]
    out = np.empty(int(sizes.sum()), np.int32)
    mine = np.repeat(is_odd, sizes)
    out[~mine], out[mine] = codes, np.array([c for r in rows for c in r], np.int32)
    return list(known), out, np.concatenate([[0], np.cumsum(sizes)])


def gathered(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places in a pool of the items of each code in turn: code c has sizes[c] of them from begins[c] on."""
    own = sizes[codes]
    ends = np.cumsum(own)
    return np.repeat(begins[codes] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)
