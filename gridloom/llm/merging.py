"""Rounds of pair merges over many words at once, on flat numpy arrays."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max

class MergeTable:
    """Which two symbols merge into which third, and how early (a smaller rank is earlier)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, symbols: int):
        keys = left.astype(np.int64) * symbols + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged, self.symbols = keys[order], rank[order].astype(np.int32), merged[order].astype(np.int32), symbols
        # Whether every pair that a merge makes possible ranks later than the merge.
        latest = np.full(symbols, -1, np.int64)
        np.maximum.at(latest, merged, rank)
        self.later = bool((np.maximum(latest[left], latest[right]) < rank).all())

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where the pair doesn't merge) and merged symbols. A negative symbol merges with nothing."""
        want = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        ok = (self.keys[at] == want) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], NONE), np.where(ok, self.merged[at], -1)


def merge(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges each word until no pair is left; returns the surviving symbols, word by word, and each word's number of them.

    In a round, every word takes its lowest rank and merges all its places at once, leftmost first where places overlap. The
    result is that of single merges, always the earliest pair and of equal ones the leftmost, for any table: a merge that
    makes a pair of a rank as low or lower is the last one of its word in the round. Words in which nothing merges leave the
    arrays, the others are compacted.
    """
    lengths = np.asarray(lengths, np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    sym = np.asarray(symbols, np.int32).copy()
    done_words, done_symbols = [], []
    rank, into = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)

    def refresh(at: np.ndarray) -> None:
        ok = at[(at >= 0) & (at + 1 < len(sym))]
        rank[at[at >= 0]] = NONE
        ok = ok[word[ok] == word[ok + 1]]
        rank[ok], into[ok] = table.look_up(sym[ok], sym[ok + 1])

    def early(at: np.ndarray) -> np.ndarray:
        """Which merges at these places, made from left to right, make a pair that doesn't rank later than they do."""
        now, made = rank[at], into[at]
        before = np.maximum(at - 1, 0)
        left = np.where(np.diff(at, prepend=-9) == 2, np.append(-1, made[:-1]), sym[before])
        has_left = (at > 0) & (word[before] == word[at])
        after = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (word[after] == word[at])
        return has_left & (table.look_up(left, made)[0] <= now) | has_right & (table.look_up(made, sym[after])[0] <= now)

    refresh(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sizes = np.diff(np.append(starts, len(sym)))
        low = np.minimum.reduceat(rank, starts)
        over = low == NONE
        if over.any():
            out = np.repeat(over, sizes)
            done_words.append(word[out])
            done_symbols.append(sym[out])
            sym, word, rank, into = sym[~out], word[~out], rank[~out], into[~out]
            low, sizes = low[~over], sizes[~over]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(low, sizes))
        run = np.arange(len(at)) - at  # equal along neighbouring places
        first = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        at = at[place % 2 == 0]
        if not table.later and len(at):
            stop = early(at)
            new_word = np.diff(word[at], prepend=-1) != 0
            begin = np.flatnonzero(new_word)
            stops = np.cumsum(stop) - stop  # such merges before this one, over all words
            at = at[stops == np.repeat(stops[begin], np.diff(np.append(begin, len(at))))]
        sym[at] = into[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
        at = at - np.arange(len(at))
        refresh(at)
        refresh(at - 1)
    words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    out = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int32)
    order = np.argsort(words, kind="stable")
    return out[order], np.bincount(words, minlength=len(lengths))


class Kept:
    """What is known about pieces of text. Short ones are kept over batches, in two generations: when the younger is full, it replaces the older."""

    def __init__(self, make, most: int = 150_000, longest: int = 64):
        self.make, self.most, self.longest, self.young, self.old = make, most, longest, {}, {}

    def of(self, pieces: list[str]) -> list:
        """A value for each of distinct pieces; make() gets the new ones as a list."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        missing = [k for k, v in enumerate(out) if v is None]
        new = []
        for k in missing:
            v = old.get(pieces[k])
            if v is None:
                new.append(k)
            else:
                out[k] = young[pieces[k]] = v
        if new:
            for k, v in zip(new, self.make([pieces[k] for k in new]), strict=True):
                out[k] = v
                if len(pieces[k]) <= self.longest:
                    young[pieces[k]] = v
        return out
