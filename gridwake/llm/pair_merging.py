"""Rank-synchronous merging of ragged symbol sequences, for vocabularies of pair merges.

Sequences lie one behind another in a flat array. In each round every sequence finds its lowest-rank pair and applies it
wherever it occurs, from the left and without overlap; sequences without a mergeable pair leave.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max
MARKS = 20


def _mark(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MARKS)).view(np.int64)


class PairTable:
    """Ranks and results of adjacent symbol pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray, formed: np.ndarray):
        """formed: the rank at which each symbol is made, -1 for single characters."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.result = key[order], rank[order].astype(np.int64), result[order].astype(np.int64)
        #: Marks of the pairs that exist, by a hash of MARKS bits: most pairs asked for don't.
        self.marks = np.zeros(1 << MARKS, bool)
        self.marks[_mark(self.key)] = True
        #: Whether merging can make a pair of lower rank than its own; then the occurrences behind it must wait.
        self.can_fall = bool(((formed[left] > rank) | (formed[right] > rank)).any())

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place) of pairs; rank is NONE where there is no merge."""
        want = left << 32 | right
        rank, at = np.full(len(want), NONE), np.zeros(len(want), np.int64)
        some = np.flatnonzero(self.marks[_mark(want)])
        want = want[some]
        place = np.searchsorted(self.key, want)
        place[place == len(self.key)] = 0
        real = self.key[place] == want
        rank[some[real]], at[some[real]] = self.rank[place[real]], place[real]
        return rank, at


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, lengths) after all merges; sequences keep their order. Symbols below 0 never merge."""
    n = len(lengths)
    out_len = lengths.astype(np.int64).copy()
    done_ids, done_sym = [], []
    live = np.flatnonzero(out_len > 1)
    single = np.flatnonzero(out_len == 1)
    begin = np.cumsum(out_len) - out_len
    if len(single):
        done_ids.append(single)
        done_sym.append(symbols[begin[single]])
    sym, size = _take(symbols, begin[live], out_len[live]), out_len[live]
    rank = None
    while len(live):
        start = np.cumsum(size) - size
        last = start + size - 1
        if rank is None:
            rank = np.full(len(sym), NONE)
            place = np.zeros(len(sym), np.int64)
            rank[:-1], place[:-1] = table.find(sym[:-1], sym[1:])
            rank[last] = NONE
        low = np.minimum.reduceat(rank, start)
        over = low == NONE
        if over.any():
            gone = np.repeat(over, size)
            done_ids.append(np.repeat(live[over], size[over]))
            done_sym.append(sym[gone])
            out_len[live[over]] = size[over]
            keep = ~gone
            sym, rank, place = sym[keep], rank[keep], place[keep]
            live, size, low = live[~over], size[~over], low[~over]
            continue
        hit = rank == np.repeat(low, size)
        at = np.flatnonzero(hit)
        if len(at) > 1:  # of overlapping occurrences every second one
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if table.can_fall and len(at) > 1:
            at = _in_order(at, sym, place, rank, start, size, table)
        sym[at] = table.result[place[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        owner = np.repeat(np.arange(len(size)), size)
        size = size - np.bincount(owner[at], minlength=len(size))
        place_new = (np.cumsum(keep) - 1)[at]
        sym, rank, place = sym[keep], rank[keep], place[keep]
        end = np.zeros(len(sym), bool)
        end[np.cumsum(size) - 1] = True
        redo = np.concatenate([place_new, place_new[place_new > 0] - 1])
        redo = redo[~end[redo]]
        rank[redo], place[redo] = table.find(sym[redo], sym[redo + 1])
        rank[place_new[end[place_new]]] = NONE
    ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
    flat = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
    return flat[np.argsort(ids, kind="stable")], out_len


def _take(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given stretches of values, one behind another."""
    return values[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)].astype(np.int64)


def _in_order(at, sym, place, rank, start, size, table):
    """The occurrences of each sequence up to the first that makes a pair of a lower rank than its own."""
    owner = np.repeat(np.arange(len(size)), size)
    new = table.result[place[at]]
    merged_at = np.zeros(len(sym), bool)
    merged_at[at] = True
    value = sym.copy()
    value[at] = new
    low = rank[at]
    before = at - 1
    swallowed = (before >= 0) & merged_at[np.maximum(before - 1, 0)] & (before >= 1)
    before = np.where(swallowed, before - 1, before)
    ok = (before >= 0) & (owner[np.maximum(before, 0)] == owner[at])
    falls = np.zeros(len(at), bool)
    falls[ok] = table.find(value[before[ok]], new[ok])[0] < low[ok]
    after = at + 2
    ok = after < len(sym)
    ok[ok] = owner[after[ok]] == owner[at[ok]]
    falls[ok] |= table.find(new[ok], sym[after[ok]])[0] < low[ok]
    if not falls.any():
        return at
    own = owner[at]
    earlier = np.cumsum(falls) - falls
    first = np.searchsorted(own, own)
    return at[earlier == earlier[first]]
