"""Suffix arrays of byte strings by induced sorting, vectorised a bucket at a time.

Suffixes are S (smaller than the next) or L. The leftmost S of each stretch of S's, the "leftmost
smaller" suffixes, are sorted first; all L suffixes follow from them in one pass over the buckets from
small to large, and all S suffixes in one pass back, each pass linear. Only the order of the first
``reach`` bytes is asked for, so the leftmost-smaller suffixes are refined by words of eight bytes,
group by group, until they differ or the reach is used up, where an unbounded sort would name their
substrings and recurse on the names. Induction adds a byte to what is known of each suffix, so every
suffix ends up ordered by at least its first ``reach`` bytes.

Common prefixes of neighbours are computed in text order (permuted), eight bytes at a time.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def _words_at(text: np.ndarray, reach: int):
    """Big-endian words at any place of the text; zeros beyond its end."""
    padded = np.concatenate([text, np.zeros(reach + 2 * WORD, np.uint8)])
    return np.ndarray((len(padded) - WORD + 1,), ">u8", padded, 0, (1,))


def _refined(words: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """Places ordered by the text's first bytes from each, ties in any order."""
    first = words[places].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    out = places[order]
    key = first[order]
    new = np.ones(len(out), bool)
    new[1:] = key[1:] != key[:-1]
    done = WORD
    at = np.arange(len(out))
    group = np.cumsum(new)
    while done < reach and len(at):
        tied = np.ones(len(at), bool)
        tied[:-1] = group[1:] != group[:-1]
        tied[1:] &= group[1:] != group[:-1]
        at, group = at[~tied], group[~tied]
        if not len(at):
            break
        key = words[out[at] + done].astype(np.uint64)
        order = np.lexsort((key, group))
        out[at] = out[at][order]
        key, group = key[order], group[order]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
        done += WORD
    return out


def _classified(symbols: np.ndarray) -> np.ndarray:
    """True for S: the next differing symbol is larger. The last symbol is the smallest, and S."""
    n = len(symbols)
    step = np.sign(np.diff(symbols.astype(np.int16)))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[following] > 0, True)


def suffix_array(text: np.ndarray, reach: int) -> np.ndarray:
    """Starts of all suffixes of a byte array, ordered by at least their first ``reach`` bytes."""
    if not len(text):
        return np.zeros(0, np.int32)
    symbols = np.append(text.astype(np.uint16) + np.uint16(1), np.uint16(0))
    n = len(symbols)
    smaller = _classified(symbols)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    leftmost = _refined(_words_at(text, reach), leftmost[:-1], reach)
    leftmost = np.concatenate([np.array([n - 1], np.int32), leftmost])

    size = np.bincount(symbols, minlength=257)
    end = np.cumsum(size)
    begin = end - size
    out = np.full(n, -1, np.int32)
    own = np.bincount(symbols[leftmost], minlength=257)
    lm_begin = np.cumsum(own) - own

    def send(preds: np.ndarray, fill: np.ndarray, step: int) -> None:
        """Append places to the buckets of their symbols, in order, from the front (1) or the back (-1)."""
        chars = symbols[preds]
        by = np.argsort(chars, kind="stable")
        preds, chars = preds[by], chars[by]
        counts = np.bincount(chars, minlength=257)
        rank = np.arange(len(preds), dtype=np.int32)
        rank -= (np.cumsum(counts) - counts).astype(np.int32)[chars]
        rank *= step
        rank += fill.astype(np.int32)[chars]
        out[rank] = preds
        fill += step * counts

    def before(batch: np.ndarray, kind: bool) -> np.ndarray:
        preds = batch[batch > 0] - np.int32(1)
        return preds[smaller[preds] == kind]

    front = begin.copy()
    for c in np.flatnonzero(size):
        done = begin[c]
        while done < front[c]:
            batch = out[done : front[c]]
            done = front[c]
            send(before(batch, False), front, 1)
        if own[c]:
            send(before(leftmost[lm_begin[c] : lm_begin[c] + own[c]], False), front, 1)
    back = end - 1
    out[0] = n - 1
    back[0] -= 1
    for c in np.flatnonzero(size)[::-1]:
        done = end[c] - 1
        while done > back[c]:
            batch = out[back[c] + 1 : done + 1][::-1]
            done = back[c]
            send(before(batch, True), back, -1)
        send(before(out[begin[c] : front[c]][::-1], True), back, -1)
    return out[1:]


def permuted_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place of the text, how much of it its predecessor in the order shares, up to cap bytes."""
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    words = _words_at(text, cap)
    shared = np.zeros(n, np.int32)
    alive = np.flatnonzero(before >= 0).astype(np.int32)
    other = before[alive]
    for done in range(0, cap, WORD):
        apart = words[alive + done].astype(np.uint64) ^ words[other + done].astype(np.uint64)
        same = apart == 0
        end = apart[~same]
        bytes_same = np.zeros(len(end), np.int32)
        for k in range(1, WORD):
            bytes_same += end < np.uint64(1 << (8 * (WORD - k)))
        shared[alive[~same]] = done + bytes_same
        alive, other = alive[same], other[same]
        shared[alive] = done + WORD
    return np.minimum(np.minimum(shared, cap), n - np.maximum(before, np.arange(n, dtype=np.int32)))
