"""A run-length index of many short texts, and the matching statistics of those texts against it.

The texts are laid end to end, each closed by a separator of its own. Sorting their suffixes gives the
Burrows-Wheeler transform; it is kept as runs with the suffixes at the ends of each run as samples. A
suffix inside a run shares with its neighbour one byte less than the suffix before it in the text, so
match lengths are worked out only at the samples and streamed through the text from there.

Of equal texts one is laid down. Each suffix of a copy would stand next to the same suffix of its text and
follow the same byte, so in the transform copies only lengthen runs; the one new head of a run, and so the
one new sample, is the copy's first suffix, which agrees with its text to the end.
"""

from __future__ import annotations

import numpy as np

PACKED = 7  # symbols of 9 bits that the first sort compares where bytes may be zero; eight bytes otherwise


def _first_symbols(codes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many symbols from each place on a key holds, the keys, and which suffixes go on beyond their key."""
    n = len(codes)
    if not (codes == 1).any():  # no zero bytes in the texts: zero can stand for what lies beyond a separator
        raw = np.concatenate([np.where(codes > 0, codes - 1, 0).astype(np.uint8), np.zeros(8, np.uint8)]).tobytes()
        key = np.ndarray((n,), ">u8", raw, strides=(1,)).astype(np.uint64)
        ends = np.flatnonzero(codes == 0)
        near = np.maximum(ends[:, None] - np.arange(8), -1)  # places less than eight symbols before a separator
        own = near >= np.concatenate([[0], ends[:-1] + 1])[:, None]
        place, room = near[own], np.broadcast_to(np.arange(8), near.shape)[own]
        shift = (8 * (8 - np.maximum(room, 1))).astype(np.uint64)
        key[place] = np.where(room > 0, (key[place] >> shift) << shift, np.uint64(0))
        open_ = np.ones(n, bool)
        open_[place] = False
        return 8, key, open_
    key = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)  # no separator among the symbols so far
    padded = np.concatenate([codes, np.zeros(PACKED, codes.dtype)])
    for k in range(PACKED):
        here = padded[k : k + n]
        key = (key << np.uint64(9)) | np.where(open_, here, 0).astype(np.uint64)
        open_ &= here != 0
    return PACKED, key, open_


def sorted_suffixes(codes: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of codes 0 (separator) and 1..256; a suffix ends at its separator, equal ones are in any order.

    With a depth, suffixes that agree in so many symbols may stay in any order."""
    n = len(codes)
    h, key, open_ = _first_symbols(codes)
    order = np.argsort(key)
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | ~open_[order[1:]]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = head
    single = fresh & np.append(fresh[1:], True)
    todo = np.flatnonzero(~single)  # places in the order that are not settled, always whole groups
    while len(todo) and (depth is None or h < depth):
        who = order[todo]
        pair = (rank[who] << 32) | rank[np.minimum(who + h, n - 1)]
        by = np.argsort(pair)
        who, pair = who[by], pair[by]
        order[todo] = who
        fresh = np.ones(len(todo), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[who] = np.maximum.accumulate(np.where(fresh, todo, 0))
        single = fresh & np.append(fresh[1:], True)
        todo = todo[~single]
        h *= 2
    return order


def match_lengths(words: np.ndarray, room: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes agree from places a and b on; words: the 8 bytes at each place; room: bytes to the text's end."""
    most = np.minimum(room[a], room[b])
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        differ = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        same = differ == 0
        part = live[~same]
        low = differ[~same] & (~differ[~same] + np.uint64(1))  # lowest set bit: the first byte that differs
        out[part] += (np.log2(low.astype(np.float64)) // 8).astype(np.int64)
        live = live[same]
        out[live] += 8
        live = live[out[live] < most[live]]
    return np.minimum(out, most)


class RunIndex:
    """Run-compressed transform of texts, with the suffixes sampled at both ends of every run."""

    def __init__(self, texts: list[bytes], copied: np.ndarray | None = None):
        """copied: which of the texts, all different, have copies."""
        self.copied = np.zeros(len(texts), bool) if copied is None else copied
        self.lengths = np.array([len(t) for t in texts], np.int64)
        data = b"\0".join([*texts, b""])
        raw = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(self.lengths + 1) - 1
        codes = raw.astype(np.uint16) + 1
        codes[self.ends] = 0
        suffixes = sorted_suffixes(codes)
        last = np.where(suffixes > 0, codes[suffixes - 1], 0)  # the transform; separators differ from one another
        head = np.ones(len(last), bool)
        head[1:] = (last[1:] != last[:-1]) | (last[1:] == 0)
        at = np.flatnonzero(head)
        self.symbols, self.run_starts = last[at], at
        self.first_sample, self.before_first = suffixes[at], suffixes[at - 1]  # a run's first suffix and the one before it
        self.first_sample, self.before_first = self.first_sample[1:], self.before_first[1:]
        self.n = len(codes)
        buffer = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.words = np.ndarray((self.n + 8,), "<u8", buffer.tobytes(), strides=(1,))
        self.room = np.repeat(self.ends, self.lengths + 1) - np.arange(self.n)

    def statistics(self) -> np.ndarray:
        """For every place of the texts the longest match that starts there and anywhere else."""
        lengths = match_lengths(self.words, self.room, self.first_sample, self.before_first)
        best = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for sample in (self.first_sample, self.before_first):
            reach = np.zeros(self.n, np.int64)
            reach[sample] = sample + lengths
            best = np.maximum(best, np.maximum.accumulate(reach) - place)
        reach = np.zeros(self.n, np.int64)
        reach[(self.ends - self.lengths)[self.copied]] = self.ends[self.copied]
        best = np.maximum(best, np.maximum.accumulate(reach) - place)
        return np.minimum(np.maximum(best, 0), self.room)
