"""Byte-level BPE ids of whole batches of texts.

Words are cut by array operations on the code points of a batch, hashed, and only words not met
before are encoded; the vocabulary comes from a ``tokenizers`` JSON file, whose ids this gives.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
import tiktoken

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
CACHE_WORDS, CACHED_BYTES = 80_000, 64
CHUNK = 1 << 19  # bytes of text handled by one set of arrays; a longer text is cut between words


def byte_alphabet() -> dict[str, int]:
    """The usual printable stand-in of each byte, inverted: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each code point."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


class SpanHasher:
    """64-bit hashes of many spans of one array of code points."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(codes) + 1
        with np.errstate(over="ignore"):
            if len(self.up) < n:
                for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                    powers = np.full(n, factor, np.uint64)
                    powers[0] = 1
                    setattr(self, name, np.multiply.accumulate(powers))
            total = np.zeros(n, np.uint64)
            np.cumsum(mixed(codes) * self.up[: n - 1], out=total[1:])
            return (total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans of bytes the number of the distinct string each holds, and where each such string occurs first.

    Spans are grouped by hash, and every byte is compared with the group's first span; were two strings to share a hash,
    the strings themselves would group the spans.
    """
    group, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    of = first[group]
    more = np.flatnonzero(of != np.arange(len(group)))
    a, b, sizes = starts[more], starts[of[more]], (ends - starts)[more]
    if (sizes == (ends - starts)[of[more]]).all():
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if (raw[within + np.repeat(a, sizes)] == raw[within + np.repeat(b, sizes)]).all():
            return group, first
    data, number, found = raw.tobytes(), {}, []
    for k, (x, y) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        n = number.setdefault(data[x:y], len(number))
        group[k] = n
        if n == len(found):
            found.append(k)
    return group, np.array(found, np.int64)


class Classes:
    """The kind of each code point, found out once per code point."""

    def __init__(self):
        self.table = np.full(0x110000, 255, np.uint8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.table[codes]
        if (new := kinds == 255).any():
            for c in np.unique(codes[new]).tolist():
                ch = chr(c)
                self.table[c] = LETTER if regex.match(r"\p{L}", ch) else NUMBER if regex.match(r"\p{N}", ch) else SPACE if regex.match(r"\s", ch) else OTHER
            kinds = self.table[codes]
        return kinds


CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def word_starts(codes: np.ndarray, kinds: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's words begin in the code points of texts laid end to end.

    A run of letters, of numbers or of other characters is a word, with one blank before it; of white
    space before a word, all but the last character are a word; an apostrophe that begins a word and is
    followed by one of CONTRACTIONS is a word with it.
    """
    n = len(codes)
    new_doc = np.zeros(n + 1, bool)
    new_doc[doc_starts] = True
    start = new_doc[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~new_doc[1:n])  # white space before a word
    start[last] = True
    start[last + 1] = codes[last] != 32
    for i in np.flatnonzero((codes == 39) & start).tolist():
        for tail in CONTRACTIONS:
            end = i + 1 + len(tail)
            if end <= n and not new_doc[i + 1 : end].any() and all(codes[i + 1 + k] == ord(t) for k, t in enumerate(tail)):
                start[i + 1 : end] = False
                if end < n:
                    start[end] = True
                break
    return np.flatnonzero(start)


BETWEEN_WORDS = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")  # a word of the pre-tokenizer begins here, whatever is around


def _parts(text: bytes) -> list[bytes]:
    out, at = [], 0
    while len(text) - at > CHUNK and (found := BETWEEN_WORDS.search(text, at + CHUNK)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        special = {t for t in model["vocab"] if any(c not in alphabet for c in t) or t == "<|endoftext|>"}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.classes, self.hasher = Classes(), SpanHasher()
        self.known: dict[bytes, list[int]] = {}

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts laid end to end, and how many each text has."""
        parts = [(i, x) for i, t in enumerate(texts) for x in _parts(t)]
        ids, counts, at = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64), 0
        while at < len(parts):
            end, size = at + 1, len(parts[at][1])
            while end < len(parts) and size + len(parts[end][1]) <= CHUNK:
                size += len(parts[end][1])
                end += 1
            got, n = self._chunk([x for _, x in parts[at:end]])
            ids.append(got)
            np.add.at(counts, [i for i, _ in parts[at:end]], n)
            at = end
        return np.concatenate(ids), counts

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b"".join(texts)
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        place = np.zeros(len(codes) + 1, np.int64)  # of each code point in the bytes
        np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=place[1:])
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        doc_starts = np.searchsorted(place, edges)
        starts = word_starts(codes, self.classes(codes), doc_starts)
        ends = np.append(starts[1:], len(codes))
        word, first = distinct_spans(np.frombuffer(data, np.uint8), place[starts], place[ends], self.hasher(codes, starts, ends))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, encode, found = self.known, self.encoding._encode_single_piece, []
        for a, b in zip(place[starts[first]].tolist(), place[ends[first]].tolist(), strict=True):
            ids = known.get(name := data[a:b])
            if ids is None:
                ids = encode(name)
                if len(name) <= CACHED_BYTES:
                    known[name] = ids
            found.append(ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        begin = np.cumsum(lengths) - lengths
        sizes = lengths[word]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        all_ids = flat[np.arange(upto[-1]) + np.repeat(begin[word] - upto[:-1], sizes)]
        return all_ids, np.diff(upto[np.searchsorted(starts, doc_starts)])


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per Python worker and file."""
    return ByteBpe(path)
