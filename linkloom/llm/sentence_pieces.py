"""Operator 1: SentencePiece encoding and decoding by suffix-array matching.

Texts are normalised as the model says (blanks become the meta symbol, one is put in front) and cut into
chunks before each run of meta symbols, which no piece crosses. The distinct chunks of a batch that are not
known yet are laid end to end and their suffixes sorted; a binary search finds the range of suffixes that
begin with each piece of the vocabulary, all pieces at once. Every occurrence is an edge of a lattice;
edges are sorted by position and relaxed from left to right. Chunks count as equal by their bytes.

The model is of the BPE kind, so relaxing does not add up scores: an edge continues the encoding of the
text before it exactly if merging would keep the border between the last piece there and the edge's
piece. One edge at most does so at each place, and the last piece at a chunk's end gives its encoding.
Characters without a piece become byte pieces. Runs of meta symbols, whose pieces share one score, are
merged from the left.

What an edge needs is the last piece at a place at most one widest piece back. So a long chunk is relaxed
in sections side by side, each with a lead of text before it; where the last pieces over one widest piece
before a section agree with those of the section before, all later ones do. A section that disagrees
is relaxed again from the places before it, one edge after another.

Defined cases: a null text has no ids and decodes to null, an empty one to an empty text; repeated rows
stay repeated; other columns are ignored; a very long text is worked on in pieces, with or without blanks,
but its ids and its decoded text are whole; two encodings never tie; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.byte_bpe import SpanHasher, distinct_spans, mixed
from linkloom.llm.common import batches, lean, table
from linkloom.llm.packing import _portions
from linkloom.llm.runindex import sorted_suffixes

META = "▁"
NORMAL, BYTE = 1, 6
CACHE_CHUNKS, CACHED_BYTES = 250_000, 64  # how many chunks are kept, of how many bytes at most
PORTION = 1 << 20  # bytes of text that is cut into chunks at a time
INDEX_BYTES = 1 << 19  # bytes of chunks that share one index
SECTION, LEAD = 1024, 256  # of long chunks
NONE, UNKNOWN = -2, -1
SLOTS = 1 << 18  # of the table of merges


def merged(symbols: list[int], rank_of: dict[tuple[int, int], int]) -> list[int]:
    """Plain merging of neighbours, the best rank first, leftmost among equals; for the vocabulary's own pieces."""
    while len(symbols) > 1:
        best = min(((rank_of.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            break
        i = best[1]
        symbols[i : i + 2] = [best[0]]
    return symbols


class PieceModel:
    """Pieces in the order in which they merge: single characters first, then longer ones by score."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models without text normalisation are supported")
        self.prefix = spec.add_dummy_prefix
        self.decoded = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.encode() if p.type == NORMAL else b"" for p in model.pieces]
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.runs = {len(p): i for i, p, _ in normal if set(p) == {META}}
        usual = [x for x in normal if len(x[1]) == 1 or set(x[1]) != {META}]
        usual.sort(key=lambda x: (len(x[1]) > 1, -x[2], x[0]))
        self.ids = np.array([i for i, _, _ in usual])
        names = [p for _, p, _ in usual]
        number = {p: k for k, p in enumerate(names)}
        self.split = np.array([(k, k) for k in range(len(names))], np.int32)
        pairs: dict[tuple[int, int], int] = {}
        self.usable = np.ones(len(names), bool)
        for k, name in enumerate(names):
            if len(name) > 1:
                parts = merged([number.get(c, -1) for c in name], pairs)  # all shorter merges that come first are known by now
                if len(parts) == 2 and -1 not in parts:
                    self.split[k] = parts
                    pairs[parts[0], parts[1]] = k
                else:
                    self.usable[k] = False
        self.pair_key, self.pair_rank = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)
        for (a, b), k in pairs.items():
            slot = int(_slots(np.array([a << 32 | b]))[0])
            while self.pair_key[slot] >= 0:
                slot = (slot + 1) % SLOTS
            self.pair_key[slot], self.pair_rank[slot] = a << 32 | b, k
        self.pieces = [n.encode() for n in names]
        self.widest = max(map(len, self.pieces))
        self.lengths = np.array([len(p) for p in self.pieces])
        padded = b"".join(p.ljust(-(-self.widest // 8) * 8, b"\0") for p in self.pieces)
        self.words = np.frombuffer(padded, ">u8").reshape(len(names), -1).astype(np.uint64)
        self.head, self.tail = np.ascontiguousarray(self.split[:, 0]), np.ascontiguousarray(self.split[:, 1])
        two = [(p[0] + 1) * 257 + (p[1] + 1 if len(p) > 1 else 0) for p in self.pieces]
        self.pair_low = np.array(two)
        self.pair_high = self.pair_low + np.where(self.lengths > 1, 1, 257)
        self.number = {p: k for k, p in enumerate(self.pieces) if self.usable[k]}
        self.kept: dict[tuple[int, int], bool] = {}  # borders that a scalar search has met
        self.hasher = SpanHasher()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # of a chunk, where its ids begin
        self.ids_known, self.ids_size, self.ids_used = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32), 0

    def remember(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        end = self.ids_used + len(ids)
        if end > len(self.ids_known):
            self.ids_known, self.ids_size = (np.concatenate([x, np.empty(len(x) + len(ids), np.int32)]) for x in (self.ids_known, self.ids_size))
        at = self.ids_used + np.cumsum(sizes) - sizes
        self.known.update(zip(chunks, at.tolist(), strict=True))
        self.ids_size[at] = sizes
        self.ids_known[self.ids_used : end] = ids
        self.ids_used = end

    def merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The piece that each two pieces merge to; a large number where they don't."""
        key = x.astype(np.int64) << 32 | y
        slot = _slots(key)
        there = self.pair_key[slot]
        out = np.where(there == key, self.pair_rank[slot], 1 << 30)
        go = np.flatnonzero((there != key) & (there >= 0))
        while len(go):
            slot[go] = (slot[go] + 1) % SLOTS
            there = self.pair_key[slot[go]]
            hit = there == key[go]
            out[go[hit]] = self.pair_rank[slot[go[hit]]]
            go = go[~hit & (there >= 0)]
        return out

    def borders(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a border between each two neighbouring pieces (numbers of this model, or UNKNOWN)."""
        good = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y, limit = a[live], b[live], np.full(len(live), 1 << 29, np.int32)
        while len(live):
            bad = self.merge_rank(x, y) < limit
            good[live[bad]] = False
            # Undo the later merge next to the border; what merged across before it would have come first.
            tail, head = self.tail[x], self.head[y]
            left = x > y
            whole_x, whole_y = tail == x, head == y
            undo_x = (left & ~whole_x) | (~left & whole_y & ~whole_x)
            undo_y = (~left & ~whole_y) | (left & whole_x & ~whole_y)
            go = ~bad & (undo_x | undo_y)
            limit = np.where(undo_x, x, np.where(undo_y, y + 1, limit))[go]
            x, y, live = np.where(undo_x, tail, x)[go], np.where(undo_y, head, y)[go], live[go]
        return good

    def occurrences(self, data: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of every occurrence of every usable piece: ranges of the sorted suffixes."""
        order = sorted_suffixes(codes, self.widest)
        n = len(order)
        raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(self.words.shape[1] * 8 + 8, np.uint8)]).tobytes()
        word_at = np.ndarray((n + self.words.shape[1] * 8,), ">u8", raw, strides=(1,))
        shift = [np.clip(8 * (8 * (w + 1) - self.lengths), 0, 64).astype(np.uint64) for w in range(self.words.shape[1])]

        def bound(after: bool) -> np.ndarray:
            low, high = lows, highs
            while (open_ := low < high).any():
                middle = (low + high) // 2
                suffix = order[np.minimum(middle, n - 1)]
                less = np.zeros(len(low), bool)  # suffix (cut to the piece's length) before the piece
                equal = np.ones(len(low), bool)
                for w in range(self.words.shape[1]):
                    if not equal.any():
                        break
                    there = word_at[suffix + 8 * w].astype(np.uint64)
                    there = np.where(shift[w] < 64, (there >> np.minimum(shift[w], np.uint64(63))) << np.minimum(shift[w], np.uint64(63)), np.uint64(0))
                    less |= equal & (there < self.words[:, w])
                    equal &= there == self.words[:, w]
                right = open_ & (less | (equal & after))
                low = np.where(right, middle + 1, low)
                high = np.where(open_ & ~right, middle, high)
            return low

        # Suffixes by their first two symbols, where the search of a piece begins.
        pairs = np.cumsum(np.bincount(codes.astype(np.int32) * 257 + np.append(codes[1:], 0), minlength=257 * 257 + 1))
        upto = np.concatenate([[0], pairs])
        lows, highs = upto[self.pair_low], upto[self.pair_high]

        first, end = bound(False), bound(True)
        count = np.where(self.usable, np.maximum(end - first, 0), 0)
        piece = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        return order[first[piece] + within], piece

    def relaxed(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks laid end to end, each closed by a zero byte: the bytes, where chunks end, and for each place the last piece
        of the encoding of its chunk up to there (its id, UNKNOWN or NONE) and where that piece begins."""
        data = b"\0".join([*chunks, b""])
        raw = np.frombuffer(data, np.uint8)
        sizes = np.array([len(c) for c in chunks])
        ends = np.cumsum(sizes + 1) - 1
        codes = raw.astype(np.uint16) + 1
        codes[ends] = 0
        begin = np.repeat((ends - sizes).astype(np.int32), sizes + 1)
        place, piece = self.occurrences(data, codes)
        place, piece = place.astype(np.int32), piece.astype(np.int32)
        size = self.lengths[piece].astype(np.int32)
        lead = (raw & 0xC0) != 0x80
        covered = np.zeros(len(raw), bool)
        width = 1 + (raw >= 0xC0).astype(np.int32) + (raw >= 0xE0) + (raw >= 0xF0)
        covered[place[size == width[place]]] = True
        covered[ends] = True
        lone = np.flatnonzero(lead & ~covered).astype(np.int32)
        place = np.concatenate([place, lone])
        upto = place + np.concatenate([size, width[lone]])
        piece = np.concatenate([piece, np.full(len(lone), UNKNOWN, np.int32)])
        step = upto - begin[place]
        by = np.argsort(step.astype(np.uint16) if sizes.max() < 1 << 16 else step, kind="stable")  # edges by the position they end at, seen from their chunk's begin
        place, piece, upto = place[by], piece[by], upto[by]
        count = np.bincount(step)
        edges = np.concatenate([[0], np.cumsum(count)]).tolist()
        last, back = np.full(len(raw) + 1, NONE, np.int32), np.zeros(len(raw) + 1, np.int32)
        starts = place == begin[place]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            p, t, e, first = place[a:b], piece[a:b], upto[a:b], starts[a:b]
            before = last[p]
            ready = np.flatnonzero(first | (before != NONE))
            p, t, e = p[ready], t[ready], e[ready]
            ok = self.borders(np.where(first[ready], UNKNOWN, before[ready]), t)
            last[e[ok]], back[e[ok]] = t[ok], p[ok]
        return raw, ends, last, back

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks, each a meta symbol (or none) and what follows it up to the next one, and how many each has."""
        ids, counts, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        sizes = np.array([len(c) for c in chunks], np.int64)
        for k in [*np.flatnonzero(sizes > SECTION).tolist(), len(chunks)]:
            for a, b in _portions(chunks[at:k], INDEX_BYTES):
                got = self._short(chunks[at + a : at + b])
                ids.append(got[0])
                counts.append(got[1])
            if k < len(chunks):
                ids.append(self._long(chunks[k]))
                counts.append([len(ids[-1])])
            at = k + 1
        return np.concatenate(ids), np.concatenate(counts)

    def _short(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw, ends, last, back = self.relaxed(chunks)
        start = ends - [len(c) for c in chunks]
        owners, tokens, at, who = [], [], ends, np.arange(len(chunks))
        while len(who := who[live := at > start[who]]):
            at = at[live]
            owners.append(who)
            tokens.append(np.where(last[at] == UNKNOWN, -1 - back[at], self.ids[last[at]]))
            at = back[at]
        if not owners:
            return np.empty(0, np.int32), np.zeros(len(chunks), np.int64)
        owner, token = np.concatenate(owners[::-1]), np.concatenate(tokens[::-1])  # found from the end
        by = np.argsort(owner, kind="stable")
        owner, token = owner[by], token[by]
        counts = np.bincount(owner, minlength=len(chunks))
        if len(odd := np.flatnonzero(token < 0)):
            width = np.ones(len(token), np.int64)
            lead = raw[-1 - token[odd]]
            width[odd] = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            token = self._with_bytes(token, raw)
            counts = np.bincount(owner, width, len(chunks)).astype(np.int64)
        return token.astype(np.int32), counts

    def _with_bytes(self, tokens: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Put byte pieces for tokens -1 - place, characters without a piece."""
        ids: list[int] = []
        for t in tokens.tolist():
            if t >= 0:
                ids.append(t)
            else:
                lead = int(raw[-1 - t])
                width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                ids += self.byte_id[raw[-1 - t : -1 - t + width]].tolist()
        return np.array(ids, np.int32)

    def _long(self, chunk: bytes) -> np.ndarray:
        """Ids of a long chunk, relaxed in sections side by side."""
        raw, n = np.frombuffer(chunk, np.uint8), len(chunk)
        borders = list(range(0, n, SECTION))
        for k, x in enumerate(borders):  # sections begin with a character
            while x < n and raw[x] & 0xC0 == 0x80:
                x += 1
            borders[k] = x
        borders = [*dict.fromkeys(x for x in borders if x < n), n]
        last, back = np.full(n + 1, NONE, np.int32), np.zeros(n + 1, np.int32)

        def begin_of(a: int) -> int:
            a = max(0, a - LEAD)
            while raw[a] & 0xC0 == 0x80:
                a -= 1
            return a

        spans = [(begin_of(a), b) for a, b in zip(borders[:-1], borders[1:], strict=True)]
        for x, y in _portions([chunk[a:b] for a, b in spans], INDEX_BYTES):
            _, ends, own_last, own_back = self.relaxed([chunk[a:b] for a, b in spans[x:y]])
            for k in range(x, y):
                a, b, begin = borders[k], borders[k + 1], spans[k][0]
                shift = int(ends[k - x]) - b  # from places of the chunk to places among the sections
                low = max(begin, a - self.widest)
                if not begin or (own_last[low + shift : a + shift + 1] == last[low : a + 1]).all():
                    last[a + 1 : b + 1], back[a + 1 : b + 1] = own_last[a + 1 + shift : b + 1 + shift], own_back[a + 1 + shift : b + 1 + shift] - shift
                else:
                    self._one_by_one(chunk, a, b, last, back)
        tokens, at = [], n
        while at > 0:
            tokens.append(int(self.ids[last[at]]) if last[at] >= 0 else -1 - int(back[at]))
            at = int(back[at])
        return self._with_bytes(np.array(tokens[::-1]), raw)

    def _one_by_one(self, chunk: bytes, a: int, b: int, last: np.ndarray, back: np.ndarray) -> None:
        """Relax the places from a to b, given what is known up to a."""
        low = max(0, a - self.widest)
        there = last[low : a + 1].tolist()
        for e in range(a + 1, b + 1):
            state = NONE
            if e == len(chunk) or chunk[e] & 0xC0 != 0x80:
                for p in range(e - 1, max(low, e - self.widest) - 1, -1):
                    if chunk[p] & 0xC0 == 0x80 or (p and there[p - low] == NONE):
                        continue
                    k = self.number.get(chunk[p:e], NONE)
                    if k == NONE and p == e - 1 - sum(1 for q in range(p + 1, e) if chunk[q] & 0xC0 == 0x80):
                        k = UNKNOWN  # one character
                    if k == NONE:
                        continue
                    pair = (UNKNOWN if p == 0 else there[p - low], k)
                    if pair not in self.kept:
                        if len(self.kept) > 100_000:
                            self.kept.clear()
                        self.kept[pair] = bool(self.borders(np.array([pair[0]], np.int32), np.array([k], np.int32))[0])
                    if self.kept[pair]:
                        state = k
                        back[e] = p
                        break
            there.append(state)
        last[a + 1 : b + 1] = there[a + 1 - low :]

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each text."""
        ids, counts = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts laid end to end, and how many each text has."""
        meta = META.encode()
        pieces = [(i, x) for i, t in enumerate(texts) for x in _segments(t)]
        first = [k == 0 or pieces[k - 1][0] != i for k, (i, _) in enumerate(pieces)]
        ids, counts = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        for a, b in _portions([x for _, x in pieces], PORTION):
            got, n = self._portion([(meta if self.prefix and f else b"") + x.replace(b" ", meta) if x else b"" for (_, x), f in zip(pieces[a:b], first[a:b], strict=True)])
            ids.append(got)
            np.add.at(counts, [i for i, _ in pieces[a:b]], n)
        return np.concatenate(ids), counts

    def _portion(self, normal: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        meta = META.encode()
        data = b"".join(normal)
        if not data:
            return np.empty(0, np.int32), np.zeros(len(normal), np.int64)
        raw = np.frombuffer(data, np.uint8)
        codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        is_meta = codes == ord(META)
        edges = np.searchsorted(place, np.concatenate([[0], np.cumsum([len(t) for t in normal])]))
        begin = is_meta.copy()
        begin[1:] &= ~is_meta[:-1]
        begin[edges[:-1][edges[:-1] < len(codes)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(codes))
        chunk, first = distinct_spans(raw, place[starts], place[ends], self.hasher(codes, starts, ends))
        if len(self.known) > CACHE_CHUNKS:
            self.forget()
        names = [data[a:b] for a, b in zip(place[starts[first]].tolist(), place[ends[first]].tolist(), strict=True)]
        new = [k for k, c in enumerate(names) if c not in self.known]
        double = meta + meta
        blanks = [_leading(names[k], meta) if names[k].startswith(double) else 0 for k in new]
        words = [names[k][3 * (b - 1) :] if b > 1 else names[k] for k, b in zip(new, blanks, strict=True)]
        ids, sizes = self.encode_chunks(words)
        if any(b > 1 for b in blanks):
            every = [self._with_blanks(x, b) for x, b in zip(np.split(ids, np.cumsum(sizes)[:-1]), blanks, strict=True)]
            ids, sizes = np.concatenate(every), np.array([len(x) for x in every])
        keep = np.array([len(names[k]) <= CACHED_BYTES for k in new], bool)
        whose = np.repeat(keep, sizes)
        self.remember([names[k] for k, x in zip(new, keep.tolist(), strict=True) if x], ids[whose], sizes[keep])
        at = np.array([self.known.get(c, -1) for c in names])
        table, rest = self.ids_known, np.array(new, np.int64)[~keep]
        sizes_of = np.where(at < 0, 0, self.ids_size[at])
        if len(rest):
            table = np.concatenate([self.ids_known[: self.ids_used], ids[~whose]])
            sizes_of[rest] = sizes[~keep]
            at[rest] = self.ids_used + np.cumsum(sizes[~keep]) - sizes[~keep]
        sizes = sizes_of
        sizes, at = sizes[chunk], at[chunk]
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ids = table[np.arange(upto[-1]) + np.repeat(at - upto[:-1], sizes)]
        return ids, np.diff(upto[np.searchsorted(starts, edges)])

    def _with_blanks(self, ids: np.ndarray, blanks: int) -> np.ndarray:
        """Put back the meta symbols before the last one; a last one that stayed alone belongs to the run."""
        run = blanks - 1
        if run < 1:
            return ids
        if len(ids) and ids[0] == self.runs[1]:
            run, ids = run + 1, ids[1:]
        stack: list[int] = []  # lengths of run pieces; all score alike, so the leftmost pair that is a piece merges first
        for _ in range(run):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return np.concatenate([np.array([self.runs[n] for n in stack], np.int32), ids])

    def decode(self, ids: list[int]) -> bytes:
        text = b"".join(map(self.decoded.__getitem__, ids)).replace(META.encode(), b" ")
        return text[1:] if self.prefix and text[:1] == b" " else text


def _leading(chunk: bytes, meta: bytes) -> int:
    n = 0
    while chunk.startswith(meta, 3 * n):
        n += 1
    return n


def _segments(text: bytes) -> list[bytes]:
    """A long text in pieces that begin with a blank after something else than blanks, which no chunk crosses."""
    meta, out, at = META.encode(), [], 0
    while len(text) - at > PORTION:
        end = at + PORTION
        while 0 < (end := text.find(b" ", end)) and (text[end - 1] == 32 or text.endswith(meta, 0, end)):
            end += 1
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) >> np.uint64(20)).astype(np.int64) % SLOTS


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model per Python worker and file."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in it:
            doc_ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in _portions([t or b"" for t in texts], PORTION):
                ids, counts = pieces.encode_flat([t or b"" for t in texts[a:b]])
                edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                gone = pa.array([t is None for t in texts[a:b]])
                yield pa.record_batch([pa.array(doc_ids[a:b], pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids), mask=gone)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text of encoded documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in it:
            texts = [None if ids is None else pieces.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and the text that the ids decode to, of every text: both ways in one pass, so ids stay in the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("text", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pieces = piece_model(model)
        for batch in it:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in _portions([t or b"" for t in texts], PORTION):
                ids, counts = pieces.encode_flat([t or b"" for t in texts[a:b]])
                for doc_id, text, own in zip(doc_ids[a:b], texts[a:b], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    yield doc_id, len(own), zlib.crc32(own.astype("<u4").tobytes()), None if text is None else pieces.decode(own.tolist())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows(it), schema):
            yield batch.set_column(3, "text", batch.column(3).cast(pa.string()))

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_ids long, ids_crc32 long, text string")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number and CRC of the ids, digest and length of the text they decode to."""
    import public_tokenizers

    read = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    text = F.coalesce("text", F.lit(""))
    return read.select("doc_id", "n_ids", "ids_crc32", F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("long").alias("n_chars"))


QUERIES = {"op1_sentence_pieces": op1_sentence_pieces}
SQL: dict[str, str] = {}
