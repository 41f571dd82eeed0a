"""Hashed word shingles of whole batches of texts, and their fast similarity sketches."""

from __future__ import annotations

import numpy as np

from linkloom.llm.byte_bpe import BASE, mixed

WORDS = 5
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE_MIX = mixed(LOWER)
PLACE_MIX = mixed(np.arange(1000, 1000 + WORDS)) | np.uint64(1)
LENGTH_MIX = mixed(np.arange(2000, 2001 + WORDS))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                    powers = np.full(n, factor, np.uint64)
                    powers[0] = 1
                    setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up, cls.down


def cut_words(texts: list[bytes], space: np.ndarray, byte_mix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: the bytes, where words begin and end, their 64-bit hashes, and for each
    text (and the end) the number of words before it. space: which bytes part words; byte_mix: of each byte."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    apart = space[data]
    change = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if len(data) and not apart[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[0::2], change[1::2]
    up, down = _Powers.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_mix[data] * up[: len(data)], out=total[1:])
        hashes = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return data, starts, ends, hashes, np.searchsorted(starts, edges)


PIECE = 1 << 19  # bytes of a long text whose words are hashed at a time


def text_words(text: bytes) -> np.ndarray:
    """Hashes of a text's words, worked out in pieces that end at white space."""
    found, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        found.append(cut_words([text[at:end]], SPACE, BYTE_MIX)[3])
        at = end
    return np.concatenate(found)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; of fewer words, one of the whole sequence."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        words = text_words(texts[0])
        first = np.array([0, len(words)])
    else:
        _, _, _, words, first = cut_words(texts, SPACE, BYTE_MIX)
    with np.errstate(over="ignore"):
        windows = max(0, len(words) - WORDS + 1)
        total = np.full(windows, LENGTH_MIX[WORDS])
        for k in range(WORDS):
            total += words[k : k + windows] * PLACE_MIX[k]
        shingles = mix(total)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(shingles[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix(np.array([(words[a:b] * PLACE_MIX[: b - a]).sum() + LENGTH_MIX[b - a]])))
            else:
                out.append(shingles[:0])
    return out


def fingerprint(shingles: np.ndarray) -> bytes:
    """16 bytes that identify a set."""
    with np.errstate(over="ignore"):
        a = mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(shingles))
        b = np.bitwise_xor.reduce(mix(shingles + np.uint64(0x0123456789ABCDEF)))
    return np.array([mix(np.array([a]))[0], b], ">u8").tobytes()


COORDINATES = 120
BANDS = 24
ROUND_MIX = mixed(np.arange(5000, 5000 + 2 * COORDINATES))
VALUE_BITS = np.uint64(40)


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a set that is not empty: t coordinates, each equal in two sketches with the
    sets' similarity as probability.

    In each of the first t rounds every element falls into a bin chosen by its hash; in round t + b all
    fall into bin b. A bin keeps its least (round, value); once all are filled, later rounds change
    nothing, so rounds are done in blocks until then.
    """
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 4096 // len(shingles))
    at = 0
    while at < 2 * t:
        rounds = np.arange(at, min(2 * t, at + step))
        with np.errstate(over="ignore"):
            h = mix(shingles[None, :] ^ ROUND_MIX[rounds][:, None])
        bins = ((h >> VALUE_BITS) % np.uint64(t)).astype(np.int64)
        late = rounds >= t
        bins[late] = (rounds[late] - t)[:, None]
        keys = (rounds.astype(np.uint64) << VALUE_BITS)[:, None] | (h & ((np.uint64(1) << VALUE_BITS) - np.uint64(1)))
        np.minimum.at(out, bins.ravel(), keys.ravel())
        at += step
        if out.max() < (np.uint64(at) << VALUE_BITS):
            break
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One signed 64-bit key for each band of neighbouring coordinates."""
    rows = coordinates.reshape(bands, -1)
    with np.errstate(over="ignore"):
        total = mixed(np.arange(9000, 9000 + bands))
        for k in range(rows.shape[1]):
            total = mix(total * np.uint64(BASE) + rows[:, k])
    return total.astype(np.int64)
