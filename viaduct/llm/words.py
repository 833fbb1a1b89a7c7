"""Words of many texts at once: byte classes, ranges and hashes in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

from viaduct.llm.batches import mix

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` as sets of bytes: all bytes of other characters are word bytes.
NOT_SPACE = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))
ALNUM = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
LONG = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range: eight bytes a step, mixed in between; a cryptographic digest of those longer than ``LONG``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0xA24BAED4963EE407))
    live = np.flatnonzero(size <= LONG)
    at, left, have = starts[live], size[live], out[live]
    while len(live):
        have = mix(have ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        out[live] = have
        more = np.flatnonzero(left > 8)
        live, at, left, have = live[more], at[more] + 8, left[more] - 8, have[more]
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = data.tobytes()
        out[long] = [int.from_bytes(hashlib.blake2b(raw[s:e], digest_size=8).digest(), "little") for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


class Words:
    """All words of a block of texts, in order.

    ``starts`` and ``ends`` are byte ranges in the block, ``first[d]`` to ``first[d + 1]`` the words of
    text d, ``hash`` a 64-bit hash of each word's lower-cased bytes.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, word_bytes: np.ndarray = ALNUM):
        data = LOWER[data]
        inside = word_bytes[data]
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[at] = True  # no word crosses from one text into the next
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, at)
        self.hash = word_hashes(data, self.starts, self.ends)
        self.counts = np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and for each text where its runs begin in that list."""
        return grams(self.hash, self.first, k)


def gram_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that begin at ``starts``; no run reaches beyond the words."""
    total = words[starts] + np.uint64(k)
    for j in range(1, k):
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += words[starts + j]
    return mix(total)


def grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside texts, and for each text where its runs begin in that list."""
    each = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(each)])
    return gram_hashes(words, np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], each), k), begin


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 .. start + length - 1 of every range, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths)
    return np.arange(total) + np.repeat(shift, lengths)
