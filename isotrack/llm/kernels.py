"""Vectorised hashing of words and bytes, used inside tasks."""

from __future__ import annotations

import hashlib
import re

import numpy as np

U = np.uint64
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)
BLOCK = 1 << 21
PIECE = 1 << 14  # values that are hashed at a time, which fit the caches
WORDS_KEPT = 200_000
SPACE = re.compile(rb"[\x20\x09-\x0d]")
_STATE: dict = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x + U(seed * 0x632BE59BD9B4E019 % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    have = _STATE.get("powers")
    if have is None or len(have[0]) < n:
        up, down = np.full(max(n, BLOCK), BASE, U), np.full(max(n, BLOCK), BASE_INVERSE, U)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if n <= 4 * BLOCK:
            _STATE["powers"] = have
    return have[0][:n], have[1][:n]


def byte_table(lower: bool) -> np.ndarray:
    table = mix(np.arange(256, dtype=U), 77)
    if lower:
        table[65:91] = table[97:123]
    return table


def separators() -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes other than ASCII white space."""
    sep = np.ones(len(buf) + 2, bool)
    sep[1:-1] = separators()[buf]
    edges = np.flatnonzero(sep[1:] != sep[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over random byte values, then mixed.

    Texts made for it can collide, so equal hashes only say where to look.
    """
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(table[buf[lo:hi]] * up, out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out)


def window_hashes(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every k consecutive 64-bit values.

    Spans double: a span's hash is a mix of its halves' hashes, so no sum over
    positions is left in which chosen words could cancel out.
    """
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    for lo in range(0, n, PIECE):
        have, span, done, length = mix(values[lo : min(lo + PIECE, n) + k - 1], seed), 1, None, 0
        while True:
            if k & span:
                done, length = (have, span) if done is None else (_join(done, have[length:]), length + span)
            if length == k:
                break
            have, span = _join(have, have[span:]), 2 * span
        out[lo : lo + PIECE] = done[: min(PIECE, n - lo)]
    return out


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    m = min(len(left), len(right))
    return mix(left[:m] * U(BASE) + right[:m], 1)


class WordDigests(dict):
    """64-bit BLAKE2 digests of words, kept for the words that a worker meets again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_DIGESTS = WordDigests()


def word_digests(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a list of texts: a digest of every word, and each text's first word (one more at the end)."""
    parts, first = [], [0]
    for t in texts:
        raw, n, at = (t or "").encode("utf-8", "surrogatepass"), 0, 0
        raw = raw.lower() if lower else raw  # of bytes, A-Z alone
        while at < len(raw):
            cut = SPACE.search(raw, at + BLOCK)  # long texts by pieces, which bounds the list of words
            end = cut.start() if cut else len(raw)
            said = raw[at:end].split()
            parts.append(np.fromiter(map(_DIGESTS.__getitem__, said), U, len(said)))
            n, at = n + len(said), end + 1
        first.append(first[-1] + n)
    return np.concatenate(parts) if parts else np.zeros(0, U), np.array(first)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats hashing for whole numbers here."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of maximal runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(values)))


def doc_words(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a list of texts: joined bytes, word starts and ends, word hashes, and each text's first word (one more at the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    starts, ends = word_spans(buf)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
    return buf, starts, ends, span_hashes(buf, starts, ends, byte_table(lower)), first


def single_spaced(texts: list[str | None]) -> list[str]:
    """The texts' words joined by one space."""
    return [b" ".join((t or "").encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass") for t in texts]


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit BLAKE2 digests of byte ranges, as two arrays."""
    whole = buf.tobytes()
    joined = b"".join([hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(sizes: list[int], most: int = BLOCK) -> list[tuple[int, int]]:
    """Cut positions so that each slice sums to about ``most`` at the utmost (single larger items alone)."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    return [*out, (begin, len(sizes))] if sizes else []
