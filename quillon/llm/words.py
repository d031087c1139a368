"""Words of many texts at once, as byte ranges and 64-bit numbers in arrays."""

from __future__ import annotations

import hashlib

import numpy as np

_B = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_SEGMENT + 1, np.uint64)
    out[0] = 1
    filled = 1
    while filled <= _SEGMENT:
        n = min(filled, _SEGMENT + 1 - filled)
        with np.errstate(over="ignore"):
            out[filled : filled + n] = out[:n] * np.uint64(pow(base, filled, 1 << 64))
        filled += n
    return out


_UP, _DOWN = _powers(_B), _powers(pow(_B, -1, 1 << 64))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Lower-case letters, digits and all non-ASCII characters, after A-Z are lower-cased.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Everything but white space.
NONSPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


class Words:
    """Words of a list of texts: byte ranges in `data`, a number for each, and the index of the text it is from.

    Equal words have equal numbers; different ones practically always different numbers.
    """

    def __init__(self, texts: list[str] | list[bytes], inside: np.ndarray, fold: np.ndarray | None = None):
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self.data = data if fold is None else fold[data]
        is_in = inside[self.data]
        edge = np.flatnonzero(is_in[1:] != is_in[:-1]) + 1
        if is_in[0]:
            edge = np.append(0, edge)
        self.start, self.stop = edge[::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        self.number = self._numbers()

    def _numbers(self) -> np.ndarray:
        """A polynomial of each word's bytes modulo 2**64, mixed with its length."""
        out = np.empty(len(self.start), np.uint64)
        with np.errstate(over="ignore"):
            at = 0
            while at < len(self.start):
                base = int(self.start[at])
                to = int(np.searchsorted(self.stop, base + _SEGMENT, side="right"))
                if to <= at:  # one word longer than a segment
                    digest = hashlib.blake2b(self.data[base : self.stop[at]].tobytes(), digest_size=8).digest()
                    out[at] = int.from_bytes(digest, "little")
                    at += 1
                    continue
                part = self.data[base : self.stop[to - 1]].astype(np.uint64) + np.uint64(1)
                sums = np.append(np.uint64(0), np.cumsum(part * _UP[: len(part)]))
                s, e = self.start[at:to] - base, self.stop[at:to] - base
                h = (sums[e] - sums[s]) * _DOWN[s]
                h ^= (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                out[at:to] = h * np.uint64(0xD6E8FEB86659FD93)
                at = to
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(number: np.ndarray, n: int) -> np.ndarray:
    """A number for each n consecutive entries."""
    if len(number) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(number) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9FB21C651E98DF25) + number[k : len(number) - n + 1 + k]
    return mixed(h)


class SuffixAutomaton:
    """All factors of the word sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w, q: int) -> int:
        """The state for the shorter factors of q that p leads to by w."""
        new = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def add(self, sequence: list) -> None:
        last = 0
        for w in sequence:
            q = self.next[last].get(w, -1)
            if q >= 0:  # an earlier sequence has it
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            now, p = self._state({}, 0, self.length[last] + 1), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = now

    def statistics(self, sequence: list) -> list[int]:
        """For each position, the length of the longest factor that ends there."""
        out, state, n = [], 0, 0
        for w in sequence:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            out.append(n)
        return out
