"""Hamming-distance search over 64-bit fingerprints held as vertical bit planes.

Plane ``p`` holds bit ``p`` of 64 fingerprints in each machine word, so one XOR compares one bit of 64 pairs.
Distances of all pairs in a word grow together in carry-save counters (ones, twos, fours and on) with a sticky ``over``
flag; words whose 64 pairs have all passed the radius are abandoned after each run of planes.
"""

from __future__ import annotations

import itertools

import numpy as np

WIDTH = 64
#: Planes between two looks at which words can be abandoned; a multiple of 4.
RUN = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words; fingerprint i is lane i % 64 of word i // 64. Missing lanes are zero."""
    n = len(prints)
    padded = np.zeros(-(-max(n, 1) // WIDTH) * WIDTH, dtype=np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def within(difference, words: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes at most ``radius`` (0 to 31) apart. ``difference(plane, at)`` gives the XOR of a plane for the words ``at``."""
    alive = np.flatnonzero(valid)
    out = np.zeros(words, dtype=np.uint64)
    if not len(alive):
        return out
    ones, twos, over = (np.zeros(len(alive), dtype=np.uint64) for _ in range(3))
    higher = [np.zeros(len(alive), dtype=np.uint64) for _ in range(1 if radius < 8 else 3)]  # fours, eights, sixteens
    for start in range(0, WIDTH, RUN):
        for p in range(start, start + RUN, 4):
            a, b, c, d = (difference(q, alive) for q in range(p, p + 4))
            x = ones ^ a
            carry_1 = (ones & a) | (x & b)
            ones = x ^ b
            x = ones ^ c
            carry_2 = (ones & c) | (x & d)
            ones = x ^ d
            x = twos ^ carry_1
            carry_4 = (twos & carry_1) | (x & carry_2)
            twos = x ^ carry_2
            carry = carry_4
            for i, counter in enumerate(higher):
                higher[i], carry = counter ^ carry, counter & carry
            over |= carry
            over |= _above([ones, twos, *higher], radius)
        open_ = (valid[alive] & ~over) != 0
        if not open_.all():
            alive, ones, twos, over, *higher = (v[open_] for v in (alive, ones, twos, over, *higher))
            if not len(alive):
                return out
    out[alive] = valid[alive] & ~over
    return out


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose number, given by its binary digits from the ones up, is over the radius."""
    greater, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for digit in range(len(counters) - 1, -1, -1):
        if radius >> digit & 1:
            equal = equal & counters[digit]
        else:
            greater = greater | (equal & counters[digit])
            equal = equal & ~counters[digit]
    return greater


def neighbours(planes: np.ndarray, query: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Indices of the valid lanes within the radius of one fingerprint."""
    bits = [ALL if query >> p & 1 else np.uint64(0) for p in range(WIDTH)]
    found = within(lambda p, at: planes[p, at] ^ bits[p], planes.shape[1], valid, radius)
    return np.flatnonzero(_lanes(found))


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


#: Up to so many rows a group is compared lane against shifted lane, all groups of a batch at once; beyond, from a frontier.
SMALL = 2048


def shifted_pairs(prints: np.ndarray, group: np.ndarray, radius: int):
    """Arrays (i, j) of all pairs i < j of equal group, groups contiguous, within the radius; one yield a shift."""
    n = len(prints)
    planes = planes_of(prints)
    words = planes.shape[1]
    wide = np.concatenate([planes, np.zeros((WIDTH, 1), dtype=np.uint64)], axis=1)
    shift = 0
    while True:
        shift += 1
        if shift >= n:
            return
        same = group[:-shift] == group[shift:]
        if not same.any():
            return
        mask = np.zeros(words * WIDTH, dtype=np.uint8)
        mask[: n - shift] = same
        valid = np.packbits(mask, bitorder="little").view(np.uint64)
        skip, bit = divmod(shift, WIDTH)

        def difference(p, at, skip=skip, bit=bit):
            other = np.minimum(at + skip, words)
            moved = wide[p, other]
            if bit:
                moved = (moved >> np.uint64(bit)) | (wide[p, np.minimum(other + 1, words)] << np.uint64(WIDTH - bit))
            return planes[p, at] ^ moved

        found = np.flatnonzero(_lanes(within(difference, words, valid, radius)))
        if len(found):
            yield found, found + shift


def frontier_links(prints: np.ndarray, radius: int, accept=None):
    """(i, j) links that span each connected group of one set of fingerprints, at most one a row.

    A row is compared only with rows no group has reached, so a dense group of m rows costs about one pass
    and not m of them. ``accept(i, candidates)`` may turn candidates down (it gets positions and gives a mask).
    """
    n = len(prints)
    planes = planes_of(prints)
    free = np.zeros(planes.shape[1] * WIDTH, dtype=np.uint8)
    free[:n] = 1
    for first in range(n):
        if not free[first]:
            continue
        free[first] = 0
        todo = [first]
        while todo:
            i = todo.pop()
            near = neighbours(planes, int(prints[i]), np.packbits(free, bitorder="little").view(np.uint64), radius)
            if accept is not None and len(near):
                near = near[accept(i, near)]
            free[near] = 0
            todo.extend(near.tolist())
            for j in near.tolist():
                yield i, j


def links(prints: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within each group (contiguous), fewer than there are rows."""
    out: list[tuple[int, int]] = []
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.diff(edge)
    small = np.repeat(sizes <= SMALL, sizes)
    at = np.flatnonzero(small)
    if len(at):
        label = np.arange(len(at))  # kept flat, so that pairs already joined are told apart all at once
        for i, j in shifted_pairs(prints[at], group[at], radius):
            apart = label[i] != label[j]
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                a, b = label[x], label[y]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
                    out.append((int(at[x]), int(at[y])))
    for start, size in zip(edge[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        out.extend((start + i, start + j) for i, j in frontier_links(prints[start : start + size], radius))
    return out


def scheme(n: int, radius: int, target: int = 1024) -> list[list[tuple[int, int]]]:
    """The pigeonhole tables for n fingerprints: each a list of (first bit, bits) whose values make its key.

    With radius + c blocks, two fingerprints within the radius agree on at least c of them, so every choice of c
    blocks is a table and no pair is lost whatever c is; c grows until chance alone fills a key with ``target`` rows at most.
    """
    for c in itertools.count(1):
        blocks = radius + c
        ends = [WIDTH * i // blocks for i in range(blocks + 1)]
        cut = [(ends[i], ends[i + 1] - ends[i]) for i in range(blocks)]
        if n <= target << min(c * (WIDTH // blocks), 62) or blocks >= 2 * radius:
            return [list(x) for x in itertools.combinations(cut, c)]
