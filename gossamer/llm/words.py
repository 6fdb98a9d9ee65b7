"""Words of many texts at once: Arrow's kernels split them, and only distinct words are hashed one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


HASHES = _Hashes()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts, and the place of each line's text."""
    split = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    return split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())


def words_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(line of each word, its number, hashes by number, words by number); ASCII white space parts words."""
    split = pc.ascii_split_whitespace(lines.cast(pa.large_string()))
    own = np.repeat(np.arange(len(lines)), pc.list_value_length(split).to_numpy())
    coded = split.flatten().dictionary_encode()
    number = coded.indices.to_numpy()
    words = coded.dictionary
    names = words.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(HASHES.__getitem__, names), dtype=np.uint64, count=len(names))
    if "" in names:  # what stands before white space at an end
        kept = number != names.index("")
        own, number = own[kept], number[kept]
    return own, number, hashes, words


#: Eight lanes of a byte, each 0 or 1, for every byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhashes(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray, weight: np.ndarray | None = None, most: int = 1, rows: int = 1 << 16) -> np.ndarray:
    """64-bit SimHashes of runs of hashes, ``n`` of them from each start on, one behind the other and none empty; weights are 1 to ``most``.

    Votes of a few hashes add up in lanes of a byte, and longer runs add the counts of their parts.
    """
    out = np.zeros(len(n), dtype=np.uint64)
    run = 255 // most
    weight = np.ones(len(hashes), dtype=np.uint64) if weight is None else weight
    pieces = -(-n // run)
    owner = np.repeat(np.arange(len(n)), pieces)
    begin = np.repeat(starts, pieces) + run * spans(np.zeros(len(pieces), dtype=np.int64), pieces)
    ends = np.append(begin[1:], len(hashes))
    votes = np.zeros((len(begin), 64), dtype=np.uint8)
    first = 0
    while first < len(begin):
        last = max(int(np.searchsorted(ends, begin[first] + rows, side="right")), first + 1)
        a, b = begin[first], ends[last - 1]
        lanes = _LANES[np.ascontiguousarray(hashes[a:b]).view(np.uint8).reshape(-1, 8)] * weight[a:b, None]
        votes[first:last] = np.add.reduceat(lanes, begin[first:last] - a, axis=0).view(np.uint8)
        first = last
    total = np.add.reduceat(weight.astype(np.int64), starts) if len(starts) else np.zeros(0, dtype=np.int64)
    pack = lambda ayes, of: np.packbits(2 * ayes > total[of, None], axis=1, bitorder="little").view(np.uint64).ravel()
    single = pieces[owner] == 1
    out[owner[single]] = pack(votes[single].astype(np.int64), owner[single])
    long = np.flatnonzero(pieces > 1)
    if len(long):
        out[long] = pack(np.add.reduceat(votes[~single].astype(np.int64), np.cumsum(pieces[long]) - pieces[long], axis=0), long)
    return out
