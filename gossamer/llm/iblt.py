"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (its lines, long ones cut on at words chosen by their hash, so that an edit moves the cuts
near it only). Each paragraph's 64-bit digest goes into three cells of a sketch: a count, the sum of digests and the sum of
check values, modulo 2**8, 2**64 and 2**32. Subtracting two sketches leaves the digests that differ, and peeling cells that hold one
recovers them with their side. A fingerprint has the smallest size at which its own digests can be peeled, so where a difference does not
come apart, both texts' digests are peeled out of their fingerprints, sketched again in more cells and subtracted there. What
two fingerprints have in common thus follows from the two strings alone. All texts of a batch are sketched and peeled together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.common import id_text, record_batch, slices, table
from gossamer.llm.words import lines_of, mixed, spans, words_of

#: A long line is cut after a word whose hash is 0 modulo this, so about so many words on average.
CUT_EVERY = 8
#: Cells for each digest that a sketch has at least, and rounds of peeling after which a sketch counts as stuck.
CELLS_PER_DIGEST, ROUNDS = 1.4, 200

_PLACE, _NTH, _MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_SPOTS = np.array([[0xBF58476D1CE4E5B9], [0x94D049BB133111EB], [0xD6E8FEB86659FD93]], dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, the place of each one's text), by text: one of each paragraph, the n-th copy of one having a digest of its own.

    White space between and around words, and empty lines, do not count; a text without words has no digests.
    """
    lines, text_of = lines_of(pa.array(texts, pa.large_string()))
    line, number, hashes, _ = words_of(lines)
    if not len(line):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    word = hashes[number]
    cut = word % np.uint64(CUT_EVERY) == 0
    cut[:-1] |= line[1:] != line[:-1]
    starts = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(word)))
    place = np.arange(len(word)) - np.repeat(starts, sizes)
    keys = mixed(np.add.reduceat(mixed(word + place.astype(np.uint64) * _PLACE), starts) + sizes.astype(np.uint64))
    owner = text_of[line[starts]]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
    if not new.all():
        at = np.arange(len(keys))
        nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        keys = np.where(nth > 0, mixed(keys + nth * _NTH), keys)
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
    return keys[new], owner[new]


def least_third(n: np.ndarray) -> np.ndarray:
    """The first third of a sketch of n digests: 2, 3, 4, 6, 8, 12 and so on, with CELLS_PER_DIGEST cells for each digest and six more."""
    need = np.maximum(n * CELLS_PER_DIGEST / 3 + 2, 2.0)
    power = 2.0 ** np.floor(np.log2(need))
    return np.where(need <= power, power, np.where(need <= 1.5 * power, 1.5 * power, 2 * power)).astype(np.int64)


def larger(third: np.ndarray) -> np.ndarray:
    """The next size: 2, 3, 4, 6, 8 and so on."""
    return np.where(third & (third - 1), third // 3 * 4, third + third // 2)


class Cells:
    """The cells of many sketches, one behind the other, each in three thirds."""

    def __init__(self, third: np.ndarray):
        self.third = third
        self.base = np.concatenate([[0], np.cumsum(3 * third)])
        total = int(self.base[-1])
        self.counts, self.keys, self.checks = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.uint64)

    def _places(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        third = self.third[owner]
        x = keys * _SPOTS
        spot = ((x ^ (x >> np.uint64(29))) % third.astype(np.uint64)).astype(np.int64)
        return (spot + self.base[owner] + third * np.arange(3)[:, None]).ravel()

    def put(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add digests to, or with sign -1 take them from, their owners' sketches; gives the cells touched."""
        at = self._places(keys, owner)
        checks = mixed(keys + _MARK) & _LOW
        minus = sign < 0
        thrice = lambda x: np.concatenate((x, x, x))
        np.add.at(self.counts, at, thrice(sign))
        np.add.at(self.keys, at, thrice(np.where(minus, -keys, keys)))
        np.add.at(self.checks, at, thrice(np.where(minus, -checks, checks)))
        return at

    @classmethod
    def of(cls, keys: np.ndarray, owner: np.ndarray, third: np.ndarray) -> Cells:
        out = cls(third)
        out.put(keys, owner, np.ones(len(keys), dtype=np.int64))
        return out

    def pick(self, which: np.ndarray) -> np.ndarray:
        return spans(self.base[which], 3 * self.third[which])

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests, owners, signs, mask of the sketches that came apart). Empties the cells."""
        owner_of = np.repeat(np.arange(len(self.third)), 3 * self.third)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = np.arange(len(self.counts))
        for _ in range(ROUNDS):
            one = todo[np.abs(self.counts[todo]) == 1]
            sign = self.counts[one]
            keys = np.where(sign > 0, self.keys[one], -self.keys[one])
            checks = np.where(sign > 0, self.checks[one], -self.checks[one]) & _LOW
            pure = mixed(keys + _MARK) & _LOW == checks
            keys, sign, owner = keys[pure], sign[pure], owner_of[one[pure]]
            if not len(keys):
                break
            _, first = np.unique(keys ^ mixed(owner.astype(np.uint64)), return_index=True)
            keys, sign, owner = keys[first], sign[first], owner[first]
            found.append((keys, owner, sign))
            todo = np.unique(self.put(keys, owner, -sign))
        left = (self.counts != 0) | (self.keys != 0) | (self.checks & _LOW != 0)
        apart = np.bincount(owner_of, left, len(self.third)) == 0
        keys, owner, sign = (np.concatenate(x) for x in zip(*found)) if found else (self.keys[:0], owner_of[:0], self.counts[:0])
        return keys, owner, sign, apart


class Fingerprints:
    """Sketches of many texts: the number of digests of each, its cells, and the digests that peeling the cells gives."""

    def __init__(self, n: np.ndarray, cells: Cells):
        self.n, self.cells = n, cells
        whole = Cells(cells.third)
        whole.counts, whole.keys, whole.checks = cells.counts.copy(), cells.keys.copy(), cells.checks.copy()
        keys, owner, _, self.apart = whole.peel()
        order = np.argsort(owner, kind="stable")
        self.keys = keys[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])

    @classmethod
    def of(cls, texts: list[str]) -> Fingerprints:
        """Of each text in the smallest size from ``least_third`` on at which it can be peeled."""
        keys, owner = digests(texts)
        n = np.bincount(owner, minlength=len(texts))
        third = least_third(n)
        while True:
            out = cls(n, Cells.of(keys, owner, third))
            if out.apart.all():
                return out
            third = np.where(out.apart, third, larger(third))

    @classmethod
    def parse(cls, fingerprints: list[str]) -> Fingerprints:
        heads, data = zip(*(f.split(":") for f in fingerprints))
        raw = [base64.b64decode(d) for d in data]
        out = Cells(np.array([len(r) // 39 for r in raw], dtype=np.int64))
        size = [len(r) // 13 for r in raw]
        join = lambda at, dtype: np.frombuffer(b"".join(at), dtype=dtype)
        out.counts = join((r[:k] for r, k in zip(raw, size)), "u1").astype(np.int64)
        out.keys = join((r[k : 9 * k] for r, k in zip(raw, size)), "<u8").copy()
        out.checks = join((r[9 * k :] for r, k in zip(raw, size)), "<u4").astype(np.uint64)
        return cls(np.array([int(h) for h in heads], dtype=np.int64), out)

    def texts(self, which: np.ndarray) -> list[str]:
        """As text: the number of digests, then base64 of counts, sums of digests and of checks (1, 8 and 4 bytes a cell)."""
        c = self.cells
        counts, keys, checks = c.counts.astype("u1"), c.keys.astype("<u8"), (c.checks & _LOW).astype("<u4")
        spans = [(i, c.base[i], c.base[i + 1]) for i in which.tolist()]
        return [f"{self.n[i]}:{base64.b64encode(counts[a:b].tobytes() + keys[a:b].tobytes() + checks[a:b].tobytes()).decode()}" for i, a, b in spans]

    def _add(self, to: Cells, which: np.ndarray, sign: int) -> None:
        """Add the sketches of ``which`` to ``to``: their cells where the sizes are equal, their digests sketched anew where they are not."""
        same = np.flatnonzero(self.cells.third[which] == to.third)
        a, b = to.pick(same), self.cells.pick(which[same])
        to.counts[a] += sign * self.cells.counts[b]
        to.keys[a] += self.cells.keys[b] if sign > 0 else -self.cells.keys[b]
        to.checks[a] += self.cells.checks[b] if sign > 0 else -self.cells.checks[b]
        other = np.flatnonzero(self.cells.third[which] != to.third)
        sizes = (self.starts[1:] - self.starts[:-1])[which[other]]
        to.put(self.keys[spans(self.starts[which[other]], sizes)], np.repeat(other, sizes), np.full(sizes.sum(), sign, dtype=np.int64))

    def apart_by(self, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(only on the left, only on the right) for each pair of places: subtract, peel, and retry larger what stays."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(self.keys[:0], self.keys[:0])] * len(left)
        third, open_ = np.maximum(self.cells.third[left], self.cells.third[right]), np.arange(len(left))
        while len(open_):
            cells = Cells(third[open_])
            self._add(cells, left[open_], 1)
            self._add(cells, right[open_], -1)
            cells.counts = (cells.counts + 128) % 256 - 128  # counts are known modulo 2**8
            keys, owner, sign, apart = cells.peel()
            order = np.argsort(owner, kind="stable")
            keys, sign = keys[order], sign[order]
            starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(open_)))])
            for i in np.flatnonzero(apart).tolist():
                own, side = keys[starts[i] : starts[i + 1]], sign[starts[i] : starts[i + 1]]
                out[open_[i]] = own[side > 0], own[side < 0]
            open_ = open_[~apart]
            third[open_] = larger(third[open_])
        return out

    def likeness(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Shared digests over all digests of each pair of places; two texts without digests are alike."""
        apart = np.array([len(a) + len(b) for a, b in self.apart_by(left, right)], dtype=np.int64)
        shared = (self.n[left] + self.n[right] - apart) / 2
        return np.where(shared + apart > 0, shared / np.maximum(shared + apart, 1), 1.0)


def fingerprint(text: str) -> str:
    return Fingerprints.of([text]).texts(np.array([0]))[0]


def difference(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in the text of fingerprint ``a`` and only in that of ``b``."""
    return Fingerprints.parse([a, b]).apart_by(np.array([0]), np.array([1]))[0]


def likeness(a: str, b: str) -> float:
    """Shared digests over all digests of two texts, from their fingerprints alone."""
    return float(Fingerprints.parse([a, b]).likeness(np.array([0]), np.array([1]))[0])


def edited(text: str, following: str) -> str:
    """The text with its last third, in code points and rounded down, replaced by as many of the beginning of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


#: Documents of a range of ids, about, and the most ranges, of which the driver holds 16 bytes each. Ranges are streamed, so their size
#: costs a task time and no memory.
RANGE_ROWS, MOST_RANGES = 2_000, 50_000
#: Characters of text that a task holds at one time, or one document, and documents.
HELD_CHARS, HELD_ROWS = 1 << 20, 512


def _tie(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace")) >> 1


def _dealt(docs: DataFrame) -> DataFrame:
    """(range, role, doc_id, tie, packed): documents dealt into ranges of ids, in the order of their succession.

    Role 0 are the range's own documents by descending id, equal ids by ``tie``, null ids behind all others; role 1 is
    the first document of the next range, with which the last one here goes on. Only the bounds of the ranges and the
    largest id of each come to the driver. Range i is partition i, so none waits behind another. All rows of one id are in one range.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    ranges = min(max(1, ids.count() // RANGE_ROWS), MOST_RANGES)
    cuts = ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    bounds = np.array(sorted({-int(x) for x in cuts}), dtype=np.int64)  # on negated ids, so that range 0 has the largest

    def place(ids: pa.Array) -> np.ndarray:
        known = np.array([np.iinfo(np.int64).max if x is None else -x for x in ids.to_pylist()], dtype=np.int64)
        return np.searchsorted(bounds, known, side="right")

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column(0))), batch.column(0)], names=["range", "top"])

    def least_tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_tie(t) for t in texts], pa.int64())], names=["tie"])

    tops = {r["range"]: r["top"] for r in ids.mapInArrow(largest, "range long, top long").groupBy("range").agg(F.max("top").alias("top")).collect()}
    filled = sorted(tops)
    # largest id of a range -> the range before it; the first range follows the last one. Rows without an id have a range of their own
    # only where no row has one, and then the one with the least tie comes first
    heads = {tops[r]: filled[i - 1] for i, r in enumerate(filled)}
    first_null = docs.where("doc_id is null").mapInArrow(least_tie, "tie long").agg(F.min("tie")).first()[0] if not filled else None

    schema = pa.schema([("range", pa.int64()), ("role", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress  # texts are the bulk of what is shuffled
        for ids, texts in slices(batches):
            rows = []
            for at, doc, text in zip(place(ids).tolist(), ids.to_pylist(), texts):
                row = (doc, _tie(text), pack((text or "").encode("utf-8", "replace")))
                rows.append((at, 0, *row))
                if doc in heads:
                    rows.append((heads[doc], 1, *row))
                elif first_null is not None and row[1] == first_null:
                    rows.append((at, 1, *row))
            yield record_batch(schema, [list(c) for c in zip(*rows)] if rows else [[] for _ in schema])

    out = docs.mapInArrow(run, "range long, role long, doc_id long, tie long, packed binary")
    return out.repartitionById(len(bounds) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "role", F.col("doc_id").desc_nulls_last(), "tie")


def _compared(held: list[tuple[int, int, int | None, str]]) -> list[list]:
    """Columns of the result for every row of ``held`` (range, role, doc_id, text) that another one of its range follows."""
    own = np.array([i for i in range(len(held) - 1) if held[i][0] == held[i + 1][0] and not held[i][1]], dtype=np.int64)
    if not len(own):
        return [[] for _ in range(7)]
    texts = [h[3] for h in held]
    changed = [edited(texts[i], texts[i + 1]) for i in own.tolist()]
    prints = Fingerprints.of(texts + changed)
    new = len(held) + np.arange(len(own))
    return [
        [held[i][2] for i in own.tolist()], [len(texts[i]) for i in own.tolist()], [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
        prints.texts(own), prints.texts(new), prints.likeness(own, new).tolist(), prints.likeness(own, own + 1).tolist(),
    ]


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited version, which goes over into the document after it.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Documents follow each other by
    descending doc_id and the first one follows the last; equal ids are ordered by a hash of the text, null ids come last. A
    null text counts as empty; a document alone follows itself; an empty table gives no rows. Further columns are not looked at. A task
    holds HELD_CHARS characters of text at a time, or two documents if they are longer.
    """
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    schema = pa.schema([*fields, ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int, int, int | None, str]] = []
        chars = 0
        for batch in batches:
            for i in range(batch.num_rows):
                at, role, doc = (batch.column(k)[i].as_py() for k in range(3))
                if held and role and held[-1][0] == at and held[-1][1]:
                    continue  # a further row of the id that begins the next range
                text = unpack(batch.column(4)[i].as_py()).decode()
                held.append((at, role, doc, text))
                chars += len(text)
                if (chars >= HELD_CHARS or len(held) >= HELD_ROWS) and len(held) > 1:
                    yield record_batch(schema, _compared(held))
                    held, chars = held[-1:], len(text)
        if held:
            yield record_batch(schema, _compared(held))

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(id_text(docs)).mapInArrow(run, ddl)


def op9_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likeness of every document, its edited text and the next document; edge cases as in ``compare_versions``."""
    return compare_versions(table(spark, sf_dir, "documents"))
