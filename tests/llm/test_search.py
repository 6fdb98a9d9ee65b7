"""SimHash, line dedup and what they share, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gossamer.llm.bitslice import frontier_links, links, neighbours, planes_of, scheme, shifted_pairs
from gossamer.llm.line_dedup import Lines, dedup_lines, edit_distance, normalised, repeated_lines
from gossamer.llm.near_copies import Shingles, keep_first_copy
from gossamer.llm.pigeonhole import cells
from gossamer.llm.simhash import fingerprint, keep_first, near_duplicates

from .conftest import varied


def components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


def clustered(rng, n):
    base = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    out = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return np.array(out, dtype=np.uint64)


def close(prints, radius):
    d = np.bitwise_count(prints[:, None] ^ prints[None])
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius)) if i < j}


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_planes(radius):
    rng = random.Random(radius)
    for n in (1, 5, 64, 65, 300):
        prints = clustered(rng, n)
        expected = close(prints, radius)
        group = np.zeros(n, dtype=np.int64)
        found = {(int(i), int(j)) for a, b in shifted_pairs(prints, group, radius) for i, j in zip(a, b)}
        assert found == expected
        valid = np.full(planes_of(prints).shape[1], 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        near = neighbours(planes_of(prints), int(prints[0]), valid, radius)
        assert {int(j) for j in near if 0 < j < n} == {j for i, j in expected if i == 0}
        spanning = list(frontier_links(prints, radius))
        assert len(spanning) < n and components(n, spanning) == components(n, expected)
        half = np.arange(n) // max(1, n // 2)
        assert components(n, links(prints, half, radius)) == components(n, {(i, j) for i, j in expected if half[i] == half[j]})


@pytest.mark.parametrize("n, tables", [(10, 5), (10**6, 5), (10**8, 15), (10**12, 70)])
def test_pigeonhole_scheme_loses_nothing(n, tables):
    cuts = scheme(n, 4)
    assert len(cuts) == tables
    rng = random.Random(n)
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(all(flips >> first & (1 << bits) - 1 == 0 for first, bits in parts) for parts in cuts)


def test_cells_bring_close_prints_together_whatever_is_hot(spark):
    rng = random.Random(9)
    prints = np.unique(clustered(rng, 400)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    held = {}
    for r in cells(df, len(prints), 4, chunk_rows=10).collect():
        held.setdefault(r.cell, set()).add(r.fp)
    together = {(a, b) for c in held.values() for a in c for b in c}
    p = prints.view(np.uint64)
    assert all((int(prints[i]), int(prints[j])) in together for i, j in close(p, 4))


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in (None, "", "one", "One TWO three", "a b c d e", "É a b c d", *(t for _, t in varied(20))):
        assert fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("rows", [varied(), []])
def test_near_duplicates_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    prints = np.array([brute_print(t) for _, t in rows], dtype=np.uint64)
    assert got == dict(enumerate(components(len(rows), close(prints, 4) if rows else ())))
    kept = [r.doc_id for r in keep_first(df).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_near_duplicates_at_the_edges(edges, nothing):
    rows = near_duplicates(edges).collect()
    assert len(rows) == 16
    by_id = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[5] == by_id[6] == by_id[9] == by_id[13] == 5 and by_id[8] == 7
    assert {r.component_id for r in rows if r.doc_id is None} == {1, 5}
    kept = keep_first(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id or 0 for r in kept.collect())[:6] == [0, 0, 1, 4, 5, 5]
    assert near_duplicates(nothing).count() == 0 and keep_first(nothing).count() == 0


def brute_copies(texts, least=0.8):
    """The first of each group by Jaccard of five-word shingles alone, every pair."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)})
    return components(len(texts), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9])


def copies(n=60, seed=31):
    """Texts with copies that have one word in so many changed, left out or put in, so that some are near 0.8 and others under it."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 5, 30, 80, 300)))]
        rows.append(" ".join(words))
        for every in (200, 60, 50, 40, 30):
            other = [x for w in words for x in ([w] if rng.random() > 1 / every else [[], [w, "more"], ["other"]][rng.randrange(3)])]
            rows.append("  ".join(other).upper())
    return list(enumerate(rows))


def test_near_copies_against_every_pair(spark):
    rows = copies() + [(1000 + i, t) for i, t in varied()]
    group = brute_copies([t for _, t in rows])
    expected = sorted(rows[i][0] for i, g in enumerate(group) if g == i)
    got = sorted(r.doc_id for r in keep_first_copy(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert set(expected) <= set(got) and len(got) <= len(expected) + 2 and len(rows) - len(expected) > 150


def test_shingles_of_a_batch_are_those_of_each():
    texts = ["", " \n", "One", "a b c d e", "a B c d e f", "x " * 700, "ä b\tc d e f g h"]
    every = Shingles(pa.array(texts, pa.large_string()))
    assert [len(x) for x in every.sets()] == [0, 0, 1, 1, 2, 1, 4] and every.keys[0] == every.keys[1] == 0
    for i, t in enumerate(texts):
        alone = Shingles(pa.array([t], pa.large_string()))
        assert alone.keys[0] == every.keys[i] and alone.prints()[0] == every.prints()[i] and alone.bands().to_pylist()[0] == every.bands().to_pylist()[i]
    print_ = every.prints().view(np.uint64)[6]
    hashes = every.hashes[every.owner == 6]
    assert print_ == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_at_the_edges(spark, edges, nothing):
    kept = keep_first_copy(edges)
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert kept.columns == edges.columns and keep_first_copy(nothing).count() == 0
    assert ids == [1, 4, 5, 7, 10, 11, None, None]  # 12 repeats 5 three times, with the same shingles but for the joints
    rows = [(1, "a b c d e f", "x", 1), (1, "an other text with more words", "y", 2), (1, "a b c d e f", "x", 1)]
    got = keep_first_copy(spark.createDataFrame(rows, "doc_id long, text string, row string, own int")).collect()
    assert sorted(tuple(r) for r in got) == sorted(set(rows))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(2))
        most = rng.randint(0, 8)
        assert edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def test_normalised():
    assert normalised("  The CAT, sat on 12 mats!! ") == "the cat sat on 0 mats" and normalised("") == "" and normalised("ABC") == "abc"


def plain_form(line):
    """The normal form of a line, by regular expressions on the whole of it."""
    line = re.sub(r"([\u3040-\u30ff\u3400-\u9fff])", r" \1 ", re.sub(r"\d+", "0", re.sub(r"\W+", " ", line.lower())))
    return " ".join(line.split())


def similar_lines(a, b, least):
    return abs(len(a) - len(b)) <= (1 - least) * max(len(a), len(b)) + 1e-9 and levenshtein(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9


def brute_lines(rows, least=0.8, alike=similar_lines):
    """Every pair of distinct lines of five words or more by edit similarity alone."""
    seen = [(i, n, plain_form(line)) for i, t in sorted(rows) for n, line in enumerate(t.split("\n")) if plain_form(line)]
    lines = sorted({line for _, _, line in seen})
    long = [i for i, x in enumerate(lines) if len(x.split()) >= 5]
    group = dict(zip(lines, components(len(lines), [(i, j) for i in long for j in long if j < i and alike(lines[i], lines[j], least)])))
    first, out = set(), {}
    for i, n, line in seen:
        if group[line] in first:
            out.setdefault(i, []).append(n)
        first.add(group[line])
    return out


def test_lines_of_a_batch_are_those_of_each():
    rng = random.Random(11)
    texts = ["", "\n\n", "one", "日本語 の テスト\nx-y 12,5 foo_bar", " \t\n a  b \n", "w " * 300 + "\n" + "long wörd " * 90, "\n".join(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 70))) for _ in range(30))]
    every = Lines.of(pa.array(texts, pa.large_string()))
    assert [(t, n, x) for t, n, x in zip(every.text.tolist(), every.line.tolist(), every.forms())] == [(t, n, plain_form(x)) for t, text in enumerate(texts) for n, x in enumerate(text.split("\n")) if plain_form(x)]
    assert every.sizes().tolist() == [len(x) for x in every.forms()] and len(set(every.keys().tolist())) == len(set(every.forms()))
    marks = every.marks().to_pylist()
    for form, key, fp, mark in zip(every.forms(), every.keys().tolist(), every.prints().tolist(), marks):
        words = form.split()
        ones = np.zeros(64, dtype=np.int64)
        for w in words:
            ones += (1 + min(len(w), 12) // 3) * np.array([xxhash.xxh64_intdigest(w) >> i & 1 for i in range(64)])
        assert fp == np.packbits(2 * ones > sum(1 + min(len(w), 12) // 3 for w in words), bitorder="little").view(np.int64)[0]
        alone = Lines.of(pa.array([form], pa.large_string()))
        assert alone.keys().tolist() == [key] and alone.marks().to_pylist() == [mark] and bool(mark) == (len(words) >= 5)


def test_line_dedup_against_brute_force(spark):
    rows = varied()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_lines(rows)
    assert {r.doc_id: r.lines for r in repeated_lines(df).collect()} == expected and sum(map(len, expected.values())) > 30
    for r in dedup_lines(df).collect():
        assert r.text == "\n".join(x for n, x in enumerate(dict(rows)[r.doc_id].split("\n")) if n not in expected.get(r.doc_id, ()))


def test_rows_that_share_an_id_lose_no_line(spark):
    rows = [(5, "one line that stands here alone\nalpha beta gamma delta epsilon zeta"), (5, "north and south and east and west\na unique line that nobody else has ever written"), (5, "alpha beta gamma delta epsilon zeta"), (6, "alpha beta gamma delta epsilon zeta!\nlast")]
    got = sorted(r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert "\n".join(got).count("alpha beta") == 1 and "unique line" in "".join(got) and "north" in "".join(got) and "last" in got


def test_line_dedup_with_clashing_names_and_long_lines(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(150_000))
    rows = [(1, long, "a", 1), (2, long + " more", "b", 2), (3, None, None, None), (4, "w1 " * 9000, "c", 3), (5, "w22 " * 9000 + "more", "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__lines` string, `a.b` int").withColumnsRenamed({"a.b": "own"})
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert dedup_lines(df).columns == df.columns and got[1].text == long and got[2].text == "" and got[2]["__lines"] == "b" and got[3].text is None and got[1].own == 1 and got[5].text == ""


def test_line_dedup_at_the_edges(edges, nothing):
    out = dedup_lines(edges)
    assert out.columns == edges.columns and out.count() == 16
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert got[1] is None and got[2] == "" and got[4] == "word" and got[6] == "" and got[12] == "" and got[13] == "" and len(got[7]) > 1000 and got[8] == ""
    assert dedup_lines(nothing).count() == 0 and dedup_lines(nothing).columns == nothing.columns
