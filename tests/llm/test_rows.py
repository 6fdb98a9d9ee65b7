"""Operators that judge, scan or encode each text, against brute force and at the edges."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gossamer.llm import iblt, sharding
from gossamer.llm.packing import byte_bpe, fill, pack, plan
from gossamer.llm.quality import Bands, judge, measures, repeated_words, verdict
from gossamer.llm.secrets import BASE, Rule, find_secrets, joined, ledger_at, redact
from gossamer.llm.sentencepiece_viterbi import Codec, StreamingViterbi, decode, encode
from gossamer.llm.sharding import fisher_yates, shuffle_into_shards
from gossamer.llm.toxicity import Lexicon, clause_scores, fit, grammar, keep_clean, logistic, score, train
from gossamer.llm.url_filter import filter_urls, propagate

from .conftest import prose, varied

ODD = ["", " ", "\n", "a  b", " lead", "trail ", "a\n b", "tab\t x", "it's don't", "日本 語", "🙂 x", "a b c", "<|endoftext|> x", "<s> </s> <0x0A>", "x" * 200, "▁x ▁", "中" * 60]


def odd_texts(n=300):
    rng = random.Random(4)
    return ODD + ["".join(rng.choice("ab \né'1🙂th ing") for _ in range(50)) for _ in range(n)]


# -- packing -------------------------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = byte_bpe()()
    marked = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|>  y<|endoftext|><|endoftext|>\n", "<|endoftext|", "<|endoftext|>>", "a <|endoftext|> b c"]
    for t in marked + odd_texts() + [t for _, t in varied(30)]:
        assert np.frombuffer(encoder(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, t


def test_fill_finds_the_best_sum():
    rng = random.Random(6)
    for _ in range(60):
        counts = [0] + [rng.choice([0, 0, 1, 2, 5]) for _ in range(12)]
        capacity = rng.randint(1, 40)
        sums = {0}
        for length, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= capacity}
        took = fill(counts, capacity)
        assert sum(x * k for x, k in enumerate(took)) == max(sums) and all(k <= n for k, n in zip(took, counts))


def test_plan_places_every_item_once():
    rng = random.Random(7)
    histogram = {rng.randint(1, 64): rng.randint(1, 3000) for _ in range(30)}
    rows = plan(histogram, 64)
    for length, n in histogram.items():
        own = rows[rows[:, 0] == length]
        assert own[0, 1] == 0
        ends = [*own[1:, 1], n]
        assert all((end - r[1]) % r[2] == 0 and r[4] + r[2] * length <= 64 for r, end in zip(own, ends))
    assert len(rows) < 2000 and plan({}, 64).shape == (0, 5)


def packed_right(rows, texts, capacity):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in texts.items():
        data = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and zlib.crc32(data[4 * at : 4 * (at + r.length)]) == r.ids_crc32 and r.doc_tokens == len(data) // 4
            at += r.length
        assert at == len(data) // 4
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 256])
def test_packing(spark, capacity):
    rows = varied(80)
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), capacity=capacity).collect()
    n = packed_right(got, dict(rows), capacity)
    assert n <= 1.02 * sum(r.length for r in got) / capacity + 2


def test_packing_at_the_edges(edges, nothing):
    got = pack(edges, with_ids=True)
    rows = got.collect()
    assert sum(r.start == 0 for r in rows) == 16 and all(len(r.ids) == 4 * r.length for r in rows)
    assert {(r.length, r.doc_tokens) for r in rows if r.doc_id in (1, 2)} == {(1, 1)}
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(s)] == [0, *np.cumsum([x for _, x in sorted(s)])[:-1]] for s in at.values())
    assert pack(nothing).count() == 0


# -- sharding ------------------------------------------------------------------------------------------------------------------


def test_fisher_yates_is_a_fair_permutation():
    assert sorted(fisher_yates(100, 1, 2)) == list(range(100)) and len(fisher_yates(0, 1, 2)) == 0
    counts = collections.Counter(tuple(fisher_yates(3, s, 0).tolist()) for s in range(3000))
    assert len(counts) == 6 and min(counts.values()) > 400


def test_shards(spark, edges, nothing, tmp_path):
    rows = varied(200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (shuffle_into_shards(df.repartition(n), str(tmp_path / f"s{n}"), bucket_bytes=4000) for n in (2, 7))
    a, b = ({r.doc_id: (r.shard, r.slot, r.text) for r in d.collect()} for d in (one, two))
    assert a == b and {i: t for i, (_, _, t) in a.items()} == dict(rows)
    sizes = collections.Counter(s for s, _, _ in a.values())
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(k for s, k, _ in a.values() if s == shard) == list(range(n)) for shard, n in sizes.items())
    out = shuffle_into_shards(edges, str(tmp_path / "e"))
    assert out.count() == 16 and {"shard_", "slot_", "shard", "slot", "lang"} <= set(out.columns)
    assert shuffle_into_shards(nothing, str(tmp_path / "n")).count() == 0


def test_the_order_rebuilt(spark, tmp_path, monkeypatch):
    """Buckets one after the other, each in the order of its seeded shuffle, whatever parts they are dealt into."""
    monkeypatch.setattr(sharding, "MOST_PARTS", 3)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in varied(150)], "doc_id long, text string, shard int, shard_ int")
    size = sum(len(r.text.encode()) + 64 for r in df.collect())
    buckets = -(-size // 4000)
    named = df.select("doc_id", F.pmod(F.xxhash64(F.lit(sharding.SEED), "doc_id", "text"), F.lit(buckets)).alias("b"), F.xxhash64("doc_id", F.lit(sharding.SEED)).alias("h")).collect()
    order = []
    for b in range(buckets):
        own = sorted((r.h, r.doc_id) for r in named if r.b == b)
        order += [own[i][1] for i in fisher_yates(len(own), sharding.SEED, b).tolist()]
    out = shuffle_into_shards(df, str(tmp_path / "o"), bucket_bytes=4000)
    got = sorted((r.shard, r.slot, r.doc_id) for r in out.collect())
    assert [d for _, _, d in got] == order and buckets > 6 and {"shard_", "shard__"} <= set(out.columns)


# -- quality -------------------------------------------------------------------------------------------------------------------


def test_measures():
    rng = random.Random(8)
    for t in ["", " ", "a", "a\na\n\n\nb", "# $ x|y", "a b c d e f g h " * 3, *(t for _, t in varied(30)), *[" ".join(rng.choice("abc") for _ in range(60)) for _ in range(40)]]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, seen, repeated = [x for x in t.split("\n") if x.split()], set(), 0
        for x in lines:
            repeated += x in seen
            seen.add(x)
        assert measures(t) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(marked))
    assert repeated_words([b"x"] * 9) == 9 and repeated_words([b"x"] * 8) == 0


def test_bands():
    bands = Bands()
    assert verdict(5_000, 50.0, [], bands) == "repetitive" and verdict(5_000, 1.01, [], bands) == "incompressible" and verdict(0, 1.0, [], bands) == "fine"
    assert verdict(20_000, 2.5, [9.0, 9.0, 2.0, 2.0], bands) == "repetitive" and verdict(20_000, 2.5, [2.0] * 9 + [9.0], bands) == "fine"


def test_quality(spark, edges, nothing):
    rng = random.Random(9)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(6000))
    df = spark.createDataFrame([(1, "x y z. " * 900), (2, noise), (3, prose(rng, 300)), (4, "too short")], "doc_id long, text string")
    got = {r.doc_id: r for r in judge(df).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [False, False, True, False] and got[2].compression == "incompressible" and got[1].compression == "repetitive"
    assert abs(got[3].ratio - len(df.where("doc_id = 3").first().text) / len(zstandard.ZstdCompressor(level=3).compress(df.where("doc_id = 3").first().text.encode()))) < 1e-9
    rows = judge(edges).collect()
    assert len(rows) == 16 and all(not r.kept and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3)) and judge(nothing).count() == 0


# -- fingerprints --------------------------------------------------------------------------------------------------------------


def brute_digests(text):
    """The set of digests of one text, a word at a time."""
    import xxhash

    mask = 2**64 - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    seen, out = collections.Counter(), set()
    for line in text.encode().split(b"\n"):
        part = []
        words = line.split()
        for i, word in enumerate(words):
            part.append(xxhash.xxh64_intdigest(word))
            if part[-1] % iblt.CUT_EVERY == 0 or i == len(words) - 1:
                total = sum(mixed(h + k * 0x9E3779B97F4A7C15 & mask) for k, h in enumerate(part)) & mask
                key = mixed(total + len(part) & mask)
                nth, part = seen[key], []
                seen[key] += 1
                out.add(mixed(key + nth * 0xD6E8FEB86659FD93 & mask) if nth else key)
    return out


def test_differences_come_out_of_the_strings():
    rng = random.Random(10)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = words(2000)
    pairs = [("", ""), ("a b", ""), (shared, shared), (shared, words(2000)), (shared + words(40), words(300) + shared), (words(30), words(4000)), ("x " * 5000, "x " * 4990), ("a\n" * 300, "a\n" * 10)]
    for x, y in pairs + [(t, u) for (_, t), (_, u) in zip(varied(40), varied(40, 9))]:
        left, right = iblt.difference(iblt.fingerprint(x), iblt.fingerprint(y))
        a, b = brute_digests(x), brute_digests(y)
        assert set(left.tolist()) == a - b and set(right.tolist()) == b - a
        assert iblt.likeness(iblt.fingerprint(x), iblt.fingerprint(y)) == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_sketches_that_do_not_peel_are_made_larger():
    keys = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    owner = np.zeros(len(keys), dtype=np.int64)
    assert not iblt.Cells.of(keys, owner, np.array([600])).peel()[3][0]
    found, _, sign, apart = iblt.Cells.of(keys, owner, np.array([1024])).peel()
    assert apart[0] and (sign == 1).all() and np.array_equal(np.sort(found), np.sort(keys))
    sizes = [2]
    while sizes[-1] < 100:
        sizes.append(int(iblt.larger(np.array([sizes[-1]]))[0]))
    assert sizes == [2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128] and set(iblt.least_third(np.arange(200)).tolist()) < set(sizes)


def test_versions(spark, edges, nothing):
    rows = [*varied(90), (2**40, "far away"), (-5, "negative")]
    iblt_rows = iblt.compare_versions(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    order = sorted(rows, reverse=True)
    texts = dict(rows)
    following = {a[0]: b for a, b in zip(order, order[1:] + order[:1])}
    by_text = collections.defaultdict(set)
    for r in iblt_rows:
        t, nxt = texts[r.doc_id], following[r.doc_id][1]
        new = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(t)
        own, other, after = (brute_digests(x) for x in (t, new, nxt))
        assert r.near_edited == pytest.approx(len(own & other) / len(own | other)) and r.near_next == pytest.approx(len(own & after) / len(own | after))
        assert r.near_edited == iblt.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == iblt.likeness(r.fingerprint, iblt.fingerprint(nxt))
        by_text[t].add(r.fingerprint)
    assert len(iblt_rows) == len(rows) and all(len(x) == 1 for x in by_text.values())
    got = iblt.compare_versions(edges).collect()
    assert len(got) == 16 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got) and iblt.compare_versions(nothing).count() == 0
    alone = iblt.compare_versions(spark.createDataFrame([(3, "only one document here")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    for n in (1, 2, 3):
        nameless = spark.createDataFrame([(None, f"a text without an id {i}") for i in range(n)], "doc_id long, text string")
        assert sorted(r.n_chars for r in iblt.compare_versions(nameless).collect()) == [22] * n


# -- SentencePiece -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return Codec(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(codec):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for t in odd_texts() + [t for _, t in varied(30)]:
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == model.encode(t) and codec.decode(ids) == model.decode(ids), t
        assert list(codec.stream([t[i : i + 5] for i in range(0, len(t), 5)])) == ids


def test_the_window_is_bounded(codec):
    viterbi = StreamingViterbi(codec.pieces)
    most, most_back = (viterbi.STEP + 2) * codec.pieces.longest, 0
    for part in ["▁the"] * 3000 + ["x" * 100_000, "▁" * 50_000, "ab" * 50_000, "é漢😀" * 20_000]:
        for _ in viterbi.feed(part):
            most_back = max(most_back, len(viterbi.back))
    assert most_back <= most


def test_one_line_of_megabytes_in_one_pass(codec):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(7)
    line = "".join(rng.choice(list("abcdefgh0123456789+/=éß漢"), 1_500_000))
    parts = [line[i : i + 9_973] for i in range(0, len(line), 9_973)]
    assert list(codec.stream(parts)) == np.frombuffer(codec.encode(line), "<u4").tolist() == model.encode(line)


def test_encode_and_decode(edges, nothing):
    coded = encode(edges)
    back = {r.doc_id: r.text for r in decode(coded).collect() if r.doc_id is not None}
    expected = {r.doc_id: r.text for r in edges.collect() if r.doc_id is not None}
    assert back == expected and encode(nothing).count() == 0


# -- secrets -------------------------------------------------------------------------------------------------------------------

HEX = "0123456789abcdef" * 3
SECRETS = [
    f'x token = "{HEX}" é', None, "", "clean", HEX, f"ä {HEX}\npassword: short, secret=abcdefgh12 {HEX[:31]}", "token: secret = abcdefghij", "API_KEY='AKIAABCDEFGHIJKL01'", "AKIA AKIAXY AKIA" + "Z" * 20, "passwd:=x Token=ÄÖ token=" + "a" * 8,
    "ghp_" + "a" * 40, "token=token=abcdefgh12", f"x token = \"{HEX}\" é",
]


def brute_secrets(t):
    t = t or ""
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark, edges, nothing):
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    base = find_secrets(df, rules=BASE).select("doc_id", joined(F.col("marks")).alias("x")).collect()
    assert {r.doc_id: r.x for r in base} == {i: brute_secrets(t) for i, t in enumerate(SECRETS)}
    every = {r.doc_id: r.x for r in find_secrets(df).select("doc_id", joined(F.col("marks")).alias("x")).collect()}
    assert "code_host:0:44" in every[10]
    masked = {r.doc_id: r.text for r in redact(df).collect()}
    assert masked[0] == 'x [REDACTED]" é' and masked[1] is None and masked[5] == f"ä [REDACTED]\npassword: short, [REDACTED] {HEX[:31]}" and masked[10] == "[REDACTED]"
    assert {r.doc_id: r.text for r in redact(redact(df)).collect()} == masked
    assert find_secrets(edges).count() == 16 and find_secrets(nothing).count() == 0 and redact(edges).columns == edges.columns and redact(nothing).count() == 0


def test_ledger_scans_unseen_pairs_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    made = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = lambda rows, rules=BASE: {r.doc_id: r.x for r in find_secrets(rows, path, rules).select("doc_id", joined(F.col("marks")).alias("x")).collect()}
    rows = lambda: ledger_at(spark, path).count()
    assert found(made("a token=abcdefgh1", "clean", "clean")) == {0: "assign:2:17", 1: "", 2: ""} and rows() == 2
    # the same texts again: no blob is scanned, and the findings come from the ledger
    assert found(made("clean", "a token=abcdefgh1", "a token=abcdefgh1")) == {0: "", 1: "assign:2:17", 2: "assign:2:17"} and rows() == 2
    assert found(made("a token=abcdefgh1", "new secret=abcdefgh2")) == {0: "assign:2:17", 1: "assign:4:20"} and rows() == 3
    # a new version of one rule: each blob is scanned under that one alone
    newer = (Rule("assign", BASE[0].pattern, 1, 9, version=2), *BASE[1:])
    assert found(made("a token=abcdefgh1", "clean", "token=12345678"), newer) == {0: "assign:2:17", 1: "", 2: ""}
    assert rows() == 6 and sorted(len(r.rules) for r in ledger_at(spark, path).collect()) == [1, 1, 3, 3, 3, 3]
    assert redact(made("a token=abcdefgh1"), path, newer).first().text == "a [REDACTED]" and rows() == 6


def test_redact_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh1", "x", 1, 2, 3)], "doc_id long, text string, `__cuts` string, cuts int, blob int, own int")
    assert [tuple(r) for r in redact(df).collect()] == [(1, "[REDACTED]", "x", 1, 2, 3)]


# -- toxicity ------------------------------------------------------------------------------------------------------------------


def test_clauses():
    lexicon, machine = Lexicon({"=idiot": 4.0, "moro": 3.0}), grammar()
    whole = lambda t: sum(clause_scores(t, lexicon, machine)[0])
    assert whole("a calm text. nothing here") == 0 and whole("idiot") == 4 and whole("moronic") == 3 and whole("moro") == 0
    assert whole("you idiot") > whole("idiot") > whole("he said idiot") > 0 and whole("not an idiot") < whole("idiot")
    assert whole("you. idiot") == whole("idiot") and whole("I will kill you") > whole("kill the lights") > 0
    assert len(clause_scores("idiot. idiot\nidiot", lexicon, machine)[0]) == 3


def test_logistic_fit():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 20)
    mean, scale, w = fit(x, np.array([0.0, 0, 1, 1] * 20))
    p = logistic((x - mean) / scale, w)
    assert p[0] < 0.1 < 0.9 < p[3]


def toxic_corpus():
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        text = prose(rng, 60)
        bad = i % 5 == 0
        if bad:
            words = text.split(" ")
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["wretch", "vermin"])
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark, edges, nothing):
    docs, labels = toxic_corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train(d, y)
    assert {"=wretch", "=vermin"} <= set(model.lexicon.weights)
    got = {r.doc_id: r.score for r in score(d, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and all((got[i] >= 0.5) == (i % 5 == 0) for i in held)
    clean = keep_clean(d, model)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs if i % 5}
    assert score(edges, model).count() == 16 and score(nothing, model).count() == 0 and keep_clean(edges, model).columns == edges.columns
    # held-out labels teach nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in score(d, train(d, flipped)).collect()} == got
    assert score(d, train(d, y.limit(0))).agg(F.max("score")).first()[0] < 1e-6


# -- URLs ----------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark, nothing):
    urls = {
        "http://a.example.com/en/1": ("com/en/", "block"), "http://EXAMPLE.com/en/7x?q": ("example.com/en/7", "allow"), "https://x.net/de/1": ("net/de/", "allow"), "https://example.net/de/8#f": ("example.net/de/8", "block"),
        "http://o.org/es/": ("org/es/", "block"), "http://o.org/es": (None, "allow"), "http://m.listed.example.org/fr/": (None, "allow"), None: (None, "allow"), "no scheme": (None, "allow"), "http://notexample.com/en/7": ("com/en/", "block"), "http://com": (None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in filter_urls(df).collect()}
    for i, (rule, verdict) in enumerate(urls.values()):
        assert (got[i].rule, got[i].verdict) == (rule, verdict), list(urls)[i]
    assert got[1].host == "example.com" and got[1].path == "/en/7x" and got[7].host == got[7].path == "" and filter_urls(df.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    page = lambda i, host, *to: (i, f"http://{host}/x", "".join(f'<a href="https://{t}/">' for t in to) + '<a href="/local">')
    rows = [page(1, "farm.example.org", "bad.example.org"), page(2, "good.example.org", "farm.example.org", "news.example.org"), page(3, "bad.example.org"), page(4, "news.example.org")]
    rows += [page(5, "half.example.org", "bad.example.org", "farm.example.org", "news.example.org"), page(6, "fan.example.org", "news.example.org")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    listed = spark.createDataFrame([("BAD.example.org",)], "host string")
    got = {r.page_id: r for r in filter_urls(df, blocked_hosts=listed).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["block", "allow", "block", "allow", "block", "allow"]
    assert all(r.verdict == "allow" and r.distrust == 0 for r in filter_urls(df).collect())
    trusted = {r.page_id: r for r in filter_urls(df, blocked_hosts=listed, trusted_hosts=spark.createDataFrame([("good.example.org",)], "host string")).collect()}
    assert trusted[2].verdict == "allow" and trusted[4].trust > 0


def test_rules_seed_the_graph_by_the_share_of_pages(spark):
    """Of ads.com all pages are blocked, and who links to it alone goes; of mixed.com one in four, which is not enough."""
    rows = [(i, "http://ads.com/en/", None) for i in range(4)] + [(10 + i, "http://mixed.com/" + ("en/" if i == 0 else "fr/"), None) for i in range(4)]
    rows += [(20, "http://a.org/", '<img src="//ads.com/x.png">'), (21, "http://b.org/", "<a href='http://mixed.com/'>"), (21, "http://b.org/", "<a href='http://mixed.com/'>"), (22, "http://c.org/", '<meta http-equiv=refresh content="0; url=https://ads.com/">')]
    rows += [(30, "http://" + "long." * 2000 + "org/" + "x" * 100_000, "<p>" * 300_000), (31, "", ""), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, host string, distrust int, `by` string")
    got = [(r.page_id, r.verdict) for r in filter_urls(df).collect()]
    assert sorted(got, key=str) == sorted([(i, "block") for i in range(4)] + [(10, "block"), (11, "allow"), (12, "allow"), (13, "allow"), (20, "block"), (21, "allow"), (21, "allow"), (22, "block"), (30, "allow"), (31, "allow"), (None, "allow")], key=str)


def test_propagation_goes_to_the_end_of_a_chain(spark):
    arcs = spark.createDataFrame([(f"h{i:02d}", f"h{i + 1:02d}") for i in range(60)], "src string, dst string")
    seed = spark.createDataFrame([("h00", 0, 1.0)], "host string, kind int, weight double")
    got = {r.host: r.trust for r in propagate(arcs, seed).collect()}
    assert len(got) == 61 and got["h60"] == pytest.approx(0.15 * 0.85**60)
    with pytest.raises(RuntimeError):
        propagate(arcs, seed, rounds=5)


def test_propagation_against_power_iteration(spark):
    rng = random.Random(12)
    arcs = sorted({(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(30)})
    arcs = [(a, b) for a, b in arcs if a != b]
    seeds = [("h1", 0, 1.0), ("h2", 1, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in propagate(spark.createDataFrame(arcs, "src string, dst string"), spark.createDataFrame(seeds, "host string, kind int, weight double"), tolerance=1e-9).collect()}
    for kind, ways in ((0, arcs), (1, [(b, a) for a, b in arcs])):
        out = collections.Counter(a for a, _ in ways)
        now = start = {h: 0.15 * w for h, k, w in seeds if k == kind}
        for _ in range(100):
            new = collections.defaultdict(float, start)
            for a, b in ways:
                new[b] += 0.85 * now.get(a, 0) / out[a]
            now = new
        for h, v in now.items():
            assert got[h][kind] == pytest.approx(v, abs=1e-6)
