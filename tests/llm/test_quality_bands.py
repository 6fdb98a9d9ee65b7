"""Junk at every band of op6 and in single chunks."""

import random
import string

import pytest
import zstandard

from gossamer.llm.quality import Bands, ratios, verdict

PRINTABLE = string.ascii_letters + string.digits + "+/"


def junk(rng, n, alphabet=PRINTABLE):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(3, 10))) for _ in range(n // 3)).encode()[:n]


def judged(data, bands=Bands()):
    return verdict(len(data), *ratios(data, bands, zstandard.ZstdCompressor(level=bands.level)), bands)


@pytest.mark.parametrize("n", [200, 300, 500, 900, 1_000, 1_500, 2_000, 3_000, 3_900, 4_096, 6_000, 9_000, 20_000])
def test_random_words_of_every_length_are_incompressible(n):
    rng = random.Random(n)
    assert all(judged(junk(rng, n)) == "incompressible" for _ in range(20))
    if n >= 1_500:
        assert all(judged(junk(rng, n, string.ascii_lowercase)) == "incompressible" for _ in range(20))


def test_a_chunk_of_random_words_is_incompressible():
    bands = Bands()
    chunk = ratios(junk(random.Random(1), bands.chunk_bytes), bands, zstandard.ZstdCompressor(level=bands.level))[0]
    assert verdict(20_000, 2.5, [2.2, chunk, chunk], bands) == "incompressible" and verdict(20_000, 2.5, [2.2] * 3, bands) == "fine"


def test_chunks_reach_the_end_of_the_text():
    bands, compressor = Bands(), zstandard.ZstdCompressor(level=3)
    for n, chunks in ((0, 0), (4_096, 0), (4_097, 2), (8_191, 2), (8_192, 2), (12_272, 3)):
        assert len(ratios(b"x" * n, bands, compressor)[1]) == chunks
    rng = random.Random(2)
    words = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(2_000)).encode()
    for good, bad in ((4_096, 4_000), (8_192, 4_080)):
        assert judged(text[: good + bad]) == "fine" and judged(text[:good] + junk(rng, bad)) == "incompressible"
