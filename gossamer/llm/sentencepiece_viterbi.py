"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice over a text's characters has an arc for every piece of the vocabulary. Its model is byte-pair
merging, so an arc may follow another only where merging the two pieces' text gives back the same two pieces; under that
rule exactly one path reaches each boundary, and it is the merging's own result. The pass keeps back
pointers for a few windows of the longest piece, and commits ids where the paths to all open boundaries share one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import insort
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gossamer.llm.common import id_text, record_batch, slices, table

SPACE = "▁"
#: Words whose ids a worker remembers.
REMEMBERED = 300_000


class Pieces:
    """The vocabulary of a SentencePiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(self.size)]
        self.control = [model.is_control(i) or model.is_unknown(i) for i in range(self.size)]
        self.byte = [int(self.names[i][3:5], 16) if model.is_byte(i) else -1 for i in range(self.size)]
        plain = [i for i in range(self.size) if not self.control[i] and self.byte[i] < 0 and not model.is_unused(i)]
        self.ids = {self.names[i]: i for i in plain}
        self.rank = {self.names[i]: -model.get_score(i) for i in plain}
        self.bytes_of = [b"" if c else bytes([b]) if b >= 0 else n.replace(SPACE, " ").encode() for n, b, c in zip(self.names, self.byte, self.control)]
        self.bytes_ids = {b: i for i, b in enumerate(self.byte) if b >= 0}
        self.longest = max(map(len, self.ids))
        #: A blank behind another character begins a piece always, as does a character of no longer piece.
        self.words_stand_alone = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        #: Pieces that merging can make at all, the automaton that finds them in a text, and which piece may follow which.
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.lengths = [len(n) for n in self.names]
        #: Stands before the first piece.
        self.start = -1
        self.follows = _Follows(self)
        self.packed = _Packed(self)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging its best pair, the leftmost of equals, again and again."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def ids_of(self, piece: int) -> list[int]:
        """The id of a piece; the ids of the bytes of a character that is none."""
        return [piece] if piece >= 0 else [self.bytes_ids[b] for b in chr(-1 - piece).encode("utf-8", "replace")]


class _Follows(dict):
    """Whether merging the text of two pieces (left * size + right) gives the two back; remembered."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, pair: int) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        left, right = (self.pieces.names[i] for i in divmod(pair, self.pieces.size))
        self[pair] = out = self.pieces.merged(left + right) == [left, right]
        return out


class _Packed(dict):
    """The ids of a piece, or of a character that is none, as little-endian bytes; remembered."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, piece: int) -> bytes:
        self[piece] = out = np.array(self.pieces.ids_of(piece), dtype="<u4").tobytes()
        return out


class StreamingViterbi:
    """Feeds on text piecemeal and gives pieces as they become certain, as ids, or as ``-1 - code point`` for a character that is no piece.

    The lattice's arcs come from one automaton over all pieces. What is kept is a back pointer (the piece that ends there) for each boundary
    since the last one that all paths share, ``STEP + 1`` windows or little more, and a window of text to find pieces across parts.
    """

    #: Windows of text after which the surviving paths are followed back to the boundary they share.
    STEP = 4

    def __init__(self, pieces: Pieces):
        self.pieces, self.longest = pieces, pieces.longest
        self.tail = ""
        self.back: list[int] = [pieces.start]  # the first is of the boundary that is committed

    def feed(self, text: str) -> Iterator[list[int]]:
        """Pieces that have become certain, some at a time."""
        back, follows, size, most = self.back, self.pieces.follows, self.pieces.size, (self.STEP + 1) * self.longest
        text, n = self.tail + text, len(back)
        shift = len(self.tail) - n  # of a boundary's number to the place of the character behind it, less one
        for last, (length, piece) in self.pieces.automaton.iter(text):
            end = last - shift
            if end < n:
                continue  # one path reaches each boundary, and it is found
            if end > n:
                back.extend(-1 - ord(c) for c in text[n + shift : last])
                n = end
            # a piece behind another one stands only where merging the two leaves both; beside a character that is no piece it always does
            left = back[end - length]
            if left < 0 or follows[left * size + piece]:
                back.append(piece)
                n += 1
                if n > most:
                    at = self._shared()
                    yield self._commit(at)
                    shift, n = shift + at, n - at
        for at in range(n + shift, len(text), most):
            back.extend(-1 - ord(c) for c in text[at : at + most])
            yield self._commit(self._shared())
        self.tail = text[1 - self.longest :]

    def _shared(self) -> int:
        """The last boundary on the paths to all boundaries that a further piece can begin at."""
        back, lengths = self.back, self.pieces.lengths
        open_ = list(range(max(0, len(back) - self.longest), len(back)))
        while len(open_) > 1:
            last = open_.pop()
            before = last - (1 if back[last] < 0 else lengths[back[last]])
            if before < open_[0]:
                open_.insert(0, before)
            elif before not in open_:
                insort(open_, before)
        return open_[0]

    def _commit(self, at: int) -> list[int]:
        out, place, back, lengths = [], at, self.back, self.pieces.lengths
        while place > 0:
            piece = back[place]
            out.append(piece)
            place -= 1 if piece < 0 else lengths[piece]
        if at:
            # what stays before the boundary is its last piece, as the next one must follow it
            del back[:at]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._commit(len(self.back) - 1)


class Codec:
    """Ids of whole texts and texts of ids, as the model's own encoder and decoder give them."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known: dict[str, bytes] = {}  # in two generations
        self.before: dict[str, bytes] = {}

    def _pass(self, parts: Iterable[str]) -> Iterator[list[int]]:
        viterbi = StreamingViterbi(self.pieces)
        for part in parts:
            yield from viterbi.feed(part)
        yield viterbi.finish()

    def stream(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in parts, however long it is."""

        def marked() -> Iterator[str]:
            first = True
            for part in parts:
                if part:
                    yield (" " + part if first else part).replace(" ", SPACE)
                    first = False

        for found in self._pass(marked()):
            for piece in found:
                yield from self.pieces.ids_of(piece)

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words, by one pass over them all. Line ends, which are in no piece, keep them apart."""
        ids, own, at, end = self.pieces.packed, [], 0, -1 - ord("\n")
        for found in self._pass(["\n".join(words)]):
            for piece in found:
                if piece == end:
                    self.known[words[at]] = b"".join(own)
                    own, at = [], at + 1
                else:
                    own.append(ids[piece])
        self.known[words[at]] = b"".join(own)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. All paths meet where a word begins and around line ends, so words are remembered."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if not self.pieces.words_stand_alone:
            return b"".join(self.pieces.packed[piece] for found in self._pass([text]) for piece in found)
        words = _WORDS.findall(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                self.before, self.known = known, {}
                known = self.known
            known["\n"] = self.pieces.packed[-1 - ord("\n")]
            unseen = []
            for word in dict.fromkeys(words):
                if word not in known:
                    if (held := self.before.get(word)) is not None:
                        known[word] = held
                    else:
                        unseen.append(word)
            if unseen:
                self._learn(unseen)
            return b"".join(map(known.__getitem__, words))

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.pieces.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


#: A run of blanks with the word behind it, or one line end. Line ends are in no piece, so no path crosses them.
_WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

_CODECS: dict[str, Codec] = {}


def piece_bpe(path: str | None = None) -> Callable[[], Codec]:
    """Gives a worker's codec; the model file is found there by name if no path is given."""

    def make() -> Codec:
        place = path
        if place is None:
            import public_tokenizers

            place = public_tokenizers.path("piece_bpe_32k.model")
        if place not in _CODECS:
            _CODECS[place] = Codec(place)
        return _CODECS[place]

    return make


def encode(docs: DataFrame, make: Callable[[], Codec] | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs, ids as little-endian unsigned 32-bit binary.

    A null text gives null, an empty one no ids; repeated rows get equal results; an empty table gives no rows.
    """
    make = make or piece_bpe()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for ids, texts in slices(batches):
            yield record_batch(schema, [ids, [None if t is None else codec.encode(t) for t in texts]])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, make: Callable[[], Codec] | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null."""
    make = make or piece_bpe()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for ids, coded in slices(batches):
            yield record_batch(schema, [ids, [None if c is None else codec.decode(np.frombuffer(c, dtype="<u4").tolist()) for c in coded]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256): the ids of every text, and the text that they decode to. Null texts count as empty."""
    make = piece_bpe()
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for ids, texts in slices(batches):
            coded = [codec.encode(t or "") for t in texts]
            decoded = [codec.decode(np.frombuffer(c, dtype="<u4").tolist()) for c in coded]
            yield record_batch(
                schema, [ids, [len(c) // 4 for c in coded], [zlib.crc32(c) for c in coded], [hashlib.sha256(t.encode()).hexdigest() for t in decoded]]
            )

    return id_text(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
