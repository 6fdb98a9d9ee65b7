"""Toxicity by a weighted finite-state pattern grammar.

A lexicon gives each token a symbol (insult, threat, target, negation, report) and a weight. Three transducers read a
clause's symbols in turn, composed into one machine: negation rewrites what it reaches, reported speech what follows it, and
the pattern transducer gives every symbol a factor and a bonus that depend on what the clause has held so far. A clause
scores the sum along its path; a text's clause scores enter a logistic model. The insults of the lexicon, whole words and
stems, and the model are learned from labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.common import id_text, record_batch, slices, table

NEUTRAL, INSULT, THREAT, TARGET, NEGATION, REPORT = "-ITYNR"

# Words that take a symbol whatever is learned.
FIXED = {
    TARGET: "you your yours yourself u ur du dich dir dein euch vous toi ton votre tú usted ustedes vosotros",
    NEGATION: "not no never isn't aren't don't doesn't wasn't nicht kein keine nie pas jamais aucun nunca ningún",
    REPORT: "said says say claimed wrote quoted quote called reported sagte schrieb dit disait écrit dijo escribió",
    THREAT: "kill hurt destroy beat shoot stab burn töten verletzen umbringen tuer frapper matar golpear",
}
THREAT_WEIGHT = 3.0
EDGES = ".,;:!?\"'()[]{}|*#$%&<>-_+=~`^/\\"
CLAUSE_ENDS = ".!?;:"

#: Labelled rows the model is fitted on at most, those with the smallest hash of the id.
TRAIN_ROWS = 20_000
#: Tokens behind a negation that it reaches.
REACH = 3
#: Toxic training texts that an entry occurs in at least, and the least log-odds it needs.
LEAST_TEXTS, LEAST_WEIGHT = 5, 2.5
STEMS = range(4, 9)


class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives (state, symbol out, factor, bonus)."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step
        self.known: dict = {}

    def move(self, state, symbol: str):
        key = state, symbol
        if key not in self.known:
            self.known[key] = self.step(state, symbol)
        return self.known[key]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives what ``second`` makes of what ``first`` writes; factors multiply and bonuses add."""

    def step(state, symbol):
        a, between, factor_a, bonus_a = first.move(state[0], symbol)
        b, out, factor_b, bonus_b = second.move(state[1], between)
        return (a, b), out, factor_a * factor_b, bonus_a + bonus_b

    return Transducer((first.start, second.start), step)


def negation(reach: int = REACH) -> Transducer:
    """Insults and threats up to ``reach`` tokens behind a negation lose most of their weight."""

    def step(left, symbol):
        if symbol == NEGATION:
            return reach, symbol, 1.0, 0.0
        hit = left > 0 and symbol in (INSULT, THREAT)
        return max(left - 1, 0), symbol, 0.3 if hit else 1.0, 0.0

    return Transducer(0, step)


def reported() -> Transducer:
    """Insults and threats behind a verb of saying count half, as someone else's."""

    def step(told, symbol):
        return told or symbol == REPORT, symbol, 0.5 if told and symbol in (INSULT, THREAT) else 1.0, 0.0

    return Transducer(False, step)


def patterns() -> Transducer:
    """Insults count by themselves and more against a target; threats need one. State: (target seen, insult or threat seen)."""

    def step(seen, symbol):
        target, hit = seen
        if symbol == INSULT:
            return (target, True), symbol, 1.25 if target else 1.0, 0.0
        if symbol == THREAT:
            return (target, True), symbol, 1.25 if target else 0.2, 0.0
        if symbol == TARGET:
            return (True, hit), symbol, 0.0, 1.0 if hit and not target else 0.0
        return seen, symbol, 0.0, 0.0

    return Transducer((False, False), step)


def grammar() -> Transducer:
    return compose(compose(negation(), reported()), patterns())


@dataclass
class Lexicon:
    """Weights of learned entries: ``=word`` for a whole word, else a stem that a longer word begins with."""

    weights: dict[str, float] = field(default_factory=dict)
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "known": {}}

    def look(self, token: str) -> tuple[str, float, bool] | None:
        """(symbol, weight, ends a clause) of a token with its punctuation; None for neutral ones inside a clause."""
        if token in self.known:
            return self.known[token]
        if len(self.known) > 200_000:
            self.known.clear()
        word = token.strip(EDGES)
        symbol, weight = FIXED_SYMBOLS.get(word, NEUTRAL), 0.0
        if symbol == NEUTRAL and word:
            weight = max([self.weights.get("=" + word, 0.0), *(self.weights.get(word[:n], 0.0) for n in STEMS if n < len(word))])
            symbol = INSULT if weight > 0 else NEUTRAL
        elif symbol == THREAT:
            weight = max(THREAT_WEIGHT, self.weights.get("=" + word, 0.0))
        ends = token[-1:] in CLAUSE_ENDS
        self.known[token] = out = None if symbol == NEUTRAL and not ends else (symbol, weight, ends)
        return out


FIXED_SYMBOLS = {word: symbol for symbol, words in FIXED.items() for word in words.split()}


def clause_scores(text: str, lexicon: Lexicon, machine: Transducer) -> tuple[list[float], int]:
    """The scores of the clauses that hold an insult or a threat, and the number of tokens. A line's end ends a clause."""
    scores, tokens = [], 0
    look, known = lexicon.look, lexicon.known
    for line in text.lower().split("\n"):
        words = line.split()
        tokens += len(words)
        state, score, hit, at = machine.start, 0.0, False, -1
        for i, word in enumerate(words):
            found = known[word] if word in known else look(word)
            if found is None:
                continue
            symbol, weight, ends = found
            for _ in range(min(i - at - 1, REACH + 1)):  # neutral tokens in between; further ones change no state
                state = machine.move(state, NEUTRAL)[0]
            state, _, factor, bonus = machine.move(state, symbol)
            score += factor * weight + bonus
            hit |= symbol in (INSULT, THREAT)
            at = i
            if ends:
                if hit:
                    scores.append(score)
                state, score, hit = machine.start, 0.0, False
        if hit:
            scores.append(score)
    return scores, tokens


def features(text: str, lexicon: Lexicon, machine: Transducer) -> tuple[float, ...]:
    scores, tokens = clause_scores(text, lexicon, machine)
    total, tokens = sum(scores), max(tokens, 1)
    return math.log1p(total), math.log1p(total / math.sqrt(tokens)), math.log1p(100 * total / tokens), max(scores, default=0.0)


@dataclass
class Model:
    """score = logistic(weights · (standardised features, 1))."""

    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        machine = grammar()
        x = np.array([features(t or "", self.lexicon, machine) for t in texts], dtype=float).reshape(-1, len(self.mean))
        return logistic((x - self.mean) / self.scale, self.weights)


def logistic(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z @ weights[:-1] + weights[-1], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge logistic model by Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weights = np.zeros(z.shape[1])
    for _ in range(steps):
        p = logistic(z[:, :-1], weights)
        move = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(weights)), z.T @ (y - p) - ridge * weights)
        weights += move
        if np.abs(move).max() < 1e-6:
            break
    return mean, scale, weights


def _entries(text: str) -> Counter:
    """Uses of each word and stem in a text."""
    out: Counter = Counter()
    for token, n in Counter(text.lower().split()).items():
        word = token.strip(EDGES)
        if word:
            out["=" + word] += n
            for k in STEMS:
                if k < len(word):
                    out[word[:k]] += n
    return out


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, text) of labelled documents outside the held-out fold, ``rows`` at most; of rows that share an id one text counts."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labelled = labelled.where("toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sample = labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # the sample's size is fixed


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Entries much more frequent in toxic texts, weighted by log-odds. Counts are made and filtered in Spark.

    Entries come from the bounded training sample, each from LEAST_TEXTS toxic texts of it or more, and none is left out.
    """
    names = ["texts_1", "texts_0", "uses_1", "uses_0"]
    schema = pa.schema([("entry", pa.string())] + [(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, ...] = tuple(Counter() for _ in names)

        def flush() -> pa.RecordBatch:
            entries = list(set().union(*counts))
            out = record_batch(schema, [entries, *([c[e] for e in entries] for c in counts)])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own, clean = _entries(text or ""), 0 if toxic == 1 else 1
                    own[""] = sum(own.values())  # of all entries; no entry is empty
                    counts[clean].update(own.keys())
                    counts[2 + clean].update(own)
                if max(map(len, counts)) > 200_000:
                    yield flush()
        yield flush()

    summed = train.select("text", "toxic").mapInArrow(run, "entry string, " + ", ".join(f"{n} long" for n in names)).groupBy("entry").agg(*[F.sum(n).alias(n) for n in names])
    all_ = F.col("entry") == ""
    totals = summed.where(all_).first()
    if totals is None or not totals["texts_1"]:
        return Lexicon()
    odds = lambda a, b, m: F.log((F.col(a) + 0.1) / totals[a]) - F.log((F.col(b) + 1) / max(totals[b], 1)) + m
    weighed = summed.where(~all_ & (F.col("texts_1") >= LEAST_TEXTS)).select("entry", odds("uses_1", "uses_0", 0).alias("w"), odds("texts_1", "texts_0", 2).alias("v"))
    kept = weighed.where((F.col("w") > LEAST_WEIGHT) & (F.col("v") > LEAST_WEIGHT))
    return Lexicon({r["entry"]: r["w"] for r in kept.collect()})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model fitted on at most ``rows`` labelled texts; without texts of both classes it scores every text 0.

    Equal sets of rows give equal models. Labels that are null, or of no document, teach nothing.
    """
    chosen = training_rows(docs, labels, rows)
    lexicon = learn_lexicon(chosen)
    width = len(features("", lexicon, grammar()))
    schema = pa.schema([("toxic", pa.int64())] + [(f"x{i}", pa.float64()) for i in range(width)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for toxic, texts in slices(batches):
            rows = [features(t or "", lexicon, machine) for t in texts]
            yield record_batch(schema, [toxic.cast(pa.int64()), *([list(c) for c in zip(*rows)] if rows else [[]] * width)])

    found = chosen.select("toxic", "text").mapInArrow(run, "toxic long, " + ", ".join(f"x{i} double" for i in range(width))).toPandas()  # ``rows`` at most
    y = (found["toxic"] == 1).to_numpy(dtype=float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, np.zeros(width), np.ones(width), np.array([0.0] * width + [-30.0]))
    order = np.lexsort(found.to_numpy(dtype=float).T)
    return Model(lexicon, *fit(found.to_numpy(dtype=float)[order, 1:], y[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs; a null text counts as empty, and an empty table gives no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield record_batch(schema, [ids, model.scores(texts)])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array(model.scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, labels learned outside the held-out fold. Null texts count as empty and a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
