"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers run over the words of a clause, one after another:

* terms rewrites a word to a symbol: an insult or threat (from the learned lexicon or the seed lists, with its log-odds), a
  target (you, they, names of groups ...), a negation, a reporting verb, a quotation mark, or nothing;
* scope carries a state from symbol to symbol (how many words a negation still reaches, whether speech is reported, how far
  the last target is) and rewrites each insult or threat to one of sixteen readings:
  kind x aimed at a target x negated x reported;
* score weighs each reading; a document's readings are summed up by a logistic function.

The lexicon is learned: words and word stems that labelled toxic texts have far more often than others. The weights of
the readings are learned too, so whether a negated or reported insult counts is what the labels say.

Cases: null and empty texts have no reading and score the bias alone (the base rate, below one half); no labels of one of the
kinds: the lexicon is empty and every score is the base rate; copies of a text count once in training; equal rows
each get a row; an empty table gives an empty result; other columns stay, clashing ones (``score``, ``predicted``,
``clauses``) as ``<name>_in``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sigspark.llm.common import set_aside
from sigspark.plans.slices import top_per

OWN = ["score", "clauses", "predicted"]
THRESHOLD = 0.7
# Bounds of training: labelled texts of each kind (chosen by a hash of the id), entries of the lexicon.
SAMPLE_TEXTS, LEXICON_SIZE = 12_000, 5_000
# A lexicon entry is in so many toxic texts at least, and at this share of toxic ones after three made-up clean texts.
MIN_TEXTS, MIN_SHARE = 5, 0.6
STEM_LENGTHS = (4, 5, 6)
REACH = 4  # words that a negation covers, and that may lie between an insult and its target

# Fixed seed lists in the four languages of the corpus.
TARGETS = frozenset("you your yours u he him his she her they them their this that people guy woman man du dich dir ihr euch dein er sie tu te toi vous ton ta il elle ils usted ustedes vosotros tú ti él ella ellos".split())
NEGATIONS = frozenset("not no never none nor without isn't aren't wasn't don't nicht kein keine nie niemals ne jamais aucun sin nunca ningún ninguna".split())
REPORTS = frozenset("said says say called calls wrote claimed reported quoted according sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
THREATS = frozenset("kill hurt destroy beat stab shoot burn töten vernichten schlagen verletzen tuer détruire frapper brûler matar destruir golpear quemar".split())

WORDS = regex.compile(r"[\p{L}\p{M}\p{N}'’]+|[.!?;\n]|[\"“”„«»]")
ENDS, QUOTES = frozenset(".!?;\n"), frozenset("\"“”„«»")
READINGS = 16


@dataclass(frozen=True)
class Grammar:
    """Lexicon (whole words and stems marked by a final ``*``, with log-odds), weights of the readings, bias."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0,) * READINGS
    bias: float = 0.0

    def term(self, word: str) -> float:
        """The strongest log-odds of the word or one of its stems; 0 if it has none."""
        best = self.lexicon.get(word, 0.0)
        for n in STEM_LENGTHS:
            if len(word) > n:
                best = max(best, self.lexicon.get(word[:n] + "*", 0.0))
        return best


class Reader:
    """The composed transducers for one grammar; words are classified once and remembered."""

    REMEMBERED = 200_000

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.known: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        if word in ENDS:
            return "end", 0.0
        if word in QUOTES:
            return "quote", 0.0
        weight = self.grammar.term(word)
        if word in THREATS:
            return "threat", max(weight, 1.0)
        if weight > 0:
            return "insult", weight
        for name, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)):
            if word in words:
                return name, 0.0
        return "", 0.0

    def classes(self, words: list[str]) -> list[tuple[str, float]]:
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = self.symbol(w)
        return [known[w] for w in words]

    def readings(self, text: str | None) -> tuple[np.ndarray, int]:
        """Strongest log-odds of each reading in the text, and the number of clauses with one."""
        out = np.zeros(READINGS)
        words = WORDS.findall((text or "").lower())
        symbols = self.classes(words)
        matched, clause = 0, False
        if not any(s[0] in ("insult", "threat") for s in set(symbols)):
            return out, 0
        negated = reported = 0
        quoted, targets = False, []
        held: list[tuple[int, str, float, bool, bool]] = []
        for i, (name, weight) in enumerate([*symbols, ("end", 0.0)]):
            if name == "end":
                for at, kind, value, negative, report in held:
                    aimed = any(abs(t - at) <= REACH for t in targets)
                    reading = (kind == "threat") * 8 + aimed * 4 + negative * 2 + report
                    out[reading] = max(out[reading], value)
                matched += clause
                clause, negated, reported, targets, held = False, 0, 0, [], []
            elif name == "quote":
                quoted = not quoted
            elif name == "target":
                targets.append(i)
            elif name == "negation":
                negated = REACH + 1
            elif name == "report":
                reported = 1
            elif name:
                held.append((i, name, weight, negated > 0, bool(reported) or quoted))
                clause = True
            negated = max(0, negated - 1)
        return out, matched

    def score(self, readings: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.grammar.bias + readings @ np.array(self.grammar.weights), -40, 40))))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, toxic: the different words and stems of each text."""
    for batch in batches:
        terms: list[str] = []
        toxic: list[int] = []
        for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = {w for w in WORDS.findall((text or "").lower()) if len(w) > 1 and w not in ENDS}
            some = words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}
            terms += some
            toxic += [label] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int32())], ["term", "toxic"])


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and stems with the log-odds of toxic texts; at most LEXICON_SIZE. A word under a listed stem adds nothing."""
    counts = sample.mapInArrow(_terms, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    share = F.col("pos") / (F.col("n") + 3)
    good = counts.where((F.col("pos") >= MIN_TEXTS) & (share >= MIN_SHARE)).withColumn("odds", F.log((F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5)))
    rows = good.orderBy(F.col("odds").desc(), "term").limit(LEXICON_SIZE).collect()
    found = {r["term"]: float(r["odds"]) for r in rows}
    return {t: o for t, o in found.items() if not any(t != t[:n] + "*" and found.get(t[:n] + "*", -1.0) >= o for n in STEM_LENGTHS if len(t.rstrip("*")) > n)}


def fit(readings: np.ndarray, labels: np.ndarray, l2: float = 1.0, steps: int = 30) -> tuple[tuple[float, ...], float]:
    """Weights and bias of a logistic model by Newton steps."""
    x = np.hstack([readings, np.ones((len(readings), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, x.T @ (p - labels) + ridge * w)
    return tuple(w[:-1].tolist()), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_texts: int = SAMPLE_TEXTS) -> Grammar:
    """Learn from at most ``sample_texts`` labelled texts of each kind; what reaches the driver is bounded by that."""
    marked = labels.where(F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).cast("int").alias("toxic"))
    picked = top_per(marked.withColumn("h", F.xxhash64(F.lit(3), "_id")), ["toxic"], [F.col("h"), F.col("_id")], sample_texts).select("_id", "toxic")
    # at most 2 * sample_texts rows
    rows = docs.join(F.broadcast(picked), docs[doc_id] == picked["_id"]).select(F.col(text).alias("text"), "toxic").where("text IS NOT NULL")
    sample = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    lexicon = learn_lexicon(sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Grammar(lexicon))
        for batch in batches:
            got = [reader.readings(t)[0].tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = sample.mapInArrow(read, "x array<double>, toxic int").collect()
    if not got:
        return Grammar(bias=-2.0)
    y = np.array([r["toxic"] for r in got], float)
    weights, bias = fit(np.array([r["x"] for r in got]), y)
    return Grammar(lexicon, weights, min(bias, -1.0))


def judge(docs: DataFrame, grammar: Grammar, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, clauses (number of matched ones) and predicted (1 from ``threshold``)."""
    kept = set_aside(docs, OWN)
    sent = docs.sparkSession.sparkContext.broadcast(grammar)  # LEXICON_SIZE entries
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("clauses", IntegerType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            got = [reader.readings(t) for t in batch.column(at).to_pylist()]
            scores = [reader.score(x) for x, _ in got]
            own = [pa.array(scores, pa.float64()), pa.array([n for _, n in got], pa.int32()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *OWN])

    return kept.mapInArrow(run, schema)
