"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps a word to a symbol (insult, threat, target, negation, report or other) and a weight;
punctuation and line ends are boundaries. Four small transducers read the symbols: negation opens a scope of a
few words, a verb of saying opens one up to the end of the sentence, a target (``you``, a name for a person or
group) one of a few words, and the matcher emits insults and threats. Their composition is one table
(state, symbol) -> (state, channel); a channel says what was matched under which scopes. A document is scored by
the clauses that match, per channel, through a logistic function.

The closed classes are fixed word lists. Insult and threat entries come from a short seed list and from labelled
texts: words and stems (prefixes) are weighed by the lower confidence bound of their log odds, and chosen by
sequential covering, so that the words of one much-copied toxic text do not become entries. Labelled texts are
sampled, at most ``sample_rows`` distinct ones a class; everything else reads all rows. The weights minimise a strictly
convex loss by Newton steps that are halved until the loss falls, and are not below zero; a text without any match is
never marked as toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import batches, prepare
from cartlens.staging import stage

#: Distinct labelled texts a class that the model is fitted on.
SAMPLE_ROWS = 6000
#: Pull of a weight towards its prior, in units of the loss.
RIDGE = 1.0
#: What a text without a match scores at most: no clause, no verdict.
MOST_WITHOUT_MATCH = 0.45
STEM_LENGTHS = range(4, 10)

# Closed classes and seed entries (fixed values).
TARGETS = "you your yours yourself he she they them his her their this these those people everyone du dich dein ihr euch tu toi vous te tes usted ustedes él ella ellos".split()
NEGATIONS = "not no never neither nor without hardly nicht nie kein keine keinen ne pas jamais sans nunca jamás sin tampoco".split()
REPORTS = "said says say told tells wrote writes claimed claims called quoted quotes according reported allegedly sagte schrieb laut dit écrit selon dijo escribió según".split()
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb jerk vermin".split()
THREATS = "kill murder hurt destroy beat stab shoot burn hang strangle".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COMMA, STOP = range(8)
SEED_WEIGHT, THREAT_WEIGHT = 2.0, 0.7
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:,\n]")
_BOUNDARY = {",": COMMA, ";": COMMA, ":": COMMA, ".": STOP, "!": STOP, "?": STOP, "\n": STOP}


# --- transducers: (state, symbol) -> (next state, output); a state that is not listed goes to 0 --------------


def scope(opener: int, words: int | None, closers: Sequence[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Outputs 1 while a scope is open: for ``words`` further words, or up to a closer if that is None."""
    last = 1 if words is None else words
    table = {}
    for state, symbol in product(range(last + 1), range(8)):
        after = state if words is None or symbol in _BOUNDARY.values() else max(0, state - 1)
        if symbol in closers:
            after = 0
        if symbol == opener:
            after = last
        table[state, symbol] = (after, int(state > 0))
    return table


def compose(machines: Sequence[dict]) -> list[list[tuple[int, int]]]:
    """The product automaton: rows are states, columns symbols, cells (next state, outputs as bits)."""
    start = (0,) * len(machines)
    number, rows, queue = {start: 0}, [], [start]
    for states in queue:
        row = []
        for symbol in range(8):
            steps = [m[s, symbol] for m, s in zip(machines, states, strict=True)]
            after = tuple(a for a, _ in steps)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row.append((number[after], sum(out << i for i, (_, out) in enumerate(steps))))
        rows.append(row)
    return rows


#: Bits of a channel: target near, negated, reported.
GRAMMAR = compose(
    [scope(TARGET, 4, (STOP,)), scope(NEGATION, 3, (COMMA, STOP)), scope(REPORT, None, (STOP,))]
)
# Channels: insult (0-7) and threat (8-15) by scope bits; then the strongest clause and the matches a word.
N_FEATURES = 18


@dataclass
class Lexicon:
    """Exact words and stems with their symbol and weight; the longest stem of a word counts."""

    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    stems: dict[str, tuple[int, float]] = field(default_factory=dict)

    def look_up(self, word: str) -> tuple[int, float]:
        entry = self.words.get(word)
        if entry:
            return entry
        for end in range(len(word), 0, -1):
            entry = self.stems.get(word[:end])
            if entry:
                return entry
        return OTHER, 0.0


def closed_lexicon() -> Lexicon:
    lexicon = Lexicon()
    for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        lexicon.words.update(dict.fromkeys(words, (symbol, 0.0)))
    return lexicon


def seed_lexicon() -> Lexicon:
    lexicon = closed_lexicon()
    lexicon.words.update(dict.fromkeys(INSULTS, (INSULT, SEED_WEIGHT)))
    lexicon.words.update(dict.fromkeys(THREATS, (THREAT, THREAT_WEIGHT)))
    return lexicon


class Scorer:
    """Runs the grammar over texts; remembers the words it has looked up, up to a bound."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.symbols: dict[str, int] = dict(_BOUNDARY)
        self.weights: dict[str, float] = {}

    def features(self, text: str | None) -> tuple[np.ndarray, list[str]]:
        """Channel sums, and the words of the strongest clause."""
        out = np.zeros(N_FEATURES)
        tokens = _TOKEN.findall(text.lower()) if text else []
        symbols, weights = self.symbols, self.weights
        if len(symbols) > 400_000:
            symbols.clear()
            symbols.update(_BOUNDARY)
        row = []
        for token in tokens:
            symbol = symbols.get(token)
            if symbol is None:
                symbol, weight = self.lexicon.look_up(token)
                symbols[token] = symbol
                if weight:
                    weights[token] = weight
            row.append(symbol)
        if INSULT not in row and THREAT not in row:
            return out, []
        state, clause, best, words, strongest = 0, 0.0, 0.0, [], []
        for token, symbol in zip(tokens, row, strict=True):
            state_after, channel = GRAMMAR[state][symbol]
            state = state_after
            if symbol in (INSULT, THREAT) and (symbol == INSULT or channel & 1):  # a threat needs a target
                weight = weights[token]
                out[channel + 8 * (symbol == THREAT)] += weight
                clause += weight * (0.5 if channel & 6 else 1.0)
                words.append(token)
            elif symbol >= COMMA:
                if clause > best:
                    best, strongest = clause, words
                clause, words = 0.0, []
        if clause > best:
            best, strongest = clause, words
        out[:16] = np.minimum(out[:16], 40.0)
        out[16] = min(best, 10.0)
        out[17] = min(100.0 * out[:16].sum() / max(20, len(tokens)), 20.0)
        return out, strongest


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray  # one a feature
    bias: float

    def probability(self, features: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, self.bias + float(features @ self.weights)))))


#: What a matched weight counts before anything is learned: scopes soften, targets sharpen.
PRIOR = np.array([0.6 * (0.5 if c & 6 else 1.0) * (1.2 if c & 1 else 1.0) for c in range(8)] * 2 + [0.3, 0.0])
PRIOR_BIAS = -2.5


def default_model() -> ToxicityModel:
    return ToxicityModel(seed_lexicon(), PRIOR.copy(), PRIOR_BIAS)


# --- fitting ---------------------------------------------------------------------------------------------------


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, sample_rows: int
) -> tuple[DataFrame, dict[int, int]]:
    """Distinct labelled texts (text, h, y), at most ``sample_rows`` a class, and the rows a class.

    Copies count once: rows are reduced to text hashes before the sample is drawn by hash, and each chosen hash keeps
    one text. A tenth more than ``sample_rows`` a class is drawn and cut to the first ones, which are broadcast.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max((F.col(label) == 1).cast("int")).alias("y")
    )
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    first = stage(hashed.join(marks, "id").groupBy("y", "h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "labels")
    sizes = {r["y"]: (r["texts"], r["n"]) for r in first.groupBy("y").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).collect()}
    grain = 1 << 20
    share = F.lit(0)
    for y, (texts, _) in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(grain, math.ceil(1.1 * grain * sample_rows / texts)))).otherwise(share)
    order = Window.partitionBy("y").orderBy("draw", "h")
    chosen = (
        first.withColumn("draw", F.xxhash64("h"))
        .where(F.pmod("draw", F.lit(grain)) < share)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= sample_rows)
        .select("id", "h", "y")
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    found = rows.join(F.broadcast(chosen), ["id", "h"]).groupBy("h", "y").agg(F.min("text").alias("text"))
    return stage(found, "sample"), {y: n for y, (_, n) in sizes.items()}


def entries_of(text: str | None) -> set[str]:
    """Candidate entries in a text: whole words (``=word``) and stems."""
    found = set()
    for word in set(_TOKEN.findall(text.lower())) if text else ():
        if word in _BOUNDARY:
            continue
        found.add("=" + word)
        found.update(word[:n] for n in STEM_LENGTHS if n <= len(word))
    return found


def _count_entries(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entry, toxic and other texts that hold it, and the toxic ones' hashes combined."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    sets: dict[str, int] = {}

    def flush():
        entries = list(counts[0].keys() | counts[1].keys())
        columns = [
            pa.array(entries, pa.string()),
            pa.array([counts[1][e] for e in entries], pa.int64()),
            pa.array([counts[0][e] for e in entries], pa.int64()),
            pa.array([sets.get(e, 0) for e in entries], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["entry", "yes", "no", "texts"])
        for held in (counts[0], counts[1], sets):
            held.clear()

    for batch in batches(source):
        for text, y, h in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "h")), strict=True):
            entries = entries_of(text)
            counts[1 if y == 1 else 0].update(entries)
            if y == 1:
                for entry in entries:
                    sets[entry] = sets.get(entry, 0) ^ h
        if len(counts[0]) + len(counts[1]) > 300_000:
            yield from flush()
    yield from flush()


def log_odds_bound(yes, no, n_yes: int, n_no: int):
    """Lower confidence bound of the log odds ratio (SQL columns or numbers)."""
    log, sqrt = (F.log, F.sqrt) if not isinstance(yes, (int, float)) else (math.log, math.sqrt)
    odds = log((yes + 0.5) / (n_yes - yes + 0.5)) - log((no + 0.5) / (n_no - no + 0.5))
    return odds - 1.3 * sqrt(1.0 / (yes + 0.5) + 1.0 / (no + 0.5))


def cover(found: list[list[str]], weights: dict[str, float], least: int) -> dict[str, float]:
    """Entries by sequential covering: the one that explains most, then the one that explains most of the rest."""
    open_texts = [set(entries) for entries in found]
    gains = Counter(e for entries in open_texts for e in entries)
    chosen: dict[str, float] = {}
    alive = set(range(len(open_texts)))
    where: dict[str, list[int]] = {}
    for i, entries in enumerate(open_texts):
        for e in entries:
            where.setdefault(e, []).append(i)
    while gains:
        entry = max(gains, key=lambda e: (gains[e] * min(weights[e], 4.0), len(e), e))
        if gains[entry] < least:
            break
        chosen[entry] = weights[entry]
        for i in where[entry]:
            if i in alive:
                alive.discard(i)
                gains.subtract(open_texts[i])
        del gains[entry]
    return chosen


def _minimum(design: np.ndarray, y: np.ndarray, centre: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Where the ridge logistic loss is least. The loss is strictly convex, so steps that are halved until it falls
    reach it from anywhere; the end is a gradient that is nought."""

    def loss(w):
        z = design @ w
        return float((np.logaddexp(0.0, z) - y * z).sum() + 0.5 * (ridge * (w - centre) ** 2).sum())

    w, now = centre.copy(), loss(centre)
    enough = 1e-7 * max(1, len(y))
    for _ in range(200):
        p = 0.5 * (1.0 + np.tanh(0.5 * (design @ w)))
        gradient = design.T @ (p - y) + ridge * (w - centre)
        if np.abs(gradient).max() <= enough:
            return w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-12 and (after := loss(w - size * step)) > now - 1e-4 * size * float(gradient @ step):
            size /= 2
        if size <= 1e-12:  # no step is felt any more: the rounding of the loss is reached
            if np.abs(gradient).max() <= 1e3 * enough:
                return w
            break
        w, now = w - size * step, after
    raise ArithmeticError("the toxicity fit did not converge")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression towards the prior, without negative weights: a feature whose weight would be negative
    is left out and the others are fitted again."""
    design = np.hstack([x, np.ones((len(x), 1))])
    centre = np.append(PRIOR, PRIOR_BIAS)
    ridge = np.append(np.full(x.shape[1], RIDGE), 0.1)
    used = np.ones(len(centre), bool)
    while True:
        w = np.zeros(len(centre))
        w[used] = _minimum(design[:, used], y, centre[used], ridge[used])
        negative = w < 0
        negative[-1] = False
        if not negative.any():
            return w[:-1], float(w[-1])
        used &= ~negative


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Lexicon and weights from labelled documents (1 is toxic). Without both classes the seed model is returned.

    Null texts and labels teach nothing; a document with several labels counts as toxic if one is 1; repeated texts
    count once. Of entries in the very same toxic texts only the one that covering would choose is compared, so the
    driver holds no more entries than the bounded sample has different sets of texts.
    """
    spark = prepare(docs.sparkSession)
    sample, sizes = labelled_sample(docs, labels, doc_id=doc_id, text=text, label=label, sample_rows=sample_rows)
    counted = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_yes, n_no = counted.get(1, 0), sum(n for y, n in counted.items() if y != 1)
    if not n_yes or not n_no:
        return default_model()
    least = max(3, n_yes // 400)
    counts = sample.mapInArrow(_count_entries, "entry string, yes long, no long, texts long").groupBy("entry").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.bit_xor("texts").alias("texts")
    )
    bound = log_odds_bound(F.col("yes"), F.col("no"), n_yes, n_no)
    first = F.struct(F.least(F.col("weight"), F.lit(4.0)), F.length("entry"), "entry", "weight")
    strong = (
        counts.where(F.col("yes") >= least)
        .withColumn("weight", bound)
        .where(F.col("weight") > 1.5)
        .groupBy("yes", "texts")
        .agg(F.max(first).alias("e"))
        .select("e.entry", "e.weight")
        .collect()
    )
    weights = {r["entry"]: float(r["weight"]) for r in strong}
    shared = spark.sparkContext.broadcast(set(weights))

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            rows = [sorted(entries_of(t) & shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["found"])

    found = [r["found"] for r in sample.where("y = 1").select("text").mapInArrow(find, "found array<string>").collect()]
    lexicon = seed_lexicon()
    for entry, weight in cover(found, weights, least).items():
        value = (INSULT, round(min(weight, 6.0), 4))
        if entry.startswith("="):
            lexicon.words[entry[1:]] = value
        else:
            lexicon.stems[entry] = value
    entries = spark.sparkContext.broadcast((lexicon.words, lexicon.stems))

    def measure(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(*entries.value))
        for batch in batches(source):
            rows = [scorer.features(t)[0].tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    table = sample.mapInArrow(measure, "x array<double>, y int").toArrow()
    x = np.array(table.column("x").to_pylist())
    y = (np.array(table.column("y").to_pylist()) == 1).astype(float)
    learned, bias = _logistic(x, y)
    all_yes, all_no = sizes.get(1, 1), sum(n for k, n in sizes.items() if k != 1)
    bias += math.log(all_yes / max(1, all_no)) - math.log(n_yes / n_no)  # the sample's classes are not the corpus's
    bias = min(bias, math.log(MOST_WITHOUT_MATCH / (1 - MOST_WITHOUT_MATCH)))
    return ToxicityModel(lexicon, learned, bias)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, *, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns, score (0 to 1) and worst (matched words of the strongest clause).

    Null and empty texts get the score of a text without matches. Repeated rows get equal scores; nothing is
    shuffled; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.weights, model.bias))
    schema = T.StructType(
        [*[docs.select(k).schema[0] for k in keep], T.StructField("score", T.DoubleType()), T.StructField("worst", T.StringType())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems, weights, bias = shared.value
        fitted = ToxicityModel(Lexicon(words, stems), weights, bias)
        scorer = Scorer(fitted.lexicon)
        for batch in batches(source):
            scores, worst = [], []
            for t in batch.column(text).to_pylist():
                features, clause = scorer.features(t)
                scores.append(fitted.probability(features))
                worst.append(" ".join(clause))
            columns = [*[batch.column(k) for k in keep], pa.array(scores, pa.float64()), pa.array(worst, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "worst"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
