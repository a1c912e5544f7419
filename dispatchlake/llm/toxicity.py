"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value significance."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import map_slices, staged, whole

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words of these lengths are features beside the word itself.
STEMS = range(4, 9)
EULER = 0.5772156649015329
#: Word scores remembered in one Python worker.
REMEMBERED = 300_000


def features(word: str) -> list[str]:
    """The whole word, marked by a dot, and its beginnings."""
    return [word + ".", *(word[:n] for n in STEMS if n <= len(word))]


@dataclass
class Model:
    """Weights of features, and how segment scores become a probability.

    Weights are signed: a word of clean texts counts against a segment. ``drift``
    is taken off for every word, known or not. A segment of score s in a
    text of n words has the normalised score rate * s - ln(n) - log_k, whose
    exponential is about one over the number of such segments that chance gives.
    ``slope`` and ``shift`` turn the sum over significant segments into the score.
    """

    weights: dict[str, float] = field(default_factory=dict)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    drift: float = 0.1
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    shift: float = -50.0

    def word_score(self, word: str) -> float:
        """The weight of the feature that tells most, either way, less the drift."""
        return max((self.weights[f] for f in features(word) if f in self.weights), key=abs, default=0.0) - self.drift

    def normalised(self, total: float, words: int) -> float:
        return self.rate * total - math.log(max(1, words)) - self.log_k

    def evidence(self, totals: list[float], words: int) -> float:
        """Sum of the normalised scores over 0; without one, the best that is under it."""
        scores = [self.normalised(t, words) for t in totals] or [self.normalised(0.0, words)]
        return sum(s for s in scores if s > 0) or max(scores)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.shift))))


class Scorer(dict):
    """Scores of words under a model, remembered within a bound."""

    #: The one of the last model in this Python worker; a task's own would outlive it.
    last: Scorer | None = None

    @classmethod
    def of(cls, model: Model) -> Scorer:
        if cls.last is None or cls.last.model.name != model.name:
            cls.last = Scorer(model)
        return cls.last

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.model.word_score(word.lower())
        return value


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass.

    A segment can't be made better by growing or shrinking it, and none lies in
    another. Each open segment leads to the last
    one before it whose sum to the left is lower, so what a search passed over is
    never walked again, and the time is linear in the scores.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, the running sums before and after, and where it leads
    total = 0.0
    for i, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        mine = (i, i + 1, total, total + score)
        total += score
        j = len(found) - 1
        while j >= 0 and found[j][2] >= mine[2]:
            j = found[j][4]
        while j >= 0 and found[j][3] < mine[3]:
            start, _, before, _, lower = found[j]
            mine = (start, mine[1], before, mine[3])
            del found[j:]
            j = lower
        found.append((*mine, j))
    return [(start, end, after - before) for start, end, before, after, _ in found]


def _rate(histogram: dict[float, int]) -> float:
    """The positive solution of E[exp(rate * score)] = 1 for the scores of clean words; their mean is negative."""
    total = sum(histogram.values())
    low, high = 0.0, 1.0
    excess = lambda r: sum(n / total * math.exp(min(700.0, r * s)) for s, n in histogram.items()) - 1
    if not any(s > 0 for s in histogram):
        return 1.0
    while excess(high) < 0:
        low, high = high, 2 * high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if excess(middle) > 0 else (middle, high)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with a slight pull towards 0."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 0.01 * beta
        curvature = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, prior: float = 0.05, least_z: float = 3.0, drift: float = 0.1) -> Model:
    """A model from labelled rows that are not held out.

    Learns from at most ``sample`` labelled documents, those of the least hashes
    of their ids; this bounds what is broadcast and collected. A feature counts
    once per document. Its weight is the difference of its log-odds in toxic and
    other documents, under a Dirichlet prior of the pooled counts that weighs
    ``prior`` of all of them; features whose difference is ``least_z`` standard
    errors and more, to either side, have one. Of several documents with a
    labelled id the one with the least hash of its text is learned from. Null ids, null labels and held-out rows are left out; of several labels
    of a document the highest holds. Without labels of both kinds no text
    scores over 0.5.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    train = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    train = staged(train.select("toxic", "text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            counts.update((f, toxic) for f in {f for word in set(WORD.findall(text)) for f in features(word.lower())})
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["feature", "toxic", "n"])

    counted = map_slices(train, "feature string, toxic int, n long", count).groupBy("feature")
    counted = staged(counted.agg(F.sum(F.expr("if(toxic = 1, n, 0L)")).alias("bad"), F.sum(F.expr("if(toxic = 1, 0L, n)")).alias("good")))
    bad, good = counted.agg(F.sum("bad"), F.sum("good")).first()
    model = Model(drift=drift)
    if not bad or not good:
        return model
    mass = prior * (bad + good)
    pseudo = prior * (F.col("bad") + F.col("good"))
    b, g = F.col("bad") + pseudo, F.col("good") + pseudo
    odds = F.log(b / (F.lit(bad + mass) - b)) - F.log(g / (F.lit(good + mass) - g))
    certain = counted.select("feature", odds.alias("odds"), (odds / F.sqrt(1 / b + 1 / g)).alias("z")).where(F.abs("z") >= least_z)
    model.weights = {r.feature: r.odds for r in certain.orderBy("feature").collect()}  # of at most ``sample`` texts

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer, clean = Scorer.of(model), Counter()
        toxics, words, totals = batch.column("toxic").to_pylist(), [], []
        for toxic, text in zip(toxics, batch.column("text").to_pylist()):
            scores = [scorer[word] for word in WORD.findall(text)]
            words.append(len(scores))
            totals.append([s for _, _, s in segments(scores)])
            if toxic != 1:
                clean.update(scores)
        n = len(toxics)
        histogram = [list(clean.items())] + [[]] * (n - 1)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("n", pa.int64())]))
        packed = pa.array([[{"score": s, "n": k} for s, k in h] for h in histogram], kind)
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.int64()), pa.array(totals, pa.list_(pa.float64())), packed], names=["toxic", "words", "totals", "clean"])

    weighed = staged(map_slices(train, "toxic int, words long, totals array<double>, clean array<struct<score:double,n:long>>", weigh))
    histogram = weighed.select(F.inline("clean")).groupBy("score").agg(F.sum("n").alias("n")).collect()
    model.rate = _rate({r.score: r.n for r in histogram})
    rows = weighed.select("toxic", "words", "totals").orderBy("toxic", "words", "totals").collect()  # at most ``sample``
    clean = [model.rate * max(r.totals, default=0.0) - math.log(max(1, r.words)) for r in rows if r.toxic != 1]
    model.log_k = float(np.mean(clean)) - EULER
    x = np.array([model.evidence(r.totals, r.words) for r in rows])
    model.slope, model.shift = _logistic(x, np.array([float(r.toxic == 1) for r in rows]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``score``, ``n_words`` and ``passages``.

    ``passages``: the significant segments, as code points from ``start`` to
    ``end``, with their score and the number of as good ones that chance gives.

    Defined results: a null or empty text has no words and no passages, and
    scores as a text without evidence; repeated rows and null ids are scored
    each; other columns are not read; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("by_chance", pa.float64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = Scorer.of(model)
        results, words, passages = [], [], []
        for text in batch.column("text").to_pylist():
            tokens = WORD.findall(text)
            n = len(tokens)
            found = segments(list(map(scorer.__getitem__, tokens)))
            results.append(model.score(model.evidence([s for _, _, s in found], n)))
            words.append(n)
            strong = [(a, b, s) for a, b, s in found if model.normalised(s, n) > 0]
            places = [m.span() for m in WORD.finditer(text)] if strong else []
            passages.append([{"start": places[a][0], "end": places[b - 1][1], "score": s, "by_chance": math.exp(-model.normalised(s, n))} for a, b, s in strong])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(results, pa.float64()), pa.array(words, pa.int64()), pa.array(passages, pa.list_(passage))], names=["doc_id", "score", "n_words", "passages"])

    return map_slices(source, f"doc_id {kind}, score double, n_words long, passages array<struct<start:int,end:int,score:double,by_chance:double>>", work)
