"""Toxic passages by maximum-scoring segments.

Units are words and the prefixes of words. From a bounded sample of labelled documents, every unit gets the log-odds of its
document frequencies in toxic and clean documents under a Dirichlet prior; units whose association is significant (signed
root of the likelihood ratio) score their tokens, all other tokens cost a little, namely the log-odds of bearing none.
A linear scan finds all maximal-scoring segments of a document. A segment's score S is set against the best that chance
gives in a text of n tokens, whose distribution is an extreme-value law: x = lambda * S - log(K * n), with lambda from the
scores of clean documents. The significant segments' x are added up and turned into a probability by a logistic curve,
fitted on a part of the sample that gave no log-odds.

Fitting: at most ``SAMPLE`` labelled documents (those with the smallest hashes of their ids), and every unit of theirs that
tells toxic from clean documents, however many these are: the sample bounds them.
Scoring: every row by itself, with the fitted model; no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.llm.bpe import Cache
from frond.llm.common import saved

SAMPLE = 20_000
PREFIXES = (4, 5, 6, 7, 8)
PRIOR, LEAST_ROOT, LEAST_ODDS, MOST_ODDS = 0.5, 4.0, 1.0, 8.0
#: Share of the sample that fits the curve and not the log-odds, as one part of so many.
CURVE_PART = 4
K = 0.1
TOXIC = 0.7
_TOKEN = re.compile(r"[^\W_]+")


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    neutral: float = -0.01
    decay: float = 1.0
    slope: float = 1.0
    intercept: float = -3.0

    def of_word(self, word: str) -> float:
        """The score of a token: the largest log-odds of its units, else the neutral one."""
        found = [self.odds[u] for u in units(word) if u in self.odds]
        return max(found) if found else self.neutral


def units(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, end) of a list, in time linear in its length.

    Candidates are kept as (sum before, sum after, first, end, link); link points to the nearest earlier candidate with a
    smaller sum before, so that looking for it costs amortised constant time.
    """
    total, found = 0.0, []
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((before, total, first, i + 1, j))
                break
            before, _, first, _, link = found[j]
            del found[j:]
            j = link
    return [(after - before, a, b) for before, after, a, b, _ in found]


def evidence(scores: np.ndarray, model: Model) -> tuple[float, list[tuple[float, int, int]]]:
    """A document's statistic and its significant passages (x, first token, end token)."""
    n = len(scores)
    if not n:
        return -10.0, []
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return -math.log(K * n + 1) - 5.0, []
    items, places, last = [], [], 0
    for at in hits.tolist():  # runs of neutral tokens are one item each, which leaves all maximal segments as they are
        if at > last:
            items.append((at - last) * model.neutral)
            places.append(last)
        items.append(float(scores[at]))
        places.append(at)
        last = at + 1
    chance = math.log(K * n + 1)
    found = [(model.decay * s - chance, places[a], places[b - 1] + 1) for s, a, b in segments(items)]
    strong = [x for x in found if x[0] > 0]
    return (sum(x[0] for x in strong) if strong else max(x[0] for x in found)), strong


def _scorer(model: Model):
    cache = Cache(model.of_word, entries=200_000)

    def score(text: str | None) -> tuple[np.ndarray, str]:
        low = (text or "").lower()
        return np.array([cache[w] for w in _TOKEN.findall(low)], float), low

    return score


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, curve) of at most ``sample`` labelled documents for which ``learn`` holds; saved."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = saved(known.withColumn("_h", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40))))
    share = 0.95 * sample / max(1, known.count())  # as many as this share has are under the bound, but for odds beyond 1e-9
    chosen = known.filter(F.col("_h") < int(share * (1 << 40))) if share < 0.95 else known
    return saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", (F.pmod("_h", F.lit(CURVE_PART)) == 0).alias("curve")))


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def out():
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], ["unit", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            found = {u for w in set(_TOKEN.findall((text.as_py() or "").lower())) for u in units(w)}
            (toxic if label.as_py() else clean).update(found)
            if len(toxic) + len(clean) > 400_000:
                yield out()
                toxic.clear()
                clean.clear()
    yield out()


def fit(sample: DataFrame) -> Model:
    """The model of a sample (text, toxic, curve). Without toxic or without clean documents nothing scores above neutral."""
    model = Model()
    base = sample.filter("not curve")
    sizes = {bool(t): n for t, n in base.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return model
    a, b = F.col("toxic"), F.col("clean")
    counts = base.select("text", "toxic").mapInArrow(_unit_counts, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = n1 / (n1 + n0)

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    gain = part(a, (a + b) * share) + part(b, (a + b) * (1 - share)) + part(n1 - a, (n1 + n0 - a - b) * share) + part(n0 - b, (n1 + n0 - a - b) * (1 - share))
    odds = F.log((a + PRIOR) / (n1 - a + PRIOR)) - F.log((b + PRIOR) / (n0 - b + PRIOR))
    told = counts.withColumns({"odds": odds, "root": F.sqrt(F.greatest(gain * 2, F.lit(0.0)))}).filter((F.col("root") >= LEAST_ROOT) & (F.col("odds") >= LEAST_ODDS))
    model.odds = {u: min(o, MOST_ODDS) for u, o in told.select("unit", "odds").collect()}  # of SAMPLE documents at most
    _fit_scores(base, model)
    _fit_curve(sample, model)
    return model


def _fit_scores(base: DataFrame, model: Model) -> None:
    """The neutral score and lambda, from how often tokens of either kind of document score what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, seen = _scorer(Model(model.odds, 0.0)), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                values, times = np.unique(np.round(score(text.as_py())[0], 1), return_counts=True)
                for v, t in zip(values.tolist(), times.tolist()):
                    seen[bool(label.as_py()), v] += t
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.float64()), pa.array([seen[k] for k in keys], pa.int64())], ["toxic", "odds", "n"])

    rows = base.select("text", "toxic").mapInArrow(run, "toxic boolean, odds double, n long").groupBy("toxic", "odds").agg(F.sum("n").alias("n")).collect()  # a few hundred rows
    tokens = {side: sum(r.n for r in rows if r.toxic == side) or 1 for side in (True, False)}
    bare = {side: sum(r.n for r in rows if r.toxic == side and r.odds == 0) for side in (True, False)}
    model.neutral = min(-0.002, math.log((bare[True] + 1) / (tokens[True] + 1)) - math.log((bare[False] + 1) / (tokens[False] + 1)))
    clean = [(r.odds or model.neutral, r.n / tokens[False]) for r in rows if not r.toxic]
    low, high = 0.0, 5.0
    for _ in range(60):  # sum of p * exp(lambda * s) is convex, 1 at 0, and 1 again at the lambda sought
        middle = (low + high) / 2
        low, high = (middle, high) if sum(p * math.exp(min(700.0, middle * s)) for s, p in clean) < 1 else (low, middle)
    model.decay = min(2.0, max(0.2, low))


def _fit_curve(sample: DataFrame, model: Model) -> None:
    """Slope and intercept of the logistic curve, by Newton's method over binned statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, seen = _scorer(model), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                x = evidence(score(text.as_py())[0], model)[0]
                seen[bool(label.as_py()), round(min(30.0, max(-15.0, x)), 1)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.float64()), pa.array([seen[k] for k in keys], pa.int64())], ["toxic", "x", "n"])

    rows = sample.filter("curve").select("text", "toxic").mapInArrow(run, "toxic boolean, x double, n long").groupBy("toxic", "x").agg(F.sum("n").alias("n")).collect()  # 902 at most
    if not any(r.toxic for r in rows) or all(r.toxic for r in rows):
        return
    x, y, n = np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows]), np.array([float(r.n) for r in rows])
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([0.5, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (n * (y - p)) - 0.05 * beta * (1, 0)
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), slope)
        beta = beta + np.clip(step, -1, 1)
    model.slope, model.intercept = max(0.05, float(beta[0])), float(beta[1])


PASSAGES = "array<struct<start: int, end: int, x: double>>"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and passages (code points start and end, and their x) for every row of ``docs``.

    A null or empty text has no passages and the score of no evidence. Repeated rows give repeated results, an empty table
    an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        passages = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("x", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                values, low = score(text.as_py())
                x, strong = evidence(values, model)
                places = [m.span() for m in _TOKEN.finditer(low)] if strong else []
                spans.append([{"start": places[a][0], "end": places[b - 1][1], "x": v} for v, a, b in strong])
                scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, model.slope * min(30.0, max(-15.0, x)) + model.intercept)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= TOXIC) for s in scores], pa.int32()), pa.array(spans, passages)], ["doc_id", "score", "predicted", "passages"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, score double, predicted int, passages {PASSAGES}")
