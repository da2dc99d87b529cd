"""Toxicity by maximum-scoring segments of token log-odds.

Every word has the log-odds of toxic against other texts, by a Dirichlet prior
over the two kinds: so many occurrences, split as its family's are. A family
is the words that begin with the same characters; longer beginnings have the
shorter ones as their prior, and those of four characters the split of all
texts. A word that the sample doesn't have gets its longest known family's
log-odds, or 0. Less a drift, the scores of ordinary words are negative, and a
scan in linear time finds every maximal segment of positive total. By
extreme-value statistics the best segment of n ordinary words exceeds x with
probability 1 - exp(-K n exp(-lambda x)), where K and lambda are those that
make the best segments of ordinary learning rows likeliest; segments that are
unlikely by this are toxic passages, and the sum of their surprises, through a
logistic curve fitted on the learning rows, gives the score.

Learning takes a bounded, fixed sample: about SAMPLE rows of each label, three
quarters for the words and the rest for the background and the curve. What
comes to the driver are the words of that sample whose log-odds differ from
their families', and counts of its rows by label, length and finding.

Texts: null and empty ones have no words and get the score of no finding;
long ones are scanned whole. Rows come one to one, repeated ids included; a
label of a repeated id is toxic if any of its labels is. Texts that tie get
one score. Without labels of both kinds in either part nothing is learned and
every score is 0. An empty table gives an empty result. Only the named columns
are read, so that other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, received, sample_share, send, slices, small_batches, stored

#: About so many labelled rows of each label are learned from.
SAMPLE = 6000
#: Occurrences that the prior counts for; drift of every word.
PRIOR, DRIFT = 15.0, 1.2
#: Lengths of the families' first characters, longest first; each is the prior of the one before.
STEMS = (8, 6, 5, 4)
#: A word whose log-odds are so near its family's is left to it.
NEAR = 0.2
#: Words whose scores a worker remembers.
REMEMBERED = 50_000
#: Segments are toxic passages where so many such are expected in an ordinary text.
EXPECTED = 0.05
#: Fixed value: what separates words.
SPLIT = r"[^\p{L}\p{N}]+"

_words = re.compile(r"[^\W_]+")


def smoothed(units, n_toxic: float, n_other: float):
    """(unit, log-odds, its family's log-odds) of (unit, toxic, other) in order of the units.

    toxic, other: how many texts of each kind have the unit. A family's name
    ends in a star, which comes before every letter and digit, so that
    families come before what belongs to them.
    """
    families: dict[int, tuple[str, float]] = {}
    for unit, toxic, other in units:
        start = unit[:-1] if unit.endswith("*") else unit
        family = 0.0
        for k in STEMS:
            if len(start) > k and k in families and families[k][0] == start[:k]:
                family = families[k][1]
                break
        share = 1 / (1 + math.exp(-family) * n_other / n_toxic)
        odds = math.log((toxic + PRIOR * share) / n_toxic) - math.log((other + PRIOR * (1 - share)) / n_other)
        if start is not unit:
            families[len(start)] = start, odds
        yield unit, odds, family


class Model:
    """scores: log-odds of words and, with a star, of families."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.seen = scores, {}
        self.decay, self.scale, self.offset, self.slope = 1.0, 1e-3, 0.0, 1.0

    def net(self, word: str) -> float:
        """A word's log-odds less the drift."""
        score = self.scores.get(word)
        if score is None:
            for k in STEMS:
                if len(word) > k:
                    score = self.scores.get(word[:k] + "*")
                    if score is not None:
                        break
            else:
                score = 0.0
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word] = score - DRIFT
        return score - DRIFT

    def nets(self, text: str) -> list[float]:
        seen, net = self.seen.get, self.net
        return [net(w) if (x := seen(w)) is None else x for w in _words.findall(text)]

    @staticmethod
    def segments(nets: list[float]) -> list[tuple[float, int, int]]:
        """(total, first word, end) of every maximal segment, in order of the text; linear in the words.

        Each candidate keeps the running total before (low) and after (high)
        it; a new one joins back to the latest candidate with a smaller low,
        if that one's high is smaller.
        """
        out: list[list] = []  # low, high, first, end, index of the latest earlier candidate with a smaller low
        total = 0.0
        for at, score in enumerate(nets):
            if score <= 0:
                total += score
                continue
            new = [total, total + score, at, at + 1, -1]
            total += score
            while True:
                j = len(out) - 1
                while j >= 0 and out[j][0] >= new[0]:
                    j = out[j][4]
                if j < 0 or out[j][1] >= new[1]:
                    new[4] = j
                    out.append(new)
                    break
                new[0], new[2] = out[j][0], out[j][2]
                del out[j:]
        return [(high - low, first, end) for low, high, first, end, _ in out]

    def best(self, text: str) -> tuple[int, float]:
        """The number of words, and the largest total of a segment, or 0."""
        nets = self.nets(text)
        return len(nets), max((total for total, _, _ in self.segments(nets)), default=0.0)

    def findings(self, text: str, passages: bool = True) -> tuple[float, float, list[tuple[int, int, float]]]:
        """The sum of the significant segments' surprises, the score, and the passages, as characters, with their expected numbers."""
        if not self.scores:
            return 0.0, 0.0, []
        nets = self.nets(text)
        surprise, found = 0.0, []
        for total, first, end in self.segments(nets):
            log_expected = math.log(self.scale * len(nets)) - self.decay * total
            if log_expected < math.log(EXPECTED):
                surprise -= log_expected
                found.append((first, end, math.exp(log_expected)))
        if found and passages:
            places = [m.span() for m in _words.finditer(text)]
            found = [(places[first][0], places[end - 1][1], expected) for first, end, expected in found]
        z = self.offset + self.slope * math.log1p(surprise)
        return surprise, 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), found

    def calibrate_background(self, n: np.ndarray, best: np.ndarray, count: np.ndarray) -> None:
        """lambda and K of greatest likelihood for the best segments of ordinary texts of n words; a best of 0 says that none is positive."""
        some = best > 0
        idle = float((count * n)[~some].sum())
        n, best, count = n[some].astype(float), best[some], count[some]
        if not count.sum():
            self.scale = 1e-9
            return

        def scale(x):
            return count.sum() / ((count * n * np.exp(-x * best)).sum() + idle)

        def slope(x):
            return count.sum() / x - (count * best).sum() + scale(x) * (count * n * best * np.exp(-x * best)).sum()

        low, high = 0.05, 20.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if slope(mid) > 0 else (low, mid)
        self.decay, self.scale = low, max(1e-9, float(scale(low)))

    def calibrate_score(self, surprise: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Logistic curve of the surprise by Newton's method, with a weak pull to 0.

        A step is halved until it lowers the loss, which is convex, so that the
        method ends at the curve even where the labels are all but parted.
        """
        x = np.column_stack([np.ones(len(surprise)), np.log1p(surprise)])
        w = np.zeros(2)

        def loss(w):
            z = x @ w
            return (weight * (np.logaddexp(0, z) - label * z)).sum() + 0.005 * w @ w

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            gradient = x.T @ (weight * (p - label)) + 0.01 * w
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
            step, part = np.linalg.solve(hessian, gradient), 1.0
            while part > 1e-9 and loss(w - part * step) > loss(w) - 1e-4 * part * gradient @ step:
                part /= 2
            if part <= 1e-9:
                break
            w -= part * step
            if np.abs(part * step).max() < 1e-9:
                break
        self.offset, self.slope = float(w[0]), float(w[1])


def _family_names(words: Column, k: int) -> Column:
    """A second parameter of the functions would be taken for an index."""
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def learn(df: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """learn_from: a condition on the id, for the rows of labels that may be read."""
    known = labels.where(learn_from & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Model({})
    share = F.when(F.col("_label") == 1, F.lit(min(1.0, sample / totals[1]))).otherwise(min(1.0, sample / totals[0]))
    chosen = known.where(sample_share("_id", share)).groupBy("_id").agg(F.max("_label").alias("_label"))
    read = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_text"))
    # The ids chosen are bounded by the sample, so that they are sent to the texts.
    texts = stored(read.join(F.broadcast(chosen), "_id").select("_label", "_text", (F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(23)), F.lit(4)) == 0).alias("_later")))
    words = F.array_distinct(F.filter(F.split("_text", SPLIT), lambda w: w != ""))
    every = texts.where("not _later").select("_label", F.explode(F.array_distinct(F.concat(words, *[_family_names(words, k) for k in STEMS]))).alias("unit"))
    counts = every.groupBy("unit").agg(F.sum("_label").cast("double").alias("toxic"), F.sum(1 - F.col("_label")).cast("double").alias("other"))
    size = {(r["_label"], r["_later"]): float(r["n"]) for r in texts.groupBy("_label", "_later").agg(F.count("*").alias("n")).collect()}
    if len(size) < 4:
        return Model({})
    n1, n0 = size[1, False], size[0, False]

    def smoother(batches):
        units = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        kept: list[tuple[str, float]] = []
        for unit, odds, family in smoothed(units, n1, n0):
            if abs(odds - family) > NEAR:
                kept.append((unit, odds))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.float64())], ["unit", "score"])

    # A family and what belongs to it share their first characters, and so a partition.
    families = counts.repartition(F.substring("unit", 1, min(STEMS))).sortWithinPartitions("unit")
    scored = families.mapInArrow(smoother, "unit string, score double")
    model = Model({r["unit"]: r["score"] for r in scored.collect()})  # of a bounded sample
    sent = send(df.sparkSession, model)

    def background(batches):
        model = received(sent)
        for batch in batches:
            found = [model.best(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["n", "best"])

    later = texts.where("_later").select("_label", "_text")
    seen = later.where("_label = 0").mapInArrow(background, "n long, best double").select("n", F.round("best", 2).alias("best")).groupBy("n", "best").count().collect()  # of a bounded sample
    model.calibrate_background(*(np.array([r[i] for r in seen], float) for i in range(3)))
    sent_again = send(df.sparkSession, model)

    def surprises(batches):
        model = received(sent_again)
        for batch in batches:
            found = [model.findings(text, False)[0] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["label", "surprise"])

    fit = later.mapInArrow(surprises, "label int, surprise double").select("label", F.round("surprise", 2).alias("surprise")).groupBy("label", "surprise").count().collect()
    # Each label counts as in all labelled rows, not as in the sample.
    repeat = {label: totals[label] / size[label, True] for label in (0, 1)}
    weights = np.array([r["count"] * repeat[r["label"]] for r in fit])
    model.calibrate_score(np.array([r["surprise"] for r in fit]), np.array([float(r["label"]) for r in fit]), weights)
    return model


def _scorer(sent):
    def run(batches):
        model = received(sent)
        for batch in slices(batches, 1):
            scores, passages = [], []
            for text in batch.column(1):
                _, score, found = model.findings(text.as_py() or "")
                scores.append(score)
                passages.append([{"start": a, "end": b, "expected": e} for a, b, e in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["id", "score", "passages"])

    return run


def score_column(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score alone, as a column: only the text goes to the Python workers."""
    sent = send(small_batches(df).sparkSession, model)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = received(sent)
        for part in texts:
            yield pa.array([model.findings(text.as_py() or "", False)[1] for text in part], pa.float64())
        give_back()

    return run(F.lower(text_col))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, passages): passages as character ranges of the lower-cased text, with the number expected by chance."""
    sent = send(df.sparkSession, model)
    read = df.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    out = read.mapInArrow(_scorer(sent), f"id {dict(read.dtypes)['id']}, score double, passages array<struct<start:int,end:int,expected:double>>")
    return out.withColumnRenamed("id", id_col)
