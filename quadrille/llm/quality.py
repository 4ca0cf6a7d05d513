"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. The counts of
vote patterns over the whole corpus (3^labellers at most) go to an expectation-maximisation
that estimates each labeller's accuracy and every pattern's posterior. A hashed linear
scorer is then trained on the posteriors of a bounded sample and scores every document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Documents the scorer is trained on, on average (all, if there are fewer): a documented bound.
TRAIN_ROWS = 10_000
#: Buckets of hashed words; words a worker remembers at once.
BUCKETS, MOST_WORDS = 1 << 17, 200_000
BAD, GOOD, NONE = 0, 1, 2
#: Words of a text at which its evidence counts half in the scorer.
SHRINK = 16
#: Log-odds of a document's own evidence below which it is rejected: two to one for bad. The share of good
#: documents is left out, so that a document with little evidence is not judged by the others.
LEAST = -math.log(2)

# Frequent words of the languages at hand, and marks of ordinary prose.
STOP_WORDS = frozenset(
    "the of and to in that was is it for on with as by at be this are or from "
    "der die und das den von zu mit im ist auf für des ein eine sich nicht dem "
    "el la de que y en los del se las por un para con no una su lo "
    "le les et du dans est pas pour qui sur au par il elle".split()
)
ORDINARY_MARKS = frozenset(".,;:'\"-()/+=?’“”„«»–—…¿¡")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
STOP, MARKED, CAPS, TITLE, DIGIT, LONG, PLAIN_END = (1 << i for i in range(7))
SHAPES = 128


class Words(dict):
    """For each white-space word: 57 bits of its bare form's hash, then its shape's 7 flags."""

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        if word.isalpha():
            bare, odd = word, 0
        else:
            bare = EDGES.sub("", word)
            odd = sum(not (c.isalnum() or c in ORDINARY_MARKS) for c in word)
        low = bare.lower()
        shape = STOP * (low in STOP_WORDS) | MARKED * (odd > 1 or (odd == 1 and not bare)) | CAPS * (len(bare) > 1 and bare.isupper()) | TITLE * bare.istitle()
        shape |= DIGIT * (not bare.isalpha() and any(c.isdigit() for c in bare)) | LONG * (len(bare) > 20) | PLAIN_END * word.endswith((".", ",", "?", "!"))
        code = int.from_bytes(hashlib.blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") & ~(SHAPES - 1) | shape
        self[word] = code
        return code


#: The worker's own memory of words, kept from task to task.
_words = Words()


@dataclass
class Profile:
    """What labellers and scorer know of a text."""

    codes: np.ndarray

    @classmethod
    def of(cls, text: str | None, words: Words) -> Profile:
        own = (text or "").split()
        return cls(np.fromiter(map(words.__getitem__, own), np.uint64, len(own)))

    def __post_init__(self) -> None:
        self.n = len(self.codes)
        self.shapes = (self.codes & np.uint64(SHAPES - 1)).astype(np.int64)
        self.bare = self.codes >> np.uint64(7)
        counts = np.bincount(self.shapes, minlength=SHAPES) / max(self.n, 1)
        self.shape_share = counts
        self.share = {flag: counts[np.arange(SHAPES) & flag > 0].sum() for flag in (STOP, MARKED, CAPS, PLAIN_END)}
        self.repeats = float((self.bare[1:] == self.bare[:-1]).mean()) if self.n > 1 else 0.0
        self.weight = self.n / (self.n + SHRINK)  # a few words are little evidence
        self.distinct = len(np.unique(self.bare)) / self.n if self.n else 0.0


def _prose(p: Profile) -> bool:
    return p.share[MARKED] < 0.02 and p.repeats < 0.1 and p.share[CAPS] < 0.2 and (p.n < 20 or p.share[STOP] > 0.1)


def _vote(applies: bool, good: bool) -> int:
    return NONE if not applies else GOOD if good else BAD


#: Labellers in the order of a pattern's digits, base 3; short texts are beyond most of them.
LABELLERS = {
    "marked words": lambda p: _vote(True, p.share[MARKED] <= 0.15),
    "repeated words": lambda p: _vote(p.n > 3, p.repeats <= 0.2),
    "capitals": lambda p: _vote(p.n > 3, p.share[CAPS] <= 0.5),
    "stop words": lambda p: _vote(p.n >= 20, p.share[STOP] >= 0.05),
    "distinct words": lambda p: _vote(p.n >= 20, p.distinct >= 0.1 * min(1, 2000 / p.n)),
    "prose": lambda p: _vote(True, _prose(p)),
    "sentences": lambda p: _vote(p.n > 3, p.share[MARKED] < 0.02 and p.repeats < 0.1 and 0.02 < p.share[PLAIN_END] < 0.5),
}


def pattern_of(profile: Profile) -> int:
    """Votes as digits base 3; -1 for a text without words."""
    return sum(vote(profile) * 3**i for i, vote in enumerate(LABELLERS.values())) if profile.n else -1


def vote_matrix(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of good for each pattern, and P(votes good | class) by class and labeller.

    Labellers vote independently given the class, each with its own accuracy on good and on
    bad documents; not to vote says nothing. It begins with every document good on which
    no labeller votes bad. Counts are smoothed.
    """
    votes = vote_matrix(patterns)
    yes, no = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    good = np.where(no.any(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        both = np.stack([1 - good, good]) * counts
        prior = (both.sum(axis=1) + 1) / (both.sum() + 2)
        rate = (both @ yes + 1) / (both @ (yes + no) + 2)
        log = np.log(prior)[:, None] + np.log(rate) @ yes.T + np.log(1 - rate) @ no.T
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return good, rate


@dataclass
class Scorer:
    """Hashed linear scorer over mean word weights, shape shares and repetition."""

    words: np.ndarray
    shapes: np.ndarray
    repeats: float
    bias: float

    def evidence(self, profile: Profile) -> float:
        """Log-odds of good by the text alone; minus infinity without words."""
        if not profile.n:
            return -math.inf
        bucket = (profile.bare % np.uint64(BUCKETS)).astype(np.int64)
        return profile.weight * (float(self.words[bucket].mean()) + float(self.shapes @ profile.shape_share) + self.repeats * profile.repeats)


def fit_scorer(profiles: list[Profile], good: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by Adam; the bias stays at the labels' own odds."""
    rows = np.repeat(np.arange(len(profiles)), [p.n for p in profiles])
    bucket = np.concatenate([(p.bare % np.uint64(BUCKETS)).astype(np.int64) for p in profiles])
    pair, times = np.unique(rows * BUCKETS + bucket, return_counts=True)
    row, column = np.divmod(pair, BUCKETS)
    value = times * np.array([p.weight / p.n for p in profiles])[row]
    dense = np.stack([np.append(p.weight * np.append(p.shape_share, p.repeats), 1.0) for p in profiles])
    sparse, solid = np.zeros(BUCKETS), np.zeros(SHAPES + 2)
    share = np.clip(good.mean(), 0.01, 0.99)
    solid[-1] = np.log(share / (1 - share))
    state = [np.zeros_like(x) for x in (sparse, sparse, solid, solid)]
    for step in range(1, rounds + 1):
        z = np.bincount(row, value * sparse[column], len(profiles)) + dense @ solid
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good) / len(profiles)
        down = np.append(dense[:, :-1].T @ error, 0.0)
        for weights, gradient, k in ((sparse, np.bincount(column, value * error[row], BUCKETS) + decay * sparse, 0), (solid, down + decay * np.append(solid[:-1], 0.0), 2)):
            state[k] += 0.1 * (gradient - state[k])
            state[k + 1] += 0.01 * (gradient**2 - state[k + 1])
            weights -= rate * (1 - step / (rounds + 1)) * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-6)
    return Scorer(sparse.astype(np.float32), solid[:SHAPES], float(solid[SHAPES]), float(solid[-1]))


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, carry: list[str] | None = None) -> DataFrame:
    """(id or the `carry` columns, p_good, evidence) for every row; see scored() for names that clash.

    evidence is the log-odds of good by the text alone, p_good adds the share of good documents.
    Null and wordless texts have p_good 0 and evidence minus infinity. Null and repeated ids pass through, repeated
    texts score alike, other columns are not read; an empty table gives an empty result. All
    words of a text count, however long it is.
    """
    own = scored(df, id_col, text_col, train_rows, [id_col] if carry is None else carry)
    return own.toDF(*([id_col] if carry is None else carry), "p_good", "evidence")


def scored(df: DataFrame, id_col: str, text_col: str, train_rows: int, names: list[str]) -> DataFrame:
    """The columns `names` as c0, c1, ..., then p_good and evidence, so that no name can clash."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    inner = [f"c{i}" for i in range(len(names))]
    target = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], F.col(text_col).alias("text"))
    scored_type = ", ".join(f"{c} {target.schema[c].dataType.simpleString()}" for c in inner) + ", p_good double, evidence double"

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern_of(Profile.of(t, _words)) for t in batch.column(0).to_pylist()], pa.int32())], names=["pattern"])

    found = docs.select("text").mapInArrow(votes, "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    seen = [(r.pattern, r.n) for r in found if r.pattern >= 0]
    if not seen:
        return target.select(*inner, F.lit(0.0).alias("p_good"), F.lit(-math.inf).alias("evidence"))
    patterns, counts = (np.array(x, np.int64) for x in zip(*sorted(seen)))
    posterior = dict(zip(patterns.tolist(), estimate(patterns, counts)[0].tolist()))
    cutoff = int(min(1.0, train_rows / counts.sum()) * (1 << 30))
    sample = docs.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 30)) < cutoff).select("text")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [Profile.of(t, _words).codes.tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary())], names=["codes"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = [Profile(np.frombuffer(c, np.uint64)) for batch in batches for c in batch.column(0).to_pylist() if c]
        if profiles:
            profiles.sort(key=lambda p: p.codes.tobytes())  # the same sums whatever the order of rows
            model = fit_scorer(profiles, np.array([posterior[pattern_of(p)] for p in profiles]))
            solid = np.append(model.shapes, [model.repeats, model.bias])
            yield pa.RecordBatch.from_arrays([pa.array([model.words.tobytes()], pa.binary()), pa.array([solid.tobytes()], pa.binary())], names=["words", "solid"])

    # a bounded sample, trained in one executor task
    model = sample.mapInArrow(coded, "codes binary").repartition(1).mapInArrow(fit, "words binary, solid binary").collect()
    if model:
        solid = np.frombuffer(model[0]["solid"])
        scorer = Scorer(np.frombuffer(model[0]["words"], np.float32), solid[:SHAPES], float(solid[SHAPES]), float(solid[-1]))
    else:
        share = sum(posterior[p] * n for p, n in seen) / sum(n for _, n in seen)
        scorer = Scorer(np.zeros(BUCKETS, np.float32), np.zeros(SHAPES), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    held = df.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([held.value.evidence(Profile.of(t, _words)) for t in batch.column(batch.num_columns - 1).to_pylist()], float)
            p = np.where(np.isinf(z), 0.0, 1 / (1 + np.exp(-np.clip(held.value.bias + z, -50, 50))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array(z, pa.float64())], names=[*inner, "p_good", "evidence"])

    return target.mapInArrow(score, scored_type)


def drop_low_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows and columns of df that the classifier does not reject.

    Null and wordless texts go; null and repeated ids and repeated rows are judged by their
    texts alone; an empty table stays empty; other columns pass through, whatever their names.
    """
    own = scored(df, id_col, text_col, train_rows, df.columns).where(F.col("evidence") >= least)
    return own.drop("p_good", "evidence").toDF(*df.columns)


def op4_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "p_good", (F.col("evidence") < LEAST).alias("is_rejected"))
