import hashlib
import inspect
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quadrille.llm.quality import BUCKETS, LABELLERS, ORDINARY_MARKS, SHRINK, STOP_WORDS, TRAIN_ROWS, Profile, Words, classify, drop_low_quality, estimate, fit_scorer, pattern_of

STOPS = "the of and to in that was is it for".split()


def prose(rng, n):
    words = [rng.choice(STOPS) if rng.random() < 0.35 else "".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(words))


def junk(rng, n):
    words = prose(rng, n).split()
    kind = rng.randrange(4)
    if kind == 0:
        return " ".join(w + rng.choice(["&&&", "###", "$$$"]) for w in words)
    if kind == 1:
        return " | ".join(w for w in words if w not in STOPS)
    if kind == 2:
        return " ".join((w.upper() + "!!") for w in words)
    return " ".join(w for w in words[: n // 30 + 1] for _ in range(30))


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    right = {True: [0.95, 0.9, 0.97, 0.9, 0.99, 0.95, 0.9], False: [0.6, 0.3, 0.4, 0.3, 0.2, 0.9, 0.8]}
    votes = np.stack([np.where(truth, rng.random(len(truth)) < g, rng.random(len(truth)) >= b) for g, b in zip(right[True], right[False])], axis=1).astype(int)
    patterns, inverse, counts = np.unique((votes * 3 ** np.arange(len(LABELLERS))).sum(axis=1), return_inverse=True, return_counts=True)
    good, rate = estimate(patterns, counts)
    assert ((good[inverse] > 0.5) == truth).mean() > 0.95
    assert np.abs(rate[1] - right[True]).max() < 0.05


@pytest.mark.parametrize("text", [None, "", " \n", "...", "One", "x " * 100000])
def test_odd_texts_have_profiles(text):
    profile = Profile.of(text, Words())
    assert (pattern_of(profile) >= 0) == (profile.n > 0)


def test_classifier(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(4, 300)) if i % 6 else junk(rng, rng.randint(60, 300))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, rows[1][1]), rows[1], (1003, prose(rng, 40000))]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, pattern string, n int")
    got = classify(df).collect()
    assert len(got) == len(rows)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 600 and (r.p_good >= 0.5) != bool(r.doc_id % 6)]
    assert len(wrong) <= 3
    by = {r.doc_id: r.p_good for r in got}
    assert by[1000] == by[1001] == 0 and by[None] == by[1] and by[1003] > 0.5
    kept = drop_low_quality(df)
    assert kept.columns == df.columns and 480 < kept.count() < 520
    assert classify(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [1 / 3, 1 / 2])
def test_short_clean_documents_stay_whatever_the_others_are(spark, share):
    rng = random.Random(4)
    count = 600
    bad = int(count * share)
    rows = [(i, junk(rng, rng.randint(60, 300)) if i < bad else prose(rng, rng.randint(60, 300))) for i in range(count)]
    short = {1000: "tomorrow", 1001: "river", 1002: "over the hills", 1003: "Yes, of course."}
    df = spark.createDataFrame(rows + list(short.items()), "doc_id long, text string")
    kept = {r.doc_id for r in drop_low_quality(df).collect()}
    assert set(short) <= kept
    assert len([i for i in range(bad) if i in kept]) <= 3 and len([i for i in range(bad, count) if i not in kept]) <= 3


def test_training_is_not_cut():
    assert inspect.signature(fit_scorer).parameters["rounds"].default == 300 and TRAIN_ROWS == 10_000


def plain_words(text):
    """(bare lower-case word, flags) of each word."""
    out = []
    for word in (text or "").split():
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        odd = sum(not (c.isalnum() or c in ORDINARY_MARKS) for c in word)
        low = bare.lower()
        number = not bare.isalpha() and any(c.isdigit() for c in bare)
        out.append((low, (low in STOP_WORDS, odd > 1 or (odd == 1 and not bare), len(bare) > 1 and bare.isupper(), bare.istitle(), number, len(bare) > 20, word.endswith((".", ",", "?", "!")))))
    return out


def plain_votes(words):
    """One of True (good), False (bad) or None for each labeller."""
    n = len(words)
    share = lambda i: sum(f[i] for _, f in words) / n
    stops, marked, capitals, ends = share(0), share(1), share(2), share(6)
    repeats = sum(a[0] == b[0] for a, b in zip(words, words[1:])) / (n - 1) if n > 1 else 0.0
    return [
        marked <= 0.15,
        repeats <= 0.2 if n > 3 else None,
        capitals <= 0.5 if n > 3 else None,
        stops >= 0.05 if n >= 20 else None,
        len({w for w, _ in words}) / n >= 0.1 * min(1, 2000 / n) if n >= 20 else None,
        marked < 0.02 and repeats < 0.1 and capitals < 0.2 and (n < 20 or stops > 0.1),
        marked < 0.02 and repeats < 0.1 and 0.02 < ends < 0.5 if n > 3 else None,
    ]


def plain_posteriors(votes, rounds=100):
    """Expectation-maximisation document by document."""
    good = [0.05 if False in v else 0.95 for v in votes]
    for _ in range(rounds):
        weight = {True: sum(good), False: sum(1 - g for g in good)}
        prior = {c: (w + 1) / (len(votes) + 2) for c, w in weight.items()}
        rate = {c: [] for c in weight}
        for k in range(7):
            for c in weight:
                yes = sum(g if c else 1 - g for g, v in zip(good, votes) if v[k] is True)
                no = sum(g if c else 1 - g for g, v in zip(good, votes) if v[k] is False)
                rate[c].append((yes + 1) / (yes + no + 2))
        for i, v in enumerate(votes):
            log = {c: math.log(prior[c]) + sum(math.log(rate[c][k] if x else 1 - rate[c][k]) for k, x in enumerate(v) if x is not None) for c in weight}
            good[i] = 1 / (1 + math.exp(max(-50, min(50, log[False] - log[True]))))
    return good


def plain_evidence(texts, rounds=300, rate=0.5, decay=1e-4):
    """Evidence of each text: everything by loops over documents, words and weights."""
    docs = [plain_words(t) for t in texts]
    full = [d for d in docs if d]
    good = plain_posteriors([plain_votes(d) for d in full])

    def features(words):
        n, out = len(words), Counter()
        weight = n / (n + SHRINK)
        for low, flags in words:
            code = int.from_bytes(hashlib.blake2b(low.encode(), digest_size=8).digest(), "big") >> 7
            out["word", code % BUCKETS] += weight / n
            out["shape", flags] += weight / n
        out["repeats", 0] = weight * (sum(a[0] == b[0] for a, b in zip(words, words[1:])) / (n - 1) if n > 1 else 0.0)
        return out

    rows = [features(d) for d in full]
    share = min(0.99, max(0.01, sum(good) / len(good)))
    bias = math.log(share / (1 - share))
    weights, mean, square = Counter(), Counter(), Counter()
    score = lambda f: sum(v * weights[k] for k, v in f.items())
    for step in range(1, rounds + 1):
        gradient = Counter()
        for f, g in zip(rows, good):
            error = (1 / (1 + math.exp(-max(-50, min(50, score(f) + bias)))) - g) / len(rows)
            for k, v in f.items():
                gradient[k] += v * error
        for k in gradient:
            slope = gradient[k] + decay * weights[k]
            mean[k] += 0.1 * (slope - mean[k])
            square[k] += 0.01 * (slope**2 - square[k])
            weights[k] -= rate * (1 - step / (rounds + 1)) * (mean[k] / (1 - 0.9**step)) / (math.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return [score(features(d)) if d else -math.inf for d in docs]


def test_classifier_equals_plain_loops(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 60)) if i % 5 else junk(rng, rng.randint(20, 60)) for i in range(60)]
    texts += [None, "", "...", "One", texts[3], "a_b 12 x9 ÄÖ (ok) über-" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.evidence for r in classify(df).collect()}
    for i, want in enumerate(plain_evidence(texts)):
        assert got[i] == want or abs(got[i] - want) < 2e-3 * (1 + abs(want))


def test_names_that_clash_with_inner_ones(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80) if i % 3 else junk(rng, 80), 1.0, "a", 2, 3, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p_good double, _text string, evidence int, c0 int, pattern string")
    kept = drop_low_quality(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 3}
    assert {tuple(r)[2:] for r in kept.collect()} == {(1.0, "a", 2, 3, "b")}
    assert drop_low_quality(df.limit(0)).columns == df.columns
