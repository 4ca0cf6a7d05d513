import hashlib
import random

import numpy as np
import pytest

from quadrille.llm.substrings import Sizes, repeated_spans, sliding_minimum, smallest_owner, sort_suffixes, window_hashes, words_at


def brute(rows, size=50):
    """(id, removed spans, kept) of (id, bytes) rows."""
    first = {}
    for i, t in rows:
        if i is not None:
            for a in range(len(t) - size + 1):
                w = t[a : a + size]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - size + 1):
            if i is not None and first[t[a : a + size]] < i:
                gone[a : a + size] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        out.append((i, [tuple(map(int, e)) for e in edges], bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 99, 60)
    for width in (1, 2, 3, 27, 35):
        assert (sliding_minimum(x, width) == [x[i : i + width].min() for i in range(60 - width + 1)]).all()


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_are_sorted(seed):
    rng = random.Random(seed)
    seeds = [bytes(rng.choice(b"ab") for _ in range(rng.choice([60, 90]))) for _ in range(4)]
    parts = []
    for _ in range(40):
        t = bytearray(rng.choice(seeds))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(b"abc\xff\x00")
        parts.append(bytes(t[: rng.randint(50, len(t))]))
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths, owners = np.array([len(p) for p in parts]), np.array([rng.randrange(30) for _ in parts])
    starts = np.cumsum(lengths) - lengths
    at = np.concatenate([np.arange(s, s + n - 49) for s, n in zip(starts, lengths)])
    order, fresh = sort_suffixes(words_at(np.concatenate([data, np.zeros(58, np.uint8)])), at, 50)
    strings = [bytes(data[at[k] : at[k] + 50]) for k in order]
    assert strings == sorted(strings)
    assert fresh.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]
    context, offset, least = smallest_owner(data, lengths, owners, 50, most=(1 << 19, 7)[seed % 2])
    best = {}
    for c, o in zip(context, offset):
        w = parts[c][o : o + 50]
        best[w] = min(best.get(w, 99), owners[c])
    assert all(least[k] == best[parts[context[k]][offset[k] : offset[k] + 50]] for k in range(len(least)))


def test_words_and_window_hashes():
    raw = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 6, np.uint8)
    words = words_at(raw)
    assert [int(w) for w in words[:3]] == [int.from_bytes(bytes(raw[i : i + 8]), "big") for i in range(3)]
    found = window_hashes(words, np.arange(90), 50)
    assert (found[:26] == found[26:52]).all() and len(set(found[:26].tolist())) == 26


def test_rows_of_exchanges_follow_the_input():
    sizes = Sizes()
    for total in (51 << 20, 203 << 20, 30 << 30, 1 << 40, 100 << 40):
        runs = -(-total // sizes.run_for(total)) + total // (128 << 20)  # a part of a run for each task
        assert runs * sizes.buckets_for(total) <= 130 * sizes.buckets + total / 13 / sizes.row * 2


#: The defaults, and sizes at which blocks, runs, hot hashes and slices all matter.
SMALL = Sizes(block=900, run=4000, bucket=500, buckets=5, row=1, hot=2, windows=60, sent=700)


@pytest.mark.parametrize("sizes", [Sizes(), SMALL])
def test_removal_equals_brute_force(spark, sizes):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(25) for _ in range(4)] + ["x" * 50, "z" * 400]
    texts = [" ".join([prose(rng.randint(1, 40)), rng.choice(passages), prose(rng.randint(1, 40))]) for _ in range(60)]
    texts += [texts[3]] * 5 + [texts[3][:-1] + "é", "x" * 49, "x" * 51, "y" * 200, "y" * 120, passages[0][:50], passages[0][:49], None, "", "z" * 90 + "q" + "z" * 90]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    rows += rows[:4] + [(None, texts[3]), (None, texts[3]), (3, "other text " * 9), (-5, passages[1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, spans string").repartition(4)
    got = sorted((repr(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256, bytes(r.kept)) for r in repeated_spans(df, with_text=True, sizes=sizes).collect())
    raw = [(i, (t or "").encode()) for i, t in rows]
    want = sorted((repr(i), len(t), spans, hashlib.sha256(kept).hexdigest(), kept) for (i, t), (_, spans, kept) in zip(raw, brute(raw)))
    assert got == want
    assert repeated_spans(df.limit(0), sizes=sizes).count() == 0
