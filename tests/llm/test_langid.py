import math
import random
import zlib

import numpy as np

from quadrille.llm.langid import WINDOW, Direction, fold_of, identify, learn, train

ALPHABETS = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éüñßöàçèab"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    layer = Direction(rng.normal(size=(256, 9)), rng.normal(size=(9, 3)))
    codes, weight = rng.integers(97, 103, (6, 4)), rng.normal(size=(6, 3, 4))
    _, kept = layer.train_run(codes)
    d_in, d_rec = layer.back(codes, kept, weight)
    for array, gradient, places in ((layer.inputs, d_in, [(97, 0), (99, 4), (101, 8)]), (layer.recurrent, d_rec, [(0, 0), (4, 2), (8, 1)])):
        for at in places:
            old = array[at]
            values = []
            for step in (1e-6, -1e-6):
                array[at] = old + step
                values.append((layer.train_run(codes)[0] * weight).sum())
            array[at] = old
            assert abs((values[0] - values[1]) / 2e-6 - gradient[at]) < 1e-5


def test_window_run_equals_training_run():
    rng = np.random.default_rng(1)
    layer = Direction(rng.normal(size=(256, 6)).astype(np.float32), rng.normal(size=(6, 2)).astype(np.float32))
    codes = rng.integers(0, 256, (10, 5)).astype(np.uint8)
    assert np.allclose(layer.run(codes), layer.train_run(codes)[0], atol=1e-4)


def test_network_learns():
    rng = random.Random(0)
    rows = [(text(rng, k, 12).encode()[:90], i) for i, k in enumerate(ALPHABETS) for _ in range(60)]
    net = train([r for r, _ in rows], np.array([y for _, y in rows]), list(ALPHABETS), rounds=200, lanes=90)
    new = [(text(rng, k, n).encode(), i) for i, k in enumerate(ALPHABETS) for n in (3, 40, 900)]
    means = net.pooled([x for x, _ in new] + [b""])
    assert (means[:-1].argmax(axis=1) == [y for _, y in new]).all()
    assert np.allclose(means[:-1].sum(axis=1), 1, atol=1e-3) and (means[-1] == 0).all()


def test_operator(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, k, rng.randint(3, 60)), k) for i, k in enumerate(list(ALPHABETS) * 40)]
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "123 ... !", "cc"), (None, text(rng, "aa", 9), None), rows[0], (503, text(rng, "cc", 30000), None)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    network = learn(df.where(fold_of("doc_id") != 2), "doc_id", "text", "lang")
    got = identify(df, network).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: k for i, _, k in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth) >= 0.97 * (len(rows) + 1)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[500].score == 0
    assert by[None].lang_pred == "aa" and by[503].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got)
    folds = {r.doc_id: r.f for r in df.select("doc_id", fold_of("doc_id").alias("f")).collect()}
    assert all(folds[i] == zlib.crc32(str(i).encode()) % 4 for i in truth)
    assert learn(df.limit(0), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in identify(df, None).collect()} == {"und"}
    assert identify(df.limit(0), network).count() == 0


def test_rare_labels_are_not_learned(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, k, 10), k) for i, k in enumerate(["aa", "bb"] * 12)] + [(100 + i, text(rng, "cc", 10), f"slip{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn(df, "doc_id", "text", "lang", languages=2).languages == ["aa", "bb"]


def plain_states(layer, codes):
    """States of one direction, unit by unit."""
    units = layer.recurrent.shape[1]
    state, out = [0.0] * units, []
    w = layer.recurrent.tolist()
    for code in codes:
        x = layer.inputs[code].tolist()
        dot = lambda row, s: sum(a * b for a, b in zip(row, s))
        gate = lambda k: 1 / (1 + math.exp(-2 * (dot(w[k], state) + x[k])))
        z, r = [gate(k) for k in range(units)], [gate(units + k) for k in range(units)]
        held = [a * b for a, b in zip(r, state)]
        new = [math.tanh(dot(w[2 * units + k], held) + x[2 * units + k]) for k in range(units)]
        state = [s + a * (c - s) for s, a, c in zip(state, z, new)]
        out.append(state)
    return out


def plain_pooled(net, text):
    raw = text.lower().encode()
    sums = [0.0] * len(net.languages)
    for a in range(0, len(raw), WINDOW):
        window = raw[a : a + WINDOW]
        codes = window + b" " * (WINDOW - len(window))
        ahead, back = plain_states(net.forward, codes), plain_states(net.backward, codes[::-1])[::-1]
        for t in range(len(window)):
            both = ahead[t] + back[t]
            logits = [sum(a * b for a, b in zip(row, both)) + c for row, c in zip(net.output.tolist(), net.bias.tolist())]
            top = max(logits)
            parts = [math.exp(x - top) for x in logits]
            for k, x in enumerate(parts):
                sums[k] += x / sum(parts)
    return [x / len(raw) for x in sums]


def test_operator_equals_plain_loops(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, k, rng.randint(1, 40)), k) for i, k in enumerate(list(ALPHABETS) * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = learn(df, "doc_id", "text", "lang")
    for parts in (1, 7):
        for r in identify(df.repartition(parts), net).collect():
            want = plain_pooled(net, rows[r.doc_id][1])
            best = max(range(len(want)), key=want.__getitem__)
            assert r.lang_pred == net.languages[best] and abs(r.score - want[best]) < 1e-4
