import numpy as np

from quadrille.llm.topk import cells_of, floored, top_k, top_splits


def brute(rows, query_ids, k):
    out = []
    for q, x in rows:
        if q in query_ids:
            cut = lambda v: max(-(2**63), min(2**63 - 1, v))
            scored = sorted((-cut(sum(int(a) * int(b) for a, b in zip(x, y))), i) for i, y in rows if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-9, 9, 6)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(300, 380)]  # ties and a shorter vector
    odd = [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")]), (404, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows + odd], "vec_id long, embedding array<double>, rank int, query_id string")
    got = top_k(df, df.where("vec_id % 20 = 0"), 7, shard_rows=90, leaf_rows=8).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, {i for i, _ in rows if i % 20 == 0}, 7)
    few = df.where("vec_id < 5")
    assert sorted(tuple(r) for r in top_k(few, few, 20).collect()) == brute(rows[:5], set(range(5)), 20)
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_whole_numbers_beyond_floating_point(spark):
    rows = [(0, [float(2**40), 1.0]), (1, [float(2**40), 3.0]), (2, [float(2**40), -3.0]), (3, [float(2**60), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df, df, 3).collect()) == brute(rows, {0, 1, 2, 3}, 3)


def test_cells_prune_shards_before_vectors_travel(spark, monkeypatch):
    from quadrille.llm import topk

    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (16, 4)) * 10
    rows = [(i, [float(v) for v in centres[i % 16] + rng.integers(-5, 6, 4)]) for i in range(1600)]
    sent, plain = [], topk.in_blocks

    def in_blocks(pairs, per_shard):
        sent.append((pairs.count(), pairs.select("id").distinct().count()))
        return plain(pairs, per_shard)

    monkeypatch.setattr(topk, "in_blocks", in_blocks)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, df.where("vec_id % 20 = 0"), 5, shard_rows=50, leaf_rows=8).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, {i for i, _ in rows if i % 20 == 0}, 5)
    queries, shards = 80, 32
    assert sent[0] == (queries, queries)
    assert sum(n for n, _ in sent) < queries * shards / 4


def test_splits_give_cells_of_like_size():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(4000, 5))
    found = np.bincount(cells_of(rows, top_splits(rows, 16)))
    assert len(found) == 16 and found.min() > 200
    same = np.ones((50, 3))
    assert cells_of(same, top_splits(same, 8)).tolist() == [0] * 50
    assert cells_of(np.zeros((0, 3)), top_splits(np.zeros((0, 3)), 1)).tolist() == []


def test_floored(spark):
    df = spark.createDataFrame([(1, [0.1, -0.1, 1e30, None, float("nan")])], "vec_id long, embedding array<float>")
    out = floored(df).first().embedding
    assert out[:2] == [6.0, -7.0] and out[2] > 6e31 and out[3] is None and np.isnan(out[4])
