import random
from collections import Counter

import numpy as np

from quadrille.llm.common import components, merged
from quadrille.llm.minhash import bag_minhash, bag_minhashes, drop_near_duplicates, near_duplicates
from quadrille.llm.shingles import multiset, weighted_jaccard


def brute_shingles(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if size else Counter()


def brute_classes(rows):
    bags = [(i, brute_shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in bags}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(bags):
        for j, y in bags[:k]:
            if x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in parent}


def variants(rng, words, count, change):
    for _ in range(count):
        own = list(words)
        for _ in range(rng.randint(0, change)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        yield " ".join(own)


def test_multisets_equal_plain_ones():
    for text in ["a b c d e f a b c d e f", "Ä ä  x\n\ty z q", "one two", "", "Und " * 300]:
        mine, plain = multiset(text), brute_shingles(text)
        assert sorted(mine[1]) == sorted(plain.values())
    a, b = "a b c d e f g h i j", "a b c d e f g h i k"
    x, y = brute_shingles(a), brute_shingles(b)
    assert weighted_jaccard(multiset(a), multiset(b)) == sum((x & y).values()) / sum((x | y).values())


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    a = rng.integers(1, 9, len(h))
    b = np.where(rng.random(len(h)) < 0.8, a, rng.integers(1, 30, len(h)))
    x, y = bag_minhash(h, a, 4096), bag_minhash(h, b, 4096)
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    both = bag_minhashes([(h, a), (h[:3], a[:3]), (h, b)], 128)
    assert (both[0] == bag_minhash(h, a, 128)).all() and (both[2] == bag_minhash(h, b, 128)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.class_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(101, 160))
    for a, b in edges:
        assert a == b or got[a] == got[b]


def test_merged_labels(spark):
    labels = components(spark.createDataFrame([(1, 2), (3, 4), (4, 5), (8, 9)], "a long, b long"))
    more = merged(labels, spark.createDataFrame([(5, 2), (10, 9), (20, 21), (21, 22), (3, 5)], "a long, b long"), labels.count())
    assert {r.node: r.class_id for r in more.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8, 20: 20, 21: 20, 22: 20}


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "short", "short", "Short text", "Und " * 400, "Und " * 390, "Und " * 200]
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts += list(variants(rng, base, 40, 14))  # chains around the threshold
    for _ in range(6):
        texts += list(variants(rng, [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 400]))], 5, 3))
    shared = [f"p{k}" for k in range(150)]
    texts += [" ".join(shared + [f"q{rng.randrange(10**6)}" for _ in range(100)]) for _ in range(25)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k], "x", 0) for i, k in enumerate(order)]
    rows += rows[:3] + [(None, "short", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n int").repartition(5)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute_classes([r[:2] for r in rows])
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert near_duplicates(df.limit(0)).count() == 0


def test_unlinked_families_in_one_bucket_end(spark):
    rng = random.Random(11)
    shared = [f"p{k}" for k in range(300)]
    rows = []
    for family in "ab":
        own = shared + [f"{family}{k}" for k in range(60)]
        for k in range(50):
            rows.append((len(rows), " ".join([*own[: 300 + k % 3], f"{family}x{rng.randrange(10**9)}", *own[301 + k % 3 :]])))
    a, b = (brute_shingles(rows[k][1]) for k in (0, 50))
    assert 0.5 < sum((a & b).values()) / sum((a | b).values()) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df, bands=6, rows=1).collect()}
    assert got == brute_classes(rows) == {i: i // 50 * 50 for i in range(100)}


def counted(monkeypatch):
    """Pairs that reach verification, round by round."""
    from quadrille.llm import minhash

    rounds, plain = [], minhash.verified

    def verified(pairs, *rest):
        rounds.append(rest[-1])
        return plain(pairs, *rest)

    monkeypatch.setattr(minhash, "verified", verified)
    return rounds


def test_strangers_that_share_a_passage_do_not_meet_pair_by_pair(spark, monkeypatch):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(200)]
    found = {}
    for count in (60, 240):
        rows = [(i, " ".join([*[f"a{rng.randrange(10**8)}" for _ in range(40)], *passage, *[f"b{rng.randrange(10**8)}" for _ in range(rng.randrange(30, 60))]])) for i in range(count)]
        rounds = counted(monkeypatch)
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        monkeypatch.undo()
        assert got == {i: i for i in range(count)}
        found[count] = sum(rounds)
    assert found[240] <= 8 * found[60] + 240  # in proportion to buckets' members, not to pairs, which are 16 times as many


def test_large_group_of_edited_copies(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(140)]
    rows = list(enumerate(variants(rng, base, 250, 8)))  # many are too far from the original, and from each other
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 250, 10)]  # copies of copies, linked to those alone
    order = list(rows)
    rng.shuffle(order)
    rounds = counted(monkeypatch)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) > 20 and max(Counter(got.values()).values()) > 80
    assert sum(rounds) < len(rows) * (len(rows) - 1) / 2 / 8


def test_very_long_texts_and_ids_with_several_texts(spark):
    long = [f"v{k % 30011}" for k in range(60000)]
    rows = [(5, " ".join(long)), (3, " ".join([*long, "one", "more"])), (9, " ".join(f"u{k}" for k in range(60000)))]
    rows += [(7, "some text of a row whose id comes again"), (7, " ".join(long[:30]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(3, 3), (5, 3), (7, 7), (7, 7), (9, 9)]
