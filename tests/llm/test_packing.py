import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm.packing import Encoder, best_fit_decreasing, dominance_reduction, pack_documents, pack_histogram, token_pieces

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")
TEXTS = [None, "", "a<|endoftext|>b", " \n\n x don't ''s", "é́ a​b 𝔘", " " * 30000 + "x", "Und Und " * 3000, "word salad"]


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_library():
    encoder = Encoder(FILE)
    for text in TEXTS:
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == reference_ids(text)[:-1]


def test_encoder_equals_library_on_a_whole_table():
    import pathlib

    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    table = pathlib.Path("/root/testdata/sf0.01/documents.parquet")
    if not table.exists():
        pytest.skip("the table is not here")
    encoder, library = Encoder(FILE), Tokenizer.from_file(FILE)
    for text in pq.read_table(table, columns=["text"])["text"].to_pylist():
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_histogram_packing_is_complete(seed):
    random.seed(seed)
    cap = random.choice([10, 30, 1024])
    counts = dict(Counter(random.randint(1, cap) for _ in range(random.choice([1, 40, 3000]))))
    rows = pack_histogram(counts, cap)
    used, fill = Counter(), Counter()
    for length, lo, hi, times, first, offset in rows:
        assert lo == used[length]
        used[length] = hi
        for q in range((hi - lo) // times):
            fill[first + q] += times * length
    assert used == counts
    assert max(fill.values()) <= cap
    assert len(fill) >= -(-sum(k * v for k, v in counts.items()) // cap)
    plain = sum(c for _, c in best_fit_decreasing(counts, cap))
    assert len(fill) <= plain + 1


def test_dominance_is_optimal_on_small_cases():
    def optimum(items, cap):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for seed in range(40):
        random.seed(seed)
        cap = random.randint(6, 20)
        items = sorted((random.randint(1, cap) for _ in range(8)), reverse=True)
        fixed, rest = dominance_reduction(dict(Counter(items)), cap)
        left = [x for x, c in rest.items() for _ in range(c)]
        assert sum(c for _, c in fixed) + optimum(sorted(left, reverse=True), cap) == optimum(items, cap)


def test_operator(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "word salad", None, 3)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    got = pack_documents(df, FILE).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        ids = reference_ids(text)
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 1024 for p in pieces[1:]) and all(p.length <= 1024 for p in pieces)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert len(by[None]) == 2
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    assert pack_documents(df.limit(0), FILE).count() == 0
    assert token_pieces(df, FILE, with_ids=True).where(F.length("ids") != F.col("length") * 4).count() == 0
