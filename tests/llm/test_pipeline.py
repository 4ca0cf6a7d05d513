import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_decontaminate import plain_leaks
from test_minhash import brute_classes
from test_quality import junk, plain_evidence
from quadrille.llm.packing import Encoder
from quadrille.llm.quality import LEAST

P = pytest.importorskip("public_tokenizers")
STOPS = "the of and to in that was is it for".split()


def prose(rng, n):
    words = [rng.choice(STOPS) if rng.random() < 0.35 else "".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(words))


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    rng = random.Random(2)
    item = prose(rng, 30)
    rows = [(i, prose(rng, rng.randint(30, 200))) for i in range(60)]
    rows += [(100 + i, " | ".join(w for w in prose(rng, 90).split() if w not in STOPS)) for i in range(12)]  # junk
    rows += [(200, rows[5][1]), (201, rows[6][1] + " extra"), (202, prose(rng, 50) + " " + item + " " + prose(rng, 50))]
    rows += [(203, prose(rng, 40) + " password = abcdefghijklmnop " + prose(rng, 40)), (204, None), (205, prose(rng, 3000))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    whole = {i for i, _ in rows}
    assert seen["quality"] == whole - set(range(100, 112)) - {204}
    assert seen["near_dedup"] == seen["quality"] - {200, 201}
    assert seen["decontamination"] == seen["near_dedup"] - {202} == seen["secret_scan"]
    clean = docs.where("doc_id = 203").first()
    assert "abcdefghijklmnop" not in clean.text and clean.n_chars == len(clean.text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    encoder = Encoder(P.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: len(encoder.encode(r.text)) // 4 + 1 for r in docs.collect()}
    assert {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == tokens
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


EXTRA = "p_good double, _text string, evidence int, class_id string, id long, key int, hash string, spans string, length int, piece int, c0 int"


def frames(spark, tmp_path, rows):
    """Documents with columns whose names the stages use inside, and a benchmark."""
    more = (0.5, "t", 1, "c", 7, 3, "h", "s", 4, 5, 6)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *more) for i, t in rows], schema)
    items = [(1, prose(random.Random(50), 30)), (2, None), (3, ""), (3, "x")]
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return frame, items


def test_stages_on_an_empty_table(spark, tmp_path):
    frame, _ = frames(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        assert out.count() == 0 and (out.columns == frame.columns or name == "packing")


def test_stages_equal_plain_versions_on_odd_rows(spark, tmp_path):
    rng = random.Random(21)
    item = prose(random.Random(50), 30)
    rows = [(i, prose(rng, rng.randint(25, 70)) if i % 6 else junk(rng, 60)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(1, 12)]  # ties: equal texts
    words = rows[7][1].split()
    rows += [(130, " ".join([*words, "tail"])), (131, " ".join(["head", *words])), (132, prose(rng, 20) + " " + item), (133, item)]
    rows += [rows[3], rows[3], (3, prose(rng, 40)), (140, None), (141, ""), (142, " \n"), (None, rows[5][1]), (None, rows[5][1]), (None, item), (143, prose(rng, 9000)), (144, "secret: " + "a" * 12)]
    frame, items = frames(spark, tmp_path, rows)
    stage = dict(corpus_pipeline.STAGES)
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    kept = stage["quality"](spark, frame, str(tmp_path))
    assert kept.schema == frame.schema
    wanted = [(r, e) for r, e in zip(rows, plain_evidence([t for _, t in rows]))]
    assert all(abs(e - LEAST) > 0.01 for _, e in wanted)
    assert seen(kept) == sorted((r for r, e in wanted if e >= LEAST), key=repr)

    kept = stage["near_dedup"](spark, frame, str(tmp_path))
    assert kept.columns == frame.columns
    classes = brute_classes(rows)
    first = {r for r in rows if r[0] is not None and classes[r[0]] == r[0]}
    assert seen(kept) == sorted([*first, *(r for r in rows if r[0] is None)], key=repr)

    kept = stage["decontamination"](spark, frame, str(tmp_path))
    assert kept.columns == frame.columns
    gone = {d for d, _ in plain_leaks(rows, items)}
    assert {132, 133, None} <= gone and seen(kept) == sorted((r for r in rows if r[0] not in gone), key=repr)

    kept = stage["secret_scan"](spark, frame, str(tmp_path))
    assert kept.columns == frame.columns and kept.count() == len(rows)
    assert all((r.n_chars is None) == (r.text is None) and (r.text is None or r.n_chars == len(r.text)) for r in kept.collect())
    assert [r.text for r in kept.where("doc_id = 144").collect()] == ["[assign]"]

    pieces = stage["packing"](spark, frame, str(tmp_path)).collect()
    assert sorted(repr(r.doc_id) for r in pieces if r.piece == 0) == sorted(repr(i) for i, _ in rows)
    room = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 1024


def test_run_is_its_stages(spark, tmp_path):
    rng = random.Random(30)
    rows = [(i, prose(rng, rng.randint(25, 70)) if i % 5 else junk(rng, 60)) for i in range(30)]
    frame, _ = frames(spark, tmp_path, rows + [(50, rows[1][1])])
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").collect()} == {i for i, _ in rows if i % 5}
