"""Benchmark decontamination on canonical templates.

Words become template tokens: numbers, units and names (capitalised words inside a
sentence) turn into typed placeholders, all others into their lower-case letters. Windows
of template tokens of the corpus are hash-joined to those of the benchmark. Windows that
lie on one diagonal (document position minus item position) are one occurrence; their
changed slots must be consistent, each benchmark value standing for one document value and
the other way round, which tells a re-parameterised question from an accidental match. Where
they are not, windows without changed slots count by themselves if they cover two windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import cut
from quadrille.llm.shingles import mix

#: Tokens of a window; items of at least LEAST tokens that are shorter are one window.
WINDOW, LEAST = 8, 6
#: Literal tokens a window needs at least, as a share.
LITERAL_SHARE = 0.5
#: Distinct window hashes of a benchmark that executors hold as a filter (8 bytes each);
#: beyond, every window of the corpus goes into the join. The result is the same.
FILTER_HASHES = 2_000_000
#: Words a worker remembers at once.
MOST_WORDS = 200_000

# Words that stand for numbers, and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km mg g kg ml l s min h hz khz mhz ghz w kw v mv ma j kj mol pa kpa inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers centimeter centimeters millimeter millimeters gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros degree degrees percent % $ € £".split())
NUMBER = re.compile(r"([$€£]?)[+-]?\d+(?:[.,:/]\d+)*([A-Za-z%°]{0,3})", re.ASCII)
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
CAPITAL, ENDS, EMPTY = 4, 8, 16
MASK = np.uint64(31)


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") & ~31


class Words(dict):
    """A code for each white-space word: its hash with kind and context flags in the low bits."""

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        bare = EDGES.sub("", word)
        kept = bare or (word if word in UNITS else "")
        flags = ENDS if word.rstrip("\"')]»”’").endswith((".", "!", "?", ":")) else 0
        if not kept:
            code = flags | EMPTY
        elif NUMBER.fullmatch(bare) or bare.lower() in NUMBER_WORDS:
            code = _hash(kept.lower()) | flags | NUM
        elif kept.lower() in UNITS:
            code = _hash(kept.lower()) | flags | UNIT
        else:
            capital = kept[:1].isupper() and kept[1:].islower()
            code = _hash(kept.lower()) | flags | (CAPITAL if capital else 0)
        self[word] = code
        return code


PLACEHOLDERS = np.array([0] + [_hash(x) for x in ("<number>", "<unit>", "<name>")], np.uint64)


def template(words: list[str], codes: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template and raw token hashes, kinds, and the word numbers of the tokens; words of marks alone are no token."""
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    flags = (code & MASK).astype(np.int8)
    place = np.flatnonzero(flags & EMPTY == 0)
    ends = np.ones(len(words) + 1, bool)  # a text begins like a sentence
    ends[1:] = flags & ENDS != 0
    # marks alone pass on the sentence end before them
    kinds = flags[place] & 3
    name = (flags[place] & CAPITAL != 0) & ~ends[:-1][place] & (kinds == LITERAL)
    kinds[name] = NAME
    raw = code[place] & ~MASK
    return np.where(kinds == LITERAL, raw, PLACEHOLDERS[kinds]), raw, kinds, place


def windows(tokens: np.ndarray, kinds: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of `size` tokens with enough literals; of all raw windows if kinds is None."""
    count = len(tokens) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(count, size if kinds is not None else -size & 0xFFFFFFFF, np.uint64)
        for k in range(size):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += tokens[k : k + count]
        if kinds is None:
            return np.arange(count), mix(total)
        sums = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
        starts = np.flatnonzero(sums[size:] - sums[:-size] >= LITERAL_SHARE * size)
        return starts, mix(total[starts])


def slots(words: list[str], kinds: np.ndarray, place: np.ndarray, start: int, size: int) -> list[str]:
    """Values of the placeholders of a window, with their offsets."""
    return [f"{k}:{EDGES.sub('', words[place[start + k]]).lower()}" for k in range(size) if kinds[start + k] != LITERAL]


WINDOW_ROW = "hash long, start int, size int, raw boolean, slots array<string>"


def corpus_windows(docs: DataFrame, sizes: list[tuple[int, bool]], wanted: np.ndarray | None, least: int = LEAST) -> DataFrame:
    """(id, hash, start, size, raw, slots) of the windows whose hash is wanted (all if None).

    Sizes come with whether the window is raw: of lower-case tokens as they are, without slots. A
    raw window of fewer than `least` tokens is a whole text.
    """
    context = docs.sparkSession.sparkContext
    held = context.broadcast(wanted) if wanted is not None else None
    schema = f"id {docs.schema[0].dataType.simpleString()}, {WINDOW_ROW}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Words()
        if held is not None:
            known = held.value
            table = np.zeros(1 << 22, bool)
            table[known >> np.uint64(42)] = True
        for batch in batches:
            row, hashes, starts, lengths, raws, values = [], [], [], [], [], []

            def flush(column=batch.column(0)) -> pa.RecordBatch:
                out = [column.take(pa.array(row, pa.int64())), pa.array(np.array(hashes, np.uint64).astype(np.int64)), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(raws, pa.bool_()), pa.array(values, pa.list_(pa.string()))]
                for x in (row, hashes, starts, lengths, raws, values):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, names=["id", "hash", "start", "size", "raw", "slots"])

            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text or "").split()
                tokens, plain, kinds, place = template(words, codes)
                for size, raw in sizes:
                    if size < least and len(tokens) != size:
                        continue
                    start, value = windows(plain, None, size) if raw else windows(tokens, kinds, size)
                    if held is not None:
                        near = np.flatnonzero(table[value >> np.uint64(42)])
                        at = np.searchsorted(known, value[near])
                        near = near[known[np.minimum(at, len(known) - 1)] == value[near]]
                        start, value = start[near], value[near]
                    for s, h in zip(start.tolist(), value.tolist()):
                        row.append(i), hashes.append(h), starts.append(s), lengths.append(size), raws.append(raw)
                        values.append([] if raw else slots(words, kinds, place, s, size))
                if len(row) > 50_000:
                    yield flush()
            yield flush()

    return docs.mapInArrow(run, schema)


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(id, item_id, windows, is_exact) for every document and benchmark item that it holds.

    Null texts hold nothing. Raw windows find verbatim copies of every item, whatever its share
    of literals; items of fewer than `least` tokens are found where they are the whole text,
    and not searched in longer ones; rows with one id (or without) are judged together; other columns are not
    read; empty tables give an empty result. Long texts are searched whole.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    small = [(size, False) for size in range(least, window + 1)] + [(size, True) for size in range(1, window + 1)]
    sized = cut(corpus_windows(items, small, None, least))
    # a short item is searched by the window that is as long as it is
    longest = sized.groupBy("id", "raw").agg(F.max("size").alias("size"))
    sought = cut(sized.join(longest, ["id", "raw", "size"]).select(F.col("id").alias("item_id"), "hash", F.col("start").alias("item_start"), "size", "raw", F.col("slots").alias("item_slots")).distinct())
    hashes = sought.select("hash").distinct()
    wanted = None
    if hashes.count() <= FILTER_HASHES:
        wanted = np.sort(np.array([r[0] for r in hashes.collect()], np.int64).astype(np.uint64))
    sizes = sorted((r[0], r[1]) for r in sought.select("size", "raw").distinct().collect())
    if not sizes:
        kinds = [(id_col, docs.schema["id"].dataType), ("item_id", items.schema["id"].dataType)]
        none = T.StructType([T.StructField(n, t) for n, t in [*kinds, ("windows", T.LongType()), ("is_exact", T.BooleanType())]])
        return docs.sparkSession.createDataFrame([], none)
    found = corpus_windows(docs, sizes, wanted, least).distinct()
    met = found.join(sought, ["hash", "size", "raw"])
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda x: F.struct(F.regexp_replace(x.item_slots, r"^\d+:", "").alias("item"), F.regexp_replace(x.slots, r"^\d+:", "").alias("doc")))
    # values that stayed are evidence whatever became of their equals; only changed ones must be one to one
    changed = F.filter(pairs, lambda x: x.item != x.doc)
    met = met.select("id", "item_id", "start", (F.col("start") - F.col("item_start")).alias("diagonal"), changed.alias("changed"))
    runs = met.groupBy("id", "item_id", "diagonal").agg(
        F.count_distinct("start").alias("windows"), F.count_distinct(F.when(F.size("changed") == 0, F.col("start"))).alias("same"), F.array_distinct(F.flatten(F.collect_set("changed"))).alias("pairs")
    )
    one_way = lambda side: F.size(F.array_distinct(F.col(f"pairs.{side}"))) == F.size("pairs")
    whole = one_way("item") & one_way("doc")
    # more unchanged windows than one has tokens: two whole windows are verbatim, which needs no mapping
    good = runs.where(whole | (F.col("same") > window)).withColumn("windows", F.when(whole, F.col("windows")).otherwise(F.col("same")))
    return good.groupBy("id", "item_id").agg(F.max("windows").alias("windows"), F.max(F.size("pairs") == 0).alias("is_exact")).withColumnRenamed("id", id_col)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of df that hold no benchmark item."""
    leaks = find_leaks(df, benchmark, id_col, text_col).select(F.col(id_col).alias("_leak")).distinct()
    return df.join(leaks, df[id_col].eqNullSafe(leaks["_leak"]), "left_anti")


def op8_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: whether it holds benchmark items, which ones, and whether one is verbatim."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    leaks = cut(find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    by_doc = leaks.groupBy(F.col("doc_id").alias("d")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("windows").alias("windows"), F.max("is_exact").alias("is_exact"))
    joined = docs.select("doc_id").join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("is_contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("is_exact", F.lit(False)).alias("is_exact"))
