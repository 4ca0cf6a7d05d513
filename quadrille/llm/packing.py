"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most `capacity` tokens. Packing depends only on how many
pieces there are of each length, so the driver packs a histogram of at most `capacity`
rows, however large the corpus is: first Martello-Toth dominance reduction fixes small
sets that provably dominate every alternative, in bulk over equal lengths; best-fit
decreasing takes the shrunken rest. The patterns then become rank intervals per length,
and every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import cut

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Length of white space that is left to the tokenizers library.
SPACES = 2000
#: Mean pieces of a rank bucket.
BUCKET_ROWS = 4096


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian uint32 bytes.

    tiktoken applies the file's own vocabulary to ordinary text, which gives the same ids
    four times as fast; texts that hold one of its added tokens, or white space long
    enough to exhaust the fast matcher's stack, go to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves
        shown = printed + [b for b in range(256) if b not in printed]
        back = {chr(b if i < len(printed) else 256 + i - len(printed)): b for i, b in enumerate(shown)}
        ranks = {bytes(back[c] for c in word): rank for word, rank in self.library.get_vocab(with_added_tokens=False).items() if word not in self.added}
        self.spaces = re.compile(rf"\s{{{SPACES}}}").search
        self.fast = Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added) or len(text) > SPACES and self.spaces(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's own encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for every piece of every row.

    A document's ids end with `end_id`. Longer ones are cut into pieces of `capacity`
    whose first takes the remainder. Null and empty texts give one piece that holds
    `end_id` alone; very long texts are cut like any other; null or repeated ids pass
    through; other columns are not read; an empty table gives no piece.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = array("I", [end_id]).tobytes()
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                code = encoder.encode(text or "") + end
                total = len(code) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = code[4 * a : 4 * b]
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return rows.mapInArrow(run, schema)


class Histogram:
    """Counts per length, with neighbours by size."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] += count

    def largest(self, most: int, held: Counter) -> int:
        """The largest length up to `most` of which a piece is left besides `held`; 0 if none."""
        for length in np.flatnonzero(self.n[: max(most, 0) + 1])[::-1]:
            if self.n[length] > held[int(length)]:
                return int(length)
        return 0

    def smallest(self, count: int, held: Counter) -> list[int]:
        """The `count` smallest pieces besides `held`, fewer if there are fewer."""
        found: list[int] = []
        for length in np.flatnonzero(self.n):
            free = int(self.n[length]) - held[int(length)]
            found += [int(length)] * min(max(free, 0), count - len(found))
            if len(found) == count:
                break
        return found


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed because they dominate, as (lengths, how often), and the histogram left over.

    Lengths are taken from the largest on. With a piece j and room r = capacity - j:
    alone, if nothing fits beside it; with the largest k that fits, if k = r or no two
    pieces fit together; with a pair (a, b), if no three fit together, a is the largest
    that fits beside the smallest piece, b the largest that fits beside a, and no partner of
    j (alone, or larger and smaller of a pair) exceeds them. Any set with j can be
    exchanged for such a set without using more sequences.
    """
    left, fixed = Histogram(counts, capacity), []
    for j in range(capacity, 0, -1):
        while left.n[j]:
            held, room = Counter({j: 1}), capacity - j
            low = left.smallest(3, held)
            k = left.largest(room, held)
            if not k:
                pack = (j,)
            elif k == room or low[0] + (low[1] if len(low) > 1 else capacity) > room:
                pack = (j, k)
            else:
                pack = ()
                if len(low) < 3 or sum(low) > room:
                    a = left.largest(room - low[0], held)
                    b = left.largest(min(a, room - a), held + Counter({a: 1}))
                    widest = left.largest(min(a, room // 2), held)
                    if b and k <= a and widest <= b:
                        pack = (j, a, b)
            if not pack:
                break
            need = Counter(pack)
            often = min(int(left.n[x]) // c for x, c in need.items())
            for x, c in need.items():
                left.n[x] -= c * often
            fixed.append((pack, often))
    return fixed, {int(x): int(left.n[x]) for x in np.flatnonzero(left.n)}


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how many), ...) with how often, lengths from the largest on.

    Equal open sequences are kept as one entry with a count, so a step costs the same
    for one piece and for millions.
    """
    rooms: dict[int, Counter] = {}
    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            room = min((r for r in rooms if r >= size), default=0)
            if room:
                pattern, have = next(iter(rooms[room].items()))
            else:
                room, pattern, have = capacity, (), -(-todo // (capacity // size))
            each = room // size
            full = min(have, todo // each)
            rest = todo - each * full if full < have else 0
            for times, number in ((each, full), (rest, 1)):
                if times and number:
                    rooms.setdefault(room - times * size, Counter())[(*pattern, (size, times))] += number
            used = full + (rest > 0)
            todo -= each * full + rest
            if pattern:
                rooms[room][pattern] -= used
                if not rooms[room][pattern]:
                    del rooms[room][pattern]
                if not rooms[room]:
                    del rooms[room]
    return [(p, c) for group in rooms.values() for p, c in group.items()]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rank intervals (length, first, last + 1, times in a sequence, first sequence, offset)."""
    fixed, rest = dominance_reduction(counts, capacity)
    patterns = [(tuple(sorted(Counter(p).items(), reverse=True)), c) for p, c in fixed] + best_fit_decreasing(rest, capacity)
    used: Counter = Counter()
    sequence, rows = 0, []
    for pattern, often in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, used[length], used[length] + times * often, times, sequence, offset))
            used[length] += times * often
            offset += times * length
        sequence += often
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` of 1 to `capacity`.

    The histogram that reaches the driver and the intervals that are broadcast depend on
    `capacity` alone. Ranks are exact: within hash buckets of a length, after the counts of
    the buckets before, so that a frequent length is not one task's work. Which piece of
    equal length takes which place is arbitrary. `pieces` must be reproducible (written).
    """
    spark = pieces.sparkSession
    total = pieces.count()
    keys = [c for c in pieces.columns if c != "length"]
    buckets = max(8, total // BUCKET_ROWS)
    marked = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = marked.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    intervals = pack_histogram(histogram, capacity)
    places = spark.createDataFrame(intervals, "_length long, _lo long, _hi long, _times long, _first long, _offset long")
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    step = F.col("_rank") - F.col("_lo")
    return ranked.join(F.broadcast(places), here).select(
        *pieces.columns,
        (F.col("_first") + F.floor(step / F.col("_times"))).alias("sequence_id"),
        (F.col("_offset") + step % F.col("_times") * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """Every piece of every document with its sequence and offset; see token_pieces, pack_pieces."""
    return pack_pieces(cut(token_pieces(df, tokenizer, capacity, id_col=id_col)), capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
