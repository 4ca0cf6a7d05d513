"""Removal of byte substrings that also occur in earlier documents, by suffix sorting.

Texts go to blocks of bounded size in the shared folder, and a task's consecutive blocks
form runs. Every window of `size` bytes is represented by the smallest hash of its 24-byte
substrings, which equal windows share. Runs exchange these hashes and learn which of them
occur elsewhere; only windows with such a hash go on. They are dealt out by their hash, as
the short contexts that hold stretches of them, and each task sorts the suffixes that begin there: a
multikey quicksort over 8-byte characters to a shallow depth, then blind tries for groups
that share a longer prefix. Neighbours that agree over `size` bytes are one substring, whose
smallest document number goes back to the blocks.

Equal contexts of a block travel once, so a passage that every document holds costs one
entry for each block. The windows of a hash with very many contexts are dealt out once
more by a hash of the whole window, on which equal windows agree, and a task sorts windows
in slices by that hash too. Rows of the exchanges hold some hundred hashes at least
on average, so their number follows the input, not blocks times buckets.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checkpoint_dir, cut
from quadrille.llm.shingles import mix

#: Length of the hashed substrings; bytes that the quicksort compares.
GRAM, SHALLOW = 24, 16
#: Stands for the number of a document without one: never smaller than another.
NOBODY = 2**63 - 1


@dataclass(frozen=True)
class Sizes:
    """Bounds of memory; results do not depend on them."""

    #: Bytes of a block and of a run of blocks; mean bytes of text for each bucket of the exchanges.
    block: int = 2 << 20
    run: int = 64 << 20
    bucket: int = 4 << 20
    #: Buckets at least; hashes of a row at least, on average over full runs.
    buckets: int = 64
    row: int = 256
    #: Contexts of a hash beyond which its windows are dealt out by their whole content.
    hot: int = 1 << 14
    #: Windows that are sorted at once; bytes of contexts that are sent at once.
    windows: int = 1 << 19
    sent: int = 16 << 20

    def buckets_for(self, total: int) -> int:
        """A hash stands for about 13 bytes of text."""
        return max(self.buckets, min(total // self.bucket, self.run // (13 * self.row)))

    def run_for(self, total: int) -> int:
        """Small inputs are cut into enough runs for many tasks."""
        return min(self.run, max(self.block, total // 128))


def words_at(raw: np.ndarray) -> np.ndarray:
    """For each position, the 8 bytes from there on as one number, first byte highest: a view that overlaps itself."""
    return np.ndarray((len(raw),), ">u8", np.concatenate([raw, np.zeros(7, np.uint8)]), strides=(1,))


def taken(words: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Words at positions, as the machine's numbers."""
    return words[at].astype(np.uint64)


def depths(size: int) -> list[int]:
    """Offsets whose words cover a window."""
    return [*range(0, size - 7, 8)] + ([size - 8] if size % 8 else [])


def window_hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the whole window at each position."""
    key = np.full(len(at), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in depths(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + taken(words, at + k))
    return key


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values (one value fewer per unit of width)."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def spread(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash."""
    return ((mix(values) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Block:
    """Documents of a block, the runs of windows with one hash, and the distinct hashes in bucket order."""

    def __init__(self, ids: list[int | None], texts: list[bytes], size: int, buckets: int):
        self.size = size
        self.ids = np.array([NOBODY if i is None else i for i in ids], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.words = words_at(np.concatenate([self.raw, np.zeros(size + 8, np.uint8)]))
        inside = np.zeros(len(self.raw) + 2, np.int32)
        long = lengths >= size
        np.add.at(inside, self.starts[long], 1)
        np.add.at(inside, self.ends[long] - size + 1, -1)
        windows = np.flatnonzero(np.cumsum(inside)[: len(self.raw)])
        if not len(windows):
            self.run_start = self.run_count = self.run_doc = self.run_hash = np.zeros(0, np.int64)
            self.hashes, self.bucket = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        count = len(self.raw) - GRAM + 1
        with np.errstate(over="ignore"):
            gram = taken(self.words, slice(0, count)) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
            gram += taken(self.words, slice(8, count + 8))
            gram *= np.uint64(0xBF58476D1CE4E5B9)
            gram ^= gram >> np.uint64(32)
            gram += taken(self.words, slice(16, count + 16))
            gram = mix(gram) & ~np.uint64(1)
        low = sliding_minimum(gram, size - GRAM + 1)[windows]
        del gram, inside
        first = np.ones(len(windows), bool)
        first[1:] = (low[1:] != low[:-1]) | (windows[1:] != windows[:-1] + 1)
        at = np.flatnonzero(first)
        self.run_start, self.run_count = windows[at], np.diff(np.append(at, len(windows)))
        # a window next to the last of another document begins a run too
        self.run_doc = np.searchsorted(self.ends, self.run_start, "right")
        hashes, inverse = np.unique(low[at], return_inverse=True)
        bucket = spread(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes, self.bucket, self.run_hash = hashes[order], bucket[order], place[inverse]

    def in_several(self) -> np.ndarray:
        """For each distinct hash, whether documents of the block with different numbers hold it."""
        low, high = np.full(len(self.hashes), NOBODY), np.full(len(self.hashes), -NOBODY - 1)
        np.minimum.at(low, self.run_hash, self.ids[self.run_doc])
        np.maximum.at(high, self.run_hash, self.ids[self.run_doc])
        return low != high

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        at = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(self.bucket) else []
        for a, b in zip(at, np.append(at[1:], len(self.bucket)) if len(at) else []):
            yield int(self.bucket[a]), slice(int(a), int(b))

    def contexts(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs with a shared hash, the number of each one's distinct context, and each context's first run."""
        runs = np.flatnonzero(shared[self.run_hash])
        start, count = self.run_start[runs], self.run_count[runs]
        last = start + count - 1
        offsets = depths(self.size)
        with np.errstate(over="ignore"):
            key = self.run_hash[runs].astype(np.uint64) * np.uint64(31) + count.astype(np.uint64)
            for base in (start, last):
                for k in offsets:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + taken(self.words, base + k))
        # windows at both ends of a run cover its context unless it is very long; such runs stay apart
        apart = count > self.size
        key[apart] = mix(start[apart].astype(np.uint64))
        _, where, number = np.unique(key, return_index=True, return_inverse=True)
        other = where[number]
        same = (count == count[other]) & (self.run_hash[runs] == self.run_hash[runs][other])
        for base in (start, last):
            for k in offsets:
                same &= self.words[base + k] == self.words[base[other] + k]
        odd = np.flatnonzero(~same | (apart & (other != np.arange(len(runs)))))
        number[odd] = len(where) + np.arange(len(odd))
        return runs, number, np.append(where, odd)


def sort_suffixes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at `at`, by `size` bytes, and where a new string begins in it."""
    order = np.argsort(taken(words, at), kind="quicksort")
    fresh = np.ones(len(at), bool)
    current = taken(words, at[order])
    fresh[1:] = current[1:] != current[:-1]
    for depth in range(8, SHALLOW, 8):  # multikey quicksort: ties go on with the next character
        group = np.cumsum(fresh)
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(tied):
            return order, fresh
        part = order[tied]
        value = taken(words, at[part] + depth)
        inner = np.lexsort((value, group[tied]))
        order[tied] = part[inner]
        value, own = value[inner], group[tied]
        fresh[tied[1:]] |= (value[1:] != value[:-1]) & (own[1:] == own[:-1])
    # blind tries: members of a group branch off its first member at their first different byte
    deep = [d for d in depths(size) if d >= SHALLOW]
    group = np.cumsum(fresh)
    tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
    group = group[tied]
    while len(tied):
        head = np.append(True, group[1:] != group[:-1])
        pivot = order[tied[head]][np.cumsum(head) - 1]
        member = order[tied]
        common = np.full(len(tied), size, np.int64)
        less = np.zeros(len(tied), bool)
        byte = np.zeros(len(tied), np.int64)
        open_ = np.flatnonzero(member != pivot)
        for depth in deep:
            a, b = taken(words, at[member[open_]] + depth), taken(words, at[pivot[open_]] + depth)
            differ = a != b
            found = open_[differ]
            if len(found):
                x = a[differ] ^ b[differ]
                byte_at = np.zeros(len(x), np.int64)
                for k in range(1, 8):
                    byte_at += x < np.uint64(1) << np.uint64(64 - 8 * k)
                common[found], less[found] = depth + byte_at, a[differ] < b[differ]
                byte[found] = ((a[differ] >> (np.uint64(56) - np.uint64(8) * byte_at.astype(np.uint64))) & np.uint64(255)).astype(np.int64)
            open_ = open_[~differ]
            if not len(open_):
                break
        branch = np.where(common == size, 1 << 16, np.where(less, common << 8, (2 << 16) + ((size - common) << 8)) + byte)
        inner = np.lexsort((branch, group))
        order[tied] = member[inner]
        branch = branch[inner]
        begins = np.append(True, (branch[1:] != branch[:-1]) | (group[1:] != group[:-1]))
        fresh[tied] |= begins
        label = np.cumsum(begins)
        several = np.bincount(label)[label] > 1
        again = several & (branch != 1 << 16)  # the strings equal to the first member are done
        tied, group = tied[again], label[again]
    return order, fresh


def smallest_owner(data: np.ndarray, lengths: np.ndarray, owners: np.ndarray, size: int, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the contexts in turn: its context, its offset there, the smallest owner of its string.

    Slices of about `most` windows are sorted in turn; equal windows have one hash, so one slice.
    """
    counts = lengths - size + 1
    context = np.repeat(np.arange(len(lengths), dtype=np.int32), counts)
    first = np.cumsum(counts) - counts
    offset = (np.arange(len(context)) - np.repeat(first, counts)).astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    words = words_at(np.concatenate([data, np.zeros(size + 8, np.uint8)]))
    slices = -(-len(context) // most)
    part = np.zeros(len(context), np.uint16)
    if slices > 1:
        for lo in range(0, len(context), most):
            at = starts[context[lo : lo + most]] + offset[lo : lo + most]
            part[lo : lo + most] = window_hashes(words, at, size) % np.uint64(min(slices, 1 << 16))
    out = np.empty(len(context), np.int64)
    for k in range(max(1, min(slices, 1 << 16))):
        mine = np.flatnonzero(part == k) if slices > 1 else np.arange(len(context))
        if not len(mine):
            continue
        order, fresh = sort_suffixes(words, starts[context[mine]] + offset[mine], size)
        begin = np.flatnonzero(fresh)
        least = np.minimum.reduceat(owners[context[mine[order]]], begin)
        out[mine[order]] = np.repeat(least, np.diff(np.append(begin, len(mine))))
    return context, offset, out


def _place(folder: str, block: int, attempt: int) -> str:
    return f"{folder}/block-{block >> 24:06d}-{block & (1 << 24) - 1:07d}-{attempt}.parquet"


def _blocks(folder: str, row: dict, size: int, buckets: int) -> Iterator[Block]:
    """The blocks of a run in turn."""
    where, base = fs.FileSystem.from_uri(folder)
    for k in range(row["blocks"]):
        with where.open_input_file(_place(base, row["run"] + k, row["attempt"])) as source:
            table = pq.read_table(source)
        yield Block(table["id"].to_pylist(), table["text"].to_pylist(), size, buckets)


def _packed(x: np.ndarray | bytes) -> bytes:
    return pa.compress(x if isinstance(x, bytes) else x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, count: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=count * np.dtype(kind).itemsize, codec="zstd", asbytes=True) if count else b"", kind)


RUNS = "run long, attempt long, blocks int, bucket int, hashes binary, many binary"


def write_blocks(docs: DataFrame, folder: str, size: int, buckets: int, sizes: Sizes, run_bytes: int) -> DataFrame:
    """Writes blocks of (id, text); returns RUNS, a row for each run and bucket, one at least for each run.

    A run is a task's consecutive blocks, named by the first one's number. Each attempt of a
    task writes files of its own, and its rows name the attempt, so nothing is replaced. The
    lowest bit of a hash says that documents of its block share it; `many` lists the places and numbers
    of stretches of the hashes that have several in their block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        first, attempt = task.partitionId() << 24, task.taskAttemptId()
        number, ids, texts, held, sent = 0, [], [], 0, 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> None:
            nonlocal number, ids, texts, held
            with where.open_output_stream(_place(base, first + number, attempt)) as out:
                pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())}), out, compression="zstd", use_dictionary=False)
            block = Block(ids, texts, size, buckets)
            times = np.bincount(block.run_hash, minlength=len(block.hashes)).astype(np.int32)
            parts.append((block.hashes | block.in_several().astype(np.uint64), block.bucket.astype(np.uint16), times))
            number, ids, texts, held = number + 1, [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal sent
            hashes, bucket, times = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(bucket, kind="stable")
            hashes, bucket, times = hashes[order], bucket[order], times[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(2, np.int64)
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                often = np.flatnonzero(times[a:b] > 1).astype(np.int32)
                rows.append((first + number - len(parts), attempt, len(parts), int(bucket[a]) if len(bucket) else 0, hashes[a:b].tobytes(), np.append(often, times[a:b][often]).tobytes()))
            parts.clear()
            sent = 0
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["run", "attempt", "blocks", "bucket", "hashes", "many"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i), texts.append(t or b"")
                held += len(texts[-1])
                if held >= sizes.block:
                    sent += held
                    close()
                    if sent >= run_bytes:
                        yield emit()
        if ids:
            close()
        if parts:
            yield emit()

    return docs.mapInArrow(run, RUNS)


MASKS = "run long, attempt long, blocks int, bucket int, mask binary, ways binary"


def _shared(hot: int):
    def shared_of(table: pa.Table) -> pa.Table:
        """Masks of the hashes of one bucket that several documents hold; places and ways of the hot ones among them."""
        parts = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        many = [np.frombuffer(x, np.int32).reshape(2, -1) for x in table["many"].to_pylist()]
        whole = np.concatenate(parts)
        _, inverse, counts = np.unique(whole >> np.uint64(1), return_inverse=True, return_counts=True)
        several = counts > 1
        several[inverse[(whole & np.uint64(1)).astype(bool)]] = True
        starts = np.cumsum([0, *map(len, parts)])
        for s, (place, times) in zip(starts, many):
            np.add.at(counts, inverse[s + place], times - 1)
        ways = np.minimum(-(-counts // hot), 1 << 15).astype(np.int32)
        masks, hots = [], []
        for a, b in zip(starts, starts[1:]):
            own = inverse[a:b]
            masks.append(np.packbits(several[own]).tobytes())
            place = np.flatnonzero(several[own] & (ways[own] > 1)).astype(np.int32)
            hots.append(np.append(place, ways[own][place]).astype(np.int32).tobytes())
        return pa.table({c: table[c] for c in ("run", "attempt", "blocks", "bucket")} | {"mask": pa.array(masks, pa.binary()), "ways": pa.array(hots, pa.binary())})

    return shared_of


class Masks:
    """The masks of a run, read block by block in turn."""

    def __init__(self, rows: list[dict]):
        self.bits = {r["bucket"]: np.unpackbits(np.frombuffer(r["mask"], np.uint8)).astype(bool) for r in rows}
        self.ways = {r["bucket"]: np.frombuffer(r["ways"], np.int32).reshape(2, -1) for r in rows if r["ways"]}
        self.read = dict.fromkeys(self.bits, 0)

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash of the next block is shared, and in how many ways its windows are dealt out."""
        shared, ways = np.zeros(len(block.hashes), bool), np.ones(len(block.hashes), np.int32)
        for b, part in block.by_bucket():
            start = self.read[b]
            self.read[b] = end = start + part.stop - part.start
            shared[part] = self.bits[b][start:end]
            if b in self.ways:
                place, many = self.ways[b]
                lo, hi = np.searchsorted(place, (start, end))
                ways[part.start + place[lo:hi] - start] = many[lo:hi]
        return shared, ways


CONTEXTS = "bucket int, run long, pieces int, bytes long, about binary, data binary"
ANSWERS = "run long, rows long, answer binary"


def pieces_of(block: Block, shared: np.ndarray, ways: np.ndarray, buckets: int) -> tuple[np.ndarray, ...] | None:
    """Distinct contexts of a block, in pieces: bucket, context, first window in it, windows, smallest and largest document, first byte."""
    runs, number, first = block.contexts(shared)
    if not len(runs):
        return None
    doc = block.ids[block.run_doc[runs]]
    low, high = np.full(len(first), NOBODY), np.full(len(first), -NOBODY - 1)
    np.minimum.at(low, number, doc)
    np.maximum.at(high, number, doc)
    start, count, place = block.run_start[runs][first], block.run_count[runs][first], block.run_hash[runs][first]
    context, base, bucket = np.arange(len(first)), np.zeros(len(first), np.int64), block.bucket[place]
    many = np.flatnonzero(ways[place] > 1)
    if len(many):
        # windows of hot hashes go where their whole content sends them, neighbours together if they can
        owner = np.repeat(many, count[many])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
        way = (window_hashes(block.words, start[owner] + at, block.size) % ways[place[owner]].astype(np.uint64)).astype(np.int64)
        head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (way[1:] != way[:-1])))
        with np.errstate(over="ignore"):
            to = spread(block.hashes[place[owner[head]]] + way[head].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), buckets)
        plain = np.flatnonzero(ways[place] == 1)
        context, base, bucket = np.append(plain, owner[head]), np.append(base[plain], at[head]), np.append(bucket[plain], to)
        count = np.append(count[plain], np.diff(np.append(head, len(owner))))
    else:
        count = count.copy()
    return bucket, context, base, count, low[context], high[context], start[context] + base


def send_contexts(by_run: DataFrame, folder: str, size: int, buckets: int, sizes: Sizes) -> DataFrame:
    """CONTEXTS of a run's masks: pieces of contexts with the smallest and largest documents of the block that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("pieces", pa.int32()), ("bytes", pa.int64()), ("about", pa.binary()), ("data", pa.binary())])

        def flush(number: int, held: list) -> pa.RecordBatch:
            bucket, about, data = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1), np.concatenate([h[2] for h in held])
            length = about[3] + size - 1
            begin = np.cumsum(length) - length
            order = np.argsort(bucket, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])), len(order))
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                mine = order[a:b]
                own = length[mine]
                take = np.repeat(begin[mine] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                rows.append({"bucket": int(bucket[mine[0]]), "run": number, "pieces": len(mine), "bytes": len(take), "about": _packed(np.ascontiguousarray(about[:, mine])), "data": _packed(data[take])})
            return pa.RecordBatch.from_pylist(rows, kinds)

        for batch in batches:
            for row in batch.to_pylist():
                masks, held, weight = Masks(row["masks"]), [], 0
                for k, block in enumerate(_blocks(folder, row, size, buckets)):
                    found = pieces_of(block, *masks.of(block), buckets)
                    if found is None:
                        continue
                    bucket, context, base, count, low, high, start = found
                    length = count + size - 1
                    take = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
                    held.append((bucket, np.stack([np.full(len(context), k), context, base, count, low, high]), block.raw[take]))
                    weight += len(take)
                    if weight >= sizes.sent:
                        yield flush(row["run"], held)
                        held, weight = [], 0
                if held:
                    yield flush(row["run"], held)

    return by_run.mapInArrow(run, CONTEXTS)


def _answers(size: int, most: int):
    def answer(table: pa.Table) -> pa.Table:
        """For each run, (block, context, first window, windows, smallest document) where some document of the block is larger."""
        pieces = table["pieces"].to_pylist()
        about = np.concatenate([_unpacked(x, 6 * n, np.int64).reshape(6, n) for x, n in zip(table["about"].to_pylist(), pieces)], axis=1)
        data = np.concatenate([_unpacked(x, n, np.uint8) for x, n in zip(table["data"].to_pylist(), table["bytes"].to_pylist())])
        piece, offset, least = smallest_owner(data, about[3] + size - 1, about[4], size, most)
        begin = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (least[1:] != least[:-1])))
        count = np.diff(np.append(begin, len(piece)))
        piece, offset, least = piece[begin], offset[begin], least[begin]
        use = least < about[5][piece]
        piece = piece[use]
        rows = np.stack([about[0][piece], about[1][piece], about[2][piece] + offset[use], count[use], least[use]], axis=1)
        cuts = np.searchsorted(piece, np.cumsum([0, *pieces]))
        answers = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        return pa.table({"run": table["run"], "rows": pa.array([len(x) for x in answers], pa.int64()), "answer": pa.array([_packed(np.ascontiguousarray(x)) for x in answers], pa.binary())})

    return answer


def covered(block: Block, shared: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which bytes of the block are covered by strings that begin in a smaller document; rows are its answers."""
    runs, number, _ = block.contexts(shared)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    first, last = np.searchsorted(rows[:, 0], number), np.searchsorted(rows[:, 0], number, "right")
    times = last - first
    which = np.repeat(np.arange(len(runs)), times)
    row = rows[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    doc = block.ids[block.run_doc[runs[which]]]
    good = (row[:, 3] < doc) & (doc != NOBODY)
    begin = (block.run_start[runs[which]] + row[:, 1])[good]
    edges = np.zeros(len(block.raw) + 1, np.int32)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + row[good, 2] - 1 + block.size, -1)
    return np.cumsum(edges)[:-1] > 0


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, with_text: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """(id, n_bytes, spans, kept_sha256[, kept]) for every row.

    A byte is removed if it is covered by a string of `size` bytes that also begins in a row
    with a smaller id. `spans` are the maximal removed runs as (start, end) byte offsets,
    end exclusive, and `kept` are the remaining bytes. Null texts are empty; shorter ones
    lose nothing; rows with one id do not count as earlier for each other; rows with a
    null id lose nothing and are earlier than none; other columns are not read; an
    empty table gives an empty result. df must be reproducible (a scan or a written table).
    """
    if size < GRAM + 8:
        raise ValueError(f"size must be {GRAM + 8} at least")
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    if not folder.startswith("file:") and "://" not in folder:
        folder = "file://" + folder
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = sizes.buckets_for(total)
    hashes = write_blocks(docs, folder, size, buckets, sizes, sizes.run_for(total))
    masks = cut(hashes.groupBy("bucket").applyInArrow(_shared(sizes.hot), MASKS))
    by_run = masks.groupBy("run").agg(F.max("attempt").alias("attempt"), F.max("blocks").alias("blocks"), F.collect_list(F.struct("bucket", "mask", "ways")).alias("masks"))
    contexts = send_contexts(by_run, folder, size, buckets, sizes)
    answers = cut(contexts.groupBy("bucket").applyInArrow(_answers(size, sizes.windows), ANSWERS))
    whole = by_run.join(answers.groupBy("run").agg(F.collect_list(F.struct("rows", "answer")).alias("answers")), "run", "left")
    schema = f"`{id_col}` long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_text
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def results(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        spans, digests, kept = [], [], []
        for a, b in zip(block.starts, block.ends):
            own = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2).tolist() if own.any() else []
            spans.append([{"start": s, "end": e} for s, e in edges])
            rest = (block.raw[a:b][~own] if edges else block.raw[a:b]).tobytes()
            digests.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                kept.append(rest)
        ids = pa.array(block.ids, pa.int64(), mask=block.ids == NOBODY)
        columns = [ids, pa.array(block.ends - block.starts, pa.int64()), pa.array(spans, span_type), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, names=[id_col, "n_bytes", "spans", "kept_sha256"] + ["kept"] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                masks = Masks(row["masks"])
                found = np.concatenate([_unpacked(x["answer"], 5 * x["rows"], np.int64).reshape(-1, 5) for x in row["answers"] or []] or [np.zeros((0, 5), np.int64)])
                found = found[np.argsort(found[:, 0], kind="stable")]
                for k, block in enumerate(_blocks(folder, row, size, buckets)):
                    lo, hi = np.searchsorted(found[:, 0], (k, k + 1))
                    yield results(block, covered(block, masks.of(block)[0], found[lo:hi, 1:]))

    return whole.mapInArrow(run, schema)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
