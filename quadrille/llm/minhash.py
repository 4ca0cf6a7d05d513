"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

A shingle that occurs w times has weight w, discretised into unit levels. Levels are
covered by dyadic blocks [0,1), [1,2), [2,4), ...; each (shingle, block) owns a Poisson
process whose rate is the block's size times the signature length. A point falls on a
level of its block, halved down by hash bits, and counts if the level is below w; it then
bids for one signature component, which keeps the earliest point. Two multisets agree in
a component with probability equal to their weighted Jaccard similarity. Points are only
generated up to a time by which all components are expected to be filled (continued in
the rare other case), so a signature costs about m ln m points beyond one for each shingle.

Signatures are cut into bands; documents that share a band are candidates and are verified
on their whole multisets. Equal multisets are collapsed first. No bucket is compared pair
by pair: its members first meet one pivot. Only members of buckets that are then in several
classes go on, and meet through rare elements (a shingle and the number of its copy): a
pair at or above the threshold must share one of the rarest few elements of either side, where
elements that a single class holds come first, since they link to no other class. Members
whose rarest elements are all of that kind, as of documents that share a passage or were
edited apart, can have no link left and meet nobody.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bounded, components, cut, cut_round, gathered, merged, release, slices
from quadrille.llm.shingles import mix, multiset, weighted_jaccard

#: 44 bands of 6: a pair with similarity 0.8 is missed with probability 2e-6, and one with 0.5,
#: as documents that share a passage have, is in a band's bucket with probability 0.02.
BANDS, ROWS = 44, 6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Pivots of a cell in the first round over rare elements; each later round has 16 times as many.
PIVOTS = 16
#: Their number does not grow beyond this: cells are smaller.
MOST_PIVOTS = 1 << 30


def bag_minhashes(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """A row of m 64-bit point ids for each non-empty multiset (hashes, counts)."""
    with np.errstate(over="ignore"):
        hashes, counts = (np.concatenate(x) for x in zip(*sets))
        owner = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])
        total = np.bincount(owner, counts, len(sets))
        parts = [(mix(hashes ^ GOLDEN), owner, np.zeros(len(hashes), np.int64), np.ones(len(hashes), np.int64), counts)]
        level = 1
        while (more := np.flatnonzero(counts > level)).size:
            block = np.full(len(more), level)
            parts.append((mix(hashes[more] + GOLDEN * np.uint64(level + 1)), owner[more], block, block, counts[more]))
            level *= 2
        key, owner, low, size, weight = (np.concatenate(x) for x in zip(*parts))
        horizon = (np.log(m) + 3.0) / total
        scale = 1.0 / (m * size)
        now, drawn = np.zeros(len(key)), np.zeros(len(key), np.uint64)
        signature, best = np.zeros(len(sets) * m, np.uint64), np.full(len(sets) * m, np.inf)
        active = np.arange(len(key))
        while len(active):
            while len(active):
                step = min(64, max(1, 16384 // len(active)))
                numbers = drawn[active][:, None] + np.arange(1, step + 1, dtype=np.uint64)
                points = mix(key[active][:, None] + numbers * GOLDEN)
                gaps = -np.log(((points >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * scale[active][:, None]
                gaps[:, 0] += now[active]
                times = np.cumsum(gaps, axis=1) if step > 1 else gaps
                now[active], drawn[active] = times[:, -1], numbers[:, -1]
                row, column = np.nonzero(times <= horizon[owner[active]][:, None])
                who, t, p = active[row], times[row, column], points[row, column]
                lots = mix(p + GOLDEN)
                position = (lots >> np.uint64(32)).astype(np.int64) & (size[who] - 1)
                good = low[who] + position < weight[who]
                place = owner[who[good]] * m + ((lots[good] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
                t, p = t[good], p[good]
                np.minimum.at(best, place, t)
                first = best[place] == t
                signature[place[first]] = p[first]
                active = active[now[active] <= horizon[owner[active]]]
            short = ~np.isfinite(best).reshape(len(sets), m).all(axis=1)
            # the rest of these documents' points: a point past the old horizon was drawn but not used
            if not short.any():
                break
            again = np.flatnonzero(short[owner])
            horizon[short] *= 1.6
            now[again], drawn[again] = 0.0, 0
            active = again
        return signature.reshape(len(sets), m)


def bag_minhash(hashes: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """The signature of one non-empty multiset."""
    return bag_minhashes([(hashes, counts)], m)[0]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of each signature."""
    with np.errstate(over="ignore"):
        parts = signature.reshape(-1, bands, rows)
        key = np.tile(np.arange(bands, dtype=np.uint64) * GOLDEN, (len(parts), 1))
        for r in range(rows):
            key = mix(key * np.uint64(31) + parts[:, :, r])
    return key.astype(np.int64)


def signatures(docs: DataFrame, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, f1, f2, keys) of (id, text): shingle count, multiset fingerprint, band keys.

    Texts without a word have n = 0 and no keys.
    """
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, keys = [], [], [], []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in slices(texts, 200_000):
                sets = [multiset(x, words) for x in texts[lo:hi]]
                full = [x for x in sets if len(x[0])]
                own = iter(band_keys(bag_minhashes(full, bands * rows), bands, rows) if full else ())
                for hashes, counts in sets:
                    n.append(int(counts.sum()))
                    with np.errstate(over="ignore"):
                        times = counts.astype(np.uint64)
                        f1.append((mix(hashes) * times).sum(dtype=np.uint64).astype(np.int64))
                        f2.append((mix(hashes + GOLDEN) * times).sum(dtype=np.uint64).astype(np.int64))
                    keys.append(next(own) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "keys"]
            )

    return docs.mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float, rows: int) -> DataFrame:
    """The pairs (a, b), `rows` in number, whose whole multisets are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    full = left.join(bounded(pairs, rows), "a").join(right, "b").select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last: tuple = (None, None)
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if y != last[0]:
                    last = (y, multiset(y, words))
                if weighted_jaccard(multiset(x, words), last[1]) >= least:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    return full.mapInArrow(run, f"a {kind}, b {kind}")


def elements(texts: DataFrame, words: int) -> DataFrame:
    """(id, part, class_id, n, elements) of (id, class_id, text): elements are shingles with the number of their copy.

    Multisets become plain sets of elements, whose Jaccard similarity is the weighted one. `part`
    tells texts with one id apart.
    """
    kinds = [texts.schema[c].dataType.simpleString() for c in ("id", "class_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n, held = [], [], []
            for text in batch.column(2).to_pylist():
                hashes, counts = multiset(text, words)
                with np.errstate(over="ignore"):
                    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    own = mix(np.repeat(hashes, counts) + copy.astype(np.uint64) * GOLDEN)
                    part.append(int(mix(own).sum(dtype=np.uint64).astype(np.int64)))
                n.append(len(own)), held.append(own.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int64()), batch.column(1), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["id", "part", "class_id", "n", "elements"])

    return texts.select("id", "class_id", "text").mapInArrow(run, f"id {kinds[0]}, part long, class_id {kinds[1]}, n long, elements array<long>")


def rare_cells(held: DataFrame, least: float) -> DataFrame:
    """(element, id, n, reach, class_id) of `elements`: the rare elements through which a row may have links to other classes.

    All rows order their elements alike: those of a single class first, then by how many rows hold
    them. A pair meets at the first element that both hold; all they share comes from there on.
    `reach` is the largest size of a partner then: both sizes together are at most (1 + least) /
    least times what either has from there on. Elements whose reach is below any partner's size
    are left out, so about a ninth to a fifth of a row's elements stay, private ones counted.
    """
    each = held.select("id", "part", "class_id", "n", F.explode("elements").alias("element"))
    spread = each.groupBy("element").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count("*").alias("often")).where("low < high")
    met = each.join(spread.select("element", "often"), "element")
    own = met.groupBy("id", "part", "class_id", "n").agg(F.collect_list(F.struct("often", "element")).alias("shared"))
    size = F.size("shared")
    # private elements, which come first, and then `place` rarer ones are not in the overlap of a pair that first meets here
    reach = (1 + least) / least * (F.size("shared") - F.col("place")) - F.col("n") + 1e-6
    placed = own.select("id", "n", "class_id", "shared", F.posexplode(F.array_sort("shared")).alias("place", "e"))
    return placed.withColumn("reach", reach).where(F.col("reach") >= least * F.col("n") - 1e-6).select("e.element", "id", "n", "reach", "class_id")


def open_cells(cells: DataFrame, rows: int, passes: int = 2) -> DataFrame:
    """Those of at most `rows` rows that may link to another class of their cell, by classes, sizes and reaches."""
    for _ in range(passes):
        around = cells.groupBy("element").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.min("n").alias("small"), F.max("reach").alias("far"))
        cells = cells.join(bounded(around.where("low < high"), rows), "element").where("small <= reach and n <= far").select(cells.columns)
    return cells


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id) for every row; class_id is the smallest id of the row's class.

    A class is a connected component of links between rows whose multisets of
    `words`-word shingles have a weighted Jaccard similarity of `least` or more. Null and
    wordless texts are alone in their classes; texts of fewer words are one shingle; equal
    multisets are always in one class, repeated rows too; texts are read whole, however
    long, one at a time; a null id has a null class and takes no part. Other columns are not
    read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = cut(signatures(docs, words, bands, rows))
    same = ["f1", "f2", "n"]
    groups = known.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"))
    firsts = known.join(groups.select(*same, F.col("rep").alias("id")), [*same, "id"], "left_semi")
    # the smaller side of the exchange: one row for each text and band
    banded = firsts.select("id", "n", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("crowd")).where("low < high")
    members = cut(banded.join(shared.select("key", "crowd"), "key").dropDuplicates(["key", "id", "n"]))
    # members of large buckets come first as pivots: the original of a group of copies is among them
    first = members.groupBy("id").agg((-F.sum("crowd")).alias("first"))
    texts = cut(docs.where("text is not null").join(first.select("id"), "id", "left_semi"))
    members = members.join(first, "id").select("key", "id", "n", "first")
    pivots = members.groupBy("key").agg(F.min(F.struct("first", "id", "n")).alias("p"))
    met = cut(members.join(pivots, "key").where(F.col("id") != F.col("p.id")).select("key", "id", "n", "p"))
    near = F.least("n", "p.n") >= least * F.greatest("n", "p.n")
    pairs = met.where(near).select(F.least("id", "p.id").alias("b"), F.greatest("id", "p.id").alias("a")).distinct()
    tried = cut_round(pairs)
    many = tried.count()
    links = cut_round(verified(tried, texts, words, least, many))
    labels = components(links)
    held = labels.count()
    labelled = lambda rows: rows.join(bounded(labels.withColumnRenamed("node", "id"), held), "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    # the pivot has met all members; a bucket is finished when the others are in one class
    classed = labelled(met.select("key", "id"))
    unfinished = classed.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("key")
    left = classed.join(unfinished, "key", "left_semi").select("id", "class_id").distinct()
    cells = cut_round(rare_cells(cut(elements(texts.join(left, "id").select("id", "class_id", "text"), words)), least))
    rows = cells.count()
    cells = cut_round(gathered(open_cells(gathered(cells, rows), rows), rows))
    rows, count = cells.count(), PIVOTS
    while rows:
        part = F.pmod(F.xxhash64("element", "id"), F.lit(count))
        chosen = cells.groupBy("element", part.alias("part")).agg(F.min(F.struct("id", "n", "reach", "class_id")).alias("p")).select("element", "p")
        p = F.col("p")
        apart = (F.col("class_id") != p.class_id) & (F.col("n") <= p.reach) & (p.n <= F.col("reach")) & (F.least("n", p.n) >= least * F.greatest("n", p.n))
        pairs = cells.join(bounded(chosen, rows), "element").where(apart).select(F.least("id", p.id).alias("b"), F.greatest("id", p.id).alias("a")).distinct()
        fresh = cut_round(pairs.join(bounded(tried, many), ["a", "b"], "left_anti"))
        if found := fresh.count():
            fresh = gathered(fresh, found)
            more = cut_round(verified(fresh, texts, words, least, found))
            tried, many = tried.unionByName(fresh), many + found
            if not more.isEmpty():
                labels = merged(labels, more, held)
                held = labels.count()
        # pivots have met their cells
        rest = cells.join(bounded(chosen.select("element", p.id.alias("id")), rows), ["element", "id"], "left_anti")
        cells = cut_round(gathered(open_cells(labelled(rest.drop("class_id")).select(cells.columns), rows), rows))
        rows, count = cells.count(), min(16 * count, MOST_PIVOTS)
        release(spark)
    whole = known.select("id", *same).join(groups, same, "left")
    whole = whole.join(labels.select(F.col("node").alias("rep"), "class_id"), "rep", "left")
    lone = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "rep", "id"))
    return whole.select(F.col("id").alias(id_col), lone.alias("class_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of df without all but one row of each class; rows with null ids stay."""
    classes = near_duplicates(df, id_col, text_col, **options)
    kept = classes.where(F.col(id_col) == F.col("class_id")).select(id_col).distinct()
    rows = df.join(kept, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return rows.select(df.columns).unionByName(df.where(F.col(id_col).isNull()))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("is_kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
