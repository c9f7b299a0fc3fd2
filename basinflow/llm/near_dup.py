"""Near-duplicate documents by HyperMinHash sketches.

A document is the set of its word shingles. Documents of equal sets are one class,
represented by its smallest id, so copies cost one aggregation. A class has a
sketch of REGISTERS buckets: a shingle's hash is drawn once, its leading part chooses
the bucket, the rest is its value there, and a bucket keeps of its smallest value the
number of leading zeros (6 bits) and the 10 bits that follow the leading one. A small
set leaves buckets empty. It is hashed anew, for those alone, in up to ROUNDS rounds;
what is then still empty takes the smallest of a hash of its own over the whole set. A
round counts for more than any value, so the register of two sets' union is always the
smaller one of theirs, and registers agree with the sets' Jaccard similarity whatever
their sizes. Rows of ROWS registers, compressed, are the LSH bands.

Candidates come from the buckets that a band shares. To keep a hot bucket linear,
a member is first compared with one pivot of its buckets only, each bucket's pivot
being its member that meets most others. Links that full sets confirm join
components. Buckets whose members are then all in one component are done; in the
others, members outside of the bucket's largest component meet all members in tiles
of bounded size, where the collision-corrected Jaccard estimate of the sketches drops
pairs clearly below the threshold. A pair is told once, by the first band that it
shares and towards the larger component. What is left, a member and another component
near it, is decided on the full sets of all that component's texts.

At a Jaccard similarity of 0.8, BANDS bands of ROWS registers miss a pair with
probability (1 - 0.8**5)**40 = 1.3e-7; the estimate drops a pair at the threshold
at five standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch
from .components import components

ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
MANTISSA_BITS = 10
#: Rounds in which hashes choose their bucket.
ROUNDS = 2
#: Members of one side of a tile, on average.
TILE = 128
#: Bytes of text of one side of a tile of full sets, on average.
TILE_BYTES = TILE * 3072

_MULTIPLIERS = hashing.constants(REGISTERS, 0x1234567)
_BAND_MULTIPLIERS = hashing.constants(ROWS, 0x7654321)
_SALTS = hashing.constants(BANDS, 0xABCDEF)
_ROUND_MULTIPLIERS = hashing.constants(ROUNDS, 0x13579BD)
#: First hash of each bucket, and the last hash of all, which counts as none.
_EDGES = np.array([min(-(-(k << 64) // REGISTERS), (1 << 64) - 1) for k in range(REGISTERS + 1)], np.uint64)


def smallest(shingle_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value of each register of a nonempty sorted set, and the round it is of."""
    low, rounds = np.zeros(REGISTERS, np.uint64), np.full(REGISTERS, ROUNDS, np.uint64)
    values, empty = shingle_set, np.arange(REGISTERS)
    for r in range(ROUNDS):
        if r:
            values = np.sort(hashing.mix(shingle_set * _ROUND_MULTIPLIERS[r]))
        # sorted hashes lie bucket by bucket, the smallest first
        first = np.searchsorted(values, _EDGES)
        new = empty[first[empty] < first[empty + 1]]
        # the place in the bucket is the fraction of hash x buckets
        low[new] = values[first[new]] * np.uint64(REGISTERS)
        rounds[new] = r
        empty = np.flatnonzero(rounds == ROUNDS)
        if not len(empty):
            return low, rounds
    low[empty] = np.iinfo(np.uint64).max
    for at in range(0, len(shingle_set), 512):
        part = hashing.mix(np.multiply.outer(shingle_set[at : at + 512], _MULTIPLIERS[empty]))
        low[empty] = np.minimum(low[empty], part.min(axis=0))
    return low, rounds


def codes(low: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Leading-zero counts and mantissa bits of registers' smallest values."""
    low = np.maximum(low, np.uint64(1))
    # without its last bits a long value is a float exactly
    exact = np.where(low >> np.uint64(53) > 0, low & ~np.uint64(0x7FF), low).astype(np.float64)
    part, exponent = np.frexp(exact)
    mantissa = ((2 * part - 1) * (1 << MANTISSA_BITS)).astype(np.uint64)
    # registers of different rounds agree by chance alone
    mantissa ^= rounds * np.uint64(0x95) & np.uint64((1 << MANTISSA_BITS) - 1)
    return (((64 - exponent).astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def registers(shingle_set: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a nonempty sorted set: leading-zero count and mantissa bits."""
    return codes(*smallest(shingle_set))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the registers along the last axis."""
    rows = regs.reshape(*regs.shape[:-1], BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return hashing.mix((rows * _BAND_MULTIPLIERS).sum(axis=-1, dtype=np.uint64) ^ _SALTS)


def collision_rate(bits: int = MANTISSA_BITS) -> float:
    """Chance that registers of two disjoint sets of equal size agree.

    The minimum of n uniform hashes is exponential at scale 1/n; a register cell of
    leading-zero count z and one mantissa is an interval. The rate is the sum of the
    squared cell probabilities; it hardly depends on n.
    """
    z = np.arange(1, 60)[:, None]
    left = 2.0**-z * (1 + np.arange(1 << bits)[None, :] / (1 << bits)) * 2**20
    width = 2.0**-z / (1 << bits) * 2**20
    p = np.exp(-left) * -np.expm1(-width)
    return float((p**2).sum())


def estimate(a: np.ndarray, b: np.ndarray, collisions: float) -> np.ndarray:
    """Collision-corrected Jaccard estimates between the register rows of a and b."""
    agree = np.stack([(b == row).sum(axis=1) for row in a]) / REGISTERS
    return (agree - collisions) / (1 - collisions)


_FEATURES = "row_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"


def _features(n: int, rule: hashing.WordRule):
    c1, c2 = hashing.constants(2, 99)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column(0), len(batch)
            if not size:
                continue
            number = np.zeros(size, np.int64)
            fp = np.zeros((size, 2), np.uint64)
            keys: list = [None] * size
            sketch: list = [None] * size
            low, rounds = np.ones((size, REGISTERS), np.uint64), np.zeros((size, REGISTERS), np.uint64)
            for r, s in hashing.shingle_sets(batch.column(1), rule, n):
                number[r] = len(s)
                if len(s):
                    fp[r] = hashing.mix(s * c1).sum(dtype=np.uint64), hashing.mix(s ^ c2).sum(dtype=np.uint64)
                    low[r], rounds[r] = smallest(s)
            for at in range(0, size, 256):
                regs = codes(low[at : at + 256], rounds[at : at + 256])
                bands = band_keys(regs).view(np.int64)
                for r in range(at, min(at + 256, size)):
                    if number[r]:
                        keys[r], sketch[r] = bands[r - at], regs[r - at].tobytes()
            signed = fp.view(np.int64)
            yield pa.record_batch([ids.cast(pa.int64()), pa.array(number), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["row_id", "n_shingles", "fp1", "fp2", "bands", "sketch"])

    return run


def _near_components(percent: int):
    """Tiles of members to (member, other component) where an estimate reaches the threshold less five deviations.

    Similar texts share many buckets: the one of their first common band tells of them. Of
    two that are both outside of its largest component, that of the smaller component does.
    """
    t = percent / 100
    least = t - 5 * np.sqrt(t * (1 - t) / REGISTERS)
    collisions = collision_rate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for key, members in zip(np.asarray(batch.column(0)), batch.column(1)):
                m = members.values
                side = np.asarray(m.field("side"))
                ids, comp, rank, size = (np.asarray(m.field(k)) for k in ("id", "comp", "rank", "n"))
                regs = np.frombuffer(b"".join(m.field("sketch").to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
                a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
                if not len(a) or not len(b):
                    continue
                differ = comp[a][:, None] != comp[b][None, :]
                x, y = size[a][:, None], size[b][None, :]
                differ &= (x == 0) | (y == 0) | (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
                p, q = rank[a][:, None], rank[b][None, :]
                differ &= (q > p) | ((q == p) & (comp[b][None, :] < comp[a][:, None]))
                rows = np.flatnonzero(differ.any(axis=1))
                if not len(rows):
                    continue
                near = (estimate(regs[a[rows]], regs[b], collisions) >= least) & differ[rows]
                i, j = np.nonzero(near)
                bands = band_keys(regs).view(np.int64)
                u, v = bands[a[rows[i]]], bands[b[j]]
                # texts of an id of several may be here without a common band
                here = (u == v).argmax(axis=1)
                told = (u[np.arange(len(i)), here] == key) | ~(u == v).any(axis=1)
                i, j = i[told], j[told]
                found.append(np.unique(np.stack([ids[a[rows[i]]], comp[b[j]]], 1), axis=0))
            out = np.unique(np.concatenate(found), axis=0)
            yield pa.record_batch([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["id", "other"])

    return run


def _linked_members(n: int, rule: hashing.WordRule, percent: int):
    """Groups of texts on two sides to the pairs across that full sets link.

    One lookup counts what a text shares with every text of the other side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in batch.column(0):
                m = members.values
                side, ids = np.asarray(m.field("side")), np.asarray(m.field("id"))
                sets = [s for _, s in hashing.shingle_sets(m.field("text"), rule, n)]
                other = [i for i in range(len(ids)) if side[i] == 0]
                if not other:
                    continue
                size = np.array([len(sets[i]) for i in other])
                pool = np.concatenate([sets[i] for i in other])
                owner = np.repeat(np.arange(len(other)), size)
                order = np.argsort(pool, kind="stable")
                pool, owner = pool[order], owner[order]
                for i in np.flatnonzero(side == 1):
                    first = np.searchsorted(pool, sets[i], side="left")
                    number = np.searchsorted(pool, sets[i], side="right") - first
                    at = np.repeat(first - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
                    shared = np.bincount(owner[at], minlength=len(other))
                    hit = np.flatnonzero((shared > 0) & (100 * shared >= percent * (size + len(sets[i]) - shared)))
                    us.append(np.full(len(hit), ids[i]))
                    vs.append(ids[np.array(other)[hit]])
            yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle_words: int = 5,
    percent: int = 80,
    rule: hashing.WordRule = hashing.SPACED,
) -> DataFrame:
    """Classes of near-duplicate documents.

    Returns (row_id long, n_shingles long, component_id long, kept boolean), one row
    per input row. Documents are linked if 100 * |A & B| >= percent * |A | B| over
    their distinct shingle sets; component_id is the smallest id reachable over links.
    A text of fewer words than a shingle is one shingle; a null, empty or blank text
    has none and is linked with nothing. Rows that share an id are one document with
    several texts: what any of them links is linked. A row without an id is its own
    class: component_id null, kept true. Columns besides the two named are not read.
    An empty table gives an empty result.
    """
    if percent < 50 or percent > 100:
        raise ValueError("percent must be 50 to 100: the bands are made for near duplicates")
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    feats = scratch.keep(source.mapInArrow(_features(shingle_words, rule), _FEATURES), "features")

    named = feats.where("row_id is not null and n_shingles > 0")
    fp = ["fp1", "fp2", "n_shingles"]
    # written, so that joins with it read plain exchanges and a class of many copies can be split
    classes = scratch.keep(named.groupBy(*fp).agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(*fp, "rep"), "classes")
    own_rep = F.coalesce("rep", "row_id")
    classed = scratch.keep(named.select("row_id", *fp).join(classes, fp, "left").select("row_id", own_rep.alias("rep")), "classed")
    member = scratch.keep(classed.groupBy("row_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("rows")), "members")
    repeated = not member.where("rows > 1").isEmpty()
    # an id whose rows have different texts links the classes of all its texts
    several = classed.withColumnRenamed("rep", "u").join(member.where("rep <> last"), "row_id").select("u", F.col("rep").alias("v")).where("u <> v").distinct()
    reps = named.join(classes, fp, "left").where(own_rep == F.col("row_id"))
    if repeated:
        reps = reps.dropDuplicates(["row_id", "fp1", "fp2"])
    reps = scratch.keep(reps.select(F.col("row_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch"), "sketches")

    # a key's salt tells its band
    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = scratch.keep(rows.join(shared, "key"), "buckets")
    # a bucket's pivot is its member that meets most others over all bands: the text that its copies stem from, mostly
    # an id whose texts differ in size has no one size: 0 passes every comparison of sizes
    sizes = reps.groupBy("id").agg(F.when(F.min("n") == F.max("n"), F.max("n")).otherwise(0).alias("n"))
    hubs = scratch.keep(buckets.groupBy("id").agg(F.sum("size").alias("hub")).join(sizes, "id"), "hubs")
    found = buckets
    buckets = scratch.keep(found.select("key", "id").join(hubs, "id"), "members")
    scratch.drop(found)
    pivots = buckets.groupBy("key").agg(F.max(F.struct("hub", (-F.col("id")).alias("m"), "n")).alias("best"))
    pivots = scratch.keep(pivots.select("key", (-F.col("best.m")).alias("pivot"), F.col("best.hub").alias("pivot_hub"), F.col("best.n").alias("pivot_n")), "pivots")

    def fits(x: Column, y: Column) -> Column:
        return (x == 0) | (y == 0) | (F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y))

    def every(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    def block(n: str, seed: int, content: str) -> Column:
        # texts of one id are dealt, too
        return F.array(F.pmod(F.xxhash64("id", content, F.lit(seed)), F.col(n)).cast("int"))

    # the same join at every size: texts are dealt by id, once
    texts = source.where("text is not null").join(hubs.select("id").hint("merge"), "id").select("id", "text")
    texts = texts.dropDuplicates(["id", "text"]) if repeated else texts
    texts = scratch.keep(texts.withColumn("bytes", F.greatest(F.octet_length("text"), F.lit(1))), "texts")

    def linked(ask: DataFrame, have: DataFrame, name: str) -> DataFrame:
        """(u, v): of every ``other``, the ids of ask that full sets link with ids of have; both are (id, other).

        An other's texts are dealt to tiles of bounded bytes, so each text is sent once for a
        tile of the other side, not once for each partner.
        """

        def tiles(side: DataFrame, n: str) -> DataFrame:
            return side.join(texts.select("id", "bytes"), "id").groupBy("other").agg(F.ceil(F.sum("bytes") / TILE_BYTES).cast("int").alias(n))

        plan = scratch.keep(tiles(have, "across").join(tiles(ask, "down"), "other"), f"{name}-plan")
        wanted = ask.withColumn("side", F.lit(1)).union(have.withColumn("side", F.lit(0))).join(plan, "other")
        at = wanted.join(texts.select("id", "text"), "id")
        asks = F.col("side") == 1
        at = at.withColumn("i", F.explode(F.when(asks, block("down", 3, "text")).otherwise(every("down"))))
        at = at.withColumn("j", F.explode(F.when(asks, every("across")).otherwise(block("across", 4, "text"))))
        groups = at.groupBy("other", "i", "j").agg(F.collect_list(F.struct("side", "id", "text")).alias("members")).select("members")
        found = scratch.keep(groups.mapInArrow(_linked_members(shingle_words, rule, percent), "u long, v long"), name)
        scratch.drop(plan)
        return found

    first = (
        buckets.join(pivots, "key").where(F.col("id") != F.col("pivot")).where(fits(F.col("n"), F.col("pivot_n")))
        .groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("bands"), F.first("pivot_hub").alias("hub"))
        .groupBy("id").agg(F.max(F.struct("bands", "hub", "pivot")).alias("best"))
        .select("id", F.col("best.pivot").alias("other"))
    )
    first = scratch.keep(first, "first")
    links = linked(first, first.select(F.col("other").alias("id"), "other").distinct(), "links")
    roots = scratch.keep(components(links.union(several), scratch), "roots")

    label = roots.select(F.col("node").alias("id"), "root")
    ranked = label.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("rank")), "root")
    marked = scratch.keep(buckets.join(ranked, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("comp"), F.coalesce("rank", F.lit(0)).alias("rank")), "marked")
    scratch.drop(pivots)
    parts = marked.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("key").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = mixed.select("key", F.col("main.comp").alias("main"), F.ceil(F.col("size") / TILE).cast("int").alias("across"), F.ceil((F.col("size") - F.col("main.k")) / TILE).cast("int").alias("down"))
    mixed = scratch.keep(mixed, "mixed")
    at = marked.join(mixed, "key").join(reps.select("id", "sketch"), "id")

    def side(k: int, *fields: str) -> Column:
        return F.struct(F.lit(k).alias("side"), *fields).alias("m")

    grid = ["key", "i", "j"]
    # a bucket's largest component asks nothing there, so it outranks all others
    at = at.withColumn("rank", F.when(F.col("comp") == F.col("main"), F.lit((1 << 63) - 1)).otherwise(F.col("rank")))
    outside = at.where("comp <> main").withColumn("i", F.explode(block("down", 1, "sketch"))).withColumn("j", F.explode(every("across"))).select(*grid, side(1, "id", "comp", "rank", "n", "sketch"))
    inside = at.withColumn("j", F.explode(block("across", 2, "sketch"))).withColumn("i", F.explode(every("down"))).select(*grid, side(0, "id", "comp", "rank", "n", "sketch"))
    tiles = outside.union(inside).groupBy(*grid).agg(F.collect_list("m").alias("members")).select("key", "members")
    near = scratch.keep(tiles.mapInArrow(_near_components(percent), "id long, other long").distinct(), "near")

    # those members against all texts of the other component
    whole = hubs.select("id").join(label, "id", "left").select("id", F.coalesce("root", "id").alias("other"))
    more = linked(near, whole.join(near.select("other").distinct(), "other", "left_semi").select("id", "other"), "more")
    final = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), scratch)

    scratch.drop(classes, classed, reps, hubs, buckets, texts, first, links, marked, mixed, near, more)
    labelled = member.select("row_id", "rep").join(final.select(F.col("node").alias("rep"), "root"), "rep", "left").select("row_id", F.coalesce("root", "rep").alias("component_id"))
    named_rows = feats.where("row_id is not null").select("row_id", "n_shingles").join(labelled, "row_id", "left").select("row_id", "n_shingles", F.coalesce("component_id", "row_id").alias("component_id"))
    unnamed = feats.where("row_id is null").select("row_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = named_rows.union(unnamed)
    return out.withColumn("kept", F.coalesce(F.col("row_id") == F.col("component_id"), F.lit(True)))
