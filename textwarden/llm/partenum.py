"""Jaccard join of word n-gram sets by PartEnum signatures.

Sets whose sizes can reach the similarity fall into the same size band or into adjacent ones. A
band instance covers two adjacent bands; its sets differ in at most ``k`` features if they are
similar. The feature domain is hashed into ``k // 2 + 1`` partitions, so one of them holds at
most one difference, and each partition into three cells: of the three pairs of cells, one then
agrees exactly. Each pair of cells is a signature, so similar sets share one; there is no
probability in it.

Two cells without features agree between any sets, so a signature of them joins a share of all
documents, and the pairs below it grow with the square of their number. Only the largest sets of
an instance can differ in ``k`` features, and larger sets have a few partitions more than they need;
so sets leave out their lightest partitions, as many as keep one with at most one difference between
any two similar sets (``Bands.spare``).

Sets that share a signature form a star around the smallest id, per input task first and then
over all, so no task or group pairs its members with each other. Star links are verified exactly
on the sets. Where members of one signature remain in different components, all their untested
pairs are verified too, so no link between components is lost. Equal sets are one class from the
start. Sets travel only for documents that occur in candidate pairs. Pairs of the rest are ruled
out before they become rows where the triangle inequality or a parity sketch shows that they
differ too much; neither can rule out a similar pair.

Defined results: a text with fewer words than a shingle is one shingle; without words the set is
empty, linked with nothing; rows without an id are linked with nothing and have no component.
Rows that repeat an id are one document. Ids must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from textwarden.llm.common import map_batches, salted_join, stored
from textwarden.llm.components import components

#: words of a shingle and the least Jaccard similarity of a link, unless the caller gives others
WORDS = 3
SIMILARITY = Fraction(9, 10)
CELLS = 3
#: of so many partitions even the largest sets of an instance can do without one, for which two more are made
SPARED = 24
#: a task stars its signatures when it holds this many
HELD = 1 << 19
#: texts that are taken out of a batch at a time
TEXTS = 512
#: filter of the documents in candidate pairs: 2 ** 24 bits, 2 MiB
FILTER_BITS = 24
_A, _B, _C, _D = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams (A-Z in lower case)."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    hashes = np.full(len(codes) - size + 1, np.uint64(size))
    for i in range(size):
        hashes = _mix(hashes * _A + codes[i:i + len(hashes)])
    return np.unique(hashes)


def highest(size: int, similarity: Fraction = SIMILARITY) -> int:
    """The largest set that can be similar to one of this size."""
    return size * similarity.denominator // similarity.numerator


class Bands:
    """Lower ends of the size bands: a band ends with the largest partner of its lowest size."""

    def __init__(self, similarity: Fraction = SIMILARITY):
        self.similarity, self.low = similarity, [1]

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(highest(self.low[-1], self.similarity) + 1)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def differences(self, instance: int) -> int:
        """Most differing features of similar sets in bands ``instance`` and ``instance + 1``."""
        self.of(self.low[min(instance, len(self.low) - 1)])
        while len(self.low) < instance + 3:
            self.low.append(highest(self.low[-1], self.similarity) + 1)
        s = self.similarity
        return int(2 * (self.low[instance + 2] - 1) * (1 - s) / (1 + s))

    def spare(self, size: int, partitions: int) -> int:
        """How many of an instance's partitions a set of this size can do without.

        Sets of x and y features are similar only if they differ in at most ``c (x + y)``, ``c = (1 - s) / (1 + s)``, so at
        most ``c (x + y) / 2`` partitions hold two differences or more. With ``m`` partitions, each set may leave out
        ``(m - 1 - floor(c x)) // 2``: whatever is even or odd, what both leave out and these are at most ``m - 1`` together.
        """
        num, den = self.similarity.numerator, self.similarity.denominator
        return (partitions - 1 - size * (den - num) // (den + num)) // 2


def signatures(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of a set in its two band instances, without those of its lightest partitions."""
    band = bands.of(len(hashes))
    out = []
    for instance in ([band - 1] if band else []) + [band]:
        k = bands.differences(instance)
        salt = np.uint64(instance * int(_D) % (1 << 64))
        if k == 0:  # only equal sets are similar
            out.append(_mix(np.array([np.bitwise_xor.reduce(_mix(hashes))]) + salt))
            continue
        parts = k // 2 + 1
        parts += 2 * (parts // SPARED)
        spread = _mix(hashes + salt)
        part = (spread >> np.uint64(20)) % np.uint64(parts)
        cell = (part * np.uint64(CELLS) + (spread & np.uint64(0xFFFFF)) % np.uint64(CELLS)).astype(np.int64)
        # sums of 40-bit weights in a fixed order: equal cells have equal sums; others are verified later
        weight = (_mix(spread ^ _D) >> np.uint64(24)).astype(np.float64) + 1
        sums = _mix(np.bincount(cell, weight, parts * CELLS).view(np.uint64)).reshape(parts, CELLS)
        place = np.arange(parts * CELLS, dtype=np.uint64).reshape(parts, CELLS)
        both = _mix(sums * _A + np.roll(sums, -1, axis=1))  # cells (0, 1), (1, 2), (2, 0)
        found, spare = _mix(both + _mix(place * _C + salt)), bands.spare(len(hashes), parts)
        if spare:
            count = np.bincount(cell, minlength=parts * CELLS).reshape(parts, CELLS)
            lightest = count.sum(axis=1) - count.max(axis=1)  # features of the lightest pair of cells
            found = found[np.argpartition(lightest, spare)[spare:]]
        out.append(found.ravel())
    return np.concatenate(out)


def _star(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (sig, doc), without repeats, and the smallest document of each row's signature."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    keep = np.append(True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])) if len(sig) else np.zeros(0, bool)
    sig, doc = sig[keep], doc[keep]
    first = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
    return sig, doc, doc[first][np.cumsum(first) - 1] if len(sig) else doc


def _rows(sig: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    other = pa.nulls(len(sig), pa.int64()) if b is None else pa.array(b)
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(a), other], ["sig", "a", "b"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS))


def _signed(batches: Iterator[pa.RecordBatch], words: int, similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """(sig, a, null) of the smallest document of each signature met, (sig, a, b) of the others."""
    bands, held, classes, size = Bands(similarity), [], {}, 0

    def flush():
        sig, doc, low = _star(np.concatenate([s for s, _ in held]), np.concatenate([d for _, d in held]))
        lead = doc == low
        yield _rows(sig[lead], doc[lead], None)
        yield _rows(sig[~lead], low[~lead], doc[~lead])

    for batch in _slices(batches):
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            hashes = shingles(text, words)
            if doc is None or not len(hashes):
                continue
            digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
            if digest in classes:  # equal sets are linked by their class
                continue
            classes[digest] = doc
            found = signatures(hashes, bands)
            held.append((found, np.full(len(found), doc, np.int64)))
            size += len(found)
            if size >= HELD:
                yield from flush()
                held, classes, size = [], {}, 0
    if held:
        yield from flush()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, a, b): (sig, a, b) of each further document of a signature."""
    last, low = None, None
    for batch in batches:
        sig, a = (np.asarray(c) for c in batch.columns[:2])
        alone = np.asarray(batch.column(2).is_null())
        if not len(sig):
            continue
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        lows = a[starts].copy()
        if sig[0] == last:
            lows[0] = low
        lead = np.repeat(lows, np.diff(np.append(starts, len(sig))))
        last, low = sig[-1], lows[-1]
        other = alone & (a != lead)
        b = np.asarray(batch.column(2).fill_null(0))
        yield _rows(np.concatenate([sig[other], sig[~alone]]), np.concatenate([lead[other], a[~alone]]),
                    np.concatenate([a[other], b[~alone]]))


def _measured(documents: DataFrame, words: int) -> DataFrame:
    """(id, n_shingles, class): the digest of each document's set."""
    def work(batches):
        for batch in _slices(batches):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())],
                ["id", "n_shingles", "class"])

    return map_batches(documents, work, "id long, n_shingles long, class binary")


def _of_documents(documents: DataFrame, ids: DataFrame, words: int, schema: str, build) -> DataFrame:
    """``build(set)`` of the documents with these ids; a bounded filter first, then an exact join."""
    code = F.xxhash64("id")
    byte = F.shiftrightunsigned(code, 3).bitwiseAND((1 << FILTER_BITS - 3) - 1)
    bits = (ids.groupBy(byte.alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(xxhash64(id) & 7 as int))")).alias("bits")))
    filter_ = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in bits.toArrow().to_pylist():  # at most one row per byte of the filter
        filter_[row["at"]] = row["bits"]
    shared = documents.sparkSession.sparkContext.broadcast(filter_)

    def work(batches):
        for batch in batches:
            codes = np.asarray(batch.column(2))
            at = codes.view(np.uint64) >> np.uint64(3) & np.uint64((1 << FILTER_BITS - 3) - 1)
            hit = np.flatnonzero(shared.value[at.astype(np.int64)] >> (codes & 7).astype(np.uint8) & 1)
            for part in np.array_split(hit, max(1, len(hit) // 256)):
                texts = batch.column(1).take(pa.array(part)).to_pylist()
                columns = build([shingles(t, words) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), *columns.values()],
                                                 ["id", *columns])

    found = map_batches(documents.filter("id IS NOT NULL").withColumn("code", code), work, f"id long, {schema}")
    return found.join(ids, "id")


def _sets_of(documents: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    return _of_documents(documents, ids, words, "set array<long>", lambda sets: {
        "set": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A set's parity bits, over one to two times as many cells as features.

    A feature that only one of two sets has flips one bit, so the bits that differ are at most as
    many as the features that differ. The halves of a sketch combine to the one of half the cells.
    """
    level = max(7, (len(hashes) - 1).bit_length())
    cells = (_mix(hashes ^ _D) & np.uint64((1 << level) - 1)).astype(np.int64)
    parity = (np.bincount(cells, minlength=1 << level) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def _sketches_of(documents: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, n, bits) of the documents with these ids."""
    return _of_documents(documents, ids, words, "n long, bits array<long>", lambda sets: {
        "n": pa.array([len(x) for x in sets], pa.int64()),
        "bits": pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))})


def _folded(bits: str, to: str) -> str:
    """A sketch at the length of the other one of a pair, which is the same or half of it."""
    half = f"cast(size({bits}) / 2 as int)"
    return (f"if(size({bits}) <= size({to}), {bits}, zip_with(slice({bits}, 1, {half}), "
            f"slice({bits}, {half} + 1, {half}), (a, b) -> a ^ b))")


def _flipped(x: str, y: str) -> str:
    """In how many bits two sketches differ."""
    return (f"aggregate(zip_with({_folded(x, y)}, {_folded(y, x)}, (a, b) -> bit_count(a ^ b)), 0, (s, v) -> s + v)")


def compared(documents: DataFrame, pairs: DataFrame, sizes: DataFrame, words: int = WORDS,
             similarity: Fraction = SIMILARITY) -> DataFrame:
    """(a, b, low, high, linked): bounds of the Jaccard distance, equal for all pairs that could be linked.

    Sizes rule out pairs first, then sketches of a hundredth of a set's size; sets travel only for the
    documents of the pairs that are left, once per document and the task that compares them.
    """
    num, den = similarity.numerator, similarity.denominator
    for c in "ab":
        pairs = pairs.join(sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")), c)
    bound = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    sized = stored(pairs.withColumn("possible", bound), "sized-pairs")
    ids = sized.filter("possible").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sketches = stored(_sketches_of(documents, ids, words).select("id", "bits"), "pair-sketches")
    seen = sized.filter("possible")
    for c, other in ("ba", "ab"):
        seen = salted_join(seen, sketches.select(F.col("id").alias(c), F.col("bits").alias(f"bits_{c}")), [c], F.col(other))
    seen = stored(seen.select("a", "b", "n_a", "n_b", F.expr(_flipped("bits_a", "bits_b")).alias("flips"))
                  .withColumn("possible", F.expr(f"flips * {den + num} <= (n_a + n_b) * {den - num}")), "sketched-pairs")
    near = seen.filter("possible").select("a", "b")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(_sets_of(documents, ids, words), "candidate-sets")
    left = salted_join(near, sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), ["b"], F.col("a"))
    both = salted_join(left, sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), ["a"], F.col("b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    linked = common * den >= union * num
    distance = 1 - common / union
    exact = both.select("a", "b", distance.alias("low"), distance.alias("high"), linked.alias("linked"))
    # sets of x and y features that differ in at least f have a distance of at least 2 f / (x + y + f)
    apart = seen.filter("NOT possible").select(
        "a", "b", F.expr("2 * flips / (n_a + n_b + flips)").alias("low"), F.lit(1.0).alias("high"), F.lit(False).alias("linked"))
    far = sized.filter("NOT possible").select(
        "a", "b", (1 - F.least("n_a", "n_b") / F.greatest("n_a", "n_b")).alias("low"), F.lit(1.0).alias("high"),
        F.lit(False).alias("linked"))
    return stored(exact.unionByName(apart).unionByName(far).groupBy("a", "b").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("linked").alias("linked")), "compared-pairs")


def _named(pairs: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """``column`` replaced by the class of that id, where it has one."""
    step = classes.select(F.col("id").alias(column), F.col("name").alias("_name"))
    return pairs.join(step, column, "left").withColumn(column, F.coalesce("_name", column)).drop("_name")


def _unsettled(documents: DataFrame, stars: DataFrame, met: DataFrame, label: DataFrame, words: int,
               similarity: Fraction) -> DataFrame:
    """Pairs (x, y) of one signature in different components that neither bound rules out.

    ``met`` has the distance of each star link. A member lies between bounds of distance from
    its signature's first document: exact for that one's own links, a sum and a difference for
    members that an input task had starred. Similar members have bounds at most ``1 - similarity`` apart, and
    sketches that differ in no more bits than similar sets differ in features. Both are tests of
    the join itself, so pairs that fail them never become rows.
    """
    apart = met.filter("part_x <> part_y")
    mixed = stars.join(apart.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_semi").select("sig").distinct()
    rows = stored(stars.join(mixed, "sig", "left_semi").join(
        met.select(F.col("x").alias("a"), F.col("y").alias("b"), "low", "high"), ["a", "b"]), "mixed-stars")
    head = rows.groupBy("sig").agg(F.min("a").alias("head"))
    rows = rows.join(head, "sig")
    top = rows.filter("a = head").groupBy("sig", F.col("b").alias("id")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    inner = (rows.filter("a <> head").join(top.select("sig", F.col("id").alias("a"), F.col("low").alias("low_a"),
                                                      F.col("high").alias("high_a")), ["sig", "a"])
             .select("sig", F.col("b").alias("id"), F.greatest(F.lit(0.0), F.col("low") - F.col("high_a"),
                                                              F.col("low_a") - F.col("high")).alias("low"),
                     (F.col("high") + F.col("high_a")).alias("high")))
    first = head.select("sig", F.col("head").alias("id"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    member = (top.unionByName(inner).unionByName(first).groupBy("sig", "id")
              .agg(F.max("low").alias("low"), F.min("high").alias("high"))
              .join(label.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left")
              .withColumn("part", F.coalesce("part", "id")))
    member = stored(member.join(head, "sig").join(
        label.select(F.col("node").alias("head"), F.col("component").alias("main")), "head", "left")
        .withColumn("main", F.coalesce("main", "head")), "members")
    member = member.join(stored(_sketches_of(documents, member.select("id").distinct(), words), "sketches"), "id")
    # of two parts, one is not the first document's
    columns = ("id", "part", "low", "high", "n", "bits")
    one = member.filter("part <> main").select("sig", *(F.col(c).alias(f"{c}_x") for c in columns))
    two = member.select("sig", *(F.col(c).alias(f"{c}_y") for c in columns))
    most = float(1 - similarity) + 1e-9
    num, den = similarity.numerator, similarity.denominator
    return (one.join(two, "sig").filter(
        f"part_x <> part_y AND low_x - high_y <= {most} AND low_y - high_x <= {most} "
        f"AND least(n_x, n_y) * {den} >= greatest(n_x, n_y) * {num} "
        f"AND {_flipped('bits_x', 'bits_y')} * {den + num} <= (n_x + n_y) * {den - num}")
            .select(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")).distinct())


def similar(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
            similarity: Fraction = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id) of every row; the component is the smallest id reachable by links.

    A link is a Jaccard similarity of at least ``similarity`` between the sets of ``words``-word shingles.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("id"),
                             F.col(text_col).cast("string").cast("binary").alias("text"))
    measured = stored(_measured(texts, words), "shingle-classes")
    known = measured.filter("id IS NOT NULL AND n_shingles > 0")
    sizes = known.select("id", F.col("n_shingles").alias("n"))
    lead = known.groupBy("class").agg(F.min("id").alias("name"), F.max("id").alias("last")).filter("name <> last")
    classes = stored(known.select("id", "class").distinct().join(lead.select("class", "name"), "class")
                     .filter("id <> name").select("id", "name"), "equal-sets")
    same = classes.select(F.col("name").alias("a"), F.col("id").alias("b"))

    stars = stored(map_batches(
        map_batches(texts, lambda batches: _signed(batches, words, similarity), "sig long, a long, b long").repartition("sig").sortWithinPartitions("sig", "a", "b"),
        _stars, "sig long, a long, b long"), "signature-stars")
    met = stars.select("a", "b").distinct().select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b")
    met = stored(_named(_named(met, "a", classes), "b", classes)
                 .select("x", "y", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "named-pairs")
    pairs = met.filter("a <> b").select("a", "b").distinct()
    found = compared(texts, pairs, sizes, words, similarity)
    label = components(found.filter("linked").select("a", "b").unionByName(same))

    # exact rest: members of one signature that are still in different components
    part = label.select("node", "component")
    spans = met.join(found, ["a", "b"], "left").select(
        "x", "y", F.coalesce("low", F.lit(0.0)).alias("low"),
        F.coalesce("high", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1.0)).alias("high"))
    for c in "xy":
        spans = (spans.join(part.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")), c, "left")
                 .withColumn(f"part_{c}", F.coalesce(f"part_{c}", c)))
    spans = stored(spans, "star-spans")
    if not spans.filter("part_x <> part_y").isEmpty():
        rest = _unsettled(texts, stars, spans, label, words, similarity).select(F.col("x").alias("a"), F.col("y").alias("b"))
        rest = (_named(_named(rest, "a", classes), "b", classes).filter("a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        rest = stored(rest.join(pairs, ["a", "b"], "left_anti"), "rest-pairs")
        if not rest.isEmpty():
            more = compared(texts, rest, sizes, words, similarity).filter("linked").select("a", "b")
            label = components(label.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    out = salted_join(measured, label.select(F.col("node").alias("id"), "component"), ["id"], F.col("class"), "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
