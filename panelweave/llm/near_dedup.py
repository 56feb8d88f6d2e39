"""Near-duplicates by b-bit MinHash.

A document is the set of its five-word shingles. Equal sets collapse to one representative.
Each representative has 120 minima. Bands of five whole minima (at a threshold of 85 percent; of fewer at
lower ones) give the candidates; of each minimum four bits are packed into a signature, and the share of equal bits, corrected for equality
by chance, estimates the similarity of two representatives.

No bucket is expanded into pairs. In each bucket the representative that shares the most buckets
with others is the centre, and the others are compared with it by signature:

* at 0.3 or more they join its family; at 0.65 or more (at 85 percent) they also leave the bucket;
* a bucket whose remaining members all joined the same centre is done;
* of the others, the members outside the commonest family become centres, up to 64 at a time, and
  leave after they have met the rest, until no bucket has two families left.

One minus the similarity is a metric, so two sets of similarity 0.85 differ by at most 0.15 in their
distance from any third (of any other threshold likewise); a pair that is to be linked thus always lands in one family. In a family
the exact distance from its centre deals the members to zones 0.15 wide. Members of zone 0 are
linked to the centre and need no more comparison among each other; others can be linked
only within their zone and the next one, which are compared block by block: by signature first,
then on full sets, each block reporting a spanning forest of its links.

Two documents at the threshold share no band with a probability below one in a million; the signature
bounds (5.6 standard errors below the threshold, 0.19 at 85 percent) miss a link with a similar one.
All figures for 85 percent follow from the threshold by ``rows_of_band``, ``leave_from`` and ``estimate_floor``.

NULL ids link with nothing and have a NULL component; NULL or empty texts have no shingles and are
linked with nothing. Rows are linked by their texts, also where ids repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import Stages
from panelweave.llm.components import components
from panelweave.operators.joins import keyed_join

SHINGLE = 5
MINIMA, BITS = 120, 4
THRESHOLD = 85  # percent
#: Thresholds that the bounds below cover.
THRESHOLDS = range(60, 100)
FAMILY = 0.3
#: Most minima of a band, and the probability with which a pair at the threshold may share none.
ROWS, MISSED = 5, 1e-6
#: Centres that a bucket gets in each round after the first.
CENTRES = 64
#: Members of a family that one side of a comparison block holds.
BLOCK = 512
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000

_A2Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def rows_of_band(percent: int) -> int:
    """Minima of one band: the most with which a pair at the threshold shares a band nearly always."""
    if percent not in THRESHOLDS:
        raise ValueError(f"a threshold of {percent} percent is not from {THRESHOLDS[0]} to {THRESHOLDS[-1]}")
    return max(r for r in range(1, ROWS + 1) if MINIMA % r == 0 and (1 - (percent / 100) ** r) ** (MINIMA // r) < MISSED)


def leave_from(percent: int) -> float:
    """What is so similar to a centre has all its links in the centre's family, with 0.2 for the estimates' errors."""
    return FAMILY + (100 - percent) / 100 + 0.2


def estimate_floor(percent: int) -> float:
    """A pair whose signatures estimate less than this is not compared on full sets."""
    chance = 1 / (1 << BITS)
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - 5.6 * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)


class _Words(dict):
    """Hash of each word, remembered within a worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer words, one for the whole sequence."""
    words = (text or "").encode().translate(_A2Z).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    length = min(size, len(words))
    total = np.full(len(words) - length + 1, length, np.uint64)
    for k in range(length):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(total)])
    return np.unique(total)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    shape = MINIMA
    return random.integers(1, 1 << 32, shape, np.uint32) | np.uint32(1), random.integers(0, 1 << 32, shape, np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * a + b).min(axis=0), out=low)
    return low


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The lowest four bits of each minimum, two to a byte; well-mixed first, as low bits of a product are poor."""
    bits = ((low * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return bits[0::2] << np.uint8(4) | bits[1::2]


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis): equal four-bit cells, less those equal by chance."""
    differ = x ^ y
    equal = ((differ & 0x0F) == 0).sum(axis=-1, dtype=np.int32) + ((differ & 0xF0) == 0).sum(axis=-1, dtype=np.int32)
    chance = 1 / (1 << BITS)
    return (equal / MINIMA - chance) / (1 - chance)


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def sketches(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, bands and bits of every row."""
    schema = T.StructType([docs.schema["doc_id"]]).add("text_hash", "long").add("n_shingles", "long").add("set_hash", "binary").add("bands", T.ArrayType(T.LongType())).add("bits", "binary")

    rows = rows_of_band(percent)
    bands = MINIMA // rows

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _multipliers()
        weight = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        for batch in batches:
            out = []
            for text in batch["text"]:
                own = shingle_set(text)
                low = minima(own, a, b)
                band = _mixed((low.reshape(bands, rows).astype(np.uint64) * weight).sum(axis=1) + np.arange(bands, dtype=np.uint64))
                out.append((len(own), _digest(own), band.astype(np.int64), packed_bits(low).tobytes()))
            found = pd.DataFrame(out, columns=schema.names[2:], index=batch.index)
            yield pd.concat([batch[["doc_id", "text_hash"]], found], axis=1)

    return docs.select("doc_id", _text_hash(), "text").mapInPandas(sketch, schema)


@F.pandas_udf(T.DoubleType())
def _estimated(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype=float)
    shape = (len(x), -1)
    return pd.Series(estimate(np.frombuffer(b"".join(x), np.uint8).reshape(shape), np.frombuffer(b"".join(y), np.uint8).reshape(shape)))


def _similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the estimated similarity to pairs (doc, centre)."""
    own, theirs = classes.select(F.col("node").alias("doc"), "bits"), classes.select(F.col("node").alias("centre"), F.col("bits").alias("centre_bits"))
    return pairs.join(own, "doc").join(theirs, "centre").select("doc", "centre", _estimated("bits", "centre_bits").alias("similar"))


def _open_buckets(active: DataFrame) -> DataFrame:
    """The rows (bucket, doc, label) of buckets whose members have different labels."""
    mixed = active.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return active.join(mixed.select("bucket"), "bucket")


def families(classes: DataFrame, stages: Stages, percent: int = THRESHOLD) -> DataFrame:
    """Chains (a, b) of a member and a centre that belong to one family. ``classes``: node, bands, bits."""
    # One row for each band of each class; Spark sizes them as one row for each class, and would broadcast them.
    members = classes.select(F.col("node").alias("doc"), F.explode("bands").alias("bucket")).hint("merge")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stages.write(members.join(shared, "bucket"), "buckets")
    active = stages.unsent(buckets)
    weight = active.groupBy("doc").agg(F.sum("n").alias("weight"))
    heaviest = active.join(weight, "doc").groupBy("bucket").agg(F.max(F.struct("weight", "doc")).alias("c"))
    led = stages.write(
        active.select("bucket", "doc").join(heaviest.select("bucket", F.col("c.doc").alias("centre")), "bucket").where("doc != centre"), "led"
    )
    stages.drop(buckets)
    chains, leave = [], leave_from(percent)
    label = F.when(F.col("similar") >= FAMILY, F.col("centre")).otherwise(F.col("doc")).alias("label")
    own_label = None
    while True:
        judged = stages.write(_similar(led.select("doc", "centre").distinct(), classes), "judged")
        chains.append(judged.where(F.col("similar") >= FAMILY).select(F.col("doc").alias("a"), F.col("centre").alias("b")))
        seen = stages.unsent(led).join(judged, ["doc", "centre"])
        if own_label is None:
            left = seen.where(F.col("similar") < leave).select("bucket", "doc", label)
        else:
            # What has been a centre, or is close to one, has met all that it could be linked with in its bucket.
            near = seen.where(F.col("similar") >= leave).select("bucket", "doc")
            gone = near.unionByName(led.select("bucket", F.col("centre").alias("doc"))).distinct()
            left = own_label.join(gone, ["bucket", "doc"], "left_anti")
        own_label = stages.write(_open_buckets(left), "open")
        stages.drop(led)
        if own_label.isEmpty():
            break
        own_label = stages.unsent(own_label)
        # Members that share the commonest label of their bucket are one family; the others are centres by and by.
        sizes = own_label.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        common = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("c")).select("bucket", F.col("c.label").alias("common"))
        rare = own_label.join(common, "bucket").where("label != common")
        centres = rare.groupBy("bucket", F.pmod(F.xxhash64("doc"), F.lit(CENTRES)).alias("part")).agg(F.min("doc").alias("centre"))
        led = stages.write(own_label.join(centres.select("bucket", "centre"), "bucket").where("doc != centre").select("bucket", "doc", "centre"), "led")
    found = chains[0]
    for more in chains[1:]:
        found = found.unionByName(more)
    return found


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full shingle sets of the classes ``wanted`` (node, rep, set_hash): node, shingles, each read from the text of ``rep``."""

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            same = [_digest(s) == h for s, h in zip(sets, batch["set_hash"])]
            yield pd.DataFrame({"doc": batch["node"], "shingles": [s.astype(np.int64) for s in sets]})[same]

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted.select("node", "rep", "set_hash"), "rep")
    return texts.select("node", "set_hash", "text").mapInPandas(full, "doc long, shingles array<long>").dropDuplicates(["doc"])


def _forest(percent: int):
    """Task function: the links of a block that join what was apart, found on full sets."""
    floor = estimate_floor(percent)

    def links(block: pd.DataFrame) -> pd.DataFrame:
        block = block.reset_index(drop=True)
        docs, side = block["doc"].to_numpy(), block["side"].to_numpy()
        bits = np.frombuffer(b"".join(block["bits"]), np.uint8).reshape(len(block), -1)
        sets = [np.asarray(s) for s in block["shingles"]]
        sizes = np.array([len(s) for s in sets])
        parent = np.arange(len(block))
        out = []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        # One side: all its pairs once. Two sides: each of the first with each of the second.
        left = np.flatnonzero(side == side.min())
        for i in left:
            others = np.flatnonzero(side != side[i]) if block["two"].iloc[0] else np.arange(i + 1, len(block))
            fits = others[(100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))]
            near = fits[estimate(bits[fits], bits[i]) >= floor]
            for j in near:
                if root(i) != root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        parent[root(i)] = root(j)
                        out.append((docs[i], docs[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links


def links(docs: DataFrame, classes: DataFrame, stages: Stages, percent: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between classes that connect all that are linked on full sets. ``classes``: node, rep, set_hash, bands, bits."""
    chains = families(classes, stages, percent)
    family = components(chains, stages)
    members = family.select(F.col("node").alias("doc"), F.col("component").alias("family"))
    wanted = classes.join(family, "node", "left_semi")
    signed = members.join(classes.select(F.col("node").alias("doc"), "bits"), "doc")
    sets = stages.write(_sets(docs, wanted).join(signed, "doc"), "sets")
    # A family's centre is the member that most chains lead to.
    led = chains.groupBy(F.col("b").alias("doc")).agg(F.count("*").alias("n")).join(members, "doc")
    lead = led.groupBy("family").agg(F.max(F.struct("n", "doc")).alias("c")).select("family", F.col("c.doc").alias("centre"))
    heads = sets.select(F.col("doc").alias("centre"), F.col("shingles").alias("centre_shingles"))
    size, other = F.size("shingles"), F.size("centre_shingles")
    both = F.size(F.array_intersect("shingles", "centre_shingles"))
    # One family may hold a third of the rows: its members are dealt over several tasks.
    measured = keyed_join(sets, lead.join(heads, "centre"), ["family"], "inner", deal=["doc"])
    placed = stages.write(
        measured.select("doc", "family", "centre", "shingles", "bits", both.alias("both"), (size + other - both).alias("all")), "placed"
    )
    linked = (100 * F.col("both") >= percent * F.col("all")) & (F.col("doc") != F.col("centre"))
    direct = placed.where(linked).select(F.col("doc").alias("a"), F.col("centre").alias("b"))

    # Zone k holds the distances above k and up to k + 1 times (100 - percent) hundredths, zone 0 also none at all:
    # two sets that may be linked then lie in one zone or in neighbouring ones, also exactly at the threshold.
    apart, width = 100 * (F.col("all") - F.col("both")), F.col("all") * (100 - percent)
    zone = F.greatest(F.floor((apart + width - 1) / width) - 1, F.lit(0)).cast("int")
    zoned = placed.select("doc", "family", "shingles", "bits", zone.alias("zone"))
    blocks = zoned.groupBy("family", "zone").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # A family without members outside zone 0 is done.
    open_families = blocks.groupBy("family").agg(F.max("zone").alias("last")).where("last > 0").select("family")
    following = blocks.select("family", (F.col("zone") - 1).alias("zone"), F.col("blocks").alias("next_blocks"))
    before = blocks.select("family", (F.col("zone") + 1).alias("zone"), F.col("blocks").alias("last_blocks"))
    around = blocks.join(open_families, "family").join(following, ["family", "zone"], "left").join(before, ["family", "zone"], "left")
    dealt = keyed_join(zoned, around, ["family", "zone"], "inner", deal=["doc"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))

    def cells(count: str, low_zone, low_block, high_block):
        span = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(span, lambda k: F.struct(low_zone.alias("z"), F.lit(1).alias("across"), low_block(k).alias("x"), high_block(k).alias("y")))

    own = F.col("block")
    outward = cells("next_blocks", F.col("zone"), lambda k: own, lambda k: k)
    inward = cells("last_blocks", F.col("zone") - 1, lambda k: k, lambda k: own)
    inside = F.when(
        F.col("zone") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda k: F.struct(F.col("zone").alias("z"), F.lit(0).alias("across"), F.least(own, k).alias("x"), F.greatest(own, k).alias("y")),
        ),
    ).otherwise(F.array().cast("array<struct<z:int,across:int,x:int,y:int>>"))
    cell = dealt.select("family", "doc", "shingles", "bits", "zone", "block", F.explode(F.concat(outward, inward, inside)).alias("cell"))
    two = (F.col("cell.across") == 1) | (F.col("cell.x") != F.col("cell.y"))
    side = F.when(F.col("cell.across") == 1, F.col("zone") - F.col("cell.z")).otherwise((F.col("block") != F.col("cell.x")).cast("int"))
    found = (
        cell.select("family", "cell", "doc", "shingles", "bits", two.alias("two"), side.cast("int").alias("side"))
        .groupBy("family", "cell")
        .applyInPandas(_forest(percent), "a long, b long")
    )
    return direct.unionByName(found)


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_shingles, component_id, kept; text_hash and group tell equal ids apart."""
    stages = Stages(docs.sparkSession, "near-dedup")
    drawn = stages.write(sketches(docs, percent), "sketches")
    named = drawn.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Equal sets have equal sketches; the least id stands for them. Numbers are given while the table is written, so each set has its own for good.
    sketch = F.first(F.struct("bands", "bits")).alias("s")
    classes = stages.write(
        named.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), sketch).select(F.monotonically_increasing_id().alias("node"), "set_hash", "rep", "s.*"), "classes"
    )
    joined = stages.write(links(docs, classes, stages, percent), "links")
    group = classes.select("set_hash", "node", "rep").join(components(joined, stages), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = group.groupBy("component").agg(F.min("rep").alias("of"))
    labels = group.join(least, "component").select("set_hash", "of", F.col("component").alias("group"))
    rows = drawn.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_hash")).alias("set_hash"))
    out = rows.join(labels, "set_hash", "left")
    component = F.coalesce("of", F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", F.coalesce("group", "text_hash").alias("group"))


def without_near_duplicates(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """One row of each group of near-duplicates, all columns; rows without words are no duplicates, but one of repeated rows stays.

    Where ids repeat with texts of one group, the row of the least text hash stays.
    """
    stages = Stages(docs.sparkSession, "near-dedup-rows")
    labelled = stages.write(near_duplicates(docs, percent).select("doc_id", "text_hash", "group", "kept"), "labels")
    out = labelled.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    held = docs.withColumn("__text_hash", _text_hash())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    held = held.join(out, same, "left_anti")
    groups = labelled.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "group").agg(F.count("*").alias("n"), F.min("text_hash").alias("__hash"))
    if not groups.where("n > 1").isEmpty():
        # Ids that repeat: one row of each id and group stays.
        one = held.join(groups.select(F.col("doc_id").alias("__id"), "__hash"), same, "left_semi").dropDuplicates(["doc_id", "__text_hash"])
        held = held.where("doc_id IS NULL").unionByName(one)
    return held.drop("__text_hash")
