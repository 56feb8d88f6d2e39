"""Benchmark decontamination by winnowing.

Every run of five words has a hash; of any six runs in a row the least hash (the first of equal
ones) is a fingerprint. A span of ten words or more that a document shares with an item
therefore shares a fingerprint with it. Fingerprints join on their hash, and each hit is
extended to the ten-word windows around it, which are then compared by their words.

Items of one to nine words are one window of their own length. They are shorter than winnowing
can promise to find, so every run of that length is looked up too, for the few lengths that occur, in the same
pass over the documents.

NULL and empty texts have no words and no hits. Rows are told apart by id and text, so repeated
rows each get the result of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages, let, lower_ascii, split_words, whole_number

WINDOW = 10
GRAM = 5
#: What lies between words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def _runs(hashes: Column, length: int) -> Column:
    """Hash of every run of ``length`` words, in order."""
    count = F.greatest(F.size(hashes) - (length - 1), F.lit(0))
    return F.transform(F.slice(hashes, 1, count), lambda _, i: F.xxhash64(F.slice(hashes, i + 1, length)))


def fingerprints(hashes: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Array of (place of the run's first word, hash) that winnowing selects from an array of word hashes."""
    width = window - gram + 1

    def select(grams: Column) -> Column:
        count = F.greatest(F.size(grams) - (width - 1), F.lit(0))
        places = F.transform(
            F.slice(grams, 1, count),
            lambda _, i: let(F.slice(grams, i + 1, width), lambda s: i + F.array_position(s, F.array_min(s)).cast("int") - 1),
        )
        return F.transform(F.array_distinct(places), lambda p: F.struct(p.alias("place"), F.get(grams, p).alias("hash")))

    return let(_runs(hashes, gram), select)


def probes(words: Column, short: list[int], window: int = WINDOW, gram: int = GRAM) -> Column:
    """Array of (length, place, hash): the fingerprints, for windows of ``window`` words, and every run of each shorter length."""

    def all_of(hashes: Column) -> Column:
        full = F.transform(fingerprints(hashes, window, gram), lambda f: F.struct(F.lit(window).alias("length"), f["place"], f["hash"]))
        def placed(n: int) -> Column:
            return F.transform(_runs(hashes, n), lambda h, i: F.struct(F.lit(n).alias("length"), i.alias("place"), h.alias("hash")))

        runs = [placed(n) for n in short]
        return F.concat(full, *runs) if runs else full

    return let(F.transform(words, lambda x: F.xxhash64(x)), all_of)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window: its words as text, its length, and the ids of the items it occurs in."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = items.select("item_id", length.alias("length"), F.col("words"), F.explode(starts).alias("start"))
    text = F.array_join(F.slice("words", F.col("start"), F.col("length")), " ")
    return (
        windows.select("item_id", "length", text.alias("window"))
        .groupBy("window", "length")
        .agg(F.collect_set("item_id").alias("items"))
    )


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Documents (doc_id, text_hash) that share a window, with ``spans`` (start, end in words) and ``items``.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are left out.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    stages = Stages(docs.sparkSession, "decontamination")
    # Windows of the same items share a set of them by its digest: a passage that many items quote has one.
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    windows = stages.write(item_windows(benchmark, window).withColumn("item_set", F.sha2(ids.cast("binary"), 256)), "windows")
    sets = windows.groupBy("item_set").agg(F.first("items").alias("items"))
    targets = windows.drop("items")
    short = sorted(r["length"] for r in targets.where(F.col("length") < window).select("length").distinct().collect())

    words = words_of(F.col("text"))
    # One pass over the documents for windows of all lengths.
    own = keyed.select("doc_id", "text_hash", F.explode(probes(words, short, window, gram)).alias("f")).select("doc_id", "text_hash", "f.*")
    of_length = F.explode(probes(F.split("window", " "), short, window, gram)).alias("f")
    wanted = targets.select(F.col("length").alias("of"), of_length).where(F.col("of") == F.col("f.length")).select("f.length", "f.hash").distinct()
    found = own.join(wanted, ["length", "hash"], "left_semi")
    reach = F.when(F.col("length") == window, window - gram).otherwise(0)
    starts = found.select("doc_id", "text_hash", "length", F.explode(F.sequence(F.greatest(F.col("place") - reach, F.lit(0)), "place")).alias("start"))

    places = starts.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("places"))
    near = (
        keyed.join(*_same_row(keyed, places), "inner")
        .select(keyed["doc_id"], keyed["text_hash"], words.alias("words"), "places")
        .dropDuplicates(["doc_id", "text_hash"])
    )

    def spelled(w: Column, at: Column) -> Column:
        inside = F.filter(at, lambda p: p["start"] + p["length"] <= F.size(w))
        return F.transform(
            inside, lambda p: F.struct(p["start"], p["length"], F.array_join(F.slice(w, p["start"] + 1, p["length"]), " ").alias("window"))
        )

    around = near.select("doc_id", "text_hash", F.explode(let(F.col("words"), lambda w: spelled(w, F.col("places")))).alias("at"))
    # Windows that overlap pack well, so that Spark sizes a table of many far too low.
    spelled_out = stages.unsent(windows).drop("items")
    matched = stages.write(around.select("doc_id", "text_hash", "at.*").join(spelled_out, ["window", "length"]).drop("window"), "matched")
    spans = matched.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans")
    )
    items = matched.select("doc_id", "text_hash", "item_set").distinct().join(sets, "item_set")
    items = items.select("doc_id", "text_hash", F.explode("items").alias("item")).groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("items"))
    return spans.join(*_same_row(spans, items)).select(spans["doc_id"], spans["text_hash"], "spans", "items")


def _same_row(left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
    """The right side and the condition that joins it to its rows, NULL ids included."""
    right = right.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    return right, left["doc_id"].eqNullSafe(right["__id"]) & (left["text_hash"] == right["__hash"])


def covered_words(spans: Column) -> Column:
    """Words inside any of the sorted (start, end) spans."""
    zero = F.struct(whole_number(0).alias("n"), F.lit(0).alias("reach"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))
        return F.struct((a["n"] + fresh).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_words, spans and items; the last two are NULL without a hit."""
    words = F.size(words_of(F.col("text"))).cast("long")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words.alias("n_words"))
    overlaps = find_overlaps(docs, benchmark, window, gram)
    return rows.join(*_same_row(rows, overlaps), "left").select(rows["doc_id"], "n_words", "spans", "items")


def without_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with the benchmark."""
    keyed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    bad = find_overlaps(docs, benchmark, window, gram)
    same = keyed["doc_id"].eqNullSafe(bad["doc_id"]) & (keyed["__text_hash"] == bad["text_hash"])
    return keyed.join(bad, same, "left_anti").drop("__text_hash")
