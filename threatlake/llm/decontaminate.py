"""Documents that hold benchmark items, by SimHash of item-sized windows. DataFrame functions only.

A document holds an item if one of its windows, as many words long as the item, has at least the asked weighted
Jaccard similarity with it over word shingles (``sum of minima / sum of maxima`` of the counts).

0. *Candidates.* A window that is similar enough shares the part ``num / den`` of the item's shingles, hence one of any that make up a little more than
   the rest. Those that the fewest items have are taken; only documents with one of them are looked at for the item, so a template that
   all items share brings none together.
1. *Windows.* Moving a window forward to the next shingle that it shares with the item loses nothing it shares, so windows that
   start at a shared shingle (or end with the document) are all that matter, and of those the ones that hold
   enough shared shingles for the similarity. Both follow from the positions of shared shingles alone.
2. *Fingerprints.* Each such window and each item has a 64-bit SimHash: bit by bit the majority of the hashes of its pairs (shingle,
   number of its occurrence). The similarity is that of the sets of these pairs, so a repeated word weighs no more here than there.
3. *Multi-index.* Fingerprints are cut into RADIUS + 1 blocks. Two within RADIUS bits of each other agree in one block
   at least, so an equi-join on (size, block, value) finds every such pair, whatever the number of items; other pairs are then dropped by
   their distance. A window that is similar enough shares six sevenths of its pairs with the item (a cosine of 6/7 at least), which puts
   its fingerprint more than four standard deviations inside the radius.
4. *Exact similarity* of the remaining pairs, from the counts of their shingles.

Shuffles carry hashes and positions, and once the texts of the documents. The table of item shingles is broadcast only where its counted rows are
few; beyond that the join is by shuffle.

Defined cases: null and blank texts hold nothing, and such items are held by nothing; an item with fewer words than a
shingle is one shingle; a document with fewer words than the item is one window; equal rows get equal results; a null ``doc_id`` is a value like
others; other columns are ignored; no documents give no rows, no items leave all documents clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatlake.llm.common import discard, scratch, stored, text_of

SHINGLE = 5
RADIUS = 23
BROADCAST_ROWS = 1_000_000
KEY = ["k1", "k2"]


def words_of(text: Column) -> Column:
    """Lower-case runs without white space; the empty array for a blank text."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t\n\x0b\f\r]+"))


def shingles_of(words: Column, length: int) -> Column:
    """Hashes of the runs of ``length`` words, in order."""
    count = F.size(words) - length + 1
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length)])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), run)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(counts: DataFrame, by: list[str]) -> DataFrame:
    """One row for each ``by`` with ``print``, the SimHash of its shingles ``h``, each as often as its count ``c`` with the
    number of the occurrence. Two counters share a long."""
    numbers = F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))
    hashed = counts.select(*by, "h", numbers.alias("_i")).select(*by, F.xxhash64("h", "_i").alias("_h"))
    bit = lambda i: F.shiftrightunsigned("_h", i).bitwiseAND(1)
    sums = [F.sum(bit(i) + F.shiftleft(bit(i + 32), 32)).alias(f"_s{i}") for i in range(32)]
    counted = hashed.groupBy(*by).agg(F.count("*").alias("_n"), *sums)
    half = lambda c: 2 * c > F.col("_n")
    bits = [(half(F.col(f"_s{i}").bitwiseAND(0xFFFFFFFF)), 1 << i) for i in range(32)]
    bits += [(half(F.shiftrightunsigned(f"_s{i}", 32)), 1 << (i + 32) if i < 31 else -(1 << 63)) for i in range(32)]
    return counted.select(*by, reduce(Column.bitwiseOR, [F.when(c, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")) for c, v in bits]).alias("print"))


def blocks(prints: DataFrame) -> DataFrame:
    """One row for each of the RADIUS + 1 blocks of ``print``."""
    edges = [64 * j // (RADIUS + 1) for j in range(RADIUS + 2)]
    parts = [
        F.struct(F.lit(j).alias("block"), F.shiftrightunsigned("print", a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
        for j, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    return prints.select("*", F.inline(F.array(*parts)))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by two hashes of id and text: equal rows share a key, others don't."""
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))


def _at_least(a: Column, b: Column, num: int, den: int) -> Column:
    """Shared shingles that two multisets of these sizes need."""
    return F.ceil(num * (a + b) / (num + den)).cast("int")


def leading_shingles(shingles: DataFrame, num: int, den: int) -> DataFrame:
    """``h, item_id`` of shingles of which every similar window has one: by the number of items that have them, then by hash."""
    common = shingles.groupBy("h").agg(F.count("*").alias("_items"))
    size = F.col("n") - F.col("length") + 1
    order = W.partitionBy("item_id").orderBy("_items", "h").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(order), F.lit(0))
    ranked = shingles.join(common, "h").withColumn("_before", before)
    return ranked.where(F.col("_before") <= size - F.ceil(num * size / den)).select("h", "item_id")


def shared_windows(docs: DataFrame, shingles: DataFrame, length: int, num: int, den: int) -> DataFrame:
    """``k1, k2, item_id, n, m, start``: windows that share enough shingles of this length with an item. ``n``: words of
    the item; ``m``: words of the window, fewer only in a shorter document."""
    words = _keyed(docs).select(*KEY, words_of(F.col("text")).alias("words"))
    found = words.select(*KEY, F.size("words").alias("total"), F.posexplode(shingles_of(F.col("words"), length)).alias("pos", "h"))
    items = shingles.where(F.col("length") == length)
    keys = items.select("h").distinct()
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = found.join(F.broadcast(keys), "h", "left_semi")
    else:
        found = found.join(keys, "h", "left_semi")
    found = stored(found, "found")
    met = found.select(*KEY, "h").distinct().join(leading_shingles(items, num, den), "h").select(*KEY, "item_id").distinct()
    hits = stored(met.join(items.select("item_id", "n", "h"), "item_id").join(found, [*KEY, "h"]).drop("h"), "hits")
    discard(found)
    m = F.least("n", "total")
    hits = hits.withColumns({"m": m, "rank": F.row_number().over(W.partitionBy(*KEY, "item_id").orderBy("pos"))})
    hits = hits.withColumn("start", F.least(F.col("pos"), F.col("total") - F.col("m")))
    need = _at_least(F.col("m") - length + 1, F.col("n") - length + 1, num, den)
    first = hits.groupBy(*KEY, "item_id", "n", "m", "start").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.col("rank") + F.greatest(need, F.lit(1)) - 1)
    last = hits.select(*KEY, "item_id", "rank", F.col("pos").alias("_last"))
    return first.join(last, [*KEY, "item_id", "rank"]).where(F.col("_last") <= F.col("start") + F.col("m") - length).select(
        *KEY, "item_id", "n", "m", "start"
    )


def held_items(docs: DataFrame, benchmark: DataFrame, num: int = 3, den: int = 4) -> DataFrame | None:
    """``k1, k2, _items``: the items, in order, that the documents with these keys hold; None without items.
    ``num / den`` is the similarity."""
    with scratch(docs.sparkSession):
        return _held_items(docs, benchmark, num, den)


def _held_items(docs: DataFrame, benchmark: DataFrame, num: int, den: int) -> DataFrame | None:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(text_of()).alias("words"))
    items = items.where("item_id IS NOT NULL AND size(words) > 0").withColumn("n", F.size("words"))
    items = stored(items.withColumn("length", F.least("n", F.lit(SHINGLE))), "items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # SHINGLE values at most
    if not lengths:
        return None
    of_length = [
        items.where(F.col("length") == k).select("item_id", "n", "length", F.explode(shingles_of(F.col("words"), k)).alias("h"))
        for k in lengths
    ]
    shingles = reduce(DataFrame.unionByName, of_length).groupBy("item_id", "n", "length", "h").agg(F.count("*").alias("c"))
    shingles = stored(shingles, "item-shingles")

    windows = [shared_windows(docs, shingles, k, num, den).withColumn("length", F.lit(k)) for k in lengths]
    windows = stored(reduce(DataFrame.unionByName, windows).select(*KEY, "n", "m", "start", "length").distinct(), "windows")
    wanted = windows.groupBy(*KEY).agg(F.collect_list(F.struct("n", "m", "start", "length")).alias("_windows"))
    texts = _keyed(docs).select(*KEY, "text").join(wanted, KEY).dropDuplicates(KEY)
    texts = texts.select(*KEY, words_of(F.col("text")).alias("words"), "_windows")
    cut = lambda w: F.struct(w["n"].alias("n"), w["m"].alias("m"), w["start"].alias("start"), w["length"].alias("length"), F.slice("words", w["start"] + 1, w["m"]).alias("window"))
    cuts = stored(texts.select(*KEY, F.inline(F.transform("_windows", cut))), "cuts")

    window = [*KEY, "n", "m", "start", "length"]
    held = [cuts.where(F.col("length") == k).select(*window, shingles_of(F.col("window"), k).alias("_hs")) for k in lengths]
    # dealt by window, so that neither counting nor fingerprints need another shuffle
    held = reduce(DataFrame.unionByName, held).repartition(*window).select(*window, F.explode("_hs").alias("h"))
    counts = held.groupBy(*window, "h").agg(F.count("*").alias("c"))
    ours = blocks(fingerprints(counts, window))
    theirs = blocks(fingerprints(shingles, ["item_id", "n", "length"])).withColumnRenamed("print", "_print")
    pairs = ours.join(theirs, ["n", "length", "block", "value"])
    pairs = pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("_print"))) <= RADIUS).select(*window, "item_id").distinct()

    counts = counts.withColumnRenamed("c", "_c")
    both = counts.join(pairs, window).join(shingles.select("item_id", "h", "c"), ["item_id", "h"])
    shared = both.groupBy(*window, "item_id").agg(F.sum(F.least("c", "_c")).alias("_shared"))
    sizes = F.col("m") + F.col("n") - 2 * F.col("length") + 2
    held = shared.where(den * F.col("_shared") >= num * (sizes - F.col("_shared"))).select(*KEY, "item_id").distinct()
    return stored(held.groupBy(*KEY).agg(F.sort_array(F.collect_list("item_id")).alias("_items")), "held", lasting=True)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, first_item, item_ids`` of every row of ``docs``; ``item_ids`` lists the items
    held, in order."""
    held, rows = held_items(docs, benchmark), _keyed(docs).select("doc_id", *KEY)
    if held is None:
        rows = rows.withColumn("_items", F.lit(None).cast("array<bigint>"))
    else:
        rows = rows.join(held, KEY, "left")
    return rows.select(
        "doc_id", F.col("_items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), F.get("_items", F.lit(0)).alias("first_item"),
        F.coalesce(F.array_join(F.col("_items").cast("array<string>"), ","), F.lit("")).alias("item_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    held = held_items(docs, benchmark)
    if held is None:
        return docs
    keys = held.select(F.col("k1").alias("_held1"), F.col("k2").alias("_held2"))
    rows = docs.withColumns({"_key1": F.xxhash64("doc_id", text_of()), "_key2": F.xxhash64(F.lit(1), text_of(), "doc_id")})
    rows = rows.join(keys, (F.col("_key1") == F.col("_held1")) & (F.col("_key2") == F.col("_held2")), "left_anti")
    return rows.select(*docs.columns)
