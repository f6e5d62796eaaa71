"""Mixing sources to target weights in blocks; DataFrame functions only.

Documents of a source are laid end to end and cut into blocks of ``block``
words.  The mix is a sequence of slots, dealt into output shards.  For each
shard the number of slots of every source is drawn: the whole part of its
expected count is given, the rest of the shard's slots is a multinomial draw
over the fractional parts (residual resampling), so that sums stay near their
targets at any size.  A source's slots, counted through all shards, run through
its blocks in a pseudorandom order, another one in each epoch: a swap-or-not
shuffle (Hoang, Morris and Rogaway, 2012) maps slot numbers to block numbers,
exactly one to one, without a table.  Slots and blocks are joined by block number.

Targets: sources by code point, null last, weigh 1, 2, 3, 1, ... and share the
whole size; a source's target stops at ``epochs`` times its size, and what is
over goes to the others by weight until none is above.

All is made from hashes of numbers, so reruns agree.  Only one row per source, and
one per source and 4096 shards, are sorted in one place; per-document sums run
within (source, chunk), where a chunk is one of about sqrt(documents) hash
ranges, so that a source with a third of all rows is spread.

A null source is a source, a null text has no words, and repeated rows have
words of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import WORD_PATTERN, materialize

#: Words of a block, slots of an output shard, rounds of the shuffle.
BLOCK, SHARD_SLOTS, ROUNDS = 64, 4096, 24
GRID = 1024
#: Shards whose slots are summed together.
SHARDS_TOGETHER = 4096
#: Slots that a task numbers and maps to blocks.
SLOTS_PER_TASK = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from one row per source with its size (column ``source_size``)."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    # water filling: in the order of cap to weight, those before the level are full and the level serves the rest
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    levels = ranked.select("*", ((total - before) / behind).alias("level"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = levels.select("source", "source_size", "weight", "cap", level.alias("level"))
    full = F.col("level").isNull() | (F.col("cap") < F.col("weight") * F.col("level"))
    return out.select("source", "source_size", "weight", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def permuted(k: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """k's place in a pseudorandom permutation of 0..n-1 that depends on key."""

    def swap(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, i), n) - x, n)
        heads = F.pmod(F.xxhash64(key, i, F.greatest(x, partner)), F.lit(2)) == 1
        return F.when(heads, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k, swap)


def lay_out(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """A row per document, without its text: row keys, size and, within the source, the number of words before it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("digest"))
    n = docs.count()
    chunks = 1 << min(18, max(4, math.ceil(math.log2(max(n, 2)) / 2)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(chunks)))
    key = [F.col("source"), F.col("chunk")]
    inside = Window.partitionBy(*key).orderBy("doc_id", "digest", "size")
    rows = rows.withColumn("rn", F.row_number().over(inside)).withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    per_chunk = rows.groupBy(*key).agg(F.sum("size").alias("chunk_size"))
    by_chunk = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), F.coalesce(F.sum("chunk_size").over(by_chunk), F.lit(0)).alias("base"))
    return rows.join(base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("chunk") == F.col("c2"))).withColumn("offset", F.col("base") + F.col("inside")).drop("s2", "c2", "base", "inside")


def draw_slots(plan: DataFrame, slots: int, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, n, count): how many slots of each shard the n-th source gets; plan has n and p, its share of the slots."""
    spark = plan.sparkSession
    shards = spark.range(0, -(-slots // shard_slots)).select(F.col("id").alias("shard"), F.least(F.lit(shard_slots), F.lit(slots) - F.col("id") * shard_slots).alias("m"))
    kinds = spark.createDataFrame([(m,) for m in sorted({shard_slots, slots % shard_slots or shard_slots} if slots >= shard_slots else {slots})], "m long")
    given = plan.join(F.broadcast(kinds), F.lit(True)).withColumn("given", F.floor(F.col("p") * F.col("m"))).withColumn("rest", F.col("p") * F.col("m") - F.col("given"))
    upto = Window.partitionBy("m").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("m")
    given = given.withColumn("hi", F.sum("rest").over(upto) / F.sum("rest").over(whole)).withColumn("lo", (F.sum("rest").over(upto) - F.col("rest")) / F.sum("rest").over(whole)).withColumn("left", F.col("m") - F.sum("given").over(whole))
    given = materialize(given.select("m", "n", "given", "lo", "hi", "left"), "shares")
    sure = shards.join(given, "m").select("shard", "n", F.col("given").cast("long").alias("count"))
    left = given.groupBy("m").agg(F.first("left").cast("long").alias("left"))
    # a residual slot draws one source: its number in [0, 1) is matched within a cell of a grid
    draws = shards.join(left, "m").where("left > 0").select("shard", "m", F.explode(F.sequence(F.lit(1), F.col("left"))).alias("j"))
    draws = draws.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "shard", "j"), F.lit(1 << 40)) / F.lit(float(1 << 40))).withColumn("cell", F.floor(F.col("u") * GRID))
    cells = given.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))))
    drawn = draws.join(cells.select(F.col("m").alias("m2"), F.col("cell").alias("cell2"), "n", "lo", "hi"), (F.col("m") == F.col("m2")) & (F.col("cell") == F.col("cell2")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return sure.unionByName(drawn.select("shard", "n", F.lit(1).cast("long").alias("count"))).groupBy("shard", "n").agg(F.sum("count").alias("count"))


def first_slots(counts: DataFrame, together: int = SHARDS_TOGETHER) -> DataFrame:
    """counts (shard, n, count) with first, the source's slots in all shards before: sums of ranges of shards, then sums within each."""
    ranged = counts.withColumn("range", F.floor(F.col("shard") / together).cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("n", "range").agg(F.sum("count").alias("in_range"))
    base = whole.select(F.col("n").alias("n2"), F.col("range").alias("r2"), F.coalesce(F.sum("in_range").over(before(Window.partitionBy("n").orderBy("range"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("count").over(before(Window.partitionBy("n", "range").orderBy("shard"))), F.lit(0))
    summed = ranged.withColumn("inside", inside).join(base, (F.col("n") == F.col("n2")) & (F.col("range") == F.col("r2")))
    return summed.select("shard", "n", "count", (F.col("base") + F.col("inside")).alias("first"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, epochs: int = 3, seed: int = 9, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of the mix.

    rows: doc_id, source, digest (of the text), n, chunk, rn (the source's number,
    which with chunk and rn names the row), size, source_size, target.  spans: n, chunk, rn,
    shard, epoch, block, start, stop: the words [start, stop) of the row that a
    slot takes.  A text without words gets no span; an empty table gives empty tables.
    """
    rows = materialize(lay_out(docs, doc_id, text, source), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, epochs)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    plan = targets.withColumn("n", F.row_number().over(by_name).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # a block of this source has source_size / blocks words on average
    plan = materialize(plan.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))), "mix-plan")
    named = rows.join(plan.select(F.col("source").alias("s2"), "source_size", "target", "n", "blocks"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    slots = math.ceil(plan.agg(F.sum("slots")).first()[0] or 0)
    empty = rows.sparkSession.createDataFrame([], "n long, chunk long, rn int, shard long, epoch long, block long, start long, stop long")
    if not slots:
        return named, empty
    shares = plan.select("n", (F.col("slots") / F.sum("slots").over(Window.partitionBy(F.lit(1)))).alias("p")).where("p > 0")
    counts = draw_slots(shares, slots, seed, shard_slots)
    counts = first_slots(materialize(counts, "mix-counts"))
    # a row here stands for up to a shard of slots: they are dealt before they are written out
    counts = counts.where("count > 0").repartition(min(20_000, math.ceil(slots / SLOTS_PER_TASK)), "shard", "n")
    numbered = counts.select("shard", "n", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("k")).join(plan.select("n", "blocks"), "n")
    numbered = numbered.withColumn("epoch", F.floor(F.col("k") / F.col("blocks")).cast("long")).where(F.col("epoch") < epochs)  # a slot beyond the last epoch stays empty
    taken = numbered.select("shard", "n", "epoch", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "n", "epoch")).alias("block"))
    pieces = named.where("size > 0").select("n", "chunk", "rn", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))).alias("block"))
    pieces = pieces.select("n", "block", "chunk", "rn", F.greatest(F.lit(0), F.col("block") * block - F.col("offset")).cast("long").alias("start"), F.least(F.col("size"), (F.col("block") + 1) * block - F.col("offset")).cast("long").alias("stop"))
    return named, taken.join(pieces, ["n", "block"]).select("n", "chunk", "rn", "shard", "epoch", "block", "start", "stop")


def taken_words(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows with ``taken``, the words that the mix takes of each, repeats counted."""
    key = ["n", "chunk", "rn"]
    took = spans.groupBy(*key).agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    return rows.join(took, key, "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mixed_rows(docs: DataFrame, rows: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents' columns, once per document and epoch, the text cut to what the epoch takes of it.

    Words that were neighbours in the text stay so with the white space between
    them; a document taken whole keeps its text as it is.  Texts move once, to
    meet their spans by a digest of id, source and text.
    """
    key = ["n", "chunk", "rn"]
    took = spans.groupBy(*key, "epoch").agg(F.sum(F.col("stop") - F.col("start")).alias("__taken"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    row_key = lambda i, s, d: (F.xxhash64(i, s).alias("__a"), d.alias("__b"))
    took = rows.join(took, key).select(*row_key(F.col("doc_id"), F.col("source"), F.col("digest")), F.col("size").alias("__size"), "__taken", "__spans")
    keyed = docs.select("*", *row_key(F.col(doc_id), F.col(source), F.xxhash64(F.col(text))))
    if rows.groupBy("doc_id", "source", "digest").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["__a", "__b"])  # repeated rows have spans of their own, but one text
    joined = keyed.join(took, ["__a", "__b"])
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    part_taken = F.col("__taken") < F.col("__size")
    # words are listed only where a part is taken, and once
    joined = joined.withColumn("__words", F.explode(F.array(F.when(part_taken, tokens))))
    part = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(F.col("__words"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    cut = F.when(part_taken, F.regexp_replace(part, r"^[\x20\x09-\x0D]+", "")).otherwise(F.col(text))
    return joined.withColumn(text, cut).select(*docs.columns)
