"""Mixing sources to target weights with fixed-length blocks of words.

The documents of a source, in a pseudorandom but fixed order, make one stream
of words that is packed into blocks of ``block_words``. Output shards draw
multinomial counts of slots for each source, which decide what a shard holds: the counts are
scaled to each source's quota, and a source's slots are numbered shard after shard. A slot's ordinal within its source
goes through that source's pseudorandom permutation of block indexes, one
permutation for each epoch, and slots meet blocks in a join by index. The short
last block of a source has the last ordinal of each epoch, so a source's slots
add up to its target to the word: a last slot is cut where the target ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.words import WORD, let, word_count
from quillspark.session import quoted, small_table, written

ROUNDS = 20


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets that share ``total`` by weight, none above ``most`` times its size; the excess is shared again."""
    targets, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
            left -= targets[i]
        free = [i for i in free if i not in set(full)]
    return targets


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of 0..n-1 chosen by ``key``: swap-or-not rounds, so any n will do."""

    n = F.greatest(n, F.lit(1))

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        bit = F.pmod(F.xxhash64(key, r, F.greatest(x, partner)), F.lit(2))
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index.cast("long"), step)


def _alias(p: list[float]) -> tuple[list[float], list[int]]:
    """Walker's alias table: one uniform draw picks from any number of sources in constant time."""
    n = len(p)
    scaled, alias = [x * n for x in p], list(range(n))
    small, large = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
    while small and large:
        s, g = small.pop(), large[-1]
        alias[s] = g
        scaled[g] -= 1 - scaled[s]
        if scaled[g] < 1:
            small.append(large.pop())
    return scaled, alias


def _draws(spark: SparkSession, quota: list[int], shard_slots: int, seed: int) -> DataFrame:
    """(__s, shard, n): how many of its ``shard_slots`` slots each output shard draws for each source."""
    total = sum(quota)
    prob, alias = _alias([q / total for q in quota])
    g = F.col("id")
    uniform = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), g), F.lit(1 << 40)) / F.lit(float(1 << 40))
    at = F.floor(uniform(1) * len(quota)).cast("int")
    prob_at = F.get(F.array(*map(F.lit, prob)), at)
    pick = F.when(uniform(2) < prob_at, at).otherwise(F.get(F.array(*map(F.lit, alias)), at))
    drawn = spark.range(total).select((g / shard_slots).cast("long").alias("shard"), pick.alias("__s"))
    return drawn.groupBy("__s", "shard").agg(F.count(F.lit(1)).alias("n"))


def _slots(spark: SparkSession, plan: list[dict], shard_slots: int, seed: int, chunk: int = 4096) -> DataFrame:
    """(__s, shard, ordinal) of every slot: each shard's drawn counts, scaled so that a source's add up to its quota.

    A source that was drawn d times in all gets quota / d slots for each draw: the running sum of its draws, times that, is rounded
    down at each shard's end, so no count is off by more than one slot and the sum is the quota. Sums run in chunks of shards.
    """
    quota = [p["quota"] for p in plan]
    shards = -(-sum(quota) // shard_slots)
    counts = written(_draws(spark, quota, shard_slots, seed).withColumn("chunk", (F.col("shard") / chunk).cast("long")), "mix-draws")
    by_source = W.partitionBy("__s")
    chunks = counts.groupBy("__s", "chunk").agg(F.sum("n").alias("n")).select(
        "__s", "chunk", F.coalesce(F.sum("n").over(by_source.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by_source).alias("all"),
    )
    inside = W.partitionBy("__s", "chunk").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    known = small_table(spark, list(enumerate(quota)), "__s int, quota long")
    summed = counts.withColumn("upto", F.sum("n").over(inside)).join(chunks, ["__s", "chunk"]).join(F.broadcast(known), "__s")
    scaled = lambda drawn: F.expr(f"cast({drawn} AS decimal(19, 0)) * cast(quota AS decimal(19, 0)) div cast(`all` AS decimal(19, 0))")
    ends = summed.select("__s", "shard", scaled("(before + upto - n)").alias("a"), scaled("(before + upto)").alias("b")).filter("b > a")
    # few rows become many: they are dealt to as many tasks as the slots need
    dealt = ends.repartition(min(100_000, 1 + sum(quota) // SLOTS_A_TASK), "__s", "shard")
    placed = dealt.select("__s", "shard", F.explode(F.sequence("a", F.col("b") - 1)).alias("ordinal"))
    # a source of so few slots that none was drawn is spread evenly
    seen = {r["__s"] for r in chunks.select("__s").distinct().collect()}  # one row for each source
    unseen = [(i, q) for i, q in enumerate(quota) if q and i not in seen]
    if unseen:
        even = small_table(spark, unseen, "__s int, q long").select("__s", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("ordinal"))
        placed = placed.unionByName(even.select("__s", F.expr(f"ordinal * {shards} div q").alias("shard"), "ordinal"))
    return placed


WEIGHTS, SHARE, MOST, BLOCK_WORDS, SHARD_SLOTS, BIN_ROWS, MAX_SOURCES, SEED = (5, 2, 1), 1.5, 2.0, 128, 4096, 4_000, 10_000, 17
SLOTS_A_TASK = 50_000
RESULTS = ("size", "source_size", "target", "taken", "first_shard", "text")


def _placed(
    docs: DataFrame, weights: tuple[float, ...], share: float, most: float, block_words: int, bin_rows: int, max_sources: int, seed: int
) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Every row (doc_id, source and, if there is one, ``__row``) with its offset in the stream of its source; the table of sources; the plan of each."""
    spark = docs.sparkSession
    sized = docs.select(
        *(c for c in docs.columns if c != "text"),
        F.col("source").alias("__source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("__h"),
    )
    sized = written(sized, "mix-sizes")
    totals = sized.groupBy("__source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r["size"] for r in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    plan = []
    for row, target in zip(totals, targets, strict=True):
        words, size = round(target), row["size"]
        full, tail = divmod(size, block_words)
        epochs, rest = divmod(words, size) if size else (0, 0)
        quota = epochs * (full + (tail > 0)) + rest // block_words + (rest % block_words > 0)
        plan.append({"source": row[0], "size": size, "target": float(target), "full": full, "per_epoch": full + (tail > 0), "quota": quota, "epochs": epochs, "rest": rest, "bins": max(1, row["n"] // bin_rows)})
    sources = small_table(
        spark,
        [(i, p["source"], p["size"], p["target"], p["full"], p["per_epoch"], p["quota"], p["epochs"], p["rest"], p["bins"]) for i, p in enumerate(plan)],
        "__s int, __source string, source_size long, target double, full long, per_epoch long, quota long, epochs long, rest long, bins long",
    )
    few = F.broadcast(sources.select("__s", F.col("__source").alias("__name"), "source_size", "target", "bins"))
    known = sized.join(few, F.col("__source").eqNullSafe(F.col("__name"))).drop("__name", "__source")
    # a source's rows are numbered in bins of bounded size, then the bins' totals are added up
    binned = known.withColumn("__bin", F.pmod("__h", F.col("bins"))).drop("bins")
    order = [F.asc_nulls_first("__h"), F.asc_nulls_first("size"), F.asc_nulls_first("doc_id")]
    inside = W.partitionBy("__s", "__bin").orderBy(*order)
    edges = binned.groupBy("__s", "__bin").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("__s").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select("__s", "__bin", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__base"))
    placed = (
        binned.withColumn("__rn", F.row_number().over(inside))
        .withColumn("__in", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .join(edges, ["__s", "__bin"])
        .withColumn("__off", F.col("__base") + F.col("__in"))
        .drop("__in", "__base")
    )
    return written(placed, "mix-placed"), sources, plan


def _pieces(placed: DataFrame, block_words: int, *more: str) -> DataFrame:
    """The piece of every document in each block that it touches: words a to b of the block."""
    end = F.col("__off") + F.col("size")
    blocks = placed.filter("size > 0").select(
        "__s", "__bin", "__rn", "__off", "size", *more,
        F.explode(F.sequence((F.col("__off") / block_words).cast("long"), ((end - 1) / block_words).cast("long"))).alias("block"),
    )
    edge = F.col("block") * block_words
    return blocks.withColumn("a", F.greatest(F.col("__off") - edge, F.lit(0))).withColumn("b", F.least(end - edge, F.lit(block_words)))


def _slot_blocks(spark: SparkSession, sources: DataFrame, plan: list[dict], block_words: int, shard_slots: int, seed: int, draw_seed: int) -> DataFrame:
    """(__s, shard, ordinal, block, words): the block that each slot holds and how many words of it."""
    slots = _slots(spark, plan, shard_slots, draw_seed).join(F.broadcast(sources.select("__s", "full", "per_epoch", "epochs", "rest")), "__s")
    slots = slots.withColumn("epoch", (F.col("ordinal") / F.col("per_epoch")).cast("long")).withColumn("j", F.col("ordinal") % F.col("per_epoch"))
    key = F.xxhash64(F.lit(seed), F.lit("epoch"), "__s", "epoch")
    block = F.when(F.col("j") >= F.col("full"), F.col("j")).otherwise(permuted(F.col("j"), F.col("full"), key))
    words = F.when(F.col("epoch") < F.col("epochs"), F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("rest") - F.col("j") * block_words))
    return slots.select("__s", "shard", "ordinal", block.alias("block"), words.alias("words"))


def _takes(placed: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """Pieces of documents in blocks, with how often the block is taken ``whole``, how many words of it in ``part``, and the first shard of either."""
    cut = F.col("words") < block_words
    takes = slots.groupBy("__s", "block").agg(
        F.sum(F.when(cut, 0).otherwise(1)).alias("whole"), F.max(F.when(cut, F.col("words")).otherwise(0)).alias("part"),
        F.min(F.when(~cut, F.col("shard"))).alias("shard"), F.min(F.when(cut, F.col("shard"))).alias("cut_shard"),
    )
    # slots grow out of a small table of counts, whose size would make Spark broadcast them
    return _pieces(placed, block_words).join(takes.hint("merge"), ["__s", "block"])


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    bin_rows: int = BIN_ROWS,
    max_sources: int = MAX_SOURCES,
    seed: int = SEED,
    draw_seed: int = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: its columns but ``text``, ``size``, ``source_size``, ``target``, ``taken``, ``first_shard``.

    ``weights`` repeat over the sources in code-point order, null last. Sizes
    are word counts of whole texts (null: 0). ``first_shard`` is the first output shard that has a word of the row, null if none has. Rows without words are taken 0
    times; an empty table, or one without words, gives targets of 0. Rows that
    are repeated are rows of their own, in any order among themselves; null ids sort first; texts may be of any length. More than ``max_sources`` sources are
    refused, as their table is held by the driver and broadcast. Input columns
    with a result's name are replaced; names that begin with two underscores are reserved.
    """
    row = F.struct(*(quoted(c) for c in docs.columns if c not in RESULTS)).alias("__row")
    placed, sources, plan = _placed(docs.select("doc_id", "text", "source", row), weights, share, most, block_words, bin_rows, max_sources, seed)
    if not sum(p["quota"] for p in plan):
        return placed.select("__row.*", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    slots = _slot_blocks(docs.sparkSession, sources, plan, block_words, shard_slots, seed, draw_seed)
    got = F.col("whole") * (F.col("b") - F.col("a")) + F.greatest(F.lit(0), F.least("b", "part") - F.col("a"))
    shard = F.min(F.least(F.col("shard"), F.when(F.least("b", "part") > F.col("a"), F.col("cut_shard"))))
    taken = _takes(placed, slots, block_words).groupBy("__s", "__bin", "__rn").agg(F.sum(got).cast("long").alias("taken"), shard.alias("first_shard"))
    out = placed.join(taken, ["__s", "__bin", "__rn"], "left")
    return out.select("__row.*", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mix_shards(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
    draw_seed: int = SEED,
) -> DataFrame:
    """The mix by output shard: (shard, source, ordinal, doc_id, lo, hi), words lo to hi - 1 of a document in a slot of a source.

    ``ordinal`` numbers the slots of a source over all shards. Nulls, ties and empty tables are as in ``mix_sources``.
    """
    placed, sources, plan = _placed(docs.select("doc_id", "text", "source"), weights, share, most, block_words, BIN_ROWS, MAX_SOURCES, seed)
    if not sum(p["quota"] for p in plan):
        return placed.select(F.lit(0).cast("long").alias("shard"), "source", F.lit(0).cast("long").alias("ordinal"), "doc_id", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")).limit(0)
    slots = _slot_blocks(docs.sparkSession, sources, plan, block_words, shard_slots, seed, draw_seed)
    met = _pieces(placed.select("__s", "__bin", "__rn", "__off", "size", "source", "doc_id"), block_words, "source", "doc_id").join(slots.hint("merge"), ["__s", "block"])
    at = F.col("block") * block_words - F.col("__off")
    return met.select("shard", "source", "ordinal", "doc_id", (at + F.col("a")).alias("lo"), (at + F.least("b", "words")).alias("hi")).filter("hi > lo")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, copies: int = 2) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each document and each time that words of it are taken.

    A copy that takes all words is the whole text; another has the words taken,
    in order, each with the blanks behind it. ``n_chars``, if there is one, is the
    length of the new text. At most ``copies`` copies are taken of any word. Other columns pass through, whatever their names; those that
    begin with two underscores are reserved. Nulls, ties, repeated rows and long texts are as in ``mix_sources``; rows alike in id and text
    are taken from any of them. An empty table, or one without words, gives none.
    """
    placed, sources, plan = _placed(docs.select("doc_id", "text", "source"), WEIGHTS, SHARE, float(copies), block_words, BIN_ROWS, MAX_SOURCES, SEED)
    if not sum(p["quota"] for p in plan):
        return docs.limit(0)
    takes = _takes(placed, _slot_blocks(docs.sparkSession, sources, plan, block_words, SHARD_SLOTS, SEED, SEED), block_words)
    at = F.col("block") * block_words - F.col("__off")  # a word's place in its document, less its place in the block
    piece = lambda k: F.struct(
        F.lit(k).alias("k"), (at + F.col("a")).alias("lo"),
        (at + F.when(F.col("whole") >= k, F.col("b")).when(F.col("whole") == k - 1, F.least("b", "part")).otherwise(F.lit(0))).alias("hi"),
    )
    pieces = takes.select("__s", "__bin", "__rn", F.explode(F.filter(F.array(*[piece(k + 1) for k in range(copies)]), lambda p: p["hi"] > p["lo"])).alias("p"))
    runs = pieces.groupBy("__s", "__bin", "__rn", F.col("p.k").alias("k")).agg(F.sort_array(F.collect_list(F.struct("p.lo", "p.hi"))).alias("runs"))
    # rows of one source, id and text are alike: their copies are gathered, and one of the rows carries them all
    key = ["__h", "__id"]
    wanted = runs.join(placed.select("__s", "__bin", "__rn", "__h", F.col("doc_id").alias("__id"), "size"), ["__s", "__bin", "__rn"])
    wanted = wanted.groupBy(*key, "__s").agg(F.collect_list(F.struct("runs", "size")).alias("__copies"))
    own = docs.select(
        F.struct("*").alias("__row"), F.col("text").alias("__text"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text")).alias("__h")
    ).join(F.broadcast(sources.select("__s", F.col("__source").alias("__name"))), F.col("__source").eqNullSafe(F.col("__name")))
    first = own.withColumn("__i", F.row_number().over(W.partitionBy(*key, "__s").orderBy(F.lit(0)))).filter("__i = 1")
    met = first.join(wanted, (first["__h"] == wanted["__h"]) & first["__id"].eqNullSafe(wanted["__id"]) & (first["__s"] == wanted["__s"]))
    words = F.regexp_extract_all("__text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    one = met.select("__row", "__text", F.explode("__copies").alias("__c"))
    cut = let(words, lambda w: F.array_join(F.flatten(F.transform("__c.runs", lambda r: F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), ""))
    whole = F.aggregate("__c.runs", F.lit(0).cast("long"), lambda acc, r: acc + r["hi"] - r["lo"]) == F.col("__c.size")
    out = one.withColumn("__text", F.when(whole, F.col("__text")).otherwise(cut))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*((new[c] if c in new else F.col("__row")[c]).alias(c) for c in docs.columns))
