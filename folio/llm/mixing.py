"""Mixing sources to target weights by a splitting tree of block quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD, small, staged

#: Most blocks of one source; below that a source of n rows has about sqrt(n) blocks.
BLOCKS = 4096
#: No source is used more often than this.
PASSES = 3
#: A uniform number is made of this many hash bits.
BITS = 53
#: Buckets of each output shard in which its copies are ordered.
PLACES = 1024
#: Documents that are added one by one where whole blocks and the last block's documents leave words missing.
TOP_UPS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A key that is never null: sources may be."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def targets(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """(key, source, docs, words) -> the same with ``rank`` and ``target``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. All words are shared by weight; a share over ``passes`` times its source's words stops
    there and the rest is shared again, until none is above. Sorted by words per weight this has one solution: the first source that is not
    stopped, given all those before it are, sets the level for it and those after it. The table of sources is the mixture's recipe and is ranked as one.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.col("rank") % 3 + 1).withColumn("limit", (F.lit(passes) * F.col("words")).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("words").over(every) - before) / rest
    ranked = ranked.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= F.col("limit"))
    first = F.min_by("_level", F.when(F.col("_free"), F.struct(F.col("limit") / F.col("weight"), F.col("rank")))).over(every)
    return ranked.withColumn("target", F.least(F.col("limit"), F.coalesce(first, F.lit(0.0)) * F.col("weight"))).drop("_level", "_free", "weight", "limit")


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """One row with ``quotas array<bigint>`` (blocks of each source) -> rows (shard, quotas) whose sum is the input.

    Each node of the tree over shards sends its share of blocks to the left half. How many of each source go is a draw without replacement: source by
    source a hypergeometric number, taken by weighted choice along its support, so that the whole is a multivariate hypergeometric draw.
    """
    uniform = f"(pmod(xxhash64({seed}L, lo, hi, size(acc.took), k), {1 << BITS}L) + 0.5D) / {float(1 << BITS)}D"
    low = "greatest(0L, q + acc.room - acc.total)"
    draw = f"""aggregate(sequence({low}, least(q, acc.room)),
        named_struct('x', 0L, 'w', 1D, 'all', 0D),
        (d, k) -> named_struct(
            'x', if({uniform} * (d.all + d.w) < d.w, k, d.x),
            'w', d.w * ((q - k) * (acc.room - k)) / ((k + 1D) * greatest(1L, acc.total - q - acc.room + k + 1)) / if(d.all > 1e200D, 1e200D, 1D),
            'all', (d.all + d.w) / if(d.all > 1e200D, 1e200D, 1D)),
        d -> d.x)"""
    merge = f"""transform(array({draw}), x -> named_struct('total', acc.total - q, 'room', acc.room - x, 'took', concat(acc.took, array(x))))[0]"""
    left = f"""aggregate(quotas, named_struct('total', total, 'room', (total * (mid - lo)) div (hi - lo), 'took', cast(array() as array<bigint>)), (acc, q) -> {merge}, acc -> acc.took)"""
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), "quotas")
    for _ in range(max(0, (n_shards - 1).bit_length())):
        sized = nodes.withColumn("mid", F.expr("(lo + hi) div 2").cast("int")).withColumn("total", F.expr("aggregate(quotas, 0L, (a, q) -> a + q)"))
        drawn = sized.withColumn("left", F.expr(f"if(mid = lo, quotas, {left})"))
        halves = F.expr(
            "if(mid = lo, array(struct(lo, hi, quotas)), array(struct(lo, mid as hi, left as quotas), struct(mid as lo, hi, zip_with(quotas, left, (a, b) -> a - b) as quotas)))"
        )
        nodes = drawn.select(F.explode(halves).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def local_shuffle(copies: DataFrame, seed: int) -> DataFrame:
    """(_id, _h, copy, shard) -> (_id, slots): where each copy comes in its shard, in hashed order, from 0 without gaps.

    A shard's copies fall into buckets by the leading bits of their hashes; the buckets' counts add up to offsets, and each bucket is ordered for itself.
    """
    mixed = copies.withColumn("_o", F.xxhash64(F.lit(seed), "shard", "_h", "copy")).withColumn("_bucket", F.floor(F.shiftrightunsigned("_o", 1) / (2**63 // PLACES)).cast("int"))
    mixed = staged(mixed, "copies")
    upto = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = mixed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.shiftrightunsigned("_o", 1), "_o", "_id", "copy")
    placed = mixed.withColumn("_k", F.row_number().over(inside) - 1).join(small(staged(offsets, "offsets")), ["shard", "_bucket"])
    slot = F.struct("copy", (F.col("_offset") + F.col("_k")).alias("slot"))
    return placed.groupBy("_id").agg(F.transform(F.sort_array(F.collect_list(slot)), lambda x: x["slot"]).alias("slots"))  # a document has few copies


def mix_documents(docs: DataFrame, n_shards: int = 16, seed: int = 5, passes: int = PASSES, carry: list[str] | None = None, with_slots: bool = False) -> DataFrame:
    """Columns of ``docs`` (those in ``carry``, or all) plus ``size``, ``source_size``, ``target``, ``taken`` and ``shards`` (the output shard of each copy taken).

    With ``with_slots`` also ``slots``: the shards are shuffled locally, and each copy has a place in its shard.

    A source's documents fall into blocks by hash and the blocks into a hashed order. The source gives whole passes over its blocks and then the first
    blocks of another pass up to its target; in the block where the target falls documents are taken in hashed order, and last, one after another, up to
    TOP_UPS documents of the source that are in fewer than ``passes`` times and come nearest to what is missing. The splitting tree deals each source's block draws to the output shards; draws are used in order, so
    shards get disjoint ones. Everything is a hash of the rows: reruns agree. Null text has no words, a null source is a source of its own, rows of
    no words are taken like others, equal rows are dealt each (which of them is taken twice is left open, they being equal), an empty table gives an
    empty result, and clashing columns of ``docs`` are replaced.
    """
    made = ("size", "source_size", "target", "taken", "shards", "slots")
    keep = [c for c in carry or docs.columns if c not in made]
    body = [c for c in keep if c != "source"]
    sized = docs.select("source", F.struct(*body).alias("_row"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))
    sized = staged(sized.withColumn("_key", _key(F.col("source"))).withColumn("_id", F.monotonically_increasing_id()), "sized")

    per = sized.groupBy("_key").agg(F.first("source").alias("source"), F.count("*").alias("docs"), F.sum("size").alias("words"))
    per = targets(per, passes).withColumn("n_blocks", F.least(F.lit(BLOCKS), F.ceil(F.sqrt("docs"))).cast("long"))
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(F.lit(1)).cast("long")
    per = per.withColumn("whole", F.least(whole, F.lit(passes))).withColumn("left_over", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("words")))
    per = staged(per, "sources")
    facts = small(per.select("_key", F.col("words").alias("source_size"), "target", "n_blocks", "whole", "left_over"))

    blocked = sized.join(facts, "_key").withColumn("_block", F.pmod("_h", "n_blocks"))
    order = Window.partitionBy("_key").orderBy(F.xxhash64(F.lit(seed), "_key", "_block"), "_block")
    blocks = blocked.groupBy("_key", "_block", "n_blocks", "whole", "left_over").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("turn", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.col("upto") - F.col("words")
    state = F.when((F.col("upto") <= F.col("left_over")) & (F.col("left_over") > 0), 2).when(before < F.col("left_over"), 1).otherwise(0)
    blocks = staged(blocks.withColumn("state", state).withColumn("room", F.col("left_over") - before), "blocks")

    # how many draws each source makes, and their shards
    draws = blocks.groupBy("_key").agg((F.sum("whole") + F.sum((F.col("state") > 0).cast("long"))).alias("draws"))
    ordered = draws.agg(F.array_sort(F.collect_list(F.struct("_key", "draws"))).alias("all"))
    quotas = split_quotas(ordered.select(F.transform("all", lambda x: x["draws"]).alias("quotas")), n_shards, seed)
    keys = ordered.select(F.transform("all", lambda x: x["_key"]).alias("keys"))
    dealt = quotas.crossJoin(F.broadcast(keys)).select("shard", F.explode(F.arrays_zip("keys", "quotas")).alias("z")).select("shard", F.col("z.keys").alias("_key"), F.col("z.quotas").alias("q"))
    ends = F.sum("q").over(Window.partitionBy("_key").orderBy("shard"))
    cuts = dealt.withColumn("end", ends).groupBy("_key").agg(F.sort_array(F.collect_list("end")).alias("ends"))

    used = blocks.groupBy("_key").agg(F.count("*").alias("n_used"), (F.sum((F.col("state") > 0).cast("long")) - 1).alias("edge"))
    plan = blocks.join(cuts.join(used, "_key"), "_key").select("_key", "_block", "turn", "state", "room", "ends", "n_used", "edge")
    rows = blocked.join(small(plan), ["_key", "_block"])
    cols = [*(F.col("_row")[c].alias(c) if c != "source" else F.col("source") for c in keep), "size", "source_size", F.col("target")]

    # in the block where the target falls: documents in hashed order up to the target
    split = rows.filter("state = 1")
    within = Window.partitionBy("_key").orderBy(F.xxhash64(F.lit(seed + 1), "_h"), "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = split.withColumn("_extra", (F.sum("size").over(within) <= F.col("room")).cast("int"))
    rows = staged(rows.filter("state <> 1").withColumn("_extra", F.when(F.col("state") == 2, 1).otherwise(0)).unionByName(split), "drawn")

    # then, up to TOP_UPS times, the one document of the source that comes nearest to what is still missing
    missing = rows.filter("state = 1").groupBy("_key").agg((F.first("room") - F.sum(F.col("_extra") * F.col("size"))).alias("missing"))
    for _ in range(TOP_UPS):
        off = F.abs(F.col("size") - F.col("missing"))
        fit = rows.filter(F.col("whole") + F.col("_extra") < passes).join(small(missing), "_key").filter(off < F.col("missing"))
        fit = fit.groupBy("_key").agg(F.min_by(F.struct("_id", "size", "missing"), F.struct(off, "_h", "_id")).alias("f"))
        fit = staged(fit.select("_key", F.col("f._id").alias("_fit"), (F.col("f.missing") - F.col("f.size")).alias("missing")), "fit")
        rows = rows.join(small(fit.select("_key", "_fit")), "_key", "left").withColumn("_extra", F.when(F.col("_id") == F.col("_fit"), F.col("_extra") + 1).otherwise(F.col("_extra"))).drop("_fit")
        missing = fit.select("_key", "missing").filter("missing > 0")

    copies = F.col("whole") + F.col("_extra")
    number = F.sequence(F.lit(0).cast("long"), copies - 1)
    place = lambda e: F.least(e, "whole") * F.col("n_used") + F.when(e >= F.col("whole"), F.least("turn", "edge")).otherwise(F.col("turn"))
    shard_of = lambda e: F.size(F.filter("ends", lambda end: end <= place(e)))
    shards = F.when(copies > 0, F.transform(number, shard_of)).otherwise(F.array().cast("array<int>"))
    out = rows.withColumn("taken", copies * F.col("size")).withColumn("shards", shards)
    if not with_slots:
        return out.select(*cols, "taken", "shards")
    out = staged(out, "taken")
    slots = local_shuffle(out.select("_id", "_h", F.posexplode("shards").alias("copy", "shard")), seed + 2)
    return out.join(slots, "_id", "left").select(*cols, "taken", "shards", F.coalesce("slots", F.array().cast("array<bigint>")).alias("slots"))


def op9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_documents(docs, carry=["doc_id"], with_slots=True).select("doc_id", "size", "source_size", "target", "taken", "shards", "slots")
