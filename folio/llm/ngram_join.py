"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import mix, shingle_sets, small, staged, text_blocks, with_each
from folio.llm.components import components

#: A shingle of more documents than this is frequent: two frequent shingles together are one signature.
FREQUENT = 8192
#: Words of 64 bits in a set's parity sketch: each shingle flips one bit, so two sketches differ in no more bits than their sets in shingles.
SKETCH = 16
#: Rounds in which a signature's members are compared with so many of them, drawn by hash, before all pairs left are.
ROUNDS, HEADS = 2, 8
#: Shingles whose documents are counted in one task, and shingles that are compared with one set in one task.
COUNTED, COMPARED = 2_000_000, 1 << 18
#: Buckets of row keys that are broadcast so that texts which nobody asks for stay out of the shuffle; each is a row of one number.
BUCKETS = 1 << 19


def row_key(docs: DataFrame):
    """A key of a row that is never null and that rows of other texts don't share, whatever their doc_id."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def needed(n, t: int):
    """Shingles that a set of n shares with any set of Jaccard similarity t / 100 or more: ceil(t n / 100)."""
    return (t * n + 99) // 100


def _sets(column, k: int):
    """(first row, classes, sizes, shingles, bounds) of each block of texts; a class is the hash of the whole set."""
    for at, raw, off in text_blocks(column):
        value, bounds = shingle_sets(raw, off, k)
        n = np.diff(bounds)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value), dtype=np.uint64)])
            cls = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)
        yield at, cls, n, value, bounds


def chunks(docs: DataFrame, k: int, t: int) -> DataFrame:
    """Texts as chunks: the documents' row keys, classes and sizes, and for each class in the chunk 32-bit keys of its shingles.

    Every other key is kept, those with an even number; they come first in the common order of shingles. Where they are fewer than the prefix, the
    smallest odd ones follow.
    """

    def run(batches):
        import pyarrow as pa

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, cls, n, value, bounds in _sets(batch.column(1), k):
                first = np.unique(cls, return_index=True)[1]
                first = first[n[first] > 0]
                # a set that only equal sets can match needs no keys
                alone = (n[first] * 100 // t == n[first]) & (needed(n[first], t) == n[first])
                owner = np.repeat(np.arange(len(n)), n)
                number = np.full(len(n), -1)
                number[first[~alone]] = np.arange((~alone).sum())
                key, own = (value >> np.uint64(32)).astype(np.uint32), number[owner]
                key, own = key[own >= 0], own[own >= 0]
                order = np.lexsort((key, key & np.uint32(1), own))
                key, own = key[order], own[order]
                size = n[first[~alone]]
                start = np.cumsum(size) - size
                rank = np.arange(len(key)) - start[own]
                keep = ((key & np.uint32(1)) == 0) | (rank <= size[own] - needed(size[own], t) + 1)
                kept = np.bincount(own[keep], minlength=len(size))
                bit = (value & np.uint64(64 * SKETCH - 1)).astype(np.int64)[number[owner] >= 0]
                flips = np.bincount(number[owner][number[owner] >= 0] * 64 * SKETCH + bit, minlength=len(size) * 64 * SKETCH)
                sketch = np.packbits((flips & 1).astype(np.uint8)).view(np.int64)
                one = lambda v, ty: pa.array([v.tolist()], pa.list_(ty))
                ids, rows = (pa.array([batch.column(i).slice(at, len(n)).to_pylist()], pa.list_(pa.int64())) for i in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), ids, rows, one(cls, pa.int64()), one(n, pa.int64()), one(cls[first[~alone]], pa.int64()), one(size, pa.int64()), one(kept, pa.int64()), one(sketch, pa.int64()), pa.array([key[keep].tobytes()], pa.binary())],
                    ["chunk", "doc_id", "doc_row", "doc_cls", "doc_n", "cls", "n", "kept", "sketches", "keys"],
                )
                chunk += 1

    schema = "chunk long, doc_id array<long>, doc_row array<long>, doc_cls array<long>, doc_n array<long>, cls array<long>, n array<long>, kept array<long>, sketches array<long>, keys binary"
    return docs.select(F.col("doc_id").cast("long"), "text", row_key(docs)).mapInArrow(run, schema)


def frequency_classes(table: DataFrame) -> DataFrame:
    """(chunk, classes): for each distinct even key of a chunk, in order, one byte: 0 if one chunk entry has it, else 1 + log2 of how many.

    Keys go as sorted arrays to the task that counts their range of values, and their classes come back the same way.
    """
    total = table.agg(F.sum(F.octet_length("keys") / 4)).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, total / COUNTED))), 0, 24))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = np.frombuffer(raw, np.uint32)
                key, count = np.unique(key[(key & np.uint32(1)) == 0], return_counts=True)
                part = (key.astype(np.uint64) >> np.uint64(32 - bits)).astype(np.int64)
                q, at = np.unique(part, return_index=True)
                ends = np.append(at[1:], len(key))[: len(at)]  # none if no key is even
                count = np.minimum(count, 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int32()), pa.array(np.full(len(q), chunk), pa.int64()), pa.array([key[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([count[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())],
                    ["q", "chunk", "keys", "counts"],
                )

    def count(group):
        import pyarrow as pa

        keys = [np.frombuffer(b, np.uint32) for b in group.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(b, np.uint16) for b in group.column("counts").to_pylist()])
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(back, counts)
        cls = np.where(df > 1, 1 + np.ceil(np.log2(np.maximum(df, 1))), 0).astype(np.uint8)[back]
        ends = np.cumsum([len(x) for x in keys])
        rows = [cls[e - len(x) : e].tobytes() for x, e in zip(keys, ends, strict=True)]
        return pa.table({"q": group.column("q"), "chunk": group.column("chunk"), "classes": pa.array(rows, pa.binary())})

    dealt = table.select("chunk", "keys").mapInArrow(deal, "q int, chunk long, keys binary, counts binary")
    counted = dealt.groupBy("q").applyInArrow(count, "q int, chunk long, classes binary")
    return counted.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("q", "classes"))).alias("parts")).select("chunk", F.transform("parts", lambda p: p["classes"]).alias("classes"))


def signatures(table: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """(sig, frequent, cls, n, rank): the shingles in the extended prefix of each class that others have too.

    The order is by frequency class, then by key, odd keys last. Of two sets that reach the threshold the first n - ceil(t n / 100) + 1 shingles share
    one, and the first n - ceil(t n / 100) + 2 share two; if the shared ones are all frequent, two of them are a shared combination.
    """
    limit = 1 + int(np.ceil(np.log2(FREQUENT)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for cls, n, kept, raw, parts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                key, n, kept = np.frombuffer(raw, np.uint32), np.array(n, np.int64), np.array(kept, np.int64)
                even = (key & np.uint32(1)) == 0
                band = np.full(len(key), 255, np.uint8)
                if parts:
                    distinct, back = np.unique(key[even], return_inverse=True)
                    band[even] = np.frombuffer(b"".join(parts), np.uint8)[back]
                own = np.repeat(np.arange(len(n)), kept)
                order = np.lexsort((key, band, own))
                key, band, own = key[order], band[order], own[order]
                rank = np.arange(len(key)) - (np.cumsum(kept) - kept)[own]
                use = (rank < n[own] - needed(n[own], t) + 2) & (band > 0)
                frequent = (band > limit) & (band < 255)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[use].astype(np.int64)), pa.array(frequent[use]), pa.array(np.array(cls, np.int64)[own[use]] if len(n) else np.zeros(0, np.int64)), pa.array(n[own[use]]), pa.array(rank[use])],
                    ["sig", "frequent", "cls", "n", "rank"],
                )

    joined = table.select("chunk", "cls", "n", "kept", "keys").join(classes, "chunk", "left").select("cls", "n", "kept", "keys", "classes")
    made = joined.mapInArrow(run, "sig long, frequent boolean, cls long, n long, rank long")
    return made.groupBy("sig", "frequent", "cls", "n").agg(F.min("rank").alias("rank"))


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, k: int, t: int) -> DataFrame:
    """(a, b, n: size of b) -> links (a, b): the pairs of classes whose sets reach the threshold.

    One document of each class (``owners``: cls, row) is read again and its whole set goes to the tasks of the sets it is compared with; a set with
    many partners has several tasks.
    """
    tasks = pairs.groupBy("a").agg(F.ceil(F.sum("n") / COMPARED).alias("tasks"))
    sent = pairs.join(tasks, "a").select(F.col("b").alias("cls"), F.col("a").alias("center"), F.pmod(F.xxhash64("b"), "tasks").alias("task"), F.lit(False).alias("own"))
    own = tasks.select(F.col("a").alias("cls"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(True).alias("own"))
    need = sent.union(own).groupBy("cls").agg(F.collect_list(F.struct("center", "task", "own")).alias("to")).join(owners, "cls")
    need = staged(need.select("row", "cls", "to"), "need")

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            asked, to = batch.column(1).to_pylist(), batch.column(2)
            for at, cls, _, value, bounds in _sets(batch.column(0), k):
                rows = []
                for i, c in enumerate(cls.tolist()):
                    if c == asked[at + i]:
                        body = value[bounds[i] : bounds[i + 1]].tobytes()
                        rows += [(x["center"], x["task"], c, x["own"], body) for x in to[at + i].as_py()]
                made = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(made, types, strict=True)], ["center", "task", "cls", "own", "body"])

    def compare(group):
        import pyarrow as pa

        cls, own = group.column("cls").to_numpy(), group.column("own").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(b, np.uint64) for b in group.column("body").to_pylist()]
        linked = []
        if own.any():
            center = sets[int(np.argmax(own))]
            for c, o, s in zip(cls.tolist(), own.tolist(), sets, strict=True):
                if not o:
                    shared = int((center[np.minimum(np.searchsorted(center, s), len(center) - 1)] == s).sum())
                    if 100 * shared >= t * (len(center) + len(s) - shared):
                        linked.append(c)
        a = group.column("center")[0].as_py()
        return pa.table({"a": pa.array([a] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    bucket = lambda: F.pmod("row", F.lit(BUCKETS)).alias("bucket")
    held = F.broadcast(need.select(bucket()).distinct())  # BUCKETS rows at most
    texts = docs.select(row_key(docs).alias("row"), "text").withColumn("bucket", bucket()).join(held, "bucket", "left_semi")
    texts = texts.join(small(need, "to"), "row").select("text", "cls", "to")
    out = texts.mapInArrow(send, "center long, task long, cls long, own boolean, body binary").groupBy("center", "task").applyInArrow(compare, "a long, b long")
    return staged(out.distinct(), "verified")


def _fit(a, b, t: int):
    return 100 * F.least(a, b) >= t * F.greatest(a, b)


def _near(a, b, na, nb, t: int):
    """May sets with these sketches reach the threshold? They differ in (100 - t) / (100 + t) of their shingles at most."""
    bits = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH)), F.lit(0))
    return (100 + t) * bits <= (100 - t) * (na + nb)


def links(docs: DataFrame, k: int, t: int) -> tuple[DataFrame, DataFrame]:
    """(documents with row key, class and size, links between classes that connect all that are connected).

    First each signature's members are compared with one of them, and then with ROUNDS others, and the linked ones are joined to components. Then whatever pairs a signature still has
    between different components are compared: members of rare signatures all, those of frequent ones if they share two.
    """
    table = staged(chunks(docs, k, t), "chunks")
    owned = table.select(F.explode(F.arrays_zip("doc_id", "doc_row", "doc_cls", "doc_n")).alias("d")).select("d.doc_id", F.col("d.doc_row").alias("row"), F.col("d.doc_cls").alias("cls"), F.col("d.doc_n").alias("n"))
    owners = owned.filter("n > 0").groupBy("cls").agg(F.min("row").alias("row"))

    sigs = staged(signatures(table, frequency_classes(table), t), "signatures")
    cut = F.transform(F.sequence(F.lit(1), F.size("cls")), lambda i: F.slice("sketches", (i - 1) * SKETCH + 1, SKETCH))
    sketched = table.filter(F.size("cls") > 0).select(F.explode(F.arrays_zip("cls", cut.alias("s"))).alias("z")).select("z.cls", F.col("z.s").alias("s"))
    sketched = staged(sketched.groupBy("cls").agg(F.first("s").alias("s")), "sketches")
    of = lambda name: sketched.select(F.col("cls").alias(name), F.col("s").alias(f"s{name}"))

    heads = sigs.groupBy("sig").agg(F.min(F.struct("cls", "n")).alias("head"), F.count("*").alias("m")).filter("m > 1").select("sig", F.col("head.cls").alias("a"), F.col("head.n").alias("na"), "m")
    star = with_each(sigs, staged(heads, "heads"), "sig", "m").filter(F.col("a") != F.col("cls")).filter(_fit("n", "na", t)).select("a", F.col("cls").alias("b"), "na", "n").distinct()
    star = star.join(of("a"), "a").join(of("b"), "b").filter(_near(F.col("sa"), F.col("sb"), F.col("na"), F.col("n"), t)).select("a", "b", "n")
    star = staged(star, "star")
    first = verified(star, docs, owners, k, t)

    comps, open_ = components(first), None
    for turn in range(ROUNDS + 1):
        members = sigs.join(comps.join(comps.groupBy("comp").agg(F.count("*").alias("members")), "comp").withColumnRenamed("node", "cls"), "cls", "left")
        members = members.withColumn("comp", F.coalesce("comp", "cls")).withColumn("members", F.coalesce("members", F.lit(1)))
        mixed = members.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("sig")
        open_ = staged(members.join(mixed, "sig", "left_semi").join(sketched, "cls"), "open")
        if turn < ROUNDS:  # other members of each signature, first of its largest component, for the rest to be compared with
            draw = lambda j: F.struct(-F.col("members") if turn % 2 == 0 else F.lit(0).cast("long"), F.xxhash64(F.lit(turn), F.lit(j), "sig", "cls"))  # noqa: E731, B023
            head = F.struct("cls", "n", "comp", "s")
            heads = open_.groupBy("sig").agg(F.array_distinct(F.array(*(F.min_by(head, draw(j)) for j in range(HEADS)))).alias("heads"), F.count("*").alias("m"))
            again = with_each(open_, staged(heads, "heads"), "sig", "m").select("cls", "n", "comp", "s", F.explode("heads").alias("head"))
            again = again.filter((F.col("comp") != F.col("head.comp")) & _fit("n", F.col("head.n"), t))
            again = again.filter(_near(F.col("s"), F.col("head.s"), F.col("n"), F.col("head.n"), t))
            again = again.select(F.col("head.cls").alias("a"), F.col("cls").alias("b"), "n").distinct()
            again = staged(again.join(star.select("a", "b").union(star.select("b", "a")), ["a", "b"], "left_anti"), "star")
            first = first.union(verified(again, docs, owners, k, t))
            star, comps = star.union(again), components(first)
    several = open_.filter("frequent").groupBy("cls", "n", "comp").agg(F.sort_array(F.collect_set("sig")).alias("all"), F.first("s").alias("s"))
    left = several.select("cls", "n", "comp", "s", "all", F.posexplode("all").alias("i", "x"))
    combined = left.select("cls", "n", "comp", "s", "x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    combined = combined.select(F.xxhash64("x", "y").alias("sig"), F.lit(True).alias("combined"), "cls", "n", "comp", F.lit(0).cast("long").alias("rank"), "s")
    both = open_.filter("not frequent").select("sig", F.lit(False).alias("combined"), "cls", "n", "comp", "rank", "s").union(combined)
    other = both.select("sig", "combined", *(F.col(c).alias(f"{c}_a") for c in ("cls", "n", "comp", "rank", "s")))
    size = F.col("n") + F.col("n_a")
    # the first shared shingle leaves room for all that must be shared
    room = (100 + t) * F.least(F.col("n") - F.col("rank"), F.col("n_a") - F.col("rank_a")) >= t * size
    rest = both.alias("x").join(other.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.combined") == F.col("y.combined")) & (F.col("comp_a") < F.col("comp")) & room & _near(F.col("s"), F.col("s_a"), F.col("n"), F.col("n_a"), t))
    rest = rest.select(F.col("cls_a").alias("a"), F.col("cls").alias("b"), "n").distinct()
    known = star.select("a", "b").union(star.select("b", "a"))
    rest = staged(rest.join(known, ["a", "b"], "left_anti"), "rest")
    if rest.isEmpty():
        return owned, comps
    return owned, components(first.union(verified(rest, docs, owners, k, t)))


def join_components(docs: DataFrame, k: int = 4, t: int = 85) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id): the smallest doc_id that links of Jaccard similarity t / 100 or more reach.

    A document's set is its distinct k-word shingles, A-Z as a-z; with fewer words it is the whole word sequence, without words or text it is empty and
    linked with nothing. Documents of equal sets are linked (one class). Repeated rows each get a row. A null doc_id gets a row too; it is no component's id
    unless it is alone, then null. An empty table gives an empty result; other columns are not read. Sets are compared by 64-bit shingle hashes.
    """
    owned, comps = links(docs, k, t)
    least = owned.groupBy("cls").agg(F.min("doc_id").alias("low"))
    comps = staged(least.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "classes")
    lowest = comps.groupBy("comp").agg(F.min("low").alias("component_id"), F.count("*").alias("m"))
    ids = with_each(comps.select("comp", "cls"), lowest, "comp", "m").select("cls", "component_id")
    full = owned.filter("n > 0").join(ids, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(owned.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """The document of lowest doc_id of each component, columns as they are; of repeated rows of one doc_id and text one stays.

    Rows are told apart by doc_id and text. A null doc_id comes after all others, so it stays if its component has no other; if one doc_id has several texts,
    each is judged by its own component. Documents without words all stay.
    """
    owned, comps = links(docs, k, t)
    placed = owned.filter("n > 0").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    best = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("_row")).select("_row")
    keep = best.union(owned.filter("n = 0").select("row")).distinct()
    return docs.join(keep, row_key(docs) == F.col("_row"), "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def op7_combination_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
