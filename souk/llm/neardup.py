"""Near duplicates by bottom-k sketches of one hash function.

1. Each text becomes its set of hashed word trigrams; the ``K`` smallest hashes are its sketch. Texts of the same set
   are near copies at once; the first of them stands for all in what follows.
2. Inverted lists of the retained values give the overlaps. A pair whose union sketch agrees in a
   share ``tau`` has at least ``ceil(tau * L)`` values in common with a sketch of ``L`` values, so it
   meets in the ``L - ceil(tau * L) + 1`` rarest of them (any fixed order would do; the rarest first
   keeps the lists of widely shared passages out). Values that only one text retains have no list.
3. Within a list each text is first compared with the list's first text only, which is linear. After
   the verified pairs are joined to components, lists that still hold several components give every
   pair across components not compared yet. No other pair can change the components: both its ends
   lie in one already. So nothing is capped and nothing is quadratic in the size of a group; what is quadratic is the
   number of texts in a list that aren't near each other, which takes over 40 % of each text in common with them.
4. Pairs are filtered by the Jaccard estimate from the union sketch, then verified by the exact
   Jaccard of the whole shingle sets.

Counts and minima by value are aggregates that combine before their shuffle and are then joined, so that a value of
every text is no task's work alone: adaptive execution divides the joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.shared import arrow, drop, free_name, table
from souk.llm.textkit import lists, shingle_sets

SHINGLE = 3
K = 64
#: Exact Jaccard of word trigrams from which two texts are near copies.
JACCARD = 0.5
#: Estimate from which a pair is verified: 1.6 standard errors of K values below JACCARD.
ESTIMATE = 0.4
ROUNDS = 40
#: Above the size of any sketch, a power of two.
K_ROOM = 1 << 12
#: Texts that one task compares with a text.
EACH = 2000


def sketches(docs: DataFrame, width: int = SHINGLE, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, sketch: the k smallest distinct shingle hashes, ascending, key: of the set); texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, keys = [], [], []
            for s in shingle_sets(batch.column(1), width):
                sizes.append(len(s))
                kept.append(s[:k].view(np.int64))
                keys.append(blake2b(s, digest_size=16).digest())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), lists(kept, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "sketch", "key"])
            yield out.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("key", T.BinaryType())])
    return arrow(docs.select("doc_id", "text"), run, schema)


def inverted(sk: DataFrame, tau: float = ESTIMATE) -> DataFrame:
    """(value, doc_id): the inverted lists of each sketch's rarest values, as many as ``tau`` needs, without lists of one.

    ``sk`` has a row for each key.
    """
    # the values travel with eight bytes for the key and the size of the sketch: enough to tell apart the texts of one doc_id
    short = F.xxhash64("key").bitwiseAND(F.lit(-K_ROOM)).bitwiseOR(F.size("sketch").cast("bigint"))
    rows = sk.select("doc_id", short.alias("of"), F.explode("sketch").alias("value"))
    shared = rows.groupBy("value").agg(F.count("*").alias("held_by")).filter("held_by > 1")
    # the values held by one text alone come first in the order; those left fill the rest of the prefix
    per = rows.join(shared, "value").groupBy("doc_id", "of").agg(F.sort_array(F.collect_list(F.struct("held_by", "value"))).alias("shared"))
    need = F.ceil(F.col("of").bitwiseAND(F.lit(K_ROOM - 1)) * F.lit(tau)).cast("int")
    first = F.size("shared") - need + 1
    return per.filter(first > 0).select("doc_id", F.explode(F.slice("shared", F.lit(1), F.greatest(first, F.lit(1)))).alias("s")).select("doc_id", F.col("s.value").alias("value"))


def estimated(pairs: DataFrame, sk: DataFrame, k: int = K, tau: float = ESTIMATE, jaccard: float = JACCARD) -> DataFrame:
    """The pairs (a, b) whose sizes allow the Jaccard and whose union sketch estimates at least tau."""
    left = sk.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sk.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") >= jaccard * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                values, times = np.unique(np.concatenate([x, y]), return_counts=True)
                found.append(float((times[:k] == 2).mean()) >= tau)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    return arrow(both.select("a", "b", "s_a", "s_b"), run, T.StructType([f for f in both.schema.fields if f.name in "ab"]))


def verified(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """(a, b, jaccard) of the pairs whose whole shingle sets reach the Jaccard.

    A pair's second text travels to its first, whose shingles are then computed once for all its pairs, ``EACH`` at a time.
    """
    kind = texts.schema["doc_id"].dataType
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / EACH).cast("int").alias("parts"))
    second = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "part", "b", "text")
    first = sizes.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(kind).alias("b"), "text")
    met = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            rows = []
            for a, b, part, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), shingle_sets(batch.column(2), width)):
                if (a, part) != at:
                    at, own = (a, part), []
                if b is None:
                    own.append(s)
                    continue
                for o in own:
                    common = len(np.intersect1d(o, s, assume_unique=True))
                    if (j := common / max(1, len(o) + len(s) - common)) >= jaccard:
                        rows.append((a, b, j))
            a, b, j = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, batch.schema.field(0).type), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])

    return arrow(met, run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("jaccard", T.DoubleType())]))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root) for every end of an edge (a, b): root is the smallest id of its component.

    Alternates large-star and small-star, each one shuffle over at most as many edges as there were;
    the number of rounds grows with the logarithm of the longest path.
    """
    now = table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        both = now.union(now.select("v", "u"))
        least = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))
        large = least.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = low.select("u", F.col("m").alias("v")).union(low.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        last, now = now, table(small, "edges")
        drop(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _across(lists_: DataFrame, groups: DataFrame, compared: DataFrame) -> DataFrame:
    """The pairs of different components within a list that weren't compared yet, written."""
    named = lists_.join(groups, "doc_id", "left").select("value", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    several = named.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("value")
    held = table(named.join(several, "value"), "across")
    x, y = (held.select("value", F.col("doc_id").alias(f"d{n}"), F.col("root").alias(f"r{n}")) for n in "xy")
    met = x.join(y, "value").filter("rx < ry")
    rest = table(met.select(F.least("dx", "dy").alias("a"), F.greatest("dx", "dy").alias("b")).distinct().join(compared, ["a", "b"], "left_anti"), "rest")
    drop(held)
    return rest


def links(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, k: int = K, jaccard: float = JACCARD, tau: float = ESTIMATE) -> DataFrame:
    """(doc_id, duplicate_of): every document of a group of near copies but its first (smallest doc_id).

    A group is a connected component of the pairs whose Jaccard of word trigrams reaches ``jaccard``.
    Rows sharing a doc_id are one document, near another if any of their texts is; so repeated rows
    don't pair with themselves. Null ids, null or wordless texts and other columns never match.
    Texts below ``width`` words match only on the same words. Texts of any length count whole. Ties don't arise:
    the sets decide. An empty table gives no rows.
    """
    if not 0 < k < K_ROOM:
        raise ValueError(f"a sketch has from 1 to {K_ROOM - 1} values")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    every = table(sketches(docs, width, k), "sketches")
    one = F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("one")
    sk = table(every.groupBy("key").agg(one, F.max("doc_id").alias("latest")).select("key", "one.*", "latest"), "sets")
    twins = table(every.select("key", F.col("doc_id").alias("b")).join(sk.filter("latest <> doc_id").select("key", F.col("doc_id").alias("a")), "key").filter("a <> b").select("a", "b", F.lit(1.0).alias("jaccard")), "twins")
    drop(every)
    inv = table(inverted(sk, tau), "inverted")
    able = inv.select("doc_id").distinct()
    held = table(sk.join(able, "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch"), "held")
    drop(sk)
    texts = table(docs.join(able, "doc_id", "left_semi"), "texts")

    first = inv.join(inv.groupBy("value").agg(F.min("doc_id").alias("a")), "value").filter("a <> doc_id")
    star = table(first.select("a", F.col("doc_id").alias("b")).distinct(), "pairs")

    def judged(pairs: DataFrame) -> DataFrame:
        likely = table(estimated(pairs, held, k, tau, jaccard), "likely")
        near = table(verified(likely, texts, width, jaccard), "near")
        drop(likely)
        return near

    by_first = judged(star)
    groups = components(by_first.union(twins))
    rest = _across(inv, groups, star)
    drop(inv, star)
    by_rest = judged(rest)
    drop(rest, held, texts)
    ends = components(by_first.union(by_rest).union(twins))
    drop(by_first, by_rest, twins)
    return ends.filter("doc_id <> root").select("doc_id", F.col("root").alias("duplicate_of"))


def keep(df: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One document of each group of near copies (smallest doc_id), all rows outside groups; columns as they were.

    Rows that share a kept doc_id all stay, as do rows with a null doc_id or a null, empty or wordless text; an empty
    table gives an empty one; columns named like internal ones are kept.
    """
    gone = free_name(df, "near_copy")
    lost = links(df, doc_id, **how).select(F.col("doc_id").alias(gone))
    return df.join(lost, df[doc_id] == lost[gone], "left_anti")
