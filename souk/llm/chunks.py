"""Substring duplicates by content-defined chunking.

A gear hash rolls over the bytes: each byte shifts the hash left by one and adds its table value, so the
top bits depend on the last ``SPAN`` bytes alone. Where they are all set a chunk ends; an insertion moves
the cuts next to it and no others. The first document of each digest is an aggregate, combined before its
shuffle; a chunk that another document had first is a repeat, and neighbouring repeats join to repeated spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.shared import arrow, free_name
from souk.llm.textkit import U, mix, portions, strings

#: Bytes the hash remembers.
SPAN = 16
#: A cut where these many of its top bits are set: every 2**BITS bytes.
BITS = 5
#: A cut less than this after another one is none; chunks longer than MOST are divided.
LEAST, MOST = 8, 256
#: Repeated spans shorter than this many bytes are no passages (a licence line, a shared sentence or two): chunk ends take up to
#: some 100 bytes off either end of a repeat, so of passages of 51, 55 and 60 words 3.5, 2.2 and 0.8 % leave less (the review's figures).
RUN = 128

_GEAR = (mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.uint16)


def cuts(offsets: np.ndarray, data: np.ndarray, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every chunk of the rows; positions in ``data``. A row's chunks depend on its bytes only."""
    n = len(data)
    h = _GEAR[data]
    step = 1
    while step < SPAN:  # the sum of the last 2 * step bytes from the sums of step bytes
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint16(step) if n > step else np.uint16(0)
        h, step = nxt, 2 * step
    mask = np.uint16(((1 << BITS) - 1) << (16 - BITS))
    at = np.flatnonzero((h & mask) == mask) + 1
    row = np.searchsorted(offsets, at, "left") - 1
    # the window lies within the row, and the cut isn't the row's own end
    inside = (at - offsets[row] >= SPAN) & (at < offsets[row + 1])
    at, row = at[inside], row[inside]
    if len(at):
        apart = np.empty(len(at), bool)
        apart[0] = True
        apart[1:] = (np.diff(at) >= least) | (np.diff(row) > 0)
        at, row = at[apart], row[apart]
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.concatenate([offsets[full], at])
    rows = np.concatenate([full, row])
    order = np.argsort(starts, kind="stable")
    starts, rows = starts[order], rows[order]
    ends = np.append(starts[1:], n)
    pieces = -(-(ends - starts) // most)
    if (pieces > 1).any():
        each = np.repeat(np.arange(len(starts)), pieces)
        k = np.arange(len(each)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        s = starts[each] + k * most
        return rows[each], s, np.minimum(s + most, ends[each])
    return rows, starts, ends


def chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, start, bytes, d1, d2): the chunks of each text, whose BLAKE2b digest of 128 bits is (d1, d2)."""
    given = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = strings(batch.column(1))
            for i, j in portions(offsets, 2 << 20):
                off, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                row, s, e = cuts(off, part, least, most)
                raw = part.tobytes()
                digests = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s.tolist(), e.tolist())]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), pa.array(s - off[row], pa.int64()), pa.array(e - s, pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["doc_id", "start", "bytes", "d1", "d2"])

    longs = [T.StructField(n, T.LongType()) for n in ("d1", "d2")]
    return arrow(given, run, T.StructType([given.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("bytes", T.IntegerType()), *longs]))


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_run: int = RUN, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, source_doc_id, span): spans "begin-end" (bytes) that an earlier document has too; earlier: smaller doc_id.

    The source is the document with the first occurrence of most of the span (ties: the smallest). Another
    one with the first occurrence of ``least_run`` neighbouring bytes of it gets a row for that stretch. The
    first occurrence itself isn't returned, nor are repeats within a document, so neither are repeated
    rows of one doc_id. Null ids, null and empty texts have no chunks; texts of any length are cut whole;
    an empty table gives no rows; other columns are ignored. Repeats shorter than ``least_run`` bytes aren't
    passages and have no row; ``least_run=1`` returns every repeated chunk.
    """
    parts = chunks(df, doc_id, text, least, most).filter("doc_id is not null")
    # a chunk of every document is one row a task here, and in the join AQE divides it, as neither side holds it
    first = parts.groupBy("d1", "d2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("latest")).filter("source <> latest").drop("latest")
    again = parts.join(first, ["d1", "d2"]).filter("source <> doc_id").select("doc_id", "start", (F.col("start") + F.col("bytes")).alias("end"), "source")
    along = W.partitionBy("doc_id").orderBy("start", "end", "source")
    opened = again.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    runs = opened.withColumn("run", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    turned = runs.withColumn("before", F.lag("source").over(along)).withColumn("turn", ((F.col("new") == 1) | (F.col("before") != F.col("source"))).cast("int"))
    stretches = turned.withColumn("stretch", F.sum("turn").over(along.rowsBetween(W.unboundedPreceding, 0)))
    each = stretches.groupBy("doc_id", "run", "stretch", "source").agg(F.min("start").alias("begin"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("bytes"))
    long = F.collect_list(F.when(F.col("end") - F.col("begin") >= least_run, F.struct("begin", "end"))).alias("long")
    by = each.groupBy("doc_id", "run", "source").agg(long, F.min("begin").alias("first"), F.max("end").alias("last"), F.sum("bytes").alias("bytes"))
    most_of = F.min(F.struct((-F.col("bytes")).alias("n"), F.col("source").alias("source"))).alias("most")
    parts = F.collect_list(F.when(F.size("long") > 0, F.struct("source", "long"))).alias("parts")
    spans = by.groupBy("doc_id", "run").agg(F.min("first").alias("begin"), F.max("last").alias("end"), most_of, parts).filter(F.col("end") - F.col("begin") >= least_run)
    whole = F.array(F.struct(F.col("most.source").alias("source"), F.col("begin"), F.col("end")))
    others = F.flatten(F.transform(F.filter("parts", lambda p: p["source"] != F.col("most.source")), lambda p: F.transform(p["long"], lambda x: F.struct(p["source"].alias("source"), x["begin"].alias("begin"), x["end"].alias("end")))))
    spans = spans.select("doc_id", F.explode(F.concat(whole, others)).alias("x"))
    return spans.select("doc_id", F.col("x.source").alias("source_doc_id"), F.concat_ws("-", "x.begin", "x.end").alias("span"))


def cut_out(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` without the repeated spans: each passage stays in the first document that has it. Columns as they were.

    Rows are neither added nor lost: of repeated rows each is cut alike, null and empty texts stay, as do rows with a
    null doc_id; an empty table gives an empty one; columns named like internal ones are kept. A cut within a
    character leaves it out.
    """
    spans, key = free_name(df, "spans"), free_name(df, "span_of")
    found = repeats(df, doc_id, text, **how).groupBy("doc_id").agg(F.collect_list("span").alias(spans)).withColumnRenamed("doc_id", key)
    met = df.join(found, df[doc_id] == found[key], "left").select(*[df[c] for c in df.columns], F.col(spans))
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, where in enumerate(batch.column(len(names)).to_pylist()):
                if where and texts[i]:
                    raw, last, kept = texts[i].encode(), 0, []
                    for b, e in sorted(tuple(map(int, s.split("-"))) for s in where):
                        kept.append(raw[last:b])
                        last = max(last, e)
                    texts[i] = b"".join([*kept, raw[last:]]).decode(errors="ignore")
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow(met, run, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))
