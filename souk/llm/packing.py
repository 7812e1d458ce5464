"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of documents in the order of doc_id. Round after round every live source's deficit is
credited its quantum, a share of the window in proportion to its weight; it draws the whole tokens of its
deficit and carries the rest on. Nothing resets a deficit: not a window's end, nor another source's end, which
only makes the quanta of those left larger within that very round. Quanta below one token add up over rounds.
Deficits begin at spread fractions, so that small sources don't draw in the same round. A document that
outlasts the draw goes on in the next round.

The credit of all rounds up to ``k`` is ``weight * time(k)`` with one ``time`` for all sources, the moment at
which they have drawn ``k`` windows in the fluid limit; so what a source has drawn (``Plan.drawn``) is a closed
formula of ``k``, the deficit is in it, and each document finds its rounds from its offset in its queue, in
whatever partition. The whole tokens of a round are a few more or less than a window; laid end to end in the
order of (round, source) they are cut into windows of exactly ``size`` tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.shared import arrow, table
from souk.llm.textkit import portions, strings, words

WINDOW = 2048
#: Exponent that flattens the sources' own sizes to their default target shares.
FLATTEN = 0.7
#: The share of a source that ``targets`` leaves out.
LEAST_SHARE = 1e-6
_TEXT = np.array([chr(b) not in " \t\n\r\f\v" for b in range(256)])


def shares(tokens: dict, targets: dict | None = None) -> dict:
    """The weights of the sources, summing to 1: their targets, or else their own sizes flattened."""
    wanted = {s: max(0.0, float(targets.get(s) or 0)) if targets else n**FLATTEN for s, n in tokens.items()}
    whole = sum(wanted.values()) or 1.0
    return {s: w / whole or LEAST_SHARE for s, w in wanted.items()}


class Plan:
    """What the sources have drawn after any number of rounds; as large as the list of sources.

    ``tokens``, ``weight``, ``deficit`` (the first one, between 0 and 1) and ``ends`` (the time when a source has
    drawn all) by source; ``knot``, ``done``, ``live``: the ends in order, the tokens of the sources that ended
    before each, and the weight of the others; ``drained``: all tokens drawn at each end.
    """

    def __init__(self, tokens, weights, size: int = WINDOW):
        self.size, self.tokens, self.weight = size, np.asarray(tokens, np.float64), np.asarray(weights, np.float64)
        n = len(self.tokens)
        self.deficit = ((np.arange(n) * 40503 & 0xFFFF) + 0.5) / 65536  # multiples of the golden ratio, spread evenly
        self.ends = self.tokens / self.weight
        order = np.argsort(self.ends, kind="stable")
        self.knot = self.ends[order]
        before = np.concatenate([[0.0], np.cumsum(self.tokens[order])])
        after = np.concatenate([np.cumsum(self.weight[order][::-1])[::-1], [0.0]])
        self.done, self.live = before, after
        self.drained = before[1:] + self.knot * after[1:]
        self.whole = before[-1]

    def time(self, k: np.ndarray) -> np.ndarray:
        """The moment at which ``k`` windows are drawn; never falling in ``k``."""
        y = np.asarray(k, np.float64) * self.size
        i = np.minimum(np.searchsorted(self.drained, y, "left"), len(self.knot) - 1)
        low = np.where(i > 0, self.knot[i - 1], 0.0)
        t = np.clip((y - self.done[i]) / self.live[i], low, self.knot[i])
        return np.where(y >= self.whole, np.inf, t)

    def round_at(self, t: np.ndarray) -> np.ndarray:
        """The round of a moment, give or take one."""
        i = np.searchsorted(self.knot, t, "right")
        return ((self.done[i] + np.where(i < len(self.knot), t, 0.0) * self.live[i]) // self.size).astype(np.int64)

    def drawn(self, source: int, k: np.ndarray) -> np.ndarray:
        """Tokens that the source has drawn before round ``k``: the whole ones of its first deficit and all its credits."""
        t, end = self.time(k), self.ends[source]
        n = np.floor(self.weight[source] * np.minimum(t, end) + self.deficit[source])
        return np.where(t >= end, self.tokens[source], np.minimum(n, self.tokens[source])).astype(np.int64)

    def fragments(self, source: int, begin: np.ndarray, count: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, round, first token, tokens) of documents at offsets ``begin`` of the source's queue, each of a token at least.

        In parts of at most ``most``: a long document of a small source has a fragment for nearly each of its tokens.
        """

        def round_of(x: np.ndarray) -> np.ndarray:
            k = np.maximum(self.round_at((x + 1 - self.deficit[source]) / self.weight[source]), 0)
            while (m := self.drawn(source, k) > x).any():
                k = k - m
            while (m := self.drawn(source, k + 1) <= x).any():
                k = k + m
            return k

        first, last = round_of(begin), round_of(begin + count - 1)
        upto = np.cumsum(last - first + 1)
        for at in range(0, int(upto[-1]) if len(upto) else 0, most):
            flat = np.arange(at, min(at + most, int(upto[-1])))
            row = np.searchsorted(upto, flat, "right")
            k = last[row] + 1 - (upto[row] - flat)
            b = np.maximum(begin[row], self.drawn(source, k))
            e = np.minimum(begin[row] + count[row], self.drawn(source, k + 1))
            some = b < e
            row, k, b, e = row[some], k[some], b[some], e[some]
            yield row, k, b - begin[row], e - b


def running(df: DataFrame, by: str | None, add: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``add`` over the rows before each in ``order``, of those of the same ``by`` if one is named.

    Prefix sums in two levels: within the partitions of a range partitioning by ``order``, and over the partitions'
    totals; a hot value spreads over as many partitions as its size asks for. ``df`` is a written table, as
    partitioning by range reads its input once more for the bounds. Written in that order.
    """
    names = df.columns
    at_by, at_add = names.index(by) if by else None, names.index(add)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sums, total = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            n = batch.column(at_add).to_numpy()
            if at_by is None:
                begin = total + np.cumsum(n) - n
                total += int(n.sum())
            else:
                begin = []
                for s, x in zip(batch.column(at_by).to_pylist(), n.tolist()):
                    begin.append(sums.get(s, 0))
                    sums[s] = begin[-1] + x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin, pa.int64()), pa.array([part] * batch.num_rows, pa.int32())], names=[*names, name, "part"])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField("part", T.IntegerType())])
    placed = table(arrow(df.repartitionByRange(*order[:2]).sortWithinPartitions(*order), local, schema), name)
    over = F.lit(0) if by is None else F.col(by)
    totals = placed.groupBy(F.col("part").alias("p"), over.alias("s")).agg(F.sum(add).alias("n"))
    before = totals.select("p", "s", F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row for each partition and value in it: far below the size of the table, and Spark's own threshold decides on broadcasting
    met = placed.join(before, (F.col("part") == F.col("p")) & over.eqNullSafe(F.col("s")))
    return met.select(*names, (F.col(name) + F.col("before")).alias(name))


def queues(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens, begin): each document's place in its source's queue. Tokens: runs without ASCII white space."""
    given = df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = strings(batch.column(2))
            n = []
            for i, j in portions(off):
                _, _, first = words(off[i : j + 1] - off[i], data[off[i] : off[j]], _TEXT)
                n.append(np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else [], pa.int64())], names=["doc_id", "source", "tokens"])

    counted = T.StructType([given.schema["doc_id"], T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())])
    some = table(arrow(given, count, counted).filter("tokens > 0"), "counted")
    return running(some, "source", "tokens", ["source", "doc_id", "tokens"], "begin")


def rounds(placed: DataFrame, plan: Plan, index: dict) -> DataFrame:
    """(round, rank, at, doc_id, source, start, n_tokens): what each document of ``queues`` gives to which round; rank: of its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.array([index[s] for s in batch.column(1).to_pylist()], np.int64)
            count, begin = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            order = np.argsort(rank, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1):
                s = int(rank[rows[0]]) if len(rows) else 0
                for row, k, start, n in plan.fragments(s, begin[rows], count[rows]):
                    at = pa.array(rows[row], pa.int64())
                    columns = [pa.array(k, pa.int64()), pa.array(np.full(len(k), s), pa.int32()), pa.array(begin[rows[row]] + start, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int64()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["round", "rank", "at", "doc_id", "source", "start", "n_tokens"])

    longs = {n: T.StructField(n, T.LongType()) for n in ("round", "at", "start", "n_tokens")}
    return arrow(placed, run, T.StructType([longs["round"], T.StructField("rank", T.IntegerType()), longs["at"], placed.schema["doc_id"], placed.schema["source"], longs["start"], longs["n_tokens"]]))


def pack(df: DataFrame, size: int = WINDOW, targets: dict | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(window, position, doc_id, source, start, n_tokens): the fragments that fill the windows.

    Every window but the last holds exactly ``size`` tokens; every token of every document is in one
    window. Any number of sources; null and blank texts have no tokens; a null source is a queue of its own;
    repeated rows are packed each for itself, ties in doc_id by their sizes; a document may span any number of
    windows; an empty table gives no rows; other columns are ignored. ``targets``: shares by source, a source
    left out (or at 0) gets a millionth until the others end; without targets see ``shares``.
    """
    placed = table(queues(df, doc_id, text, source), "placed")
    tokens = {r["source"]: r["n"] for r in placed.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row a source
    names = sorted(tokens, key=lambda s: (s is not None, s or ""))
    weights = shares(tokens, targets)
    plan = Plan([tokens[s] for s in names], [weights[s] for s in names], size)
    each = table(rounds(placed, plan, {s: i for i, s in enumerate(names)}), "rounds")
    laid = running(each, None, "n_tokens", ["round", "rank", "at"], "place")
    last = F.col("place") + F.col("n_tokens") - 1
    parts = laid.withColumn("window", F.explode(F.sequence(F.expr(f"place div {size}"), F.expr(f"(place + n_tokens - 1) div {size}"))))
    low = F.greatest(F.col("place"), F.col("window") * size)
    high = F.least(last + 1, (F.col("window") + 1) * size)
    return parts.select("window", (low - F.col("window") * size).cast("int").alias("position"), "doc_id", "source", (F.col("start") + low - F.col("place")).alias("start"), (high - low).cast("int").alias("n_tokens"))
