"""SentencePiece encoding and decoding as relations.

The distinct words of all documents are the only thing that needs segmenting. Each word explodes to its
substrings of bounded length, an equi-join with the piece table leaves the lattice's edges, and the edges,
grouped by word, are folded with Spark's higher-order ``aggregate``:

* ``unigram`` models: Viterbi, the path of the largest summed score;
* ``bpe`` models: the best edge that joins two neighbouring pieces, again and again. Their scores are merge
  ranks, not log-probabilities; the path of the largest sum is another segmentation than theirs.

Both folds keep grouping and partitioning by word, so the lattice costs no shuffle beyond that of the
distinct words. The segmented words are written to the shared folder. While they are few enough for a
worker's memory, every task reads them and encodes its documents where they are; beyond that bound the
documents' words are joined with them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.shared import arrow, table, table_path
from souk.llm.textkit import portions, span_hashes, strings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A word of more characters is segmented by ``merged``: the fold's set of cuts is the bits of a long.
MASK = 60
#: Bytes of segmented words up to which a worker holds them all.
HELD = 256 << 20
#: Rows of a batch handled at a time, so that copies of their texts stay small.
SLICE = 256


@dataclass(frozen=True)
class Model:
    """The piece table. ``scores`` is None for control and byte pieces, which no text matches."""

    pieces: tuple[str, ...]
    scores: tuple[float | None, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    kind: str = "bpe"

    @property
    def longest(self) -> int:
        return max((len(p) for p, s in zip(self.pieces, self.scores) if s is not None), default=1)


def load(path: str = MODEL, kind: str = "bpe") -> Model:
    """The piece table of a model file; its normaliser must be the identity with a space put before the text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces = tuple(m.id_to_piece(i) for i in range(n))
    scores = tuple(None if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) else m.get_score(i) for i in range(n))
    by_byte = {int(pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
    if m.decode(m.encode(" A  b ")) != " A  b ":
        raise ValueError("the model normalises white space")
    inner = [p for p, s in zip(pieces, scores) if s is not None and (SPACE in p.lstrip(SPACE) or "\n" in p)]
    if inner:
        raise ValueError(f"pieces cross words: {inner[:5]}")
    return Model(pieces, scores, tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else (), m.unk_id(), kind)


def units(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first unit of each row): a run of spaces with what follows; a line feed by itself."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space, feed = data == 32, data == 10
    start = space | feed
    start[1:] &= ~(space[1:] & space[:-1])
    start[1:] |= feed[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def spaced(column: pa.Array) -> pa.Array:
    """The texts as the model reads them: a space before each that isn't empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.if_else(pc.equal(column, pa.scalar("", pa.large_string())), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))


def distinct_words(texts: DataFrame) -> DataFrame:
    """(word) of all texts, spaces written as the model does; texts: one string column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _LOADED.clear()
        _trim()
        seen = np.zeros(0, np.uint64)
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            offsets, data = strings(spaced(batch.column(0)))
            for i, j in portions(offsets, 1 << 20):
                off, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                s, e, _ = units(off, part)
                h, at = np.unique(span_hashes(part, s, e, 1), return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                    h, at = h[new], at[new]
                seen = np.sort(np.concatenate([seen if len(seen) < 4_000_000 else seen[:0], h]))
                raw = part.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist())], pa.binary()).cast(pa.string())], names=["word"])
        del seen
        _trim()

    words = arrow(texts, run, "word string").select(F.translate("word", " ", SPACE).alias("word"))
    return words.groupBy("word").agg(F.length("word").alias("n"))


def edges(words: DataFrame, table_: DataFrame, longest: int, one: bool) -> DataFrame:
    """(word, n, s, l, score, odd) of each substring in the piece table; l = 0: the word itself, once, and all there is of a longer one than MASK.

    ``one``: with pieces of one character, too.
    """
    top = F.least(F.lit(longest), F.col("n") - F.col("s") + 1)
    least = 1 if one else 2
    short = F.col("n") <= MASK
    sizes = F.when(short & (top >= least), F.sequence(F.lit(least), top)).otherwise(F.array().cast("array<int>"))
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.when(short, F.col("n")).otherwise(1))).alias("s"))
    cut = at.select("word", "n", "s", F.explode(F.when(F.col("s") == 1, F.concat(F.array(F.lit(0)), sizes)).otherwise(sizes)).alias("l"))
    # the piece table has as many rows as the model, whatever the data
    return cut.withColumn("piece", F.substring("word", F.col("s"), F.col("l"))).join(F.broadcast(table_), "piece").select("word", "n", "s", "l", "score", "odd")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def odd_pieces(rank: dict[str, float]) -> set[str]:
    """The pieces that are half of one of better rank: merging one may make a merge possible that should have come before."""
    return {y for x, r in rank.items() for k in range(1, len(x)) for y, z in ((x[:k], x[k:]), (x[k:], x[:k])) if rank.get(y, r) > r and (len(z) == 1 or z in rank)}


def bpe_cuts(lattice: DataFrame) -> DataFrame:
    """(word, n, cuts): bit i of cuts is set where a piece begins or ends at i; null for words longer than MASK.

    Of the edges over exactly two pieces the best, then the leftmost, is merged first. A merge makes edges possible
    that contain it, and those of an ordinary piece rank behind it: so one fold over the edges in their order meets
    each when its turn is. Where an odd piece's merge makes an edge of better rank possible the order doesn't hold,
    and the word is folded again, a merge a step, over all edges each time. The fold gives the bits as they are: an
    expression over them would be inlined into its lambdas and fold again for each element.
    """
    s, e = F.col("s") - 1, F.col("s") + F.col("l") - 1
    edge = F.when(F.col("l") > 0, F.struct((-F.col("score")).alias("rank"), s.alias("s"), (_bit(s) + _bit(e)).alias("ends"), (_bit(e) - _bit(s + 1)).alias("inner"), F.col("odd")))
    by = lattice.groupBy("word", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))

    def able(cuts: Column, x: Column) -> Column:
        return (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1)

    def without(cuts: Column, inner: Column) -> Column:
        return cuts.bitwiseAND(F.bitwise_not(inner))

    def in_turn(state: Column, x: Column) -> Column:
        cuts = without(state["cuts"], x["inner"])
        late = x["odd"] & F.exists("edges", lambda y: (y["rank"] < x["rank"]) & able(cuts, y))
        return F.when(able(state["cuts"], x), F.struct(cuts.alias("cuts"), (state["late"] | late).alias("late"))).otherwise(state)

    def step(cuts: Column, _: Column) -> Column:
        best = F.array_min(F.filter("edges", lambda x: able(cuts, x)))
        return without(cuts, F.coalesce(best["inner"], F.lit(0).cast("long")))

    every = _bit(F.col("n") + 1) - 1
    rounds = F.least(F.size("edges"), F.col("n") - 1)
    times = F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>"))
    start = F.struct(every.alias("cuts"), F.lit(False).alias("late"))
    cuts = F.aggregate("edges", start, in_turn, lambda state: F.when(state["late"], F.aggregate(times, every, step)).otherwise(state["cuts"]))
    return by.select("word", "n", F.when(F.col("n") <= MASK, cuts).alias("cuts"))


def viterbi_cuts(lattice: DataFrame, unknown: float) -> DataFrame:
    """(word, n, cuts): the positions on the path with the largest summed score, null for words longer than MASK; a character without a piece costs ``unknown``."""
    edge = F.when(F.col("l") > 0, F.struct((F.col("s") + F.col("l") - 1).alias("e"), (F.col("s") - 1).alias("s"), F.col("score").cast("double").alias("w")))
    by = lattice.groupBy("word", "n").agg(F.collect_list(edge).alias("known"))
    chars = F.when(F.col("n") <= MASK, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    single = F.transform(chars, lambda i: F.struct(i.alias("e"), (i - 1).alias("s"), F.lit(unknown).cast("double").alias("w")))
    missing = F.filter(single, lambda x: ~F.exists("known", lambda k: (k["e"] == x["e"]) & (k["s"] == x["s"])))
    start = F.struct(
        F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))).alias("best"),
        F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.lit(0)).alias("back"),
    )

    def step(state: Column, x: Column) -> Column:
        total = state["best"][x["s"]] + x["w"]
        better = total > state["best"][x["e"]]
        return F.struct(
            F.transform(state["best"], lambda b, i: F.when((i == x["e"]) & better, total).otherwise(b)).alias("best"),
            F.transform(state["back"], lambda b, i: F.when((i == x["e"]) & better, x["s"]).otherwise(b)).alias("back"),
        )

    def path(state: Column) -> Column:
        """From the end back; the state is the lambda's own, so it is folded once."""
        return F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.col("n")), lambda p, _: F.when(p[0] == 0, p).otherwise(F.concat(F.array(state["back"][p[0]]), p)))

    folded = F.aggregate(F.array_sort(F.concat("known", missing)), start, step, path)
    return by.select("word", "n", F.when(F.col("n") <= MASK, folded).alias("cuts"))


def merged(word: str, rank: dict[str, float]) -> list[str]:
    """The pieces of one word by a heap of neighbouring pairs: what the fold gives, for words of any length."""
    left, right, text = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1)), list(word)
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] < len(word) and (both := text[i] + text[right[i]]) in rank:
            heapq.heappush(heap, (rank[both], i, both))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = right[i] if text[i] else len(word)
        if j >= len(word) or text[i] + text[j] != both:
            continue
        text[i], text[j], right[i] = both, "", right[j]
        if right[i] < len(word):
            left[right[i]] = i
        offer(left[i])
        offer(i)
    return [t for t in text if t]


def best_path(word: str, weight: dict[str, float], unknown: float, longest: int) -> list[str]:
    """Viterbi over one word of any length."""
    best, back = [0.0] + [float("-inf")] * len(word), [0] * (len(word) + 1)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - longest), e):
            w = weight.get(word[s:e], unknown if e - s == 1 else None)
            if w is not None and best[s] + w > best[e]:
                best[e], back[e] = best[s] + w, s
    out, e = [], len(word)
    while e:
        out.append(word[back[e] : e])
        e = back[e]
    return out[::-1]


class Segmenter:
    """One word to ids, on a worker."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, s) in enumerate(zip(model.pieces, model.scores)) if s is not None}
        known = {p: s for p, s in zip(model.pieces, model.scores) if s is not None}
        self.weight = {p: -s for p, s in known.items()} if model.kind == "bpe" else known

    def pieces(self, word: str) -> list[str]:
        if self.model.kind == "bpe":
            return merged(word, self.weight)
        return best_path(word, self.weight, unknown_score(self.model), self.model.longest)

    def of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.model.byte_ids:
                out.extend(self.model.byte_ids[b] for b in p.encode())
            else:
                out.append(self.model.unknown)
        return out


def unknown_score(model: Model) -> float:
    return min((s for s in model.scores if s is not None), default=0.0) - 10.0


def segmented(texts: DataFrame, model: Model) -> DataFrame:
    """(word, h, h2: its hashes as the texts spell it, ids: little-endian int32) of every distinct word of the texts."""
    spark = texts.sparkSession
    words = distinct_words(texts)
    kept = {p: float(s) for p, s in zip(model.pieces, model.scores) if s is not None and (model.kind != "bpe" or len(p) > 1)}
    odd = odd_pieces({p: -s for p, s in kept.items()}) if model.kind == "bpe" else set()
    known = spark.createDataFrame([("", 0.0, False), *((p, s, p in odd) for p, s in kept.items())], "piece string, score double, odd boolean")
    lattice = edges(words, known, model.longest, model.kind != "bpe")
    cuts = bpe_cuts(lattice) if model.kind == "bpe" else viterbi_cuts(lattice, unknown_score(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Segmenter(model)
        for batch in batches:
            ids = []
            for w, n, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at is None:
                    parts = one.pieces(w)
                else:
                    ends = [i for i in range(1, n + 1) if at >> i & 1] if model.kind == "bpe" else at[1:]
                    parts = [w[a:b] for a, b in zip([0, *ends], ends)]
                ids.append(np.array(one.of(parts), "<i4").tobytes())
            off, data = strings(pc.replace_substring(batch.column(0), SPACE, " "))
            h = [span_hashes(data, off[:-1], off[1:], seed) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[0].view(np.int64)), pa.array(h[1].astype(np.uint32).view(np.int32)), pa.array(ids, pa.binary())], names=["word", "h", "h2", "ids"])

    return arrow(cuts, run, "word string, h long, h2 int, ids binary")


_LOADED: dict[str, tuple[np.ndarray, ...]] = {}


def _held(path: str, n: int, total: int, wide: bool) -> tuple[np.ndarray, ...]:
    """``_load`` once a worker and table; the table before is let go first, so that two are never held."""
    if path not in _LOADED:
        _LOADED.clear()
        _trim()
        _LOADED[path] = _load(path, n, total, wide)
    return _LOADED[path]


def _load(path: str, n: int, total: int, wide: bool) -> tuple[np.ndarray, ...]:
    """The n segmented words: sorted hashes, and in their order second hashes, where the ids begin and how many there are; the ids, total in number.

    About 27 bytes a word, and little more while reading: all arrays are filled in place.
    """
    import pyarrow.dataset as ds

    source = ds.dataset(path, format="parquet")

    def batches(*columns: str) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        at = 0
        for b in source.to_batches(columns=list(columns), batch_size=1 << 15, batch_readahead=0, fragment_readahead=0, use_threads=False):
            yield at, at + b.num_rows, b
            at += b.num_rows

    h, h2 = np.empty(n, np.uint64), np.empty(n, np.uint32)
    for i, j, b in batches("h", "h2"):
        h[i:j], h2[i:j] = b.column("h").to_numpy().view(np.uint64), b.column("h2").to_numpy().view(np.uint32)
    order = np.argsort(h).astype(np.uint32)
    h = h[order]
    h2 = h2[order]
    _trim()
    begin, size, ids, filled = np.empty(n, np.int64 if total >> 32 else np.uint32), np.empty(n, np.uint32), np.empty(total, np.int32 if wide else np.uint16), 0
    for i, j, b in batches("ids"):
        column = b.column("ids").cast(pa.large_binary())
        o = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + j - i + 1] if j > i else np.zeros(1, np.int64)
        size[i:j], begin[i:j] = np.diff(o) // 4, filled + (o[:-1] - o[0]) // 4
        if o[-1] > o[0]:
            values = np.frombuffer(column.buffers()[2], np.uint8)[o[0] : o[-1]].view("<i4")
            ids[filled : filled + len(values)] = values
            filled += len(values)
    begin = begin[order]
    size = size[order].astype(np.uint16) if n and size.max() < 1 << 16 else size[order]
    del order
    _trim()
    return h, h2, begin, size, ids


def _trim() -> None:
    """Hands memory that the allocators keep back to the system: the workers of an executor share its limit."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions begin[0], .., begin[0] + n[0] - 1, begin[1], .."""
    total = int(n.sum())
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(total)


def _spell(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces, where each begins, how many it has), byte pieces as their byte, controls as none."""
    byte_of = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
    raw = [byte_of.get(i, b"") if s is None else p.replace(SPACE, " ").encode() for i, (p, s) in enumerate(zip(model.pieces, model.scores))]
    n = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n, n


def encoded(df: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """(doc_id, ids, round_trip) of every row: the model's ids of the whole text; whether they decode to it.

    Null text: null ids. Empty text: no ids. Characters without a piece become their bytes, so every text
    decodes to itself, unless it holds the model's own sign for a space (U+2581), which comes back as one.
    Words of any length are segmented exactly. Repeated rows are encoded each; an empty table gives no rows.
    """
    model = model or load()
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    path = table_path(segmented(docs.select("text"), model), "words")
    words = docs.sparkSession.read.parquet(path)
    n_words, total = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)) / 4).first()
    total, wide = int(total), len(model.pieces) > 1 << 16
    if n_words * 20 + total * (4 if wide else 2) > held or n_words >> 32:
        return _joined(docs, words, model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, h2, begin, size, ids = _held(path, n_words, total, wide)
        spelled, at, long = _spell(model)
        one = Segmenter(model)
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            offsets, data = strings(spaced(batch.column(1)))
            null = batch.column(1).is_null()
            for i, j in portions(offsets, 1 << 19):
                off, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                s, e, first = units(off, part)
                u, where, back = np.unique(span_hashes(part, s, e, 1), return_index=True, return_inverse=True)
                k = np.minimum(np.searchsorted(h, u), max(0, len(h) - 1))
                if len(h):
                    ok = (h[k] == u) & (h2[k] == span_hashes(part, s[where], e[where], 2).astype(np.uint32))
                    b, n, pool = begin[k].astype(np.int64), size[k].astype(np.int64), ids
                else:
                    ok, b, n, pool = np.zeros(len(u), bool), np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), ids
                if not ok.all():  # hashes that collide: segmented here
                    extra = []
                    for x in np.flatnonzero(~ok):
                        own = one.of(one.pieces(part[s[where[x]] : e[where[x]]].tobytes().decode().replace(" ", SPACE)))
                        b[x], n[x] = len(ids) + sum(map(len, extra)), len(own)
                        extra.append(own)
                    pool = np.concatenate([ids.astype(np.int32), *(np.array(x, np.int32) for x in extra)])
                out = pool[ragged(b[back], n[back])] if len(s) else np.zeros(0, np.int32)
                ends = np.concatenate([[0], np.cumsum(n[back])])[first]
                again = spelled[ragged(at[out], long[out])]
                if np.array_equal(again, part):
                    same = np.ones(j - i, bool)
                else:
                    to = np.concatenate([[0], np.cumsum(long[out])])[ends]
                    same = np.array([np.array_equal(again[to[r] : to[r + 1]], part[off[r] : off[r + 1]]) for r in range(j - i)])
                gone = null.slice(i, j - i)
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))
                if gone.true_count:
                    values = pc.if_else(gone, pa.scalar(None, values.type), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), values, pa.array(same)], names=["doc_id", "ids", "round_trip"])

    return arrow(docs, run, schema)


def _joined(docs: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """``encoded`` for a vocabulary that no worker can hold: the documents' words are joined with it."""
    rows = table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = strings(spaced(batch.column(1)))
            for i, j in portions(offsets):
                off, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                s, e, first = units(off, part)
                raw = part.tobytes()
                row = np.repeat(np.arange(i, j), np.diff(first))
                word = pa.array([raw[a:b] for a, b in zip(s.tolist(), e.tolist())], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(s, pa.int64()), word], names=["row", "at", "word"])

    each = arrow(rows.select("row", "text"), run, "row long, at long, word string").withColumn("word", F.translate("word", " ", SPACE))
    met = each.join(words, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    whole = rows.join(met, "row", "left").select("doc_id", "text", F.col("parts.ids").alias("parts"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, at, long = _spell(model)
        for batch in batches:
            ids, same = [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = np.frombuffer(b"".join(parts or ()), "<i4")
                ids.append(None if text is None else own)
                same.append(spelled[ragged(at[own], long[own])].tobytes() == ((" " + text).encode() if text else b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=["doc_id", "ids", "round_trip"])

    return arrow(whole, put, schema)


def decoded(df: DataFrame, model: Model | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the pieces' spelling without the leading space; null ids, null text.

    Control pieces spell nothing; an id outside the model raises; bytes that aren't UTF-8 become U+FFFD.
    """
    model = model or load()
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, at, long = _spell(model)
        for batch in batches:
            texts = []
            for x in batch.column(1):
                if not x.is_valid:
                    texts.append(None)
                    continue
                own = x.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(own) and (own.min() < 0 or own.max() >= len(long)):
                    raise ValueError("an id isn't the model's")
                raw = spelled[ragged(at[own], long[own])].tobytes().decode(errors="replace")
                texts.append(raw[1:] if raw.startswith(" ") else raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow(rows, run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))
