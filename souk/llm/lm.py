"""Language-model scores from compression.

Two dictionaries of one capacity, which grows with the counted corpus, hold what saves most in the in-domain documents
(those labelled of quality) and in all documents: up to a half passages, stretches of some 30 bytes cut by content that
occur again (phrases with their spaces and marks), and words. A text's zstandard size under a dictionary, in bits a
byte, is a cross-entropy under a model of what filled it; the score is the difference of the two, divided by the
general one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.chunks import cuts
from souk.llm.shared import arrow, drop, table
from souk.llm.textkit import portions, span_hashes, strings

#: Bytes of each dictionary at least: the model's capacity, as a number of parameters is.
CAPACITY = 1 << 16
#: Bytes of each dictionary by the square root of the counted bytes, as a vocabulary grows (Heaps): 5.5 MB at 30 GB, without a top.
GROWTH = 32
LEVEL = 3
#: Distinct words a task holds before it hands its counts on.
HELD = 400_000
#: Bytes of labelled ids up to which they are broadcast.
BROADCAST = 64 << 20
#: A match costs about this many bytes, so shorter words save nothing.
COST = 3
#: Scripts written without spaces (Thai to Khmer, kana, Han): counted by runs of RUNS characters, as a sentence is no word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
RUNS = 3


def terms(text: str) -> list[str]:
    """The words of a text, and every run of RUNS characters (a shorter stretch whole) of what is written without spaces."""
    if text.isascii() or not (stretches := _UNSPACED.findall(text)):
        return text.split()
    return _UNSPACED.sub(" ", text).split() + [x[i : i + RUNS] for x in stretches for i in range(max(1, len(x) - RUNS + 1))]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n_in, n_all): occurrences in the in-domain documents and in all, for docs (text, is_in)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = Counter(), Counter()

        def handed() -> pa.RecordBatch:
            names = list(inner.keys() | outer.keys())
            counts = [pa.array([inner[w] for w in names], pa.int64()), pa.array([inner[w] + outer[w] for w in names], pa.int64())]
            inner.clear()
            outer.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["word", "n_in", "n_all"])

        for batch in batches:
            for text, is_in in zip(batch.column(0), batch.column(1).to_pylist()):
                if text.is_valid:
                    (inner if is_in else outer).update(terms(text.as_py()))
                if len(inner) + len(outer) > HELD:
                    yield handed()
        yield handed()

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_in", T.LongType()), T.StructField("n_all", T.LongType())])
    parts = arrow(docs, run, schema)
    return parts.groupBy("word").agg(F.sum("n_in").alias("n_in"), F.sum("n_all").alias("n_all"))


def capacity_for(counts: DataFrame) -> int:
    """Bytes of a dictionary over these counts."""
    total = counts.agg(F.sum(F.col("n_all") * (F.octet_length("word") + 1))).first()[0] or 0
    return max(CAPACITY, GROWTH * math.isqrt(total))


def passage_counts(docs: DataFrame) -> DataFrame:
    """(passage: its hash, bytes, n_in, n_all) of the content-defined chunks of docs (text, is_in) that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, s, e, part in _chunks(batch.column(0)):
                h, at, back = np.unique(span_hashes(part, s, e, 7), return_index=True, return_inverse=True)
                n = np.bincount(back, minlength=len(h))
                n_in = np.bincount(back, inner[row], len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((e - s)[at], pa.int32()), pa.array(n_in), pa.array(n.astype(np.int64))], names=["passage", "bytes", "n_in", "n_all"])

    parts = arrow(docs, run, "passage long, bytes int, n_in long, n_all long")
    return parts.groupBy("passage", "bytes").agg(F.sum("n_in").alias("n_in"), F.sum("n_all").alias("n_all")).filter("n_all > 1")


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    offsets, data = strings(column)
    for i, j in portions(offsets, 2 << 20):
        part = data[offsets[i] : offsets[j]]
        row, s, e = cuts(offsets[i : j + 1] - offsets[i], part)
        if len(s):
            yield row + i, s, e, part


def most_saving(counts: DataFrame, key: str, size: Column, n: str, capacity: int) -> list[tuple[int, object]]:
    """(bytes saved, key) of the rows that save most, from the most on, as long as their sizes fit ``capacity``; ties by key.

    What occurs but once saves nothing. A histogram of the savings (sixteen bins an octave) tells from which bin on the
    rows fill the capacity; those alone reach the driver.
    """
    saved = (F.col(n) - 1) * (size - COST)
    held = counts.select(key, size.cast("long").alias("size"), saved.alias("saved")).filter("saved > 0").withColumn("bin", F.floor(F.log2("saved") * 16))
    room, edge = 0, 0
    for k, b in sorted(held.groupBy("bin").agg(F.sum(F.col("size") + 1)).collect(), reverse=True):
        room, edge = room + b, k
        if room > capacity:
            break
    rows = held.filter(F.col("bin") >= edge).select(key, "size", "saved").toArrow().to_pydict()
    room, taken = 0, []
    for minus, x, size_ in sorted((-v, x, n_) for v, x, n_ in zip(rows["saved"], rows[key], rows["size"])):
        if room + size_ + 1 > capacity:
            break
        taken.append((-minus, x))
        room += size_ + 1
    return taken


def passages(docs: DataFrame, wanted: list[int]) -> dict[int, bytes]:
    """The bytes of the passages of these hashes, each once; ``wanted`` is bounded by a dictionary's capacity."""
    sought = np.array(sorted(wanted), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bytes] = {}
        for batch in batches:
            for _, s, e, part in _chunks(batch.column(0)):
                h = span_hashes(part, s, e, 7).view(np.int64)
                for i in np.flatnonzero(np.isin(h, sought)).tolist():
                    if int(h[i]) not in found:
                        found[int(h[i])] = part[s[i] : e[i]].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["passage", "raw"])

    if not len(sought):
        return {}
    one = arrow(docs.select("text"), run, "passage long, raw binary").groupBy("passage").agg(F.min("raw").alias("raw")).toArrow().to_pydict()
    return dict(zip(one["passage"], one["raw"]))


def dictionary(counts: DataFrame, n: str, capacity: int = CAPACITY, before: list[tuple[int, bytes]] | None = None) -> bytes:
    """The passages ``before`` and the words that save most beside them, up to ``capacity`` bytes, the best last (zstandard
    reaches them at the shortest distance)."""
    before = before or []
    room = capacity - sum(len(raw) + 1 for _, raw in before)
    words = [(saved, w.encode() + b" ") for saved, w in most_saving(counts, "word", F.octet_length("word"), n, room)]
    each = sorted([*before, *words])
    return b" " + b"".join(raw for _, raw in each) if each else b""


def scored(docs: DataFrame, in_domain: bytes, general: bytes, level: int = LEVEL) -> DataFrame:
    """(doc_id, score, bits_in, bits_general) of docs (doc_id, text)."""
    names = ["score", "bits_in", "bits_general"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def under(content: bytes):
            if len(content) < 8:
                return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False, write_dict_id=False)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # the window spans the dictionary, the tables have a place for each of its bytes: else its far words were lost
            given = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content))
            log = len(content).bit_length()
            wide = {"window_log": max(given.window_log, (len(content) + (1 << 20)).bit_length()), "hash_log": max(given.hash_log, log), "chain_log": max(given.chain_log, log)}
            how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), write_checksum=False, write_content_size=False, write_dict_id=False, **wide)
            held.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

        own, other = under(in_domain), under(general)
        for batch in batches:
            rows = []
            for x in batch.column(1).cast(pa.large_binary()):
                raw = x.as_buffer() if x.is_valid else b""
                if not len(raw):
                    rows.append((None, None, None))
                    continue
                a, b = (8 * len(c.compress(raw)) / len(raw) for c in (own, other))
                rows.append(((b - a) / b, a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3))], names=["doc_id", *names])

    return arrow(docs, run, T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.DoubleType()) for n in names)]))


def models(documents: DataFrame, labels: DataFrame, capacity: int | None = None) -> tuple[bytes, bytes]:
    """The (in-domain, general) dictionaries: words and passages counted over every document, in-domain those labelled quality 1 in any row.

    Without a ``capacity`` it grows with the counted corpus.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good")).distinct()
    # the ids of labelled documents travel to the texts while they fit a worker; beyond that both sides are shuffled by id
    fits = good.count() * 64 <= BROADCAST
    met = documents.select("doc_id", "text").join(F.broadcast(good) if fits else good.hint("merge"), F.col("doc_id") == F.col("good"), "left").select("text", F.col("good").isNotNull().alias("is_in"))
    counts, repeated = table(word_counts(met), "words"), table(passage_counts(met), "passages")
    capacity = capacity or capacity_for(counts)
    chosen = {n: most_saving(repeated, "passage", F.col("bytes"), n, capacity // 2) for n in ("n_in", "n_all")}
    raw = passages(documents, [h for x in chosen.values() for _, h in x])
    made = tuple(dictionary(counts, n, capacity, [(saved, raw[h]) for saved, h in chosen[n]]) for n in ("n_in", "n_all"))
    drop(counts, repeated)
    return made


def score(documents: DataFrame, labels: DataFrame, capacity: int | None = None, level: int = LEVEL) -> DataFrame:
    """(doc_id, score, bits_in, bits_general) of every row of ``documents``; above 0: nearer the in-domain model.

    Null and empty texts have null scores. A repeated row is scored, and counted, as often as it occurs;
    a doc_id labelled more than once is in-domain if any label says so; null labels say nothing. Without
    labels the in-domain dictionary is empty, as is either where nothing occurs twice. Texts are counted and scored
    whole, words of any length. An empty table gives no rows; ties go to the smaller word; other columns are ignored.
    """
    return scored(documents.select("doc_id", "text"), *models(documents, labels, capacity), level)
