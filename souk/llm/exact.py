"""Exact duplicates by composable polynomial fingerprints.

A text is cut into fixed chunks; the chunk hashes are independent of one another (they are computed
together, as the columns of one array, and could be computed anywhere) and combine by length-shifted
arithmetic: ``F(a + b) = F(a) * B**len(b) + F(b) mod (2**61 - 1)``. Rows of equal fingerprint and
length meet, and their bytes are then compared chunk by chunk, so a collision can't merge two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.shared import arrow, free_name, nullable

P = (1 << 61) - 1
BASE = 0x1D8AF54D1C3B2A17 % P
CHUNK = 1 << 12
#: Bytes of texts that a task holds to know their copies in later batches; beyond, copies are sent to be compared.
HELD = 32 << 20
_M32 = np.uint64(0xFFFFFFFF)
_P = np.uint64(P)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


@lru_cache(maxsize=8)
def _power_limbs(base: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """base**(chunk-1) .. base**0 mod P, in two limbs of 31 bits, so that sums of byte x limb don't overflow."""
    p, x = [], 1
    for _ in range(chunk):
        p.append(x)
        x = x * base % P
    a = np.array(p[::-1], np.uint64)
    return a >> np.uint64(31), a & np.uint64((1 << 31) - 1)


def combine(left: int, right: int, right_length: int, base: int = BASE) -> int:
    """The fingerprint of a concatenation from those of its halves."""
    return (left * pow(base, right_length, P) + right) % P


def fingerprint(raw: bytes | memoryview, base: int = BASE, chunk: int = CHUNK) -> int:
    """The fingerprint of a text: all its whole chunks at once, then the combination, then the tail."""
    data = np.frombuffer(raw, np.uint8)
    high, low = _power_limbs(base, chunk)
    whole = len(data) // chunk
    f = 0
    if whole:
        step = max(1, (1 << 20) // chunk)
        shift = pow(base, chunk, P)
        for i in range(0, whole, step):
            block = data[i * chunk : min(whole, i + step) * chunk].reshape(-1, chunk).astype(np.uint64) + np.uint64(1)
            for h, l in zip((block @ high).tolist(), (block @ low).tolist()):
                f = (f * shift + (h << 31) + l) % P
    tail = data[whole * chunk :]
    if n := len(tail):
        part = tail.astype(np.uint64) + np.uint64(1)
        f = combine(f, ((int(part @ high[chunk - n :]) << 31) + int(part @ low[chunk - n :])) % P, n, base)
    return f


def same(a, b, chunk: int = 1 << 16) -> bool:
    """Chunkwise comparison of two texts of equal length; stops at the first chunk that differs."""
    return all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(a), chunk))


def orderable(kind: T.DataType) -> bool:
    """Whether Spark sorts values of the type."""
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _mark(df: DataFrame, doc_id: str, text: str, everything: bool) -> tuple[DataFrame, str]:
    """Rows with the id of the first row of the same text (null for a first row), and that column's name.

    ``everything``: with all columns of ``df``, else only doc_id.
    """
    fp, n, of = free_name(df, "fp"), free_name(df, "fp_bytes"), free_name(df, "duplicate_of")
    key, again, short = free_name(df, "row_order"), free_name(df, "is_again"), free_name(df, "fp_brief")
    plain = {f.name: f.dataType for f in df.schema.fields}
    base = df if everything else df.select(doc_id, text)
    fields = nullable(base.schema).fields
    id_type = plain[doc_id]
    keyed = T.StructType([*fields, T.StructField(fp, T.LongType()), T.StructField(n, T.LongType()), T.StructField(short, T.BinaryType())])
    at_id = base.columns.index(doc_id)
    at_text = base.columns.index(text)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = {}, HELD
        for batch in batches:
            texts, ids = batch.column(at_text).cast(pa.large_binary()), batch.column(at_id).to_pylist()
            found, brief, local = [], [None] * len(ids), {}
            for i, x in enumerate(texts):
                found.append((fingerprint(v := memoryview(x.as_buffer())), len(v)) if x.is_valid else (None, None))
                if x.is_valid and ids[i] is not None:
                    first = local.setdefault(found[i], i)
                    if ids[i] < ids[first]:
                        local[found[i]] = i
            # combined before the shuffle: of the copies within a batch, and of those held from earlier ones, only the first sends its text
            for i, k in enumerate(found):
                first = local.get(k, i) if k[0] is not None and ids[i] is not None else i
                if k[0] is None or ids[i] is None:
                    continue
                raw = memoryview(texts[i].as_buffer())
                if ids[first] != ids[i] and same(memoryview(texts[first].as_buffer()), raw):
                    brief[i] = blake2b(raw, digest_size=16).digest()
                elif (before := held.get(k)) and before[0] < ids[i] and same(before[1], raw):
                    brief[i] = blake2b(raw, digest_size=16).digest()
                elif before or len(raw) + 200 <= room:  # a smaller id takes the place of the one held
                    room -= 0 if before else len(raw) + 200
                    held[k] = (ids[i], bytes(raw))
            mine = pa.array([b is None for b in brief])
            columns = list(batch.columns)
            if not everything:
                columns[at_text] = pc.if_else(mine, columns[at_text], pa.scalar(None, columns[at_text].type))
            columns += [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)] + [pa.array(brief, pa.binary())]
            out_batch = pa.RecordBatch.from_arrays(columns, names=keyed.names)
            yield out_batch.filter(mine) if everything else out_batch

    # a null text equals nothing; spread those rows instead of gathering them under one key
    order = F.coalesce(F.col(fp), F.xxhash64(doc_id))
    others = [c for c in base.columns if c not in (doc_id, text) and orderable(plain[c])]
    met = arrow(base, prints, keyed).withColumn(key, order).repartition(key)
    met = met.sortWithinPartitions(key, n, F.col(doc_id).asc_nulls_last(), *others)
    out = T.StructType([*(fields if everything else [f for f in fields if f.name == doc_id]), T.StructField(of, id_type), T.StructField(again, T.BooleanType())])
    given = [i for i in range(len(fields)) if everything or i == at_id]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, firsts = None, []
        for batch in batches:
            fps, sizes = batch.column(len(fields)).to_pylist(), batch.column(len(fields) + 1).to_pylist()
            ids, texts = batch.column(at_id).to_pylist(), batch.column(at_text).cast(pa.large_binary())
            briefs = batch.column(len(fields) + 2).to_pylist()
            of_, again_ = [], []
            for i, k in enumerate(zip(fps, sizes)):
                if k != group:
                    group, firsts = k, []
                if k[0] is None:
                    of_.append(None)
                    again_.append(False)
                    continue
                if briefs[i] is not None:
                    hit = next(f for f in firsts if blake2b(f[1], digest_size=16).digest() == briefs[i]) if len(firsts) > 1 else firsts[0]
                else:
                    raw = memoryview(texts[i].as_buffer()).cast("B")
                    hit = next((f for f in firsts if same(f[1], raw)), None)
                if hit is None:
                    firsts.append((ids[i], bytes(raw)))
                of_.append(hit and hit[0])
                again_.append(hit is not None)
            columns = [batch.column(i) for i in given] + [pa.array(of_, batch.schema.field(at_id).type), pa.array(again_, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return arrow(met, compare, out), of


def duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, duplicate_of) for each row whose very text an earlier row has; earlier: smaller doc_id.

    A repeated row is a duplicate of itself; of n rows with one text n - 1 are returned. Null texts
    equal nothing, the empty text is a text, a null doc_id sorts last. Whole texts count, whatever
    their length; an empty table gives no rows; other columns are ignored.
    """
    marked, of = _mark(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", False)
    return marked.filter(marked[marked.columns[-1]]).select("doc_id", F.col(of).alias("duplicate_of"))


def keep(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row (smallest doc_id, then the other columns) of each text, all columns as they were; null texts all stay.

    Columns that have no order (maps, in whatever nesting) decide no tie: any of the rows then stays. A null doc_id
    comes last; of repeated rows one stays; the empty text is a text; texts of any length are compared whole; an
    empty table gives an empty one; columns named like internal ones are kept.
    """
    marked, _ = _mark(df, doc_id, text, True)
    return marked.filter(~marked[marked.columns[-1]]).select(*[marked[c] for c in df.columns])
