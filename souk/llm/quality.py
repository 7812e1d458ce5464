"""Quality rules: compression bands.

A text that zstandard shrinks far below what prose of its length shrinks to repeats itself; one
that it can hardly shrink is noise. The ratio is taken over the whole document and over each of
its fixed chunks, against limits that depend on the length compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from souk.llm.shared import arrow, free_name, nullable

#: (bytes from, lowest ratio, highest ratio). The frame and the first literals weigh more the shorter the text, so the limits
#: rise below 1 KB: each lies between what was measured of prose of sf0.1 (its 99.9th percentile at least is within) and of
#: base64 of random bytes, repeated phrases below. Under 128 bytes noise and prose meet: only repetition is judged, under 32 nothing.
BANDS = ((0, 0.0, 1e9), (32, 0.6, 1e9), (64, 0.55, 1e9), (96, 0.45, 1e9), (128, 0.36, 0.95), (192, 0.33, 0.88), (256, 0.32, 0.85), (384, 0.32, 0.81), (512, 0.3, 0.76), (1024, 0.24, 0.76), (4096, 0.20, 0.74), (16384, 0.18, 0.72))
#: Prose in scripts of several bytes a character (half the bytes at least not ASCII) shrinks as little as base64 below 1 KB:
#: (bytes from, highest ratio) there.
WIDE = ((0, 1e9), (128, 1.35), (256, 0.95))
_HIGH = bytes(range(128, 256))
CHUNK = 2048
#: Rejected when this share of the chunks is out of band, though the whole is within.
BAD_CHUNKS = 0.2
LEVEL = 3


def judge(raw: bytes, compressor, chunk: int = CHUNK, bands=BANDS, share: float = BAD_CHUNKS) -> tuple[str | None, float, float, float]:
    """(reason or None, whole ratio, lowest and highest ratio of a chunk) of one text."""
    n = len(raw)
    if not raw.strip():
        return "empty", 0.0, 0.0, 0.0

    def ratio(part: bytes) -> tuple[float, int]:
        x = len(compressor.compress(part)) / len(part)
        _, low, high = next(b for b in reversed(bands) if len(part) >= b[0])
        if x > high and len(part) < 1024 and 2 * len(bytes(part).translate(None, _HIGH)) <= len(part):
            high = max(high, next(h for least, h in reversed(WIDE) if len(part) >= least))
        return x, (x < low and -1) or (x > high and 1) or 0

    whole, verdict = ratio(raw)
    if n <= chunk:
        return {-1: "repetitive", 1: "incompressible", 0: None}[verdict], whole, whole, whole
    # the last chunk reaches back to be as long as the others
    view = memoryview(raw)
    each = [ratio(view[i : i + chunk]) for i in [*range(0, n - chunk, chunk), n - chunk]]
    low, high = min(x for x, _ in each), max(x for x, _ in each)
    if verdict:
        return ("repetitive" if verdict < 0 else "incompressible"), whole, low, high
    for sign, reason in ((-1, "repetitive chunks"), (1, "incompressible chunks")):
        if sum(v == sign for _, v in each) >= max(1, share * len(each)):
            return reason, whole, low, high
    return None, whole, low, high


def assess(df: DataFrame, text: str = "text", chunk: int = CHUNK, bands=BANDS, share: float = BAD_CHUNKS) -> DataFrame:
    """Every row of ``df``, all its columns, plus ratio, chunk_low, chunk_high (double), reason (null: keep).

    Null, empty and blank texts have ratio 0 and the reason ``empty``. A row is judged by its own text
    alone: repeated rows and ties are judged alike, an empty table gives an empty one, and a column of
    ``df`` named like an added one stays, the added one getting a ``_``. No shuffle; texts are read
    whole, however long.
    """
    names = []
    for stem in ("ratio", "chunk_low", "chunk_high", "reason"):
        names.append(free_name(df, stem))
    fields = nullable(df.schema).fields
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in names[:3]] + [T.StructField(names[3], T.StringType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        for batch in batches:
            found = [judge(x.as_buffer().to_pybytes() if x.is_valid else b"", z, chunk, bands, share) for x in batch.column(at).cast(pa.large_binary())]
            whole, low, high = ([f[k] for f in found] for k in (1, 2, 3))
            added = [pa.array(whole, pa.float64()), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array([f[0] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return arrow(df, run, schema)


def keep(df: DataFrame, **limits) -> DataFrame:
    """The rows of ``df`` within the bands, with the columns of ``df`` as they were."""
    judged = assess(df, **limits)
    return judged.filter(judged[judged.columns[-1]].isNull()).select(*[judged[c] for c in df.columns])
