"""Web archive records and their index, merged externally to capture histories.

Each input partition gives a capture run, sorted where it is by (URL key, timestamp) and written to the shared
folder. The runs are cut at common bounds, a range for every ``RANGE`` bytes of index whatever its keys (a URL of
many captures is cut by time); each range then merges its pieces of the k runs with a loser tree, log2(k)
comparisons a capture. The ranges in order are the global order; where a URL goes on from one range to the next,
its count and last digest are handed over.
"""

from __future__ import annotations

import gzip
import io
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.shared import arrow, table

#: Where pages carry no capture time, page_id seconds after this moment stand for it (2024-01-01 UTC).
EPOCH = 1_704_067_200
#: Bytes of index that a task merges at a time, and the sampled rows a range from which the bounds are taken.
RANGE, SAMPLES = 16 << 20, 16
#: Seconds of the years 1 to 9999.
_YEARS = (-62_135_596_800, 253_402_300_799)


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the root the next item.

    Equal items come in the order of their sequences. Exhausted sequences lose every match.
    """

    def __init__(self, runs):
        self.iters = [iter(r) for r in runs]
        self.k = len(self.iters)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _next(self, i: int):
        for item in self.iters[i]:
            return (item,)
        return None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return a[0] < b[0] or (not b[0] < a[0] and i < j)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        i, j = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (i, j) if self._beats(i, j) else (j, i)
        self.losers[node] = lost
        return won

    def __iter__(self):
        return self

    def __next__(self):
        w = self.winner
        if w < 0 or self.heads[w] is None:
            raise StopIteration
        item = self.heads[w][0]
        self.heads[w] = self._next(w)
        node = (w + self.k) // 2
        while node:
            other = self.losers[node]
            if self._beats(other, w):
                self.losers[node], w = w, other
            node //= 2
        self.winner = w
        return item


def url_key(url: Column) -> Column:
    """The sortable key of a URL: host parts reversed, then the path and the sorted query.

    Scheme, user, ``www`` prefix, default ports, fragment and trailing slashes don't count, nor does case. Null: "".
    """
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    u = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^([^/?]*)", 1), r"^.*@", ""), r":(80|443)?$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    reverse = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))
    return F.when(u == "", F.lit("")).otherwise(F.concat(reverse, F.lit(")"), path, tail))


def stamp(seconds: Column) -> Column:
    """Fourteen digits of UTC, whatever the session's zone; "" for null and outside the years 1 to 9999."""
    day, of = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    digits = [F.lpad(x.cast("int").cast("string"), 2, "0") for x in (F.floor(of / 3600), F.floor(of / 60) % 60, of % 60)]
    text = F.concat(F.translate(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), "-", ""), *digits)
    return F.when(seconds.between(*_YEARS), text).otherwise(F.lit(""))


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", taken: str | None = None) -> DataFrame:
    """(url_key, timestamp of 14 digits, page_id, url, digest: MD5 of the payload, length in bytes as string)."""
    seconds = F.unix_seconds(F.col(taken).cast("timestamp")) if taken else F.try_add(F.col(page_id).cast("bigint"), F.lit(EPOCH))
    return pages.select(
        url_key(F.col(url)).alias("url_key"),
        stamp(seconds).alias("timestamp"),
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.md5(F.coalesce(F.col(html), F.lit(""))).alias("digest"),
        F.coalesce(F.octet_length(F.col(html)), F.lit(0)).cast("string").alias("length"),
    )


def runs(index: DataFrame) -> DataFrame:
    """The index with (run, seq): each partition sorted by itself and numbered, written to the shared folder."""
    ordered = index.sortWithinPartitions("url_key", "timestamp", F.col("page_id").asc_nulls_first(), "digest")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([run] * m, pa.int32()), pa.array(range(n, n + m), pa.int64())], names=[*batch.schema.names, "run", "seq"])
            n += m

    return table(arrow(ordered, number, T.StructType([*index.schema.fields, T.StructField("run", T.IntegerType()), T.StructField("seq", T.LongType())])), "runs")


def _place(key: str, stamp: str, page) -> tuple:
    return key, stamp, page is not None, page if page is not None else 0


def bounds(run_table: DataFrame, size: int = RANGE) -> list[tuple]:
    """Where the ranges after the first begin, in order: a bound for every ``size`` bytes of the index, from a sample by hash."""
    rows, total = run_table.agg(F.count("*"), F.sum(F.octet_length("url_key") + F.octet_length(F.coalesce("url", F.lit(""))) + 80)).first()
    if not rows or total <= size:
        return []
    n = -(-total // size)
    one_in = max(1, rows // (n * SAMPLES))
    some = run_table.filter(F.pmod(F.xxhash64("url_key", "timestamp", "page_id"), F.lit(one_in)) == 0).select("url_key", "timestamp", "page_id").toArrow().to_pydict()
    held = sorted({_place(*x) for x in zip(some["url_key"], some["timestamp"], some["page_id"])})
    return sorted({held[i * len(held) // n] for i in range(1, n)}) if held else []


def histories(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", taken: str | None = None, size: int = RANGE) -> DataFrame:
    """(url_key, timestamp, page_id, url, digest, length, capture_no, kind): every capture in global order.

    capture_no counts a URL key's captures from 1 (ties in time: page_id, then digest; repeated rows count
    each); kind is ``revisit`` where the capture before has the same payload, else ``response``. A null URL
    has the key "", a null page has the payload of an empty one; a null time or page_id, and a time outside the
    years 1 to 9999, has the timestamp "" and sorts first. Payloads of any length count whole. An empty table
    gives no rows; other columns are ignored.
    """
    run_table = runs(captures(pages, page_id, url, html, taken))
    fields = run_table.schema.fields[:-2]
    names = [f.name for f in fields]
    at = [names.index(n) for n in ("url_key", "timestamp", "page_id", "digest")]
    cuts = bounds(run_table, size)
    split = {c[0] for c in cuts}  # the keys that may go on from one range to the next

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, time, page = (batch.column(i).to_pylist() for i in at[:3])
            ranges = [bisect_right(cuts, _place(*x)) for x in zip(key, time, page)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges, pa.int32()), pa.array([k in split for k in key], pa.bool_())], names=[*batch.schema.names, "range", "split"])

    assigned = arrow(run_table, assign, T.StructType([*run_table.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("split", T.BooleanType())]))
    # at most a row for each range and bound
    ends = assigned.filter("split").groupBy("url_key", "range").agg(F.count("*").alias("n"), F.max(F.struct("timestamp", "page_id", "digest")).alias("last")).collect() if cuts else []
    carried: dict[int, tuple[int, str | None]] = {}
    counts: dict[str, tuple[int, str | None]] = {}
    by_range: dict[int, list] = {}
    for r in ends:
        by_range.setdefault(r["range"], []).append(r)
    for i, c in enumerate(cuts):
        for r in by_range.get(i, ()):
            counts[r["url_key"]] = (counts.get(r["url_key"], (0, None))[0] + r["n"], r["last"]["digest"])
        carried[i + 1] = counts.get(c[0], (0, None))
    ranged = assigned.drop("split").repartitionByRange(len(cuts) + 1, "range").sortWithinPartitions("range", "run", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ranges = batch.column("range").to_numpy()
            starts = [0, *(int(i) + 1 for i in (ranges[1:] != ranges[:-1]).nonzero()[0]), len(ranges)]
            for a, b in zip(starts, starts[1:]):
                if held and held[-1].column("range")[0].as_py() != int(ranges[a]):
                    yield from one_range(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from one_range(held)

    def one_range(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        run = whole.column("run").to_pylist()
        pieces = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
        key, time, page, digest = (whole.column(i).to_pylist() for i in at)

        def items(a: int, b: int):
            for i in range(a, b):
                yield (*_place(key[i], time[i], page[i]), digest[i], i)

        order, numbers, kinds = [], [], []
        now, (n, last) = None, carried.get(whole.column("range")[0].as_py(), (0, None))
        if n:
            now = cuts[whole.column("range")[0].as_py() - 1][0]
        for *_, i in LoserTree([items(a, b) for a, b in zip(pieces, pieces[1:])]):
            n, last = (n + 1, last) if key[i] == now else (1, None)
            kinds.append("revisit" if digest[i] == last else "response")
            numbers.append(n)
            order.append(i)
            now, last = key[i], digest[i]
        out = whole.select(names).take(pa.array(order, pa.int64())).append_column("capture_no", pa.array(numbers, pa.int64())).append_column("kind", pa.array(kinds, pa.string()))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return arrow(ranged, merge, T.StructType([*fields, T.StructField("capture_no", T.LongType()), T.StructField("kind", T.StringType())]))


HISTORY_SQL = r"""
    WITH cut AS (
        SELECT page_id, url, coalesce(html, '') AS html,
               regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '') AS u
        FROM pages
    ), parts AS (
        SELECT page_id, url, html, u,
               regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\.', '') AS host,
               regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
               regexp_extract(u, '\?(.*)$', 1) AS query
        FROM cut
    ), keyed AS (
        SELECT CASE WHEN u = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path ||
                   CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS url_key,
               coalesce(strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y%m%d%H%M%S'), '') AS "timestamp",
               page_id, url, md5(html) AS digest, CAST(strlen(html) AS VARCHAR) AS length
        FROM parts
    )
    SELECT url_key, "timestamp", page_id, url, digest, length,
           row_number() OVER w AS capture_no,
           CASE WHEN lag(digest) OVER w = digest THEN 'revisit' ELSE 'response' END AS kind
    FROM keyed
    WINDOW w AS (PARTITION BY url_key ORDER BY "timestamp", page_id NULLS FIRST, digest)
"""

def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive file, gzip members or plain, read as a stream.

    What is damaged ends the file there: a cut last record or gzip member is left out. A record without a whole
    number as its length is skipped, as is whatever stands between records.
    """
    f = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    try:
        while line := f.readline(1 << 16):
            if line.rstrip(b"\r\n") not in (b"WARC/1.0", b"WARC/1.1"):
                continue
            head = {}
            while (line := f.readline(1 << 16)).strip():
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            n = head.get("content-length", "")
            if not line or not (n.isascii() and n.isdigit()) or len(n) > 18:
                continue
            block = f.read(int(n))
            if len(block) < int(n):
                return
            yield head, block
    except (EOFError, OSError, zlib.error):
        return


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if k.lower() != "content-length")
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def read_pages(files: DataFrame) -> DataFrame:
    """(url, taken: timestamp, html) of the responses in archive files read with ``binaryFile``; other records are skipped.

    A null, empty or foreign file has none, a damaged one those before the damage. A missing URL or a date that
    is none is null; bytes that aren't UTF-8 become U+FFFD; repeated records are returned each. No files, no rows;
    other columns are ignored.
    """
    schema = "url string, taken string, html string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["url", "taken", "html"])

        for batch in batches:
            for raw in batch.column(0).cast(pa.large_binary()):
                rows, size = [], 0
                for head, block in records(raw.as_py() or b""):
                    if head.get("warc-type") == "response":
                        _, _, body = block.partition(b"\r\n\r\n")
                        rows.append((head.get("warc-target-uri"), head.get("warc-date"), body.decode("utf-8", "replace")))
                        if (size := size + len(body)) > 16 << 20:
                            yield handed()
                            rows, size = [], 0
                yield handed()

    return arrow(files.select("content"), run, schema).withColumn("taken", F.try_to_timestamp("taken"))
