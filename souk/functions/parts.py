"""How many parts a shuffle has, by the size of what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Of the files that a plan reads, for each part; a part's rows take some ten times as much in memory.
PART_BYTES = 8 << 20


def file_bytes(df: DataFrame) -> int:
    """The bytes of all files that the plan of ``df`` reads, once for each time it reads them; other sources count nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    scans = [x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]
    return sum(int(str(x.stats().sizeInBytes())) for x in scans if x.relation().getClass().getSimpleName() == "HadoopFsRelation")


def spread(df: DataFrame, *keys: str, by: DataFrame | None = None) -> DataFrame:
    """``df`` by its keys in as many parts as the files behind ``by`` (itself, if none is given) ask for; as it is where the session's number of parts is enough.

    A join puts its other side into as many parts, so it is the smaller side that is spread, by the larger one's size:
    where Spark broadcasts that side nothing else is shuffled.
    """
    n = -(-file_bytes(df if by is None else by) // PART_BYTES)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
