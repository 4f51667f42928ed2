"""Sharding by histogram sort.

Rows are keyed by (hash of the text, id): equal texts are neighbours, and a group that is larger than
a shard can still be divided. Splitters are found without moving a row: the candidate boundaries of
each round divide the intervals that still hold a splitter into equal parts, one distributed
aggregation counts the exact bytes in every part, and the intervals shrink to the parts that the
targets fall into until each boundary is within tolerance. Then one exchange deals the rows.

The same probes find the boundaries of shards and of the cells inside them, ranges of keys of about
CELL_BYTES bytes. A cell is one task of the exchange: it sorts its rows, and the exact row counts of
the cells before it give its first slot, so slots go in the order of keys through a whole shard.

Only counts of candidate parts reach the driver: about 32 for each cell in the first round, at most
2**NEXT_BITS for each boundary still open in later ones; cells are MAX_CELLS at most. Rounds read a
written table of keys and sizes, not the texts.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST_BITS, NEXT_BITS = 10, 8
#: Bytes of rows that one task sorts, and how far its boundaries may be from their share, in parts of it.
CELL_BYTES, CELL_TOLERANCE = 16 << 20, 0.1
MAX_CELLS = 1 << 14


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Only a local session, as in tests, may do without and uses its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here, and no task computes it twice."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove what ``written`` wrote, once nothing that is still to run reads it."""
    for table in tables:
        hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Probe:
    """Keys that share the first ``bits`` bits ``prefix``; ``below`` bytes lie before them."""

    prefix: int
    bits: int
    below: int
    inside: int


def _prefix(high: Column, low: Column, bits: int, low_bits: int) -> tuple[Column, Column]:
    """The leading bits of the 64 + low_bits wide key as two numbers: of the hash, and of the id."""
    if bits <= 64:
        return (F.shiftright(high, 64 - bits) if bits < 64 else high), F.lit(0).cast("long")
    return high, F.shiftright(low, 64 + low_bits - bits)


def find_splitters(keys: DataFrame, cells: int, every: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries (high, low), the first keys of cells 1, 2, ...; ``keys`` has the columns high, low (0 at least) and size.

    Each ``every``-th boundary parts two shards and is within ``tolerance`` of a shard's share; the others are within
    CELL_TOLERANCE of a cell's.
    """
    top, total = keys.agg(F.max("low"), F.sum("size")).first()
    if not total:
        return []
    low_bits = max(1, int(top).bit_length())
    width = 64 + low_bits
    targets = [total * (i + 1) / cells for i in range(cells - 1)]
    slack = [total / cells * (every * tolerance if (i + 1) % every == 0 else CELL_TOLERANCE) for i in range(cells - 1)]
    open_probes = {i: Probe(-1, 0, 0, total) for i in range(cells - 1)}
    splitters: dict[int, tuple[int, int]] = {}
    bits = 0
    while open_probes:
        step = min(max(FIRST_BITS, cells.bit_length() + 5) if bits == 0 else NEXT_BITS, width - bits)
        upper, lower = _prefix(F.col("high"), F.col("low"), bits, low_bits) if bits else (None, None)
        bits += step
        deep_upper, deep_lower = _prefix(F.col("high"), F.col("low"), bits, low_bits)
        rows = keys
        if bits > step:
            wanted = {p.prefix for p in open_probes.values()}
            if bits - step <= 64:
                rows = rows.where(upper.isin([p for p, _ in wanted]))
            else:
                rows = rows.where(F.concat_ws(":", upper, lower).isin([f"{a}:{b}" for a, b in wanted]))
        counted = rows.groupBy(deep_upper.alias("upper"), deep_lower.alias("lower")).agg(F.sum("size").alias("size"), F.min(F.struct("high", "low")).alias("least"), F.max(F.struct("high", "low")).alias("most")).collect()
        parts = sorted((r["upper"], r["lower"], r["size"], tuple(r["least"]) if r["least"] == r["most"] else None) for r in counted)
        # Parts of one parent in order, with the bytes that lie before each.
        parents: dict = {}
        for a, b, size, only in parts:
            mine = parents.setdefault(_parent(a, b, bits - step, bits, low_bits), [])
            mine.append((a, b, size, only, mine[-1][4] + mine[-1][2] if mine else 0))
        after = {}
        for i, probe in open_probes.items():
            mine = parents[probe.prefix if probe.bits else (-1, 0)]
            # The first part whose end comes within slack of the target, or beyond.
            at = min(bisect_left(mine, targets[i] - slack[i] - probe.below, key=lambda p: p[4] + p[2]), len(mine) - 1)
            a, b, size, only, before = mine[at]
            below = probe.below + before
            # A part of a single key can't be divided: the nearer of its edges it is.
            if abs(below - targets[i]) <= slack[i] or only and targets[i] - below <= below + size - targets[i]:
                splitters[i] = _start(a, b, bits, low_bits)
            elif abs(below + size - targets[i]) <= slack[i] or only:
                splitters[i] = _next(a, b, bits, low_bits)
            else:
                after[i] = Probe((a, b), bits, below, size)
        open_probes = after
    return [splitters[i] for i in range(cells - 1)]


def _parent(a: int, b: int, bits: int, deep: int, low_bits: int) -> tuple[int, int]:
    if bits == 0:
        return -1, 0
    if deep <= 64:
        return a >> (deep - bits), 0
    return (a >> (64 - bits), 0) if bits <= 64 else (a, b >> (deep - bits))


def _start(a: int, b: int, bits: int, low_bits: int) -> tuple[int, int]:
    return (a << (64 - bits), 0) if bits <= 64 else (a, b << (64 + low_bits - bits))


def _next(a: int, b: int, bits: int, low_bits: int) -> tuple[int, int]:
    """The first key after the cell; one above the largest hash stands for none."""
    if bits <= 64:
        return _start(a + 1, 0, bits, low_bits)
    low = (b + 1) << (64 + low_bits - bits)
    return (a, low) if low < 1 << low_bits else (a + 1, 0)


def constants(values: list[int]) -> Column:
    """An array of numbers as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def cell_of(high: Column, low: Column, splitters: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below a key, by binary search."""
    if not splitters:
        return F.lit(0)
    # Above the largest hash there is no key: such a boundary is one beyond the largest id of that hash.
    top = (1 << 63) - 1
    known = [(a, b) if a <= top else (top, top) for a, b in splitters]
    highs, lows, n = constants([a for a, _ in known]), constants([b for _, b in known]), len(known)
    steps = n.bit_length()

    def narrowed(found: Column, step: Column) -> Column:
        # ``found`` boundaries are at or below the key; are ``step`` more?
        at = found + step
        a, b = F.get(highs, at - 1), F.get(lows, at - 1)
        return F.when((at <= n) & ((a < high) | ((a == high) & (b <= low))), at).otherwise(found)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), narrowed)


def histogram_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 8, tolerance: float = 0.0005, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """All columns of ``docs`` plus shard (int) and slot (long, gapless from 0 in each shard).

    A row weighs the UTF-8 bytes of its text (null: none) plus ``row_bytes``; shards differ from their share by
    ``tolerance`` of it and one row at each end. Slots go by (hash of the text, id), so equal texts have consecutive slots,
    by id; a group is divided only where a boundary passes through it. Null texts count as empty ones, null ids as the lowest
    id. Rows that agree in id and text stay together, in any order. Very long texts are rows like others: one of more than a
    shard's share fills its shard alone. Existing columns shard and slot are replaced, others kept, whatever their names. An
    empty table stays empty.
    """
    spark = docs.sparkSession
    hidden = [f"__{c}_{uuid.uuid4().hex[:8]}" for c in ("high", "low", "cell")]
    high, low, cell = hidden
    docs = docs.drop("shard", "slot")
    print_of = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    identity = F.col(id_col).cast("long")
    least = written(docs.select(print_of.alias("high"), identity.alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(row_bytes)).cast("long").alias("size")), "shard-keys")
    bottom, total = least.agg(F.min("id"), F.sum("size")).first()
    bottom = bottom or 0
    lowest = lambda c: F.coalesce(c - F.lit(bottom) + F.lit(1), F.lit(0)).cast("long")
    keys = least.select("high", lowest(F.col("id")).alias("low"), "size")

    # Cells of a shard: by bytes, and enough for all tasks.
    every = min(MAX_CELLS // shards, max(1, math.ceil((total or 0) / shards / cell_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    cells = shards * every
    splitters = find_splitters(keys, cells, every, tolerance)
    counts = dict(keys.groupBy(cell_of(F.col("high"), F.col("low"), splitters).alias("cell")).count().collect())
    first, at = [], 0
    for k in range(cells):
        at = 0 if k % every == 0 else at
        first.append(at)
        at += counts.get(k, 0)

    keyed = docs.withColumns({high: print_of, low: lowest(identity)})
    keyed = keyed.withColumn(cell, cell_of(F.col(high), F.col(low), splitters)).repartitionById(cells, F.col(cell))
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(high, low))
    numbered = keyed.withColumns({"slot": (rank + F.get(constants(first), F.col(cell)) - 1).cast("long"), "shard": F.floor(F.col(cell) / every).cast("int")})
    return numbered.drop(*hidden)
