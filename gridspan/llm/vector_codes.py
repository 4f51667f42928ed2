"""Vector codes: the parts of a vector as entries of codebooks, found by exponion search on integers.

Every component becomes an integer, so that distances, sums and ties are exact. A part starts at the entry that it had
before. Entry j can only be as near as entry a if D(a, j) <= 4 D(x, a) for squared distances, by the triangle inequality;
each entry's others are sorted by distance, so those within reach are the head of its list, found by binary search. Among
them the nearest wins, ties by the lower index.

One pass over the vectors is one round: tasks assign their parts and add up what they assigned, at most one sum for each
entry and task; the sums meet in one small aggregation. Vectors with their current entries are written to the shared
folder after every round, and those of the round before are removed, so a lost executor costs its own tasks only. The
driver and the broadcasts hold codebooks: parts x entries x length, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .histogram_sort import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one distance table, copies of each label's sum in the join that deals them out.
ROWS, SALTS = 512, 16


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in one array, and the length of each row."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


class Exponion:
    """Nearest entries of one codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.norms = (book * book).sum(1)
        apart = self._squared(book, self.norms, slice(None))
        self.order = np.argsort(apart, axis=1, kind="stable")
        # D <= 4 u just if the quarter of D, rounded up, is at most u.
        self.quarters = np.take_along_axis(-(-apart // 4), self.order, 1)

    def _squared(self, x: np.ndarray, norms: np.ndarray, chosen) -> np.ndarray:
        book = self.book[chosen]
        if x.size and book.size and float(np.abs(x).max()) * float(np.abs(book).max()) * x.shape[1] < 2**52:
            inner = (x.astype(np.float64) @ book.T.astype(np.float64)).astype(np.int64)
        else:
            inner = x @ book.T
        return norms[:, None] - 2 * inner + self.norms[chosen][None, :]

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest entry, and its squared distance."""
        gap = x - self.book[start]
        found, best = start.copy(), (gap * gap).sum(1)
        norms = (x * x).sum(1)
        by_start = np.argsort(start, kind="stable")
        for rows in np.split(by_start, np.flatnonzero(np.diff(start[by_start])) + 1) if len(x) else []:
            a = start[rows[0]]
            reach = np.searchsorted(self.quarters[a], best[rows], side="right")
            by_reach = np.argsort(reach, kind="stable")
            for k in range(0, len(rows), ROWS):
                some = by_reach[k : k + ROWS]
                mine, near = rows[some], self.order[a, : reach[some[-1]]]
                apart = self._squared(x[mine], norms[mine], near)
                best[mine] = apart.min(1)
                found[mine] = np.where(apart == best[mine][:, None], near[None, :], len(self.book)).min(1)
        return found, best


@dataclass(frozen=True)
class Codebooks:
    """books[part][entry] are the components of an entry."""

    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _largest(length: int) -> int:
    """Components beyond it are brought to it, so that a vector's distance fits 64 bits."""
    return int((2**62 / length) ** 0.5 / 2)


def _whole_numbers(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """id, label, size, and ints (64-bit integers, filled up with zeros to a multiple of ``parts``)."""
    schema = T.StructType([vectors.schema["id"], vectors.schema["label"], T.StructField("size", T.IntegerType()), T.StructField("ints", T.BinaryType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = list_rows(batch.column(2))
            out, at = [], 0
            whole = np.floor(values.astype(np.float64) * scale)
            for n in lengths:
                most = _largest(-(-n // parts) * parts)
                row = np.zeros(-(-n // parts) * parts, "<i8")
                row[:n] = np.clip(whole[at : at + n], -most, most)
                out.append(row.tobytes())
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(out, pa.binary())], names=["id", "label", "size", "ints"])

    return vectors.mapInArrow(convert, schema)


def _round(table: DataFrame, books: np.ndarray, last: bool) -> DataFrame:
    """Rows with their nearest entries from where they were; with them, unless it is the last round, rows of sums by part and entry."""
    parts, entries, length = books.shape
    shared = table.sparkSession.sparkContext.broadcast(books)
    fields = [table.schema["id"], table.schema["label"], T.StructField("codes", T.BinaryType())]
    fields += [T.StructField("error", T.LongType())] if last else [T.StructField("ints", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("part", "entry", "n")], T.StructField("sums", T.ArrayType(T.LongType()))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Exponion(b) for b in shared.value]
        sums, counts, kinds = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64), None
        for batch in batches:
            kinds = batch.schema
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8").reshape(n, parts, length)
            start = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                found, apart = search[p].nearest(x[:, p], start[:, p])
                codes[:, p] = found
                error += apart
                if not last:
                    np.add.at(sums[p], found, x[:, p])
                    counts[p] += np.bincount(found, minlength=entries)
            cells = pa.array([r.tobytes() for r in codes], pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells, pa.array(error)], names=["id", "label", "codes", "error"])
            else:
                none = [pa.nulls(n, pa.int64())] * 3 + [pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells, batch.column(2), *none], names=[f.name for f in fields])
        if kinds is not None and not last:
            part, entry = np.nonzero(counts)
            n = len(part)
            none = [pa.nulls(n, kinds.field(0).type), pa.nulls(n, kinds.field(1).type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=[f.name for f in fields])

    return table.select("id", "label", "ints", "codes").mapInArrow(assign, T.StructType(fields))


def _moved(books: np.ndarray, assigned: DataFrame) -> np.ndarray:
    """Each entry at the mean, rounded down, of the parts it was assigned; others stay."""
    sums = assigned.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    moved = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        moved[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return moved


def compress_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """id_col, label_col, codes (one byte per part) and error (long) of each usable vector, and the codebooks.

    Codebooks start as the parts of the vectors with the least ids: null ids come last, ties go by the vector; with fewer
    vectors there are fewer entries. Null and empty vectors and those with null or infinite components or NaN are left out, and so
    are vectors of another length than the first. Lengths that ``parts`` doesn't divide are filled up with zeros. Components beyond
    what 64-bit distances hold (131,072 for 64 components at scale 1,024) count as that limit. Repeated rows stay, each with its
    code. An empty table gives no rows and no codebooks. Other columns, whatever their names, are not carried along.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry is one byte")
    kept = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    table = written(_whole_numbers(kept, scale, parts).withColumn("codes", F.lit(bytes(parts))), "codes-0")
    leading = table.orderBy(F.asc_nulls_last("id"), "ints").limit(1).select("size").collect()
    same = table.where(F.col("size") == (leading[0]["size"] if leading else 0))
    first = same.orderBy(F.asc_nulls_last("id"), "ints").limit(entries).select("ints").collect()
    books = np.array([np.frombuffer(r["ints"], "<i8").reshape(parts, -1) for r in first], np.int64).swapaxes(0, 1) if first else np.zeros((parts, 1, 1), np.int64)
    books = np.ascontiguousarray(books)
    for k in range(rounds if first else 0):
        after = written(_round(same, books, last=False), f"codes-{k + 1}")
        books = _moved(books, after)
        discard(table)
        table, same = after, after.where("ints is not null")
    done = written(_round(same, books, last=True), "codes")
    discard(table)
    return done.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error"), Codebooks(books) if first else None


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` plus label_error: error summed over equal labels, nulls together; null where 64 bits don't hold it. A label's rows are dealt to SALTS tasks."""
    sums = coded.groupBy(F.col(label_col).alias("__label")).agg(F.try_sum("error").alias("label_error")).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("codes", "error"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, salted[label_col].eqNullSafe(sums["__label"]) & (salted["__salt"] == sums["__copy"]))
    return joined.drop("__label", "__copy", "__salt")
