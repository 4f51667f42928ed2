"""Quality rules with compression bands.

zstandard ratios (bytes before / bytes after) of the whole text and of fixed chunks must lie in a band
that depends on the length: far above it a text repeats itself, far below it is no language. A few
counts accompany the verdict. One Arrow UDF per row, no shuffle.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bands:
    """``whole``: (bytes, least ratio, greatest ratio), by rising length; between two lengths the limits are linear in the logarithm of the length, outside of all they stay.

    Fit on texts of tables' scale 0.1 that pass the base rules, are labelled clean and have even ids (1,578 texts, 300 bytes to 32 KB):
    the extremes within half an octave, 0.05 wider above and 0.08 below. Below 384 and from 24,576 bytes on they are few, and limits wider.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.5, 1.8),
        (256, 1.15, 1.8),
        (384, 1.31, 1.86),
        (512, 1.34, 1.94),
        (768, 1.46, 1.96),
        (1024, 1.6, 2.04),
        (1536, 1.71, 2.13),
        (2048, 1.81, 2.16),
        (3072, 1.91, 2.24),
        (4096, 2.0, 2.3),
        (6144, 2.07, 2.37),
        (8192, 2.1, 2.4),
        (12288, 2.17, 2.43),
        (16384, 2.2, 2.47),
        (24576, 2.2, 2.54),
        (32768, 2.2, 2.58),
        (65536, 2.2, 2.65),
        (131072, 2.2, 2.72),
    )
    #: From this length on a text has chunks; the last one ends where the text ends and may overlap the one before.
    chunk_bytes: int = 2048
    #: Fit likewise, on their chunks.
    chunk: tuple[float, float] = (1.82, 2.17)
    #: A text is rejected when more than this part of its chunks is out of the chunk band.
    bad_chunks: float = 0.25
    level: int = 3
    least_words: int = 50
    #: Percent of words in repeated three-word windows.
    most_repeated: int = 50

    def limits(self, n: int) -> tuple[float, float]:
        """Least and greatest ratio of a text of ``n`` bytes."""
        after = bisect_right(self.whole, n, key=lambda x: x[0])
        if after in (0, len(self.whole)):
            return self.whole[min(after, len(self.whole) - 1)][1:]
        (a, *below), (b, *above) = self.whole[after - 1 : after + 1]
        part = math.log(n / a) / math.log(b / a)
        return tuple(x + part * (y - x) for x, y in zip(below, above, strict=True))


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("ratio", pa.float64()), ("bad_chunks", pa.float64()), ("base_failed", pa.bool_()), ("in_band", pa.bool_()), ("kept", pa.bool_())]
RETURNS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,ratio:double,bad_chunks:double,base_failed:boolean,in_band:boolean,kept:boolean>"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first time included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, counted_to = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(at, counted_to)
            counted_to = at + 3
    return total


def measure(data: bytes, bands: Bands, compress) -> tuple:
    words = data.split()
    n = len(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    characters = sum(map(len, words)) - (len(data) - len(data.translate(None, CONTINUATION)))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    repeated = repeated_words(words)
    ratio = len(data) / len(compress(data)) if data else 0.0
    low, high = bands.limits(len(data))
    bad, size = 0.0, bands.chunk_bytes
    if len(data) >= size:
        starts = [*range(0, len(data) - size, size), len(data) - size]
        bad = sum(not bands.chunk[0] <= size / len(compress(data[i : i + size])) <= bands.chunk[1] for i in starts) / len(starts)
    failed = n < bands.least_words or 100 * repeated > bands.most_repeated * n
    within = low <= ratio <= high and bad <= bands.bad_chunks
    return n, characters, symbols, len(lines) - len(set(lines)), repeated, ratio, bad, failed, within, within and not failed


def quality_of(text: Column, bands: Bands | None = None) -> Column:
    """A struct of counts, ratios and verdicts of a text; null counts as empty, and empty texts fail."""
    b = bands or Bands()

    @F.arrow_udf(RETURNS)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compress = zstandard.ZstdCompressor(level=b.level).compress
        for batch in batches:
            rows = [measure(value.as_py() or b"", b, compress) for value in batch]
            columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)], fields=[pa.field(name, kind) for name, kind in FIELDS])

    return judged(F.coalesce(text, F.lit("")).cast("binary"))


def score_quality(docs: DataFrame, *, text_col: str = "text", quality_col: str = "quality_report", bands: Bands | None = None) -> DataFrame:
    """``docs`` plus the struct ``quality_of`` its text.

    A column of the same name is replaced, others stay. Null and empty texts have counts of 0 and fail. Repeated rows get the
    same verdict each; an empty table stays empty. Texts of any length are measured whole, one at a time.
    """
    return docs.withColumn(quality_col, quality_of(F.col(text_col), bands))


def keep_good(docs: DataFrame, *, text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they were, whatever their names.

    Null and empty texts go. Repeated rows stay or go together; an empty table stays empty; very long texts are judged whole.
    """
    return docs.where(quality_of(F.col(text_col), bands)["kept"])
