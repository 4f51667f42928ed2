"""Token counts under a unigram vocabulary by dynamic programming shared over a trie.

The distinct pre-tokens of a batch, sorted, are walked as the depth-first order of their trie: the
forward score of a prefix (best log probability of a segmentation, and its number of tokens) is
computed once and kept on a stack while the walk is below it; the state where a pre-token ends is its
count. A document's count is the sum over its pre-tokens. No shuffle; memory holds one path of the
trie and a bounded memo of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Pre-tokens a memo may hold, and the longest that it keeps: 60 MB at most.
MEMO_ENTRIES, LONGEST_KEY = 200_000, 64
#: How far a byte of an unknown character lies below the least likely piece.
BYTE_PENALTY = 10.0


class Unigram:
    """Pieces with log probabilities by Zipf's law of their rank in the vocabulary file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        norm = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        self.scores = {piece: -math.log(r + 1) - norm for r, piece in enumerate(ranked)}
        self.byte = min(self.scores.values()) - BYTE_PENALTY
        # Endings of pieces: where a text's ending is none of them, no longer piece ends there either.
        self.suffixes = {piece[i:]: -math.inf for piece in ranked for i in range(len(piece))} | self.scores
        self.memo: dict[bytes, int] = {}

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Token counts of words, which must be sorted. The best state of a prefix has more score, then fewer tokens."""
        scores, tokens, path, suffixes = [0.0], [0], "", self.suffixes
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del scores[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                best, fewest = scores[-1] + n * self.byte, tokens[-1] + n
                for begin in range(end - 1, -1, -1):
                    if (own := suffixes.get(word[begin:end])) is None:
                        break
                    score = scores[begin] + own
                    if score > best or score == best and tokens[begin] + 1 < fewest:
                        best, fewest = score, tokens[begin] + 1
                scores.append(best)
                tokens.append(fewest)
            path = word
            yield word, tokens[-1]

    def count(self, documents: list[bytes]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each document."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        split = [d.split() for d in documents]
        missing, own = set().union(*split).difference(self.memo), {}
        new = {BLANK + w.decode("utf-8", "replace"): w for w in missing}
        for word, n in self.walk(sorted(new)):
            own[new[word]] = n
        # Malformed bytes may read alike; they are counted by themselves.
        for w in missing.difference(own):
            own[w] = next(n for _, n in self.walk([BLANK + w.decode("utf-8", "replace")]))
        self.memo.update((w, n) for w, n in own.items() if len(w) <= LONGEST_KEY)
        known = self.memo
        return [(len(words), sum(own[w] if w in own else known[w] for w in words)) for words in split]


@lru_cache(maxsize=1)
def unigram(path: str) -> Unigram:
    return Unigram(path)


#: Documents whose pre-tokens share a trie.
TRIE_DOCUMENTS = 500


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words (pre-tokens between ASCII white space) and n_tokens of each row.

    Null and empty texts have none; null ids and repeated rows are kept; other columns, whatever their names, are not carried
    along; an empty table gives no rows. Of equally likely segmentations the one with fewer tokens counts. A pre-token of any
    length is scored whole, in time linear in it and in memory of some 100 bytes a character.
    """
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TRIE_DOCUMENTS):
                part = batch.slice(at, TRIE_DOCUMENTS)
                counts = model.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w for w, _ in counts], pa.int64()), pa.array([t for _, t in counts], pa.int64())], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
