"""Token counts of whole texts, long ones by overlapping chunks spliced where they agree.

A long text is normalised once and cut into chunks that overlap. Each chunk is encoded by the
tokenizer and its tokens get byte offsets. Two neighbouring encodings are spliced at a token both
hold at the same offsets. That boundary is proven, not guessed: merging by priority is decided
between neighbours, so a sequence is the encoding of its text exactly when every pair of adjacent
tokens is the encoding of that pair. Up to and including the shared token all pairs come from the
left chunk, from it on from the right one, so every pair of the spliced sequence has been checked
by the tokenizer. Without a shared token inside the overlap, the left chunk is encoded anew with
an overlap twice as wide, up to the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.llm.common import kept_in_worker

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
TOKEN_LIMIT = 4096
#: The sign that stands for a space in normalised text.
SPACE = "▁"


class PieceCounter:
    """Counts pieces of a BPE model with byte fallback, in chunks where a text is long."""

    def __init__(self, model_file: str, chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.widened = 0
        model = self.pieces
        self.lengths = np.array([
            1 if model.IsByte(i) else len(model.IdToPiece(i).encode())
            for i in range(model.GetPieceSize())], np.int64)

    def count(self, text: str | None) -> int:
        """Tokens of a text; none for null and empty texts."""
        if not text:
            return 0
        if len(text) <= self.chunk:
            return len(self.pieces.encode(text))
        return self.count_long(text)

    def count_many(self, texts: list[str | None]) -> list[int]:
        short = [i for i, text in enumerate(texts) if text and len(text) <= self.chunk]
        counts = [0] * len(texts)
        for i, ids in zip(short, self.pieces.encode([texts[i] for i in short], num_threads=1)):
            counts[i] = len(ids)
        for i, text in enumerate(texts):
            if text and len(text) > self.chunk:
                counts[i] = self.count_long(text)
        return counts

    def _encode(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token of text[start:end], in bytes from ``start``.

        The tokenizer puts a space sign before what it is given; where the chunk starts with one
        it is left out, elsewhere the offsets are moved back by its length. It also drops spaces
        at the end, whose tokens then are missing here and found in the next chunk.
        """
        own = text.startswith(SPACE, start)
        ids = self.pieces.encode(text[start + 1 if own else start:end])
        ends = np.cumsum(self.lengths[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
        ends = ends - (0 if own else len(SPACE.encode()))
        return np.concatenate([[0 if own else -len(SPACE.encode())], ends[:-1]]), ends

    def count_long(self, text: str) -> int:
        """The count by splicing; equal to encoding the text in one go."""
        whole = self.pieces.normalize(text)
        size = len(whole)
        total, start, end = 0, 0, min(size, self.chunk)
        starts, ends = self._encode(whole, start, end)
        settled = 0                          # tokens of this chunk before it are counted already
        while end < size:
            overlap = self.overlap
            while True:
                reach = max(start + 1, end - overlap)
                behind = len(whole[start:reach].encode())
                later = min(size, reach + self.chunk)
                next_starts, next_ends = self._encode(whole, reach, later)
                _, left, right = np.intersect1d(
                    (starts[settled:] - behind) << 32 | (ends[settled:] - behind),
                    next_starts << 32 | next_ends, assume_unique=True, return_indices=True)
                inside = next_starts[right] >= 0
                if inside.any():
                    at = int(np.flatnonzero(inside)[0])
                    total += int(left[at])
                    start, end, settled = reach, later, int(right[at])
                    starts, ends = next_starts, next_ends
                    break
                # No shared token: the left chunk reaches further and the overlap is doubled.
                self.widened += 1
                overlap *= 2
                end = min(size, end + overlap)
                starts, ends = self._encode(whole, start, end)
                if end == size:
                    break
        return total + len(starts) - settled


def token_counts(text: Column, model_file: str, chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS) -> Column:
    """Tokens of a text column, as the tokenizer counts them in whole texts."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = kept_in_worker(f"pieces_{hash((model_file, chunk_chars, overlap_chars))}",
                                 lambda: PieceCounter(model_file, chunk_chars, overlap_chars))
        for texts in batches:
            yield pa.array(counter.count_many(texts.to_pylist()), pa.int64())

    return counted(text)


def count_tokens(df: DataFrame, model_file: str, text_col: str = "text",
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Null and empty texts have zero bytes and tokens. Rows pass through one by one, so repeated
    rows, null ids and other columns are kept as they are; the three columns replace any of
    their names. An empty table gives an empty table.
    """
    return df.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"),
        "n_tokens": token_counts(F.col(text_col), model_file),
    }).withColumn("over_limit", F.col("n_tokens") > limit)
