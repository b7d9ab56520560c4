"""Byte-level BPE: merges compiled into a lazily determinised transducer, and streamed decoding.

Encoding. Merging by rank is decided between neighbours: a token sequence is the encoding of its
bytes exactly when every token encodes itself and every two adjacent tokens encode as that pair.
So the encodings are the paths of a transducer whose states are (token before, place in the
vocabulary trie). It is not deterministic: where a token ends is known only some bytes later. The
subset construction runs while texts are read: a deterministic state is the set of live paths
with the tokens each still owes; what all of them owe is emitted at once. A path lives no longer
than the longest token, which bounds the lookahead. Of all paths exactly one stands between
tokens at any byte, so the end of a piece is never ambiguous. The table of states is bounded; when
it is full, a piece that needs others is read by following its paths one by one, long tokens first.
(Emptying the full table was tried and is slower: the states that are needed early are needed most.)

Decoding. A state machine over bytes holds back an unfinished character and puts U+FFFD for
invalid bytes; its steps are composed per token and kept, so a stream of ids becomes text piece
by piece.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.llm.common import kept_in_worker

#: Bounds of what a worker keeps; beyond them it computes anew what it did not keep.
MAX_STATES = 10_000
MAX_PIECES = 500_000
MAX_PAIRS = 150_000
DECODE_BLOCK = 2048


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def piece_pattern(pattern: str, last: int = 0xFFFF) -> re.Pattern:
    r"""A splitting pattern for ``re``: \p{L}, \p{N}, \s and \S become explicit ranges.

    White space is the Unicode property, which is not what ``re`` takes for ``\s``. ``last`` is
    the last code point that texts may hold; classes within 16 bits are table lookups.
    """
    points = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)

    def ranges(kind: str) -> str:
        return "".join(f"{re.escape(m.group()[0])}-{re.escape(m.group()[-1])}"
                       for m in regex.finditer(kind + "+", points))

    classes = {r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}"),
               r"\s": ranges(r"\p{White_Space}")}
    inside = False
    out, at = [], 0
    while at < len(pattern):
        part = next((p for p in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(p, at)),
                    None)
        if part == r"\S":
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif part:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        else:
            part = pattern[at]
            inside = part == "[" or inside and part != "]"
            out.append(part)
        at += len(part)
    return re.compile("".join(out))


class Transducer:
    """Encodes pieces of bytes; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.max_states = max_states
        self.longest = max(map(len, ranks), default=0)
        self.children: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                below = self.children.get(key)
                if below is None:
                    below = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = below
            self.token_at[node] = rank
        self.own: dict[int, tuple[bytes, bytes] | None] = {}
        self.pairs: dict[int, bool] = {}
        start = (((), -1, 0),)
        self.states = {start: 0}
        self.members = [start]
        self.ends: list[tuple[int, ...] | None] = [()]
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None for bytes and for tokens that merging
        never reaches."""
        if token not in self.own:
            data = self.bytes_of[token]
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i)
                               for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.own[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.own[token]

    def stands_alone(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def may_follow(self, before: int, token: int) -> bool:
        """Whether ``token`` can stand after ``before`` (-1: at the start of a piece).

        The merges of both tokens are undone, the latest first. At each point the parts next to
        the boundary must not merge with each other before they merge into their own token. Of
        equal ranks the merge further left comes first: the left token's own one, but the one
        over the boundary before the right token's.
        """
        if before < 0:
            return self.stands_alone(token)
        pair = before << 32 | token
        known = self.pairs.get(pair)
        if known is None:
            known = self.stands_alone(token) and not self._merges_over(before, token)
            if len(self.pairs) < MAX_PAIRS:
                self.pairs[pair] = known
        return known

    def _merges_over(self, left: int, right: int) -> bool:
        ranks, bytes_of = self.ranks, self.bytes_of
        limit = 1 << 60                     # a merge over the boundary below it comes first
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], 1 << 60) < limit:
                return True
            parts_left, parts_right = (None if len(bytes_of[t]) == 1 else self.halves(t)
                                       for t in (left, right))
            if parts_left and (left > right or not parts_right):
                limit, left = left, ranks[parts_left[1]]
            elif parts_right:
                limit, right = right + 1, ranks[parts_right[0]]
            else:
                return False

    def _advance(self, paths: tuple, byte: int) -> list:
        """All live paths by one byte."""
        on, children, token_at = [], self.children, self.token_at
        for owed, before, node in paths:
            below = children.get(node << 8 | byte)
            if below is not None:
                on.append((owed, before, below))
                token = token_at[below]
                if token >= 0 and self.may_follow(before, token):
                    on.append((owed + (token,), token, 0))
        return on

    @staticmethod
    def _settle(paths: list) -> tuple[tuple[int, ...], tuple]:
        """What all paths owe, and the paths without it."""
        first, shared = paths[0][0], 0
        shortest = min(len(path[0]) for path in paths)
        while shared < shortest and all(path[0][shared] == first[shared] for path in paths):
            shared += 1
        return first[:shared], tuple((owed[shared:], before, node)
                                     for owed, before, node in paths)

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """A deterministic step, computed when it is first needed."""
        emitted, key = self._settle(self._advance(self.members[state], byte))
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = len(self.members)
            self.members.append(key)
            self.ends.append(next((owed for owed, _, node in key if node == 0), None))
        self.steps[state << 8 | byte] = step = (target, emitted)
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of a piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, steps = 0, [], self.steps
        for byte in piece:
            step = steps.get(state << 8 | byte)
            if step is None:
                if len(self.members) >= self.max_states:
                    return self._follow(piece, out)
                step = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += self.ends[state]
        return out

    def _matches(self, piece: bytes, at: int) -> list[int]:
        """Tokens that begin at a byte of a piece, the longest last."""
        node, found, children, token_at = 0, [], self.children, self.token_at
        for byte in piece[at:at + self.longest]:
            node = children.get(node << 8 | byte)
            if node is None:
                break
            if token_at[node] >= 0:
                found.append(token_at[node])
        return found

    def _follow(self, piece: bytes, out: list[int]) -> list[int]:
        """A piece from the tokens that are certain on, by its paths, one after the other, long
        tokens first. One path alone leads to a byte, so a byte that none leads on from is met once.
        """
        size, bytes_of, pairs, certain = len(piece), self.bytes_of, self.pairs, len(out)
        at, before = sum([len(bytes_of[token]) for token in out]), out[-1] if out else -1
        open_, dead = [self._matches(piece, at)], set()
        while at < size:
            options = open_[-1]
            while options:
                token = options.pop()
                end = at + len(bytes_of[token])
                if end in dead:
                    continue
                follows = pairs.get(before << 32 | token)
                if follows or follows is None and self.may_follow(before, token):
                    out.append(token)
                    if end < size:
                        open_.append(self._matches(piece, end))
                    at, before = end, token
                    break
            else:
                if len(out) == certain:
                    raise ValueError("a byte is not in the vocabulary")
                dead.add(at)
                open_.pop()
                at -= len(bytes_of[out.pop()])
                before = out[-1] if out else -1
        return out


class Encoder:
    """Encodes whole texts: splits them into pieces and keeps the ids of pieces seen before."""

    def __init__(self, rank_file: str, pattern: str, max_pieces: int = MAX_PIECES,
                 max_states: int = MAX_STATES):
        self.transducer = Transducer(load_ranks(rank_file), max_states)
        self.split_16_bit = piece_pattern(pattern)
        # Explicit classes of all planes would take 90 MB to compile; few texts need them.
        self.split_any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(
            r"\S", r"\P{White_Space}"))
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(self.known) < self.max_pieces and len(piece) <= 64:
            self.known[piece] = ids         # early pieces are the frequent ones, and stay
        return ids

    def pieces(self, text: str) -> list[str]:
        narrow = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        return (self.split_16_bit if narrow else self.split_any).findall(text)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text; none for null and empty texts."""
        if not text:
            return np.zeros(0, np.int32)
        known, packed = self.known, self._packed
        return np.frombuffer(b"".join([
            known.get(piece) or packed(piece) for piece in self.pieces(text)]), np.int32)


# Well-formed UTF-8. First byte: how many follow and the range of the second.
def _lead(byte: int) -> tuple[int, int, int] | None:
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


REPLACEMENT = "�"


class StreamDecoder:
    """Ids to text, block by block; an unfinished character waits for the next block."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        size = max(bytes_of) + 1
        self.closed = np.zeros(size, bool)          # tokens that are whole characters
        self.text_of: list[str | None] = [None] * size
        for token, data in bytes_of.items():
            try:
                self.text_of[token] = data.decode()
                self.closed[token] = True
            except UnicodeDecodeError:
                pass
        self.steps: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.pending = b""

    @staticmethod
    def machine(pending: bytes, data: bytes) -> tuple[bytes, str]:
        """The byte machine: its state is the unfinished character, its output is text."""
        out = []
        for byte in data:
            if pending:
                need, low, high = _lead(pending[0])
                if len(pending) > 1:
                    low, high = 0x80, 0xBF
                if low <= byte <= high:
                    pending += bytes([byte])
                    if len(pending) == need + 1:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append(REPLACEMENT)
                pending = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif _lead(byte):
                pending = bytes([byte])
            else:
                out.append(REPLACEMENT)
        return pending, "".join(out)

    def feed(self, ids: np.ndarray) -> str:
        """The text that the ids finish."""
        if not self.pending and self.closed[ids].all():
            return "".join(map(self.text_of.__getitem__, ids.tolist()))
        out, pending, steps = [], self.pending, self.steps
        for token in ids.tolist():
            step = steps.get((pending, token))
            if step is None:
                step = steps[pending, token] = self.machine(pending, self.bytes_of[token])
            pending, text = step
            out.append(text)
        self.pending = pending
        return "".join(out)

    def close(self) -> str:
        """What is left at the end of a stream: an unfinished character is invalid."""
        left, self.pending = self.pending, b""
        return REPLACEMENT if left else ""

    def decode(self, ids: np.ndarray, block: int = DECODE_BLOCK) -> str:
        self.pending = b""
        return "".join([self.feed(ids[i:i + block])
                        for i in range(0, len(ids), block)]) + self.close()


def _encoder(rank_file: str, pattern: str) -> Encoder:
    def build() -> Encoder:
        encoder = Encoder(rank_file, pattern)
        gc.freeze()     # the vocabulary stays: no search for garbage needs to look at it
        return encoder

    return kept_in_worker(f"bpe_{hash((rank_file, pattern))}", build)


def _decoder(rank_file: str) -> StreamDecoder:
    return kept_in_worker(f"utf8_{hash(rank_file)}", lambda: StreamDecoder(
        {rank: token for token, rank in load_ranks(rank_file).items()}))


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in rows])])
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)),
        pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """Token ids of a text column; an empty array for null and empty texts."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(rank_file, pattern)
        for texts in batches:
            yield _id_lists([encoder.encode(text.as_py()) for text in texts])

    return encoded(text)


def decode(ids: Column, rank_file: str) -> Column:
    """Text of an id column; an empty text for null and empty arrays.

    Ids outside the vocabulary are an error, as they are for the tokenizer's own library.
    """

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _decoder(rank_file)
        for lists in batches:
            yield pa.array([decoder.decode(np.asarray(row.values, np.int32)) if row.is_valid
                            else "" for row in lists], pa.string())

    return decoded(ids)


def encode_decode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text",
                  ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the ids of every text and the text they decode to.

    Null and empty texts give no ids and an empty text. Rows pass through one by one, so
    repeated rows, null ids and other columns stay; the two columns replace any of their names.
    An empty table gives an empty table. Both steps are one function: one worker for each core,
    with one set of tables, where two functions in a row would take two workers.
    """
    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _encoder(rank_file, pattern), _decoder(rank_file)
        for texts in batches:
            rows = [encoder.encode(text.as_py()) for text in texts]
            decoded = pa.array([decoder.decode(ids) for ids in rows], pa.string())
            yield pa.StructArray.from_arrays([_id_lists(rows), decoded], ["ids", "decoded"])

    return df.withColumn("_coded", coded(F.col(text_col))).withColumns({
        ids_col: F.col("_coded.ids"), decoded_col: F.col("_coded.decoded")}).drop("_coded")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")

