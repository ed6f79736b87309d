"""Cost-balanced packing of tokenized documents into fixed-length sequences.

Each task streams its documents, tokenizes them and packs them window by
window, so there is no shuffle and no state larger than one window. Inside a
window, pieces are taken in descending order and each goes to the sequence of
the lowest estimated cost (linear plus quadratic attention cost) among those
that still have room for it. When nothing has room for a whole piece it is cut.

Defined cases
  null or empty text     one token, the end-of-document id
  long documents         whole sequences are cut off as they come; the rest is
                         packed like any other piece
  repeated rows, ties    every row is packed on its own; equal pieces keep the
                         order in which they were read
  null ids               kept as null
  empty table            no rows
  extra columns          not read; only the id and the text are
  special strings        a text that spells a special token gets the token's id, as the
                         vocabulary's own tokenizer does by default; with
                         ``special_tokens={}`` such strings are ordinary text
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_TOKENS = 2048
#: Tokens that one window holds, about 1,000 sequences.
WINDOW_TOKENS = 2_000_000
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Entries of the per-worker cache from words to ids; it is emptied when full.
CACHE_WORDS = 300_000
END_ID = 1
#: Special tokens of the installed byte-level vocabulary (fixed values).
SPECIAL_TOKENS = {"<|endoftext|>": 50256}

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, ids binary"


class WordTokenizer:
    """Ids of a byte-level BPE vocabulary as little-endian 32-bit integers.

    The vocabulary's pre-tokenizer starts a token at each space that a visible
    character follows, so the ids of a text are the ids of its space-separated
    words one after another, and words can be looked up. Texts in which a word
    is empty or starts with white space are tokenized as a whole.
    """

    def __init__(self, ranks_path: str, pattern: str, special_tokens: dict[str, int]):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._encode = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}
        self._special = {text: token.to_bytes(4, "little") for text, token in special_tokens.items()}
        self._at_special = re.compile("(" + "|".join(map(re.escape, sorted(special_tokens, key=len, reverse=True))) + ")") if special_tokens else None

    def _bytes(self, text: str) -> bytes:
        from array import array

        return array("I", self._encode(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self._at_special and any(x in text for x in self._special):
            return b"".join(self._special.get(part) or self._ordinary(part) for part in self._at_special.split(text) if part)
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        words = text.split(" ")
        if len(words) == 1:
            return self._bytes(text)
        if any(not w or w[0].isspace() for w in words):
            return self._bytes(text)
        known, out = self._known, []
        if len(known) > CACHE_WORDS:
            known.clear()
        out.append(self._bytes(words[0]))
        for w in words[1:]:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self._bytes(" " + w)
            out.append(ids)
        return b"".join(out)


_tokenizers: dict[tuple, WordTokenizer] = {}


def tokenizer(ranks_path: str, pattern: str, special_tokens: dict[str, int] = SPECIAL_TOKENS) -> WordTokenizer:
    """One tokenizer for each Python worker, kept from task to task."""
    key = (ranks_path, pattern, *sorted(special_tokens.items()))
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(ranks_path, pattern, special_tokens)
    return _tokenizers[key]


class _Room:
    """Open sequences by remaining room, with the cheapest of any room range.

    A segment tree over the room 0..capacity; each leaf is a heap of
    (cost, sequence) and each inner node has the least of its leaves.
    """

    _NONE = (float("inf"), -1)

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.least = [self._NONE] * (2 * self.size)
        self.heaps: dict[int, list] = {}

    def _update(self, room: int) -> None:
        heap = self.heaps[room]
        i = room + self.size
        value = heap[0] if heap else self._NONE
        least = self.least
        least[i] = value
        i >>= 1
        while i:
            a, b = least[2 * i], least[2 * i + 1]
            v = a if a < b else b
            if least[i] == v:
                break
            least[i] = v
            i >>= 1

    def add(self, room: int, entry: tuple[float, int]) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), entry)
        self._update(room)

    def cheapest(self, needed: int) -> tuple[int, tuple[float, int]] | None:
        """Take the cheapest sequence with at least ``needed`` tokens of room."""
        lo, hi, least = needed + self.size, 2 * self.size, self.least
        best, at = self._NONE, 0
        while lo < hi:
            if lo & 1:
                if least[lo] < best:
                    best, at = least[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if least[hi] < best:
                    best, at = least[hi], hi
            lo >>= 1
            hi >>= 1
        return self._take(best, at) if best[1] >= 0 else None

    def widest(self) -> tuple[int, tuple[float, int]] | None:
        """Take the sequence with the most room."""
        if self.least[1][1] < 0:
            return None
        i = 1
        while i < self.size:
            i = 2 * i + 1 if self.least[2 * i + 1][1] >= 0 else 2 * i
        return self._take(self.least[i], i)

    def _take(self, best: tuple[float, int], at: int) -> tuple[int, tuple[float, int]]:
        while at < self.size:
            at = 2 * at if self.least[2 * at] == best else 2 * at + 1
        room = at - self.size
        heapq.heappop(self.heaps[room])
        self._update(room)
        return room, best


def cost(n: int) -> float:
    """Estimated training cost of attending within one piece of n tokens."""
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) for all tokens of ``lengths``.

    As many sequences are opened as the tokens fill; what is left over goes to
    sequences whose capacities are powers of two, so that no place is unused.
    """
    full, rest = divmod(sum(lengths), capacity)
    capacities = [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    rooms = _Room(capacity)
    for k, c in enumerate(capacities):
        rooms.add(c, (0.0, k))
    out = []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[piece]
        while left:
            room, (spent, k) = rooms.cheapest(left) or rooms.widest()
            n = min(left, room)
            out.append((piece, start, n, k, capacities[k] - room))
            if room > n:
                rooms.add(room - n, (spent + cost(n), k))
            start, left = start + n, left - n
    return out


def _packer(ranks_path: str, pattern: str, special_tokens: dict[str, int], capacity: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks_path, pattern, special_tokens).encode
        end = END_ID.to_bytes(4, "little")
        part = TaskContext.get().partitionId() << 33
        sequences = 0
        docs: list[tuple[int | None, int, int, bytes]] = []
        rows: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences, waiting
            placed = pack([len(d[3]) // 4 for d in docs], capacity)
            for i, start, n, k, offset in placed:
                doc_id, before, tokens, ids = docs[i]
                rows.append((doc_id, before + start, n, tokens, part + sequences + k, offset, ids[4 * start : 4 * (start + n)]))
            sequences += 1 + max((p[3] for p in placed), default=-1)
            waiting = 0
            docs.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = encode(texts[i].as_py() or "") + end
                tokens = len(ids) // 4
                whole = tokens - tokens % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, tokens, part + sequences, 0, ids[4 * start : 4 * (start + capacity)]))
                    sequences += 1
                if whole < tokens:
                    docs.append((doc_id, whole, tokens, ids[4 * whole :]))
                waiting += tokens
                if waiting >= window:
                    yield flush()
        if docs or rows:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    ranks_path: str | None = None,
    pattern: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    special_tokens: dict[str, int] = SPECIAL_TOKENS,
    capacity: int = SEQUENCE_TOKENS,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences.

    Columns: doc_id, start (tokens of the document before the piece), length,
    doc_tokens (with the end id), sequence_id, offset, and ids: the piece's
    token ids as little-endian unsigned 32-bit integers. ``ranks_path`` and
    ``pattern`` name the vocabulary; the installed public byte-level one if None.
    """
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(ranks_path, pattern, special_tokens, capacity, window_tokens), PIECES)
