"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact verification.

The CGK random walk reads a sequence of words step by step and advances, or
stays, by a random bit for (step, word): sequences at a small edit distance
mostly read equal symbols at equal steps. A repetition of the LSH samples a few
steps; a window of a text is a candidate for an item if it reads the item's
symbols at all of them. The symbols of all items form a trie, and the walk goes
on only for the windows that are still on a path of it. Every word of a text
starts a window, and every few words of an item start an entry, so an edited
beginning doesn't hide an item. Walks are random and lose some copies, most of
short items, so a second search completes them: an item with at most e edits is
cut into e + 1 pieces, one of which stands unchanged in every copy within the
bound. Whoever reads a piece is a candidate too, so no item is missed at any
length. Candidates are verified by the exact edit distance over words (free
ends in the text).

The benchmark is dealt into blocks of bounded size; a block is what a task
holds, so neither the driver nor a broadcast grows with the documents.

Defined cases
  words                     lower-cased, split at white space, ASCII and typographic punctuation;
                            in scripts without spaces each character is a word
  null or empty text        no words, no hits
  very long texts           whole; windows are walked in blocks
  items under ``MIN_ITEM_WORDS`` words   searched for without edits
  items without words, null items        not searched for
  equal items               each has its hits
  equal distances           the first place in the text
  repeated rows, null ids   each row has its own hits
  empty tables              no rows
  extra columns             not read (hits), kept (filter)
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits over words that still are a leak, as a share of the item's words: a similarity of 0.8.
MAX_EDITS = 0.2
#: Shorter items allow no edits: one edit would make another sentence of them.
MIN_ITEM_WORDS = 8
#: LSH: steps of the walk that are sampled from, sampled steps, repetitions, words between entries of an item.
STEPS, SAMPLES, REPETITIONS, STRIDE = 20, 7, 7, 8
#: Words of text that are walked at once.
BLOCK_WORDS = 1 << 19
#: Bound on the characters of one block of the benchmark: about 32,000 items, 310 MB while its tries are built, 75 MB broadcast (measured).
BLOCK_CHARS = 4 * 1024 * 1024
SEED = 20240229

#: A character of a script without spaces (Thai, Lao, Burmese, Khmer, Chinese, Japanese), or white space and punctuation beyond ASCII.
_WIDE = re.compile(
    "([\u0e01-\u0e5b\u0e81-\u0edf\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u302f\u3031-\u303c\u3041-\u309f\u30a1-\u30fa\u30fc-\u312f"
    "\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])"
    "|[\u0085\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u200a\u2010-\u2029\u202f-\u205f\u3000-\u3004\u3008-\u3020\u3030\u303d-\u303f\u30a0\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]"
)
_TO_SPACE = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))

HITS = "doc_id bigint, item_id bigint, distance int, start_word int, end_word int"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between white space and punctuation, or characters of scripts without spaces, as UTF-8."""
    text = text or ""
    if not text.isascii():
        text = _WIDE.sub(r" \1 ", text)
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def edit_search(pattern: list[int], text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest stretch of ``text``, if its edit distance is at most ``most``.

    Bit-parallel dynamic programming over one machine-independent integer; the
    first best end is taken, and then the latest start that attains it.
    """

    def best_end(pattern: list[int], text: list[int], anchored: bool) -> tuple[int, int]:
        n = len(pattern)
        mask, top = (1 << n) - 1, 1 << (n - 1)
        eq: dict[int, int] = defaultdict(int)
        for i, x in enumerate(pattern):
            eq[x] |= 1 << i
        pv, mv, score = mask, 0, n
        best, at = n, 0
        for j, x in enumerate(text, 1):
            e = eq.get(x, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | anchored) & mask
            mh = mh << 1 & mask
            pv = mh | ~(xv | ph) & mask
            mv = ph & xv
            if score < best:
                best, at = score, j
        return best, at

    found, end = best_end(pattern, text.tolist(), False)
    if found > most or not end:
        return None
    back, length = best_end(pattern[::-1], text[:end][::-1].tolist(), True)
    return found, end - length, end


def _joined(columns: Iterable[np.ndarray]) -> np.ndarray:
    """One 64-bit key for the words of each row (candidates are verified, so equal keys of other words do no harm)."""
    key = np.uint64(0)
    for x in columns:
        key = (key ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


class Searcher:
    """Items, their vocabulary, the tries of all repetitions and the pieces."""

    def __init__(self, items: list[tuple[int, str | None]], max_edits: float = MAX_EDITS, repetitions: int = REPETITIONS, seed: int = SEED):
        self.max_edits = max_edits
        self.ids: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[list[int]] = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                # 0 is any word that no item has.
                self.items.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        rng = np.random.default_rng(seed)
        size = len(self.vocabulary) + 1
        self.size = size
        self.walks = []
        #: Words that a text needs to hold any item.
        self.least = min((len(words) - self.most(i) for i, words in enumerate(self.items)), default=0)
        entries = [(i, at) for i, words in enumerate(self.items) if len(words) >= MIN_ITEM_WORDS for at in range(0, max(1, len(words) - STEPS // 2), STRIDE)]
        for r in range(repetitions):
            advance = rng.integers(0, 2, (STEPS, size), dtype=np.int8)
            # The first two samples lie close together near the start, so that most windows leave the trie early.
            first = r % 3
            second = first + 1 + int(rng.integers(0, 2))
            rest = rng.choice(np.arange(second + 1, STEPS), SAMPLES - 2, replace=False)
            steps = sorted({first, second, *map(int, rest)})
            self.walks.append((advance, steps, *self._trie(entries, advance, steps)))
        self.pieces = self._pieces()

    def most(self, i: int) -> int:
        """Edits that item number i may have."""
        n = len(self.items[i])
        return int(self.max_edits * n) if n >= MIN_ITEM_WORDS else 0

    def _pieces(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length of piece: sorted keys, and the item and the place in it of each."""
        cut: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, words in enumerate(self.items):
            parts = self.most(i) + 1
            bounds = [len(words) * k // parts for k in range(parts + 1)]
            for at, end in pairwise(bounds):
                cut[end - at].append((i, at))
        out = {}
        for length, places in cut.items():
            words = np.array([self.items[i][at : at + length] for i, at in places], np.int32)
            keys = _joined(words[:, k] for k in range(length))
            order = np.argsort(keys, kind="stable")
            item, at = np.array(places, np.int64).T
            out[length] = keys[order], item[order], at[order]
        return out

    def piece_candidates(self, a: np.ndarray, edges: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, estimated start, item) wherever a text reads a piece of an item."""
        found: set[tuple[int, int, int]] = set()
        known = a[: int(edges[-1])] != 0
        for length, (keys, item, at) in self.pieces.items():
            n = len(known) - length + 1
            if n < 1:
                continue
            whole = known[:n].copy()
            for k in range(1, length):
                whole &= known[k : k + n]
            start = np.flatnonzero(whole)
            key = _joined(a[start + k] for k in range(length))
            lo = np.searchsorted(keys, key)
            on = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
            start, lo, hi = start[on], lo[on], np.searchsorted(keys, key[on], "right")
            text = np.searchsorted(edges, start, "right") - 1
            inside = start + length <= edges[text + 1]
            start, text, lo, count = start[inside], text[inside], lo[inside], (hi - lo)[inside]
            # Each place with each of the equal pieces.
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            which = np.repeat(lo, count) + nth
            found.update(zip(np.repeat(text, count).tolist(), (np.repeat(start, count) - at[which]).tolist(), item[which].tolist(), strict=True))
        return found

    def _trie(self, entries, advance: np.ndarray, steps: list[int]):
        """(first level by symbol, sorted keys and nodes of the later levels, entries by last node)."""
        levels: list[dict[int, int]] = [{} for _ in steps]
        ends: dict[int, list] = defaultdict(list)
        nodes = 1
        for i, at in entries:
            words, cur, node, depth = self.items[i], at, 0, 0
            for j in range(steps[-1] + 1):
                if cur >= len(words):
                    break
                if j == steps[depth]:
                    key = node * self.size + words[cur]
                    if key not in levels[depth]:
                        levels[depth][key] = nodes
                        nodes += 1
                    node = levels[depth][key]
                    depth += 1
                cur += int(advance[j, words[cur]])
            if depth == len(steps):
                ends[node].append((i, at))
        first = np.zeros(self.size, np.int64)
        for key, node in levels[0].items():
            first[key] = node
        later = []
        for level in levels[1:]:
            keys = np.array(sorted(level), np.int64)
            later.append((keys, np.array([level[int(k)] for k in keys], np.int64)))
        return first, later, ends

    def candidates(self, a: np.ndarray, edges: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, estimated start, item) for windows that start at any word of a (padded) block of texts."""
        found: set[tuple[int, int, int]] = set()
        n = int(edges[-1])
        every = np.arange(n, dtype=np.int32)
        for advance, steps, first, later, ends in self.walks:
            start = cur = every
            node = None
            depth = 0
            for j in range(steps[-1] + 1):
                symbol = a[cur] if j else a[:n]
                if j == steps[depth]:
                    if node is None:
                        node = first[symbol]
                        on = np.flatnonzero(node)
                        node = node[on]
                    else:
                        keys, nodes = later[depth - 1]
                        if not len(keys):
                            start = start[:0]
                            break
                        key = node * self.size + symbol
                        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        on = np.flatnonzero(keys[at] == key)
                        node = nodes[at[on]]
                    start, cur, symbol = start[on], cur[on], symbol[on]
                    if not len(start):
                        break
                    depth += 1
                    if depth == len(steps):
                        break
                cur = cur + advance[j][symbol]
            if len(start) and depth == len(steps):
                # The text is where the window starts; the item's estimated start may lie before the text.
                texts = np.searchsorted(edges, start, "right") - 1
                for t, s, x in zip(texts.tolist(), start.tolist(), node.tolist(), strict=True):
                    for i, at in ends[x]:
                        found.add((t, s - at, i))
        return found

    def search(self, texts: Iterable[list[bytes]]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, distance, start word, end word): the closest place of each pair."""
        if not self.items:
            return []
        get, out = self.vocabulary.get, []
        block: list[np.ndarray] = []
        numbers: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            lengths = np.array([len(x) for x in block])
            edges = np.concatenate([[0], np.cumsum(lengths)])
            a = np.concatenate([*block, np.zeros(STEPS, np.int32)])
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            done: set[tuple[int, int, int, int]] = set()
            for t, s, i in sorted(self.candidates(a, edges) | self.piece_candidates(a, edges)):
                pattern = self.items[i]
                most = self.most(i)
                # The item may start up to ``most`` words before or after its estimate.
                lo, hi = max(s - most, int(edges[t])), min(s + len(pattern) + most, int(edges[t + 1]))
                if hi - lo < len(pattern) - most or (t, i, lo, hi) in done:
                    continue
                done.add((t, i, lo, hi))
                region = a[lo:hi]
                # Each word of the item that the region lacks is an edit of its own.
                has = set(region.tolist())
                if sum(x in has for x in pattern) < len(pattern) - most:
                    continue
                hit = edit_search(pattern, region, most)
                if hit and ((t, i) not in best or hit[0] < best[t, i][0]):
                    best[t, i] = (hit[0], hit[1] + lo - int(edges[t]), hit[2] + lo - int(edges[t]))
            out.extend((numbers[t], i, *hit) for (t, i), hit in best.items())
            block.clear()
            numbers.clear()
            held = 0

        for k, words in enumerate(texts):
            if len(words) >= self.least:
                block.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
                numbers.append(k)
                held += len(words)
                if held >= BLOCK_WORDS:
                    flush()
        if block:
            flush()
        return out


def _blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // block_chars)
    for b in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document row, item) within the edit bound: the closest place and its distance."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Searcher(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits = searcher.search(words_of(t.as_py()) for t in batch.column(1))
                if hits:
                    k, i, distance, start, end = zip(*sorted(hits), strict=True)
                    columns = [pa.array([ids[x] for x in k], pa.int64()), pa.array([searcher.ids[x] for x in i], pa.int64()), *(pa.array(x, pa.int32()) for x in (distance, start, end))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "start_word", "end_word"])

        hits = rows.mapInArrow(run, HITS)
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], HITS) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Searcher(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = {h[0] for h in shared.value.search(words_of(t.as_py()) for t in batch.column(at))}
                yield batch.filter(pa.array([k not in leaks for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
