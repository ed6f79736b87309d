"""Language identification with spans of mixed-language text.

Learning counts words by language on a bounded, hash-chosen sample of labelled
documents and turns them into hashed n-gram scores. For a text, the scripts of
a word narrow its candidate languages; per-word scores of the candidates go
through a Viterbi search with a penalty for each switch of language, and the
language with the most letters among the resulting spans is the document's.

Defined cases
  null text, no letters     ``und``, score 0
  letters of a script that no learned language uses
                            no evidence: the most frequent learned language, with
                            the score that its share of the training rows gives
  very long texts           whole; the search works on blocks of words with the
                            best predecessors kept
  equal scores              the language that sorts first
  no labelled row           every text is ``und``
  null ids                  kept; a row without an id is never held out
  repeated rows             each row has its own result
  extra columns             not read
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: The bound on labelled documents that scores are learned from, in expectation.
TRAIN_DOCS = 20_000
BUCKETS = 1 << 15
#: Cost of a switch of language, in nats of evidence.
SWITCH = 12.0
SMOOTHING = 0.5
#: Most evidence in nats that one word may give for a language against another.
WORD_LIMIT = 6.0
CACHE_WORDS = 300_000

WORD = re.compile(r"[^\W\d_]+")
#: Numbers that count as parts of a word but are no letters, such as fractions and circled digits.
_NO_LETTER = re.compile("[" + "".join(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "THAI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK")

PREDICTED = "doc_id bigint, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def script_of(word: str) -> str:
    """The script of a word's first letter, by its Unicode name."""
    c = word[0]
    if c < "ɐ":
        return "LATIN"
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "OTHER")


class _Grams(dict):
    """Letter n-gram -> hashed feature."""

    def __missing__(self, gram: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        bucket = self[gram] = zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS
        return bucket


_grams = _Grams()


def _buckets(word: str) -> list[int]:
    """Hashed features of a lower-case word: its letter n-grams of 3, ends marked."""
    framed = f"^{word}$"
    return [_grams[framed[i : i + 3]] for i in range(len(framed) - 2)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (lang, bucket) and, at bucket -1 - script, of words by script; -100: documents."""
    counts: Counter = Counter()
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, Counter()).update(_lettered(text.as_py() or "")[1])
            counts[lang, -100] += 1
        for lang, words in by_lang.items():
            for word, n in words.items():
                script = script_of(word)
                counts[lang, -1 - SCRIPTS.index(script) if script in SCRIPTS else -99] += n
                for b in _buckets(word):
                    counts[lang, b] += n
    langs, buckets = (list(x) for x in zip(*counts, strict=True)) if counts else ([], [])
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(buckets, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["lang", "bucket", "n"])


class Model:
    """Learned languages, their hashed log scores and the scripts that each uses."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        counts, docs = np.zeros((len(self.langs), BUCKETS)), np.zeros(len(self.langs))
        self.scripts: dict[str, np.ndarray] = {}
        for lang, b, n in rows:
            if b >= 0:
                counts[at[lang], b] += n
            elif b == -100:
                docs[at[lang]] += n
            else:
                name = "OTHER" if b == -99 else SCRIPTS[-1 - b]
                self.scripts.setdefault(name, np.zeros(len(self.langs)))[at[lang]] += n
        total = counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS
        scores = np.log((counts + SMOOTHING) / total)
        self.scores = (scores - scores.mean(0)).astype(np.float32) if self.langs else scores
        self.prior = docs / max(1.0, docs.sum())
        # A language uses a script if a ten-thousandth of its words are in it.
        letters = sum(self.scripts.values()) if self.scripts else docs
        self.allowed = {s: v > 1e-4 * letters for s, v in self.scripts.items()}
        self._known: dict[str, int] = {}
        self._table = np.zeros((0, len(self.langs)), np.float32)

    def _learn_words(self, words: list[str]) -> None:
        """Append the evidence of new words to the table."""
        buckets = [_buckets(w) for w in words]
        sizes = np.fromiter(map(len, buckets), np.int64, len(buckets))
        flat = np.fromiter((b for x in buckets for b in x), np.int64, int(sizes.sum()))
        got = np.add.reduceat(self.scores.T[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
        scripts = [script_of(w) for w in words]
        nothing = np.zeros(len(self.langs), bool)
        allowed = np.array([self.allowed.get(x, nothing) for x in scripts])
        got = np.where(allowed, got, -np.inf)
        best = got.max(1, keepdims=True)
        got = np.where(np.isfinite(best), np.maximum(got - np.where(np.isfinite(best), best, 0), -WORD_LIMIT), 0)
        start = len(self._known)
        self._known.update(zip(words, range(start, start + len(words)), strict=True))
        self._table = np.concatenate([self._table, got.astype(np.float32)])

    def evidence(self, words: list[str]) -> np.ndarray:
        """Evidence of each word for each language, relative to its best and bounded."""
        if len(self._known) > CACHE_WORDS:
            self._known, self._table = {}, self._table[:0]
        known = self._known
        new = list({w for w in words if w not in known})
        if new:
            self._learn_words(new)
        return self._table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def path(self, evidence: np.ndarray) -> np.ndarray:
        """The best language of each word: Viterbi with a constant cost of switching."""
        best = int(evidence.sum(0).argmax())
        n, k = evidence.shape
        if k == 1:
            return np.zeros(n, np.int64)
        rest = evidence[:, [j for j in range(k) if j != best]]
        run = np.concatenate([[0.0], np.cumsum(rest.max(1) - evidence[:, best], dtype=np.float64)])
        # No excursion from ``best`` gains more than the best sum of consecutive gains, and each costs a switch at least.
        if (run - np.minimum.accumulate(run)).max() <= SWITCH:
            return np.full(n, best)
        came, score = [], [0.0] * k
        for e in evidence.tolist():
            top = max(score)
            floor = top - SWITCH
            at = score.index(top)
            came.append([at if s < floor else j for j, s in enumerate(score)])
            score = [(s if s >= floor else floor) + x for s, x in zip(score, e, strict=True)]
        out = np.empty(n, np.int64)
        now = score.index(max(score))
        for t in range(n - 1, -1, -1):
            out[t] = now
            now = came[t][now]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) for each text; spans are code points with the language of their words."""
        words = [_lettered(t)[1] if t and self.langs else [] for t in texts]
        evidence = self.evidence([w for x in words for w in x])
        out, at = [], 0
        for text, own in zip(texts, words, strict=True):
            if not own:
                out.append((UNKNOWN, 0.0, []))
                continue
            e = evidence[at : at + len(own)]
            at += len(own)
            if not e.any():
                best = int(self.prior.argmax())
                out.append((self.langs[best], float(self.prior[best]), [(0, len(text), self.langs[best])]))
                continue
            path = self.path(e)
            cuts = np.flatnonzero(np.diff(path)) + 1
            if not len(cuts):
                out.append((self.langs[path[0]], 1.0, [(0, len(text), self.langs[path[0]])]))
                continue
            letters = np.fromiter(map(len, own), np.int64, len(own))
            share = np.bincount(path, letters, len(self.langs))
            best = int(share.argmax())
            starts = [m.start() for m in WORD.finditer(_lettered(text)[0])]
            edges = [0, *(starts[c] for c in cuts), len(text)]
            spans = [(a, b, self.langs[path[c]]) for a, b, c in zip(edges, edges[1:], [0, *cuts], strict=False)]
            out.append((self.langs[best], float(share[best] / letters.sum()), spans))
        return out


def _folded(text: str) -> str:
    """Lower case, but only where that keeps every position."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text


def _lettered(text: str) -> tuple[str, list[str]]:
    """The folded text and its words; numbers that look like letters to the pattern are blanks in both."""
    text = _folded(text)
    words = WORD.findall(text)
    if not all(map(str.isalpha, words)):
        text = _NO_LETTER.sub(" ", text)
        words = WORD.findall(text)
    return text, words


#: Characters of text that are worked on at once.
BLOCK_CHARS = 1_000_000


def _predictions(model: Model, texts: pa.Array) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    held, chars = [], 0
    for value in texts:
        text = value.as_py()
        held.append(text)
        chars += len(text or "")
        if chars >= BLOCK_CHARS:
            yield from model.predict(held)
            held, chars = [], 0
    yield from model.predict(held)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Scores from the labelled rows that are not held out, at most ``train_docs`` of them in expectation.

    Rows are chosen by the hash of their id, so the sample is the same whatever
    the partitions. What comes to the driver is one count for each (language,
    bucket): its size does not grow with the documents.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = labelled.count()
    if n > train_docs:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_docs / n))
    counts = labelled.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_counter, "lang string, bucket int, n bigint")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in rows.collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in that language's spans), spans."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            found = list(_predictions(model, batch.column(1)))
            spans = [[{"start": s, "end": e, "lang": x} for s, e, x in f[2]] for f in found]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PREDICTED)


#: A document stays in the corpus if at least this share of its letters is in its language.
KEEP_SCORE = 0.5


def keep_identified(docs: DataFrame, model: Model, least: float = KEEP_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least ``least`` of the letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = [lang != UNKNOWN and score >= least for lang, score, _ in _predictions(model, batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
