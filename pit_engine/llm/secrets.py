"""Secret scanning: fixed patterns plus the novelty of strings in sensitive context.

The patterns give the base spans. The method adds strings that stand shortly
after a sensitive word and that a compressor cannot explain: each candidate's
marginal bytes are measured by zstandard primed with a dictionary of common
identifiers and the code around the candidate. A word of the language or a
name used nearby costs few bytes; random material costs nearly its entropy. A
long string is coded by the frequencies of its characters, so it's held against
the entropy of its own alphabet, and its pieces, too short for such a code,
against the bits of plain characters.

Defined cases
  null or empty text   no spans
  sensitive context    a candidate starts at most ``REACH`` characters after a sensitive word;
                       its surroundings are the ``AROUND`` characters on either side of it.
                       Both are part of the definition, at every size of text
  very long texts      scanned whole, in time that grows with the text
  repeated rows, ties  each row has its own result
  overlaps             an added span never overlaps a base span or another one
  null ids             kept as null
  empty table          no rows
  extra columns        not read
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate, islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Words after which a string may be a secret, and how far after.
SENSITIVE = re.compile(r"(?i:password|passwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization|auth[_ -]?key|client[_ -]?id|signing[_ -]?key)", re.ASCII)
SENSITIVE_PARTS = ("passw", "passph", "secret", "token", "key", "credential", "bearer", "authorization", "client")
REACH, LEAST = 48, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
START = re.compile(r"[A-Za-z0-9+/_.=-]{16}")
#: Text on either side of a candidate that primes the compressor, and the candidate's part that is measured.
AROUND = 2048
#: Least marginal bits for each character, and least kinds of characters (lower, upper, digit).
NOVEL_BITS, CLASSES = 6.5, 2
#: Characters of a piece of a long string, and the least share of its alphabet's entropy that the whole costs.
PIECE, OF_ENTROPY = 32, 0.85
#: Alphabets of common encodings, and the share of the letters in words from which a string is a name.
ALPHABETS = (re.compile(r"[0-9A-F]+|[0-9a-f]+"), 16), (re.compile(r"[A-Z2-7=]+|[a-z2-7=]+"), 32)
WORDS, NAME = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}"), 0.8

#: Identifiers that code and configuration use often; they prime the compressor.
IDENTIFIERS = (
    "password username user_name secret_key secret token access_token refresh_token api_key apikey client_id client_secret "
    "authorization bearer credentials private_key public_key certificate signature encryption environment configuration "
    "application production development staging localhost database connection timeout response request parameter "
    "required optional undefined null none true false string integer boolean default example placeholder changeme "
    "your_password your_token your_api_key_here insert_secret_here get_secret_value load_from_environment os.environ "
    "process.env config.get settings.py properties yaml json https http www.example.com function return import export const "
    "class public private static void self.assertEqual expected actual abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "xxxxxxxxxxxxxxxxxxxxxxxx ------------------------ ======================== ........................ ________________________"
)

SPANS = "doc_id bigint, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost non-overlapping for each kind."""
    out = []
    folded = text.lower()
    if any(w in folded for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Novelty:
    """Marginal compressed bits of a string against its surroundings and the identifier dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        import zstandard

        self._zstd, self._identifiers = zstandard, identifiers.encode()

    def bits(self, before: str, candidate: str, after: str) -> float:
        # The nearest surroundings come last: a raw dictionary's end is cheapest to refer to.
        data = self._identifiers + after.encode() + b"\n" + before.encode()
        primed = self._zstd.ZstdCompressor(level=9, dict_data=self._zstd.ZstdCompressionDict(data, dict_type=self._zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
        coded = candidate.encode()
        return 8 * (len(primed.compress(coded)) - len(primed.compress(b""))) / len(coded)


def _entropy(s: str) -> float:
    """Bits of a character drawn from the alphabet of the string."""
    size = next((n for p, n in ALPHABETS if p.fullmatch(s)), 0)
    classes = ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"))
    return math.log2(size or sum(n for n, p in classes if re.search(p, s)) + len(set(re.findall("[^A-Za-z0-9]", s))))


def _is_name(s: str) -> bool:
    """Whether most letters of a string stand in words."""
    return sum(map(len, WORDS.findall(s))) >= NAME * len(re.findall("[A-Za-z]", s))


def is_novel(before: str, s: str, after: str, novelty: Novelty) -> bool:
    """Whether a string can't be explained by its surroundings, at any length."""
    bits = novelty.bits(before, s, after)
    if bits >= NOVEL_BITS or len(s) <= PIECE:
        return bits >= NOVEL_BITS
    # With hardly a digit, a path or a sentence of names isn't random at this length.
    if bits < OF_ENTROPY * _entropy(s) or 20 * len(re.findall("[0-9]", s)) < len(s) and _is_name(s):
        return False
    pieces = [s[i : i + PIECE] for i in range(0, len(s), PIECE)]
    return sum(len(p) * novelty.bits(before, p, after) for p in pieces) >= NOVEL_BITS * len(s)


def added_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Spans of kind "novel": incompressible strings in sensitive context."""
    folded = text.lower()
    if not any(w in folded for w in SENSITIVE_PARTS):
        return []
    out: list[tuple[int, int, str]] = []
    seen = at = 0
    # No base span that starts later ends before one of these, so the sweep below passes each once.
    ends = list(accumulate((e for _, e, _ in base), max))
    for word in SENSITIVE.finditer(text):
        start = max(word.end(), seen)
        while start <= word.end() + REACH:
            # A candidate is searched for no further than it may start.
            first = START.search(text, start, min(len(text), word.end() + REACH + LEAST))
            if not first:
                break
            m = CANDIDATE.match(text, first.start())
            start = seen = m.end()
            while at < len(base) and ends[at] <= m.start():
                at += 1
            if any(s < m.end() and m.start() < e for s, e, _ in takewhile(lambda b: b[0] < m.end(), islice(base, at, None))):
                continue
            c = m.group()
            if sum(bool(re.search(p, c)) for p in ("[a-z]", "[A-Z]", "[0-9]")) < CLASSES:
                continue
            if not re.search("[0-9]", c) and _is_name(c):
                continue
            if is_novel(text[max(0, m.start() - AROUND) : m.start()], c, text[m.end() : m.end() + AROUND], novelty):
                out.append((m.start(), m.end(), "novel"))
    return out


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        bases, everything = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            more = added_spans(text, base, novelty)
            as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
            bases.append(as_rows(base))
            everything.append(as_rows(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span), pa.array(everything, span)], ["doc_id", "base", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: fixed-pattern spans, and all spans, by start and then kind.

    Starts and ends are code points, ends exclusive; an assignment's span covers
    the whole assignment.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner, SPANS)
