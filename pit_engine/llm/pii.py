"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns give the base spans, which always stay. Looser patterns and the
matches that the fixed patterns drop are further candidates. Labelers vote on
each candidate (+1, 0, -1): its strict format, its structure (Luhn sum, lengths,
ranges), gazetteers (domains, card prefixes, calling codes, reserved nets), the
words around it, and what adjoins it. Expectation-maximisation estimates each
labeler's reliability per kind from the counts of vote patterns, and its
posteriors train the final classifier: log-odds of the votes, of the shape of
the candidate and of the word before it. Candidates that it accepts are added.

There are at most 3^5 vote patterns and ``FEATURES`` features for each of the
four kinds, so what the model is fit on is bounded whatever the corpus is; its
counts cover all documents.

Defined cases
  null or empty text   no spans
  very long texts      scanned whole; patterns start only where a run starts, places
                       and overlaps come from sweeps in blocks, so the time grows
                       with the text
  repeated rows        each row has its own result
  overlaps             base spans of different kinds may overlap; an added span
                       never overlaps another span; of overlapping candidates the one
                       that starts first is added, then the one of the first kind
  ties                 a candidate with even odds is not added
  null ids             kept as null
  empty table          no rows
  extra columns        not read
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pit_engine.llm.store import materialize

KINDS = ("email", "ip", "card", "phone")

# A run of the first class is tried once, from its start or from where the last match ended.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
_DIGITS = r"(?<![0-9])[0-9]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _DIGITS + r"\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: A text is searched for a kind only if it has the kind's sign (a necessary condition).
SIGN = {"email": r"@|at[\])}]", "ip": r"[0-9]\[?\.", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9][\x20().0-9-]"}

#: Gazetteers (fixed values).
DOMAINS = r"(?i)[.\]})\x20](?:com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|pl|se|no|dk|fi|pt|br|mx|ar|jp|cn|in|au|ru)$"
RESERVED = r"^(?:0|10|127|169|192|198|203|224|239|240|255)\b"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35)"
CALLING = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})"
#: Words near a span that speak for its kind, and words that speak against any kind.
CUES = {
    "email": r"mail|contact|write|reach|address|correo|adresse|kontakt|courriel",
    "ip": r"\bip\b|host|server|addr|client|login|connect|dns|gateway",
    "card": r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|cell|contact|ring|dial|telefon|llam|appel",
}
AGAINST = r"version|invoice|order|isbn|serial|issue|chapter|page|figure|table|section|doi|release|build|\bv\.?$|#\s*$"
REACH = 40

LABELERS = 5
ITERATIONS = 20
SMOOTHING = 1.0
#: Pseudo-count of votes for a class within it.
AGREE = 3.0
#: Buckets of shapes and of words before, and features of a kind: 3 for each labeler, then the buckets.
BUCKETS = 64
FEATURES = 3 * LABELERS + 2 * BUCKETS


#: Values of a sweep that are gathered before they are put to those of the blocks before them.
SWEEP_BLOCK = 256
#: Characters of a piece of text in which the surroundings of a span are looked up.
PIECE = 1024


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an array-valued expression, for arrays that it refers to several times and that shall be computed once."""
    return F.flatten(F.transform(F.array(value), use))


def _sweep(values: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """All outputs of a fold over an array: ``step`` gives the next state and an output of type ``kind``.

    An array that grows by one value copies all that it holds, so outputs are
    gathered in blocks and the blocks are put together.
    """
    def blocks_of(values: Column) -> Column:
        last = F.ceil(F.size(values) / SWEEP_BLOCK).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(values, i * SWEEP_BLOCK + 1, F.lit(SWEEP_BLOCK)))
        return F.when(last >= 0, blocks).otherwise(F.array_repeat(values, 0))

    def in_block(state: Column, value: Column) -> Column:
        after, out = step(state["at"], value)
        return F.struct(after.alias("at"), F.concat(state["out"], F.array(out)).alias("out"))

    def over_blocks(state: Column, block: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), F.expr(f"CAST(array() AS array<{kind}>)").alias("out"))
        return F.aggregate(block, begin, in_block, lambda inner: F.struct(inner["at"].alias("at"), F.concat(state["out"], F.array(inner["out"])).alias("out")))

    begin = F.struct(start.alias("at"), F.expr(f"CAST(array() AS array<array<{kind}>>)").alias("out"))
    return F.aggregate(_once(values, blocks_of), begin, over_blocks, lambda state: F.flatten(state["out"]))


def _matches(text: Column, pattern: str) -> Column:
    """All matches as structs (start, end, s): code points, from the lengths of the pieces between matches."""
    pieces = F.split(text, pattern, -1)

    def placed(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda piece, s: F.length(piece) + F.length(s))
        ends = _sweep(lengths, F.lit(0), lambda at, n: (at + n, at + n), "int")
        return F.zip_with(ends, hits, lambda end, s: F.struct((end - F.length(s)).alias("start"), end.alias("end"), s.alias("s")))

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _surrounded(hits: Column, pieces: Column) -> Column:
    """Matches with ``before`` and ``after``: the ``REACH`` characters before and half as many after each, in lower case.

    A place deep in a text is found by counting through all that stands before
    it, so it is counted in the text's pieces.
    """

    def part(start: Column, n: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        near = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
        return F.lower(F.substring(near, start - first * PIECE + 1, n))

    def with_context(m: Column) -> Column:
        before = part(F.greatest(m["start"] - REACH, F.lit(0)), F.least(m["start"], F.lit(REACH)))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["s"].alias("s"), before.alias("before"), part(m["end"], F.lit(REACH // 2)).alias("after"))

    return F.transform(hits, with_context)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(s: Column) -> Column:
    """Every dotted part is at most 255, however many zeros it starts with."""
    return F.forall(F.split(s, r"\.", -1), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))


def is_base(kind: str, s: Column) -> Column:
    """Whether a match of the kind's base pattern stands."""
    if kind == "ip":
        return _small_parts(s)
    if kind == "card":
        n = F.length(_digits(s))
        return F.when(n.between(16, 19), _luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _sign(value: Column) -> Column:
    """+1 where true, -1 where false."""
    return F.when(value, 1).otherwise(-1)


def _votes(kind: str, m: Column, strict: Column) -> Column:
    """The labelers' votes on one candidate, each 0, 1 or 2 for -1, 0, +1."""
    s, n, before, after = m["s"], F.length(_digits(m["s"])), m["before"], m["after"]
    structure = {
        "email": _sign((F.length(s) <= 254) & ~s.contains("..") & ~s.startswith(".")),
        "ip": _sign(_small_parts(F.regexp_replace(s, r"[\[\]]", "")) & ~s.rlike(r"(?:^|\.)0[0-9]")),
        "card": F.when(n.between(13, 19), _sign(_luhn(_digits(s)))).otherwise(-1),
        "phone": _sign(n.between(8, 15) & ~s.rlike(r"^\+?(.)\1+$")),
    }[kind]
    gazetteer = {
        "email": F.when(s.rlike(DOMAINS), 1).otherwise(0),
        "ip": F.when(s.rlike(RESERVED), -1).otherwise(0),
        "card": _sign(_digits(s).rlike(CARD_PREFIX)),
        "phone": F.when(s.rlike(CALLING), 1).otherwise(0),
    }[kind]
    context = F.when(before.rlike(AGAINST), -1).when(before.rlike(CUES[kind]) | after.rlike(CUES[kind]), 1).otherwise(0)
    adjoins = _sign(~(before.rlike(r"[\p{L}0-9_/=]$") | after.rlike(r"^[\p{L}0-9_/=]")))
    return F.array(*(v.cast("int") + 1 for v in (strict, structure, gazetteer, context, adjoins)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: every candidate span with its kind, base flag, votes and features."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("pieces", _pieces(F.col("text")))
    text, pieces = F.col("text"), F.col("pieces")
    none = F.expr("CAST(array() AS array<struct<kind:int,start:int,end:int,base:boolean,loose:boolean,votes:array<int>,features:array<int>>>)")
    parts = []
    for k, kind in enumerate(KINDS):

        def judged(m: Column, loose: bool, k: int = k, kind: str = kind) -> Column:
            base = F.lit(False) if loose else is_base(kind, m["s"])
            votes = _votes(kind, m, F.lit(0) if loose else _sign(base))
            shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m["s"], r"[0-9]", "9"), r"[a-z]+", "a"), r"[A-Z]+", "A")
            word = F.regexp_extract(m["before"], r"([\p{L}]+)[^\p{L}]*$", 1)
            bucket = lambda x, first: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int") + first
            by_vote = [F.get(votes, F.lit(j)) + 3 * j for j in range(LABELERS)]
            features = F.array(*by_vote, bucket(shape, 3 * LABELERS), bucket(word, 3 * LABELERS + BUCKETS))
            return F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), F.lit(loose).alias("loose"), votes.alias("votes"), features.alias("features"))

        hits = _matches(text, BASE[kind])
        if kind == "card":
            hits = F.filter(hits, lambda m: F.length(m["s"]) >= 13)
        found = F.transform(_surrounded(hits, pieces), _one(judged, False))
        if kind in LOOSE:
            found = F.concat(found, F.transform(_surrounded(_matches(text, LOOSE[kind]), pieces), _one(judged, True)))
        parts.append(F.when(text.rlike(SIGN[kind]), found).otherwise(none))
    return rows.select("doc_id", F.concat(*parts).alias("found"))


def _one(judged, loose: bool):
    """A one-argument function, which is what a lambda over an array has to be."""
    return lambda m: judged(m, loose)


def label_model(found: DataFrame) -> DataFrame:
    """kind, posteriors (votes, q), reliability: the EM estimate from the counts of vote patterns.

    q is the probability that a candidate with these votes is personal data;
    reliability[3 * j + v] is the log-odds that vote v of labeler j gives.
    """
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").cast("double").alias("n"))
    groups = each.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    ups = lambda v: F.size(F.filter(v, lambda x: x == 2)).cast("double")
    downs = lambda v: F.size(F.filter(v, lambda x: x == 0)).cast("double")
    # The start and the pseudo-counts say which class is which: votes for a class are likelier in it.
    start = F.transform("p", lambda p: 1.0 / (1.0 + F.exp(-2.0 * (ups(p["votes"]) - downs(p["votes"])))))

    def odds(q: Column) -> Column:
        """Log-odds of each (labeler, vote), then of the class itself."""
        pairs = F.arrays_zip(F.col("p").alias("p"), q.alias("q"))
        mass = lambda side: total(F.transform(pairs, lambda z: z["p"]["n"] * (z["q"] if side else 1.0 - z["q"])))
        at = lambda i, side: total(F.transform(pairs, lambda z: F.when(F.get(z["p"]["votes"], F.floor(i / 3).cast("int")) == i % 3, z["p"]["n"] * (z["q"] if side else 1.0 - z["q"])).otherwise(0.0)))
        agrees = lambda i, side: F.when(i % 3 == (2 if side else 0), AGREE).when(i % 3 == 1, SMOOTHING).otherwise(SMOOTHING / AGREE)
        rate = lambda i, side: (at(i, side) + agrees(i, side)) / (mass(side) + AGREE + SMOOTHING + SMOOTHING / AGREE)
        each = F.transform(F.sequence(F.lit(0), F.lit(3 * LABELERS - 1)), lambda i: F.ln(rate(i, True)) - F.ln(rate(i, False)))
        return F.concat(each, F.array(F.ln(mass(True) + SMOOTHING) - F.ln(mass(False) + SMOOTHING)))

    def posterior(w: Column) -> Column:
        score = lambda p: total(F.transform(p["votes"], lambda v, j: F.get(w, 3 * j + v))) + F.get(w, F.lit(3 * LABELERS))
        return F.transform("p", lambda p: 1.0 / (1.0 + F.exp(-score(p))))

    # The state holds q; each step goes through an array of one weight vector so that it is computed once.
    step = lambda q, _: F.flatten(F.transform(F.array(odds(q)), posterior))
    q = F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, step)
    fitted = groups.select("kind", "p", q.alias("q"))
    zipped = F.transform(F.arrays_zip("p", "q"), lambda z: F.struct(z["p"]["votes"].alias("votes"), z["q"].alias("q")))
    return fitted.select("kind", zipped.alias("posteriors"), odds(F.col("q")).alias("reliability"))


def span_classifier(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, weights: log-odds by kind * (FEATURES + 1) + feature; the last of a kind is its prior."""
    post = labels.select("kind", F.explode("posteriors").alias("x")).select("kind", F.col("x.votes").alias("votes"), F.col("x.q").alias("q"))
    seen = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    # Bounded: 3^5 patterns for each of four kinds.
    scored = seen.join(F.broadcast(post), ["kind", "votes"])
    features = F.explode(F.concat("features", F.array(F.lit(FEATURES)))).alias("f")
    sums = scored.select("kind", features, (F.col("n") * F.col("q")).alias("up"), (F.col("n") * (1.0 - F.col("q"))).alias("down")).groupBy("kind", "f").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    prior = sums.where(F.col("f") == FEATURES).select("kind", F.col("up").alias("all_up"), F.col("down").alias("all_down"))
    rate = lambda x, whole: (F.col(x) + SMOOTHING) / (F.col(whole) + BUCKETS * SMOOTHING)
    weight = F.when(F.col("f") == FEATURES, F.ln(F.col("up") + SMOOTHING) - F.ln(F.col("down") + SMOOTHING)).otherwise(F.ln(rate("up", "all_up")) - F.ln(rate("down", "all_down")))
    weights = sums.join(F.broadcast(prior), "kind").select((F.col("kind") * (FEATURES + 1) + F.col("f")).alias("i"), weight.alias("w"))
    table = F.map_from_entries(F.collect_list(F.struct("i", "w")))
    return weights.agg(table.alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) * (FEATURES + 1) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("weights"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: base spans and all spans (kind, start, end), by kind and then start.

    Kinds are names; starts and ends are code points, ends exclusive.
    """
    found = materialize(candidates(docs, id_col, text_col), "candidates")
    weights = span_classifier(found, label_model(found)).scalar()
    rows = found.select("doc_id", "found", F.when(F.size("found") > 0, weights).alias("weights"))
    base = F.filter("found", lambda c: c["base"])

    def accepted(c: Column) -> Column:
        first = c["kind"] * (FEATURES + 1)
        score = F.aggregate(c["features"], F.get("weights", first + FEATURES), lambda a, f: a + F.get("weights", first + f))
        return ~c["base"] & (score > 0)

    placed = lambda xs, added: F.transform(xs, lambda c: F.struct(c["start"], F.lit(added).alias("added"), c["kind"], c["end"]))
    rows = rows.withColumn("stands", base).withColumn("more", F.filter("found", accepted))
    rows = rows.withColumn("placed", F.sort_array(F.concat(placed("stands", False), placed("more", True))))
    # For each span the start of the next base span, swept from the end.
    after = F.reverse(_sweep(F.reverse("placed"), F.lit(2**31 - 1), lambda at, x: (F.when(x["added"], at).otherwise(x["start"]), at), "int"))
    pairs = F.zip_with("placed", after, lambda x, n: F.struct(x["start"].alias("start"), x["end"].alias("end"), (~x["added"]).alias("base"), n.alias("next")))
    rows = rows.withColumn("pairs", F.when(F.size("more") > 0, pairs))

    def stays(until: Column, x: Column) -> tuple[Column, Column]:
        keep = x["base"] | (x["start"] >= until) & (x["next"] >= x["end"])
        return F.when(keep, F.greatest(until, x["end"])).otherwise(until), keep

    kept = F.zip_with("placed", _sweep(F.col("pairs"), F.lit(0), stays, "boolean"), lambda x, keep: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), keep.alias("keep")))
    spans = F.when(F.size("more") > 0, F.filter(kept, lambda x: x["keep"])).otherwise(F.transform("stands", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(True).alias("keep"))))
    names = F.array(*(F.lit(k) for k in KINDS))
    named = lambda spans: F.transform(F.sort_array(spans), lambda c: F.struct(F.get(names, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    plain = F.transform("stands", lambda c: F.struct(c["kind"], c["start"], c["end"]))
    return rows.select("doc_id", named(plain).alias("base"), named(spans).alias("spans"))
