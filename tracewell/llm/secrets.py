"""Secret scans with DataFrame operations only: three patterns, and Shannon entropy in a sliding window.

Candidate strings are runs of characters that keys are made of. What the allow-list knows is cut out of them; a window of
fixed width slides over each piece that is left. Symbol counts change by the character that comes and the one that goes, and so do
the entropy and the window's character class. The windows over the threshold of their class mark a span of their piece, from the
first one's start to the last one's end. Of a span that meets patterns' spans, the parts of a window's length or more that none of
them covers stay.

Defined cases: a null text is an empty text; positions are code points, ends exclusive; repeated rows are scanned each;
an empty table gives an empty result. A very long text, string or list of matches takes time in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns. Letters of the first words are in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Symbols that a candidate is made of; a symbol's place is its count's index.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class EntropyParams:
    window: int = 20
    #: Bits in a window, by what it is made of: 0-9 a-f, letters and digits, any symbols.
    hex_bits: float = 3.05
    alnum_bits: float = 3.75
    other_bits: float = 3.85
    #: What is known to be harmless, as a pattern: identifiers of fixed form, sequences, and words that mark an example. A window that meets a match doesn't count; others of the same string do.
    allow: str = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|example|sample|dummy|placeholder|your[_-]|x{6}|0{8}|abcdefgh|12345678"


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(arr: Column, size: int) -> Column:
    """Numbers of the blocks of an array."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))


def _placed(text: Column, matches: Column, pattern: str) -> Column:
    """start, end and text of each match. The text between matches, from split() by the same pattern, gives the positions: running sums of lengths within blocks of matches, and over the blocks, so that no long array is copied for each match."""
    n = 64
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    both = F.zip_with(gaps, matches, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), m.alias("match")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    zero = F.lit(0).cast("bigint")

    def put(acc, x):
        s = acc["at"] + x["gap"]
        e = s + x["len"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["match"].alias("match")))).alias("out"))

    # Positions within each block, and the block's length.
    inside = _let(both, lambda xs: F.transform(_blocks(xs, n), lambda k: F.aggregate(F.slice(xs, k * n + 1, F.lit(n)), F.struct(zero.alias("at"), none.alias("out")), put)))

    def moved(inside):
        bases = F.aggregate(inside, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        return F.zip_with(inside, F.slice(bases, F.lit(1), F.size(inside)), lambda b, base: F.transform(b["out"], lambda x: F.struct((x["start"] + base).alias("start"), (x["end"] + base).alias("end"), x["match"].alias("match"))))

    return F.when(F.size(matches) > 0, F.flatten(_let(inside, moved))).otherwise(none)


def _as_spans(placed: Column, kind: int) -> Column:
    return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(SPAN)


#: Counts of twelve symbols, of five bits each, make a word; a window has fewer than 32 characters.
PER_WORD, BITS = 12, 5
WORDS = -(-len(SYMBOLS) // PER_WORD)
#: Entropy is summed up in whole numbers of this part of a bit, so that nothing drifts in long strings.
UNIT = 1 << 40


def most_sum(odd: Column, marks: Column, p: EntropyParams) -> Column:
    """The largest sum of k log k over a window's symbol counts, in UNITs, at which the window reaches its class's entropy. odd: characters but 0-9 a-f; marks: characters but letters and digits."""
    most = lambda bits: F.lit(math.floor((math.log2(p.window) - bits) * p.window * UNIT))
    return F.when(odd == 0, most(p.hex_bits)).when(marks == 0, most(p.alnum_bits)).otherwise(most(p.other_bits))


def _pieces(match: Column, start: Column, allow: str) -> Column:
    """start and match of what the allow-list leaves of a string."""
    known = _placed(match, F.regexp_extract_all(match, F.lit(allow), F.lit(0)), allow)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(known, lambda k: k["end"]))
    return F.zip_with(starts, F.split(match, allow, -1), lambda at, text: F.struct((start + at).alias("start"), text.alias("match")))


def window_span(string: Column, p: EntropyParams) -> Column:
    """struct(first, last): where the first window that reaches its class's entropy starts and where the last ends, from 0; nulls if there is none. The symbols' counts change by the character that comes and the one that goes."""
    w = p.window
    x_log_x = F.array(*[F.lit(round(k * math.log2(k) * UNIT) if k else 0).cast("long") for k in range(w + 2)])
    places = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    a, digit, mark_ = (SYMBOLS.index(c) for c in "a0+")
    hexes = lambda k: k.between(a, a + 5) | k.between(digit, digit + 9)
    chars = F.transform(places, lambda k: F.struct(
        F.floor(k / PER_WORD).cast("int").alias("word"), (k % PER_WORD * BITS).cast("int").alias("shift"), (~hexes(k)).cast("int").alias("odd"), (k >= mark_).cast("int").alias("marks"),
    ))
    none = F.struct(F.lit(-1).alias("word"), *[F.lit(0).alias(c) for c in ("shift", "odd", "marks")])
    # The character that goes when the one at i comes: none for the first w.
    steps = F.slice(F.zip_with(chars, F.concat(F.array_repeat(none, w), chars), lambda new, old: F.struct(new.alias("new"), old.alias("old"))), F.lit(1), F.size(chars))
    names = [f"c{k}" for k in range(WORDS)]
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in names], F.lit(0).cast("long").alias("sum"), *[F.lit(0).alias(c) for c in ("odd", "marks", "i")], F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    one = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s["shift"])

    def held(acc, s):
        word = F.lit(0).cast("long")
        for k, c in enumerate(names):
            word = F.when(s["word"] == k, acc[c]).otherwise(word)
        return F.call_function("shiftright", word, s["shift"]).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

    def step(acc, s):
        new, old = s["new"], s["old"]
        same = (new["word"] == old["word"]) & (new["shift"] == old["shift"])
        n_new, n_old = held(acc, new), held(acc, old)
        change = F.get(x_log_x, n_new + 1) - F.get(x_log_x, n_new) + F.when(old["word"] < 0, F.lit(0).cast("long")).otherwise(F.get(x_log_x, n_old - 1) - F.get(x_log_x, n_old))
        counts = [(acc[c] + F.when(new["word"] == k, one(new)).otherwise(F.lit(0).cast("long")) - F.when(old["word"] == k, one(old)).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(names)]
        return F.struct(*counts, (acc["sum"] + F.when(same, F.lit(0).cast("long")).otherwise(change)).alias("sum"), *[(acc[c] + new[c] - old[c]).alias(c) for c in ("odd", "marks")], (acc["i"] + 1).alias("i"), acc["first"].alias("first"), acc["last"].alias("last"))

    def mark(acc, s):
        # Two steps, so that the new sum is computed once.
        def marked(a):
            over = (a["i"] >= w) & (a["sum"] <= most_sum(a["odd"], a["marks"], p))
            kept = [a[c].alias(c) for c in [*names, "sum", "odd", "marks", "i"]]
            return F.struct(*kept, F.when(over, F.coalesce(a["first"], a["i"] - w)).otherwise(a["first"]).alias("first"), F.when(over, a["i"]).otherwise(a["last"]).alias("last"))

        return F.element_at(F.transform(F.array(step(acc, s)), marked), 1)

    return F.aggregate(steps, zero, mark, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _running_max(xs: Column) -> Column:
    """The largest value so far at each place of an array of longs: within blocks, then over the blocks."""
    n = 64
    low = F.array(F.lit(-1).cast("bigint"))
    longer = lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x)))
    inside = F.transform(_blocks(xs, n), lambda k: F.aggregate(F.slice(xs, k * n + 1, F.lit(n)), low, longer, lambda acc: F.slice(acc, F.lit(2), F.size(acc) - 1)))

    def raised(inside):
        before = F.aggregate(inside, low, lambda acc, b: longer(acc, F.element_at(b, -1)))
        return F.zip_with(inside, F.slice(before, F.lit(1), F.size(inside)), lambda b, top: F.transform(b, lambda x: F.greatest(x, top)))

    return F.flatten(_let(inside, raised))


def _uncovered(spans: DataFrame, least: int) -> DataFrame:
    """row, base, added: of `spans` (disjoint) the parts of at least so many characters that no span of base covers. One sweep over the starts of both: up to the next start, a part lies between the furthest end of base so far and that of spans."""
    none = F.array().cast(SPAN)
    both = spans.select("row", "base", F.when(F.size("spans") > 0, F.sort_array(F.concat("base", "spans"))).otherwise(none).alias("both"))
    ends = lambda own: F.transform("both", lambda e: F.when((e["kind"] == 3) == F.lit(own), e["end"]).otherwise(F.lit(-1).cast("bigint")))
    starts = F.transform("both", lambda e: e["start"])
    nexts = F.concat(F.slice(starts, F.lit(2), F.size("both")), F.array(F.lit((1 << 62)).cast("bigint")))
    swept = both.select("row", "base", ends(True).alias("own"), ends(False).alias("covered"), starts.alias("starts"), nexts.alias("nexts"))
    reach = swept.select("row", "base", "starts", "nexts", _running_max(F.col("covered")).alias("covered"), _running_max(F.col("own")).alias("own"))
    first = F.zip_with("starts", "covered", lambda s, c: F.greatest(s, c))
    last = F.zip_with(F.slice("nexts", F.lit(1), F.size("starts")), "own", lambda s, e: F.least(s, e))
    parts = F.zip_with(first, last, lambda s, e: F.struct(s.alias("start"), F.lit(3).alias("kind"), e.alias("end")))
    return reach.select("row", "base", F.filter(parts, lambda x: x["end"] - x["start"] >= least).cast(SPAN).alias("added"))


def find_secrets(docs: DataFrame, p: EntropyParams = EntropyParams()) -> DataFrame:
    """docs' columns as `row`, base (spans of the patterns) and added (spans of the entropy method): arrays of start, kind (index in KINDS), end, sorted."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    found = rows.select(
        "row", "t", F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(0)).alias("assign"), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)).alias("access"),
        F.regexp_extract_all("t", F.lit(HEX), F.lit(0)).alias("hex"), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("candidate"),
    )
    long_enough = lambda x: F.char_length(F.regexp_extract(x["match"], "^" + ASSIGN, 2)) >= 6
    placed = found.select(
        "row", F.filter(_placed(F.col("t"), F.col("assign"), ASSIGN), long_enough).alias("assign"), _placed(F.col("t"), F.col("access"), ACCESS).alias("access"),
        _placed(F.col("t"), F.col("hex"), HEX).alias("hex"), _placed(F.col("t"), F.col("candidate"), CANDIDATE).alias("candidate"),
    )
    base = placed.select("row", F.sort_array(F.concat(_as_spans(F.col("assign"), 0), _as_spans(F.col("access"), 1), _as_spans(F.col("hex"), 2))).alias("base"), "candidate")
    # Strings that the allow-list knows nothing in stay whole.
    cut = F.flatten(F.transform("candidate", lambda x: F.when(x["match"].rlike(p.allow), _pieces(x["match"], x["start"], p.allow)).otherwise(F.array(F.struct(x["start"].alias("start"), x["match"].alias("match"))))))
    left = base.select("row", "base", F.filter(cut, lambda x: F.length(x["match"]) >= p.window).alias("pieces"))
    spans = F.transform("pieces", lambda x: F.struct(x["start"].alias("start"), window_span(x["match"], p).alias("at")))
    spans = F.transform(F.filter(spans, lambda x: x["at"]["first"].isNotNull()), lambda x: F.struct((x["start"] + x["at"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["at"]["last"]).alias("end")))
    marked = left.select("row", "base", F.when(F.size("pieces") > 0, spans.cast(SPAN)).otherwise(F.array().cast(SPAN)).alias("spans"))
    return _uncovered(marked, p.window)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )
