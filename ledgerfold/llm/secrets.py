"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens.

Everything is a DataFrame expression; texts never leave the JVM.

Three kinds of span are found by pattern: ``assign`` (a name such as password, a
sign and a value), ``access`` and ``hex``. Positions are running sums of the lengths
of matches and of what lies between them.

The method adds spans of kind ``random``. Candidates are runs of at least 16
letters, digits and ``+/_=-`` with a letter that overlap no pattern span. An
encoding is inferred from the characters of each (hex, base32, base36, base62 or
base64), and under it three tests ask how well the token agrees with uniform noise:
chi-squared uniformity of its alphabet, the number of runs above and below the
alphabet's middle, and its serial correlation. Fisher's method combines their three
p-values into one. Against it stands the p-value of the token as an ordinary one: the
likelihood ratio of models of ordinary words, capitals and numbers, by how
kinds of characters follow each other and how often letters are, to uniform noise,
which an ordinary token exceeds with at most that probability and which falls with
length. Where the battery speaks against noise, its p-value (as a share of
NOISE_LEVEL) takes that much of the second one's weight. The Benjamini-Hochberg step
over a document's candidates controls false discoveries; since a short token can't
reach a small p-value, it is only found if it stands among few.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
#: A run of 32 or more is the same as a maximal run that is kept if it has 32 or more.
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"

MIN_ASSIGN = 8
MIN_RANDOM = 16
#: Combined p-value of the battery below which a token loses weight, and level of false discoveries.
NOISE_LEVEL = 0.01
DISCOVERY_LEVEL = 1e-3
MASK = "[SECRET]"
#: Deviates count as no more than this.
FAR_OFF = 12.0
#: Members of a list that are folded at once; a fold copies what it has gathered.
FOLDED = 128
SPAN = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"

_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Pattern and alphabet of each encoding; the first that fits is taken, base64 if none does.
_ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9a-fA-F]+$", "0123456789abcdef"),
    ("^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("^[a-z2-7]+=*$", _LOWER + "234567"),
    ("^[A-Z0-9]+=*$", _UPPER + _DIGITS),
    ("^[a-z0-9]+=*$", _LOWER + _DIGITS),
    ("^[A-Za-z0-9]+=*$", _UPPER + _LOWER + _DIGITS),
)
_BASE64 = _UPPER + _LOWER + _DIGITS + "+/"
#: Probability of the kind (lower, upper, digit, other) of the first character, and of each next one after each kind.
_FIRST = (0.4, 0.3, 0.2, 0.1)
_ORDINARY = (
    ((0.90, 0.03, 0.02, 0.05), (0.76, 0.15, 0.04, 0.05), (0.08, 0.05, 0.67, 0.20), (0.55, 0.20, 0.15, 0.10)),
    ((0.70, 0.20, 0.05, 0.05), (0.02, 0.90, 0.03, 0.05), (0.03, 0.10, 0.67, 0.20), (0.15, 0.60, 0.15, 0.10)),
    ((0.70, 0.05, 0.15, 0.10), (0.20, 0.50, 0.20, 0.10), (0.07, 0.05, 0.73, 0.15), (0.10, 0.10, 0.60, 0.20)),
)
#: Percentages of the letters a to z in ordinary words of several languages, each raised by half of one.
_LETTERS = (8.5, 2.0, 3.7, 4.5, 14.0, 2.1, 2.3, 4.0, 8.0, 0.9, 1.4, 4.5, 3.1, 7.9, 6.7, 2.9, 1.0, 7.1, 6.8, 8.0, 4.0, 1.7, 1.7, 0.9, 1.7, 1.1)


def _running(values: Column, plus, zero: int = 0) -> Column:
    """What ``plus`` makes of all values before each one, for an associative ``plus``; in blocks, since a fold copies its list."""

    def before(v: Column, start: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(
            v,
            F.struct(start.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]

    def blocks_of(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(FOLDED)), lambda a: F.slice(v, a, FOLDED))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), lambda x, y: plus(x, y)))
        return F.flatten(F.zip_with(blocks, before(sums, F.lit(zero)), before))

    return _let(values, lambda v: _let(blocks_of(v), of_blocks))


def _spans(text: Column, pattern: str, kind: str, order: int, keep=None, group: int = 0) -> Column:
    """start, order, end, kind and value (what ``group`` matched) of all matches, leftmost first, without overlaps."""
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else matches
    # What lies before each match; the last piece, after them all, is left over.
    between = F.split(text, pattern, -1)
    cells = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))
    cells = F.transform(cells, lambda c: F.struct(F.length(c["gap"]).alias("gap"), F.length(c["match"]).alias("size"), c["value"].alias("value")))

    def placed(c: Column) -> Column:
        before = _running(F.transform(c, lambda x: x["gap"] + x["size"]), lambda x, y: x + y)
        return F.zip_with(
            c,
            before,
            lambda x, at: F.struct(
                (at + x["gap"]).alias("start"), F.lit(order).alias("order"), (at + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")
            ),
        ).cast(SPAN)

    walked = _let(cells, placed)
    if keep is not None:
        walked = F.filter(walked, keep)
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPAN))


def _outside(candidates: Column, base: Column) -> Column:
    """Candidates that overlap no span of ``base``; those of either list don't overlap among themselves but for kinds of ``base``."""

    def tell(both: Column) -> Column:
        is_base = lambda s: s["order"] < 3
        reached = _running(F.transform(both, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.greatest)
        far = (1 << 31) - 1
        next_start = F.reverse(_running(F.reverse(F.transform(both, lambda s: F.when(is_base(s), s["start"]).otherwise(far))), F.least, far))
        told = F.zip_with(F.zip_with(both, reached, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), next_start, lambda x, n: F.struct(x["s"].alias("s"), x["r"].alias("r"), n.alias("n")))
        free = F.filter(told, lambda x: (x["s"]["order"] == 3) & (x["r"] <= x["s"]["start"]) & (x["n"] >= x["s"]["end"]))
        return F.transform(free, lambda x: x["s"])

    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(_let(F.array_sort(F.concat(base, candidates)), tell))


def _let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbers(values, kind: str) -> Column:
    """An array of constants, made in one step."""
    return F.expr(f"cast(array({', '.join(map(repr, values))}) AS array<{kind}>)")


def _two_sided(z: Column) -> Column:
    """Probability that a normal deviate is as far from zero, by the usual polynomial of five terms; no less than at FAR_OFF."""
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def tail(x: Column) -> Column:
        # The terms times rising powers of 1 / (1 + 0.2316419 x), the highest first.
        powers = _let(1 / (1 + 0.2316419 * x), lambda t: F.aggregate(_numbers(reversed(terms), "double"), F.lit(0.0), lambda a, c: (a + c) * t))
        return F.least(F.lit(1.0), 2 / math.sqrt(2 * math.pi) * F.exp(-x * x / 2) * powers)

    return _let(F.least(F.abs(z), F.lit(FAR_OFF)), tail)


def _evidence(token: Column) -> Column:
    """p-value of a token against ordinary ones, raised by what the battery has against noise."""
    bare = F.regexp_replace(token, "=", "")
    alphabet = F.lit(_BASE64)
    for pattern, letters in reversed(_ENCODINGS):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    # '_' and '-' as in URL-safe base64, '=' as nothing.
    shown = F.when(bare.rlike("^[0-9a-fA-F]+$"), F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))

    def steps_of(v: Column) -> Column:
        return F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def chars_of(t: Column) -> Column:
        return F.filter(F.split(t, ""), lambda c: c != "")

    def noise(letters: Column) -> Column:
        k = F.length(letters).cast("double")

        def tests(v: Column) -> Column:
            """The battery's combined p-value."""
            m = F.size(v).cast("double")
            counts = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)).cast("double"))
            squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
            chi2, df = squares * k / m - m, k - 1
            spread = 2 / (9 * df)
            uniform = (F.pow(chi2 / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
            steps = steps_of(v)
            runs = F.aggregate(steps, F.lit(1.0), lambda a, s: a + F.when((s["x"] >= k / 2) != (s["y"] >= k / 2), 1.0).otherwise(0.0))

            def off(expected: Column) -> Column:
                variance = (expected - 1) * (expected - 2) / (m - 1)
                return _let(variance, lambda var: F.when(var > 0, (runs - expected) / F.sqrt(var)).otherwise(F.lit(FAR_OFF)))

            high = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x >= k / 2, 1.0).otherwise(0.0))
            runs_off = _let(_let(high, lambda h: 2 * h * (m - h) / m + 1), off)

            def correlation(mean: Column) -> Column:
                around = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
                along = F.aggregate(steps, F.lit(0.0), lambda a, s: a + (s["x"] - mean) * (s["y"] - mean))
                # Under noise its mean is -1 / m and its variance nearly 1 / m.
                return _let(around, lambda r: F.when(r > 0, (along / r + 1 / m) * F.sqrt(m)).otherwise(F.lit(FAR_OFF)))

            serial = _let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / m, correlation)
            half = F.aggregate(F.transform(F.array(uniform, runs_off, serial), _two_sided), F.lit(0.0), lambda a, p: a - F.log(p))
            # The upper tail of chi-squared with six degrees of freedom, at twice ``half``.
            return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

        # Index of each character in the alphabet, from 0.
        return _let(F.transform(chars_of(shown), lambda c: F.instr(letters, c).cast("double") - 1), tests)

    # By a character's place among lower case, upper case and digits, 0 for none of these: its kind, and bits within the kind.
    kinds = _numbers([3] + [0] * 26 + [1] * 26 + [2] * 10, "int")
    letter_bits = [-math.log2(x / sum(_LETTERS)) for x in _LETTERS]
    bits = _numbers([2.0, *letter_bits, *letter_bits, *[math.log2(10)] * 10], "double")

    def ordinary_bits(places: Column) -> Column:
        within = F.aggregate(places, F.lit(0.0), lambda a, x: a + F.element_at(bits, x))

        def of_kinds(v: Column) -> Column:
            def cost(model) -> Column:
                after = _numbers([-math.log2(p) for row in model for p in row], "double")
                return F.aggregate(steps_of(v), F.lit(0.0), lambda a, s: a + F.element_at(after, s["x"] * 4 + s["y"] + 1))

            return F.least(*map(cost, _ORDINARY)) + F.element_at(_numbers([-math.log2(p) for p in _FIRST], "double"), F.element_at(v, 1) + 1)

        return within + _let(F.transform(places, lambda x: F.element_at(kinds, x)), of_kinds)

    places = F.transform(chars_of(bare), lambda c: F.instr(F.lit(_LOWER + _UPPER + _DIGITS), c) + 1)

    def weighed(letters: Column) -> Column:
        gain = _let(places, ordinary_bits) - F.length(bare) * F.log2(F.length(letters).cast("double"))

        def evidence(p: Column) -> Column:
            """The battery can only raise p, so it is asked where p is small enough to matter."""
            return F.when(p > DISCOVERY_LEVEL, F.least(F.lit(1.0), p)).otherwise(p / F.least(F.lit(1.0), noise(letters) / NOISE_LEVEL))

        return _let(F.pow(F.lit(2.0), -gain), evidence)

    return F.when((F.length(bare) < MIN_RANDOM) | ~token.rlike("[A-Za-z]"), F.lit(1.0)).otherwise(_let(alphabet, weighed))


def _discoveries(candidates: Column) -> Column:
    """Candidates (with p) that the Benjamini-Hochberg step keeps."""

    def step(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda x: x["p"]))
        cut = F.array_max(
            F.transform(ranked, lambda p, i: F.when(p <= DISCOVERY_LEVEL * (i + 1) / F.size(found), p).otherwise(F.lit(-1.0)))
        )
        return _let(cut, lambda c: F.filter(found, lambda x: x["p"] <= c))

    return _let(candidates, step)


def _found(text: Column):
    """What the patterns match in a text, the method's candidates, and what picks from those of them that are free."""
    base = F.array_sort(
        F.concat(
            _spans(text, ASSIGN, "assign", 0, lambda s: F.length(s["value"]) >= MIN_ASSIGN, group=2),
            _spans(text, ACCESS, "access", 1),
            _spans(text, HEX, "hex", 2),
        )
    )
    candidates = _spans(text, CANDIDATE, "random", 3, lambda s: s["value"].rlike("[A-Za-z]"))

    def discovered(free: Column) -> Column:
        weighed = F.transform(free, lambda s: s.withField("p", _evidence(s["value"])))
        kept = F.transform(_discoveries(weighed), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "order", "end", "kind", "value")]))
        return F.when(F.size(free) > 0, F.coalesce(kept, F.array().cast(SPAN))).otherwise(F.array().cast(SPAN))

    return base, candidates, discovered


def find_secrets(docs: DataFrame, text: str = "text", base: str = "base", found: str = "found") -> DataFrame:
    """Adds columns ``base`` and ``found`` to every row: arrays of (start, order, end, kind, value) by start and kind.

    ``base`` has what the patterns match, ``found`` that and the method's spans.
    Positions are code points, ends exclusive. A null or empty text has no spans.
    Rows are independent, so repeated ones have the same spans; texts of any length
    are searched whole, in time that grows with length and matches in proportion.
    Candidates of one p-value are found or left together. All columns stay.
    """
    base_of, candidates, discovered = _found(F.coalesce(F.col(text), F.lit("")))
    df = docs.withColumn(base, base_of).withColumn(found, candidates)
    df = df.withColumn(found, _outside(F.col(found), F.col(base)))
    return df.withColumn(found, F.array_sort(F.concat(F.col(base), discovered(F.col(found)))))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256 and all spans for every row of ``docs`` (doc_id, text).

    What find_secrets() says of null, empty, long and repeated texts holds; further columns are ignored.
    """
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("found").alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The rows of ``docs`` with each secret's value replaced by ``mask``.

    Of an assignment only the value goes. Overlapping spans are replaced once.
    All columns and rows come back, null and empty texts as they are; ``n_chars``, if
    there is one, follows the text.
    """
    # Columns of docs may have any names.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = find_secrets(whole)
    values = F.array_sort(
        F.transform(
            "found",
            lambda s: F.struct(
                F.when(s["kind"] == "assign", s["end"] - F.length(s["value"])).otherwise(s["start"]).alias("start"), s["end"].alias("end")
            ),
        )
    )

    def masked(v: Column) -> Column:
        done = _running(F.transform(v, lambda s: s["end"]), F.greatest)
        pieces = F.zip_with(
            v,
            done,
            lambda s, at: F.when((s["end"] > at) & (s["start"] >= at), F.concat(F.substring(F.col("text"), at + 1, s["start"] - at), F.lit(mask))).otherwise(""),
        )
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.array_max(F.transform(v, lambda s: s["end"])) + 1, F.length("text")))

    some = F.size("found") > 0
    out = found.select("row", F.when(some, _let(values, masked)).otherwise(F.col("text")).alias("text"), some.alias("some"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("some"), F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])
