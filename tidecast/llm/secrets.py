"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens.

Column functions only. A candidate is a run of characters of a key alphabet. Its encoding (hex, base32
or base36 in one case, or base64) is read off the characters it holds. Three tests ask whether it looks
random in that encoding: chi-squared uniformity of the alphabet, the number of runs of character classes, and the lag-1 serial
correlation of the character values. A random key passes all three. A fourth figure bounds how likely
ordinary text would hold as many characters that are not lower case letters; in base36 and small base32, where
keys hold few such characters, it is the likelihood ratio of text letters against the encoding. It shrinks
with the length, and per length class the Benjamini-Hochberg rule over all candidates says how small it must be.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import stored

# The base patterns and the least lengths of what they find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
LENGTH_CLASSES = (32, 64, 128)
DIGITS = 0.2  # digits among the characters of ordinary long tokens that are not small letters
SINGLE = "^([0-9a-z]+|[0-9A-Z]+)$"  # base36, and base32 in small letters
# Shares of a to z among the letters of English text, in ten-thousandths.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7,
)))
STEPS = 400  # classes of the logarithm of the text bound, a tenth each


def let(value: Column, use) -> Column:
    """Bind a value that an expression needs more than once, so that it is computed once."""
    return F.transform(F.array(value), use)[0]


NONE = "array<struct<start:int,end:int,kind:string,value:string>>"


def places(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """Matches in text order: array of (start, end, kind, value), code points from 0, end exclusive.

    Matches and the gaps between them alternate, so running lengths give the places. Texts without a match,
    by far the most, are scanned once.
    """
    none = F.array().cast(NONE)

    def folded(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        value = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        steps = F.transform(
            F.arrays_zip(gaps.alias("gap"), found.alias("whole"), value.alias("value")),
            lambda m: F.struct(m["gap"].alias("gap"), F.length(m["whole"]).alias("size"), m["value"].alias("value")),
        )
        return F.aggregate(
            F.filter(steps, lambda m: m["size"].isNotNull()),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda so_far, m: F.struct(
                (so_far["at"] + m["gap"] + m["size"]).alias("at"),
                F.concat(so_far["out"], F.array(F.struct(
                    (so_far["at"] + m["gap"]).alias("start"),
                    (so_far["at"] + m["gap"] + m["size"]).alias("end"),
                    F.lit(kind).alias("kind"),
                    m["value"].alias("value"),
                ))).alias("out"),
            ),
            lambda done: done["out"],
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, folded(f)).otherwise(none))


KINDS = ("assign", "access", "hex", "random")


def ordered(spans: Column) -> Column:
    """By start, then by kind as listed."""
    ranked = F.transform(spans, lambda m: F.struct(
        m["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]).alias("rank"),
        m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value"),
    ))
    return F.transform(F.array_sort(ranked), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value"),
    ))


def base_places(text: Column) -> Column:
    """Spans of the three fixed patterns."""
    assign = F.filter(places(text, ASSIGN, "assign", 2), lambda m: F.length(m["value"]) >= ASSIGN_LEAST)
    return ordered(F.concat(assign, places(text, ACCESS, "access"), places(text, HEX, "hex")))


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ","
    )


def figures(token: Column, odd_share: float, worst_z: float) -> Column:
    """(length_class, step, random): step is the text bound's negative decimal logarithm in tenths."""
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
    groups = "0" * 10 + "A" * 26 + "a" * 26 + "+" * 4
    zero = F.lit(0.0)

    def count(of: Column, what: Column) -> Column:
        return (F.length(of) - F.length(F.replace(of, what, F.lit("")))).cast("double")

    def uniform_z(n: Column, chars: Column, size: Column) -> Column:
        squares = F.aggregate(F.transform(F.array_distinct(chars), lambda c: count(token, c)), zero, lambda t, c: t + c * c)
        df = size - 1
        return (F.cbrt(F.greatest(squares * size / n - n, zero) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

    def runs_z(n: Column, kinds: Column, shares: Column) -> Column:
        same = F.aggregate(shares, zero, lambda t, x: t + x * x)
        runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
        spread = F.sqrt(F.greatest((n - 1) * same * (1 - same), F.lit(0.25)))
        return (1 + (n - 1) * (1 - same) - runs) / spread

    def serial_z(n: Column, chars: Column) -> Column:
        start = F.struct(zero.alias("sum"), zero.alias("squares"), zero.alias("lagged"), F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("first"))
        sums = F.aggregate(
            F.transform(chars, lambda c: F.ascii(c).cast("double")), start,
            lambda t, c: F.struct(
                (t["sum"] + c).alias("sum"), (t["squares"] + c * c).alias("squares"),
                (t["lagged"] + F.coalesce(t["last"] * c, zero)).alias("lagged"), c.alias("last"), F.coalesce(t["first"], c).alias("first"),
            ),
        )
        return let(sums, lambda t: F.when(
            t["squares"] * n > t["sum"] * t["sum"],
            F.abs(t["lagged"] - t["sum"] / n * (2 * t["sum"] - t["first"] - t["last"]) + (n - 1) * t["sum"] * t["sum"] / (n * n)) / (t["squares"] - t["sum"] * t["sum"] / n) * F.sqrt(n),
        ).otherwise(F.sqrt(n)))

    def odd_step(n: Column, odd: Column) -> Column:
        k = F.least(odd, F.lit(1 - 1e-9))
        bound = n * (k * F.log(k / odd_share) + (1 - k) * F.log((1 - k) / (1 - odd_share))) / F.log(F.lit(10.0))
        return F.when(k > odd_share, F.least(F.floor(bound * 10), F.lit(STEPS))).otherwise(F.lit(0)).cast("int")

    def ratio_step(n: Column, size: Column) -> Column:
        # text gives a likelihood ratio of x with a probability of 1/x at most
        low, total = F.lower(token), sum(LETTERS.values())
        digits = odd_share * DIGITS
        text = [(d, digits / 10) for d in "0123456789"] + [(c, (1 - digits) * f / total) for c, f in LETTERS.items()]
        of_text = sum((count(low, F.lit(c)) * math.log10(share) for c, share in text), zero)
        return F.greatest(F.least(F.floor((-n * F.log10(size) - of_text) * 10), F.lit(STEPS)), F.lit(0)).cast("int")

    def judged(x: Column) -> Column:
        hexed, upper32 = token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), token.rlike("^[A-Z2-7]+$")
        n, size = F.length(token).cast("double"), (
            F.when(hexed, F.lit(16.0)).when(upper32 | token.rlike("^[a-z2-7]+$"), F.lit(32.0))
            .when(token.rlike(SINGLE), F.lit(36.0)).otherwise(F.lit(64.0))
        )
        step = F.when(token.rlike(SINGLE) & ~hexed & ~upper32, ratio_step(n, size)).otherwise(
            odd_step(n, 1 - count(x["kinds"], F.lit("a")) / n)
        )
        shares = F.transform(F.array(*map(F.lit, "0Aa+")), lambda c: count(x["kinds"], c) / n)
        length_class = F.lit(0)
        for i, least in enumerate(LENGTH_CLASSES, 1):
            length_class = F.when(n >= least, F.lit(i)).otherwise(length_class)
        random = (
            (F.size(F.filter(shares, lambda s: s > 0)) > 1) & (uniform_z(n, x["chars"], size) < worst_z)
            & (runs_z(n, x["kinds"], shares) < worst_z) & (serial_z(n, x["chars"]) < worst_z)
        )
        return F.struct(
            length_class.alias("length_class"), step.alias("step"), random.alias("random"),
        )

    return let(F.struct(F.split(token, "").alias("chars"), F.translate(token, letters, groups).alias("kinds")), judged)


def scanned(docs: DataFrame, text: str, odd_share: float, worst_z: float) -> DataFrame:
    """`docs` with the columns `_base` (spans) and `_tokens` (candidates and their figures), row by row."""
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = F.transform(places(body, CANDIDATE, "random"), lambda m: F.struct(
        m.alias("span"), figures(m["value"], odd_share, worst_z).alias("figures")
    ))
    return docs.withColumns({"_base": base_places(body), "_tokens": tokens})


def least_steps(tokens: DataFrame, rate: float) -> dict[int, int]:
    """Per length class the smallest step that Benjamini-Hochberg admits over all candidates.

    The driver reads one row per class (four at most); bounds are rounded up to steps, so the rate is kept.
    """
    steps = tokens.select(F.explode("_tokens.figures").alias("f")).groupBy("f.length_class", "f.step").agg(F.count("*").alias("rows"))
    down = Window.partitionBy("length_class").orderBy(F.desc("step"))
    ranked = steps.select(
        "length_class", "step", F.sum("rows").over(down).alias("rank"),
        F.sum("rows").over(Window.partitionBy("length_class")).alias("total"),
    )
    good = F.pow(F.lit(10.0), -F.col("step") / 10.0) <= F.lit(rate) * F.col("rank") / F.col("total")
    least = ranked.where(good & (F.col("step") > 0)).groupBy("length_class").agg(F.min("step").alias("step"))
    return {row["length_class"]: row["step"] for row in least.collect()}


def with_spans(found: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Add `_spans`: the base spans and the random tokens that overlap none of them."""

    def kept(t: Column) -> Column:
        enough = F.lit(False)
        for length_class, step in sorted(limits.items()):
            enough = enough | ((t["figures"]["length_class"] == length_class) & (t["figures"]["step"] >= step))
        alone = ~F.exists("_base", lambda b: (b["start"] < t["span"]["end"]) & (t["span"]["start"] < b["end"]))
        return t["figures"]["random"] & enough & alone

    extra = F.transform(F.filter("_tokens", kept), lambda t: t["span"])
    return found.withColumn("_spans", ordered(F.concat(F.col("_base"), extra)))


def find(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    rate: float = 0.01, odd_share: float = 0.15, worst_z: float = 3.5,
) -> DataFrame:
    """(id, base, spans): arrays of (start, end, kind, value), by start and then kind.

    `base` holds the pattern matches, `spans` these and the random tokens that no base span overlaps.
    Null and empty texts have empty arrays, an empty table gives no rows, other columns are ignored, and
    repeated rows are scanned each. `odd_share` bounds the share of characters other than small letters in
    ordinary long tokens; `rate` is the false-discovery rate against that bound; a z value of a test must
    stay below `worst_z`. Texts are scanned once: spans and figures are stored before the rate is applied.
    """
    found = stored(scanned(docs.select(id_column, text), text, odd_share, worst_z).select(id_column, "_base", "_tokens"))
    judged = with_spans(found, least_steps(found, rate))
    return judged.select(id_column, F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redact(
    docs: DataFrame, text: str = "text", mask: str = "[secret]",
    rate: float = 0.01, odd_share: float = 0.15, worst_z: float = 3.5,
) -> DataFrame:
    """`docs` with every span of its text replaced by `mask`; overlapping spans become one mask.

    All rows and columns stay; null and empty texts stay as they are.
    """
    # texts are scanned once: what was found is stored beside them before the rate is applied
    found = stored(scanned(docs, text, odd_share, worst_z))
    spans = with_spans(found, least_steps(found, rate))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(t: Column, m: Column) -> Column:
        between = F.substring(F.col(text), t["at"] + 1, m["start"] - t["at"])
        return F.when(m["end"] <= t["at"], t).when(
            m["start"] < t["at"], F.struct(m["end"].alias("at"), t["out"].alias("out"))
        ).otherwise(F.struct(m["end"].alias("at"), F.concat(t["out"], F.array(between, F.lit(mask))).alias("out")))

    made = F.aggregate("_spans", start, step, lambda t: F.concat(
        F.array_join(t["out"], ""), F.substring(F.col(text), t["at"] + 1, F.length(text))
    ))
    clean = F.when(F.size("_spans") > 0, made).otherwise(F.col(text))
    return spans.withColumn(text, clean).select(*docs.columns)
