"""Secret scan with DataFrame functions only: named patterns, and a randomness test battery for other tokens.

Base patterns (fixed values, below) give spans ``assign``, ``access`` and ``hex``. Every other run of TOKEN characters is
a candidate. Its encoding is inferred (decimal, hexadecimal, base 32, base 64) and three tests ask whether its symbols
look drawn at random from that alphabet: chi-squared uniformity (over symbols for small alphabets, over character
classes for base 64), Wald-Wolfowitz runs above and below the middle of the alphabet, and lag-one serial correlation.
Fisher's method combines them into one p-value of randomness, which is spread evenly over 0 to 1 for random tokens and
close to 0 for words, paths and names.

Which candidates are reported is decided over the whole corpus, for each class of lengths by itself, since the tests tell
short tokens apart less well: in a class, those with p of a half or more tell how many random tokens it has (Storey's
estimate), hence how many of those above any limit are none. The least limit is taken that keeps the share of false
ones among the reported at FDR or below; it is never above a half, and never so low that a token passes which random
ones would be in one case of a hundred. Reported candidates that carry MIN_BITS are spans of kind ``random``.

Spans of one text are placed in time that grows with the power 1.5 of their number. Positions are code points, ends
exclusive. Nulls: a null text is an empty one, without spans. Rows are independent up to the limits; repeated rows give
repeated results; extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import materialise

# Fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ["assign", "access", "hex", "random"]

TOKEN = r"[A-Za-z0-9+/_=-]+"
TOKEN_LEAST = 20
MIN_BITS = 90.0
FDR = 0.05
#: p-values are kept in steps of a hundredth of a decade, down to 1e-30.
STEPS, LOWEST = 100, 30
#: Steps of a p-value of a half and of a hundredth.
HALF, HUNDREDTH = 30, 200
#: Least lengths of the classes above the first.
LENGTHS = [28, 40, 64, 128]


def _least(pattern: str, n: int) -> str:
    """The greedy run of n characters or more: shorter runs would be dropped, and a run holds no other run."""
    return pattern.removesuffix("+") + f"{{{n},}}"


def spans_of(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, end, token>> of the leftmost non-overlapping matches, token being the group or the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    token = F.transform(found, lambda m: F.regexp_extract(m, pattern, group)) if group else found
    empty = "array<struct<start:bigint,end:bigint,token:string>>"

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), x["token"].alias("token"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(block: Column) -> Column:
        """Spans of a block, counted from its start, and its length."""
        return F.aggregate(block, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(empty).alias("out")), add)

    def joined(blocks: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(blocks, none, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = F.zip_with(blocks, starts, lambda b, o: F.transform(b["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["token"].alias("token"))))
        return F.flatten(moved)

    zipped = F.arrays_zip(found.alias("m"), gaps.alias("gap"), token.alias("token"))
    spans = let(zipped, lambda z: let(F.transform(in_blocks(z), placed), joined))
    if least:
        spans = F.filter(spans, lambda s: F.length(s["token"]) >= least)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(empty))


def in_blocks(items: Column) -> Column:
    """An array (one element at least) cut into runs of about the square root of its length."""
    width = F.ceil(F.sqrt(F.size(items))).cast("int")
    return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / w).cast("int")), lambda i: F.slice(items, i * w + 1, w)))


def apart(tokens: Column, known: Column) -> Column:
    """The tokens (in order, none over another) that overlap no known span."""

    def of_block(block: Column) -> Column:
        reach = F.filter(known, lambda k: (k["start"] < F.element_at(block, -1)["end"]) & (F.element_at(block, 1)["start"] < k["end"]))
        return let(reach, lambda near: F.filter(block, lambda t: ~F.exists(near, lambda k: (k["start"] < t["end"]) & (t["start"] < k["end"]))))

    return F.when((F.size(known) == 0) | (F.size(tokens) == 0), tokens).otherwise(F.flatten(F.transform(in_blocks(tokens), of_block)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|): the error function's rational approximation 7.1.26 of Abramowitz and Stegun, 1e-7 off at most."""

    def tail(x: Column) -> Column:
        poly = let(1 / (1 + 0.3275911 * x), lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))
        return F.least(F.lit(1.0), F.greatest(F.lit(10.0**-LOWEST), poly * F.exp(-x * x)))

    return let(F.abs(z) / F.sqrt(F.lit(2.0)), tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def chi_p(statistic: Column, freedom: Column) -> Column:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root, one-sided."""
    k = 2.0 / (9.0 * freedom)
    z = (F.pow(statistic / freedom, F.lit(1.0 / 3.0)) - (1.0 - k)) / F.sqrt(k)
    return let(z, lambda z: let(two_sided(z) / 2, lambda p: F.when(z > 0, p).otherwise(1 - p)))


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: (name, pattern of a whole token, alphabet, bits a symbol, groups of the alphabet for chi-squared); the first that fits
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS, 3.32, list(DIGITS)),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 4.0, list("0123456789abcdef")),
    ("base32", "^[A-Z2-7]+=*$", LOWER + "234567", 5.0, list(LOWER + "234567")),
    ("base64", "^.*$", LOWER.upper() + LOWER + DIGITS + "+/", 6.0, [LOWER.upper(), LOWER, DIGITS, "+/"]),
]


def encoding(token: Column) -> Column:
    """alphabet, bits, case (whether it is told apart) and groups of the first encoding that fits."""
    out = None
    for name, pattern, alphabet, bits, groups in reversed(ENCODINGS):
        shares = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(len(g) / len(alphabet)).alias("share")) for g in groups])
        own = F.struct(F.lit(alphabet).alias("alphabet"), F.lit(bits).alias("bits"), F.lit(name == "base64").alias("case"), shares.alias("groups"))
        out = own if out is None else F.when(token.rlike(pattern), own).otherwise(out)
    return out


def battery(token: Column, code: Column) -> Column:
    """p of randomness of a token in its encoding."""
    trimmed = F.translate(F.rtrim(F.translate(token, "=", " ")), "-_", "+/")

    def tests(x: Column) -> Column:
        lead = F.slice(x, F.lit(2), F.size(x) - 1)
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), lead, lambda a, b: a * b)
        turns = _sum(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), lead, lambda a, b: F.when((a > 0) != (b > 0), 1.0).otherwise(0.0)))
        up = _sum(F.transform(x, lambda a: F.when(a > 0, 1.0).otherwise(0.0)))
        m = F.size(x).cast("double")

        def runs_z(both: Column) -> Column:
            var = both * (both - m) / (m * m * (m - 1))
            return F.when(var > 0, (turns + 1 - (both / m + 1)) / F.sqrt(var)).otherwise(F.sqrt(m))

        runs = let(let(up, lambda u: 2 * u * (m - u)), runs_z)
        square = _sum(F.transform(x, lambda a: a * a))
        serial = F.when(square > 0, _sum(pairs) / square * F.sqrt(m)).otherwise(F.sqrt(m))
        return F.struct(two_sided(runs).alias("runs"), two_sided(serial).alias("serial"))

    def combined(bare: Column) -> Column:
        n = F.length(bare).cast("double")

        def add(total: Column, g: Column) -> Column:
            off = n - F.length(F.call_function("translate", bare, g["group"], F.lit(""))) - n * g["share"]
            return total + off * off / (n * g["share"])

        p1 = chi_p(F.aggregate(code["groups"], F.lit(0.0), add), (F.size(code["groups"]) - 1).cast("double"))
        middle = (F.length(code["alphabet"]) + 1) / 2
        index = F.transform(F.split(bare, ""), lambda c: F.instr(code["alphabet"], c).cast("double") - middle)
        half = let(let(index, tests), lambda o: -(F.log(p1) + F.log(o["runs"]) + F.log(o["serial"])))
        # chi-squared with six degrees of freedom has a closed upper tail
        return let(half, lambda h: F.greatest(F.lit(10.0**-LOWEST), F.exp(-h) * (1 + h + h * h / 2)))

    return let(F.when(code["case"], trimmed).otherwise(F.lower(trimmed)), combined)


def candidate(s: Column) -> Column:
    """start, end, bits, length class and step (of minus log10 of the p-value) of a token."""
    length = F.length(F.rtrim(F.translate(s["token"], "=", " ")))
    size = sum((F.when(length >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0))

    def tested(code: Column) -> Column:
        step = F.round(-F.log10(battery(s["token"], code)) * STEPS).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (code["bits"] * length).alias("bits"), size.alias("size"), step.alias("step"))

    return let(encoding(s["token"]), tested)


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id and spans, array<struct<start, kind_at, end, kind>> in order, of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        spans_of(F.col("text"), ASSIGN, 2, ASSIGN_LEAST).alias("assign"),
        spans_of(F.col("text"), _least(ACCESS, ACCESS_LEAST - 4)).alias("access"),
        spans_of(F.col("text"), _least(HEX, HEX_LEAST)).alias("hex"),
        spans_of(F.col("text"), _least(TOKEN, TOKEN_LEAST)).alias("token"),
    )
    known = F.concat("assign", "access", "hex")
    base = base.withColumn("token", apart(F.col("token"), known))
    free = F.col("token")
    tested = F.transform(free, candidate)
    plain = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS[:3]]
    rows = materialise(base.select("doc_id", *plain, F.when(F.size(free) > 0, tested).alias("tested")), "secrets")
    rows = rows.join(F.broadcast(limits(rows.select(F.explode("tested").alias("t")).select("t.*"), fdr)))
    passed = F.filter(F.coalesce("tested", F.expr("array()").cast(rows.schema["tested"].dataType)), lambda t: (t["bits"] >= MIN_BITS) & (t["step"] <= F.coalesce(F.get("limits", t["size"]), F.lit(-1))))

    def named(spans, i: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind_at"), s["end"].alias("end"), F.lit(KINDS[i]).alias("kind")))

    return rows.select("doc_id", F.array_sort(F.concat(*[named(F.col(k), i) for i, k in enumerate(KINDS[:3])], named(passed, 3))).alias("spans"))


def limits(tested: DataFrame, fdr: float) -> DataFrame:
    """One row, limits: for each class of lengths the last step that is reported."""
    # at most LOWEST * STEPS + 1 different steps a class, whatever the corpus
    counts = tested.filter(F.col("bits") >= MIN_BITS).groupBy("size", "step").agg(F.count(F.lit(1)).alias("n"))
    upwards = Window.partitionBy("size").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    random = (F.sum(F.when(F.col("step") <= HALF, F.col("n")).otherwise(0)).over(Window.partitionBy("size")) + 1) / F.lit(1 - 10 ** (-HALF / STEPS))
    ranked = counts.select("size", "step", F.sum("n").over(upwards).alias("reported"), random.alias("random"))
    true = F.col("random") * (1 - F.pow(F.lit(10.0), -F.col("step") / F.lit(float(STEPS))))
    fits = (F.col("step") <= HALF) | ((F.col("step") <= HUNDREDTH) & (true >= (1 - fdr) * F.col("reported")))
    last = ranked.filter(fits).groupBy("size").agg(F.max("step").alias("last"))
    found = last.agg(F.map_from_entries(F.collect_list(F.struct("size", "last"))).alias("found"))
    return found.select(F.array(*[F.coalesce(F.try_element_at("found", F.lit(i)), F.lit(-1)) for i in range(len(LENGTHS) + 1)]).alias("limits"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined) of every row."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [count(k) for k in KINDS[:3]]
    return scan(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
