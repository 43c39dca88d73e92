"""Secret scan: fixed patterns, and a randomness test battery with length-aware false-discovery control.

DataFrame functions only. Matches with their places come from splitting a text by the pattern: the lengths of the pieces
and of the matches add up to the starts.

The battery looks at long tokens outside the base spans. From a token's signs its encoding is inferred (hex, base32, one case and
digits, base64). Three tests ask whether its signs look drawn at random from that alphabet: chi-squared uniformity, the runs test
about the middle of the alphabet, and lag-1 serial correlation. Their standardised results add up to one statistic (chi-squared
with 3 degrees of freedom for random signs); a token that it rejects is never added.

A false discovery is a natural word. A token's p-value is the chance that as many letters drawn as in written language repeat so
little: pairs of equal signs have a known mean and variance for a language's repeat rate, the least of common languages is taken,
and the lower tail is bounded from above. (Hex signs repeat as often as letters do; their p-value is the chance that written
letters are all hex signs.) So longer tokens get smaller p-values. All tokens are candidates, letters alone too; in each class of
lengths the largest p-value is taken at which Benjamini and Hochberg's rule keeps the false-discovery rate at ``FDR``. Counts cover
all texts; what reaches the driver is classes x bins.

Defined cases: a null text is empty and has no spans; equal rows get equal results; an empty table gives an empty result; a single
token can be added if its own p-value is at most ``FDR``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.llm.common import checkpointed, documents

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs, so the least length may stand in the pattern: a run too short has no longer match inside.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 6

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Lower ends of the classes of lengths; 0.999 quantile of chi-squared(3); p-values are kept in tenths of their decimal exponent.
CLASSES, REJECTED, FDR, BINS = (20, 24, 32, 48, 64, 128), 16.27, 0.05, 300
# The least sum of squared letter frequencies of common written languages, a matching sum of cubes, and the share of
# hex signs among written letters.
REPEATS, TRIPLES, HEX_SHARE = 0.06, 0.0045, 0.35
_ORDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _sum(x: Column, of=lambda v: v, kind: str = "long") -> Column:
    return F.aggregate(x, F.lit(0).cast(kind), lambda t, v: t + of(v).cast(kind))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once. Else it is computed wherever ``use`` has it, within a lambda for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def running_sum(x: Column) -> Column:
    """Sums of the first i+1 values of a bound array; by blocks of about the square root of the length, so long arrays stay cheap."""
    n, block = F.size(x), F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: _sum(F.slice(x, b * block + 1, block)))
    at = lambda i: F.floor(i / block).cast("int")
    return bound(blocks, lambda blocks: F.transform(F.sequence(F.lit(0), n - 1), lambda i: _sum(F.slice(blocks, F.lit(1), at(i))) + _sum(F.slice(x, at(i) * block + 1, i - at(i) * block + 1))))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, match), in code points, end exclusive; null if none."""

    def spans(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda p, h: (F.char_length(p) + F.char_length(h)).cast("long"))
        return F.zip_with(bound(lengths, running_sum), hits, lambda e, h: F.struct((e - F.char_length(h)).alias("start"), e.alias("end"), h.alias("match")))

    return F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans))


def _spans(found: Column, kind: int) -> Column:
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return F.coalesce(F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))), none)


def base_spans(text: Column) -> Column:
    """Sorted (start, kind, end) of the base patterns."""
    assigned = F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_ASSIGNED)
    return F.array_sort(F.concat(_spans(assigned, 0), _spans(matches(text, ACCESS), 1), _spans(matches(text, HEX), 2)))


def alphabet_size(token: Column) -> Column:
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+$"), 32).when(token.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36).otherwise(64)


def place(sign: Column, size: Column) -> Column:
    """The sign's number in its alphabet: hex and one-case alphabets have their digits first, base32 and base64 their letters."""
    by64 = F.instr(F.lit(_ORDER), F.translate(sign, "-_", "+/")) - 1
    by36 = F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), F.lower(sign)) - 1
    by32 = F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), sign) - 1
    return F.when(size == 64, by64).when(size == 32, by32).otherwise(by36).cast("double")


def _signs(token: Column) -> Column:
    """(size, signs, n) of a token without padding: the size of its alphabet, its signs, and their number."""
    signs = lambda bare: F.filter(F.split(bare, "", -1), lambda x: x != "")
    return bound(F.regexp_replace(token, "=+$", ""), lambda bare: F.struct(alphabet_size(bare).alias("size"), signs(bare).alias("signs"), F.char_length(bare).cast("double").alias("n")))


def battery(token: Column) -> Column:
    """The statistic of the three tests; about chi-squared(3) for signs drawn at random."""
    return bound(_signs(token), lambda t: bound(F.transform(t["signs"], lambda s: place(s, t["size"])), lambda codes: bound(_sum(codes, kind="double") / t["n"], lambda mean: _statistic(t["size"], t["signs"], t["n"], codes, mean))))


def _statistic(size: Column, signs: Column, n: Column, codes: Column, mean: Column) -> Column:
    squares = _sum(F.transform(F.array_distinct(signs), lambda s: F.pow(F.size(F.filter(signs, lambda x: x == s)), F.lit(2))), kind="double")
    df = (size - 1).cast("double")
    uniform = F.greatest((squares * size / n - n - df) / F.sqrt(2 * df * (n - 1) / n), F.lit(0.0))

    after = F.slice(codes, F.lit(2), F.size(codes))
    ahead = F.slice(codes, F.lit(1), F.size(codes) - 1)
    high = _sum(codes, lambda c: F.when(c >= size / 2, 1.0).otherwise(0.0), "double")
    runs = 1 + _sum(F.zip_with(ahead, after, lambda a, b: F.when((a >= size / 2) != (b >= size / 2), 1.0).otherwise(0.0)), kind="double")
    low = n - high
    expected = 2 * high * low / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    ran = F.when((high > 0) & (low > 0), (runs - expected) / spread).otherwise(F.sqrt(n))

    variance = _sum(codes, lambda c: (c - mean) * (c - mean), "double")
    serial = F.when(variance > 0, _sum(F.zip_with(ahead, after, lambda a, b: (a - mean) * (b - mean)), kind="double") / variance * F.sqrt(n)).otherwise(F.sqrt(n))
    return bound(F.struct(uniform.alias("u"), ran.alias("r"), serial.alias("s")), lambda v: v["u"] * v["u"] + v["r"] * v["r"] + v["s"] * v["s"])


def natural_p(token: Column) -> Column:
    """Upper bound of the chance that a natural token of this length repeats its signs as little as this one."""

    def p(t: Column) -> Column:
        n, signs = t["n"], t["signs"]
        same = _sum(F.transform(F.array_distinct(signs), lambda s: F.size(F.filter(signs, lambda x: x == s))), lambda c: c * (c - 1) / 2, "double")
        pairs = n * (n - 1) / 2
        spread = pairs * REPEATS * (1 - REPEATS) + n * (n - 1) * (n - 2) * (TRIPLES - REPEATS**2)
        tail = lambda z: F.when(z > 0, F.exp(-z * z / 2) * F.least(F.lit(0.5), 0.3989423 / F.greatest(z, F.lit(1e-6)))).otherwise(1.0)
        return F.when(t["size"] == 16, F.pow(F.lit(HEX_SHARE), n)).otherwise(bound((pairs * REPEATS - same) / F.sqrt(spread), tail))

    return bound(_signs(token), p)


def length_class(n: Column) -> Column:
    found = F.lit(0)
    for i, least in enumerate(CLASSES):
        found = F.when(n >= least, i).otherwise(found)
    return found


def _scored(tokens: Column) -> Column:
    """(start, end, class, bin) of tokens: the bin is -10 log10 of the p-value, 0 if the battery rejects."""
    exponent = lambda t: F.least(F.floor(-10 * F.log10(F.greatest(natural_p(t), F.lit(1e-300)))), F.lit(BINS - 1))
    one = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), length_class(m["end"] - m["start"]).alias("cls"), F.when(battery(m["match"]) > REJECTED, 0).otherwise(exponent(m["match"])).cast("int").alias("bin"))
    return F.coalesce(F.transform(tokens, one), F.array().cast("array<struct<start:bigint,end:bigint,cls:int,bin:int>>"))


def thresholds(counts: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """(class, bin, candidates) -> the least bin of each class at which the expected share of false discoveries is at most ``fdr``."""
    out: dict[int, int] = {}
    for cls in {k for k, _, _ in counts}:
        rows = sorted(((b, n) for k, b, n in counts if k == cls), reverse=True)
        total, found = sum(n for _, n in rows), 0
        for b, n in rows:
            found += n
            if b > 0 and total * 10 ** (-b / 10) / found <= fdr:
                out[cls] = b
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans: arrays of (start, kind, end), sorted; kinds by number in ``KINDS``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), matches(text, TOKEN).alias("tokens"))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    read = read.withColumn("free", free)
    read = checkpointed(read.select("doc_id", "base", _scored(F.col("free")).alias("scored")))
    counts = read.select(F.explode("scored").alias("t")).groupBy(F.col("t.cls").alias("cls"), F.col("t.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    limits = thresholds([(r["cls"], r["bin"], r["n"]) for r in counts.collect()])
    limit = F.array(*[F.lit(limits.get(k, BINS)) for k in range(len(CLASSES))])
    added = _spans(F.filter("scored", lambda t: t["bin"] >= F.get(limit, t["cls"])), 3)
    return read.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan_secrets(documents(spark, sf_dir)).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
