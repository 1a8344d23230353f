"""Secret scan with Spark's own functions.

Base kinds are found by pattern: assignments to password-like names, access keys,
long lower-case hexadecimal strings.  The method adds spans: over each candidate
string (20 or more characters of the base64 alphabet, or 16 or more hexadecimal
ones, with a digit and a letter) a window slides; the counts of its characters change
by the one that enters and the one that leaves, and with them the sum of c log2 c that
Shannon's entropy needs.  Hexadecimal candidates have a window and a threshold of
their own.  Candidates of an allowed shape are passed over; of others, windows that
overlap an allowed part are.  Base spans are never.

All repetitions are of character classes, not of groups (which Java's engine would run by
recursion, as deep as the text is long), and each character costs a fixed time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .spans import between, found, let, places, replaced

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20}|[0-9a-fA-F]{16,19}(?![A-Za-z0-9+/_=-]))(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]++={0,2}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: character class -> window, bits per character from which a window counts
CLASSES = {"hex": (16, 2.8), "base64": (20, 3.6)}
#: Whole candidates that are allowed: UUIDs; words between single separators that end in a short number.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
WORDS, APART = r"^[A-Za-z][A-Za-z_/=-]*[-_/=][A-Za-z]*[0-9]{1,4}$", r"[-_/=]{2}"
#: Parts that are allowed, each with its length: placeholders, counting, one character many times.
PARTS = {"(?i)example": 7, "(?i)sample": 6, "(?i)placeholder": 11, "(?i)dummy": 5, "(?i)changeme": 8, "(?i)lorem": 5, "0123456789": 10, "12345678": 8, "(?i)abcdefgh": 8, r"(.)\1{5}": 6}
#: c log2 c in units of 2 ** -40, so that sums stay exact
UNIT = 1 << 40
GROWN = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(max(w for w, _ in CLASSES.values()) + 2)]
KINDS = ["assign", "access", "hex", "entropy"]


def allowed(candidate: Column) -> Column:
    return candidate.rlike(UUID) | (candidate.rlike(WORDS) & ~candidate.rlike(APART))


def masked(candidate: Column) -> Column:
    """The candidate with ~ for every character of an allowed part."""
    out = candidate
    for pattern, n in PARTS.items():
        out = F.regexp_replace(out, F.lit(pattern), F.lit("~" * n))
    return F.when(candidate.rlike("|".join(f"(?:{p})" for p in PARTS)), out).otherwise(candidate)


def entropy_span(candidate: Column) -> Column:
    """struct<at, to> inside a candidate: from its first to its last window over the threshold; null without."""
    is_hex = candidate.rlike("^[0-9a-fA-F]+$")
    window = F.when(is_hex, CLASSES["hex"][0]).otherwise(CLASSES["base64"][0])
    most = F.when(is_hex, _limit(*CLASSES["hex"])).otherwise(_limit(*CLASSES["base64"]))
    grown = lambda c: F.element_at(F.array(*[F.lit(g).cast("long") for g in GROWN]), c + 1)
    count = lambda counts, code: F.ascii(F.substr(counts, code, F.lit(1))) - 48
    put = lambda counts, code, n: F.overlay(counts, F.char(n + 48), code, F.lit(1))

    def leave(acc: Column, code: Column) -> Column:
        gone = let(count(acc["counts"], code), lambda c: F.struct(put(acc["counts"], code, c - 1).alias("counts"), (acc["sum"] + grown(c - 1) - grown(c)).alias("sum")))
        return F.when(code > 0, gone).otherwise(F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))

    def enter(left: Column, code: Column) -> Column:
        come = let(count(left["counts"], code), lambda c: F.struct(put(left["counts"], code, c + 1).alias("counts"), (left["sum"] + grown(c + 1) - grown(c)).alias("sum")))
        return F.when(code > 0, come).otherwise(left)

    def step(acc: Column, pair: Column, window: Column, most: Column) -> Column:
        return let(
            let(leave(acc, pair["goes"]), lambda left: enter(left, pair["comes"])),
            lambda now: let(
                F.struct((acc["i"] + 1).alias("i"), F.when(pair["comes"] > 0, acc["clear"] + 1).otherwise(0).alias("clear")),
                lambda at: let(
                    (at["clear"] >= window) & (now["sum"] <= most),
                    lambda over: F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), at["i"].alias("i"), at["clear"].alias("clear"), F.when(over & acc["at"].isNull(), at["i"] - window).otherwise(acc["at"]).alias("at"), F.when(over, at["i"]).otherwise(acc["to"]).alias("to")),
                ),
            ),
        )

    none = F.lit(None).cast("int")
    start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(0).alias("clear"), none.alias("at"), none.alias("to"))
    codes = F.transform(F.split(masked(candidate), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = lambda own, window: F.zip_with(own, F.concat(F.array_repeat(F.lit(0), window), F.slice(own, F.lit(1), F.greatest(F.size(own) - window, F.lit(0)))), lambda x, y: F.struct(x.alias("comes"), y.alias("goes")))
    folded = lambda own, w, limit: F.aggregate(pairs(own, w), start, lambda acc, pair: step(acc, pair, w, limit), lambda acc: F.when(acc["at"].isNotNull(), F.struct(acc["at"].alias("at"), acc["to"].alias("to"))))
    return let(F.struct(codes.alias("codes"), window.alias("w"), most.alias("most")), lambda v: F.when(F.size(v["codes"]) >= v["w"], folded(v["codes"], v["w"], v["most"])))


def _limit(window: int, bits: float) -> Column:
    """The largest sum of c log2 c of a window with so many bits a character."""
    return F.lit(math.floor((math.log2(window) - bits) * window * UNIT)).cast("long")


def _numbered(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["at"].alias("at"), F.lit(KINDS.index(kind)).alias("kind"), s["to"].alias("to")))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["at"], s["to"])), ",")


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of df and _base, _spans: array<struct<at, kind, to>>, sorted.  Null texts are empty and have none."""
    prepare(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_am", found(text, ASSIGN)).withColumn("_xm", found(text, ACCESS)).withColumn("_hm", found(text, HEX)).withColumn("_cm", found(text, CANDIDATE))
    out = out.withColumn("_av", F.when(F.size("_am") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))).otherwise(F.array().cast("array<string>")))
    for name, pattern in (("_a", ASSIGN), ("_x", ACCESS), ("_h", HEX), ("_c", CANDIDATE)):
        out = out.withColumn(name, places(between(text, pattern, F.col(f"{name}m")), F.transform(f"{name}m", lambda m: F.length(m))))
    # assignments whose value is too short go
    out = out.withColumn("_a", F.filter("_a", lambda s, i: F.length(F.element_at("_av", i + 1)) >= 6))
    inner = F.zip_with("_cm", "_c", lambda c, s: F.when(~allowed(c), F.struct(s["at"].alias("at"), entropy_span(c).alias("e"))))
    entropy = F.transform(F.filter(inner, lambda x: x.isNotNull() & x["e"].isNotNull()), lambda x: F.struct((x["at"] + x["e"]["at"]).alias("at"), (x["at"] + x["e"]["to"]).alias("to")))
    out = out.withColumn("_e", F.when(F.size("_cm") > 0, entropy).otherwise(F.array().cast("array<struct<at:int,to:int>>")))
    base = F.array_sort(F.concat(_numbered(F.col("_a"), "assign"), _numbered(F.col("_x"), "access"), _numbered(F.col("_h"), "hex")))
    out = out.withColumn("_base", base).withColumn("_spans", F.array_sort(F.concat("_base", _numbered(F.col("_e"), "entropy"))))
    return out.drop("_am", "_xm", "_hm", "_cm", "_av", "_a", "_x", "_h", "_c", "_e")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret span (overlapping ones together) replaced by the mark; n_chars, if there, is counted anew.
    Rows without secrets are left as they are, null and empty texts too; rows that repeat are changed alike."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    scanned = scan(docs.toDF(*names), text)
    out = scanned.withColumn("_new", F.when(F.size("_spans") > 0, replaced(F.col(text), F.col("_spans"), mark)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(F.size("_spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*["_new" if n == text else n for n in names]).toDF(*docs.columns)


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    scanned = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return scanned.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"))
