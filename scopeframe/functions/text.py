"""Text expressions in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINATED = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a string."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def lines(text: Column) -> Column:
    """Lines with their terminators (LF, CRLF, CR); after a last terminator, and for an empty text, one empty line."""
    found = F.regexp_extract_all(text, F.lit(TERMINATED), F.lit(0))
    return F.when((text == "") | F.substring(text, -1, 1).isin("\n", "\r"), F.concat(found, F.array(F.lit("")))).otherwise(found)


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def shebang(text: Column) -> Column:
    """What follows #! on the first line; empty without."""
    return F.regexp_extract(text, r"^#!([^\r\n]*)", 1)


def program(word: Column) -> Column:
    """A program's lower-case base name without .exe."""
    return F.regexp_replace(F.lower(F.element_at(F.split(word, r"[/\\]"), -1)), r"\.exe$", "")


def interpreter(line: Column) -> Column:
    """The program that an interpreter line runs: its lower-case base name without .exe; env's own options and settings are passed over."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    step = lambda acc, w: F.struct(
        F.when(acc["found"] != "", acc["found"]).when(acc["skip"], "").when(acc["rest"] | ~w.rlike(r"^-|^[A-Za-z_]\w*="), w).otherwise("").alias("found"),
        ((acc["found"] == "") & ~acc["skip"] & w.isin("-u", "--unset", "-C", "--chdir")).alias("skip"),
        (acc["rest"] | (w == "--")).alias("rest"),
    )
    start = F.struct(F.lit("").alias("found"), F.lit(False).alias("skip"), F.lit(False).alias("rest"))
    after_env = F.aggregate(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), start, step, lambda acc: acc["found"])
    run = F.when(F.size(words) == 0, "").when(program(words[0]) == "env", after_env).otherwise(words[0])
    return F.when(run != "", program(run)).otherwise("")
