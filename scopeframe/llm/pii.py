"""Personal data replaced by surrogates, with Spark's own functions.

Entities (e-mail and IPv4 addresses, telephone and social security numbers, payment
cards that pass the Luhn test, names after a title) get replacements by a keyed
permutation of their normal form: one entity has one surrogate wherever and however it
is written, and two entities of a kind never share one.  Replacements keep the type and
the format: punctuation, length, letter case, vowels and consonants, country codes, valid
check digits, top-level domains; the script and gender of names (by title, and in
Cyrillic by the ending).  A family name has one surrogate with or without a given name.

The permutation shifts each character within its class by a hash of those before it, and
then by a hash of those after it.  Each pass can be undone, so the whole is one to one on the
strings of a format.

Collision checks: no surrogate may be an entity of the corpus, or another's surrogate.
Those that are get a further attempt, with another key.  Where the whole space of a format is taken
(all numbers of one form, say) the first attempt holds: distinct, though some
other entity is written so.  The entities with a further attempt are few; they reach the texts
as one small table, or, if there are many, by a join.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import parts, prepare, salted_join
from .spans import let

KEY = "scopeframe"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Groups repeat a bounded number of times only: Java's engine recurses over them.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,63}"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,8}\)?){1,6})(?![0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
TITLES_M, TITLES_F = r"Mr|Herr|Monsieur|Señor|Sr|г-н", r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа"
_WORD = r"\p{Lu}(?=[\p{L}'])\p{L}{0,40}+(?:['-](?!s(?!\p{L}))\p{L}{1,40}+){0,3}"
NAME = rf"(?<!\p{{L}})(?:{TITLES_F}|{TITLES_M})\.?\x20{_WORD}(?:\x20{_WORD})?"
PATTERN = "|".join((EMAIL, IP, SSN, PHONE, CARD, NAME))
#: What a text must hold to have an entity at all.
HINT = rf"[0-9@]|{TITLES_F}|{TITLES_M}"
KINDS = ["email", "ip", "ssn", "phone", "card", "name_m", "name_f"]
#: Characters that may stand for one another.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâãäåæéèêëíìîïóòôõöøœúùûüýÿ", "çñšžřčďťňłńśźżğşðþ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"]
_ALL = "".join(CLASSES)
#: By place in _ALL: where the class begins, and its size.
_BEGIN = [_ALL.index(c[0]) + 1 for c in CLASSES for _ in c]
_SIZE = [len(c) for c in CLASSES for _ in c]
#: Endings of surrogate given names.
ENDINGS = {"name_m": ("us", "ан"), "name_f": ("ia", "ина")}
MOST_ATTEMPTS = 12
#: Entities with a further attempt that may go to the texts in one table.
BLOCK = 1000


def _table(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, b: a + b) % 10


def kind_of(m: Column) -> Column:
    """An entity's kind; null for digits that are neither card nor number."""
    n = F.length(_digits(m))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{TITLES_F})[. ]"), "name_f")
        .when(m.rlike(rf"^(?:{TITLES_M})[. ]"), "name_m")
        .when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.startswith("+"), F.when(n.between(8, 15), "phone"))
        .when(n < 13, "phone")
        .when(m.rlike(r"^[0-9]") & (luhn(_digits(m)) == 0), "card")
        .when(m.contains("("), "phone")
    )


def norm_of(m: Column, kind: Column) -> Column:
    """The normal form: lower-case address or name without its title, digits; a country code and a space before the rest of a number."""
    country = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .(-]", 1)
    return (
        F.when(kind.isin("email", "ip"), F.lower(m))
        .when(kind.startswith("name"), F.lower(F.regexp_replace(m, r"^\S+\x20", "")))
        .when((kind == "phone") & (country != ""), F.concat(country, F.lit(" "), _digits(F.substr(m, F.length(country) + 1))))
        .otherwise(_digits(m))
    )


def family_of(norm: Column) -> Column:
    return F.regexp_extract(norm, r"(\S+)$", 1)


def _seed(key: str, *about: Column) -> Column:
    return F.xxhash64(F.sha2(F.concat_ws("|", F.lit(key), *about), 256))


def _shifted(c: Column, h: Column) -> Column:
    """The character moved by a hash within its class; others stay."""
    return let(F.instr(F.lit(_ALL), c), lambda p: F.when(p > 0, let(F.element_at(_table(_BEGIN), p), lambda b: F.substr(F.lit(_ALL), (b + F.pmod(p - b + F.pmod(h, F.lit(1 << 20)), F.element_at(_table(_SIZE), p))).cast("int"), F.lit(1)))).otherwise(c))


def _octet(c: Column, h: Column) -> Column:
    return F.pmod(c.cast("int") + F.pmod(h, F.lit(256)), F.lit(256)).cast("int").cast("string")


def permuted(chars: Column, seed: Column, shift: Callable[[Column, Column], Column] = _shifted) -> Column:
    """An array of characters under a keyed permutation that keeps each one's class."""
    step = lambda acc, c: F.struct(F.xxhash64(acc["h"], c).alias("h"), F.concat(acc["out"], F.array(shift(c, acc["h"]))).alias("out"))
    one = lambda x, h: F.reverse(F.aggregate(x, F.struct(h.alias("h"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"]))
    return let(seed, lambda h: one(one(chars, h), F.xxhash64(h, F.lit("back"))))


def _word(text: Column, seed: Column) -> Column:
    return F.when(text == "", "").otherwise(F.array_join(permuted(F.split(text, ""), seed), ""))


def _family(name: Column, attempt: Column, key: str) -> Column:
    """In Cyrillic the last two letters of longer names stay, which tell the gender."""
    kept = F.when(name.rlike(r"[а-яё]$") & (F.length(name) > 4), 2).otherwise(0)
    return let(kept, lambda k: F.concat(_word(F.substr(name, F.lit(1), F.length(name) - k), _seed(key, F.lit("family"), attempt.cast("string"))), F.when(k > 0, F.right(name, k)).otherwise("")))


def fresh_norm(kind: Column, norm: Column, attempt: Column, key: str = KEY) -> Column:
    """The normal form of an entity's surrogate; kind may also be family, for the family name alone."""
    seed = lambda *about: _seed(key, kind, attempt.cast("string"), *about)
    local, domain, top = F.regexp_extract(norm, r"^([^@]*)@", 1), F.regexp_extract(norm, r"@(.*)\.[^.]*$", 1), F.regexp_extract(norm, r"(\.[^.]*)$", 1)
    email = F.concat(_word(local, seed(domain, top)), F.lit("@"), _word(domain, _seed(key, F.lit("domain"), top)), top)
    payload = let(F.length(norm), lambda n: F.concat(F.substr(norm, F.lit(1), F.lit(1)), _word(F.substr(norm, F.lit(2), n - 2), seed(F.substr(norm, F.lit(1), F.lit(1))))))
    card = let(payload, lambda p: F.concat(p, F.pmod(F.lit(10) - luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
    country, rest = F.regexp_extract(norm, r"^(\+[0-9]+ )", 1), F.regexp_extract(norm, r"([0-9]+)$", 1)
    given = F.regexp_extract(norm, r"^(.*)\x20", 1)
    ending = lambda k: F.when(given.rlike("[а-яё]"), ENDINGS[k][1]).otherwise(ENDINGS[k][0])
    named = lambda k: F.concat(F.when(given != "", F.concat(_word(given, _seed(key, F.lit("given"), F.lit(k))), ending(k), F.lit(" "))).otherwise(""), _family(family_of(norm), attempt, key))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.array_join(permuted(F.split(norm, r"\."), seed(), _octet), "."))
        .when(kind == "card", card)
        .when(kind == "name_m", named("name_m"))
        .when(kind == "name_f", named("name_f"))
        .when(kind == "family", _family(norm, attempt, key))
        .otherwise(F.concat(country, _word(rest, seed(country))))
    )


def _recased(m: Column, new: Column) -> Column:
    """new in the letter case of m, character by character; what goes beyond m is upper case if all of m is."""
    upper = F.when((F.upper(m) == m) & (F.length(m) > 1), F.upper(F.substr(new, F.length(m) + 1))).otherwise(F.substr(new, F.length(m) + 1))
    chars = F.zip_with(F.split(F.substr(new, F.lit(1), F.length(m)), ""), F.split(m, ""), lambda n, o: F.when(o != F.lower(o), F.upper(n)).otherwise(n))
    return F.concat(F.array_join(chars, ""), F.when(F.length(new) > F.length(m), upper).otherwise(""))


def _laid_out(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order."""
    own = F.split(digits, "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["out"], F.get(own, acc["i"])).alias("out"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["out"], c).alias("out")))
    return F.aggregate(F.split(m, ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def as_written(m: Column, kind: Column, norm: Column) -> Column:
    """A surrogate's normal form, written as the entity m was."""
    title, rest = F.regexp_extract(m, r"^(\S+\x20)", 1), F.regexp_replace(m, r"^\S+\x20", "")
    given = lambda x: F.regexp_extract(x, r"^(.*)\x20", 1)
    name = F.concat(title, F.when(given(norm) != "", F.concat(_recased(given(rest), given(norm)), F.lit(" "))).otherwise(""), _recased(family_of(rest), family_of(norm)))
    return F.when(kind == "email", _recased(m, norm)).when(kind == "ip", norm).when(kind.startswith("name"), name).otherwise(_laid_out(m, _digits(norm)))


def _entity(m: Column) -> Column:
    """struct<m, kind, norm, key>: key is what an attempt is kept by; null for what is none."""
    named = lambda k: let(norm_of(m, k), lambda n: F.struct(m.alias("m"), k.alias("kind"), n.alias("norm"), F.when(k.startswith("name"), F.concat(F.lit("family:"), family_of(n))).otherwise(F.concat_ws(":", k, n)).alias("key")))
    return let(kind_of(m), lambda k: F.when(k.isNotNull(), named(k)))


def _found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, norm, n): the distinct entities of the corpus (of names, the family names), and how often they occur."""
    key = docs.select(F.explode(F.transform(_found(F.col(text_col)), _entity)).alias("e")).where("e is not null").select("e.key")
    return key.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.regexp_extract("key", "^([a-z]+):", 1).alias("kind"), F.regexp_extract("key", "(?s)^[a-z]+:(.*)$", 1).alias("norm"), "n")


def attempts(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt): the entities whose first surrogate is taken, with the first attempt that is free, if there is one."""
    spark = found.sparkSession
    made = lambda df, k: df.select("kind", "norm", fresh_norm(F.col("kind"), F.col("norm"), F.lit(k), key).alias("s"))
    # many small tasks: the table is small, but each row costs far more than its bytes say
    found = found.select("kind", "norm").repartition(4 * parts(spark), "kind", "norm").checkpoint()
    now = made(found, 0).checkpoint()
    taken = found.select("kind", F.col("norm").alias("s"))
    known = now.select("kind", "s")
    left = now.join(taken, ["kind", "s"], "left_semi").select("kind", "norm").checkpoint()
    out = spark.createDataFrame([], "kind string, norm string, attempt int")
    for k in range(1, MOST_ATTEMPTS + 1):
        if not left.limit(1).count():
            break
        free = made(left, k).join(taken, ["kind", "s"], "left_anti").join(known, ["kind", "s"], "left_anti")
        first = free.groupBy("kind", "s").agg(F.min("norm").alias("norm")).checkpoint()
        out = out.unionByName(first.select("kind", "norm", F.lit(k).alias("attempt")))
        known = known.unionByName(first.select("kind", "s"))
        left = left.join(first, ["kind", "norm"], "left_anti").checkpoint()
    return out


def _tabled(docs: DataFrame, text_col: str, changed: DataFrame) -> DataFrame:
    """docs and _t: the further attempts of the entities in the row's text, by key."""
    n = changed.count()
    if n <= BLOCK:
        rows = {r.key: r.attempt for r in changed.collect()}
        return docs.withColumn("_t", F.from_json(F.lit(json.dumps(rows)), "map<string,int>"))
    own = F.when(F.col(text_col).rlike(HINT), F.sha2(text_col, 256))
    each = docs.select(own.alias("_own"), F.transform(_found(F.col(text_col)), lambda m: _entity(m)["key"]).alias("k")).where("size(k) > 0").dropDuplicates(["_own"])
    hits = each.select("_own", F.explode(F.array_distinct("k")).alias("key")).join(changed, "key").groupBy("_own").agg(F.map_from_entries(F.collect_list(F.struct("key", "attempt"))).alias("_t"))
    return salted_join(docs.withColumn("_own", own), hits, "_own", by=F.monotonically_increasing_id(), how="left").drop("_own")


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The columns of docs with text_col replaced, and _kinds: the kinds of the entities in it, in order.

    Null texts stay null and empty ones empty; texts without entities are unchanged.  Rows that repeat are replaced alike.
    An empty table gives no rows."""
    prepare(docs.sparkSession)
    changed = attempts(entities(docs.select(text_col), text_col), key).select(F.concat_ws(":", "kind", "norm").alias("key"), "attempt").checkpoint()
    names = [f"d{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index(text_col)]
    text = F.col(own)
    out = _tabled(docs.toDF(*names), own, changed)
    out = out.withColumn("_m", _found(text)).withColumn("_e", F.transform("_m", _entity))
    attempt = lambda e: F.coalesce(F.element_at("_t", e["key"]), F.lit(0))
    fresh = lambda e, m: F.when(e.isNull(), m).otherwise(let(fresh_norm(e["kind"], e["norm"], attempt(e), key), lambda n: as_written(m, e["kind"], n)))
    out = out.withColumn("_s", F.zip_with("_e", "_m", fresh)).withColumn("_b", F.when(F.size("_m") > 0, F.split(text, PATTERN, -1)))
    put = F.array_join(F.zip_with("_b", "_s", lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")
    out = out.withColumn("_new", F.when(F.size("_m") > 0, put).otherwise(text))
    kinds = F.filter(F.transform("_e", lambda e: e["kind"]), lambda k: k.isNotNull())
    return out.withColumn("_kinds", kinds).select(*["_new" if n == own else n for n in names], "_kinds").toDF(*docs.columns, "_kinds")


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, n_entities, one count a kind, and the text with surrogates."""
    done = replace(docs.select("doc_id", "text"))
    counts = [(F.size("_kinds") - F.size(F.array_remove("_kinds", name))).cast("long").alias(f"n_{name}") for name in KINDS]
    return done.select("doc_id", F.size("_kinds").cast("long").alias("n_entities"), *counts, "text")
