"""Operators against plain Python versions of them, and the helpers they share."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from scopeframe.llm import langid, runtime, simhash, spans, substrings

R = random.Random(11)


def fold(text):
    """Bytes of the text: letters in lower case, other ASCII as blanks."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode())


def pairs_of(text):
    data = b" " + fold(text or "") + b" "
    return [(a, b) for a, b in zip(data, data[1:]) if (a, b) != (32, 32)]


def site(host):
    return host.split(".", 1)[1] if "." in host else host.rstrip("0123456789")


def plain_language(rows):
    """(lang, posterior, second, kept) of rows (text, label, host, declared, suffix)."""
    names = sorted({label for _, label, *_ in rows if label and _ is not None} | {r[1] for r in rows if r[1] and r[0] is not None})
    n = len(names)
    counts = {name: collections.Counter(p for t in {r[0] for r in rows if r[1] == name and r[0] is not None} for p in pairs_of(t)) for name in names}
    seen = len(set().union(*counts.values())) + 1
    letters = lambda p: all(97 <= x <= 122 or x > 127 for x in p)
    none = lambda p: 0.5 / 27**2 if max(p) < 128 else 0.5 / (155**2 - 27**2)
    # what of a pair is common to all languages says nothing
    loglik = lambda p: [math.log((counts[k][p] + 1) / (sum(counts[k].values()) + seen)) for k in names]
    scored = []
    for text, _, host, declared, suffix in rows:
        ll, known = [0.0] * n, [0.0] * n
        found = pairs_of(text)
        for p in found:
            own = loglik(p)
            for k in range(n):
                ll[k] += own[k] - max(own)
                like = (1 - langid.FOREIGN) * (counts[names[k]][p] + langid.UNSEEN) / (sum(counts[names[k]].values()) + langid.UNSEEN * 155**2) / none(p) + langid.FOREIGN
                known[k] += math.log(like)
        ok = bool(found) and any(letters(p) for p in found) and max(known) > 0
        scored.append(([x / langid.TEMPER for x in ll], ok))
    votes = collections.defaultdict(lambda: [0] * n)
    for (ll, ok), (_, _, host, *_) in zip(scored, rows):
        if ok and host is not None:
            votes[host][ll.index(max(ll))] += 1
        elif ok:
            votes[None][ll.index(max(ll))] += 1
    smooth = lambda own, wider: [(v + langid.SMOOTHING * w) / (sum(own) + langid.SMOOTHING) for v, w in zip(own, wider)]
    base = smooth([sum(v[k] for v in votes.values()) for k in range(n)], [1 / n] * n)
    sites = collections.defaultdict(lambda: [0] * n)
    for host, v in votes.items():
        if host is not None:
            sites[site(host)] = [a + b for a, b in zip(sites[site(host)], v)]
    out = []
    for (ll, ok), (_, _, host, declared, suffix) in zip(scored, rows):
        prior = smooth(votes[host], smooth(sites[site(host)], base)) if host is not None and host in votes and sum(votes[host]) else base
        log = [a + math.log(p) for a, p in zip(ll, prior)]
        for value, sure in ((declared, langid.DECLARED), (suffix, langid.SUFFIXED)):
            if value in names:
                log = [x + math.log(sure if name == value else (1 - sure) / (max(2, n) - 1)) for x, name in zip(log, names)]
        weight = [math.exp(x - max(log)) for x in log]
        order = sorted(range(n), key=lambda k: (-weight[k], k))
        best = weight[order[0]] / sum(weight)
        out.append((names[order[0]], best, names[order[1]], ok and best >= langid.LEAST))
    return out


WORDS = {"en": "the of and that with from ship thing water", "de": "der und nicht ein schiff wasser mit über", "fr": "le et que dans avec eau été bateau"}


def test_language_against_plain_python(spark):
    rows = []
    for i in range(60):
        lang = R.choice(list(WORDS))
        text = " ".join(R.choice(WORDS[lang].split()) for _ in range(R.randint(1, 12)))
        rows.append((text, lang, R.choice([f"a{i % 4}.example.de", "b.example.de", "src1", "src22"]), "", None))
    rows += [("", "en", "src1", "", None), (None, "de", "src1", "", None), ("Москва это город", None, "src1", "", None), ("x", None, None, "", None), ("1 2 3", "en", "lonely", "", None), ("le le", None, "new.example.fr", "", None)]
    suffixed = [(t, label, h, d, langid.SUFFIXES.get(h.rsplit(".", 1)[-1]) if h and "." in h else None) for t, label, h, d, _ in rows]
    want = plain_language(suffixed)
    df = spark.createDataFrame([(i, t, label, h) for i, (t, label, h, *_) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in langid.identify_documents(df).collect()}
    for i, (lang, best, second, kept) in enumerate(want):
        assert got[i].lang == lang and got[i].posterior == pytest.approx(best, abs=1e-9) and got[i].second == second and got[i].kept == kept, rows[i]
    assert sorted(r.doc_id for r in langid.keep_identified(df).collect()) == [i for i, (*_, kept) in enumerate(want) if kept]


def test_salted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(runtime, "LEAST_HOT", 3)
    runtime.prepare(spark)
    left = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 3 else f"k{i}", i) for i in range(200)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3), ("none", 4)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).select("i", "k", "v").collect()))
        assert sorted(map(tuple, runtime.salted_join(left, right, "k", F.col("i"), how).select("i", "k", "v").collect())) == want
        assert runtime.salted_join(left.where("false"), right, "k", F.col("i"), how).count() == 0


def test_prefix_sums_and_cuts(spark):
    runtime.prepare(spark)
    lists = [[R.randint(0, 9) for _ in range(n)] for n in (0, 1, 5, 127, 128, 129, 300, 1000)]
    df = spark.createDataFrame([(v,) for v in lists], "v array<int>")
    got = [(r.v, r.s, r.m) for r in df.select("v", spans.scan(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), spans.scan(F.col("v"), F.lit(0), lambda a, b: F.greatest(a, b)).alias("m")).collect()]
    for v, s, m in got:
        assert s == [sum(v[:i]) for i in range(len(v))] and m == [max([0, *v[:i]]) for i in range(len(v))]
    texts = []
    for n in (10, 4096, 4097, 20000):
        text = "".join(R.choice("abc é😀\n") for _ in range(n))
        at = sorted((a := R.randrange(n), a + R.randint(0, 3000)) for _ in range(5))
        texts.append((text, [(a, min(b, n)) for a, b in at]))
    df = spark.createDataFrame(texts, "t string, s array<struct<at:int,to:int>>")
    for r in df.select("t", "s", spans.replaced(F.col("t"), F.col("s"), "#").alias("o")).collect():
        out, to = "", 0
        for a, b in r.s:
            if a >= to:
                out += r.t[to:a] + "#"
            to = max(to, b)
        assert r.o == out + r.t[to:]


def test_copies_beyond_a_task_lose_the_same_words(spark, monkeypatch):
    monkeypatch.setattr(runtime, "LEAST_HOT", 3)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(40)] + [(100, None), (101, ""), (102, "a b"), (103, " ".join(f"v{i}" for i in range(50)))] + [(None, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.op4(df).collect()}
    assert got == {**{i: (50, 50) for i in range(40)}, 100: (0, 0), 101: (0, 0), 102: (2, 0), 103: (50, 0), None: (51, 50)}


def test_components_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(runtime, "LEAST_HOT", 3)
    rows = [(i, " ".join(["same"] * 30)) for i in range(5, 60)] + [(None, " ".join(["same"] * 30)), (1, "other words here now")]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1, 5}


def test_work_for_a_fingerprint_stays_level():
    """Variants listed, per fingerprint, do not grow with the number of fingerprints in a bucket."""
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1 << 9, 1 << 12):
        points = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        ball = simhash.Ball(2, simhash.bits_for(len(points), 1 << 12))
        assert sum(len(v) for b in range(1 << ball.bits) for v, _ in ball.variants(b, points[(np.bitwise_count((points ^ np.uint64(b)) & ball.low) <= 2)], 1 << 10)) == 2081 * len(points)
