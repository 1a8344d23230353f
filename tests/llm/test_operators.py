"""Each operator on small frames: brute force, round trips, nulls, empty and long texts, repeats, empty tables."""

import collections
import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash

from scopeframe.llm import chat, decontaminate, langid, matroska, pii, piece, quality, secrets, simhash, substrings

R = random.Random(5)
WORDS = ["".join(R.choice("abdelnorst") for _ in range(R.randint(2, 8))) for _ in range(300)]
COPY = " ".join(R.choice(WORDS) for _ in range(90))


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


TEXTS = [None, "", " \n ", "one", "Two words", COPY, COPY, COPY.replace(" ", "  ", 3), prose(40) + " " + COPY[: len(COPY) // 2], prose(3000), "a b c " * 60, "日本語 😀 ▁ é\x0b", COPY.upper()] + [prose(R.randint(1, 120)) for _ in range(40)]
ROWS = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)] + [(5, COPY, "en", "src0", len(COPY)), (None, "no id here", None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] a \\l [/INST]"), (1, 1, "assistant", "<<SYS>>|"), (1, 2, "odd|<role>", None), (1, 3, "assistant", "é😀"), (1, 4, "user", "end"), (2, 0, None, "x"), (None, 0, "system", "s"), (3, 1, "assistant", ""), (3, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.examples(df).collect()
    assert len(made) == 7
    for conv in {r.conv_id for r in made}:
        last = max((r for r in made if r.conv_id == conv), key=lambda r: r.example)
        assert chat.parse(last.formatted) == [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
    assert [chat.unescape(r.formatted[r.mask_start : r.mask_end]) for r in sorted(made, key=lambda r: r.example) if r.conv_id == 1] == ["<<SYS>>|", "é😀", ""]
    got = {r.conv_id: r for r in chat.op1(df).collect()}
    assert got[1].loss_sha256 == hashlib.sha256("<<SYS>>|é😀".encode()).hexdigest() and got[1].n_turns == 5 and -1 in got
    assert chat.examples(df.where("turn > 99")).count() == 0


def fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


def test_simhash(docs, none):
    fps = [fingerprint(r[1]) for r in ROWS]
    roots = brute_components(fps)
    least = {}
    for r, c in zip(ROWS, roots, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f"{f:016x}", str(least.get(c))) for r, f, c in zip(ROWS, fps, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op2(docs).collect()) == want
    assert simhash.op2(none).count() == 0
    assert sorted(r.doc_id for r in simhash.near_dedup(docs.where("doc_id is not null")).collect()) == sorted(set(least.values()))


def test_near_dedup_keeps_one_row_of_each_group_of_similar_texts(spark, none):
    """Against brute-force Jaccard similarity of five-word shingles, over chains and a large group."""
    r = random.Random(8)
    texts = [prose(r.randint(1, 90)) for _ in range(30)] + [None, "", "b a", "B  a", "b a c"]
    common = prose(30)
    texts += [common + " " + prose(60) for _ in range(40)]
    for _ in range(150):
        w = (r.choice(texts) or "x").split(" ")
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words((t or "").lower())) else frozenset() for t in texts]
    up = list(range(len(texts)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                up[max(root(i), root(k))] = min(root(i), root(k))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(x.doc_id for x in simhash.near_dedup(df).collect()) == [i for i in range(len(texts)) if up[i] == i]
    assert simhash.near_dedup(none).count() == 0


def test_near_dedup_decides_by_row(spark):
    """Null ids and different texts under one id."""
    a, b, c, d = (prose(50) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (1, a), (2, c), (2, d), (3, c), (0, d), (4, "x"), (4, "x")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in simhash.near_dedup(df).collect()), key=str) == sorted([(None, b), (1, a), (2, c), (0, d), (4, "x")], key=str)


def test_ball_hashing_loses_no_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    points = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(6):
            for bit in r.choice(64, r.integers(1, 6), replace=False):
                b ^= 1 << int(bit)
            points.add(b)
    points = np.array(sorted(points), np.uint64)
    forest = simhash._Forest()
    for bits, most in ((4, 1 << 22), (6, 1000)):
        ball = simhash.Ball(2, bits)
        listed = sum(len(v) for bucket in range(1 << bits) for v, _ in ball.variants(bucket, points, most))
        assert listed == 2081 * len(points)  # each variant once, however small the steps
        for bucket in range(1 << bits):
            for a, b in simhash.bucket_links(ball, bucket, points, 4, most):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(x, y)
        signed = points.view(np.int64).tolist()
        roots = brute_components(points.tolist())
        assert all((roots[i] == roots[j]) == (forest.root(signed[i]) == forest.root(signed[j])) for i in range(len(points)) for j in range(i))


def test_substrings(docs, none):
    count = collections.Counter(" ".join(w[k : k + 35]) for r in ROWS for w in [words(r[1])] for k in range(len(w) - 34))
    want = []
    for r in ROWS:
        w, keep = words(r[1]), [True] * len(words(r[1]))
        for k in range(len(w) - 34):
            if count[" ".join(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        want.append((str(r[0]), len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep, strict=True) if y).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op4(docs).collect()) == sorted(want)
    assert substrings.op4(none).count() == 0


def test_matroska(spark, docs):
    for n in (0, 1, 64, 513, 8 * 512, 70_000, 300_000):
        data = bytes(R.randrange(256) for _ in range(n))
        made = matroska.write(matroska.padded(data))
        found = matroska.parse(made)
        assert matroska.samples(made, found) == matroska.padded(data)
        assert all(matroska.vint(made, place, marker=True)[0] == matroska.CLUSTER for *_, place in found.cues) and len(found.cues) == len(found.clusters)
        assert [t for _, t, *_ in found.packets] == [k * matroska.FRAME_MS * matroska.SCALE for k in range(len(found.packets))]
    for kind in (matroska.XIPH, matroska.EBML_LACING):
        frames = [bytes(n) for n in (300, 5, 255, 1000, 0)]
        body = matroska.lace(frames, kind)
        assert [n for _, n in matroska.unlace(body, 0, len(body), kind)] == [300, 5, 255, 1000, 0]
    got = {(r.doc_id, r.n_bytes): r for r in matroska.op5(docs).collect()}
    for r in ROWS:
        payload = matroska.padded((r[1] or "").encode())
        x = got[r[0], len((r[1] or "").encode())]
        assert (x.payload_sha256, x.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    bad = spark.createDataFrame([(1, b"junk"), (2, b""), (3, None)], "doc_id long, media binary")
    assert {r.doc_id for r in matroska.packets(bad).where("error is not null").collect()} == {1, 2, 3}


def test_matroska_files_that_are_none_have_an_error(spark):
    whole = matroska.write(matroska.padded(b"abc" * 5000))
    # sizes are not looked into until an element ends, so every master here may hold all the rest
    nested = whole[: whole.index(matroska.SEGMENT.to_bytes(4, "big"))] + (matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7) * 3000
    files = [whole, b"junk", b"", None, nested, whole[:-1], whole[:40], whole.replace(matroska.CLUSTER.to_bytes(4, "big"), b"\x1f\x43\xb6\x76")]
    df = spark.createDataFrame([(i, 15000, f) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in matroska.read_back(df).collect()}
    assert [got[i].error is None for i in range(len(files))] == [True] + [False] * 7
    assert got[0].payload_bytes == 15040 and got[3].media_bytes is None and got[1].media_bytes == 4
    assert "deep" in got[4].error
    assert {r.doc_id for r in matroska.packets(df.drop("n_bytes")).where("error is null").collect()} <= {0, 7}
    table = matroska.cues(df.where("doc_id = 0").drop("n_bytes")).collect()
    assert [r.place for r in table] == matroska.parse(whole).clusters


def test_pii(docs, none):
    got = [(r.doc_id, r.n_entities, r.text) for r in pii.op6(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((r[0], 0, r[1])) for r in ROWS)
    assert pii.op6(none).count() == 0


def test_pii_is_coreferent_distinct_and_keeps_types(spark):
    text = "Mr John Smith, Mr Smith's, Mrs Jane SMITH; a.b@c.example.com A.B@c.example.com +1 (017) 555-7713 +1 017 555 7713 4111 1111 1111 1111 4111111111111112 1.2.3.4"
    rows = [(i, f"{text} 10.0.{i // 200}.{i % 200} x{i}@y.org") for i in range(400)]
    out = sorted(pii.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    new = out[0].text
    assert out[0].n_card == 1 and "4111111111111112" in new and "4111 1111 1111 1111" not in new and "John" not in new
    names = re.findall(r"Mr (\w+) (\w+), Mr (\w+)'s, Mrs (\w+) (\w+);", new)[0]
    assert names[1] == names[2] == names[4].capitalize() and names[4].isupper() and len(names[1]) == 5
    assert names[0].endswith(pii.ENDINGS["name_m"][0]) and names[3].endswith(pii.ENDINGS["name_f"][0])
    a, b = re.findall(r"\S+@\S+\.com", new)
    assert a.lower() == b.lower() and a != b
    p, q = re.findall(r"\+1 .*? ?\d{3}[ -]\d{4}", new)
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q)
    digits = re.sub(" ", "", re.search(r"(\d{4} ){3}\d{4}(?= 4111111111111112)", new)[0])
    assert sum(int(d) if i % 2 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(digits)) % 10 == 0
    assert len({re.findall(r"\S+@\S+\.org", r.text)[0] for r in out}) == 400


class PlainPii:
    """The surrogates in plain Python: the same keyed permutation, its own code."""

    def __init__(self, texts, key=pii.KEY):
        self.key, self.pattern = key, regex.compile(pii.PATTERN)
        self.found = [[m for m in self.pattern.finditer(t or "")] for t in texts]
        entities = {(k, n) for ms in self.found for m in ms if (e := self.entity(m[0])) for k, n in [e[2]]}
        first = {e: self.fresh(*e, 0) for e in entities}
        taken = {(k, n) for k, n in entities}
        used = {(k, s) for (k, _), s in first.items()}
        left = sorted(e for e in entities if (e[0], first[e]) in taken)
        self.attempt = {}
        for k in range(1, pii.MOST_ATTEMPTS + 1):
            free = {}
            for e in left:
                s = (e[0], self.fresh(*e, k))
                if s not in taken and s not in used:
                    free[s] = min(free.get(s, e), e)
            self.attempt |= {e: k for e in free.values()}
            used |= set(free)
            left = [e for e in left if e not in self.attempt]

    def kind(self, m):
        digits = re.sub("[^0-9]", "", m)
        if "@" in m:
            return "email"
        if re.match(f"(?:{pii.TITLES_F})[. ]", m):
            return "name_f"
        if re.match(f"(?:{pii.TITLES_M})[. ]", m):
            return "name_m"
        if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", m):
            return "ip"
        if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
            return "ssn"
        if m[0] == "+":
            return "phone" if 8 <= len(digits) <= 15 else None
        if len(digits) < 13:
            return "phone"
        if m[0].isdigit() and self.luhn(digits) == 0:
            return "card"
        return "phone" if "(" in m else None

    @staticmethod
    def luhn(digits):
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10

    def entity(self, m):
        """(kind, norm, (kind, norm) that attempts go by)"""
        kind = self.kind(m)
        if kind is None:
            return None
        norm = re.sub("[^0-9]", "", m)
        if kind in ("email", "ip"):
            norm = m.lower()
        elif kind[:4] == "name":
            norm = m.split(" ", 1)[1].lower()
            return kind, norm, ("family", norm.split(" ")[-1])
        elif kind == "phone" and (c := re.match(r"(\+\d{1,3})[ .(-]", m)):
            norm = c[1] + " " + re.sub("[^0-9]", "", m[len(c[1]) :])
        return kind, norm, (kind, norm)

    @staticmethod
    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little"), seed)
        return seed

    def seed(self, *about):
        return self.h(hashlib.sha256("|".join((self.key, *about)).encode()).hexdigest())

    def permuted(self, chars, seed, octets=False):
        def one(chars, h):
            out = []
            for c in chars:
                signed = h - (1 << 64) if h >> 63 else h
                if octets:
                    out.append(str((int(c) + signed % 256) % 256))
                else:
                    of = next((x for x in pii.CLASSES if c in x), None)
                    out.append(of[(of.index(c) + signed % (1 << 20)) % len(of)] if of else c)
                h = self.h(h, c)
            return out[::-1]

        return one(one(chars, seed), self.h(seed, "back"))

    def word(self, text, seed):
        return "".join(self.permuted(text, seed)) if text else ""

    def family(self, name, attempt):
        kept = 2 if re.search("[а-яё]$", name) and len(name) > 4 else 0
        return self.word(name[: len(name) - kept], self.seed("family", str(attempt))) + name[len(name) - kept :]

    def fresh(self, kind, norm, attempt):
        seed = lambda *about: self.seed(kind, str(attempt), *about)
        if kind == "email":
            local, rest = norm.split("@")
            domain, top = rest.rsplit(".", 1)
            return self.word(local, seed(domain, "." + top)) + "@" + self.word(domain, self.seed("domain", "." + top)) + "." + top
        if kind == "ip":
            return ".".join(self.permuted(norm.split("."), seed(), True))
        if kind == "card":
            p = norm[0] + self.word(norm[1:-1], seed(norm[0]))
            return p + str(-self.luhn(p + "0") % 10)
        if kind == "family":
            return self.family(norm, attempt)
        if kind[:4] == "name":
            *given, family = norm.split(" ")
            first = self.word(given[0], self.seed("given", kind)) + pii.ENDINGS[kind][bool(re.search("[а-яё]", given[0]))] + " " if given else ""
            return first + self.family(family, attempt)
        country = re.match(r"(\+\d+ )?", norm)[0]
        return country + self.word(norm[len(country) :], seed(country))

    @staticmethod
    def recased(m, new):
        out = "".join(n.upper() if o != o.lower() else n for o, n in zip(m, new))
        rest = new[len(m) :]
        return out + (rest.upper() if m == m.upper() and len(m) > 1 else rest)

    def written(self, m, kind, norm):
        if kind == "email":
            return self.recased(m, norm)
        if kind == "ip":
            return norm
        if kind[:4] == "name":
            title, *parts = m.split(" ")
            return " ".join([title, *(self.recased(a, b) for a, b in zip(parts, norm.split(" "), strict=True))])
        digits = iter(re.sub("[^0-9]", "", norm))
        return "".join(next(digits) if c.isdigit() else c for c in m)

    def text(self, i, text):
        out, at = [], 0
        for m in self.found[i]:
            e = self.entity(m[0])
            out += [text[at : m.start()], self.written(m[0], e[0], self.fresh(e[0], e[1], self.attempt.get(e[2], 0))) if e else m[0]]
            at = m.end()
        return "".join(out) + text[at:] if text else text


PEOPLE = ["Mr John Smith and Mrs SMITH-JONES, Herr Müller, Frau Ängel", "г-н Иван Петров, г-жа Петрова; Sr. Núñez, Mme D'Arc", "Jo.Do+x@Mail.Example.org jo.do+x@mail.example.org b@c.de", "+49 30 1234567, +1 (555) 010-9999, 555-010-9999 (555) 010-9999", "4111 1111 1111 1111, 4111111111111111 4111111111111112", "10.20.30.40 1.2.3.4.5 123-45-6789", "Miss A and Mr O'Neil's, Mr x", "+7 1", "😀 a@b.co 😀", None, "", "Mr"]


@pytest.mark.parametrize("block", [1000, 0])
def test_pii_against_plain_python(spark, monkeypatch, block):
    """Detection, surrogates and attempts (with few characters to a class, so that many surrogates are taken), by map and by join."""
    monkeypatch.setattr(pii, "BLOCK", block)
    texts = PEOPLE + [f"{i % 3}00-10-000{i}" for i in range(10)] + [f"Mr {a}{b}{c}" for a in "AEIOU" for b in "aei" for c in "bc"] + [f"{c}@ab.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    plain = PlainPii(texts)
    assert plain.attempt
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, PEOPLE[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.op6(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == plain.text(i, t)
        assert got[i].n_entities == sum(plain.entity(m[0]) is not None for m in plain.found[i])
    assert got[None].text == got[0].text
    singles = [got[i].text for i in range(len(PEOPLE), len(texts))]
    assert len(set(singles)) == len(singles)


def test_pii_where_the_whole_space_is_taken(spark, monkeypatch):
    """Ten numbers that differ in one digit, of which alone surrogates may differ: all stay distinct, none fails."""
    monkeypatch.setattr(pii, "_word", lambda text, seed: pii.F.concat(pii.F.left(text, pii.F.length(text) - 1), pii.F.pmod(pii.F.right(text, pii.F.lit(1)).cast("int") + pii.F.pmod(seed, pii.F.lit(10)), pii.F.lit(10)).cast("int").cast("string")))
    rows = [(i, f"100-10-000{i}") for i in range(10)]
    out = [r.text for r in pii.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(out) == {t for _, t in rows}
    out = [r.text for r in pii.op6(spark.createDataFrame(rows[:4], "doc_id long, text string")).collect()]
    assert len(set(out)) == 4 and not set(out) & {t for _, t in rows[:4]}


LONG = ["a@" + "b." * 500_000, "a-" * 500_000 + "1", "a" * 1_000_000 + "@b.com", "Mr " + "A" * 1_000_000, "1-" * 500_000, "1." * 500_000, "+1" + " 2" * 500_000, "x1" * 10_000, "a=" * 300_000 + "password=" * 30_000, "0a" * 12 + (" " + "0a" * 12) * 20_000]


def test_very_long_strings_end(spark):
    """Shapes on which patterns could recurse, search again and again, or copy all before at every match."""
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(10)
    assert sorted(len(r.text) for r in pii.replace(df).select("text").collect()) == sorted(map(len, LONG))
    got = {r.doc_id: r for r in secrets.op8(df).collect()}
    assert got[9].n_hex == 20_001 and got[1].n_entropy == 0
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert out[9] == " ".join(["[SECRET]"] * 20_001) and out[1] == LONG[1]


@pytest.mark.skipif(not os.path.exists(piece.MODEL), reason="no vocabulary")
def test_piece(docs, none):
    v = piece.vocabulary(piece.read_bytes(piece.MODEL))
    texts = [t or "" for t in TEXTS] + ["﷐▁  x", " ", "\n\na", "q" * 500, "日本" * 300 + "😀", "é😀x日" * 20, "ab﷐" * 90]
    ids, at = piece.encode(v, [t.encode() for t in texts])
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert piece.decode(v, own).decode() == t
        want = [x for w in re.findall(" +[^ ]*|[^ ]+", " " + t if t else "") for x in piece.viterbi(v, w)[0]]
        assert own.tolist() == want
    got = piece.op7(docs).collect()
    assert len(got) == len(ROWS) and all(r.decoded_ok for r in got) and piece.op7(none).count() == 0


@pytest.mark.skipif(not os.path.exists(piece.MODEL), reason="no vocabulary")
def test_piece_words_of_equal_hashes_stay_apart():
    """The Thue-Morse word of 4,096 letters and its complement have one polynomial hash under any odd base modulo 2 ** 64."""
    v = piece.vocabulary(piece.read_bytes(piece.MODEL))
    a = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [a, b, a, "x " + b, b[:-1], "a b"]
    ids, at = piece.encode(v, [t.encode() for t in texts])
    assert [piece.decode(v, ids[at[i] : at[i + 1]]).decode() for i in range(len(texts))] == texts


def test_viterbi_finds_the_best_of_all_splits():
    if not os.path.exists(piece.MODEL):
        pytest.skip("no vocabulary")
    v = piece.vocabulary(piece.read_bytes(piece.MODEL))

    def best(w):
        return max((v.scores[w[:k]][1] if w[:k] in v.scores else v.unknown) + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in v.scores or k == 1) if w else 0.0

    for w in (" nation", " the", "éx", "日b\n"):
        assert piece.viterbi(v, w)[1] == pytest.approx(best(w))


PATTERNS = [("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)]


def test_secrets(spark, none):
    texts = [*TEXTS, "Token = 'abcdef' 😀 api_key:x secret=token: abcdefgh AKIA" + "Q7" * 9, "f" * 30 + " " + "0a" * 20, "v=Zx9Qw3Rt7Yu1Io5Pa8Sd k=123e4567-e89b-12d3-a456-426614174000", "password=example_example_1234567a"]
    got = {r.doc_id: r for r in secrets.op8(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = []
        for k, (name, p, least) in enumerate(PATTERNS):
            for m in re.finditer(p, t or "", re.I if not k else 0):
                if len(m[1] if not k else m[0]) >= least:
                    spans.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
        spans = [s for *_, s in sorted(spans)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i].spans.split(",")) | {""}
    n = len(TEXTS)
    assert got[n + 1].n_entropy == 0 and got[n + 2].spans == "entropy:2:22" and got[n + 3].n_entropy == 0
    out = secrets.redact(spark.createDataFrame([(1, texts[n], 3)], "doc_id long, text string, n_chars long")).first()
    assert "abcdef'" not in out.text and out.n_chars == len(out.text) and secrets.op8(none).count() == 0


def test_entropy_windows_by_brute_force(spark):
    strings = ["".join(R.choice("0123456789abcdefXYZ+/_-"[: R.randint(4, 23)]) for _ in range(R.randint(20, 60))) for _ in range(80)]
    got = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.entropy_span(secrets.F.col("s")).alias("e")).collect()
    for r in got:
        n, least = secrets.CLASSES["hex" if re.fullmatch("[0-9a-fA-F]+", r.s) else "base64"]
        ends = [k for k in range(n, len(r.s) + 1) if -sum(c / n * np.log2(c / n) for c in collections.Counter(r.s[k - n : k]).values()) >= least]
        assert (r.e is None) == (not ends)
        if ends:
            assert (r.e["at"], r.e["to"]) == (ends[0] - n, ends[-1])


def test_language(spark, none):
    rows = [(i, "le chat et la souris que nous avons vus" if i % 2 else "the cat and the mouse that we have seen", "fr" if i % 2 else "en", f"h{i % 2}.example.com", 1) for i in range(40)]
    rows += [(100, "la souris", None, "h1.example.com", 1), (101, None, None, None, None), (102, "123 !!", None, "h1.example.com", 0), (102, "the mouse", None, "h0.example.com", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(langid.op9(df).collect(), key=lambda r: (r.doc_id, r.text_pairs))
    assert all(r.lang == ("fr" if r.doc_id % 2 else "en") for r in got[:40])
    assert [(r.doc_id, r.lang, r.kept) for r in got[40:]] == [(100, "fr", True), (101, "en", False), (102, "fr", False), (102, "en", True)]
    assert langid.keep_identified(df).count() == 42 and langid.op9(none).count() == 0
    pages = spark.createDataFrame([(1, "http://x.fr/", '<html lang="fr"><p>le chat</p></html>'), (2, None, None)], "page_id long, url string, html string")
    assert {r.page_id: (r.lang, r.kept) for r in langid.identify_pages(pages, df).collect()}[1] == ("fr", True)


def test_language_fits_all_languages_on_different_texts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, (letters[i % 26] + letters[i // 26] + "q ") * 9, f"l{i:02}", "h", 1) for i in range(70)]
    models = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert models.names == [f"l{i:02}" for i in range(70)]
    assert [int(models.likelihoods([r[1].encode()])[0].argmax()) for r in rows] == list(range(70))
    copies = spark.createDataFrame([(i, "aa", "x", "h", 1) for i in range(50)] + [(99, "bb", "x", "h", 1), (100, "cc", "y", "h", 1)], SCHEMA)
    table = langid.fit(copies, rows=2).table
    pair = [c << 8 | c for c in b"ab"]
    assert table[0][pair[0]] == table[0][pair[1]] == 0 and all(table[1][pair] < 0)


def test_language_rejects_other_scripts_and_junk(spark):
    rows = [(i, "le chat et la souris que nous avons vus" if i % 2 else "the cat and the mouse that we have seen", "fr" if i % 2 else "en", "h", 1) for i in range(40)]
    odd = ["привет как дела у вас сегодня", "今天天气很好我们去公园", "xqzk vjwq zzxk qqvj kxwz", "\x01\x02é\x03ÿ\x7fþ" * 9, "a", "1 a 2 b", "!?"]
    df = spark.createDataFrame(rows + [(100 + i, t, None, "h", 1) for i, t in enumerate(odd)], SCHEMA)
    assert sorted(r.doc_id for r in langid.op9(df).where("kept").collect()) == list(range(40))
    assert sorted(r.doc_id for r in langid.keep_identified(df).collect()) == list(range(40))


def test_quality(spark, none):
    rows = [(i, prose(60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(60).split()), "en", "s", 1) for i in range(240)] + [(900, None, None, None, None), (901, "", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.op3(df, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [r for i, r in got.items() if r.held_out and i < 240]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.9 and got[900].score == got[901].score
    assert quality.op3(none, labels).count() == 0 and quality.op3(df, labels.limit(0)).count() == len(rows)


def test_quality_chunks_cover_the_document():
    net = quality.Network().freeze()
    text = bytes(R.randrange(256) for _ in range(1000))
    alone = [net.scores([text[:n]])[0] for n in (0, 1, 255, 256, 257, 1000)]
    assert net.scores([text[:n] for n in (0, 1, 255, 256, 257, 1000)]).tolist() == pytest.approx(alone)
    data = np.frombuffer(text + bytes(quality.WIDTH - 1), np.uint8)
    z = np.array([sum(net.weights[k][data[i + k]] for k in range(quality.WIDTH)) for i in range(1000)])
    pooled = np.array([np.maximum(z[a : a + quality.CHUNK].max(axis=0), 0) for a in range(0, 1000, quality.CHUNK)])
    assert net.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-(np.r_[pooled.mean(axis=0), pooled.max(axis=0)] @ net.out + net.bias))), rel=1e-4)


def shingles(t, n=5):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    return {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else set()


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_containment(spark, docs, none, block):
    base = TEXTS[9].split()
    items = [(0, " ".join(base[500:540])), (1, ", ".join(base[10:40]) + " " + prose(6)), (2, prose(30)), (3, None), (4, ""), (5, "Two Words!"), (6, " ".join(base[5:12])), (7, " ".join(base[100:130]) + " " + prose(12)), (8, TEXTS[12])]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in items:
        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        n = min(5, len(w))
        s = shingles(t, n) if n else set()
        want |= {(str(r[0]), i) for r in ROWS if s and len(s & shingles(r[1], n)) >= 0.8 * len(s)}
    got = decontaminate.search(docs, df, block_bytes=block).collect()
    assert {(str(r.doc_id), r.item_id) for r in got} == want
    held = {x for x, _ in want}
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, df, block_bytes=block).collect()) == sorted(str(r[0]) for r in ROWS if str(r[0]) not in held)
    assert decontaminate.search(none, df).count() == 0 and decontaminate.search(docs, df.limit(0)).count() == 0


def test_extra_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "the cat", "en", "s", 7, "x", 2, "y", "z")], SCHEMA + ", fp string, _id int, _n string, c0 string")
    assert langid.keep_identified(df).columns == decontaminate.clean(df, spark.createDataFrame([(1, "q")], "item_id long, text string")).columns == df.columns
    assert json.dumps(sorted(secrets.redact(df).columns)) == json.dumps(sorted(df.columns))
    for op in (simhash.op2, substrings.op4, matroska.op5, pii.op6, secrets.op8, langid.op9):
        assert op(df).count() == 1


def test_components_drop_the_shuffle_files_of_earlier_rounds(spark):
    import time

    from scopeframe.llm.components import components
    from scopeframe.llm.runtime import prepare, release

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    prepare(spark)
    links = spark.range(0, 300, numPartitions=4).selectExpr("id AS a", "id + 1 AS b").checkpoint()
    release(spark)
    time.sleep(2)
    before = files()
    found = components(links)
    end = time.time() + 5
    while (most := files() - before) > 100 and time.time() < end:
        time.sleep(0.2)
    assert found.where("root = 0").count() == 300
    assert most <= 100


def test_few_links_are_joined_in_few_tasks(spark):
    """Every task leaves its lines in Spark's event log, so what a small table costs is its tasks."""
    from scopeframe.llm.components import components
    from scopeframe.llm.runtime import prepare

    prepare(spark)
    links = spark.range(0, 300, numPartitions=4).selectExpr("id AS a", "id + 1 AS b").checkpoint()
    context, status = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("few-links", "components")
    found = components(links).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in status.getJobIdsForGroup("few-links") for s in status.getJobInfo(j).stageIds}
    assert sum(x.numCompletedTasks for s in stages if (x := status.getStageInfo(s))) <= 40
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(1, 301)}


@pytest.mark.parametrize("few", [0, 60, 1 << 20])
def test_components_by_rounds_and_at_once(spark, monkeypatch, few):
    """Against brute force, on links of random graphs, a large star, a chain and none, by rounds alone, by rounds and then one task, by one task."""
    from scopeframe.llm import components as module
    from scopeframe.llm.runtime import prepare

    prepare(spark)
    monkeypatch.setattr(module, "FEW", few)
    r = np.random.default_rng(few)
    graph = np.sort(r.integers(-200, 200, (150, 2)), axis=1)
    links = {(int(a), int(b)) for a, b in graph if a < b} | {(1000 + i, 1050) for i in range(50)} | {(2000 + i, 2001 + i) for i in range(40)}
    for rows in (links, set()):
        up = {x: x for link in rows for x in link}
        while any(up[a] != up[b] for a, b in rows):
            for a, b in rows:
                up[a] = up[b] = min(up[a], up[b])
        df = spark.createDataFrame(sorted(rows), "a long, b long").repartition(3)
        got = [(x.node, x.root) for x in module.components(df).collect()]
        assert len(got) == len(set(got)) and set(got) == {(x, y) for x, y in up.items() if x != y}
