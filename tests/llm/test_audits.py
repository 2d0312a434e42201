"""Filter audit, de Bruijn repeats and source divergence against plain Python and SQL, with odd rows and both paths."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
PASSAGE = " ".join(f"common{i}" for i in range(45))
ROWS = [
    (7, "first copy " + PASSAGE + " end", "en", "a"),
    (3, "another start of it " + PASSAGE + " and another end", "en", "b"),
    (3, "another start of it " + PASSAGE + " and another end", "en", "b"),
    (5, "x " + PASSAGE + " y " + PASSAGE + " z", None, None),
    (5, "the same id " + PASSAGE + " with another text", "fr", "a"),
    (None, PASSAGE, "en", "a"),
    (None, PASSAGE, "en", None),
    (2, None, None, "c"),
    (None, None, "en", "c"),
    (1, "", "en", "c"),
    (9, LONG, "en", "a"),
    (8, LONG, "en", "b"),
    (11, "word " * 500, "fr", "a"),
    (10, "word " * 60, "fr", "b"),
    (12, " \t\n ÄÖ ü K ＡＢ a b #1 ", "de", "ä"),
    (13, "###", "de", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = ("ord", "ver", "n", "key", "id", "part", "mask", "term", "slot", "sha", "at", "marks", "cuts", "shard", "value", "batch")
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_de_bruijn_repeats", "op13_source_divergence"])
def test_query_equals_sql(spark, folder, name):
    from compare import check, connect

    assert check(spark, connect(folder), folder, name)[0] is None


# -- 11


def audit_of(rows, labels):
    first = {}
    order = lambda d: (d is None, d or 0)
    for d, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", (True, 1 << 70)), order(d))
    fails = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = SPACE.findall(t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if order(d) > first[t] else set()
        q = labels.get(d, (0, 0)) if d is not None else (0, 0)
        fails.append((lang or "", f, q))
    out, shapley = {}, collections.Counter()
    for part in {p for p, *_ in fails}:
        own = [(f, q) for p, f, q in fails if p == part]
        for order_ in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order_, 1):
                here = [(f, q) for f, q in left if x in f]
                gone_before = sum(x in f for f, _ in own) - len(here)
                left = [(f, q) for f, q in left if x not in f]
                shapley[part, x] += len(here)
                out[part, "".join(order_), step] = [
                    len(left), len(here), gone_before, sum(f == {x} for f, _ in own),
                    sum(q[0] == 1 for _, q in here), sum(q[1] == 1 for _, q in here),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(7, 1, 0), (3, 1, 1), (3, 0, None), (5, None, 1), (None, 1, 1), (99, 1, 1), (9, 1, 0), (8, 0, 1)]


def labelled():
    out = {}
    for d, q, t in LABELS:
        old = out.get(d, (0, 0))
        out[d] = (max(old[0], q or 0), max(old[1], t or 0))
    return out


def test_audit_retracts(spark, odd, tmp_path):
    """Ids arrive in falling order over several micro-batches, so every later batch retracts what an earlier one counted."""
    from arealcast.llm.filter_audit import audit

    rng = random.Random(4)
    more = [(1000 - i, rng.choice(["same text " * 120, "b c d", PASSAGE]), rng.choice(["en", "fr"]), "s") for i in range(60)]
    rows = sorted(ROWS + more, key=lambda r: (r[0] is not None, -(r[0] or 0)))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = audit_of(rows, labelled())
    for batches in (1, 3, 8):
        path = f"{tmp_path}/docs-{batches}.parquet"
        for i in range(0, len(rows), 10):
            spark.createDataFrame(rows[i : i + 10], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = audit(spark, path, labels, batches)
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == want
    path = f"{tmp_path}/clash.parquet"
    odd.write.parquet(path)
    got = audit(spark, path, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == audit_of(ROWS, labelled())
    odd.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    assert audit(spark, f"{tmp_path}/none.parquet", labels.limit(0)).collect() == []


# -- 12


def repeats_of(rows, span=20):
    docs = {(d, t or "") for d, t, *_ in rows}
    order = lambda d: (1 << 63) - 1 if d is None else d
    first = {}
    for d, t in docs:
        w = SPACE.findall(t)
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            first[k] = min(first.get(k, 1 << 70), order(d))
    out = {}
    for d, t in docs:
        w = SPACE.findall(t)
        seen, gone = set(), [False] * len(w)
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            if first[k] < order(d) or k in seen:
                gone[i : i + span] = [True] * span
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, t] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted((order(d), *out[d, t or ""]) for d, t, *_ in rows)


def found(rows):
    return sorted((1 << 63) - 1 if r.doc_id is None else r.doc_id for r in rows), sorted(
        ((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows
    )


def test_repeats_odd(spark, odd):
    from arealcast.llm.debruijn import remove_repeats

    assert found(remove_repeats(odd).collect())[1] == repeats_of(ROWS)
    assert remove_repeats(odd.limit(0)).collect() == []


def test_repeats_random(spark):
    """Few words, so that paths branch everywhere; spliced, nested, periodic and overlapping copies; one hot passage."""
    from arealcast.llm.debruijn import remove_repeats

    rng = random.Random(12)
    pool = [[f"v{rng.randrange(40)}" for _ in range(rng.randrange(5, 120))] for _ in range(30)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(1, 5)):
            piece = rng.choice(pool)
            a = rng.randrange(len(piece))
            words += piece[a : a + rng.randrange(1, 80)] + [f"u{rng.getrandbits(40)}"] * (rng.random() < 0.5)
            if rng.random() < 0.1:
                words += ["x", "y", "z"][: rng.randrange(1, 4)] * 30
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(words), "en", "a"))
    rows += [(2_000_000 + i, f"a{i} {PASSAGE} b{i}", "en", "a") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(remove_repeats(df).collect())[1] == repeats_of(rows)


def test_paths_are_compacted():
    """A passage of 45 words in one piece: one path and only windows that cross its ends."""
    import numpy as np

    from arealcast.llm.debruijn import K, SPAN, paths, places

    pos, gap = np.array([3, 9, 15, 30]), np.array([6, 6, 9, 0])
    start, end = paths(pos, gap, np.array([2, 2, 2, 5]), np.array([True, True, False, False]))
    assert start.tolist() == [3, 30] and end.tolist() == [15 + K, 30 + K]
    begins, lengths = places(60, pos, start, end)
    whole = [(b, n) for b, n in zip(begins.tolist(), lengths.tolist()) if n != SPAN]
    assert whole == [] and (3, 20) in zip(begins.tolist(), lengths.tolist())
    begins, lengths = places(60, *[np.array(x) for x in ([3, 9, 15, 24], [3], [32])])
    assert (3, 29) in zip(begins.tolist(), lengths.tolist())
    assert not {b for b, n in zip(begins.tolist(), lengths.tolist()) if n == SPAN} & set(range(3, 13))


# -- 13


def divergence_of(rows):
    rows = [(lang or "", source or "", TERM.findall((t or "").translate(AZ))) for _, t, lang, source in rows]
    df = collections.Counter((lang, x) for lang, _, terms in rows for x in set(terms))
    kept = collections.defaultdict(list)
    for (lang, x), n in df.items():
        if n >= 3:
            kept[lang].append(x)
    count = collections.Counter((lang, s, x) for lang, s, terms in rows for x in terms)
    sources = collections.defaultdict(set)
    for lang, s, _ in rows:
        sources[lang].add(s)
    out = []
    for lang, names in sources.items():
        v = kept[lang]
        total = {s: sum(count[lang, s, x] for x in v) for s in names}
        p = {(s, x): 1 + 10**9 * (count[lang, s, x] + 1) // (total[s] + len(v)) for s in names for x in v}
        n = sum(total.values())
        q = {x: 1 + 10**9 * (sum(count[lang, s, x] for s in names) + 1) // (n + len(v)) for x in v}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in names:
            pairs = [(-sum(f(p[s, x], p[o, x]) for x in v), o.encode(), o) for o in names if o != s]
            terms = [(-f(p[s, x], q[x]), x.encode(), x) for x in v if count[lang, s, x] and p[s, x] > q[x]]
            out += [(lang, s, "pair", o, -m, r) for r, (m, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x, -m, r) for r, (m, _, x) in enumerate(sorted(terms), 1) if r <= 200]
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_divergence_odd(spark, odd, most):
    from arealcast.llm.divergence import divergence

    assert sorted(map(tuple, divergence(odd, most).collect())) == divergence_of(ROWS)
    assert divergence(odd.limit(0), most).collect() == []


def test_divergence_of_many_shards_and_blocks(spark, monkeypatch):
    """Ties among terms, more than 200 of them, several shards and blocks, and tasks that pass counts on early."""
    from arealcast.llm import divergence as D

    monkeypatch.setattr(D, "SHARD_TERMS", 50)
    monkeypatch.setattr(D, "CELLS", 300)
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = [f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(40))]
        rows.append((i, " ".join(words + ["hot"] * 20), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", "c"])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = divergence_of(rows)
    assert max(r[5] for r in want) == 200
    for most in (1 << 26, 0):
        assert sorted(map(tuple, D.divergence(df, most).collect())) == want


def test_perfect_hash():
    from arealcast.llm.perfect_hash import PerfectHash, build, key_hashes, shard_of

    keys = [f"term{i}".encode() for i in range(5000)]
    parts = [[] for _ in range(7)]
    for k, s in zip(keys, shard_of(key_hashes(keys)[0], 7)):
        parts[s].append(k)
    h = PerfectHash.of([build(p) for p in parts])
    slots = h.slots(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert h.keys.take(slots).to_pylist() == keys
    assert (h.slots([f"other{i}".encode() for i in range(5000)]) == -1).all()
    assert PerfectHash.of([build([])]).slots([b"x"]).tolist() == [-1]
