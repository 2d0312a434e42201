"""The pipeline's stages against what they have to do to planted and plain documents."""

from __future__ import annotations

import random


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_one_of_each_group_stays(spark):
    """Exact copies, near copies far above 0.8, unrelated texts, empty texts and repeated rows."""
    from arealcast.llm.simhash import keep_one_of_each

    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.getrandbits(30)}" for _ in range(n)]
    base = fresh(300)
    rows = [(10, " ".join(base)), (4, " ".join(base)), (11, " ".join(base))]
    for i in range(20):  # one word of 300 changed: similarity 0.97
        near = list(base)
        near[rng.randrange(300)] = f"x{i}"
        rows.append((100 + i, " ".join(near)))
    clean = [(200 + i, " ".join(fresh(120))) for i in range(60)]
    empty = [(300, ""), (301, None), (302, "  ")]
    again = [(400, "the same row twice"), (400, "the same row twice"), (None, "no id " + " ".join(fresh(30)))]
    docs = spark.createDataFrame(rows + clean + empty + again, "doc_id long, text string").selectExpr("*", "'x' AS fp", "'y' AS k")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted([(False, 4), (True, 0), (False, 400), *[(False, d) for d, _ in clean + empty]])
    assert keep_one_of_each(docs.limit(0)).collect() == []


def test_near_duplicates_are_those_at_four_fifths(spark):
    """Pairs of a known Jaccard similarity, texts of few shingles, repeated lines, and a hot family below 0.8."""
    from arealcast.llm.simhash import keep_one_of_each

    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    rows, want = [], []
    # (shingles, last words that differ): 0.6, 0.7, 0.79, 0.8, 0.85; 0.8 with texts of 9 shingles; just below
    kinds = [(160, 40), (170, 30), (179, 21), (270, 30), (370, 30), (9, 1), (8, 1)]
    for m, k in kinds:
        for _ in range(60):
            text, d = fresh(m + 4), len(rows)
            rows += [(d, " ".join(text)), (d + 1, " ".join(text[:-k] + fresh(k)))]
            similarity = len(shingles(rows[d][1]) & shingles(rows[d + 1][1])) / len(shingles(rows[d][1]) | shingles(rows[d + 1][1]))
            assert abs(similarity - (m - k) / (m + k)) < 1e-9
            want += [d] if 10 * (m - k) >= 8 * (m + k) else [d, d + 1]
    # A line that stands there often is one line of the set.
    line, rest = fresh(12), fresh(200)
    rows += [(5000, " ".join(rest + line)), (5001, " ".join(rest + line * 40))]
    want.append(5000)
    # Pages of one template, each with its own fifth: 0.66 to each other, and one real near copy of one of them.
    template = fresh(160)
    pages = [template + fresh(40) for _ in range(600)]
    rows += [(6000 + i, " ".join(p)) for i, p in enumerate(pages)] + [(7000, " ".join(pages[17][:-5] + fresh(5)))]
    want += [6000 + i for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in keep_one_of_each(docs).collect())
    assert kept == sorted(want), (sorted(set(want) - set(kept))[:20], sorted(set(kept) - set(want))[:20])


def test_stages_keep_columns_and_clean_documents(spark, folder):
    import corpus_pipeline
    from arealcast.llm.common import table

    docs = table(spark, folder, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    after = {r.doc_id: r.text for r in docs.collect()}
    assert set(after) < set(before)
    # No two of those that are left are nearly the same.
    left = [(d, shingles(t)) for d, t in after.items()]
    for i, (_, a) in enumerate(left):
        assert all(len(a & b) < 0.9 * len(a | b) for _, b in left[:i])
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in mixed} == set(after) and all(0 <= r.taken <= 3 * r.size for r in mixed)
