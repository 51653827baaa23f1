import random

import numpy as np
import pyarrow as pa

from rivulet.llm import resample

from .cases import awkward, prose, table

LABELS = "doc_id long, quality int, toxic int, text string"


def junk(seed):
    return " ".join(f"{w}{random.Random(seed).choice(('!!', '%%%', '***'))}" for w in prose(seed, 50).split())


def corpus(n=400):
    rows = [(k, junk(k) if k % 5 == 0 else prose(k, 60)) for k in range(n)]
    labels = [(k, int(k % 5 != 0), 0, "x") for k in range(0, n, 2)]
    return rows, labels


def test_features_are_tokens_and_pairs():
    doc, at = resample.features(pa.array(["Ab, ab", "", "é x"]))
    assert np.bincount(doc, minlength=3).tolist() == [5, 0, 3]
    assert at[0] == at[2]  # case does not count


def test_weights_against_plain_counts(spark):
    rows, labels = corpus(60)
    docs, table_ = table(spark, rows), spark.createDataFrame(labels, LABELS)
    assert {r.doc_id for r in resample.target_ids(table_).collect()} == {i for i, q, *_ in labels if q}
    model, held_out = ({r.doc_id for r in x.collect()} for x in resample.halves(table_))
    assert not model & held_out and model | held_out == {i for i, *_ in labels} and min(len(model), len(held_out)) > 8
    good = {i for i, q, *_ in labels if q and i in model}
    raw, target = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    each = {}
    for i, t in rows:
        _, each[i] = resample.features(pa.array([t]))
        np.add.at(raw, each[i], 1)
        if i in good:
            np.add.at(target, each[i], 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in resample.resample(docs, table_).collect():
        assert r.n_grams == len(each[r.doc_id])
        assert abs(r.weight - ratio[each[r.doc_id]].sum()) < 1e-3


def test_draw_against_plain_python(spark):
    rows, labels = corpus(300)
    label_table = spark.createDataFrame(labels, LABELS)
    held_out = {r.doc_id for r in resample.halves(label_table)[1].collect()}
    for temperature, k in ((1.0, None), (50.0, 40), (1.0, 0), (1.0, 10**6)):
        got = {r.doc_id: r for r in resample.resample(table(spark, rows), label_table, temperature=temperature, k=k).collect()}
        mean = {i: r.weight / r.n_grams for i, r in got.items()}
        sides = [sorted(mean[i] for i, q, *_ in labels if i in held_out and bool(q) == side) for side in (False, True)]
        lo, hi = min(map(min, sides)), max(map(max, sides))
        step = (hi - lo) / resample.BINS
        edges = [lo + step * b for b in range(resample.BINS)]
        below = [[np.searchsorted(s, e) / len(s) for e in edges] for s in sides]  # shares of bad and of good below an edge
        divide = int(np.argmax(np.subtract(*below)))
        price = edges[min(divide, max(b for b in range(resample.BINS) if below[1][b] <= resample.LOST))]
        hashed = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in got], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id, {resample.SEED}), {1 << 52}) as h").collect()}
        key = {i: (r.weight - price * r.n_grams) / temperature - np.log(-np.log((hashed[i] + 0.5) / (1 << 52))) for i, r in got.items()}
        many = sum(r.weight >= price * r.n_grams for r in got.values()) if k is None else k
        least = sorted(key.values(), reverse=True)[many - 1] if 0 < many <= len(key) else -np.inf if many else np.inf
        assert all(abs(key[i] - r.key) < 1e-6 for i, r in got.items())
        assert {i for i, r in got.items() if r.kept} == {i for i in key if key[i] >= least}


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r.doc_id: r.kept for r in resample.resample(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i, _ in rows if i % 2]
    assert np.mean([got[i] == (i % 5 != 0) for i in held]) > 0.97


def test_kth_largest_against_sort(spark):
    r = random.Random(3)
    keys = [r.choice((0.0, 1.0, r.gauss(0, 100), 1e9 * r.random(), -1e-9 * r.random())) for _ in range(2000)]
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 2, 10, 777, 1999, 2000):
        assert resample.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_bound_on_the_target(spark):
    labels = spark.createDataFrame([(k, 1, 0, "") for k in range(50)], LABELS)
    assert resample.target_ids(labels, 7).count() == 7


def test_defined_cases(spark):
    rows, labels = awkward(), [(4, 1, 0, ""), (15, 0, 0, ""), (None, 1, 0, ""), (11, 1, None, ""), (14, None, 0, ""), (4, 1, 0, "")]
    got = resample.resample(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(r.kept is not None for r in got)
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept for r in resample.resample(table(spark, rows), none).collect())
    assert resample.resample(table(spark, rows).limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_same_draw_again(spark):
    rows, labels = corpus(100)
    run = lambda n, seed: {(r.doc_id, r.kept, round(r.key, 6)) for r in resample.resample(table(spark, rows, n), spark.createDataFrame(labels, LABELS), seed=seed).collect()}
    assert run(1, 7) == run(5, 7)
    assert run(1, 7) != run(1, 8)
