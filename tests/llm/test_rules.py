import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from rivulet.llm import rules, textvec

from .cases import awkward, prose, table, words


def counts(text):
    w, text = words(text), text or ""
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, dup, len(covered)


def test_counts_against_plain_python():
    r = random.Random(1)
    texts = [t for _, t in awkward()] + ["".join(r.choice("ab \n\t#é😀|\r\x0b") for _ in range(r.randint(0, 120))) for _ in range(500)]
    texts += ["", "\n", "a\n", "\na", "a b c d e a b c d e", "a\nb\na\n", "a \na", "x" * 20000]
    got = rules.measure_texts(pa.array([t or "" for t in texts]))
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")) == counts(t), t


def morse(n):
    """Two words whose difference is a product of (1 - x**2**k): equal under any polynomial hash modulo 2**64."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_different_texts_are_never_equal(monkeypatch):
    for n in (1024, 2048, 4096):
        a, b = morse(n)
        text = f"{a}\n{b}\n" + " ".join([a, "1", "2", "3", "4", b, "1", "2", "3", "4"])
        got = rules.measure_texts(pa.array([text]))
        assert (got["n_dup_lines"][0], got["n_repeat_words"][0]) == (0, 0)
    texts = ["a b c d e f\nb a c d e f\na b c d e f", "x y\nx y\nz y", "", "aé b c d e aé b c d e"]
    want = [counts(t) for t in texts]
    monkeypatch.setattr(rules, "hash_ranges", lambda data, start, end: (end - start).astype("uint64") % 2)
    monkeypatch.setattr(textvec, "hash_ranges", rules.hash_ranges)  # a hash that tells next to nothing
    got = rules.measure_texts(pa.array(texts))
    assert [tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")) for k in range(len(texts))] == want


def test_memory_of_a_long_text():
    import tracemalloc

    text = pa.array([" ".join(f"word{k % 99991}" for k in range(800_000))])
    size = len(text[0].as_py())
    tracemalloc.start()
    got = rules.measure_texts(text)
    assert tracemalloc.get_traced_memory()[1] < 45 * size
    tracemalloc.stop()
    assert got["n_words"][0] == 800_000


def test_sketch_quantiles_are_within_their_accuracy_and_merge(spark):
    r = random.Random(2)
    rows = [(k, "en" if k % 3 else None, f"s{k % 4}", n := r.randint(50, 400), int(n * r.lognormvariate(1.5, 0.3)), int(n * r.random() ** 4), 10, k % 3, 0) for k in range(3000)]
    stats = spark.createDataFrame(rows, rules._STATS)
    by_part = rules.sketch(stats.filter("doc_id < 1000")).unionByName(rules.sketch(stats.filter("doc_id >= 1000")))
    whole = {tuple(x) for x in rules.quartiles(rules.sketch(stats), ["lang"]).collect()}
    assert {tuple(x) for x in rules.quartiles(by_part, ["lang"]).collect()} == whole
    for row in rules.quartiles(rules.sketch(stats), ["lang"]).collect():
        expr = rules.MEASURES[row.measure][0]
        values = sorted(x.v for x in stats.filter(F.col("lang").eqNullSafe(row.lang)).select(F.expr(f"cast({expr} as double)").alias("v")).collect())
        for q, got in ((0.25, row.q25), (0.75, row.q75)):
            exact = values[max(0, -(-int(q * 1000) * len(values) // 1000) - 1)]
            assert abs(got - exact) <= 0.0101 * exact + 1e-12
        assert row.rows == len(values)


def test_verdicts(spark):
    rows = [(k, prose(k, 60)) for k in range(300)]
    rows += [(1000 + k, " ".join(f"{w}%%%" for w in prose(k, 60).split())) for k in range(20)]
    rows += [(2000 + k, "\n".join([prose(k, 4)] * 2 + [prose(k + j, 6) for j in range(4)])) for k in range(1)]
    got = {r.doc_id: r for r in rules.quality_rules(table(spark, rows)).collect()}
    assert all(got[k].kept and not got[k].base_failed for k in range(300))
    assert not any(got[1000 + k].kept for k in range(20))


def test_base_rule_and_defined_cases(spark):
    rows = awkward() + [(50, "a b c"), (4, "twice")]
    got = rules.quality_rules(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(x[k] is not None for x in got for k in ("kept", "base_failed", "n_words"))
    assert rules.quality_rules(table(spark, rows).limit(0)).count() == 0


def test_partitioning_does_not_change_verdicts(spark):
    rows = [(k, prose(k, 20 + k % 30) + " #" * (k % 9)) for k in range(400)]
    a, b = ({tuple(x) for x in rules.quality_rules(table(spark, rows, n)).collect()} for n in (1, 7))
    assert a == b
