import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rivulet.llm import char_runs, exact_dedup, line_dedup, near_dedup
from rivulet.llm.components import close_enough, close_pairs, components

from .cases import awkward, prose, table, union_find, words


def test_exact(spark):
    rows = awkward() + [(20, "a b"), (20, "a b"), (21, "b a")]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for bare, members in groups.items():
        for n, m in enumerate(sorted(members)):
            want[m[3], min(members)[3], len(members), n == 0 if m[3] == min(members)[3] else False, hashlib.sha256(bare.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got) == want
    assert exact_dedup.exact_dedup(table(spark, rows).limit(0)).count() == 0


def test_exact_in_many_small_batches(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        docs = table(spark, [(k, f"t{k % 40}" + " " * (k % 7)) for k in range(400)], 4)
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    finally:
        spark.conf.set(size, before)
    keep = {c: min((k for k in range(400) if k % 40 == c), key=lambda k: (-(k % 7), k)) for c in range(40)}
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {k: (keep[k % 40], 10, k == keep[k % 40]) for k in range(400)}


def test_exact_hot_group_meets_in_few_rows(spark):
    docs = table(spark, [(k, "same text") for k in range(3000)] + [(5000 + k, f"t{k}") for k in range(50)], 16)
    rows = exact_dedup.digest_rows(docs)
    assert exact_dedup.merge_runs(rows).count() == 51
    got = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in got) == 51
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 3000} == {(0, 3000)}


def test_prob_min_hash_estimates_probability_jaccard():
    r = np.random.default_rng(4)
    value = r.integers(0, 2**63, 300, np.int64).astype(np.uint64)
    weights = r.exponential(1, (2, 300)) * (r.random((2, 300)) < 0.8)
    m = 4096
    doc, at = np.nonzero(weights)
    regs = near_dedup.prob_min_hash(doc, value[at], weights[doc, at], 2, m)
    x, y = weights
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(300) if x[i] and y[i])
    assert abs((regs[0] == regs[1]).mean() - want) < 0.03


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_truth(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (not sets[a] and not sets[b]) or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    return union_find(ids, links)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
    return " ".join(w)


def test_near_against_brute_force(spark):
    rng = random.Random(5)
    rows = [r for r in awkward() if r[0] is not None]
    for g in range(12):  # groups of near copies with few and many edits
        base = prose(100 + g, rng.choice((8, 40, 200)))
        rows += [(1000 + 50 * g + k, edited(rng, base, rng.choice((0, 0, 1, 2, 4)))) for k in range(rng.choice((2, 5, 30)))]
    rng.shuffle(rows)
    want = near_truth(rows)
    got = {r.doc_id: r for r in near_dedup.near_dedup(table(spark, rows)).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_near_defined_cases(spark):
    rows = awkward() + [(4, awkward()[3][1])]
    got = near_dedup.near_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.kept for r in got if r.doc_id is None)
    assert {r.class_id for r in got if r.doc_id in (4, 5, 6, 7)} == {4}
    assert {r.class_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert near_dedup.near_dedup(table(spark, rows).limit(0)).count() == 0


def test_near_hot_group(spark):
    rng, base = random.Random(6), prose(300, 120)
    rows = [(k, edited(rng, base, rng.choice((0, 1, 1, 2)))) for k in range(400)] + [(1000 + k, prose(400 + k, 80)) for k in range(50)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows, 8)).collect()}
    assert got == near_truth(rows)


def test_near_small_groups_in_large_buckets(spark):
    rng, passage = random.Random(11), prose(310, 100)
    rows = []
    for g in range(60):  # nearly all share one passage, which is not enough for a link; each group has an own part
        own = prose(2000 + g, 30)
        rows += [(10 * g + k, f"{passage} {own if not k else edited(rng, own, 1)}") for k in range(3)]
    want = near_truth(rows)
    assert len(set(want.values())) == 60
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows, 4), bands=8, rows=1).collect()}
    assert got == want


def test_near_documents_with_several_texts(spark):
    a, b, c = prose(21, 60), prose(22, 60), prose(23, 60)
    near = b.split()
    near[30] = "changed"
    rows = [(1, a), (1, b), (3, " ".join(near)), (4, a), (5, c), (6, c), (6, None), (7, "")]
    for n in (1, 4):
        got = near_dedup.near_dedup(table(spark, rows, n)).collect()
        assert sorted((r.doc_id, r.class_id, r.kept) for r in got) == sorted([(1, 1, True), (1, 1, True), (3, 1, False), (4, 1, False), (5, 5, True), (6, 5, False), (6, 5, False), (7, 5, False)])


def test_words_that_a_polynomial_takes_for_equal(spark):
    from .test_rules import morse

    x, y = morse(1024)
    rows = [(1, f"{x} a b c d e f g"), (2, f"{y} a b c d e f g"), (3, x), (4, y), (5, x)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows)).collect()}
    assert got == near_truth(rows) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_heavy_join_is_a_join(spark):
    from rivulet.llm.common import heavy_join

    rows = spark.createDataFrame([(k % 3 if k < 4000 else k, k) for k in range(8000)], "key long, x long")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    got = heavy_join(rows, sizes, ["key"], "n")
    assert got.count() == 8000 and got.filter("n > 1").count() == 4000 and got.select("x").distinct().count() == 8000
    assert heavy_join(rows.limit(0), sizes.limit(0), ["key"], "n").count() == 0


def test_near_with_repeated_lines(spark):
    rows = []
    for g in range(60):  # the second has a menu of 24 shingles that occurs ten times
        base, menu = prose(5000 + g, 112), prose(6000 + g, 21)
        rows += [(2 * g, base), (2 * g + 1, " ".join([base, *[menu] * 10]))]
    want = near_truth(rows)
    assert len(set(want.values())) < 120
    assert {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows)).collect()} == want


def test_components(spark):
    rng = random.Random(7)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(500, 500), (None, 3), (5, None)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == union_find({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def line_truth(rows, least=20):
    occurs = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n") if i is not None else []):
            if len(line.strip(" ")) >= least:
                occurs[line.strip(" ")].append((i, k))
    lines = sorted(occurs)
    units = [line.encode("utf-16-be") for line in lines]
    sets = []
    for u in units:
        runs = {n: {u[k : k + 2 * n] for k in range(0, len(u) - 2 * n + 1, 2)} for n, *_ in line_dedup.LENGTHS}
        sets.append({n: runs[n] for n, low, high, *_ in line_dedup.LENGTHS if runs[n] and low <= len(runs[n]) + n - 1 <= (high or 1e9)})
        assert sets[-1] or len(u) < 4
    alike = lambda x, y: any(10 * len(x[n] & y[n]) >= 8 * len(x[n] | y[n]) for n in x.keys() & y.keys())
    links = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if alike(sets[a], sets[b])]
    groups = defaultdict(set)
    for k, g in union_find(range(len(lines)), links).items():
        groups[g] |= set(occurs[lines[k]])
    return {(i, k): min(g) for g in groups.values() for i, k in g if (i, k) != min(g)}


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    pool = [prose(600 + k, 40) for k in range(25)]

    def some():
        line = rng.choice(pool)
        if rng.random() < 0.4:
            at = rng.randrange(len(line))
            line = line[:at] + "😀é"[rng.randrange(2)] + line[at + 1 :]
        return rng.choice(("", " ")) + line

    rows = awkward() + [(2000 + k, "\n".join(some() if rng.random() < 0.6 else prose(9000 + 10 * k + j, 9) for j in range(rng.randint(0, 6)))) for k in range(60)]
    got = line_dedup.line_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, k): d for r in got for k, d in zip(r.removed_lines, r.keep_doc_ids, strict=True)}
    assert found == {at: kept[0] for at, kept in line_truth(rows).items()}
    assert {r.doc_id: r.n_lines for r in got if r.doc_id in (1, 2, 16)} == {1: 0, 2: 1, 16: 4}
    assert line_dedup.line_dedup(table(spark, rows).limit(0)).count() == 0


def test_lines_small_groups_in_large_buckets(spark):
    rng, passage = random.Random(12), prose(320, 60)
    rows = []
    for g in range(60):
        own = prose(7000 + g, 18)
        rows += [(10 * g + k, f"{passage} {own if not k else edited(rng, own, 1)}") for k in range(3)]
    want = line_truth(rows)
    assert len(want) == 120
    got = line_dedup.line_dedup(table(spark, rows, 4), bands=8, rows=1).collect()
    assert {(r.doc_id, k): d for r in got for k, d in zip(r.removed_lines, r.keep_doc_ids, strict=True)} == {at: kept[0] for at, kept in want.items()}


def test_unlike_lines_in_a_bucket_are_no_pairs(spark, monkeypatch):
    """Lines with a passage in common share buckets; only those that sketches do not tell apart from another are paired."""
    passage, seen, real = prose(330, 60), [], line_dedup.verify
    rows = [(k, f"{passage} {prose(7400 + k, 50)}") for k in range(30)]
    rows += [(100 + k, text + "!") for k, text in rows[:2]]

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(line_dedup, "verify", counting)
    got = line_dedup.line_dedup(table(spark, rows, 4), bands=8, rows=1).collect()
    assert {r.doc_id: r.keep_doc_ids for r in got if r.removed_lines} == {100: [0], 101: [1]}
    assert sum(seen) <= 6  # all pairs of a bucket are some 500


def test_sets_of_many_lines_at_once():
    rng = random.Random(18)
    lines = ["".join(rng.choice("abcd \u00e9\U0001f600") for _ in range(rng.choice((0, 1, 2, 9, 20, 300, 40000, 90000)))) for _ in range(400)]
    units = pa.array([t.encode("utf-16-be") for t in lines])
    for some in (units, units.slice(3, 200)):
        for k in (2, 3, 10):
            many, sketch = char_runs.sets(some, k)
            for i, u in enumerate(some.to_pylist()):
                runs = char_runs.distinct(u, k)
                odd = np.bincount((runs >> np.uint64(16)).astype(np.intp) & 511, minlength=512) & 1
                assert many[i] == len(runs) and (np.packbits(odd.astype(np.uint8)).view(np.int64) == sketch[i]).all()


def test_lines_in_which_runs_recur(spark):
    rng = random.Random(16)
    lines = ["-" * n for n in (2, 3, 25, 60, 200, 5000)] + ["la " * n + "la" for n in (8, 30, 90)] + [". " * n + "7" for n in (9, 40)]
    lines += ["Page 3 of 10 ......", "Page 4 of 10 ......", "=", "*", "ab", "x" * 130 + "yz", "x" * 20 + "yz"] + ["".join(rng.choice("ab ") for _ in range(n)) for n in (30, 45, 100, 128, 140, 300)] + [prose(700, 300)]
    rows = [(k, line) for k, line in enumerate(lines)] + [(100 + k, line) for k, line in enumerate(lines[-4:])]
    got = {r.doc_id: r.keep_doc_ids[0] for r in line_dedup.line_dedup(table(spark, rows), least=1).collect() if r.removed_lines}
    assert got == {at[0]: kept[0] for at, kept in line_truth(rows, 1).items()}
    assert {got[k] for k in range(1, 6)} == {0} and {got[7], got[8]} == {6} and got[17] == 16 and not {12, 13, 14} & set(got)  # Page 3 and Page 4: 12 of 16 pairs


def test_lengths_that_fit():
    rng = random.Random(17)
    lines = ["".join(rng.choice("abcdefgh "[:m]) for _ in range(n)) for m in (1, 2, 4, 9) for n in (1, 2, 9, 28, 41, 127, 128, 140, 200, 700)] + [prose(k, n) for k, n in enumerate((4, 8, 12, 16, 20, 24, 60))]
    units = [t.encode("utf-16-be") for t in lines]
    got = char_runs.fitting(pa.array(units), tuple(x[:3] for x in line_dedup.LENGTHS))
    for u, fits in zip(units, got.tolist(), strict=True):
        for (k, low, high, *_), fit in zip(line_dedup.LENGTHS, fits, strict=True):
            n = len({u[i : i + 2 * k] for i in range(0, len(u) - 2 * k + 1, 2)})
            assert fit == (n > 0 and low <= n + k - 1 <= (high or 1e9)), (u.decode("utf-16-be"), k)


def test_short_lines_are_compared_too(spark):
    rows = [(1, "Read more\n\nown text"), (2, "\n Read more\nread more"), (3, "\t\nRead more"), (4, "\t\nx"), (5, "x")]
    got = {r.doc_id: (r.removed_lines, r.keep_doc_ids) for r in line_dedup.line_dedup(table(spark, rows), least=1).collect()}
    # "read more" has 7 of 8 pairs of characters in common with "Read more"
    assert got == {1: ([], []), 2: ([1, 2], [1, 1]), 3: ([1], [1]), 4: ([], []), 5: ([0], [4])}
    assert all(not r.removed_lines for r in line_dedup.line_dedup(table(spark, rows)).collect())


def test_lines_with_one_changed_character(spark):
    rng, rows = random.Random(13), []
    for n in range(20, 101):  # without repeated characters nearby, so that no run occurs twice
        line = "".join(chr(0x4E00 + 200 * n + k) for k in range(n))
        at = rng.randrange(n)
        rows += [(10 * n, line), (10 * n + 1, line[:at] + "#" + line[at + 1 :])]
    got = {r.doc_id: r.keep_doc_ids for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert {i for i, k in got.items() if k} == {i for i, _ in rows if i % 2}
    assert all(got[i] == [i - 1] for i in got if i % 2)


def test_lines_linked_in_one_of_their_ranges(spark):
    line = "".join(chr(0x4E00 + k) for k in range(40))  # two changes: 35 of 43 runs of two, 32 of 44 of three
    rows = [(1, "own line of the first text"), (2, line), (3, line), (4, line[:10] + "#" + line[11:30] + "#" + line[31:]), (5, line)]
    got = {r.doc_id: (r.removed_lines, r.keep_doc_ids) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == {1: ([], []), 2: ([], []), 3: ([0], [2]), 4: ([0], [2]), 5: ([0], [2])}


def test_line_bands_recall_of_short_lines(spark):
    rng, rows = random.Random(14), []
    for g in range(4000):  # 18 of 22 runs in common, 0.82 of similarity
        line = [chr(0x4E00 + rng.randrange(20000)) for _ in range(21)]
        other = line[:10] + [chr(0x4E00 + rng.randrange(20000))] + line[11:]
        rows += [(2 * g, "".join(line)), (2 * g + 1, "".join(other))]
    units = [pa.array([t.encode("utf-16-be") for i, t in rows if i % 2 == end]) for end in (0, 1)]
    _, _, _, bands, in_band = line_dedup.LENGTHS[0]
    same = char_runs.keys(units[0], 2, bands, in_band) == char_runs.keys(units[1], 2, bands, in_band)
    assert (~same.any(axis=1)).sum() <= 8
    agree = char_runs.registers(units[0], 2, 30) == char_runs.registers(units[1], 2, 30)
    runs = [[{t[k : k + 2] for k in range(20)} for i, t in rows if i % 2 == end] for end in (0, 1)]
    assert abs(agree.mean() - sum(len(x & y) / len(x | y) for x, y in zip(*runs, strict=True)) / 4000) < 0.01


def test_runs_of_long_and_many_lines():
    rng = random.Random(15)
    lines = ["".join(rng.choice("abcd \u00e9\U0001f600") for _ in range(rng.choice((20, 60, 300, 40000)))) for _ in range(60)]
    units = pa.array([t.encode("utf-16-be") for t in lines])
    for k in (2, 3, 10):
        together = char_runs.registers(units, k, 7)
        for n, u in enumerate(units.to_pylist()):
            assert (together[n] == char_runs.registers(pa.array([u]), k, 7)[0]).all()
            assert len(char_runs.distinct(u, k)) == len({u[i : i + 2 * k] for i in range(0, len(u) - 2 * k + 1, 2)})
    sliced = char_runs.registers(units.slice(5, 9), 3, 7)
    assert (sliced == char_runs.registers(units, 3, 7)[5:14]).all()


def test_without_lines(spark):
    rows = [(1, "a shared line that is long enough\nown"), (2, "x\na shared line that is long enough\ny"), (3, None), (None, "a shared line that is long enough")]
    docs = table(spark, rows)
    got = line_dedup.without_lines(docs, line_dedup.line_dedup(docs))
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, rows[0][1]), (2, "x\ny"), (3, None), (None, rows[3][1])}


def test_sketches_rule_out_no_link(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[: n - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        links = both >= 0.8 * (len(np.unique(a)) + len(np.unique(b)) - both)
        words = [[int(w) for w in char_runs.parities(np.unique(x))] for x in (a, b)]
        rows.append((len(np.unique(a)), len(np.unique(b)), bool(links), *words[0], *words[1]))
    names = [f"{end}{w}" for end in "ab" for w in char_runs.WORDS]
    table = spark.createDataFrame(rows, "na long, nb long, links boolean, " + ", ".join(f"{c} long" for c in names))
    may = close_enough([F.col(c) for c in names[:4]], [F.col(c) for c in names[4:]], F.col("na"), F.col("nb"), 0.8)
    got = table.select("links", may.alias("may")).collect()
    assert all(r["may"] for r in got if r["links"])
    assert 0 < sum(r["links"] for r in got) < len(got) and any(not r["may"] for r in got)
    assert char_runs.parities(np.zeros(0, np.uint64)).tolist() == [0, 0, 0, 0]


def test_large_buckets_are_compared_in_blocks(spark):
    """All close pairs of two components and no others, however a bucket is cut; elements are not dealt."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: int(rng.integers(30, 60))], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)))) for _ in range(90)]
    words = [char_runs.parities(x) for x in sets]
    sketches = spark.createDataFrame([(k, 3, len(x), *[int(w) for w in words[k]]) for k, x in enumerate(sets)], "node long, kind int, n long, " + ", ".join(f"{w} long" for w in char_runs.WORDS))
    parts = [k % 7 for k in range(90)]
    members = spark.createDataFrame([(key, size, k, parts[k], parts[k] != 0) for key, size in ((1, 90), (2, 40)) for k in range(size)], "key long, size long, node long, component long, rest boolean")

    def close(x, y):
        n = len(sets[x]) + len(sets[y])
        return min(len(sets[x]), len(sets[y])) >= 0.8 * max(len(sets[x]), len(sets[y])) - 1e-9 and 1.8 * sum(int(a ^ b).bit_count() if a ^ b >= 0 else int((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(map(int, words[x]), map(int, words[y]), strict=True)) <= 0.2 * n + 1e-9

    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if parts[a] != parts[b] and close(a, b)}
    assert 0 < len(want) < 3000
    for most in (4096, 16):
        got = [(r.a, r.b) for r in close_pairs(members, sketches, 0.8, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_registers_from_one_hash_of_each_run():
    rng, some = random.Random(19), "abcdefghijklmnopqrstuvwxyz é"
    lines = ["".join(rng.choice(some) for _ in range(rng.choice((99, 300, 40000)))) for _ in range(300)]
    others = [line[: len(line) // 2] + "#" + line[len(line) // 2 + 1 :] for line in lines]
    sides = [pa.array([t.encode("utf-16-be") for t in side]) for side in (lines, others)]
    many, sketch, least = char_runs._sets(sides[0], 10, 30, True)
    for i, u in enumerate(sides[0].to_pylist()):
        runs = char_runs.distinct(u, 10) >> np.uint64(16)
        bins = (runs >> np.uint64(16)) * np.uint64(30) >> np.uint64(32)
        assert least[i].tolist() == [int(min(runs[bins == b], default=0xFFFFFFFFFFFF)) for b in range(30)]
    assert (many == char_runs.sets(sides[0], 10)[0]).all() and (sketch == char_runs.sets(sides[0], 10)[1]).all()
    both = [{t[k : k + 10] for k in range(len(t) - 9)} for t in lines], [{t[k : k + 10] for k in range(len(t) - 9)} for t in others]
    want = sum(len(x & y) / len(x | y) for x, y in zip(*both, strict=True)) / 300
    assert abs((least == char_runs._sets(sides[1], 10, 30, False)[2]).mean() - want) < 0.02


def test_wide_sketches_tell_large_sets_apart(spark):
    """Lines just under the similarity are no pairs, though the slots of narrow sketches are too few to show that."""
    rng, some = random.Random(20), "abcdefghijklmnopqrstuvwxyz "
    base = [rng.choice(some) for _ in range(1200)]

    def changed(n):
        line = list(base)
        for at in range(15, 15 + 25 * n, 25):
            line[at] = chr(0x4E00 + rng.randrange(20000))
        return "".join(line)

    lines = [*[changed(17) for _ in range(40)], "".join(base), changed(4)]  # 40 that have some 0.74 in common, and a link
    units = [t.encode("utf-16-be") for t in lines]
    many, words = char_runs.sets(pa.array(units), 10)
    sketches = spark.createDataFrame([(k, 10, int(n), *map(int, w)) for k, (n, w) in enumerate(zip(many, words, strict=True))], "node long, kind int, n long, " + ", ".join(f"{w} long" for w in char_runs.WIDE))
    members = spark.createDataFrame([(1, 42, k, k, k > 0) for k in range(42)], "key long, size long, node long, component long, rest boolean")
    wide = char_runs.wide_sketches(spark.createDataFrame([(k, 10, u) for k, u in enumerate(units)], "node long, kind int, units binary"))
    sets = [set(char_runs.distinct(u, 10).tolist()) for u in units]
    links = {(a, b) for a in range(42) for b in range(a + 1, 42) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    narrow, got = [{(r.a, r.b) for r in close_pairs(members, sketches, 0.8, most, wide=w).collect()} for most, w in ((4096, None), (16, wide))]
    assert links <= got <= narrow and (40, 41) in links
    assert len(got) <= len(links) + 20 < 400 < len(narrow)
