import random
import re

from rivulet.llm import divergence as D

from .cases import SCHEMA, awkward, table


def plain(rows, least, top):
    """rows of (lang, source, text): shares of every kept term in every group, and their differences."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = sorted(t for t in {t for d in mine for t in d[2]} if sum(t in d[2] for d in mine) >= least)
        share = lambda words: [1 + 10**9 * (words.count(t) + 5) // (sum(words.count(x) for x in kept) + 5 * len(kept)) for t in kept]
        groups = {s: [w for d in mine if d[1] == s for w in d[2]] for s in {d[1] for d in mine}}
        p, q = {s: share(w) for s, w in groups.items()}, share([w for g in groups.values() for w in g])
        for s, words in groups.items():
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in groups if o != s]
            terms = [(a - b, t) for a, b, t in zip(p[s], q, kept) if t in words and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_awkward_rows(spark):
    docs = table(spark, awkward())
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    for least, top in ((1, 50), (2, 3), (99, 50)):
        assert got(D.divergence(docs, least, top)) == plain(rows, least, top)


def test_random_groups_with_one_hot_source_and_ties(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else f"s{r.randint(0, 5)}"
        rows.append((i, " ".join(r.choice(["Ab", "abc", "é", "ÉA", "x-y", "The", "the"]) + r.choice(["", "q", "1z"]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), source, 0, "", i))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(D.divergence(docs, 30, 5)) == plain([(x[2], x[3], x[1]) for x in rows], 30, 5)


def test_no_rows(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_in_blocks_is_one_document(spark, monkeypatch):
    text = " ".join(f"w{chr(97 + k % 26)} é" for k in range(2000))
    docs = spark.createDataFrame([(1, text, "en", "a", 0, "", 0), (2, "wa", "en", "b", 0, "", 0)], SCHEMA)
    import pyarrow as pa

    monkeypatch.setattr(D, "STEP", 64)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "source": ["a"], "text": [text]})
    found = {}
    for b in D._count([batch]):
        for row in b.to_pylist():
            n, d = found.get(row["term"], (0, 0))
            found[row["term"]] = (n + row["n"], d + row["docs"])
    words = re.findall(r"[^\W\d]+", text)
    assert found == {w: (words.count(w), 1) for w in set(words)}
    monkeypatch.undo()
    assert got(D.divergence(docs, 1)) == plain([("en", "a", text), ("en", "b", "wa")], 1, 50)


def test_share_is_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(10**15, 10**15 + 7, 3), (0, 10**15, 10**6), (123456789012345, 987654321098765, 77777), (0, 0, 4)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", D.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in df.collect())
