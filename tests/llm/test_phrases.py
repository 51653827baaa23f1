import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from rivulet.llm import phrases as P

from .cases import SCHEMA, awkward, table


def plain(rows, least, top, inside=100):
    """rows of (lang, text): all runs of 1 to 5 words within pieces, counted; cuts, covers and ranks by the definition."""
    out = set()
    for lang in {r[0] for r in rows}:
        f = Counter()
        for text in (r[1] for r in rows if r[0] == lang):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
                ws = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        hidden = {w[i:j] for w, c in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * c >= inside * f[w[i:j]]}
        lines = []
        for w, a in found.items():
            if w not in hidden:
                score, k = min((1000 * a * n // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                lines.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out |= {(lang, p + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for p, x in enumerate(sorted(lines)[:top])}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def rows_of(docs):
    return [("und" if r["lang"] is None else r["lang"], r["text"] or "") for r in docs.collect()]


def test_counts_are_added_up_as_they_are_held(monkeypatch):
    monkeypatch.setattr(P, "HELD", 8)
    r = random.Random(2)
    batches = [pa.RecordBatch.from_pydict({"k": [r.choice("abcdefghij"[:m]) for _ in range(5)], "n": [r.randint(1, 4) for _ in range(5)]}) for m in (2, 2, 10, 10, 10, 1)]
    want, got = Counter(), Counter()
    for b in batches:
        for x in b.to_pylist():
            want[x["k"]] += x["n"]
    for b in P._summed(batches, ["k"]):
        for x in b.to_pylist():
            got[x["k"]] += x["n"]
    assert got == want and list(P._summed([], ["k"])) == []


@pytest.mark.parametrize("least, top, inside", [(2, 2000, 100), (5, 7, 60), (10**6, 2000, 100)])
def test_awkward_rows(spark, least, top, inside):
    docs = table(spark, awkward())
    want = plain(rows_of(docs), least, top, inside)
    assert got(P.collocations(docs, least, top, inside)) == want and bool(want) == (least < 10)


def test_hot_word_control_signs_and_ties(spark):
    r = random.Random(3)
    vocab = ["the", "The", "a\x01", "a", "b", "b\x00c", "é", "É", "\x0bx", "y\tz", "w.", "q\r\nq"]
    rows = [(i, " ".join("the" if r.random() < 0.4 else r.choice(vocab) for _ in range(r.randint(0, 60))), None if i % 3 else "en", "s", 0, "", i) for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(6)
    assert got(P.collocations(docs, 4)) == plain(rows_of(docs), 4, 2000)


def test_no_rows(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_in_blocks(monkeypatch):
    """Blocks look ahead, so that the words and suffixes of a long text are those of the text as a whole."""
    import numpy as np

    r = random.Random(8)
    text = "".join(r.choice("abc") * r.randint(1, 9) + r.choice([" ", "  ", "\t", ". ", " "]) for _ in range(1500)) + "x" * 3000 + " a b c d"
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    every = np.full(P.FILTER_BITS // 64, -1, np.int64)

    def found():
        words, suffixes = Counter(), Counter()
        for b in P._count_words([batch]):
            for x in b.to_pylist():
                words[x["word"]] += x["n"]
        for b in P._suffixes([batch], every, every, np.zeros(0, np.uint64)):
            for x in b.to_pylist():
                suffixes[x["suffix"]] += x["n"]
        return words, suffixes

    whole = found()
    monkeypatch.setattr(P, "STEP", 50)
    assert found() == whole


def test_stack_goes_on_over_batches():
    suffixes = Counter()
    r = random.Random(1)
    for _ in range(400):
        suffixes[" ".join(r.choice(["a", "ab", "b", "a\x01"]) for _ in range(r.randint(2, 5))) + " "] += r.randint(1, 3)
    rows = [{"lang": lang, "salt": -1, "suffix": s, "n": n} for lang in ("de", "en") for s, n in sorted(suffixes.items(), key=lambda x: x[0].encode(), reverse=True)]
    schema = pa.schema([("lang", pa.string()), ("salt", pa.int32()), ("suffix", pa.string()), ("n", pa.int64())])
    want = Counter()
    for x in rows:
        ws = x["suffix"].split()
        for k in range(2, len(ws) + 1):
            want[x["lang"], " ".join(ws[:k])] += x["n"]
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema) for i in range(0, len(rows), size)]
        out = [x for b in P._count_prefixes(1)([*batches, batches[0].slice(0, 0)]) for x in b.to_pylist()]
        assert len(out) == len(want) and {(x["lang"], x["phrase"]): x["n"] for x in out} == want


def test_a_suffix_is_a_row_for_each_occurrence():
    """So the rows that tasks make grow with the words, not with the distinct suffixes of a task times the tasks."""
    import numpy as np

    every = np.full(P.FILTER_BITS // 64, -1, np.int64)
    for copies in (1, 5):
        batch = pa.RecordBatch.from_pydict({"lang": ["en", None] * copies, "text": ["a b c. a b", "a b c"] * copies})
        rows = [x for b in P._suffixes([batch], every, every, np.zeros(0, np.uint64)) for x in b.to_pylist()]
        assert len(rows) == 5 * copies and {x["n"] for x in rows} == {1}
        assert Counter((x["lang"], x["suffix"]) for x in rows) == {("en", "a b c "): copies, ("en", "b c "): copies, ("en", "a b "): copies, ("und", "a b c "): copies, ("und", "b c "): copies}
