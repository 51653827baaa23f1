"""Small tables of documents with the awkward cases, and plain readings of the definitions."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return _WORD.findall(text or "")


def table(spark, rows, partitions=3):
    """rows of (doc_id, text); lang and source by turns, with nulls; further columns with clashing names."""
    full = [(i, t, (None, "en", "de")[k % 3], (None, "a")[k % 2], len(t or ""), "x", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()) + str(r.randint(0, 99)) for _ in range(n))


def awkward():
    """Nulls, empty and blank texts, ties, copies, near copies, a long text, signs outside the BMP."""
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (6, f" {base}\n"), (7, " ".join(near)), (8, "a b"), (9, "a b"), (10, "a  b"),
        (11, prose(2, 12000)), (12, "😀 café ▁x <|endoftext|> \x00\x1f\x85　y"), (13, "x" * 3000), (14, "one two three four five " * 30),
        (15, "### $$$ %%% a" * 20), (None, base), (None, "only here"), (16, "line one is long enough\nline one is long enough\n\nshort"), (17, "é \r\n\v\f z"),
    ]
    return rows


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
