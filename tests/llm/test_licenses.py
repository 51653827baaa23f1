import re

from rivulet.llm import licenses

from .cases import awkward, prose, table


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def truth(rows, templates):
    known = {k: shingles(t) for k, t in templates.items()}
    return {(i, k) for i, t in rows for k, s in known.items() if s and len(s & shingles(t)) >= 0.8 * len(s)}


APART = {k: v for k, v in licenses.TEMPLATES.items() if k in ("MIT/text", "Apache-2.0/notice", "MIT/statement", "CC-BY-NC-4.0/statement", "BSD-3-Clause/clause", "Unlicense/text")}


def documents():
    rows = [r for r in awkward() if r[0] is not None]
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        w[len(w) // 2 : len(w) // 2] = ["changed"] if len(w) > 40 else []
        rows += [(100 + k, text), (200 + k, f"{prose(k, 300)}\n{text.upper()}\n{prose(k + 50, 300)}"), (300 + k, " ".join(w)), (400 + k, " ".join(text.split()[: len(text.split()) // 2]))]
    rows.append((500, "\n\n".join(licenses.TEMPLATES.values())))
    rows.append((501, f"{prose(9, 20000)} {licenses.TEMPLATES['MIT/text']}"))
    return rows


def test_against_brute_force(spark):
    rows = documents()
    got = licenses.license_scan(table(spark, rows), APART).collect()
    assert {(r.doc_id, r.template) for r in got} == truth(rows, APART)
    assert all(0.8 <= r.containment <= 1 for r in got)


def test_the_best_of_overlapping_templates_stays(spark):
    got = {}
    for r in licenses.license_scan(table(spark, documents())).collect():
        got.setdefault(r.doc_id, set()).add(r.template)
    names = list(licenses.TEMPLATES)
    for k, name in enumerate(names):
        assert name in got[100 + k] and name in got[200 + k]
    assert got[100 + names.index("GPL-3.0/notice")] == {"GPL-3.0/notice"}


def test_stretched_texts_at_all_offsets(spark):
    text = " ".join(licenses.TEMPLATES["Apache-2.0/notice"].split()[:68])  # 64 shingles
    half = text.split()
    rows = [(k, f"{prose(k, k)} {' '.join(half[:34])} {prose(90 + k, 70)} {' '.join(half[34:])} {prose(200 + k, 40)}") for k in range(0, 64, 2)]
    pages = [(1000 + k, " ".join(f"{x} {prose(300 + j, 60)}" for j, x in enumerate(" ".join(half[i : i + 17]) for i in range(0, 68, 17)))) for k in range(3)]
    got = licenses.license_scan(table(spark, rows + pages), {"A": text}, containment=0.7).collect()
    assert {r.doc_id for r in got} == {i for i, t in rows + pages if len(shingles(t) & shingles(text)) >= 0.7 * len(shingles(text))}
    assert {r.doc_id for r in got} >= {i for i, _ in rows}


def test_whole_licenses(spark):
    names = [n for n in licenses.TEMPLATES if n.endswith("/text") and len(licenses.TEMPLATES[n]) > 5000]
    assert len(names) >= 9
    rows = [(k, f"{prose(k, 50)}\n{licenses.TEMPLATES[n]}") for k, n in enumerate(names)]
    got = {}
    for r in licenses.license_scan(table(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.template)
    assert all(n in got[k] for k, n in enumerate(names))
    assert not any(other in got[k] for k, n in enumerate(names) for other in names if other != n)


def test_place(spark):
    (r,) = licenses.license_scan(table(spark, [(1, f"one two three. {licenses.TEMPLATES['MIT/statement']} end")])).collect()
    assert (r.template, r.first_word, r.last_word, r.containment) == ("MIT/statement", 3, 7, 1.0)


def test_defined_cases(spark):
    line = licenses.TEMPLATES["Apache-2.0/statement"]
    rows = awkward() + [(None, line), (None, line), (7, line), (7, line)]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in licenses.license_scan(table(spark, rows)).collect()) == [(False, 7), (False, 7), (True, 0), (True, 0)]
    assert licenses.license_scan(table(spark, rows).limit(0)).count() == 0
