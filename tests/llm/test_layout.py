import random

import pytest

from rivulet.llm.layout import extract, render

CASES = {
    "One <b>two</b>\n three": "One two three",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div>b<div>c</div>": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>a<li value=7>b<li>c</ol>": "3. a\n7. b\n8. c",
    "<li>x</li>": "- x",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<table><tr><th>A<th>Bee<tr><td>long<td>1</table>": "A     Bee\nlong  1",
    "<table><tr><td rowspan=2>r<td>s<tr><td>t</table>": "r  s\n   t",
    "<table><tr><td rowspan=2>r<td>s<tr><td>t<tr><td>u<td>v</table>": "r  s\n   t\nu  v",
    "<table><caption>Cap</caption><tr><td>a<td>b<tr><td colspan=2>wide one</table>": "Cap\na  b\nwide one",
    "<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>": "a     d\n\nb  c",
    "<td>a<td>b</table>z": "a\nbz",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "<blockquote>q</blockquote>r": "  q\n\nr",
    "x <script>if (a<b) '</p>'</script> y": "x y",
    "<style>.n{display:none} #z{visibility:hidden} em{display:none}</style><p class='a n'>gone<p id=z>h <i style='visibility: visible'>shown</i><em>e</em>": "shown",
    "<p hidden>a</p><p style='display : none'>b</p><p style='display:none !important'>c</p>d": "d",
    "<title>t</title><p>a": "a",
    "<head><meta charset=x><title>t</title>body text": "body text",
    "<details><summary>s</summary>more</details><details open><summary>s</summary>more</details>": "s\ns\nmore",
    "<noscript>n</noscript><template>t</template><textarea> <b>x </textarea>": " <b>x",
    "a &amp; &lt;b&gt; &eacute; &#128512; &bogus; &nbsp;c": "a & <b> é 😀 &bogus; \xa0c",
    "<!-- c > --><!doctype html><?pi?>a<!-- open": "a",
    "a < b and <3": "a < b and <3",
    '<a href="x>y" title=\'">\'>link</a>': "link",
    "<a href=\"open>text": "text",
    "</p>a</div></b>b": "ab",
    "<P>UP<BR/>per</P>": "UP\nper",
    "<select><option>a<option>b</select>": "a\nb",
    "": "",
    "   \n ": "",
    "<img alt=x>": "",
    "<h1>T</h1><p>x</p><hr><p>y": "T\n\nx\n\ny",
    "<b>one</b> <i>two</i>": "one two",
    "<style>@media print{.x{display:none}} @media (max-width:600px){nav,.desktop{display:none}}</style><p class=x>a<nav>b</nav><p class=desktop>c": "a\n\nb\n\nc",
    "<style>@media screen and (min-width: 600px){.x{display:none}}</style><p class=x>a<p>b": "b",
    "<style media=print>p{display:none}</style><p>a": "a",
    "<style>@import url('a;b.css');@font-face{font-family:'p{'}@keyframes k{from{display:none}}p{color:red}</style><p>a": "a",
    "<style>@supports (display:grid){@media all{.x{display:none}}}</style><p class=x>a<p>b": "b",
    "<style>.x{display:none} .x{display:block}</style><p class=x>a": "a",
    "<style>.x{display:none}</style><p class=x style='display:block'>a": "a",
    "<style>.x{display:none!important}</style><p class=x style='display:block'>a<p>b": "b",
    "<style>#i{display:block} p.x{display:none}</style><p class=x id=i>a<p class=x>b": "a",
    "<style>div.x{display:none} .a .b{display:none} ul > li.c{visibility:hidden}</style><div class=x>g</div><p class=x>a<div class=a><i><b class=b>g</b></i>d</div><ul><li class=c>g<li>e</ul><li class=c>f": "a\n\nd\n\n- e\n\n- f",
    "<style>.a + p, .a ~ i {display:none}</style><b class=a>x</b><p>g<p>y</p><i>g</i>": "x\n\ny",
    "<style>[data-x=off], p:not(.on):first-child, a:hover {display:none}</style><b data-x=off>g</b><div><p>g<p>a</div><a href=x>b</a>": "a\n\nb",
    "<style>.md\\:hidden{display:none} .w{display:nonesense;visibility:visible}</style><p class='md:hidden'>g<p class=w>a": "a",
    "<p hidden style='display:block'>a<dialog style='display:block'>b</dialog><dialog>g</dialog>": "a\n\nb",
    "<style>body{display:none}</style><body><p>a": "",
    "<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>g</annotation></math>": "x+1",
    "a<svg><defs/><title>g</title><path d=x /><text>b</text><g><text><tspan>c</tspan></text></g>g</svg>d": "a b c d",
    "<input type=submit value=Go><input type=hidden value=g><input value=typed><input type=reset><input type=password value=g>": "Go typed Reset",
    f"<table><tr><td>{'x' * 70}<td>b<tr><td>{'y' * 60}<td>c<tr><td>z<td>d</table>": f"{'x' * 70}\n{' ' * 62}b\n{'y' * 60}  c\nz{' ' * 61}d",
}


@pytest.mark.parametrize("page", CASES)
def test_case(page):
    assert render(page) == CASES[page]


def test_deep_nesting_keeps_text():
    assert render("<div>" * 5000 + "x" + "</div>" * 5000 + "y").split() == ["x", "y"]
    assert render("<ul><li>" * 300 + "x").strip("- \n") == "x"


def test_all_visible_words_survive():
    r = random.Random(1)
    tags = "p div span b li ul ol table tr td th h1 dl dt dd pre blockquote section br".split()
    for _ in range(400):
        page, words = "", []
        for k in range(r.randint(1, 60)):
            if r.random() < 0.6:
                page += f"<{r.choice(('', '/'))}{r.choice(tags)}>"
            else:
                words.append(f"w{k}x")
                page += words[-1] + r.choice(("", " "))
        text = render(page)
        assert sorted(w for w in words if w in text) == sorted(words), page


def brute_visible(tree, rules, path=(), seen=True):
    """Words that show: every rule is tried on every element with all ways to choose its ancestors."""

    def fits(compound, node):
        tag, classes, identity = compound
        return (not tag or tag == node["tag"]) and classes <= set(node["classes"]) and (not identity or identity == node["id"])

    def matches(compounds, joins, chain):
        import itertools

        if not fits(compounds[-1], chain[-1]):
            return False
        for at in itertools.combinations(range(len(chain) - 1), len(compounds) - 1):
            places = [*at, len(chain) - 1]
            if all(fits(c, chain[k]) for c, k in zip(compounds, places)) and all(j == " " or b - a == 1 for j, a, b in zip(joins, places, places[1:])):
                return True
        return False

    out = []
    for child in tree["children"]:
        if isinstance(child, str):
            out += [child] if seen else []
            continue
        chain, found = [*path, child], []
        for order, (compounds, joins, name, value, important) in enumerate(rules):
            if matches(compounds, joins, chain):
                weight = (sum(bool(c[2]) for c in compounds), sum(len(c[1]) for c in compounds), sum(bool(c[0]) for c in compounds))
                found.append(((important, 0, weight, order), name, value))
        found += [((important, 1, (0, 0, 0), k), name, value) for k, (name, value, important) in enumerate(child["style"])]
        won = {name: value for _, name, value in sorted(found, key=lambda x: x[0])}
        if won.get("display") == "none":
            continue
        shown = seen if "visibility" not in won else won["visibility"] == "visible"
        out += brute_visible(child, rules, chain, shown)
    return out


def test_visibility_against_brute_force():
    r, n = random.Random(3), 0
    for _ in range(300):
        def compound():
            got = r.choice(("", "i", "b", "u")), {x for x in "xyz" if r.random() < 0.25}, r.choice(("", "", "", "k1", "k2"))
            return got if any(got) else ("i", set(), "")

        def said():
            name = r.choice(("display", "visibility"))
            return name, r.choice(("none", "block", "inline") if name == "display" else ("hidden", "visible")), r.random() < 0.2

        def grow(depth):
            nonlocal n
            node = {"tag": r.choice("ibu"), "classes": [x for x in "xyz" if r.random() < 0.3], "id": r.choice(("", "", "k1", "k2")), "style": [said() for _ in range(r.choice((0, 0, 0, 1, 2)))], "children": []}
            for _ in range(r.randint(1, 3)):
                n += 1
                node["children"].append(f"w{n}." if depth > 4 or r.random() < 0.5 else grow(depth + 1))
            return node

        tree = {"children": [grow(1) for _ in range(3)]}
        rules = [([compound() for _ in range(k)], [r.choice(" >") for _ in range(k - 1)], *said()) for k in (r.choice((1, 1, 2, 2, 3)) for _ in range(r.randint(0, 8)))]

        def css(c):
            return (c[0] + "".join("." + x for x in sorted(c[1])) + ("#" + c[2] if c[2] else "")) or "*"

        def page(node):
            if isinstance(node, str):
                return node + " "
            style = ";".join(f"{a}:{v}{' !important' if i else ''}" for a, v, i in node["style"])
            return f"<{node['tag']} class='{' '.join(node['classes'])}' id='{node['id']}' style='{style}'>{''.join(map(page, node['children']))}</{node['tag']}>"

        sheet = "".join(f"{css(cs[0])}{''.join(j + css(c) for j, c in zip(js, cs[1:]))}{{{a}:{v}{'!important' if i else ''}}}" for cs, js, a, v, i in rules)
        got = render(f"<style>{sheet}</style>" + "".join(map(page, tree["children"])))
        assert got.split() == brute_visible(tree, rules), sheet


def test_selectors_of_deep_trees_end():
    assert render("<style>q " + "div " * 40 + "x{display:none}</style>" + "<div>" * 250 + "<x>a</x>") == "a"


def test_query(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b", "t"), (2, "u", None, "t"), (None, None, "c", None), (1, "u", "<p>a<p>b", "t"), (3, "u", "<p>" + "word " * 50000, "t")], "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert len(got) == 5
    assert {(r.page_id, r.text[:9]) for r in got} == {(1, "a\n\nb"), (2, ""), (None, "c"), (3, "word word")}
    assert next(len(r.text.split()) for r in got if r.page_id == 3) == 50000
    assert extract(pages.limit(0)).count() == 0
