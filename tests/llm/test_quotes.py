import random
import re
from collections import defaultdict

from rivulet.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, level int, thread string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def norm(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def parse(text):
    """Passages (level, lines) and the text without quotes."""
    found, last, own = [], None, []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        mark = re.match(r"(?:[ \t]{0,3}>)+[ \t]?", line)
        level, body = (mark[0].count(">"), norm(line[mark.end() :])) if mark else (0, norm(line))
        if not mark:
            own.append(line)
        if not body:
            last = None
            continue
        if last != level:
            found.append((level, []))
        found[-1][1].append(body)
        last = level
    return found, "\n".join(own).strip()


def truth(rows):
    says, parsed = defaultdict(lambda: defaultdict(list)), {}
    for c, t, _, text in rows:
        parsed[c, t] = parse(text)
        for level, lines in parsed[c, t][0]:
            if level == 0:
                for unit in {" ".join(lines[i:j]) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)}:
                    says[c][unit].append(t)
    parent = {}
    for (c, t), (found, _) in parsed.items():
        by_level = defaultdict(list)
        for level, lines in found:
            first = min(says[c].get(" ".join(lines), [t])) if level else t
            if first < t:
                by_level[level].append(first)
        if by_level:
            parent[c, t] = max(by_level[min(by_level)])
    out = {}
    for (c, t), (_, own) in parsed.items():
        at, depth = t, 0
        while (c, at) in parent:
            at, depth = parent[c, at], depth + 1
        out[c, t] = (own, parent.get((c, t)), at, depth)
    return out


def conversations():
    r, rows = random.Random(4), []
    for c in range(25):
        said = []
        for t in range(r.randint(1, 14)):
            own = [f"Message {c} {t} line {k}, {r.choice(('yes', 'no'))}!" for k in range(r.randint(1, 4))]
            text = []
            if said and r.random() < 0.7:
                _, lines = r.choice(said)
                low = r.randrange(len(lines))
                part = lines if r.random() < 0.5 else lines[low : r.randint(low + 1, len(lines))]
                if r.random() < 0.3:
                    earlier = r.choice(said)[1]
                    text += [f"> > {x}" for x in earlier]
                text += [r.choice(("> ", ">", " > ")) + x.upper() for x in part] + r.choice(([], [""]))
            rows.append((c, t, ("user", "assistant")[t % 2], "\n".join(text + own)))
            said.append((t, own))
    return rows


def test_against_brute_force(spark):
    rows = conversations()
    got = {(r.conv_id, r.turn): (r.text, r.parent, r.thread, r.depth) for r in quotes.format_chats(frame(spark, rows)).collect()}
    assert got == truth(rows)


def test_runs_of_lines_link(spark):
    own = [f"line {k} of five" for k in range(5)]
    rows = [(c, 0, "user", "hello\n\n" + "\n".join(own)) for c in range(15)]
    spans = [(i, j) for i in range(5) for j in range(i + 1, 6)]
    rows += [(c, 1, "user", "\n".join(f"> {x}" for x in own[i:j]) + "\nyes") for c, (i, j) in enumerate(spans)]
    got = [r for r in quotes.format_chats(frame(spark, rows)).collect() if r.turn == 1]
    assert len(got) == 15 and all((r.parent, r.n_quotes, r.n_linked) == (0, 1, 1) for r in got)


def test_conversation_rows(spark):
    rows = conversations()
    messages = quotes.format_chats(frame(spark, rows + rows[:3]))
    got = quotes.conversations(messages, 4).collect()
    want = {}
    for (c, t), (own, parent, thread, depth) in truth(rows).items():
        want.setdefault(c, []).append((thread, t, own))
    for c, all_ in want.items():
        parts = sorted((r.part, r.messages) for r in got if r.conv_id == c)
        assert [p for p, _ in parts] == list(range(len(parts))) and all(len(m) <= 4 for _, m in parts)
        assert [(m.thread, m.turn, m.text) for _, ms in parts for m in ms] == sorted(all_)
    first = next(r for r in got if r.conv_id == 1 and r.part == 0)
    assert first.text == "".join(m.formatted for m in first.messages)
    places = {(r.conv_id, r.place) for r in messages.collect()}
    assert places == {(c, k) for c, all_ in want.items() for k in range(len(all_))}


def test_against_sql(spark, tmp_path):
    from ..oracle import differences

    (tmp_path / "x").mkdir()
    full = conversations() + [(90, 0, None, None), (90, 1, "user", "> a\r\n>> b\rc"), (None, 1, "user", "> x"), (91, None, "user", "y"), (92, 0, "user", "p"), (92, 0, "user", "p"), (92, 1, "user", "> p\nq")]
    frame(spark, full).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(tmp_path / "x/conversations.parquet"))
    from rivulet.llm.queries import ORACLES, QUERIES

    assert differences(spark, str(tmp_path / "x"), QUERIES["op8_chat_quotes"], ORACLES["op8_chat_quotes"]) is None


def test_reply_order_puts_answers_after_what_they_answer(spark):
    got = quotes.format_chats(frame(spark, conversations())).orderBy("conv_id", "place").collect()
    seen = set()
    for r in got:
        assert r.parent is None or (r.conv_id, r.parent) in seen
        seen.add((r.conv_id, r.turn))


def test_long_chain(spark):
    rows = [(1, 0, "user", "start 0")] + [(1, t, "user", f"> start {t - 1}\nstart {t}") for t in range(1, 40)]
    got = {r.turn: (r.thread, r.depth) for r in quotes.format_chats(frame(spark, rows)).collect()}
    assert got == {t: (0, t) for t in range(40)}


def test_defined_cases(spark):
    rows = [(1, 0, "user", None), (None, 1, None, "> a"), (1, None, "user", "b"), (2, 0, "user", "> nothing\nx"), (3, 0, "user", "c"), (3, 0, "user", "c"), (3, 1, None, ">c\nd"), (4, 0, "user", "")]
    got = quotes.format_chats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.text, r.parent) for r in got if r.conv_id == 3} == {("c", None), ("d", 0)}
    assert next(r.n_quotes for r in got if r.conv_id == 2) == 1
    assert quotes.format_chats(frame(spark, rows).limit(0)).count() == 0


def test_template_and_plan(spark):
    df = quotes.format_chats(frame(spark, [(1, 0, "user", "hi")]), ("<{role}>", "</{role}>"))
    assert df.first().formatted == "<user>hi\n</user>"
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
