import random

from quillforge.operators import grading as gr


def packed(lines, limit):
    """Parts by hand: lines in order, over-long ones carried on, escapes whole."""
    parts = []
    for line in lines:
        if parts and len(parts[-1]) + 1 + len(line) <= limit:
            parts[-1] += "\n" + line
            continue
        while line:
            end = min(limit, len(line))
            amp = line.rfind("&", 0, end)
            if amp >= 0 and ";" not in line[amp:end]:
                end = amp
            parts.append(line[:end])
            line = line[end:]
    return parts


def test_no_character_of_long_lines_is_lost(spark):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("ab&<> é\n𝒳") for _ in range(n))
    rows = [(a, i, text(rng.choice([0, 5, 30, 90, 400, 1000])), text(rng.choice([0, 10, 80])), rng.random() < 0.5) for a in range(20) for i in range(12)]
    rows += [(99, 1, "p" * 9000, "tail", True), (99, 2, "short", "x", False)]
    df = spark.createDataFrame(rows, "attempt_id int, ord int, prompt string, answer string, correct boolean")
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    for limit in (100, 3900):
        got = gr.report_parts(df, limit=limit).orderBy("attempt_id", "part").collect()
        assert max(len(r.body) for r in got) <= limit
        for a in {r[0] for r in rows}:
            lines = [f"{'+' if ok else '-'} {escape(p)}: {escape(answer)}" for k, _, p, answer, ok in rows if k == a]
            assert [r.body for r in got if r.attempt_id == a] == packed(lines, limit)


def message(head, rows, limit):
    """Parts by hand."""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    cut = lambda s, n: s if len(s) <= n else s[:n - 1] + "…"
    room, parts = limit - len(gr.REPORT_CONTINUED) - 2, [head]
    for _, ord_, answer, ok, accepted in sorted(rows, key=lambda r: r[1]):
        right = "" if ok else " / ".join(a for a in accepted or [] if a is not None) or "—"
        start = f"{'✅' if ok else '❌'} {ord_}. "
        block = start + escape(cut(answer or "—", max(32, room - len(start) - len("\n   Верно: ") - len(right))))
        if not ok:
            block += "\n   Верно: " + escape(cut(right, room // 2))
        if len(parts[-1]) + len(block) + 2 > limit:
            parts.append(gr.REPORT_CONTINUED + "\n\n" + block)
        else:
            parts[-1] += "\n\n" + block
    return parts


def test_result_messages(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("ab&<> é𝒳") for _ in range(n))
    rows = [(a, i + 1, text(rng.choice([0, 5, 90, 500])), rng.random() < 0.5, [text(rng.choice([0, 3, 200])) for _ in range(rng.randrange(3))]) for a in range(15) for i in range(9)]
    rows += [(20, 2, None, None, None), (20, 1, "x", False, [None, "y"])]
    df = spark.createDataFrame(rows, "attempt_id int, ord int, answer string, correct boolean, accepted array<string>")
    heads = spark.createDataFrame([(a, "A < B", 2, "One & two", 3, 9) for a in [*range(15), 20, 21]], "attempt_id int, title string, lesson_version int, student string, correct int, total int")
    head = f"{gr.REPORT_TITLE}\n<b>A &lt; B</b> · версия 2\nУченик: One &amp; two\nБаллы: <b>3 из 9</b>"
    for limit in (250, 3900):
        got = gr.result_report(heads, df, limit).orderBy("attempt_id", "part").collect()
        for a in [*range(15), 20, 21]:
            assert [r.body for r in got if r.attempt_id == a] == message(head, [r for r in rows if r[0] == a], limit)
    assert gr.result_report(heads.limit(0), df).count() == 0
