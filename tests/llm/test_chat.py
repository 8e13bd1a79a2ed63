"""Perspective rotation against rendering each dialogue in plain Python."""

import random

from pathloom.llm.chat import rotate


def slow(rows):
    out = {}
    clean = lambda s: (s or "").replace("<|", "< |")
    turns = [(c, t, r or "unknown", x) for c, t, r, x, *_ in rows]
    for c, own in {(c, n) for c, _, n, _ in turns}:
        parts = []
        for _, t, n, x in (r for r in turns if r[0] == c):
            head = "<|assistant|>\n" if n == own else f"<|user|>{clean(n)}: "
            parts.append(((t is None, t or 0, n, head + clean(x) + "<|end|>\n"), head))
        parts.sort()
        text, learned = "", []
        for (*_, n, segment), head in parts:
            if n == own:
                learned.append((len(text) + len(head), len(text) + len(segment) - 1))
            text += segment
        out[c, own] = (text, learned)
    return out


def test_rotation(spark):
    rnd = random.Random(1)
    names = ["ann", "bob", None, "<|x|>"]
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, *range(9)]), rnd.choice(names), rnd.choice([None, "", "hi <|end|>", "é" * 40, "long " * 400]), 1) for _ in range(120)]
    rows += [(9, i, names[i % 3], f"turn {i}", 1) for i in range(3000)] + [(9, 5, "ann", "again", 1)] * 2
    rows += [(10, None, "ann", f"null turn {i}", 1) for i in range(40)] + [(11, i if i else 10**15, "bob", "x" * 50_000 if i == 3 else f"outlier {i}", 1) for i in range(2000)] + [(12, -(10**17), "ann", "first", 1), (12, 10**17, "bob", "last", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int")
    got = {}
    for r in sorted(rotate(df).collect(), key=lambda r: r["start"]):
        text, learned = got.setdefault((r["conv_id"], r["perspective"]), ("", []))
        assert r["start"] == len(text) and r["length"] == len(r["segment"]) and (r["role"] == "assistant") == (r["name"] == r["perspective"])
        got[r["conv_id"], r["perspective"]] = (text + r["segment"], learned + ([(r["mask_start"], r["mask_end"])] if r["mask_start"] is not None else []))
    assert got == slow(rows)
    assert rotate(df.limit(0)).count() == 0
