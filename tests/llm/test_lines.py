"""Line dedup against comparing every line with every earlier one."""

import random

import numpy as np

from pathloom.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow(rows, least=20):
    at = []
    for k, t in sorted({r[:2] for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0])):
        at += [((k is None, k or 0), k, t, i, " ".join(x.lower().split())) for i, x in enumerate(t.split("\n"))]
    at = [x for x in at if x[4]]  # equal lines go at any length, near ones from ``least`` on
    gone = {}
    for i, x in enumerate(at):
        for y in at[:i]:
            if x[4] == y[4]:
                gone[x[1:4]] = "exact"
                break
        else:
            if any(len(x[4]) >= least and len(y[4]) >= least and abs(len(x[4]) - len(y[4])) <= 1 and distance(x[4], y[4]) <= 1 for y in at[:i]):
                gone[x[1:4]] = "near"
    first = {}
    for x in at:
        first.setdefault(x[4], x[1:4])
    out = []
    for k, t, *_ in rows:
        if t is None:
            out.append((k, None, 0, 0, 0))
            continue
        own = t.split("\n")
        kind = [gone.get((k, t, i)) for i in range(len(own))]
        out.append((k, "\n".join(x for x, g in zip(own, kind, strict=True) if not g), len(own), kind.count("exact"), kind.count("near")))
    return sorted(out, key=str)


def test_variants_are_the_deletions():
    for line in ("abcab", "aaaa", "é" * 3 + "x", "a"):
        deleted, placed, whole = lines.variants(line)
        for i in range(len(line)):
            assert int(deleted[i]) == lines.variants(line[:i] + line[i + 1 :])[2] if len(line) > 1 else True
        assert len(np.unique(placed)) == len(line)
        assert lines.variants(line)[2] == whole


def test_lines_against_all_pairs(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abc d") for _ in range(rnd.randint(18, 40))).strip() or "x" for _ in range(40)]

    def edit(x):
        i = rnd.randrange(len(x))
        return rnd.choice([x[:i] + "z" + x[i + 1 :], x[:i] + x[i + 1 :], x[:i] + "y" + x[i:], x, x.upper(), x[:i] + "qq" + x[i:]])

    rows = [(i, "\n".join(edit(rnd.choice(base)) for _ in range(rnd.randint(1, 6))), "x") for i in range(120)]
    boiler = "this very common line stands in a great many documents "
    rows += [(200 + i, f"{boiler}{i % 10}\nshort\n\n{boiler}", "x") for i in range(60)]
    rows += [(300, None, "x"), (301, "", "x"), (302, "\n\n", "x"), (None, base[0], "x"), (200, f"{boiler}0\nshort\n\n{boiler}", "x"), (303, "w" * 5000, "x"), (304, "w" * 5001, "x"), (305, "a tail line that differs only here " + "é" * 5, "x"), (306, "a tail line that differs only here " + "é" * 4 + "e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_near string")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == slow(rows)
    assert lines.dedup_lines(df.limit(0)).count() == 0
