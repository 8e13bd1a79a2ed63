"""Winnowing against plain Python, its guarantee, and edited documents."""

import hashlib
import random
import re

import pytest
import xxhash

from pathloom.llm import winnow as w

M = 2**64 - 1


def plain(text, gram, window):
    tokens = [xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text or "")]
    if not tokens:
        return []
    turn = lambda x, r: ((x << r) | (x >> (64 - r))) & M if r else x
    grams = []
    for i in range(max(len(tokens) - gram + 1, 1)):
        h = 0
        for j, t in enumerate(tokens[i : i + gram]):
            h ^= turn(t, j)
        grams.append(h >> 33)
    out = []
    for i in range(max(len(grams) - window + 1, 1)):
        part = list(enumerate(grams[i : i + window], i))
        place, h = min(part, key=lambda p: (p[1], -p[0]))
        if not out or out[-1][0] != place:
            out.append((place, h))
    return out


def samples():
    rng = random.Random(3)
    some = [" ".join(rng.choice(["the", "of", "Straße", "日本語", "internationalization" * 3, "x", "y\n"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 40, 400)]
    return [None, "", " \n\t", *some, "a " * 300, "z" * 500, "w" * 100_000]


@pytest.mark.parametrize(("gram", "window"), [(4, 8), (1, 1), (2, 4), (8, 2)])
def test_kept_places(spark, gram, window):
    texts = samples()
    df = spark.createDataFrame([(i, t, "?", "?") for i, t in enumerate(texts)], "doc_id long, text string, kept string, `a.b` string")
    got = {r["doc_id"]: [tuple(x) for x in r["kept"]] for r in w.fingerprints(df, gram=gram, window=window).collect()}
    assert got == {i: plain(t, gram, window) for i, t in enumerate(texts)}


def test_shared_passages_leave_a_shared_hash(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(100):
        passage = [word() for _ in range(w.GRAM + w.WINDOW - 1)]
        rows += [(i, " ".join([*[word() for _ in range(rng.randint(0, 40))], *passage, *[word() for _ in range(rng.randint(0, 40))]])) for _ in range(2)]
    found = {}
    for r in w.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], []).append({x["hash"] for x in r["kept"]})
    assert all(a & b for a, b in found.values())


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    own = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for n, (i, text) in enumerate(own):
        after = own[(n + 1) % len(own)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = ({h for _, h in plain(x, w.GRAM, w.WINDOW)} for x in (text, edited, after))
        near = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        out += [(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(a, b), near(a, c))] * rows.count((i, text))
    return sorted(out, key=str)


def test_edited_documents(spark):
    rng = random.Random(2)
    rows = [(i * 7 - 50, " ".join(rng.choice(["alpha", "béta", "γ", "d"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "x"), (None, "the last of all, without a key"), (1003, rows[5][1]), *[(1004, "repeated row " * 9)] * 40]
    df = spark.createDataFrame([(i, t, 1, "?") for i, t in rows], "doc_id long, text string, n int, `a.b` string").repartition(6)
    got = w.edited_likeness(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=str) == expected(rows)
    text = {i: t for i, t in rows}
    prints = {}
    for r in got:
        prints.setdefault(r["fingerprint"], set()).add(tuple(plain(text[r["doc_id"]], w.GRAM, w.WINDOW)))
    assert all(len(x) == 1 for x in prints.values())
    one = w.edited_likeness(df.where("doc_id = 1002")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert w.edited_likeness(df.where("n > 5")).count() == 0
