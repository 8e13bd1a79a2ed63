"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pathloom.llm import spelling as s


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéüÿñ×À") for _ in range(rng.randint(4, 13))) for _ in range(40)]
    words = list(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:i] + rng.choice("abxÉ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("cdyö") + w[i + 1 :]]))
    weights = [rng.choice([1, 2, 5, 20, 90]) for _ in words]
    return [(i if i else None, " ".join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(words, weights, k=rng.randint(0, 160)))) for i in range(60)]


@pytest.mark.parametrize("seed", range(3))
def test_words_forms_and_roots(spark, seed):
    rows = texts(seed) + [(70, None), (71, ""), (72, "a1b2 ,;-"), (73, "long" * 4000), (3, "abcde abcdf abcde")] + [(74, "Straße straßen strasse")] * 5
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "doc_id long, text string, word string, `a.b` string").repartition(4)
    got = {tuple(r) for r in s.spelling_variants(df).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("key_words", [1, 5])
def test_split_keys_lose_nothing(spark, key_words):
    rng = random.Random(5)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(6)) + "suffix" for _ in range(150)} | {"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(150)}
    got = {(r["word"], r["near"]) for r in s.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), key_words).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.spelling_variants(df).count() == 0
