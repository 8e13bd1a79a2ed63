"""Near-duplicates by exact similarity against comparing all pairs."""

import random

import corpus_pipeline
from pathloom.llm import simhash


def sets(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def slow(rows, least=0.8):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or len(s[i] & s[j]) >= least * len(s[i] | s[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        low[top(i)] = min(k, low.get(top(i), k))
    return {k: low[top(i)] for i, (k, _) in enumerate(rows)}


def corpus(rnd):
    words = [f"w{i}" for i in range(400)]
    hot = " ".join(rnd.choice(words) for _ in range(40))
    texts = []
    for _ in range(30):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 30, 80, 300]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 3])):
            for _ in range(rnd.choice([1, max(1, len(base) // 60)])):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            texts.append(" ".join(base))
    # one passage in very many otherwise unlike texts, and texts without words or with few
    texts += [f"{hot} {' '.join(rnd.choice(words) for _ in range(20))}" for _ in range(40)]
    texts += ["", "  ", "a b", "A b", "a b c d e", texts[0], texts[0].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_similar_texts_against_all_pairs(spark):
    rows = corpus(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df, shingle=5).collect()}
    assert got == want
    assert simhash.similar(df.limit(0), shingle=5).count() == 0


def test_stage_drops_texts_of_similarity_above_08(spark):
    rows = corpus(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow(rows)
    # some links are further apart than the 3 bits that the stage went by before
    assert any(want[k] != k and bin(simhash.fingerprint(t, 5) ^ simhash.fingerprint(rows[want[k]][1], 5)).count("1") > 3 for k, t in rows)
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, df, "").collect()} == set(want.values())
