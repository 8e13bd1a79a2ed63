"""Brute-force checks of the token, packing, SimHash, mixing and quality operators on small tables."""

import random
import zlib
from collections import Counter as Bag

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import bpe_count, common, mixing, packing, quality, simhash
from pathloom.llm.queries import tokenizer_path

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "the  cat\n\nsat\t\t on", "it's we'll I'd 've", "x<|endoftext|>y <|endoftext|>", "é ü ñ 12345 $$$***", "\x1c\x1d a\x85b c　d",
    " lead", "trail ", "\nnew", "a \n b", "a \t b", "a\t b c", "word " * 3000, "z" * 20000, "\U0001f600 ok", "A\r\nB\r\n", "tab\tx y", "don't\nstop 'til\n 's",
]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_counts_match_the_library(spark, library):
    rnd = random.Random(3)
    texts = ODD_TEXTS + ["".join(rnd.choice("ab c\n\t'sdé1$ \xa0") for _ in range(60)) for _ in range(300)]
    df = frame(spark, [(i, t, 5) for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens int")
    assert bpe_count.token_counts(df, tokenizer_path()).count() == 2 * len(texts)
    got = {r["doc_id"]: r for r in bpe_count.token_counts(df, tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024), repr(t)
    assert bpe_count.token_counts(df.limit(0), tokenizer_path()).count() == 0


def test_token_ids_match_the_library(library):
    tokens = packing.Tokens(tokenizer_path())
    rnd = random.Random(4)
    long = [" " * 2_000_000 + "x", "ab c  \n" * 20_000, "é" * (packing.SHORT + 1)]
    for t in ODD_TEXTS + long + ["".join(rnd.choice("ab c\n\t'sdé1$ \xa0") for _ in range(60)) for _ in range(300)]:
        assert np.frombuffer(tokens.ids(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)[:200]


def check_packing(rows, texts, library, sequence=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert all(p["length"] == sequence for p in parts[1:]) and 1 <= parts[0]["length"] <= sequence
        at = 0
        for p in parts:
            assert p["start"] == at
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by_sequence)


def test_packing_round_trip(spark, library):
    rnd = random.Random(5)
    texts = dict(enumerate(ODD_TEXTS + [" ".join(rnd.choice(["alpha", "beta", "zqx", "the"]) for _ in range(rnd.randint(1, 900))) for _ in range(200)]))
    df = frame(spark, list(texts.items()), "doc_id long, text string")
    rows = packing.pack_documents(df, tokenizer_path()).collect()
    sequences = check_packing(rows, texts, library)
    total = sum(r["length"] for r in rows)
    assert sequences <= 1.05 * -(-total // 2048) + 1
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_plan_places_every_length_without_overlap():
    rnd = random.Random(6)
    for _ in range(20):
        histogram = Bag(min(2048, max(1, int(rnd.expovariate(1 / rnd.choice([30, 300, 900]))))) for _ in range(rnd.choice([0, 1, 50, 5000])))
        fill, seen = {}, Bag()
        for n, a, b, per, first, offset in packing.plan(dict(histogram)):
            for r in range(a, b):
                seen[n] += 1
                fill.setdefault(first + (r - a) // per, []).append((offset + (r - a) % per * n, n))
        assert seen == histogram
        for places in fill.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 2048
        total = sum(n * c for n, c in histogram.items())
        if total > 2048 * 100:
            best = first_fit(histogram)
            assert len(fill) <= 1.01 * best + 1


def first_fit(histogram):
    """Number of sequences of best fit, longest first, one document at a time."""
    spaces, made = Bag(), 0
    for n in sorted(histogram.elements(), reverse=True):
        s = next((s for s in range(n, 2048) if spaces[s]), None)
        if s is None:
            made, s = made + 1, 2048
        else:
            spaces[s] -= 1
        spaces[s - n] += 1
    return made


def test_nnls_against_a_grid():
    a = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0]])
    assert np.allclose(packing.nnls(a, np.array([2.0, 3.0])) @ a.T, [2, 3])
    assert (packing.nnls(np.array([[1.0], [1.0]]), np.array([-1.0, -2.0])) == 0).all()


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(fps):
    """component of each index by comparing all pairs"""
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_simhash_text(spark):
    rnd = random.Random(7)
    base = [" ".join(rnd.choice(["a", "B", "cc", "dd", "e1", "é"]) for _ in range(80)) for _ in range(20)]
    texts = [None, "", "one", "one two", *base, *[b.replace("cc", "xx", 1) for b in base], *base[:5], "q w " * 3000]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, [(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, _x int")).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_classes(fps)
    for i, fp in enumerate(fps):
        assert got[i]["fingerprint"] == f"{fp:016x}"
        assert got[i]["component_id"] == want[i]


@pytest.mark.parametrize("block", [1024, 3])
def test_simhash_links_lose_nothing(spark, block):
    rnd = random.Random(8)
    fps = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 3, 12])):
            fps.append(x)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = frame(spark, [(x,) for x in signed], "_fp long")
    roots = {r["_node"]: r["_root"] for r in simhash.components(simhash.links(df, block=block)).collect()}
    want = slow_classes(fps)
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(want[i], set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert simhash.links(df.limit(0)).count() == 0


def test_simhash_keeps_one_of_each(spark):
    rows = [(5, "x y z w"), (3, "x y z w"), (3, "x y z w"), (9, "other words stand here now"), (None, "x y z w"), (None, "lonely null key text")]
    kept = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in simhash.one_of_each(frame(spark, rows, "doc_id long, text string")).collect())
    assert [(k, t) for _, k, t in kept] == [(3, "x y z w"), (9, "other words stand here now"), (None, "lonely null key text")]


def test_running_sums_in_small_buckets(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, "a", "b"]), i, rnd.random(), rnd.randint(0, 9)) for i in range(500)] + [("hot", i, rnd.random(), 1) for i in range(1000, 2500)]
    got = common.running_sums(frame(spark, rows, "g string, k long, p double, v long"), ["g"], "p", ["v"], ties=["k"], rows_per_bucket=7).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r["g"]]
        assert r["before_v"] == sum(x[3] for x in mine if (x[2], x[1]) < (r["p"], r["k"]))
        assert r["total_v"] == sum(x[3] for x in mine)


def fill(sizes, weights, total, passes=2):
    """targets by handing out the excess again and again"""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    rest = total
    while open_ and rest > 1e-9:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + rest * weights[s] / w >= passes * sizes[s]}
        if not full:
            for s in open_:
                target[s] += rest * weights[s] / w
            break
        for s in full:
            target[s] = float(passes * sizes[s])
        open_ -= full
        rest = total - sum(target[s] for s in sizes if s not in open_)
        for s in open_:
            target[s] = 0.0
    return target


def test_mixing_targets_and_takes(spark):
    rnd = random.Random(10)
    rows = [(i, rnd.choice([None, "a", "b", "c", "Z", "hot", "hot", "hot"]), rnd.randint(0, 300)) for i in range(3000)]
    out = mixing.assign(frame(spark, rows, "doc_id long, source string, size long"))
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    sizes = Bag()
    for _, s, n in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken = Bag()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 300
    again = mixing.assign(frame(spark, rows, "doc_id long, source string, size long").repartition(7))
    assert sorted(map(str, again.select("doc_id", "taken", "positions").collect())) == sorted(map(str, out.select("doc_id", "taken", "positions").collect()))
    order = [r["position"] for r in mixing.training_order(out).collect()]
    assert order == sorted(order) and len(order) == sum(len(r["positions"]) for r in got)
    assert mixing.assign(frame(spark, [], "doc_id long, source string, size long")).count() == 0


def test_positions_follow_the_integrated_schedules(spark):
    """Each position against integrating its source's schedule by steps; the order column against all sources' demand."""
    rnd = random.Random(12)
    rows = [(i if i % 7 else None, rnd.choice([None, "a", "b", "c", "d"]), rnd.choice([None, 0, 5, 40, 200])) for i in range(400)] + [(1, "a", 7)] * 30 + [(None, None, None)] * 3
    df = frame(spark, [(*r, "x", "y") for r in rows], "doc_id long, source string, size long, order string, taken string")
    out = mixing.assign(df)
    got = out.collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(k), str(s), n or 0) for k, s, n in rows)
    names = ["a", "b", "c", "d", None]
    turn = {s: i % len(mixing.SCHEDULES) for i, s in enumerate(names)}
    assert len({mixing.SCHEDULES[t] for t in turn.values()} - {mixing.FLAT}) >= 2
    targets = {r["source"]: r["target"] for r in got}
    grid = np.linspace(0, 1, 200_001)
    sums = []
    for schedule in mixing.SCHEDULES:
        f = np.interp(grid, *zip(*schedule, strict=True))
        area = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(grid))])
        sums.append(area / area[-1])
    parts = {s: [] for s in names}
    for r in got:
        for p, o in zip(r["positions"], r["order"], strict=True):
            parts[r["source"]].append((np.interp(p, grid, sums[turn[r["source"]]]), r["size"]))
            want = sum(targets[s] * np.interp(p, grid, sums[turn[s]]) for s in names) / sum(targets.values())
            assert abs(o - want) < 1e-6
    for s, found in parts.items():
        # in order of demand, a document's part is that of its middle in the source's stream
        at = 0
        for part, n in sorted(found):
            if n:
                assert abs(part - (at + n / 2) / targets[s]) < 1e-6
                at += n
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(n or 0 for _, _, n in rows)) <= 5 * 200
    again = mixing.assign(df.repartition(5))
    order = lambda x: sorted(map(str, x.select("doc_id", "source", "size", "taken", "positions").collect()))
    assert order(again) == order(out)
    rows = [(i, None if i % 3 else i / 400, None if i % 3 else i / 400) for i in range(400)]
    late = mixing.in_order(frame(spark, rows, "doc_id long, p double, o double"), "p", "o", "doc_id")
    assert sorted(r["doc_id"] for r in late.collect()) == list(range(400))
    assert late.select("p", F.spark_partition_id().alias("n")).where("p is null").select("n").distinct().count() == 4
    assert [r["p"] for r in late.where("p is not null").collect()] == sorted(p for _, p, _ in rows if p is not None)


def test_folded_rows_come_back(spark):
    rows = [(1, "a")] * 9000 + [(2, None)] * 3 + [(None, None)]
    got = common.unfolded(common.folded(frame(spark, rows, "k long, s string"), "test"))
    assert Bag((r["k"], r["s"]) for r in got.collect()) == Bag(rows)
    assert got.select("k", "s", "_copy").distinct().count() == len(rows)


def test_packing_of_null_and_repeated_keys(spark):
    rows = [(None, "same words here", 1)] * 3000 + [(7, "same words here", 2)] * 50 + [(7, "others", 3), (None, None, 4)]
    got = packing.pack_documents(frame(spark, rows, "doc_id long, text string, offset int"), tokenizer_path(), keep=["doc_id", "offset"]).collect()
    assert Bag(r["doc_id"] for r in got) == Bag(k for k, _, _ in rows)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_files_of_another_kind_are_refused():
    spec = {"model": {"type": "BPE", "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    bpe_count.check_kind(spec)
    for odd in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "WordPiece"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"model": {"type": "BPE", "ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe_count.check_kind(spec | odd)


def test_demand_inverse_follows_the_schedule(spark):
    knots = ((0.0, 0.0), (0.5, 2.0), (1.0, 1.0))
    df = spark.range(0, 101).select((F.col("id") / 100).alias("p")).withColumn("t", mixing.demand_inverse(F.col("p"), knots))
    for r in df.collect():
        ts = np.linspace(0, r["t"], 20001)
        area = np.trapezoid(np.interp(ts, *zip(*knots, strict=True)), ts)
        assert abs(area / 1.25 - r["p"]) < 1e-6


def slow_quality(rows):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[1-9]", "0", x.lower())).strip(" ")
    texts = {(s, t or "") for _, t, s in rows}
    docs, lines = Bag(s for s, _ in texts), Bag()
    for s, t in texts:
        for h in {norm(x) for x in t.split("\n") if word.search(x)}:
            lines[s, h] += 1
    out = []
    for i, t, s in rows:
        t = t or ""
        w = word.findall(t)
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Bag(g)
        cover = {k + d for k in range(len(g)) if n[g[k]] > 1 for d in range(3)}
        own = [x for x in t.split("\n") if word.search(x)]
        gone = sum(len(word.findall(x)) for x in own if lines[s, norm(x)] > max(10, 0.05 * docs[s]))
        bad = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(cover), bad, not bad and len(w) - gone >= 0.3 * len(w)))
    return sorted(out, key=str)


def test_quality(spark):
    rnd = random.Random(11)
    def text():
        return "\n".join(" ".join(rnd.choice("ab cd ef gh é# ij1 K l m n o p q r s t u v w x y z".split()) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 8)))
    footer = "All rights Reserved 2024 by the site " + " ".join(f"w{i}" for i in range(60))
    rows = [(i, text(), rnd.choice(["a", "b", None])) for i in range(80)] + [(100 + i, f"{footer}\nshort {i}", "a") for i in range(14)] + [(200 + i, f"{footer}\n" + " ".join(f"v{i}x{k}" for k in range(80)), "a") for i in range(4)]
    rows += [(300, None, "a"), (301, "", None), (302, " \n\t\n", "b"), (303, "rep eat ed " * 5000, "b"), (None, text(), "a"), (304, rows[0][1], rows[0][2])] + [(400 + i, "copy " * 3 + " ".join(f"c{k}" for k in range(70)), "a") for i in range(30)]
    df = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    got = sorted((tuple(r) for r in quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=str)
    want = slow_quality(rows)
    assert got == want
    assert any(not x[6] and not x[7] for x in want)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in quality.kept_documents(df).collect())
    flags = dict.fromkeys((str(x[0]) for x in want if x[7]), 1)
    assert kept == sorted((str(r[0]), r[1]) for r in rows if str(r[0]) in flags)
    assert quality.judge(df.limit(0)).count() == 0
