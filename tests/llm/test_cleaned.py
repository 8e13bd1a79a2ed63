"""Texts that pass the quality rules go on without their host's repeated lines."""

import corpus_pipeline


def test_stage_removes_lines_above_the_limits(spark):
    own = lambda i: " ".join(f"{chr(97 + i % 100)}x{k}" for k in range(80))
    rows = [(i, f"All rights reserved {i % 10}\n{own(i)}\n\n tail {i % 10} ", "a") for i in range(20)]
    rows += [(100 + i, f"All rights reserved 1\n{own(100 + i)}", "b") for i in range(10)]
    rows += [(200 + i, "Read the  whole story " + " ".join(f"w{k}" for k in range(200)) + f"\n{own(200 + i)[:300]}", None) for i in range(15)]
    rows += [(300, None, "a"), (301, "short", "a")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["quality rules"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage(spark, df, "").collect()}
    # host a: the first and last lines stand in all texts (digits count as one); b has too few texts; null: depleted
    want = {i: f"{own(i)}\n" for i in range(20)} | {k: t for k, t, s in rows if s == "b"}
    assert got == {k: (t, len(t)) for k, t in want.items()}
