"""The pipeline's stages on the smallest documents, each held against its own input."""

import collections

import corpus_pipeline
import test_core
import test_lines
from pyspark.sql import functions as F

from pathloom.llm import mixing
from pathloom.llm.common import word_count
from pathloom.llm.queries import tokenizer_path


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_each_stage(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    (_, quality), (_, lines), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES

    def stage(f, df, name):
        f(spark, df, "").write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = stage(quality, docs, "quality")
    assert kept.columns == columns
    want = {x[0] for x in test_core.slow_quality(rows(docs)) if x[7]}
    assert {r[0] for r in rows(kept)} == want and kept.count() == len(want)

    cut = stage(lines, kept, "lines")
    assert cut.columns == columns
    slow = {k: t for k, t, _, e, n in test_lines.slow([(k, t) for k, t, _ in rows(kept)]) if e + n == 0 or (t and t.split())}
    assert {k: t for k, t, _ in rows(cut)} == slow
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0

    single = stage(near, cut, "near")
    assert single.columns == columns
    ids = [r[0] for r in rows(single)]
    assert len(set(ids)) == len(ids) and set(ids) <= set(slow)

    mixed = stage(mix, single, "mix")
    assert mixed.columns == columns
    taken = collections.Counter(r[0] for r in rows(mixed))
    sized = single.select(F.col("doc_id").alias("key"), F.col("source").alias("from"), F.xxhash64("text").alias("own"), word_count(F.col("text")).alias("words"))
    plan = {r["key"]: len(r["positions"]) for r in mixing.assign(sized, "from", "words", "key").collect()}
    assert taken == collections.Counter({k: n for k, n in plan.items() if n})

    packed = pack(spark, mixed.dropDuplicates(["doc_id"]), "")
    texts = {k: t for k, t, _ in rows(mixed)}
    test_core.check_packing(packed.collect(), texts, Tokenizer.from_file(tokenizer_path()))
    assert pack(spark, mixed, "").select(F.sum("length")).first()[0] >= packed.select(F.sum("length")).first()[0]
