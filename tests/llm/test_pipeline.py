import re

import pytest
from conftest import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SECRET = "api_key=Zx8Qp2Lm9Rt4Vb7Nc1Kd6Wf3"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    bench = [(1, prose(500, 30)), (2, prose(501, 8))]
    rows = [(i, prose(i, 120)) for i in range(60)]
    rows += [(100 + i, re.sub(r"^\S+", "Other", prose(i, 120))) for i in range(5)]
    rows += [(200, prose(3, 120)), (201, prose(3, 120))]
    rows += [(300 + i, " ".join(w + "###" for w in prose(300 + i, 120).split())) for i in range(8)]
    rows += [(400, prose(400, 60) + " " + prose(500, 30).upper() + " " + prose(401, 60)), (401, prose(402, 90) + " " + prose(501, 8))]
    rows += [(500, prose(502, 70) + f" {SECRET} " + prose(503, 70)), (600, "too short"), (601, None), (602, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def stages(spark, folder, tmp_path):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns, name
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs)
    return out


def test_every_stage_takes_effect(spark, folder, tmp_path):
    import sentencepiece

    from vigilake.llm.sentencepieces import MODEL

    good, single, clean, redacted, coded = stages(spark, folder, tmp_path)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) == {*range(60), *range(100, 105), 200, 201, 400, 401, 500}
    assert ids(single) == {*range(60), 400, 401, 500}
    assert ids(clean) == {*range(60), 500} == ids(redacted) == ids(coded)
    text = redacted.filter("doc_id = 500").first()
    assert SECRET not in text.text and "[SECRET]" in text.text and text.n_chars == len(text.text)
    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in redacted.collect()}
    assert all(r.token_ids == reference.encode(texts[r.doc_id]) and r.decodes for r in coded.collect())
    run = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: r.token_ids for r in run.collect()} == {r.doc_id: r.token_ids for r in coded.collect()}


def test_near_copies_of_similarity_0_8_are_dropped(spark):
    """Whatever exceeds 0.8 by brute force goes, through chains too; what is below stays."""
    import random

    rng, texts = random.Random(7), []
    for i in range(50):
        words = prose(1000 + i, rng.choice([100, 300])).split()
        texts.append(" ".join(words))
        for _ in range(2):
            for at in rng.sample(range(len(words)), len(words) // (50 if i % 2 else 30)):
                words[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    shingles = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root, near = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                near += 1
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert near > 40 and len(set(root)) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == set(root)


def test_pipeline_on_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
