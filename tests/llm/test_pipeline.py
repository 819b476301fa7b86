"""The pipeline against a plain version on a small fixture."""

import hashlib
import importlib.util
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from test_training_operators import brute_contamination, brute_line_dedup, brute_similar, noise

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline
    from placelens.llm import quality

    clean = [" ".join(["the", "of"] + noise(300 + i, 1, 150)[0].replace("\n", " ").split() + ["and", "is"]) for i in range(25)]
    passage = "\n".join(f"shared line {i} with several words of its own" for i in range(8))
    bench = [(0, " ".join(noise(500, 1, 60)[0].split()[:30])), (1, "x y")]
    texts = [None, "", "short", "a | b | c " * 30] + clean + [x.replace(" ", "  ", 1) for x in clean[:5]] + clean[5:8]
    texts += [f"{x}\n{passage}\nthe end of {i}" for i, x in enumerate(clean[8:14])] + [f"{clean[15]} {bench[0][1]}"]
    spark.createDataFrame([(i, x, "en", f"s{i % 3}", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = {x.doc_id for x in quality.quality(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("kept").collect()}
    docs = [(i, x) for i, x in enumerate(texts) if i in kept]
    docs = [(i, y) for (i, _), (_, y) in zip(docs, brute_line_dedup([x for _, x in docs]))]
    roots = brute_similar([x for _, x in docs])
    docs = [d for n, d in enumerate(docs) if roots[n] == n]
    hits = brute_contamination([x for _, x in docs], bench)
    docs = [d for d, (words, hit, _) in zip(docs, hits) if not (hit and 20 * hit >= words)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(got) == {i for i, _ in docs}
    for i, x in docs:
        ids = library.encode(x, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()
    assert 20 < len(docs) < len(texts) - 10


def test_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_texts_of_a_similarity_of_four_fifths_are_one(spark, tmp_path):
    """Every pair of 0.8 and more on five words; texts far apart stay, whatever passage they share."""
    import corpus_pipeline

    r = random.Random(44)
    pool = [f"w{i}" for i in range(900)]
    base = [[r.choice(pool) for _ in range(400)] for _ in range(25)]
    texts = [" ".join(x) for x in base]
    for x in base:
        for edits in (1, 3, 6, 8):
            y = list(x)
            for at in r.sample(range(400), edits):
                y[at] = "edit"
            texts.append(" ".join(y))
    alone = [" ".join(base[i][:60] + [r.choice(pool) for _ in range(340)]) for i in range(25)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts + alone)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert {*range(25), *range(len(texts), len(texts) + 25)} <= got
    assert len(got) - 50 <= 5  # of a hundred copies


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, key string, row string, id int, kept int, code int"
    docs = spark.createDataFrame([(1, "the cat of it " * 9, "en", "s", 126, "clash", "k", "r", 1, 2, 3)], schema)
    spark.createDataFrame([(1, "nothing alike")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_null_and_repeated_ids_lose_no_text(spark, tmp_path):
    import corpus_pipeline

    own = [" ".join(["the", "of"] + noise(900 + i, 1, 150)[0].replace("\n", " ").split() + ["and", "is"]) for i in range(7)]
    bench = " ".join(noise(990, 1, 60)[0].split()[:30])
    rows = [(None, own[0]), (None, own[1]), (None, own[0]), (5, own[2]), (5, own[3]), (4, own[3]), (5, own[2]), (None, f"{own[4]} {bench}"), (6, own[5]), (6, f"{own[6]} {bench}"), (None, own[2])]
    docs = spark.createDataFrame([(i, x, "en", f"s{n}", len(x)) for n, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    texts_of = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    want = [(None, own[0]), (None, own[1]), (5, own[2]), (4, own[3]), (None, rows[7][1]), (6, own[5]), (6, rows[9][1])]
    assert texts_of(near) == sorted(want, key=str)
    assert texts_of(corpus_pipeline.decontaminate(spark, near, str(tmp_path))) == sorted([x for x in want if bench not in x[1]], key=str)
