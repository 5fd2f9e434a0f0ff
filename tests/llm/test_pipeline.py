"""The pipeline over planted documents: every stage does its work on all that the one before kept."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from auditlake.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(20)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in "aeiou" for c in ("r", "st", "n", "ld")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    toxic = lambda t: " ".join(w + (" vile rotten" if i % 9 == 4 else "") for i, w in enumerate(t.split()))
    docs = [(i, toxic(text(40)) if i % 5 == 0 else text(60)) for i in range(500)]
    base = text(100)
    copies = [(1000 + i, base) for i in range(30)]
    near = [(1100 + i, " ".join(w if j != 3 * i + 1 else "changed" for j, w in enumerate(base.split()))) for i in range(30)]
    item = text(40)
    leaked = [(1200 + i, f"{text(50)} {item} {text(50)}") for i in range(10)]
    private = [(1300 + i, f"{text(30)} write to p{i}@mail.example.com {text(30)}") for i in range(10)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs + copies + near + leaked + private] + [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(500)], "doc_id BIGINT, toxic INT, quality INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables).cache()
        assert docs.columns == columns, name
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    toxic, plain = {i for i in range(500) if i % 5 == 0}, {i for i in range(500) if i % 5}
    assert len(ids["toxicity"] & toxic) <= 5 and len(plain - ids["toxicity"]) <= 5 and {2000, 2001, *range(1000, 1310)} - set(range(1060, 1100)) >= ids["toxicity"] - set(range(500))
    assert ids["near_duplicates"] & set(range(1000, 1130)) == {1000} and ids["toxicity"] - set(range(1000, 1130)) == ids["near_duplicates"] - {1000}
    assert ids["near_duplicates"] - ids["decontamination"] == set(range(1200, 1210)) & ids["toxicity"]
    assert ids["pii"] == ids["decontamination"]
    clean = {r.doc_id: r for r in docs.collect()}
    assert all("[EMAIL]" in clean[i].text and "@" not in clean[i].text and clean[i].n_chars == len(clean[i].text) for i in range(1300, 1310) if i in clean)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert {r.doc_id for r in mixed} <= ids["pii"] and all(0 < r.taken <= 2 * r["size"] for r in mixed)
    docs.unpersist()


def test_near_duplicates_keep_one_of_equal_rows(spark, tables):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "g h i j k l", "en", "s", 11), (2, "m n o", "en", "s", 5), (None, "p", "en", "s", 1), (None, "p", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    left = corpus_pipeline.near_duplicates(spark, docs, tables)
    assert left.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(map(str, [(1, "a b c d e f"), (1, "g h i j k l"), (2, "m n o"), (None, "p"), (None, "p")]))


def test_run_ends_in_the_mix(spark, tables):
    assert set(corpus_pipeline.run(spark, tables).columns) == {"doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_one_query_for_each_operator():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
