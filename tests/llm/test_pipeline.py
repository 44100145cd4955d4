import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from oracle import compare, connect
from tripweave.llm import bytebpe, language, mixing, quality, simhash
from tripweave.llm.common import written
from tripweave.llm.queries import ORACLE, QUERIES
from tripweave.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER) == ""


def test_all_dealt_queries_are_registered():
    assert sorted(name.split("_")[0] for name in QUERIES) == sorted([f"op{n}" for n in range(1, 14)] + ["pipeline"])


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and what each stage makes of its predecessor's rows."""
    docs, out = read_table(spark, FOLDER, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_every_stage_decides_on_all_rows_of_the_one_before(spark, stages):
    docs, good, spoken, single, mixed, encoded = stages
    assert all(stage.columns == docs.columns for stage in stages[:5])
    judged = quality.judge_documents(docs, quality.fit(docs, read_table(spark, FOLDER, "labels")))
    assert ids(good) == ids(judged.filter("kept"))
    named = language.predict_documents(good, language.fit(language.learning_part(good)))
    assert ids(spoken) == ids(named.filter("lang_pred <> 'und'"))
    assert ids(single) == ids(simhash.near_duplicates(spoken).filter("doc_id = component_id"))
    copies = {r.doc_id: r.copies for r in mixing.mix_counts(single).collect()}
    assert Counter(ids(mixed)) == Counter({i: n for i, n in copies.items() if n})
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    want = []
    for r in mixed.collect():
        tokens = np.array(library.encode_ordinary(r.text), "<u4").tobytes()
        want.append((r.doc_id, len(tokens) // 4, hashlib.sha256(tokens).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in encoded.collect()) == sorted(want)


def test_run_gives_the_rows_of_the_last_stage(spark, stages, rows):
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(stages[-1])


def test_documents_that_read_well_stay(spark, stages):
    docs, good = stages[0], stages[1]
    trusted = read_table(spark, FOLDER, "labels").filter("quality = 1")
    long_enough = docs.join(trusted, "doc_id").join(
        quality.judge_documents(docs, quality.ratio_of_counts(np.zeros(2), np.zeros(2))).filter("NOT base_failed").select("doc_id"), "doc_id")
    assert set(ids(long_enough)) <= set(ids(good))


def test_odd_documents_pass_through_every_stage(spark, tmp_path, documents, nasty):
    folder = str(tmp_path)
    documents(nasty + nasty[:4], [*range(len(nasty)), None, None, 1, 1]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = read_table(spark, folder, "documents")
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() >= 0 and stage(spark, docs.limit(0), folder).count() == 0
