import os
from collections import Counter

import pytest

from runloom.llm import queries, spam, tokenizer
from tests.oracle import database, differ

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return database(DIR)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    if name in queries.SQL:
        assert not differ(df, con, queries.SQL[name])
    else:
        CHECKS[name](spark, df.collect())


def whole_splits(spark, got):
    """Every row is in a job, every job in one split, linked jobs in the same one, the shares about right."""
    runs = spark.read.parquet(f"{DIR}/test_runs.parquet").count()
    assert sum(r.rows for r in got) == runs and len({r.job for r in got}) == len(got)
    split = {r.job: r.split for r in got}
    assert all(split[a] == split[b] for a, b in map(tuple, queries.QUERIES["p1_found"](spark, DIR).collect()))
    for name, share in queries.SHARES.items():
        assert abs(sum(r.rows for r in got if r.split == name) / runs - share) < 0.02


def whole_containers(spark, got):
    tokens = {r.doc_id: r.tokens for r in tokenizer.token_counts(spark.read.parquet(f"{DIR}/documents.parquet")).collect()}
    load, seen = Counter(), Counter()
    for r in got:
        load[r.container] += r.length
        seen[r.doc_id] += r.length
    assert seen == Counter(tokens) and max(load.values()) <= queries.CAPACITY
    assert len(load) <= -(-sum(tokens.values()) // queries.CAPACITY) + 1


def more_than_one_container(spark, got):
    tokens = tokenizer.token_counts(spark.read.parquet(f"{DIR}/documents.parquet"))
    assert {r.doc_id for r in got} == {r.doc_id for r in tokens.where(f"tokens > {queries.CAPACITY}").collect()}


def equal_to_the_public_library(spark, got):
    import tokenizers

    public = tokenizers.Tokenizer.from_file(tokenizer.BYTE_BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(got) == len(texts) and all(r.ids == public.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)


def judged_by_distance(spark, got):
    assert len(got) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert {r.doc_id for r in got if r.is_spam} == {r.doc_id for r in got if r.distance > spam.FAR and r.toward > spam.TOWARD}
    found = {r.doc_id for r in queries.QUERIES["p10_found"](spark, DIR).collect()}
    assert 0 < len(found) < 0.2 * len(got) and found == {r.doc_id for r in got if r.is_spam}


def distinct_documents(spark, got):
    assert len({r.doc_id for r in got}) == len(got) > 0


CHECKS = {"p1_splits": whole_splits, "p8_ids": equal_to_the_public_library, "p9_found": more_than_one_container, "p9_containers": whole_containers, "p10_found": distinct_documents, "p10_pages": judged_by_distance}


def test_split_documents(spark):
    ids = {r.doc_id: len(r.ids) for r in queries.QUERIES["p8_ids"](spark, DIR).collect()}
    found = {r.doc_id for r in queries.QUERIES["p9_found"](spark, DIR).collect()}
    assert found == {k for k, n in ids.items() if n > queries.CAPACITY}
