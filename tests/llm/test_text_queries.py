"""The registered text queries with their SQL, and the pipeline against a plain version."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from starloom.llm import bpe, decontam, quality
from starloom.llm.queries import QUERIES, SQL
from tests.compare import compare, connect
from tests.llm.test_operators import RANKS, plain_fingerprint, plain_groups


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, connect(sf_dir).execute(SQL[name]).fetchdf()) is None and len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    source = {"op1_html_text": "pages", "op8_chat": None}.get(name, "documents")
    if name in ("op9_licenses", "op10_decontamination", "op13_packing"):
        assert got.count() > 0 and "doc_id" in got.columns
    else:
        assert got.count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r.doc_id: rows[r.doc_id] for r in quality.score_documents(docs, model).collect() if r.score >= 0.3}
    groups = plain_groups(list(rows.items()))
    rows = {keep: rows[keep] for keep, _, _ in groups.values()}
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    rows = {i: rows[i] for i in ids if find(i) == i}
    plain = lambda t: re.sub(r"\s", " ", t.lower())
    items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {i for i, t in rows.items() if any(x in plain(t) for x in items)}
    tokens = bpe.read_ranks(RANKS)
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={}
    )
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(rows) - leaked
    for i, row in got.items():
        assert row.ids == known.encode_ordinary(rows[i])
        assert row.decoded_sha256 == hashlib.sha256(rows[i].encode()).hexdigest()
    assert leaked and decontam.RATE == 0.1 and corpus_pipeline.ORACLE_SQL is None
