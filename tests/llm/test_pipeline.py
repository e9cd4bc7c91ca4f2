"""The pipeline against its stages done plainly, and every query over a whole small table."""

import hashlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fascicle.llm import decontam, queries
from tests.conftest import DATA
from tests.llm import brute


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    told = {r["doc_id"]: r["text"] for r in corpus_pipeline.STAGES[0][1](spark, docs, DATA).collect()}
    assert len(told) >= 0.98 * docs.count()
    groups = brute.jaccard(told.items())
    kept = {k: t for k, t in told.items() if groups[k][1] == k}
    masks = brute.repeated(kept.items())
    kept = {k: bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") for k, (b, gone) in masks.items()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    leaked = {k for k, t in kept.items() if any(plain(q) in plain(t) for _, q in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got.keys() == kept.keys() - leaked
    for k, r in got.items():
        ids = library.encode(kept[k], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_names():
    found = entry.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_array_dedup", "decontamination", "bpe"]
    assert decontam.BLOCK >= 1
