"""Queries with a DuckDB counterpart, and the others against plain versions, on small tables."""

import os

import brute
import duckdb
import pytest

from conftest import DATA
from promptgov.llm import queries as Q
from promptgov.llm.oracles import oracles


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{DATA}/{file}'")
    df = Q.queries()[name](spark, DATA)
    result = duck.execute(oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.columns, df.collect()) == ordered(names, result.fetchall())


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_repeated_bytes(spark, documents):
    got = rows(Q.op2(spark, DATA), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeated_bytes([(i, t.encode()) for i, t in documents], 400))


def test_repeated_words(spark, documents):
    got = rows(Q.op5(spark, DATA), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.repeated_words([(i, t.encode()) for i, t in documents], 20))


def test_contamination(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = rows(Q.op8(spark, DATA), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(documents, items))


def test_simhash(spark, documents):
    prints = [(i, brute.fingerprint(t.encode())) for i, t in documents]
    label = brute.components(prints, 2)
    got = rows(Q.op10(spark, DATA), "doc_id", "fingerprint", "component_id")
    assert got == sorted((i, f"{f:016x}", label[i]) for i, f in prints)


def test_packing(spark, documents):
    """Ids, pieces and places: as the tokenizer says, gapless, and near the least number of sequences."""
    import zlib
    from collections import defaultdict

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, text in documents:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    found = Q.op6(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(places) <= sum(r.length for r in found) / 1024 * 1.05 + 2
