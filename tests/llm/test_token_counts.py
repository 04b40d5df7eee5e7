"""Token counts against the library itself."""

import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from conftest import DATA
from promptgov.llm import queries as Q
from promptgov.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "  ", "'", "'ll", "'s", "1", "é", "ß", "\n", "\t", "　", " ", "!", "...", "<|endoftext|>", "<|endoftext",
         "\U0001f600", "日本", "the", " quick", "\U00010940", "՘", "⃁", "\x1c", "\x85", "é"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return T.Vocabulary(PATH)


def texts(n=400, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def expected(library, some):
    return [len(library.encode(t, add_special_tokens=False).ids) for t in some]


@pytest.mark.parametrize("stretch, together", [(1 << 18, 100_000), (5, 7)])
def test_library(library, vocabulary, monkeypatch, stretch, together):
    monkeypatch.setattr(T, "STRETCH", stretch)
    monkeypatch.setattr(T, "TOGETHER", together)
    some = [*texts(), "", "<|endoftext|>" * 3, "a" * 3000, "ab" * 900 + " ", " \n" * 50 + "x", "x" + " " * 700]
    sizes, totals = T.Counter(vocabulary).counts(t.encode() for t in some)
    assert sizes == [len(t.encode()) for t in some] and totals == expected(library, some)


def test_forgetting(library, vocabulary, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 20)
    monkeypatch.setattr(T, "LONGEST", 3)
    monkeypatch.setattr(T, "TOGETHER", 50)
    some = texts(150, 6)
    assert T.Counter(vocabulary).counts(t.encode() for t in some)[1] == expected(library, some)


def test_one_merge_at_a_time(library, vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary.merges, "together", False)
    some = texts(60, 7)
    assert T.Counter(vocabulary).counts(t.encode() for t in some)[1] == expected(library, some)


def test_pairs_out_of_order():
    """A token that two pairs make, and a pair that comes before the one that makes its part."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = [chr(b) for b in visible] + [chr(256 + i) for i in range(256 - len(visible))]
    vocabulary = {n: i for i, n in enumerate(names)} | {"ab": 300, "bc": 301, "abc": 302}
    assert T.Merges(vocabulary, [("a", "b"), ("ab", "c")]).together
    assert not T.Merges(vocabulary, [("ab", "c"), ("a", "b")]).together
    assert not T.Merges(vocabulary, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]).together


def test_one_long_word(library, vocabulary):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(30_000))
    assert T.Counter(vocabulary).counts([text.encode()])[1] == expected(library, [text])


def test_query(spark, library):
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = Q.op13(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        n = len(library.encode(documents[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[r.doc_id].encode()), n, n > 512)


def test_edges(spark):
    schema = "doc_id long, text string, n_tokens string, __id int"
    docs = spark.createDataFrame([(None, None, "x", 1), (3, "", None, None), (3, "a b", "y", 2), (3, "a b", "y", 2)], schema)
    rows = T.count_tokens(docs, PATH)
    assert rows.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect()) == [
        (0, 0, 0, False), (3, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False)]
    assert T.count_tokens(docs.filter("false"), PATH).count() == 0


def test_other_files():
    with pytest.raises(ValueError):
        T.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
