"""run() against a plain version of its stages on a small corpus."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers
from test_cases import distance
from tokenizers import Tokenizer

import corpus_pipeline


def plain(docs, items):
    def clean(text):
        words = (text or "").split()
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        return len(words) >= 10 and 100 * len(again) <= 20 * len(words) and 10 * sum(c in "#*$%&|<>" for c in text) <= len(words)

    docs = [(i, t) for i, t in docs if clean(t)]
    seen, out = [], []
    for i, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            near = len(line) >= 40 and any(abs(len(s) - len(line)) <= 2 and distance(s, line) <= 2 for s in seen)
            if len(line) >= 40:
                seen.append(line)
            if not near:
                kept.append(line)
        out.append((i, "\n".join(kept)))
    label = brute.components([(i, brute.fingerprint(t.encode())) for i, t in out], 2)
    out = [(i, t) for i, t in out if label[i] == i]
    dirty = {r[0] for r in brute.contamination(out, items) if r[5]}
    return [(i, t) for i, t in out if i not in dirty]


def test_run(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    line = lambda n=14: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 4))) for _ in range(14)]
    items = [(0, line(12)), (1, line(15))]
    texts += [texts[0], texts[1] + "x", f"{line()}\n{texts[2]}", f"{line(6)} {items[0][1]} {line(6)}", None, "", "few words", "x # y | " * 9]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, text in plain(docs, items):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, 0, len(ids), zlib.crc32(ids.tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(expected)
    assert 13 <= len(expected) < 18
