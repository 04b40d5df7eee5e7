"""Source divergence: perfect hashes, and the whole operator against plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from promptgov.llm import source_audit as A
from promptgov.llm.perfect_hash import PerfectHash, hashes

SCHEMA = "doc_id long, text string, lang string, source string, n string, kind int"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_perfect_hash(n):
    keys = [f"key é{i}".encode() for i in range(n)]
    made = PerfectHash.of(keys)
    again = PerfectHash(made.keys, *made.parts())
    assert sorted(again.slots(keys, hashes(keys)).tolist()) == list(range(n))
    assert [again.keys[s] for s in again.slots(keys, hashes(keys))] == keys
    others = [f"other {i}".encode() for i in range(2000)]
    assert (again.slots(others, hashes(others)) == -1).all()


def test_equal_hashes(monkeypatch):
    """Keys that no level can tell apart are listed."""
    import promptgov.llm.perfect_hash as P

    keys = [b"a", b"b", b"c", b"d"]
    same = lambda some: np.array([1 if k in (b"a", b"b") else 100 + k[0] for k in some], np.uint64)
    monkeypatch.setattr(P, "hashes", same)
    made = PerfectHash.of(keys)
    assert set(made.listed) == {b"a", b"b"}
    assert sorted(made.slots(keys, same(keys)).tolist()) == [0, 1, 2, 3]


def test_terms(monkeypatch):
    text = "One two-THREE é_ü9x  日本 \x00z" * 20
    expected = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    for stretch in (1, 3, 17, 1 << 20):
        monkeypatch.setattr(A, "STRETCH", stretch)
        assert [w.decode() for words in A.terms(text.encode()) for w in words] == expected


def test_shares():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.choice([rng.randint(1, 50), rng.randint(1, 10**15)])
        count = rng.randrange(total)
        assert A.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def plain(rows, least=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        seen[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]

        def share(count):
            total = sum(count[t] for t in kept) + len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}  # noqa: B023

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(seed=2):
    rng = random.Random(seed)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "abcdéfghij"] + ["ﬁ", "\U0001f600", "Zed"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, ""]),
             rng.choice(["s1", "s2", "s3", None, ""])) for _ in range(150)]
    rows += [("once upon", "xx", "s1"), (None, "xx", "s2"), ("", "xx", "s3"), ("alone", "yy", "s1"), (None, "en", "s9")]
    return rows + rows[:10] + [("same same", "en", "s1")] * 40


@pytest.mark.parametrize("small", [False, True])
def test_definition(spark, monkeypatch, small):
    if small:  # several shards, rounds, stretches and partial counts
        for name, value in dict(SHARD_TERMS=20, ROUND_BYTES=3000, ENTRIES=40, SLOTS=30, CELLS=16, STRETCH=50).items():
            monkeypatch.setattr(A, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, "x", 7) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = A.source_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_top_and_empty(spark):
    rows = [(f"aa bb cc dd é{i % 3}", "en", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame([(i, *r, "x", 7) for i, r in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, A.source_divergence(docs, top=1).collect())) == plain(rows, top=1)
    assert A.source_divergence(docs.filter("false")).count() == 0
    alone = docs.limit(1)
    assert A.source_divergence(alone).count() == 0


def test_rows_that_leave_the_recount(spark, monkeypatch):
    """The second pass gives a row per task, group and stretch, however many terms these have."""
    written = {}

    def watched(df, label, cut=A.cut_lineage):
        written[label] = cut(df, label)
        return written[label]

    monkeypatch.setattr(A, "cut_lineage", watched)
    text = " ".join(f"term{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(4000))
    rows = [(text + " terma" * 70_000 if i == 0 else text, "en", f"s{i % 2}") for i in range(8)]
    docs = spark.createDataFrame([(i, *r, "x", 7) for i, r in enumerate(rows)], SCHEMA).repartition(2)
    assert sorted(map(tuple, A.source_divergence(docs).collect())) == plain(rows)
    assert written["group-counts"].count() <= 2 * 2


def test_packed_counts():
    for largest in (1, 255, 256, 70_000, 1 << 40):
        slot, n = np.array([0, 5, 65_535], np.uint16), np.array([1, largest, 3])
        again = A.unpacked(slot.tobytes(), A.packed(n))
        assert again[0].tolist() == slot.tolist() and again[1].tolist() == n.tolist()
