"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from promptgov.llm import (
    decontaminate, html_text, line_dedup, pack, quality, repeats, secrets, simhash, substring_dedup, suffix_dedup, warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id string, h int"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 0) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(seed, n, pool=400):
    rng = random.Random(seed)
    return " ".join(rng.choice([f"w{i}é" for i in range(pool)]) for _ in range(n))


LONG = words(1, 30_000)
TEXTS = [None, "", " \n\t ", "one two", LONG, LONG[1000:5000] + " tail", words(2, 60), words(2, 60), "a" * 3000, "ab" * 2000]


@pytest.mark.parametrize("n", [0, len(TEXTS)])
def test_repeats(spark, n):
    data = [(i, (t or "").encode()) for i, t in enumerate(TEXTS[:n])]
    got = suffix_dedup.repeated_bytes(table(spark, TEXTS[:n]), 400).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeated_bytes(data, 400))
    got = substring_dedup.repeated_words(table(spark, TEXTS[:n]), 20).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeated_words(data, 20))


def test_crowded_anchors_as_rows(spark):
    """Anchors with many classes take the other way, with the same result."""
    passage = words(5, 22)
    texts = [f"{words(10 + i, 30)} {passage} {words(900 + i, 30)}" for i in range(40)]
    data = [(i, t.encode()) for i, t in enumerate(texts)]
    spec = substring_dedup.spec_for(20, 8)
    source = repeats.sources(table(spark, texts), "doc_id", "text")
    few, many = ({tuple(r) for hit in [repeats.repeated_windows(source, spec, hot)] for r in hit.select(
        "id", F.explode(F.sequence("first", "last"))).collect()} for hot in (2, 1000))
    assert few == many
    assert sum(1 for i, _ in few if i == 0) == 0 and len({i for i, _ in few}) == 39
    assert sum(r[2] for r in brute.repeated_words(data, 20)) > 0


def test_repeated_rows_and_null_ids(spark):
    docs = table(spark, [words(3, 40), words(3, 40), words(3, 40)], [None, 7, 7])
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.repeated_words(docs).collect()}
    assert got == {(None, 0), (7, 40)}
    labels = simhash.near_duplicates(docs).collect()
    assert {r.component_id for r in labels} == {7}
    assert [r.doc_id for r in simhash.one_of_each(docs).collect()] == [7]


def test_one_of_each(spark):
    """Null and repeated ids, equal rows, a component without ids, clashing names."""
    texts = [words(60, 50), words(61, 50), words(62, 50), words(63, 50)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[1]), (7, texts[2]), (7, texts[2]), (8, texts[2]), (9, texts[3]), (None, None), (3, "")]
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("__row", F.lit("x")).withColumn("fp", F.lit(1))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted(
        [(0, texts[0]), (7, texts[1]), (7, texts[2]), (9, texts[3]), (3, "")])
    assert simhash.one_of_each(docs.filter("false")).count() == 0 and simhash.near_duplicates(docs.filter("false")).count() == 0


def test_covering_masks():
    masks = simhash.covering_masks(2)
    for a in range(64):
        for b in range(a, 64):
            assert any(not m & ((1 << a) | (1 << b)) for m in masks)


def test_simhash_links(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ 1 << rng.randrange(64) ^ 0 for p in prints[:30]] + [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints[:30]]
    classes = spark.createDataFrame([(simhash.signed(p),) for p in set(prints)], "fp long")
    from promptgov.llm.components import connected_components

    got = {r.node: r.root for r in connected_components(simhash.links(classes)).collect()}
    label = brute.components([(simhash.signed(p), p) for p in set(prints)], 2)
    for a in label:
        for b in label:
            assert (label[a] == label[b]) == (got.get(a, a) == got.get(b, b))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(out))
        out[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
    return "".join(out)


def test_band_distance(spark):
    rng = random.Random(6)
    pairs = [(a, edited(rng, a)) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(8, 30))) for _ in range(300))]
    for edits in (1, 2, 3):
        got = spark.createDataFrame(pairs, "x string, y string").select(
            "x", "y", line_dedup.band_distance(F.col("x"), F.col("y"), edits).alias("d")).collect()
        assert all(min(distance(r.x, r.y), edits + 1) == min(r.d, edits + 1) for r in got)


def test_line_join(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 60))) for _ in range(40)]
    lines = base + [edited(rng, b) for b in base for _ in range(3)] + base[:5]
    rng.shuffle(lines)
    docs = table(spark, ["\n".join([*lines[i:i + 4], "short"]) for i in range(0, len(lines), 4)] + [None, "", "\n"])
    place = {}
    for at, line in enumerate(lines):
        place.setdefault(line, (at // 4, at % 4))
    long_ = {line: p for line, p in place.items() if len(line) >= 40}
    near = {a: [b for b in long_ if a != b and distance(a, b) <= 2] for a in long_}
    expected = sorted((at // 4, at % 4, *place[line], len(near[line]),
                       (at // 4, at % 4) > min([place[line], *[place[b] for b in near[line]]]))
                      for at, line in enumerate(lines) if len(line) >= 40)
    assert sorted(map(tuple, line_dedup.line_join(docs).collect())) == expected
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    gone = {(d, n) for d, n, *_, removed in expected if removed}
    assert kept[0] == "\n".join([*[x for n, x in enumerate(lines[:4]) if (0, n) not in gone], "short"])
    assert kept[len(lines) // 4 + (len(lines) % 4 > 0)] is None
    assert line_dedup.line_join(table(spark, [])).count() == 0


def test_every_line(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in [5] * 4 + [19, 20, 25, 38, 39, 40, 41, 60] * 2]
    lines = base + [edited(rng, b) for b in base for _ in range(3)] + base[:6] + ["Menu", "Menu", "Menus"]
    rng.shuffle(lines)
    at = {(i // 4, i % 4): line for i, line in enumerate(lines)}
    docs = table(spark, ["\n".join([*lines[i:i + 4], " ", ""]) for i in range(0, len(lines), 4)] + [None, ""])
    allowed = lambda n: 2 if n >= 40 else 1 if n >= 20 else 0
    expected = []
    for place, line in at.items():
        if not line.strip():
            continue
        same = [p for p, x in at.items() if x == line]
        near = {x for x in at.values() if x != line and distance(x, line) <= min(allowed(len(x)), allowed(len(line)))}
        earliest = min(p for p, x in at.items() if x == line or x in near)
        expected.append((*place, *min(same), len(same), len(near), place > earliest))
    assert sorted(map(tuple, line_dedup.every_line(docs).collect())) == sorted(expected)
    assert any(at[r[:2]] == "Menu" and r[-1] for r in expected)


def test_dropped_lines_of_null_and_repeated_ids(spark):
    long_ = [f"line number {i} {words(80 + i, 12)}" for i in range(6)]
    rows = [(None, [0, 1]), (None, [2, 0]), (7, [3, 4]), (7, [5, 3]), (9, [1, 5]), (9, [1, 5])]
    docs = table(spark, ["\n".join(long_[i] for i in lines) for _, lines in rows], [i for i, _ in rows])
    got = line_dedup.drop_lines(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or 0, line) for r in got.collect() for line in r.text.split("\n") if line)
    first = [(0, 0), (0, 1), (0, 2), (7, 3), (7, 4), (7, 5)]
    assert got.count() == 6 and kept == sorted((i, long_[n]) for i, n in first)


def test_quality(spark):
    docs = table(spark, TEXTS + [("same words again and here " * 40), "# $ % & | < > * " * 9])
    judged = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert not judged[0].kept and judged[4].kept and judged[4].n_words == 30_000 and not judged[10].kept
    kept = quality.cascade(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in judged.items() if r.kept}
    assert quality.cascade(docs.filter("false")).count() == 0


def test_secrets(spark):
    live, copied = "Zx81Kd93mmQpL0aa77Bvc", "Ab12Cd34Ef56Gh78Ij90K"
    rows = [(0, f"é {live} secret='hunter22' token: ab", "en", "s0"), (1, None, None, None), (2, "", "en", "s1")]
    rows += [(3 + i, f"see {copied}", "en", f"s{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert got[0].spans == "owned:2:23,assign:24:40" and got[0].n_assign == 1 and got[0].n_live == 2
    assert got[3].spans == "" and got[3].n_copied == 1 and got[1].spans == ""


def test_decontamination_blocks(spark):
    items = spark.createDataFrame([(i, words(50 + i, 15)) for i in range(6)] + [(9, "Tiny item"), (10, None), (None, words(50, 15))],
                                  "item_id long, text string")
    texts = [*TEXTS, words(50, 15) + " x", "a tiny  ITEM b", words(52, 15)[5:]]
    docs = table(spark, texts)
    expected = sorted(brute.contamination(list(enumerate(texts)), [tuple(r) for r in items.collect()]))
    assert sorted(map(tuple, decontaminate.contamination(docs, items).collect())) == expected
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    blocks = decontaminate.contamination(docs, items, max_windows=7).select(*columns)
    assert sorted(map(tuple, blocks.collect())) == expected
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in expected if not r[5]}


def test_decontaminate_in_blocks(spark):
    items = spark.createDataFrame([(i, words(50 + i, 15)) for i in range(6)], "item_id long, text string")
    texts = [*TEXTS, *[words(50 + i, 15) + f" x{i}" for i in range(6)]]
    docs = table(spark, texts, [None, None, *range(2, len(texts))])
    kept = decontaminate.decontaminate(docs, items, max_windows=7)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, *range(2, len(TEXTS))]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit(score):
    rng = random.Random(3)
    counts = {}
    for _ in range(3000):
        n = rng.randint(1, 64)
        counts[n] = counts.get(n, 0) + 1
    capacity = pack.Capacity(tokens=64, documents=5, cost=2500 + 64 * 64 // 2)
    held = {}
    for length, a, b, first, offset in pack.best_fit(counts, capacity, score):
        for i in range(b - a):
            held.setdefault(first + i, []).append((offset, length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert len(own) <= 5 and sum(n for _, n in own) <= 64 and sum(n * n for _, n in own) <= capacity.cost
    assert sum(map(len, held.values())) == 3000


def test_ids_are_the_library_s():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = pack.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert added == {"<|endoftext|>": 50256}
    ids = pack.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), 2, added)()
    rng = random.Random(7)
    parts = ["a", " ", "<|endoftext|>", "<|endoftext", "|>", "\n", "é", " b", "  ", "1", "\u3000", "word "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for text in texts:
        assert ids(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_remembered_words_are_small():
    """What a task remembers of a word is the word, its ids as bytes and a place in a table."""
    import tracemalloc

    import public_tokenizers

    ids = pack.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), 2)()
    tracemalloc.start()
    for i in range(0, 100_000, 1000):
        ids(" ".join(f"wort{j}er" for j in range(i, i + 1000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 250 * 100_000


def test_packing_empty(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for texts, n in (([], 0), ([None, "", "  double  space\n\n x"], 3)):
        rows = pack.pack(pack.pieces(table(spark, texts), pack.byte_bpe(path)), pack.Capacity(), "norm", "doc_id", "piece")
        assert rows.count() == n


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site name here</p></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>%s<h1>A &amp; B</h1>
<p>First   para with <a href=x>a link</a> &eacute; and more words.<script>var a="<p>no</p>";</script>
<aside><p>Read this instead now</p></aside><form><p>Sign up</p></form><p>Second para<br>goes on.
<!-- gone --><div id="comments"><p>I like this a lot</p></div>%s<div class="sidebar"><p>Side words</p></div><footer>Foot</footer>"""


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("<div class=post>", "</div>")])
def test_main_text(marks):
    text = html_text.main_text(PAGE % marks, html_text.weights({}))
    assert text == "A & B\n\nFirst para with a link é and more words.\n\nSecond para goes on."


POST = "<p>A post of a few plain words here.</p><p>And a second one after it.</p>"


@pytest.mark.parametrize("around", [
    "%s<aside><article><p>Teaser words</p></article></aside>",
    "%s<ol class=commentlist><li><article><p>I like it</p></article></ol>",
    "%s<article class=comment><p>I like it</p></article>"])
def test_articles_that_mark_nothing(around):
    page = around % f'<div class="entry-content">{POST}</div>'
    assert html_text.main_text(page, html_text.weights({})) == "A post of a few plain words here.\n\nAnd a second one after it."


@pytest.mark.parametrize("around", [
    '<div class="content-sidebar-wrap">%s</div>', '<div class="layout with-sidebar"><article>%s</article></div>',
    '<div class="layout with-sidebar"><article>%s</article><div class="sidebar"><p>Side</p></div></div>',
    '<body class="has-header"><div id=form>%s</div>'])
def test_wrappers_with_names(around):
    assert html_text.main_text(around % POST, html_text.weights({})) == "A post of a few plain words here.\n\nAnd a second one after it."


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("<div>", "</div>")])
def test_slug_ids(marks):
    parts = '<h2 id="related-work">Related work</h2><p>Others did so.</p><section id="search-and-sort"><p>Sort, then search.</p></section>'
    text = html_text.main_text(marks[0] + POST * 2 + parts + "<div class=related><p>More to read</p></div>" + marks[1], html_text.weights({}))
    assert text.endswith("Related work\n\nOthers did so.\n\nSort, then search.")


def test_words_outside_are_learned():
    marked = html_text.feature_counts(html_text.tokens(f"<p>Not in it</p><article>{POST}</article>"))
    assert marked["word:outside"] == (0, 3)
    assert -2 < html_text.weights({"word": (20, 9000), "word:outside": (0, 300)})["word:outside"] < -1


@pytest.mark.parametrize("page, text", [
    ('<article><p>See <a href=foo">Link</a> words that matter here.<p class="x">Last para.</article>', "See Link words that matter here.\n\nLast para."),
    ("<article><p title=it's>It's fine to say so.</p><p>Don't stop.</p></article>", "It's fine to say so.\n\nDon't stop."),
    ('<article><p "odd>First words.</p><p a="b>c" d = \'e>f\' g>Second words.</p></article>', "First words.\n\nSecond words."),
    ("<article><p>The mass is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in units.</p></article>", "The mass is E=m in units."),
])
def test_tags_and_quotes(page, text):
    assert html_text.main_text(page, html_text.weights({})) == text


@pytest.mark.parametrize("part", ["<i></zz>", "<a><div><i></a>", "<p><b></i>", "<li></td>", '<b title="x>', "<td><p>", "</p>"])
def test_hostile_pages_take_seconds(part):
    """Pages of 300 KB whose tags match nothing; time grows with the page, not with its square."""
    import time

    page = part * (300_000 // len(part)) + "<p>Some words at the end.</p>"
    began = time.monotonic()
    html_text.main_text(page, html_text.weights({}))
    assert time.monotonic() - began < 15


def test_html_odd(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x <b"), (2, None, "")],
                                  "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("", 0), ("", 0), ("x", 1)]
    assert html_text.extract(pages.filter("false")).count() == 0
    assert html_text.best_region([-1.0, 2.0, -1.0, 3.0, -5.0, 4.0]) == (1, 4)


def test_warc(spark, tmp_path):
    rows = [(1, "u\n1", "same é"), (2, None, "same é"), (None, "x", None), (2, "y", "same é"), (5, "z", ""), (6, "q", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    a, b = (f"file://{tmp_path}/{n}" for n in "ab")
    first = warc.write_warc(pages, a, roll_bytes=300, shard_bytes=50_000).collect()
    again = warc.write_warc(pages.repartition(3), b, roll_bytes=300, shard_bytes=50_000).collect()
    assert sorted(first) == sorted(again) and sum(r.records for r in first) == 6 and len(first) > 2
    got = warc.read_warc(spark, a).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (0, "revisit", 5), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (5, "response", None), (6, "response", None)]
    assert {r.page_id: r.payload for r in got if r.record_type == "response"} == {
        2: bytearray("same é".encode()), 5: bytearray(), 6: bytearray(b"x" * 100_000)}
    warc.write_warc(pages.filter("false"), f"file://{tmp_path}/empty")
    assert warc.read_warc(spark, f"file://{tmp_path}/empty").count() == 0
