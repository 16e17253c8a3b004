"""Operators 2 and 5, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest

from lumenfit.llm import components, neardup, substrings


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0, "k") for i, t in rows], "doc_id long, text string, bucket int, row int, kind string")


def brute_substrings(rows):
    first: dict = {}
    last = 1 << 63
    for i, t in sorted(rows, key=lambda r: last if r[0] is None else r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (last if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randrange(6, 60)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [text(rng.randrange(0, 40)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        parts.insert(rng.randrange(4), rng.choice(shared)[rng.randrange(5) :])
        rows.append((i * 3 % 71, " ".join(parts)))
    line = text(12)
    rows += [(200 + i, f"{text(5)} {line} {text(5)}") for i in range(40)]
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(400, "a" * 300), (401, "a" * 120), (402, "\0" * 130), (403, "\0" * 60), (404, None), (405, ""), (406, "short"), (None, rows[0][1]), (None, rows[0][1] + "x"), (3, rows[5][1]), (3, rows[5][1])]
    return rows


@pytest.mark.parametrize("options", [{}, {"crowd": 2}, {"crowd": 0}])
def test_op2_brute_force(spark, options):
    rows = corpus(1)
    got = substrings.remove_repeats(docs(spark, rows).repartition(3), **options).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str) == brute_substrings(rows)


def test_op2_pieces(monkeypatch):
    """Windows of a text cut into pieces have the anchors that they have in the whole text."""
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 100, 3000).astype(np.uint8))

    def windows():
        key, context, lo, hi, number = substrings.halves([text[:100], text, text[:70]])
        assert (hi - lo <= substrings.NEAR).all()
        return sorted((int(t), w, int(k)) for k, x, y, t in zip(key, lo, hi, number, strict=True) for w in range(x, y + 1))

    want = windows()
    assert [w[:2] for w in want] == [(t, w) for t, n in enumerate((100, 3000, 70)) for w in range(n - substrings.SPAN + 1)]
    first = {w: k for t, w, k in want if t == 1}
    assert all(first[w] == k for t, w, k in want if t != 1)  # equal windows have equal keys
    monkeypatch.setattr(substrings, "BATCH", 1)
    for piece in (1000, 777, 64):
        monkeypatch.setattr(substrings, "PIECE", piece)
        assert windows() == want


def test_op2_bytes_decide(spark, monkeypatch):
    """With keys that say nothing, all contexts meet, and the result is the same."""
    rows = corpus(2)[:40]
    monkeypatch.setattr(substrings, "SUFFIXES", 100)
    plain = substrings.halves
    same_key = lambda texts: (lambda k, *rest: (k & np.uint64(1), *rest))(*plain(texts))
    doc = np.array([2**62 if i is None else i for i, _ in rows])
    texts = [(t or "").encode() for _, t in rows]
    monkeypatch.setattr(substrings, "halves", same_key)
    keys, told = substrings.ask(texts, doc)
    pack = {"pack": 0, "doc": [i for i, _ in rows], "ends": np.cumsum([len(t) for t in texts]).tolist(), "texts": substrings.zstandard.ZstdCompressor().compress(b"".join(texts))}
    out = substrings.contexts(pack, substrings.answer(keys, told, 10**6), 1)
    marks = [np.frombuffer(b, substrings.MARK) for k, b in zip(out.column("kind").to_pylist(), out.column("payload").to_pylist(), strict=True) if k == substrings.MARKS]
    met = substrings.trees(out.filter(substrings.pa.compute.equal(out.column("kind"), substrings.CONTEXTS)))
    marks += [np.frombuffer(b, substrings.MARK) for b in met.column("payload").to_pylist()]
    gone = np.concatenate(marks)
    got = [int(substrings.covered(len(t), gone[gone["row"] == k]).sum()) for k, t in enumerate(texts)]
    want = {(r[0], r[5]): r[2] for r in brute_substrings(rows)}
    assert sorted(got) == sorted(want.values()) and sum(got) > 500


def test_op2_text_over_16_mib(spark):
    rng = np.random.default_rng(2)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    early, late = letters(300), letters(300)
    long = "A" + letters(1 << 20) + "B" + early + "C" + letters(16 << 20) + "D" + late + "E"
    rows = [(1, early + "1"), (2, late + "2"), (3, long)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(docs(spark, rows)).drop("kept").collect()}
    assert got == {1: (301, 0, 0), 2: (301, 0, 0), 3: (len(long), 600, 2)}


def test_op2_empty(spark):
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_op2_maximal_repeats():
    rng = random.Random(0)
    for _ in range(40):
        text = "".join(rng.choice("ab") for _ in range(60))
        n, least = len(text), 4
        rows = np.zeros((n, n), np.uint8)
        for k in range(n):
            rows[k, : n - k] = np.frombuffer(text[k:].encode(), np.uint8)
        before = np.array([-1, *(ord(c) for c in text[:-1])])
        got = {(length, tuple(sorted(who))) for length, who in substrings.maximal_repeats(rows, np.arange(n, 0, -1), before, least)}
        want = set()
        for length in range(least, n):
            groups: dict = {}
            for k in range(n - length + 1):
                groups.setdefault(text[k : k + length], []).append(k)
            for at in groups.values():
                left = {text[k - 1] if k else None for k in at}
                right = {text[k + length] if k + length < n else None for k in at}
                if len(at) > 1 and len(left) > 1 and len(right) > 1:
                    want.add((length, tuple(at)))
        assert got == want


def near_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows, i = [], 0
    for size in (1, 1, 2, 3, 5, 14):
        base = [word() for _ in range(120)]
        for k in range(size):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = word()
            rows.append((i * 7 % 101, " ".join(w)))
            i += 1
    rows += [(500 + k, " ".join(word() for _ in range(90))) for k in range(40)]
    rows += [(600, rows[0][1]), (601, rows[0][1]), (602, None), (603, ""), (604, "one two"), (605, "One, two!"), (606, "!!!"), (None, rows[1][1]), (None, "alone and nameless words here now")]
    return rows


def weighted_sets(rows):
    """Shingles with TF-IDF weights, from words and counts over all rows."""
    sets = []
    for _, t in rows:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        grams: dict = {}
        for k in range(max(1, len(words) - 4) if words else 0):
            g = tuple(words[k : k + 5])
            grams[g] = grams.get(g, 0) + 1
        sets.append(grams)
    df: dict = {}
    for grams in sets:
        for g in grams:
            df[g] = df.get(g, 0) + 1
    return [{g: n * max(1, round(8 * math.log((1 + len(rows)) / (1 + df[g])))) for g, n in grams.items()} for grams in sets]


def brute_near(rows):
    weighted = weighted_sets(rows)
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = weighted[a], weighted[b]
            low = sum(min(v, y.get(k, 0)) for k, v in x.items())
            high = sum(x.values()) + sum(y.values()) - low
            if (rows[a][1] or "") == (rows[b][1] or "") or (high and low / high >= 0.8):
                label[root(a)] = root(b)
    groups: dict = {}
    for k, r in enumerate(rows):
        groups.setdefault(root(k), []).append(r[0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def near_groups(out):
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.class_id, []).append(str(r.doc_id))
    return got


@pytest.mark.parametrize("options", [{}, {"crowd": 4}, {"room": 300}, {"crowd": 1}])
def test_op5_brute_force(spark, options):
    rows = near_corpus(3)
    got = near_groups(neardup.near_duplicates(docs(spark, rows).repartition(3), **options))
    assert sorted(sorted(g) for g in got.values()) == brute_near(rows)
    for k, g in got.items():
        ids = [int(x) for x in g if x != "None"]
        assert not ids or k == min(ids)


def test_op5_weights_and_signatures(spark):
    rows = [*near_corpus(5), (700, "long " + "é word " * 60_000), (701, "ÀÉ Îx " * 30)]
    want = sorted((str(i), sorted(w.values())) for (i, _), w in zip(rows, weighted_sets(rows), strict=True))
    out = neardup.signed_rows(docs(spark, rows).select("doc_id", neardup.common.text_of().alias("text")).repartition(2)).collect()
    got = sorted((str(r.doc_id), sorted(neardup.from_set_bytes(bytes(r.set))[1].tolist()) if r.set else []) for r in out)
    assert got == want and len({r.node for r in out}) == len(rows)
    by_text: dict = {}
    for r in out:
        by_text.setdefault((r.h1, r.h2), set()).add(r.signature and bytes(r.signature))
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("crowd", [2000, 4])
def test_op5_chain_in_a_crowd(spark, crowd):
    """Revisions of which only neighbours are alike: links across blocks make them one class."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(100 + 200)]
    rows = [(k, " ".join(words[k : k + 100])) for k in range(200)]
    got = near_groups(neardup.near_duplicates(docs(spark, rows), crowd=crowd))
    assert list(got) == [0] and len(got[0]) == 200


def test_op5_two_hubs(spark):
    """Two families, alike within, whose members are near each other across only; and a family apart."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(200)]
    other = [w if k < 150 else word() for k, w in enumerate(base)]

    def bent(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(len(out))] = word()
        return " ".join(out)

    steps = [" ".join(other[k:200] if k < 0 else [*base[: 200 - k], *other[200 - k :]]) for k in range(0, 51, 5)]
    apart = [word() for _ in range(120)]
    rows = [(i, t) for i, t in enumerate([*(bent(base, k % 3) for k in range(15)), *(bent(other, k % 3) for k in range(15)), *steps, *(bent(apart, k % 2) for k in range(6))])]
    for crowd in (2000, 3):
        got = near_groups(neardup.near_duplicates(docs(spark, rows), crowd=crowd))
        assert sorted(sorted(g) for g in got.values()) == brute_near(rows), crowd


@pytest.mark.parametrize("options", [{}, {"crowd": 4}])
def test_op5_near_copies_in_a_large_group(spark, options):
    """Near copies of 0.8 and more belong to their group even where it is most of the table and its shingles weigh little."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(140)]
    rows = [(k, " ".join([*base[:20], *(word() for _ in range(9)), *base[29:]])) for k in range(60)]
    rows += [(100 + k, " ".join(word() for _ in range(100))) for k in range(40)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows[:60]]
    assert all(len(x & y) / len(x | y) >= 0.8 for x in sets for y in sets)
    weighted = near_groups(neardup.near_duplicates(docs(spark, rows), **options))
    assert len(weighted) == 100  # by weighted similarity alone
    got = near_groups(neardup.near_duplicates(docs(spark, rows), plain=True, **options))
    assert len(got) == 41 and sorted(map(int, got[0])) == list(range(60))


def test_op5_long_text_in_slices():
    rng = np.random.default_rng(1)
    text, shingle = np.array([0] * 50 + [1] * 700 + [2] * 3), rng.integers(0, 1 << 48, 753).astype(np.uint64)
    weight, starts = rng.integers(1, 9, 753) / 2, np.flatnonzero(np.r_[True, np.diff(text) > 0])
    want = neardup.samples(shingle, weight, starts)
    for size in (64, 50, 700):
        neardup.SLICE, was = size, neardup.SLICE
        assert (neardup.samples(shingle, weight, starts) == want).all()
        neardup.SLICE = was
    words = b"word \xc3\xa9t\xc3\xa9 a1 " * 50
    neardup.BATCH, was = 37, neardup.BATCH
    cut = neardup.words_of(words)
    neardup.BATCH = was
    assert (cut == neardup.words_of(words)).all() and len(cut) == 150


def test_op5_empty(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_op5_samples_agree_with_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 44, 300).astype(np.uint64)
    h.sort()
    a, b = rng.uniform(0.5, 5, 300), rng.uniform(0.5, 5, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rates = []
    for k in range(60):
        x = neardup.samples(h ^ np.uint64(k << 20), a, np.array([0]))
        y = neardup.samples(h ^ np.uint64(k << 20), b, np.array([0]))
        rates.append((x == y).mean())
    assert abs(np.mean(rates) - want) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(400):
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label

def test_components_of_few_edges_take_no_rounds(spark):
    edges = [(k, k + 1) for k in range(40) if k % 10 != 9] + [(7, 7), (60, -5), (-5, 60), (61, 60)]
    want = {k: k - k % 10 for k in range(40)} | {-5: -5, 60: -5, 61: -5}
    table = spark.createDataFrame(edges, "u long, v long")
    for options in ({"rounds": 0}, {"task_edges": 0}):  # in one task; by stars
        assert {r.node: r.label for r in components.components(table, **options).collect()} == want
    assert components.components(table.filter("u > 99"), rounds=0).collect() == []


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs_, now = spark.read.parquet(f"{DATA}/documents.parquet"), None
    before = {r.doc_id: r for r in docs_.collect()}
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    now = docs_
    for name, stage in p.STAGES[:4]:
        out = stage(spark, now, DATA)
        assert set(out.columns) == set(docs_.columns), name
        rows, was = {r.doc_id: r for r in out.collect()}, {r.doc_id: r for r in now.collect()}
        assert rows.keys() <= was.keys()
        gone = [was[k] for k in was.keys() - rows.keys()]
        if name == "language":
            assert len(gone) <= 2
        elif name == "near_duplicates":
            texts = [r.text for r in rows.values()]
            assert len(set(texts)) == len(texts) and gone
        elif name == "decontaminate":
            assert not any(b in r.text for r in rows.values() for b in bench) and all(any(b in r.text for b in bench) for r in gone)
        else:
            assert not gone and all(rows[k].text == was[k].text or "[SECRET]" in rows[k].text for k in was)
            assert all(r.n_chars == len(r.text) for r in rows.values() if "[SECRET]" in r.text)
        now = spark.createDataFrame(list(rows.values()), docs_.schema)
    packed = p.pack(spark, now, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows) and len(before) == 200


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names, empty tables."""
    import corpus_pipeline as p

    rng = random.Random(3)
    parts = {"en": ["the", "er", "ing", "tion", "an"], "de": ["sch", "ung", "ei", "ber"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(3))
    text = lambda lang, n=40: " ".join(word(lang) for _ in range(n))
    item = "A question of the benchmark that stands here with 12 apples and 30 pears for everyone to read at once"
    rows = [(i, text(g), g, "s", 1) for i in range(40) for g in ("en", "de")]
    same, held = text("en"), text("en")
    rows += [(500, same, "en", "b", 2), (500, same, "en", "a", 3), (500, same, "en", "a", 3), (None, same, None, None, None), (501, same, None, "s", 1)]
    rows += [(None, f"{held} {item} {text('en')}", "en", None, None), (None, None, None, None, None), (600, None, "en", "s", 0), (601, "", None, "s", 0), (602, "123 ...", "en", "s", 7)]
    rows += [(None, f"{text('en')} token=abcdefgh12345 {text('en')}", None, None, None), (700, text("de", 30_000), "de", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs_ = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema + ", node long, spans string, h1 long")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs_
    for name, stage in p.STAGES[:4]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == p.COLUMNS, name
        rest = out.collect()
        texts = [r.text for r in rest]
        if name == "language":
            assert len(rest) == len(rows) - 4 and all(texts)
        elif name == "near_duplicates":
            assert len(rest) == len(set(texts)) and [(r.doc_id, r.source, r.n_chars) for r in rest if r.text == same] == [(500, "a", 3)]
        elif name == "decontaminate":
            assert not any(item in t for t in texts) and len(rest) == len(now.collect()) - 1
        else:
            assert sum("[SECRET]" in t for t in texts) == 1 and not any("abcdefgh12345" in t for t in texts)
        now = spark.createDataFrame(rest, schema)
    packed = p.pack(spark, now, "").collect()
    assert sum(r.length for r in packed if r.start == 0 or r.start) > 30_000 and max(r.offset + r.length for r in packed) <= 2048
    none = docs_.limit(0)
    assert all(stage(spark, none, str(tmp_path)).count() == 0 for _, stage in p.STAGES)
