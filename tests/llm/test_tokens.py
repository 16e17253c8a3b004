"""Operators 3, 8, 9, 10: exact round trips, plain versions, held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenfit.llm import chat, huffman, langid, packing, tokens

BYTE, WORD = (tokens.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["a  b\n\n c ", "", "\nx", " y ", "foo\r\nbar\r\n", "it's don't  ' s", "Ünï ́cödé x", "ſK ǅ Á İ", "tab\tand space   em", "\x01 mark", "a\x01b c", "<|endoftext|> </s>", "x" * 5000, "word " * 4000, "line\n" * 50, " ", "\n", "１２３ 4５", "a \n b\n \nc"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_equal_whole_texts(path):
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("ab é\n\t .,'’1 ́") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|startoftext|>x", "A<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|>" * 3 + "\n<|endoftext|>", "<| endoftext|>"]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert any(len(w) == 1 for t, w in zip(texts, want, strict=True) if t == "<|endoftext|>" or "</s>" in t) or plain.token_to_id("<|endoftext|>") in want[ODD.index("<|endoftext|> </s>")]
    for most in (50, 100_000):
        enc = tokens.UnitEncoder(path, max_units=most)
        for _ in range(2):  # the second time from the memo
            got = [ids[ends[k] : ends[k + 1]].tolist() for _, ids, ends in enc.encode(pa.array(texts)) for k in range(len(ends) - 1)]
            assert got == want


def test_memo_compares_bytes():
    memo = tokens.UnitMemo(10)
    raw, start, end = np.frombuffer(b"abcabd", np.uint8), np.array([0, 3, 6]), np.array([3, 6, 6])
    h, known = memo.find(raw, start, end)
    assert (known == -1).all()
    memo.add(h, raw, start, end, np.array([1, 2, 3], np.uint32), np.array([1, 2, 0]))
    assert memo.find(raw, start, end)[1].tolist() == [0, 1, 2]
    memo.raw = np.frombuffer(b"abcabx", np.uint8)  # as if hashes had collided
    assert memo.find(raw, start, end)[1].tolist() == [0, -1, 2]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start long, ids string")


def test_op3_pieces(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate([*ODD, None, *(" ".join(rng.choice(["the", "station", "pack", "é"]) for _ in range(rng.randrange(3000))) for _ in range(60))])] + [(None, "no id"), (3, "again")]
    tok = Tokenizer.from_file(BYTE)
    whole = {}
    for i, t in rows:
        whole.setdefault((i, len(ids := tok.encode(t or "", add_special_tokens=False).ids + [1])), []).append(ids)
    got = packing.pack_documents(documents(spark, rows).repartition(2), BYTE).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == whole.keys()
    for k, pieces in by_doc.items():
        if len(whole[k]) == 1:
            pieces.sort(key=lambda r: r.start)
            ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in pieces]).tolist()
            assert ids == whole[k][0] and [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        fill = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert fill <= 2048 and fill & (fill - 1) == 0  # full, or of a power of two: no padding
    assert packing.packed_pieces(documents(spark, [])).count() == 0


def test_op3_level_is_the_best_one():
    rng = random.Random(1)
    p = packing.LevelPacker(32, lambda w: None, max_open=10**9)
    for i in range(400):
        need = rng.randrange(1, 32)
        before = int((p.count**2).sum())
        costs = {}
        for h in range(33 - need):
            if h == 0 or p.count[h]:
                c = p.count.copy()
                c[h] -= h > 0
                c[h + need] += h + need < 32
                costs[h] = int((c**2).sum()) - before
        assert costs[p.level(need)] == min(costs.values())
        p.add(i, np.arange(need))


def test_op9_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [(7 * i % 101, t) for i, t in enumerate([*ODD, None, "much " * 30_000, *("".join(rng.choice(["alpha ", "beta ", "γ "]) for _ in range(rng.randrange(900))) for _ in range(40))])] + [(None, "none"), (5, "twice")]
    path = huffman.write_token_file(documents(spark, rows), str(tmp_path / "t"), WORD, 2, 49408, block_tokens=500, stride=16)
    got = huffman.read_token_file(spark, path).collect()
    tok = Tokenizer.from_file(WORD)
    want = sorted(((i is not None, i or 0), tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    told = sorted((((r.doc_id is not None, r.doc_id or 0), np.frombuffer(bytes(r.ids), "<u4").tolist(), r) for r in got), key=lambda x: x[2].start)
    assert sorted(x[:2] for x in told) == want and [x[0] for x in told] == [w[0] for w in want]
    # a third of the rows without doc_id, and many with one, are dealt to several tasks
    many = [(None if i % 3 else 9, f"text number {i}") for i in range(300)]
    hot = huffman.write_token_file(documents(spark, many), str(tmp_path / "h"), WORD, 2, 49408, block_tokens=64)
    shards = spark.read.parquet(f"{hot}/blocks").groupBy("shard").sum("n_docs").collect()
    back = huffman.read_token_file(spark, hot).orderBy("start").collect()
    assert len(shards) > 2 and max(r[1] for r in shards) < 200 and [r.doc_id for r in back] == [None] * 200 + [9] * 100
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()
    assert [x[2].start for x in told] == np.cumsum([0, *(x[2].n_tokens for x in told)])[:-1].tolist()
    empty = huffman.write_token_file(documents(spark, []), str(tmp_path / "e"), WORD, 2, 49408)
    assert huffman.read_token_file(spark, empty).count() == 0


def test_op9_codes():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 16), (2, 16), (300, 9), (300, 16), (5000, 13)):
        counts = np.maximum(1, (1e9 / np.arange(1, n + 1) ** 3).astype(np.int64))
        rng.shuffle(counts)
        lens = huffman.code_lengths(counts, limit)
        assert lens.max() <= limit and sum(2.0 ** -float(x) for x in lens) <= 1
        ids = rng.integers(0, n, 4000)
        sizes = np.array([1000, 0, 2999, 1])
        payload = huffman.encode_block(ids, sizes, lens, huffman.canonical_codes(lens), 7)
        back, doc_lens = huffman.decode_block(payload, huffman.decode_table(lens))
        assert (back == ids).all() and (doc_lens == sizes).all()
    # package-merge is optimal: as good as Huffman where the limit doesn't bind
    import heapq

    counts = rng.integers(1, 1000, 200)
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((huffman.code_lengths(counts).astype(int) * counts).sum()) == total


HARD = "</s>[INST] ok [/INST]"
BITS = [HARD, "", "\n", " lead", "<t>", "\\", "<t\\>", "[INST\\\\] é😀", "<s", "</s\\>", "</", "plain text", "[", "~", "="]


def test_op10_escapes():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice(BITS + ["<", ">", "]", "/INST"]) for _ in range(rng.randrange(6)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_op10_round_trip(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "we<t>ird\n", None]), rng.choice([None, *("".join(rng.choice(BITS) for _ in range(rng.randrange(5))) for _ in range(5))])))
    rows += [(None, None, "user", "x"), (None, 1, "assistant", HARD), (7, 0, "assistant", "repeated"), (7, 0, "assistant", "repeated")]
    rows.append((500, 0, "assistant", "long é " * 100_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(df, BYTE)).collect()
    assert sum(r.conv_id is None for r in out) == 2  # rows without conv_id are conversations of their own
    got = {r.conv_id if r.conv_id is not None else ("none", r.loss_chars): r for r in out}
    by: dict = {}
    for conv, turn, role, text in rows:
        conv = conv if conv is not None else ("none", len(text) if role == "assistant" else 0)
        by.setdefault(conv, []).append(((turn is not None, turn or 0), (role is not None, role or ""), text or "", role))
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        turns.sort(key=lambda t: t[:3])
        r = got[conv]
        told = "".join(f"{role or ''}\n{text}\n" for *_, text, role in turns)
        loss = "".join(text for *_, text, role in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0), BYTE)).count() == 0


def test_op10_ids_and_offsets_as_the_library_gives_them():
    rng = random.Random(8)
    words = [*BITS, "word", " word", "  two", "\n\n", "\t", "naïve", "\u3000", "𝄞", "it's", " 12", "<|endoftext|>", "\x01", "\x85"]
    texts = []
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", None]), "".join(rng.choice(words) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(4))]
        texts.append(chat.render(turns)[0])
    encoder = tokens.UnitEncoder(BYTE, controls=chat.CONTROLS)
    plain = tokens.load(BYTE)
    plain.add_special_tokens(list(chat.CONTROLS))
    assert encoder.style == "spaced" and any("<|endoftext|>" in t for t in texts)
    for _ in range(2):  # with an empty memo and a full one
        got = list(chat.encode_with_offsets(encoder, texts))
        want = [plain.encode(t, add_special_tokens=False) for t in texts]
        assert [i.tolist() for i, _ in got] == [e.ids for e in want]
        assert [[tuple(o) for o in x.tolist()] for _, x in got] == [e.offsets for e in want]
    other = tokens.UnitEncoder(WORD, controls=chat.CONTROLS)  # a tokenizer whose tokens aren't bytes: the library's offsets
    assert other.style == "whole" and all(len(i) == len(o) for i, o in chat.encode_with_offsets(other, texts))


def test_op10_mask_against_plain():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 60, 8))
        spans = np.array(list(zip(cuts[::2], cuts[1::2], strict=False)), dtype=np.int64).reshape(-1, 2)
        edges = np.unique(np.r_[0, rng.integers(0, 60, 12), 60])
        offsets = np.c_[edges[:-1], edges[1:]]
        want = [any(a < e and s < b for s, e in spans) for a, b in offsets]
        assert chat.loss_mask(offsets, spans).tolist() == [int(x) for x in want]


def test_op8_learns(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "er", "ing", "tion", "an"], "de": ["sch", "ung", "ß", "ei", "über"], "fr": ["eau", "ç", "ment", "é", "qui"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(5, 200))), lang if i % 50 else None))
    rows += [(1000, None, "en"), (1001, "123 --- 456", "en"), (1002, "", None), (None, "the thing", "en")]
    df = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, lang string, score double")
    flag = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(v == (k is not None and zlib.crc32(str(k).encode()) % 3 == 1) for k, v in flag.items())
    net = langid.fit(df.filter(~langid.held_out()), per_lang=96)
    got = {r.doc_id: r for r in langid.predict(df, net).collect()}
    right = [got[i].lang_pred == lang for i, t, lang in rows[:400] if lang and flag[i]]
    assert len(right) > 60 and np.mean(right) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(df.limit(0)) is None and {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


def small_net(seed, langs=3, widths=(2, 3), filters=4, dim=3, window=12):
    rng = np.random.default_rng(seed)
    total, widest = filters * len(widths), max(widths)
    mask = np.zeros((widest * dim, total))
    for k, w in enumerate(widths):
        mask[: w * dim, k * filters : (k + 1) * filters] = 1
    embed = rng.normal(size=(256, dim))
    embed[0] = 0
    net = langid.ByteNet([f"l{i}" for i in range(langs)], embed, rng.normal(size=mask.shape) * mask, rng.normal(size=total), rng.normal(size=(total, langs)), rng.normal(size=langs), window)
    return net, mask


def plain_log_probs(net, window):
    """Position by position, filter by filter."""
    dim = net.embed.shape[1]
    widest = len(net.kernel) // dim
    padded = [*window, *[0] * (widest - 1)]
    top = []
    for f in range(net.kernel.shape[1]):
        responses = [sum(net.embed[padded[i + j]][d] * net.kernel[j * dim + d, f] for j in range(widest) for d in range(dim)) for i in range(len(window))]
        top.append(max(0.0, max(responses) + net.bias[f]))
    z = [sum(top[f] * net.out[f, k] for f in range(len(top))) + net.out_bias[k] for k in range(len(net.langs))]
    most = max(z)
    return [v - most - np.log(sum(np.exp(u - most) for u in z)) for v in z]


def test_op8_forward_against_plain():
    net, _ = small_net(0)
    x = np.random.default_rng(1).integers(0, 256, (9, net.window)).astype(np.uint8)
    x[3, 5:] = 0
    want = [plain_log_probs(net, w.tolist()) for w in x]
    assert np.allclose(net.log_probs(x), want, atol=1e-4) and np.allclose(net.log_probs(x, rows=2), want, atol=1e-4)


def test_op8_gradients_against_differences():
    net, mask = small_net(2)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (6, net.window)).astype(np.uint8), rng.integers(0, 3, 6)
    loss = lambda: -np.mean([plain_log_probs(net, w.tolist())[k] for w, k in zip(x, y, strict=True)])
    for name, grad in langid.gradients(net, x, y, mask).items():
        value = getattr(net, name)
        spots = [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]
        if name == "embed":
            spots = [(int(x[i, i]), d) for i in range(6) for d in range(2) if x[i, i]]
        for at in spots:
            if name == "kernel" and not mask[at]:
                continue
            was = value[at]
            value[at] = was + 1e-5
            up = loss()
            value[at] = was - 1e-5
            down = loss()
            value[at] = was
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-4), name


def test_op8_odd_rows(spark):
    rows = [(1, "aa bb", "x"), (1, "aa bb", "x"), (1, "cc dd", "y"), (2, "cc dd " * 200_000, "y"), (3, "aa", None), (4, None, "x")]
    df = spark.createDataFrame([(i, t, g, 1, "s") for i, t, g in rows], "doc_id long, text string, lang string, o int, lang_pred string")
    assert langid.sampled(df.filter("lang IS NOT NULL AND text IS NOT NULL"), 96).count() == 3  # repeated rows once
    net = langid.fit(df)
    got = langid.predict(df, net).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.text} <= {"x", "y"} and [r.lang_pred for r in got if r.text is None] == ["und"]
    with pytest.raises(ValueError, match="languages"):
        langid.MOST_LANGUAGES, was = 1, langid.MOST_LANGUAGES
        try:
            langid.fit(df, per_lang=1)
        finally:
            langid.MOST_LANGUAGES = was
