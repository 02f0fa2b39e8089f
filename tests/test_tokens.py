"""Token operators: padding, digit-place codes, BPE against brute force."""

import random
from collections import Counter

import pytest

from tessera.operators import bpe
from tessera.operators import tokens as tk
from tessera.sources import artefacts as art


def test_digit_place_vocabulary(spark):
    v = tk.digit_place_vocabulary(spark).collect()
    toks = [r["token"] for r in v]
    assert len(toks) == 40 and len(set(toks)) == 40
    assert "_0_0_" in toks and "_9_3_" in toks


def test_digit_place_round_trip(spark):
    texts = ["PID is 51234, DOY is 211, B02 is -150, B03 is 0, B04 is None", "B02 is 7"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    enc = df.select(tk.digit_place_encode("text").alias("e"))
    got = [r["e"] for r in enc.collect()]
    assert got[0] == "PID is 51234, DOY is _2_2_ _1_1_ _1_0_, B02 is -_1_2_ _5_1_ _0_0_, B03 is _0_0_, B04 is None"
    back = [r[0] for r in enc.select(tk.digit_place_decode("e")).collect()]
    assert back == texts


def test_padding_equalises_batches(spark):
    df = spark.createDataFrame([(1, 0, [5, 6]), (1, 1, [7]), (2, 0, [])], "b int, t int, input_ids array<long>")
    out = {(r["b"], r["t"]): r for r in tk.pad_batch(df, "b").collect()}
    assert out[(1, 1)]["input_ids"] == [tk.PAD_ID, 7]
    assert out[(1, 1)]["attention_mask"] == [0, 1]
    assert out[(2, 0)]["input_ids"] == []
    lab = tk.token_labels(tk.pad_batch(df, "b")).filter("b = 1 AND t = 1").first()["labels"]
    assert lab == [tk.IGNORE_LABEL, 7]


def test_lengths_of_a_batch_come_from_the_texts(spark):
    df = spark.createDataFrame([(1, 0, "b a  b"), (1, 1, "c"), (2, 0, ""), (2, 1, None)], "b int, t int, text string")
    encoded = tk.encode_words(df, ["b", "t"])
    got = tk.pad_batch(encoded, "b", longest=tk.batch_lengths(df, "b"))
    assert sorted(map(str, got.collect())) == sorted(map(str, tk.pad_batch(encoded, "b").collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_encode_words_keeps_order(spark):
    df = spark.createDataFrame([(1, "b a  b"), (2, "")], "k int, text string")
    out = {r["k"]: r["input_ids"] for r in tk.encode_words(df, ["k"]).collect()}
    assert out[1] == [1, 0, 1] and out[2] == []


def _brute_bpe(words_counts, n_merges):
    seqs = {tuple(w): c for w, c in words_counts.items()}
    merges = []
    for _ in range(n_merges):
        pairs = Counter()
        for s, c in seqs.items():
            for a, b in zip(s, s[1:]):
                pairs[(a, b)] += c
        if not pairs:
            break
        best = sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0][0] + " " + kv[0][1]))[0]
        (a, b), n = best
        merges.append((a, b, n))
        new = {}
        for s, c in seqs.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            new[tuple(out)] = new.get(tuple(out), 0) + c
        seqs = new
    return merges


def _random_words(seed, n):
    rnd = random.Random(seed)
    parts = ["a", "aa", "ab", "the", "on", "é", "ing", "b"]
    return [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 12)))
            for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"LEADERS": 4, "STORE_EVERY": 2, "BATCH": 3}, {"KEPT": 6}])
def test_bpe_matches_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bpe, name, value)
    texts = ["aaa abab aa", "ab ab ba aaaa", "b a ab", "aaaaaaa aaaaa"] + _random_words(1, 60)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    table = tk.pretoken_counts(df).repartition(3)
    wc = Counter()
    for r in table.collect():
        wc[tuple(r["pieces"].split())] += r["n"]
    want = _brute_bpe(wc, 45)
    got = [(r["a"], r["b"], r["n"]) for r in tk.bpe_train(table, 45).orderBy("rank").collect()]
    assert got == want
    known = [(a, b) for a, b, _ in want[:20]]
    more = tk.bpe_train(table, 25, known).orderBy("rank").collect()
    assert [(r["a"], r["b"], r["n"]) for r in more] == want[20:] and more[0]["rank"] == 20


def _blocks(words, n, size):
    import numpy as np
    import pyarrow as pa

    ids = [np.array([x for w in words[i:i + size] for x in [*w, bpe.GAP]], np.int32).tobytes()
           for i in range(0, len(words), size)]
    counts = [np.array(n[i:i + size], np.int64).tobytes() for i in range(0, len(words), size)]
    return [pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary()), "n": pa.array(counts, pa.binary())})]


@pytest.mark.parametrize("stream, summed", [(1 << 20, 1 << 21), (5, 3)])
def test_a_task_reports_each_context_and_change_once(monkeypatch, stream, summed):
    monkeypatch.setattr(bpe, "STREAM", stream, raising=False)
    monkeypatch.setattr(bpe, "SUMMED", summed, raising=False)
    rnd = random.Random(4)
    words = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 9))] for _ in range(120)]
    n = [rnd.randint(1, 5) for _ in words]
    batch, leaders = [(0, 1, 256), (2, 1, 257)], [3 << 32, (3 << 32) | 2]
    want = Counter()
    for w, k in zip(words, n):
        after = bpe.merge_word(w, {(a, b): x for a, b, x in batch})
        for sign, symbols in ((-k, w), (k, after)):
            for a, b in zip(symbols, symbols[1:]):
                want[(a << 32) | b, 0] += sign
        for i, (a, b) in enumerate(zip(after, after[1:])):
            if (a << 32) | b in leaders or max(a, b) >= 256:
                if i:
                    want[(a << 32) | b, after[i - 1] + 1] += k
                if i + 2 < len(after):
                    want[(a << 32) | b, -after[i + 2] - 1] += k
    rows = [r for b in bpe.apply_round([], batch, leaders, 256)(_blocks(words, n, 7)) for r in b.to_pylist()]
    got = {(r["pair"], r["side"]): r["n"] for r in rows}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_training_leaves_no_streams(spark):
    table = spark.createDataFrame([(" 61 62 63 64 ", 3), (" 61 62 63 ", 2)], "pieces string, n long")
    trainer = bpe.Trainer(table)
    trainer.blocks = trainer.store(trainer.blocks)
    assert not art.exists(spark, f"{trainer.folder}/0") and art.exists(spark, f"{trainer.folder}/1/_SUCCESS")
    assert trainer.blocks.count() > 0 and len(trainer.train(3)) == 3


def test_bpe_ends_when_no_pair_is_left(spark):
    table = spark.createDataFrame([(" 61 62 ", 3), (" 63 ", 9)], "pieces string, n long")
    assert [tuple(r) for r in tk.bpe_train(table, 9).collect()] == [(0, "61", "62", 3)]
    assert tk.bpe_train(table.limit(0), 9).count() == 0


def test_saved_merges_encode_as_one_long_training(spark, tmp_path):
    texts = _random_words(2, 80) + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = tk.pretoken_counts(df)
    whole = tk.bpe_train(table, 40)
    art.save_tokenizer(str(tmp_path), tk.bpe_vocab(spark, whole.limit(25)), whole.filter("rank < 25"))
    vocab, merges = art.load_tokenizer(spark, str(tmp_path))
    assert vocab.count() == len(tk.SPECIAL_TOKENS) + 256 + 25
    assert merges.orderBy("rank").collect() == whole.filter("rank < 25").orderBy("rank").collect()
    longer = merges.unionByName(tk.bpe_train(table, 15, [(r["a"], r["b"]) for r in merges.orderBy("rank").collect()]))
    one = {r["doc_id"]: r["ids"] for r in tk.bpe_encode(df, whole).collect()}
    assert {r["doc_id"]: r["ids"] for r in tk.bpe_encode(df, longer).collect()} == one
    token = {r["id"]: bytes.fromhex(r["token"]) for r in tk.bpe_vocab(spark, whole).filter("id >= 8").collect()}
    for i, t in enumerate(texts):  # ids spell the text; merges one after the other give the same ids
        assert (one[i] is None) == (t is None)
        if t is not None:
            assert b"".join(token[x] for x in one[i]) == (" " + t).encode()
    number = {(r["a"], r["b"]): r["rank"] + 256 for r in whole.collect()}
    names = {f"{i:02X}": i for i in range(256)} | {a + b: n for (a, b), n in number.items()}
    ranks = {(names[a], names[b]): n for (a, b), n in number.items()}
    for word in {w for t in texts if t for w in t.split()}:
        plain = list(word.encode())
        for (a, b), n in sorted(ranks.items(), key=lambda x: x[1]):
            plain = bpe.merge_word(plain, {(a, b): n})
        assert bpe.merge_word(word.encode(), ranks) == plain


def test_words_are_merged_at_once_as_one_by_one():
    import pyarrow as pa

    rnd = random.Random(8)
    words = ["", "aaaa", "é"] + ["".join(rnd.choice("aab") for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    merges = [(97, 97, 256), (97, 98, 257), (256, 256, 258), (257, 97, 259), (98, 98, 260), (258, 97, 261),
              (259, 256, 262), (98, 258, 263)]
    ranks = {(a, b): new for a, b, new in merges}
    batches = bpe.apart(merges)
    assert [m for b in batches for m in b] == merges and len(batches) < len(merges)
    symbols, sizes = bpe.merged_words(pa.array(words), batches)
    ends = [sum(sizes[:i]) for i in range(len(words) + 1)]
    assert [symbols[x:y].tolist() for x, y in zip(ends, ends[1:])] == [bpe.merge_word(w.encode(), ranks) for w in words]


def test_encoding_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "ab ab  b"), (2, ""), (3, None), (4, "ab"), (5, "<|x|> é")], "k int, text string")
    first = tk.bpe_encode(df, spark.createDataFrame([(0, "61", "62", 3), (1, "20", "6162", 3)],
                                                    "rank int, a string, b string, n long"))
    shift, got = len(tk.SPECIAL_TOKENS), {r["k"]: r["ids"] for r in first.collect()}
    space, b = 32 + shift, 98 + shift
    assert got[1][:2] == [257 + shift] * 2 and got[1][-1] == b and got[3] is None
    assert got[4] == [257 + shift] and got[2] == [space]
    assert got[5] == [space] + [x + shift for x in "<|x|> é".encode()]


def test_vocab_extend_skips_duplicates(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "id long, token string")
    out = {r["token"]: r["id"] for r in tk.vocab_extend(vocab, ["b", "c", "c", "d"]).collect()}
    assert out == {"a": 0, "b": 1, "c": 2, "d": 3}
