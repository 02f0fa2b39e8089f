"""Language identification, quality classifier, packing, chat formatting, pipeline."""

import json
import random
import zlib

import pytest
from llm_data import docs_of, documents  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.chat import TURN_SCHEMAS, levels, link_calls, turn_calls, validate
from tessera.llm.langid import identify_language
from tessera.llm.packing import Bm25, TermNumbers, fill_windows, pack, placed, terms_of
from tessera.llm.quality import QualityModel, fit_quality, keep_good, score_quality
from tessera.llm.tokens import encoder, tokenizer_file

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def crc(i):
    return zlib.crc32(str(i).encode())


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_language_held_out(spark):
    docs = read(spark, "documents")
    got = {r.doc_id: r for r in identify_language(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(got[i].held_out == (crc(i) % 3 == 1) for i in lang)
    held = [i for i in lang if got[i].held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.97 * len(held)
    # what a held-out row says of its language changes nothing
    other = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1,
                                           "zz").otherwise(F.col("lang"))).withColumn("score", F.lit("x"))
    assert {(r.doc_id, r.lang_pred, r.score) for r in identify_language(other).collect()} == \
        {(r.doc_id, r.lang_pred, r.score) for r in got.values()}


def test_language_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "hello there"), (4, "hello there"), (None, "word"), (5, "x" * 200_000)]
    got = identify_language(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and all(r.lang_pred == "en" for r in got if r.doc_id == 4)
    none = docs_of(rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_language(none).collect()} == {"und"}
    assert identify_language(docs_of([])).count() == 0


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert all(r.held_out == (crc(i) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if crc(r.doc_id) % 5 == 0]
    good, bad = ([x.score for x, q in held if q == v] for v in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.97 * len(good) * len(bad)
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, flipped)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_quality_edges(spark, docs_of):
    rows = [(i, "fine words here" if i % 2 else "### $$$ ###") for i in range(60)] + [(60, None), (61, ""), (None, "x")]
    rows += [(1, "fine words here"), (62, "y" * 100_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (None, 1, 0), (1, 0, 1)], LABELS)
    docs = docs_of(rows, ["score", "quality"])
    got = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[3] > 0.5 > scores[4]
    assert "### $$$ ###" not in {r.text for r in keep_good(docs, fit_quality(docs, labels)).collect()}
    one = fit_quality(docs, labels.filter("quality = 0"))
    assert {r.score for r in score_quality(docs, one).collect()} == {0.0}
    assert QualityModel([]).score(None) == 1.0
    assert score_quality(docs.limit(0), one).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_ids_are_the_tokenizers():
    rnd = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "é", "THE", "'s", " the", "123", "<|endoftext|>", "\u3000", "\x85", "\x1c", "…",
             "中文", "\u200b", " \n ", "x\n", ".", "!!", "😀", "\r\n"]
    texts = ["", " "] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(4000)]
    want = tokenizer().encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for (a, _), b in zip(encoder(tokenizer_file()).encode_all(texts), want))


def check_pieces(rows, pieces, window=1024):
    import numpy as np

    want = {}
    for i, t in rows:
        ids = [*tokenizer().encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append(ids)
    covered, places = {}, {}
    for p in pieces:
        assert p.length > 0
        assert any(p.doc_tokens == len(x) and zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes())
                   == p.ids_crc32 for x in want[p.doc_id])
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert covered == {i: sum(map(len, x)) for i, x in want.items()}
    for at in places.values():
        end = 0
        for offset, n in sorted(at):
            assert offset == end
            end += n
        assert end <= window
    return places


def test_packing(spark, docs_of):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["river", "stone", "of", "a", f"w{i % 9}"]) for _ in range(rnd.randint(0, 900))))
            for i in range(40)]
    rows += [(50, None), (51, ""), (52, "long word " * 5000), (None, "no id"), (3, rows[3][1])]
    for shard_bytes in (1 << 12, 1 << 24):
        got = pack(docs_of(rows, ["start", "shard", "offset"]).repartition(3), shard_bytes=shard_bytes).collect()
        places = check_pieces(rows, got)
    assert sum(sum(n for _, n in x) < 1024 for x in places.values()) <= 1
    again = pack(docs_of(rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert pack(docs_of([])).count() == 0


def test_neighbours_share_rare_words():
    index = Bm25([[1, 2, 3], [1, 9, 9], [1, 2, 4], [5], [2, 9]])
    import numpy as np

    assert index.neighbours(0, np.array([False, True, True, True, True]))[0] == 2
    assert index.neighbours(3, np.ones(5, bool)) == []
    pieces = fill_windows([3, 3, 3, 1, 2], index, 6)
    assert [p[0] for p in pieces[:2]] == [0, 2]
    assert fill_windows([], Bm25([]), 6) == []


def test_related_documents_share_a_shard(spark, docs_of):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(200)) + f" rare{i % 60}") for i in range(120)]
    shards = {}
    for r in pack(docs_of(rows), shard_bytes=1 << 13).collect():
        shards.setdefault(r.doc_id, set()).add(r.sequence_id >> 32)
    assert len(set.union(*shards.values())) > 3
    assert all(shards[i] == shards[i + 60] for i in range(60))


def test_words_count_over_all_documents(spark, docs_of):
    rows = [(i, f"one two w{i % 7} x{i}") for i in range(50)] + [(99, None)]
    got = placed(docs_of(rows).select("doc_id", "text"), len(rows), 5, 1 << 20, 20.0).collect()
    assert len(got) == 51 and {r.mean for r in got} == {200 / 51}
    want = {i: sorted([50, 50, sum(j % 7 == i % 7 for j in range(50)), 1]) for i in range(50)}
    assert all(sorted(r.df) == want[r.doc_id] for r in got if r.doc_id < 99)


def test_every_word_of_a_seed_counts():
    import numpy as np

    # 0 shares 16 words with one of 2-17 each, and 20 more common ones with 1 and the last
    docs = [[*range(36)], [*range(16, 36)], *([i] for i in range(16)), [*range(16, 36)]]
    near = Bm25(docs).neighbours(0, np.arange(len(docs)) > 0)
    assert near[:2] == [1, 18] and len(near) == 18


def test_words_at_any_white_space():
    assert terms_of("one two\nthree\tfour\u00a0five") == ["one", "two", "three", "four", "five"]
    assert {"北京", "京大", "大学"} <= set(terms_of("x 北京大学")) and terms_of("") == []
    numbers, index = TermNumbers(), None
    index = Bm25([numbers.of(t) for t in ("a\nriver", "river\nb", "北京大学", "去北京")])
    import numpy as np

    assert index.neighbours(0, np.arange(4) != 0) == [1] and index.neighbours(2, np.arange(4) != 2) == [3]


def odd_texts(n=400):
    rnd = random.Random(5)
    parts = ["a", " ", "  ", "\n", "\t", "é", "THE", "\u3000", "\x85", "\x1c", "\u00a0", "中文", "北京大学", "\u200b", ".", "😀",
             "x" * 70, "y" * 64, "ab" * 4, "ab" * 8, "ไทยดี", "ひら", "\x00"]
    return ["", " ", None, *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)), ""]


def test_terms_are_counted_by_text():
    import numpy as np
    import pyarrow as pa

    from tessera.llm.packing import TermCounts

    texts, numbers = odd_texts(), TermNumbers()
    for given in (texts, pa.chunked_array([texts[:99], texts[99:]]), pa.array(["", *texts])[1:]):
        got = TermCounts.of(given)
        assert got.n == len(texts)
        for i, t in enumerate(texts):
            own, n = np.unique(numbers.of(t or ""), return_counts=True)
            held = got.owner == i
            assert np.array_equal(got.vocabulary[got.at[held]], own) and np.array_equal(got.tf[held], n)
            assert got.sizes[i] == len(terms_of(t or ""))
    for none in ([], [None], ["", " "]):
        assert TermCounts.of(none).n == len(none) and len(TermCounts.of(none).tf) == 0


def test_fill_takes_the_best_that_fits():
    import numpy as np

    rnd = random.Random(8)
    docs = [[rnd.randrange(60) for _ in range(rnd.randint(0, 12))] for _ in range(300)]
    lengths = [rnd.choice([1, 3, 8, 20, 70]) for _ in docs]
    index, unused, want, left, number = Bm25(docs), np.ones(len(docs), bool), [], None, 0
    while left or unused.any():
        doc, start = left or (int(unused.argmax()), 0)
        unused[doc] = False
        seed, offset = doc, min(32, lengths[doc] - start)
        want.append((doc, start, offset, number, 0))
        left = (doc, start + offset) if start + offset < lengths[doc] else None
        near = index.neighbours(seed, unused) if offset < 32 else []
        waiting = []
        for doc in near:
            if lengths[doc] <= 32 - offset:
                want.append((doc, 0, lengths[doc], number, offset))
                unused[doc], offset = False, offset + lengths[doc]
            else:
                waiting.append(doc)
        while offset < 32 and unused.any():
            doc = waiting.pop(0) if waiting else int(unused.argmax())
            n, unused[doc] = min(32 - offset, lengths[doc]), False
            want.append((doc, 0, n, number, offset))
            offset, left = offset + n, (doc, n) if n < lengths[doc] else None
        number += 1
    assert fill_windows(lengths, index, 32) == want


def test_rows_go_to_shards_compressed(spark, docs_of):
    from tessera.llm.packing import unpacked

    rnd = random.Random(4)
    rows = [(i, " ".join(f"word{rnd.randrange(500)}" for _ in range(200))) for i in range(60)] + [(99, None), (1, "x y")]
    docs = docs_of(rows).select("doc_id", "text")
    plain = placed(docs, len(rows), 9, 1 << 20, 20.0).collect()
    short = placed(docs, len(rows), 9, 1 << 20, 20.0, compressed=True)
    assert not {"text", "df"} & set(short.columns)
    short = short.collect()
    got = [(r.doc_id, *unpacked(r.body, r.text_bytes, r.terms), r.place, r.parts, r.mean) for r in short]
    assert sorted((i, t, d.tolist(), *x) for i, t, d, *x in got) == \
        sorted((r.doc_id, r.text or "", r.df, r.place, r.parts, r.mean) for r in plain)
    assert sum(len(r.body) for r in short) < 0.6 * sum(len(t or "") for _, t in rows)
    words = {i: set((t or "").split()) for i, t in rows[:60]}
    df = {w: sum(w in x for x in [*words.values(), {"x", "y"}]) for x in words.values() for w in x}
    assert all(sorted(r.df) == sorted(df[w] for w in words[r.doc_id]) for r in plain if len(r.df) > 2)
    assert plain[0].mean == (60 * 200 + 2) / 62


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
    "a": {"type": "integer", "minimum": 1}, "b": {"type": "string", "enum": ["x", "y"]}, "c": {"type": "number"}}}}


def test_chat_links_order_and_schemas(spark):
    calls = spark.createDataFrame([
        (1, 5, "k1", "add", '{"b":"x", "a": 2}', ["k2", "zz"]), (1, 3, "k2", "add", '{"a": 0}', []),
        (1, 7, "k3", "add", '{"a":"1","b":"q","d":1}', ["k1", "k2"]), (1, 8, "c1", "add", '{"a":1}', ["c2"]),
        (1, 9, "c2", "add", '{"a":1.5,"c":2}', ["c1"]), (1, 10, "k2", "add", '{"a":1}', []),
        (2, 1, "k1", "other", "{}", []), (2, 2, None, "add", "[1]", None), (2, 3, "n", "add", None, None)], CALLS)
    results = spark.createDataFrame([(1, 6, "k1", 'say "é"\n'), (1, 11, "k1", "late"), (3, 1, "k1", "lost"),
                                     (2, 9, None, "none"), (1, 12, "k3", "done")], RESULTS)
    order = {(r.conv_id, r.call_id): r.level for r in levels(calls).collect()}
    assert order == {(1, "k2"): 0, (1, "k1"): 1, (1, "k3"): 2, (2, "k1"): 0, (2, "n"): 0}
    wrong = {(r.conv_id, r.turn): r.problems for r in validate(calls, SCHEMAS).collect()}
    assert wrong[1, 5] == [] and wrong[1, 3] == ["a: minimum"] and wrong[1, 9] == ["a: type"]
    assert wrong[1, 7] == ["a: type", "additional", "b: enum"] and wrong[2, 1] == ["unknown tool"]
    assert wrong[2, 2] == ["no object"] and wrong[2, 3] == ["no object"]
    got = link_calls(calls.withColumn("status", F.lit("x")), results, SCHEMAS).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == 12
    ok = by[1, 5]
    assert (ok.status, ok.level, ok.result_turn) == ("ok", 1, 6)
    assert ok.record == ('{"call":{"after":["k2","zz"],"arguments":{"a":2,"b":"x"},"id":"k1","name":"add","problems":[],'
                         '"turn":5},"result":{"content":"say \\"é\\"\\n","turn":6},"status":"ok"}')
    assert by[1, 3].status == "invalid" and by[1, 10].status == "repeated" and by[1, 8].status == "unanswered"
    assert by[1, 11].status == by[3, 1].status == by[2, 9].status == "orphan"
    assert by[1, 8].level is None and all(json.loads(r.record)["status"] == r.status for r in got)


def test_chat_turns_edges(spark):
    schema = "conv_id long, turn long, role string, text string, status string"
    rows = [(1, 0, "user", "a b c", ""), (1, 1, "assistant", "d", ""), (1, 2, "user", "", ""), (1, 4, "assistant", "e", ""),
            (1, 0, "user", "a b c", ""), (None, 0, "user", None, ""), (2, None, "assistant", None, ""),
            (3, 0, None, "q", ""), (4, 0, "user", "z " * 100_000, "")]
    got = link_calls(*turn_calls(spark.createDataFrame(rows, schema)), TURN_SCHEMAS).collect()
    assert len(got) == 8
    assert sorted(r.status for r in got if r.conv_id == 1) == ["invalid", "ok", "orphan", "repeated"]
    empty = spark.createDataFrame([], schema)
    assert link_calls(*turn_calls(empty), TURN_SCHEMAS).count() == 0


def test_pipeline_stages(spark):
    docs = read(spark, "documents").withColumn("_th", F.lit("x"))
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns, name
        left = {r.doc_id for r in new.collect()}
        assert left <= ids and len(left) > 0.4 * len(ids)
        docs, ids = new, left
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(rows, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())


def test_pipeline_run_and_empty(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.columns[:2] == ["doc_id", "start"]
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", ["op1_url_filters", "op3_chat_formatting", "op9_exact_topk", "op2_ngram_jaccard_join"])
def test_registered_sql(spark, name):
    from oracle_check import compare, duck

    from tessera.llm.registry import ORACLE, QUERIES

    line = compare(spark, SF, name, QUERIES[name], ORACLE[name], duck(SF))
    assert line.startswith("OK"), line
