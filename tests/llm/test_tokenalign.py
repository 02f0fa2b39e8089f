"""Alignment of two tokenizers against the tokenizers themselves and a plain merge of their ends."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from llm_data import docs_of  # noqa: F401
from tokenizers import Tokenizer

from tessera.llm import tokenalign
from tessera.llm.registry import op12_token_alignment
from tessera.llm.tokenalign import align_tokens, most_pairs, vocabulary_a, vocabulary_b

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["a", "the", "word", "é", "▁", "\n", "\t", " ", "  ", "x.", "<|endoftext|>", "<s>", "　", "ﬁ", "😀", "\0",
         "don't", "12345", "\r", "_", "Thonerion", " ", " ", "ß", "日本"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, b, vocabulary_a(A), vocabulary_b(b)


def texts(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "er", "on", "é", "ing", "qu"]) for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    out = []
    for i in range(n):
        some = PARTS if i % 3 == 0 else words
        out.append((rnd.choice(["", " "]) if some is PARTS else " ").join(
            rnd.choice(some) for _ in range(rnd.randint(1, 30))))
    return out


def brute(tools, rows):
    tok, sp, bytes_a, bytes_b = tools
    found, counts = [], Counter()
    for i, text in rows:
        own = (" " + (text or "")).encode()
        a = tok.encode(own.decode(), add_special_tokens=False).ids
        b = sp.encode(text or "")
        groups, links = [], []
        if text and own == b"".join(bytes_a[x] for x in a) == b"".join(bytes_b[x] for x in b):
            ends_a, ends_b, x = {}, {}, 0
            for k, t in enumerate(a):
                ends_a[x := x + len(bytes_a[t])] = k
            x = 0
            for k, t in enumerate(b):
                ends_b[x := x + len(bytes_b[t])] = k
            i0 = j0 = 0
            for e in sorted(set(ends_a) & set(ends_b)):
                k, m = ends_a[e] + 1, ends_b[e] + 1
                groups.append(",".join(map(str, a[i0:k])) + "|" + ",".join(map(str, b[j0:m])))
                links.append((a[k - 1], b[m - 1]))
                i0, j0 = k, m
        else:
            a = b = []
        counts.update(links)
        found.append((i, len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(((i, na, nb, len(g), len(li), sum(counts[x] == best[x[1]] for x in li), sum(counts[x] for x in li),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, li in found),
                  key=str), counts


def test_alignment_equals_brute_force(docs_of, spark, tools, monkeypatch):
    rows = list(enumerate(texts(300)))
    rows += [(800 + i, t) for i, t in enumerate(["a \n b", " x", "x ", "a  b c", "\n x", "x \ny z", "\u2581 a b", "a \u2581 b"])]
    rows += [(900, None), (901, ""), (902, " "), (None, "one two"), (5, rows[5][1]), (903, "z" * 3000),
             (904, "ab▁c"), (905, " ".join(texts(90, seed=3)))]
    want, counts = brute(tools, rows)
    for segment, memo in ((1 << 17, 300_000), (40, 5)):
        monkeypatch.setattr(tokenalign, "SEGMENT", segment)
        monkeypatch.setattr(tokenalign, "MEMO", memo)
        monkeypatch.setattr(tokenalign, "HELD", 500)
        docs = docs_of(rows, ["links", "n_a", "code"]).repartition(3)
        scored, links = align_tokens(docs, A, B)
        assert scored.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, scored.collect()), key=str) == want
        top = {y: max(n for (_, b), n in counts.items() if b == y) for _, y in counts}
        assert {(r.a, r.b): (r.n, r.best) for r in links.collect()} == {
            (x, y): (n, n == top[y]) for (x, y), n in counts.items()}
    scored, links = align_tokens(docs_of([]), A, B)
    assert scored.count() == 0 and links.count() == 0


def test_pieces_never_join_across_a_single_space(tools):
    """Long texts are cut at single spaces; no piece of B holds a space after another character."""
    _, sp, bytes_a, bytes_b = tools
    assert not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    assert len(bytes_a) < tokenalign.FORMS and len(bytes_b) < 1 << tokenalign.SHIFT
    assert most_pairs([b"ab", b"b", b"c"], [b"b", b"ab", b"xc"]) == 5


def test_query(spark):
    out = op12_token_alignment(spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and out.filter("n_groups > 0 and n_best <= n_links and length(groups_sha256) = 64").count()
