"""Registered queries: token ids, padding, digit-place codes, BPE, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import text as tx, tokens as tk
from tessera.plans import oracle as o
from tessera.plans import recover as rc
from tessera.plans.q_text import COLS, CS, ROW_TEXT_SQL, corpus_rows
from tessera.plans.registry import query
from tessera.session import checkpoint_dir
from tessera.sources import artefacts as art
from tessera.sources.tables import table

# ------------------------------------------------------------------ word ids and padding

_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
CONV_IDS = f"""vocab AS (SELECT w, dense_rank() OVER (ORDER BY w) - 1 AS id FROM
  (SELECT DISTINCT unnest({_WORDS}) AS w FROM conversations)),
tw AS (SELECT conv_id, turn, unnest({_WORDS}) AS w, unnest(range(len({_WORDS}))) AS pos FROM conversations),
seq AS (SELECT c.conv_id, c.turn, COALESCE(s.ids, []) AS input_ids FROM conversations c LEFT JOIN
  (SELECT conv_id, turn, list(id ORDER BY pos) AS ids FROM tw JOIN vocab USING (w) GROUP BY conv_id, turn) s
  ON c.conv_id = s.conv_id AND c.turn = s.turn),
mx AS (SELECT conv_id, max(len(input_ids)) AS m FROM seq GROUP BY conv_id),
padded AS (SELECT seq.conv_id, turn,
  list_concat(list_transform(range(m - len(input_ids)), lambda x: {tk.PAD_ID}), input_ids) AS input_ids,
  list_concat(list_transform(range(m - len(input_ids)), lambda x: 0),
              list_transform(range(len(input_ids)), lambda x: 1)) AS attention_mask
  FROM seq JOIN mx USING (conv_id))"""


def padded_conversations(spark, d):
    conv = table(spark, d, "conversations").select("conv_id", "turn", "text")
    encoded = tk.encode_words(conv, ["conv_id", "turn"])
    return tk.pad_batch(encoded, "conv_id", longest=tk.batch_lengths(conv, "conv_id"))


@query("pad_tokens", "WITH " + CONV_IDS + "\nSELECT * FROM padded")
def q_pad_tokens(spark, d):
    return padded_conversations(spark, d)


@query("token_labels", "WITH " + CONV_IDS + "\nSELECT conv_id, turn, input_ids, attention_mask, "
       f"list_transform(list_zip(input_ids, attention_mask), lambda x: CASE WHEN x[2] = 1 THEN x[1] "
       f"ELSE {tk.IGNORE_LABEL} END) AS labels FROM padded")
def q_token_labels(spark, d):
    return tk.token_labels(padded_conversations(spark, d))


# ------------------------------------------------------------------ corpus replication

VOLUME = 3


@query("corpus_volume", o.with_scene(
    f"SELECT CAST(v.copy AS INTEGER) AS copy, row_id, {ROW_TEXT_SQL} AS text FROM cs, "
    f"(SELECT unnest(range(1, {VOLUME + 1})) AS copy) v", CS))
def q_corpus_volume(spark, d):
    return tk.corpus_volume(tx.row_text(corpus_rows(spark, d), COLS), VOLUME)


# ------------------------------------------------------------------ digit-place codes

def _enc_num_sql(v: str) -> str:
    dg = f"regexp_replace({v}, '^-', '')"
    toks = (f"array_to_string(list_transform(range(1, length({dg}) + 1), lambda i: '_' || substr({dg}, i, 1) "
            f"|| '_' || CAST(length({dg}) - i AS VARCHAR) || '_'), ' ')")
    return (f"CASE WHEN regexp_full_match({v}, '-?[0-9]{{1,4}}') THEN "
            f"(CASE WHEN starts_with({v}, '-') THEN '-' ELSE '' END) || {toks} ELSE {v} END")


ENC_SQL = ("array_to_string(list_transform(string_split(text, ', '), lambda p: CASE WHEN "
           "len(string_split(p, ' is ')) = 2 THEN string_split(p, ' is ')[1] || ' is ' || "
           + _enc_num_sql("string_split(p, ' is ')[2]") + " ELSE p END), ', ')")
RT = f"rt AS (SELECT row_id, {ROW_TEXT_SQL} AS text FROM cs)"


def encoded(spark, d):
    rt = tx.row_text(corpus_rows(spark, d), COLS)
    return rt.select("row_id", tk.digit_place_encode("text").alias("text"))


@query("digit_place_encode", o.with_scene(f"SELECT row_id, {ENC_SQL} AS text FROM rt", CS + ",\n" + RT))
def q_digit_place_encode(spark, d):
    return encoded(spark, d)


@query("digit_place_roundtrip", o.with_scene("SELECT row_id, text FROM rt", CS + ",\n" + RT))
def q_digit_place_roundtrip(spark, d):
    """Decoding the encoded corpus must give the original text back."""
    return encoded(spark, d).select("row_id", tk.digit_place_decode("text").alias("text"))


@query("digit_place_vocab", o.with_scene(
    "SELECT tok AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '_[0-9]_[0-3]_')) AS tok "
    f"FROM (SELECT {ENC_SQL} AS text FROM rt)) GROUP BY tok", CS + ",\n" + RT))
def q_digit_place_vocab(spark, d):
    """Digit-place tokens used by the encoded corpus, with their counts."""
    enc = encoded(spark, d)
    toks = enc.select(F.explode(F.regexp_extract_all("text", F.lit("_[0-9]_[0-3]_"), 0)).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("token_lengths", o.with_scene(
    "SELECT round(avg(len(b)), 6) AS avg_before, max(len(b)) AS max_before, round(avg(len(a)), 6) AS avg_after, "
    f"max(len(a)) AS max_after FROM (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') "
    f"AS b, list_filter(regexp_split_to_array({ENC_SQL}, '\\s+'), lambda w: w <> '') AS a FROM rt)",
    CS + ",\n" + RT))
def q_token_lengths(spark, d):
    return tk.token_lengths(tx.row_text(corpus_rows(spark, d), COLS))


# ------------------------------------------------------------------ BPE

_PRETOKEN_SQL = tk.PRETOKEN.replace("'", "''")
PAIRS_SQL = f"""WITH toks AS (SELECT unnest(regexp_extract_all(' ' || text, '{_PRETOKEN_SQL}')) AS tok FROM documents),
cnt AS (SELECT hex(encode(tok)) AS h, count(*) AS n FROM toks GROUP BY tok),
pr AS (SELECT substr(h, 2 * i + 1, 2) || ' ' || substr(h, 2 * i + 3, 2) AS pair, n
       FROM (SELECT h, n, unnest(range(CAST(length(h) / 2 AS BIGINT) - 1)) AS i FROM cnt))
SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM pr GROUP BY pair"""


@query("bpe_pair_counts", PAIRS_SQL)
def q_bpe_pair_counts(spark, d):
    return tk.pair_counts(tk.pretoken_counts(table(spark, d, "documents").select("text")))


BPE_MERGES = 1000
MORE_MERGES = 200


def _pretokens(spark, d):
    return tk.pretoken_counts(table(spark, d, "documents").select("text"))


@query("bpe_train")
def q_bpe_train(spark, d):
    return tk.bpe_train(_pretokens(spark, d), BPE_MERGES)


def saved_tokenizer(spark, d) -> str:
    """Folder of the tokenizer of ``documents``; trained once for each state of the table's files."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokenizer-{rc.source_key(spark, d, 'documents', BPE_MERGES)}"
    if not art.exists(spark, f"{path}/merges/_SUCCESS"):
        merges = tk.bpe_train(_pretokens(spark, d), BPE_MERGES)
        art.save_tokenizer(path, tk.bpe_vocab(spark, merges), merges)
    return path


@query("bpe_roundtrip")
def q_bpe_roundtrip(spark, d):
    """The saved vocabulary, read back: special tokens, bytes, then every merge in its order."""
    vocab, merges = art.load_tokenizer(spark, saved_tokenizer(spark, d))
    own = tk.bpe_vocab(spark, merges)
    return vocab.join(own, ["id", "token"], "left_semi")


@query("bpe_retrain")
def q_bpe_retrain(spark, d):
    """Training goes on from the saved merges, and the documents are encoded by the longer list."""
    _, saved = art.load_tokenizer(spark, saved_tokenizer(spark, d))
    known = [(r["a"], r["b"]) for r in saved.orderBy("rank").collect()]  # the vocabulary
    merges = saved.unionByName(tk.bpe_train(_pretokens(spark, d), MORE_MERGES, known))
    return tk.bpe_encode(table(spark, d, "documents").select("doc_id", "text"), merges).select("doc_id", "ids")


# Base vocabulary: the byte pieces present in documents, ranked; extended
# with the digit-place tokens and the column names.
NEW_TOKENS = [f"_{d}_{p}_" for d in range(tk.DIGITS) for p in range(tk.PLACES)] + COLS


@query("vocab_extend", "WITH " + PAIRS_SQL.split("\nSELECT")[0].replace("WITH ", "", 1) + f""",
bytes AS (SELECT DISTINCT substr(h, 2 * i + 1, 2) AS token FROM (SELECT h, unnest(range(CAST(length(h) / 2 AS BIGINT)))
          AS i FROM cnt)),
base AS (SELECT CAST(dense_rank() OVER (ORDER BY token) - 1 AS BIGINT) AS id, token FROM bytes),
lst AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(NEW_TOKENS))}) AS l(pos, token)),
fresh AS (SELECT pos, token FROM lst WHERE token NOT IN (SELECT token FROM base))
SELECT id, token FROM base UNION ALL
SELECT CAST((SELECT max(id) FROM base) + row_number() OVER (ORDER BY pos) AS BIGINT) AS id, token FROM fresh""")
def q_vocab_extend(spark, d):
    pieces = tk.pretoken_counts(table(spark, d, "documents").select("text"))
    byts = pieces.select(F.explode(F.split(F.trim("pieces"), " ")).alias("token")).distinct()
    base, _ = tk.number_sorted(byts, ["token"], "id")
    return tk.vocab_extend(base, NEW_TOKENS)
