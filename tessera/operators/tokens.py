"""Token operators: vocabularies, padding, digit-place codes and BPE training.

* Word ids are a dictionary encoding: the dense rank of each distinct word
  (binary string order), numbered with the distributed ``ids`` machinery.
* Batch padding takes the longest sequence per batch from a grouped
  aggregate joined back on the batch key (no window over a batch).
* BPE works on the table of distinct pre-tokens with their counts, held as
  space-separated hex byte pieces; ``operators.bpe`` learns many merges per
  job from it and encodes texts by a whole merge list in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.expr import ws_trim
from tessera.operators.bpe import encode_texts, train_merges
from tessera.operators.ids import number_sorted

# Fixed values of the token format.
PAD_ID = 50256
IGNORE_LABEL = -100
SPECIAL_TOKENS = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "is", "DOY", "PID"]
DIGITS, PLACES = 10, 4
# Byte-level pre-tokenizer (contractions, letters, numbers, other symbols,
# whitespace runs), applied after prefixing a space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def words(c) -> Column:
    """Whitespace-separated words, empty strings dropped.

    Trimming first leaves no empty pieces (except for an empty text), so no
    lambda filter is needed and the expression stays in generated code.
    """
    t = ws_trim(F.col(c) if isinstance(c, str) else c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


# ------------------------------------------------------------------ word ids, padding

def word_vocab(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """(word, id) with id = rank of the word among distinct words."""
    w = df.select(F.explode(words(text_col)).alias("word")).distinct()
    return number_sorted(w, ["word"], "id")


def encode_words(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Token ids of each row's words, in text order."""
    vocab, _ = word_vocab(df, text_col)
    toks = df.select(*keys, F.posexplode_outer(words(text_col)).alias("pos", "word"))
    toks = toks.join(vocab, "word", "left")  # AQE broadcasts a small vocabulary, splits hot words otherwise
    seq = toks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("_s"))
    return seq.select(*keys, F.col("_s").getField("id").alias("input_ids"))


def batch_lengths(df: DataFrame, batch: str, text_col: str = "text") -> DataFrame:
    """(batch, _max): the most words of a text in each batch, from the texts alone."""
    return df.groupBy(batch).agg(F.max(F.size(words(text_col))).alias("_max"))


def pad_batch(df: DataFrame, batch: str, ids: str = "input_ids", pad_id: int = PAD_ID,
              left: bool = True, longest: DataFrame | None = None) -> DataFrame:
    """Pad every sequence to the longest of its batch; mask marks real tokens.

    ``longest`` (batch, _max), if known before the ids are, spares a second
    run of the plan that makes the ids.
    """
    if longest is None:
        longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_max"))
    j = df.join(longest, batch)
    n_pad = F.col("_max") - F.size(ids)
    pad = F.array_repeat(F.lit(pad_id), n_pad)
    zeros, ones = F.array_repeat(F.lit(0), n_pad), F.array_repeat(F.lit(1), F.size(ids))
    padded = F.concat(pad, F.col(ids)) if left else F.concat(F.col(ids), pad)
    mask = F.concat(zeros, ones) if left else F.concat(ones, zeros)
    return j.select(*[c for c in df.columns if c != ids], padded.alias(ids), mask.alias("attention_mask"))


def token_labels(df: DataFrame, ids: str = "input_ids", mask: str = "attention_mask",
                 ignore_padding: bool = True) -> DataFrame:
    """Labels = ids; with ``ignore_padding`` padded positions get -100."""
    if not ignore_padding:
        return df.withColumn("labels", F.col(ids))
    z = F.arrays_zip(F.col(ids).alias("i"), F.col(mask).alias("m"))
    return df.withColumn("labels", F.transform(z, lambda x: F.when(x["m"] == 1, x["i"]).otherwise(F.lit(IGNORE_LABEL))))


def corpus_volume(df: DataFrame, volume: int) -> DataFrame:
    """Replicate every corpus row ``volume`` times (a generator, not a join)."""
    return df.select(F.explode(F.sequence(F.lit(1), F.lit(volume))).alias("copy"), *df.columns)


# ------------------------------------------------------------------ digit-place codes

def digit_place_vocabulary(spark: SparkSession) -> DataFrame:
    """The 40 tokens ``_d_p_`` (digit d, place p; units are place 0)."""
    r = spark.range(DIGITS * PLACES)
    d, p = (F.col("id") / PLACES).cast("int"), F.pmod(F.col("id"), F.lit(PLACES)).cast("int")
    return r.select(F.format_string("_%d_%d_", d, p).alias("token"), d.alias("digit"), p.alias("place"))


def encode_number(v: Column) -> Column:
    """``-340`` -> ``-_3_2_ _4_1_ _0_0_``; values with more than 4 digits stay as they are."""
    digits = F.regexp_replace(v, "^-", "")
    n = F.length(digits)
    toks = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.concat(F.lit("_"), F.substring(digits, i, 1), F.lit("_"),
                                          (n - i).cast("string"), F.lit("_")))
    enc = F.concat(F.when(v.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.array_join(toks, " "))
    return F.when(v.rlike(r"^-?[0-9]{1,4}$"), enc).otherwise(v)


def digit_place_encode(c, sep: str = ", ", is_: str = " is ") -> Column:
    """Encode the value of every ``name is value`` part of a row text.

    One ``regexp_replace`` per digit count (1..4): a value is a signed
    number of that many digits right after ``" is "`` and right before the
    next separator or the end.  Plain regex replacements stay in generated
    code, unlike a per-part lambda.
    """
    c = F.col(c) if isinstance(c, str) else c
    head = f"({is_}-?)"
    stop = "(?=" + sep.strip() + "|$)"
    for n in range(PLACES, 0, -1):
        digits = "".join(r"(\d)" for _ in range(n))
        repl = "$1" + " ".join(f"_${i + 2}_{n - 1 - i}_" for i in range(n))
        c = F.regexp_replace(c, head + digits + stop, repl)
    return c


def digit_place_decode(c) -> Column:
    """Inverse of :func:`digit_place_encode`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, "_ _", "__"), r"_(\d)_\d_", "$1")


# ------------------------------------------------------------------ vocabulary extension

def vocab_extend(vocab: DataFrame, new_tokens: list[str]) -> DataFrame:
    """Append tokens not yet in ``vocab(id, token)``; ids continue after the max,
    in list order, duplicates skipped."""
    spark = vocab.sparkSession
    seen, ordered = set(), []
    for t in new_tokens:
        if t not in seen:
            seen.add(t)
            ordered.append((len(ordered), t))
    lst = spark.createDataFrame(ordered, "_pos int, token string")
    fresh = lst.join(vocab.select("token"), "token", "left_anti")
    # the new-token list is bounded by the caller's list: rank it with a window
    base = vocab.agg(F.max("id")).scalar()
    ranked = fresh.select("token", (base + F.row_number().over(Window.orderBy("_pos"))).cast("long").alias("id"))
    return vocab.select("id", "token").unionByName(ranked)


# ------------------------------------------------------------------ BPE

def pretoken_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct byte-level pre-tokens with counts; pieces = space-separated hex bytes."""
    toks = df.select(F.explode(F.regexp_extract_all(F.concat(F.lit(" "), F.col(text_col)),
                                                    F.lit(PRETOKEN), 0)).alias("tok"))
    counts = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    hx = F.hex(F.encode(F.col("tok"), "UTF-8"))
    # " 48 45 4C ": one space after every byte (regex replace, no lambda)
    return counts.select(F.concat(F.lit(" "), F.regexp_replace(hx, "(..)", "$1 ")).alias("pieces"), "n")


def pair_counts(table: DataFrame) -> DataFrame:
    """Adjacent piece pairs weighted by pre-token count: (pair, n)."""
    # overlapping adjacent pairs: a zero-width look-ahead match at every piece start
    pairs = F.regexp_extract_all(F.col("pieces"), F.lit(r"(?= (\S+ \S+) )"), 1)
    return (table.select(F.explode(pairs).alias("pair"), "n")
            .groupBy("pair").agg(F.sum("n").cast("long").alias("n")))


def bpe_train(table: DataFrame, n_merges: int, initial_merges: list[tuple[str, str]] | None = None) -> DataFrame:
    """Learn ``n_merges`` merges (ties: smallest pair); returns (rank, a, b, n).

    ``initial_merges`` re-applies an existing merge list first (retraining
    from a saved vocabulary with a new budget).
    """
    return train_merges(table, n_merges, initial_merges or [])


def bpe_encode(df: DataFrame, merges: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids``: each text's token ids in the vocabulary of :func:`bpe_vocab`."""
    ranked = [(r["a"], r["b"]) for r in merges.orderBy("rank").select("a", "b").collect()]  # the vocabulary
    return encode_texts(df, ranked, PRETOKEN, text_col, first_id=len(SPECIAL_TOKENS) + 256)


def bpe_vocab(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """Special tokens, then the 256 byte pieces, then merged pieces in merge order."""
    specials = spark.createDataFrame([(i, t) for i, t in enumerate(SPECIAL_TOKENS)], "id long, token string")
    k = len(SPECIAL_TOKENS)
    bytes_ = spark.range(256).select((F.col("id") + k).alias("id"), F.lpad(F.hex("id"), 2, "0").alias("token"))
    merged = merges.select((F.col("rank") + k + 256).cast("long").alias("id"), F.concat("a", "b").alias("token"))
    return specials.unionByName(bytes_).unionByName(merged)


def token_lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Tokens per row before and after digit-place encoding (avg, max)."""
    before = F.size(words(text_col))
    after = F.size(words(digit_place_encode(text_col)))
    return df.agg(F.round(F.avg(before), 6).alias("avg_before"), F.max(before).alias("max_before"),
                  F.round(F.avg(after), 6).alias("avg_after"), F.max(after).alias("max_after"))

