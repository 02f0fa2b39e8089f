"""Registered queries: row <-> text codecs, prompts, parsing, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import BANDS, NUMERIC_TEXT, mix_sql, pick, pick_sql
from tessera.operators import sampling as sp, text as tx
from tessera.plans import oracle as o
from tessera.plans import recover as rc
from tessera.plans.registry import query
from tessera.sources.tables import table

COLS = ["PID", "DOY", "B02", "B03", "B04"]
SEED = 42
CS = ("cs AS (SELECT CAST(PID AS BIGINT) * 1000 + DOY AS row_id, PID, DOY, B02, B03, B04 FROM data9)")
TS = ("tis AS (SELECT CAST(PID AS BIGINT) * 1000 + DOY AS row_id, PID, DOY, B02, B03, B04 FROM ti)")


def corpus_rows(spark, d):
    """(row_id, PID, DOY, B02, B03, B04) of every scene row; row_id = PID * 1000 + DOY."""
    t = rc.tables(spark, d)
    return t.data.select((F.col("PID").cast("long") * 1000 + F.col("DOY")).alias("row_id"), *COLS)


def impute_rows(spark, d):
    t = rc.tables(spark, d)
    return rc.impute_table(t).select((F.col("PID").cast("long") * 1000 + F.col("DOY")).alias("row_id"), *COLS)


def part_sql(c: str) -> str:
    return f"'{c} is ' || COALESCE(CAST({c} AS VARCHAR), 'None')"


def shuffled_sql(cols, seed, offset=0) -> str:
    items = ", ".join(f"{{'h': {mix_sql('row_id', seed, i + offset)}, 't': {part_sql(c)}}}"
                      for i, c in enumerate(cols))
    return f"array_to_string(list_transform(list_sort([{items}]), lambda x: x.t), ', ')"


ROW_TEXT_SQL = "concat_ws(', ', " + ", ".join(part_sql(c) for c in COLS) + ")"


@query("row_text", o.with_scene(f"SELECT row_id, {ROW_TEXT_SQL} AS text FROM cs", CS))
def q_row_text(spark, d):
    return tx.row_text(corpus_rows(spark, d), COLS)


@query("row_text_shuffled", o.with_scene(f"SELECT row_id, {shuffled_sql(COLS, SEED)} AS text FROM cs", CS))
def q_row_text_shuffled(spark, d):
    return tx.row_text_shuffled(corpus_rows(spark, d), COLS, seed=SEED)


@query("row_text_conditional", o.with_scene(
    "SELECT row_id, concat_ws(', ', " + ", ".join(part_sql(c) for c in COLS[:2])
    + f", {shuffled_sql(COLS[2:], SEED, 2)}) AS text FROM cs", CS))
def q_row_text_conditional(spark, d):
    return tx.row_text_conditional(corpus_rows(spark, d), COLS, 2, seed=SEED)


_KNOWN = "concat_ws(', ', " + ", ".join(part_sql(c) for c in COLS[:2]) + ") || ', '"
_TARGET = "concat_ws(', ', " + ", ".join(part_sql(c) for c in COLS[2:]) + ")"


@query("row_text_segments", o.with_scene(
    "SELECT row_id, known, target, list_concat(string_split(rtrim(known), ' '), string_split(rtrim(target), ' ')) "
    "AS tokens, list_concat(list_transform(string_split(rtrim(known), ' '), lambda x: 0), "
    "list_transform(string_split(rtrim(target), ' '), lambda x: 1)) AS segments "
    f"FROM (SELECT row_id, {_KNOWN} AS known, {_TARGET} AS target FROM cs)", CS))
def q_row_text_segments(spark, d):
    return tx.row_text_segments(corpus_rows(spark, d), COLS, 2)


_ENC_SQL = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '{c} is ' || CAST({c} AS VARCHAR) END" for c in COLS) + ")"


@query("partial_row_text", o.with_scene(f"SELECT row_id, PID, DOY, B02, B03, B04, {_ENC_SQL} AS enc FROM tis",
                                        TS))
def q_partial_row_text(spark, d):
    return tx.partial_row_text(impute_rows(spark, d), COLS)


_MISS_SQL = ("list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in COLS)
             + "], lambda x: x IS NOT NULL)")


@query("impute_prompt", o.with_scene(
    "SELECT row_id, CASE WHEN enc <> '' THEN enc || ', ' ELSE '' END || "
    f"CASE WHEN len(m) > 0 THEN m[CAST({pick_sql('row_id', 'len(m)', SEED)} AS INTEGER) + 1] || ' is' ELSE '' END "
    f"AS prompt FROM (SELECT row_id, {_ENC_SQL} AS enc, {_MISS_SQL} AS m FROM tis)", TS))
def q_impute_prompt(spark, d):
    return tx.impute_prompt(impute_rows(spark, d), COLS, seed=SEED)


# The same with NDVI, whose values are fractions: a row with one prints every number as the corpus does.
FLOAT_COLS = [*COLS, "NDVI"]
TSN = "tis AS (SELECT CAST(PID AS BIGINT) * 1000 + DOY AS row_id, PID, DOY, B02, B03, B04, NDVI FROM ti)"


def _float_enc_sql() -> str:
    whole = " AND ".join(f"({c} IS NULL OR CAST({c} AS DOUBLE) = floor(CAST({c} AS DOUBLE)))" for c in FLOAT_COLS)
    cells = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c} is ' || CASE WHEN {whole} THEN CAST(CAST({c} AS BIGINT) "
                      f"AS VARCHAR) ELSE CAST({c} AS VARCHAR) END END" for c in FLOAT_COLS)
    return f"concat_ws(', ', {cells})"


def float_rows(spark, d):
    t = rc.tables(spark, d)
    return rc.impute_table(t).select((F.col("PID").cast("long") * 1000 + F.col("DOY")).alias("row_id"), *FLOAT_COLS)


@query("partial_row_text_float", o.with_scene(
    f"SELECT row_id, {', '.join(FLOAT_COLS)}, {_float_enc_sql()} AS enc FROM tis", TSN))
def q_partial_row_text_float(spark, d):
    return tx.partial_row_text(float_rows(spark, d), FLOAT_COLS)


@query("impute_prompt_float", o.with_scene(
    "SELECT row_id, CASE WHEN enc <> '' THEN enc || ', ' ELSE '' END || "
    f"CASE WHEN len(m) > 0 THEN m[CAST({pick_sql('row_id', 'len(m)', SEED)} AS INTEGER) + 1] || ' is' ELSE '' END "
    f"AS prompt FROM (SELECT row_id, {_float_enc_sql()} AS enc, list_filter(["
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in FLOAT_COLS)
    + "], lambda x: x IS NOT NULL) AS m FROM tis)", TSN))
def q_impute_prompt_float(spark, d):
    return tx.impute_prompt(float_rows(spark, d), FLOAT_COLS, seed=SEED)


@query("clean_text", "SELECT doc_id, replace(replace(replace(text, '<|endoftext|>', ''), chr(10), ' '), "
       "chr(13), '') AS text FROM documents")
def q_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text("text").alias("text"))


def _parse_sql(src: str, text: str = "text") -> str:
    cols = []
    for c in COLS:
        v = (f"COALESCE(list_filter(parts, lambda a: a[1] = '{c}' AND len(a) >= 2)[1][2], 'placeholder')")
        cols.append(f"CASE WHEN {v} = 'None' THEN NULL ELSE {v} END AS {c}")
    return (f"SELECT row_id, {', '.join(cols)} FROM (SELECT row_id, list_transform(string_split({text}, ','), "
            f"lambda p: string_split(trim(p), ' is ')) AS parts FROM {src})")


@query("text_to_row", o.with_scene(_parse_sql("sh"), CS + f", sh AS (SELECT row_id, {shuffled_sql(COLS, SEED)} "
                                                            "AS text FROM cs)"))
def q_text_to_row(spark, d):
    return tx.text_to_row(tx.row_text_shuffled(corpus_rows(spark, d), COLS, seed=SEED), COLS)


# Generated text: the shuffled corpus with deterministic, data-driven
# defects (truncation, bad numbers, an unknown column, model end marker),
# then cleaned -- the input the validity filter is built for.
def generated(spark, d):
    base = tx.row_text_shuffled(corpus_rows(spark, d), COLS, seed=SEED)
    k = pick(F.col("row_id"), 6, 7)
    t = F.col("text")
    bad = (F.when(k == 0, F.regexp_replace(t, ", [^,]*$", ""))
           .when(k == 1, F.concat(t, F.lit("x")))
           .when(k == 2, F.concat(t, F.lit("d")))
           .when(k == 3, F.concat(F.lit("ZZZ is 4, "), t))
           .when(k == 4, F.concat(t, F.lit("<|endoftext|>\n")))
           .otherwise(t))
    return base.select("row_id", tx.clean_text(bad).alias("text"))


_K = pick_sql("row_id", 6, 7)
GEN_SQL = ("gen AS (SELECT row_id, replace(replace(replace(CASE "
           f"WHEN {_K} = 0 THEN regexp_replace(text, ', [^,]*$', '') "
           f"WHEN {_K} = 1 THEN text || 'x' WHEN {_K} = 2 THEN text || 'd' "
           f"WHEN {_K} = 3 THEN 'ZZZ is 4, ' || text WHEN {_K} = 4 THEN text || '<|endoftext|>' || chr(10) "
           "ELSE text END, '<|endoftext|>', ''), chr(10), ' '), chr(13), '') AS text FROM sh)")
_SH = f"sh AS (SELECT row_id, {shuffled_sql(COLS, SEED)} AS text FROM cs)"


def _num_sql(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '{NUMERIC_TEXT}') THEN TRY_CAST(trim({c}) AS DOUBLE) END")


_VALID_SQL = ("SELECT row_id, " + ", ".join(f"{_num_sql(c)} AS {c}" for c in COLS) + " FROM parsed WHERE "
              + " AND ".join(f"COALESCE({c}, '') <> 'placeholder'" for c in COLS)
              + " AND NOT (" + " AND ".join(f"{c} IS NULL" for c in COLS) + ") AND "
              + " AND ".join(f"({_num_sql(c)} IS NOT NULL OR {c} IS NULL)" for c in COLS))


@query("valid_generated", o.with_scene(_VALID_SQL, ",\n".join([CS, _SH, GEN_SQL, f"parsed AS ({_parse_sql('gen')})"])))
def q_valid_generated(spark, d):
    return tx.valid_generated(tx.text_to_row(generated(spark, d), COLS), COLS, COLS)


@query("coerce_numeric", o.with_scene(
    "SELECT row_id, " + ", ".join(f"{_num_sql(c)} AS {c}" for c in COLS) + " FROM parsed",
    ",\n".join([CS, _SH, GEN_SQL, f"parsed AS ({_parse_sql('gen')})"])))
def q_coerce_numeric(spark, d):
    return tx.coerce_columns(tx.text_to_row(generated(spark, d), COLS), COLS)


HEAD_N = 100


@query("head_n", o.with_scene(_VALID_SQL + f" ORDER BY row_id LIMIT {HEAD_N}",
                              ",\n".join([CS, _SH, GEN_SQL, f"parsed AS ({_parse_sql('gen')})"])))
def q_head_n(spark, d):
    v = tx.valid_generated(tx.text_to_row(generated(spark, d), COLS), COLS, COLS)
    return sp.head_n(v, HEAD_N, ["row_id"])


# ------------------------------------------------------------------ packed forms

_PACK = ("CAST(COALESCE(CAST(B02 AS VARCHAR), 'nan') || ';' || COALESCE(CAST(B03 AS VARCHAR), 'nan') || ';' || "
         "COALESCE(CAST(B04 AS VARCHAR), 'nan') || ';' AS VARCHAR)")


@query("pack_bands", o.with_scene(f"SELECT PID, DOY, {_PACK} AS BAND FROM data9"))
def q_pack_bands(spark, d):
    return tx.pack_bands(rc.tables(spark, d).data, BANDS, ["PID", "DOY"])


@query("unpack_bands", o.with_scene(
    "SELECT PID, DOY, " + ", ".join(
        f"TRY_CAST(string_split(rtrim(BAND, ';'), ';')[{i + 1}] AS INTEGER) AS {b}" for i, b in enumerate(BANDS))
    + f" FROM (SELECT PID, DOY, {_PACK} AS BAND FROM data9)"))
def q_unpack_bands(spark, d):
    return tx.unpack_bands(tx.pack_bands(rc.tables(spark, d).data, BANDS, ["PID", "DOY"]), BANDS, ["PID", "DOY"])


PAD = {"PID": 4, "DOY": 3, "B02": 3, "B03": 3, "B04": 3}


def _zfill_sql(c: str, w: int) -> str:
    s = f"CAST({c} AS VARCHAR)"
    return (f"CASE WHEN length({s}) >= {w} THEN {s} WHEN starts_with({s}, '-') THEN '-' || "
            f"lpad(substr({s}, 2), {w - 1}, '0') ELSE lpad({s}, {w}, '0') END")


@query("zero_pad", o.with_scene(
    "SELECT " + ", ".join(f"{_zfill_sql(c, w)} AS {c}" for c, w in PAD.items()) + " FROM data9"))
def q_zero_pad(spark, d):
    return tx.zero_pad(rc.tables(spark, d).data.select(*PAD), PAD)


@query("unpivot_bands", o.with_scene(" UNION ALL ".join(
    f"SELECT PID, DOY, '{b}' AS BNAME, {b} AS BAND FROM data9" for b in BANDS)))
def q_unpivot_bands(spark, d):
    return tx.unpivot_bands(rc.tables(spark, d).data, ["PID", "DOY"], BANDS)
