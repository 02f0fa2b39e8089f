"""Table <-> text operators, all as Spark SQL expressions.

Rows become sentences ``"c is v, c is v"``; sentences are parsed back with
``split`` / ``filter`` / ``transform`` higher-order functions.  Random
column order is a hash of (row id, column position, seed), so it is
reproducible under any partitioning and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import all_of, coerce_numeric, mix, pick, value_text

# Fixed values of the text format.
SEP = ", "
IS = " is "
PLACEHOLDER = "placeholder"
NONE_TEXT = "None"
END_MARKER = "<|endoftext|>"


def _part(c: str) -> Column:
    return F.concat(F.lit(c + IS), value_text(c))


def _shuffled(cols: list[str], row_id: Column, seed: int, offset: int = 0) -> Column:
    parts = F.array(*[
        F.struct(mix(row_id, seed, i + offset).alias("h"), _part(c).alias("t"))
        for i, c in enumerate(cols)
    ])
    # sort_array + struct-field projection stay in generated code (no lambda)
    return F.array_join(F.sort_array(parts).getField("t"), SEP)


def row_text(df: DataFrame, cols: list[str], id_col: str = "row_id") -> DataFrame:
    """Fixed column order: ``"c is v, ..."``; null prints ``None``."""
    return df.select(id_col, F.concat_ws(SEP, *[_part(c) for c in cols]).alias("text"))


def row_text_shuffled(df: DataFrame, cols: list[str], id_col: str = "row_id", seed: int = 0) -> DataFrame:
    """Columns in a per-row random order (hash of row id, position, seed)."""
    return df.select(id_col, _shuffled(cols, F.col(id_col), seed).alias("text"))


def row_text_conditional(df: DataFrame, cols: list[str], fixed: int = 2, id_col: str = "row_id",
                         seed: int = 0) -> DataFrame:
    """The first ``fixed`` columns in order, the rest shuffled."""
    head = F.concat_ws(SEP, *[_part(c) for c in cols[:fixed]])
    tail = _shuffled(cols[fixed:], F.col(id_col), seed, fixed)
    return df.select(id_col, F.concat_ws(SEP, head, tail).alias("text"))


def row_text_segments(df: DataFrame, cols: list[str], fixed: int = 2, id_col: str = "row_id") -> DataFrame:
    """Known / target segments, word tokens and a segment id per token."""
    known = F.concat(F.concat_ws(SEP, *[_part(c) for c in cols[:fixed]]), F.lit(SEP))
    target = F.concat_ws(SEP, *[_part(c) for c in cols[fixed:]])
    out = df.select(id_col, known.alias("known"), target.alias("target"))
    k_tok = F.split(F.rtrim(F.col("known")), " ")
    t_tok = F.split(F.rtrim(F.col("target")), " ")
    return out.select(
        id_col, "known", "target",
        F.concat(k_tok, t_tok).alias("tokens"),
        F.concat(F.array_repeat(F.lit(0), F.size(k_tok)), F.array_repeat(F.lit(1), F.size(t_tok))).alias("segments"),
    )


def _is_int_row(cols: list[str]) -> Column:
    """Whether all cells of the row are whole numbers or missing (text that is no number is not)."""
    return all_of([F.col(c).isNull() | F.coalesce(
        F.col(c).try_cast("double") == F.floor(F.col(c).try_cast("double")), F.lit(False)) for c in cols])


def partial_row_text(df: DataFrame, cols: list[str], id_col: str = "row_id") -> DataFrame:
    """Present cells only; integers print without a decimal point when the
    whole row is integral, otherwise values print as in the corpus text."""
    int_row = _is_int_row(cols)

    def cell(c):
        as_int = F.col(c).try_cast("double").cast("long").cast("string")
        return F.when(F.col(c).isNotNull(),
                      F.concat(F.lit(c + IS), F.when(int_row, as_int).otherwise(value_text(c))))

    return df.select(id_col, *cols, F.concat_ws(SEP, *[cell(c) for c in cols]).alias("enc"))


def impute_prompt(df: DataFrame, cols: list[str], id_col: str = "row_id", seed: int = 0) -> DataFrame:
    """Partial text + one missing column (hash pick) + ``" is"``.

    No missing column leaves the trailing separator; all missing gives
    only ``"c is"``.
    """
    enc = partial_row_text(df, cols, id_col)
    # names of the missing cells, in column order (concat_ws skips present ones; no lambda)
    names = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    missing = F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, ","))
    n = F.size(missing)
    one = F.when(n > 0, F.element_at(missing, (pick(F.col(id_col), n, seed) + 1).cast("int")))
    prompt = F.concat(
        F.when(F.col("enc") != "", F.concat(F.col("enc"), F.lit(SEP))).otherwise(F.lit("")),
        F.when(n > 0, F.concat(one, F.lit(" is"))).otherwise(F.lit("")),
    )
    return enc.select(id_col, prompt.alias("prompt"))


def clean_text(c) -> Column:
    """Drop the end marker, newline to space, drop carriage returns."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.replace(c, F.lit(END_MARKER), F.lit(""))
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.replace(c, F.lit("\r"), F.lit(""))


def text_to_row(df: DataFrame, cols: list[str], text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """Parse ``"c is v, ..."`` back into one string column per known column.

    Semantics: parts split on ``,``; each part is trimmed and split on
    ``" is "``; the first part whose name is ``c`` and that carries a value
    gives ``c``'s value (the text between the first and the second
    ``" is "``); unset columns hold ``placeholder``; ``None`` becomes null.
    Implemented as one anchored regular expression per column: the leftmost
    match is exactly that first part, and regex functions run in generated
    code (a per-part lambda would be interpreted).
    """
    out = []
    for c in cols:
        # a part that is only "c is" (after trimming) carries no value: skip it
        pat = r"(?s)(?:^|,)\s*\Q" + c + r"\E is (?!\s*(?:,|$))(.*?)(?: is |\s*(?:,|$))"
        v = F.when(F.col(text_col).rlike(pat), F.regexp_extract(F.col(text_col), pat, 1)).otherwise(
            F.lit(PLACEHOLDER))
        out.append(v.alias(c))
    raw = df.select(id_col, *out)
    return raw.select(id_col, *[
        F.when(F.col(c) == NONE_TEXT, F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) for c in cols])


def valid_generated(parsed: DataFrame, cols: list[str], num_cols: list[str], id_col: str = "row_id",
                    drop_nan: bool = False) -> DataFrame:
    """Validity filter for generated rows, then numeric cast.

    Drops rows with any unset column, all-null rows, optionally rows with
    any null, and rows whose numeric text is bad (null stays null).
    """
    staged = parsed.select(id_col, *cols, *[coerce_numeric(c).alias(f"_num_{c}") for c in num_cols])
    # null-safe test: a None cell must not turn the predicate into null
    ok = [~F.exists(F.array(*[F.col(c) for c in cols]), lambda x: x.eqNullSafe(PLACEHOLDER)),
          ~all_of([F.col(c).isNull() for c in cols])]
    if drop_nan:
        ok.append(all_of([F.col(c).isNotNull() for c in cols]))
    ok += [F.col(f"_num_{c}").isNotNull() | F.col(c).isNull() for c in num_cols]
    # Keep-or-drop through a generator instead of a Filter: Catalyst would push
    # a filter below the parse projections and repeat the parse inside it.
    row = F.struct(F.col(id_col), *[F.col(f"_num_{c}").alias(c) if c in num_cols else F.col(c) for c in cols])
    return staged.select(F.inline(F.when(all_of(ok), F.array(row))))


def coerce_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double per column; bad text becomes null."""
    return df.withColumns({c: coerce_numeric(c) for c in cols})


# ------------------------------------------------------------------ packed / padded forms

def pack_bands(df: DataFrame, bands: list[str], keys: list[str], out: str = "BAND") -> DataFrame:
    """``"b2;b3;b4;"``; a missing value prints ``nan``."""
    txt = [F.coalesce(F.col(b).cast("string"), F.lit("nan")) for b in bands]
    return df.select(*keys, F.concat(F.concat_ws(";", *txt), F.lit(";")).alias(out))


def unpack_bands(df: DataFrame, bands: list[str], keys: list[str], col: str = "BAND",
                 dtype: str = "int") -> DataFrame:
    parts = F.split(F.regexp_replace(F.col(col), ";+$", ""), ";")
    return df.select(*keys, *[F.try_element_at(parts, F.lit(i + 1)).try_cast(dtype).alias(b)
                              for i, b in enumerate(bands)])


def zfill(c, width: int) -> Column:
    """Python ``str.zfill``: pad with zeros after an optional sign; never cut."""
    s = F.col(c).cast("string") if isinstance(c, str) else c
    neg = s.startswith("-")
    body = F.when(neg, F.substring(s, 2, 1 << 30)).otherwise(s)
    return F.when(F.length(s) >= width, s).otherwise(
        F.when(neg, F.concat(F.lit("-"), F.lpad(body, width - 1, "0"))).otherwise(F.lpad(body, width, "0")))


def zero_pad(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    return df.withColumns({c: zfill(c, w) for c, w in widths.items()})


def unpivot_bands(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Wide to long ``(keys, BNAME, BAND)``, nulls kept."""
    return df.unpivot(keys, bands, "BNAME", "BAND")
