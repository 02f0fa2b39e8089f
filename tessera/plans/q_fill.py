"""Registered queries: start samplers, draws, synthesis, batch models, artefacts."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.expr import BANDS, mix, mix_keys_sql, mix_sql, pick_sql, uniform_sql
from tessera.operators import fill, prompts as pr, sampling as sp, synth as sy, text as tx, udf
from tessera.plans import oracle as o
from tessera.plans import recover as rc
from tessera.plans.q_metrics import _rank_cte
from tessera.plans.q_text import COLS, TS, impute_rows
from tessera.plans.registry import _FILLED_ALL, _FILLED_SEL, _nulled, query
from tessera.session import checkpoint_dir
from tessera.sources import artefacts as art
from tessera.sources import scene as src
from tessera.sources.tables import table

SEED = 42


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ K1 start samplers

CDF_SQL = """c AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1),
s AS (SELECT value, n, sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS cum,
             sum(n) OVER () AS tot FROM c),
cdf AS (SELECT value, n AS w, CAST(cum - n AS DOUBLE) / CAST(tot AS DOUBLE) AS lo,
               CAST(cum AS DOUBLE) / CAST(tot AS DOUBLE) AS hi FROM s)"""


def _segment_counts(spark, d):
    cust = table(spark, d, "customer")
    return cust.filter(F.col("c_mktsegment").isNotNull()).groupBy(F.col("c_mktsegment").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


@query("start_dist_cdf", "WITH " + CDF_SQL + "\nSELECT value, CAST(w AS BIGINT) AS w, lo, hi FROM cdf")
def q_start_dist_cdf(spark, d):
    return sy.cdf_table(_segment_counts(spark, d), "value")


_U = uniform_sql("c_custkey", SEED)


@query("start_categorical", "WITH " + CDF_SQL + f"""
SELECT c_custkey, 'c_mktsegment is ' || value || ',' AS start
FROM (SELECT c_custkey, {_U} AS u FROM customer) r JOIN cdf ON r.u >= cdf.lo AND r.u < cdf.hi""")
def q_start_categorical(spark, d):
    cust = table(spark, d, "customer")
    return sy.start_categorical(cust, "c_custkey", "c_mktsegment", _segment_counts(spark, d), SEED)


@query("start_continuous", f"""
WITH v AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i FROM customer),
n AS (SELECT count(*) AS n FROM customer)
SELECT c.c_custkey, 'c_acctbal is ' || printf('%.5f', v.c_acctbal) || ',' AS start
FROM customer c JOIN v ON v.i = CAST(floor({uniform_sql('c.c_custkey', SEED)} * (SELECT n FROM n)) AS BIGINT)""")
def q_start_continuous(spark, d):
    cust = table(spark, d, "customer")
    vals = cust.select("c_acctbal", F.col("c_custkey").alias("_k"))
    return sy.start_continuous(cust, "c_custkey", "c_acctbal", vals, SEED)


def _fitted(spark, d, cols):
    """A record fitted on customer columns, saved and loaded again."""
    path = _scratch(spark, "fit-record")
    art.save_fit_record(spark, path, sy.fit_record(table(spark, d, "customer").select(*cols)))
    return art.load_fit_record(spark, path)


@query("start_fitted", "WITH " + CDF_SQL + f"""
SELECT c_custkey, 'c_mktsegment is ' || value || ',' AS start
FROM (SELECT c_custkey, {_U} AS u FROM customer) r JOIN cdf ON r.u >= cdf.lo AND r.u < cdf.hi""")
def q_start_fitted(spark, d):
    """No start column given: the last fitted column, a text, gives the starts."""
    record = _fitted(spark, d, ["c_custkey", "c_acctbal", "c_mktsegment"])
    return sy.start_texts(table(spark, d, "customer"), "c_custkey", record, seed=SEED)


@query("start_fitted_numbers", f"""
WITH c AS (SELECT c_acctbal AS v, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1),
s AS (SELECT v, n, sum(n) OVER (ORDER BY n DESC, v ROWS UNBOUNDED PRECEDING) - n AS f, sum(n) OVER () AS tot FROM c)
SELECT c_custkey, 'c_acctbal is ' || printf('%.5f', v) || ',' AS start
FROM (SELECT c_custkey, {_U} AS u FROM customer) r
JOIN s ON least(CAST(floor(u * CAST(tot AS DOUBLE)) AS BIGINT), tot - 1) >= f
      AND least(CAST(floor(u * CAST(tot AS DOUBLE)) AS BIGINT), tot - 1) < f + n""")
def q_start_fitted_numbers(spark, d):
    """The same with a number as the last fitted column."""
    record = _fitted(spark, d, ["c_custkey", "c_mktsegment", "c_acctbal"])
    return sy.start_texts(table(spark, d, "customer"), "c_custkey", record, seed=SEED)


START_COLS = ["c_mktsegment", "c_acctbal", "c_nationkey"]


@query("start_random", "SELECT c_custkey, [" + ", ".join(f"'{c}'" for c in START_COLS)
       + f"][CAST({pick_sql('c_custkey', len(START_COLS), SEED)} AS INTEGER) + 1] || ' is ' AS start "
       "FROM customer")
def q_start_random(spark, d):
    return sy.start_random(table(spark, d, "customer"), "c_custkey", START_COLS, SEED)


# ------------------------------------------------------------------ K5 - K7

def _level_ctes(name: str, src: str, ctx: list[str], temperature: float, unit: int = sy.WEIGHT_UNIT) -> str:
    """CTE ``name``: the intervals (ctx, v, f, w, tot) of the values ``v`` counted in ``src``."""
    part = f"PARTITION BY {', '.join(ctx)}" if ctx else ""
    cols = "".join(f"{c}, " for c in ctx)
    w = "n" if temperature == 1.0 else (
        f"CAST(floor(pow(CAST(n AS DOUBLE) / CAST(max(n) OVER ({part}) AS DOUBLE), {1.0 / temperature!r}) "
        f"* {unit} + 0.5) AS BIGINT)")
    return (f"{name}_w AS (SELECT {cols}v, n, {w} AS w FROM (SELECT {cols}v, count(*) AS n FROM {src} "
            f"WHERE v IS NOT NULL GROUP BY {cols}v)),\n"
            f"{name} AS (SELECT {cols}v, w, CAST(sum(w) OVER ({part} ORDER BY n DESC, v ROWS UNBOUNDED PRECEDING) - w "
            f"AS BIGINT) AS f, CAST(sum(w) OVER ({part}) AS BIGINT) AS tot FROM {name}_w WHERE w > 0)")


def _hit(t: str, u: str) -> str:
    at = f"least(CAST(floor({u} * CAST({t}.tot AS DOUBLE)) AS BIGINT), {t}.tot - 1)"
    return f"{at} >= {t}.f AND {at} < {t}.f + {t}.w"


TEMPERATURE = 0.7


def _draw_sql(temperature: float) -> str:
    ctes, joins = [], []
    for i, b in enumerate(BANDS):
        ctes.append(f"lg{i} AS (SELECT DOY, CAST({b} AS DOUBLE) AS v FROM clear)")
        ctes.append(_level_ctes(f"a{i}", f"lg{i}", ["DOY"], temperature))
        ctes.append(_level_ctes(f"z{i}", f"lg{i}", [], temperature))
        u = f"u{i}"
        ctes.append(f"c{i} AS (SELECT row_id, DOY, {uniform_sql('row_id', SEED, 1 + i)} AS {u} FROM tis WHERE {b} IS NULL)")
        ctes.append(f"d{i} AS (SELECT c{i}.row_id, COALESCE(a.v, z.v) AS v FROM c{i} LEFT JOIN a{i} a ON a.DOY = c{i}.DOY "
                    f"AND {_hit('a', u)} LEFT JOIN z{i} z ON {_hit('z', u)})")
        joins.append(f"LEFT JOIN d{i} ON d{i}.row_id = tis.row_id")
    cols = ", ".join(f"COALESCE(CAST({b} AS DOUBLE), d{i}.v) AS {b}" for i, b in enumerate(BANDS))
    return o.with_scene(f"SELECT tis.row_id, PID, DOY, {cols} FROM tis {' '.join(joins)}", TS + ",\n" + ",\n".join(ctes))


@query("impute_draw", _draw_sql(TEMPERATURE))
def q_impute_draw(spark, d):
    t = rc.tables(spark, d)
    rows = impute_rows(spark, d)
    return sy.impute_draw(rows, t.clear, "row_id", BANDS, (("DOY",), ()), temperature=TEMPERATURE, seed=SEED)


COLD = 1e-32


@query("impute_draw_cold", _draw_sql(COLD))
def q_impute_draw_cold(spark, d):
    """The same draw at the temperature of an evaluation: only the most frequent values are left."""
    t = rc.tables(spark, d)
    return sy.impute_draw(impute_rows(spark, d), t.clear, "row_id", BANDS, (("DOY",), ()), temperature=COLD, seed=SEED)


def _synthesize_sql() -> str:
    """One round of draws: a row for each key, every band from its longest context with data."""
    number = (f"((({mix_keys_sql(['row_id', '0'], 0, 1)}) & {(1 << 31) - 1}) << 32) | ({mix_keys_sql(['row_id', '0'], 0, 2)})")
    ctes = ["st AS (SELECT DOY AS v FROM clear)", _level_ctes("s", "st", [], 1.0),
            f"k AS (SELECT row_id, CAST({number} AS BIGINT) AS dr FROM tis)",
            f"r0 AS (SELECT row_id, dr, s.v AS DOY FROM (SELECT *, {uniform_sql('dr', SEED)} AS u FROM k) x "
            f"JOIN s ON {_hit('s', 'x.u')})"]
    for i, b in enumerate(BANDS):
        before = BANDS[:i]
        ctes.append(f"lg{i} AS (SELECT DOY, {''.join(f'CAST({x} AS DOUBLE) AS {x}, ' for x in before)}"
                    f"CAST({b} AS DOUBLE) AS v FROM clear)")
        found = []
        for level, ctx in enumerate(dict.fromkeys([("DOY", *before), ("DOY",), ()])):
            name = f"l{i}_{level}"
            ctes.append(_level_ctes(name, f"lg{i}" if not ctx else
                                    f"(SELECT * FROM lg{i} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ctx)})",
                                    list(ctx), 1.0))
            on = " AND ".join([*[f"{name}.{c} = x.{c}" for c in ctx], _hit(name, "x.u")])
            found.append((name, f"LEFT JOIN {name} ON {on}"))
        ctes.append(f"r{i + 1} AS (SELECT x.row_id, x.dr, x.DOY, {''.join(f'x.{c}, ' for c in before)}"
                    f"COALESCE({', '.join(f'{n}.v' for n, _ in found)}) AS {b} FROM (SELECT *, "
                    f"{uniform_sql('dr', SEED, i + 1)} AS u FROM r{i}) x {' '.join(j for _, j in found)})")
    return o.with_scene(f"SELECT row_id, DOY, {', '.join(BANDS)} FROM r{len(BANDS)}", TS + ",\n" + ",\n".join(ctes))


@query("synthesize", _synthesize_sql())
def q_synthesize(spark, d):
    t = rc.tables(spark, d)
    keys = impute_rows(spark, d).select("row_id")
    return sy.synthesize(keys, "row_id", t.clear, "DOY", BANDS, n=keys.count(), seed=SEED)


_COMPLETE = "WHERE " + " AND ".join(f"f_{b} IS NOT NULL" for b in BANDS)


@query("complete_prompts", o.with_scene(
    "SELECT row_id, CAST(PID AS DOUBLE) AS PID, CAST(DOY AS DOUBLE) AS DOY, "
    + ", ".join(f"CAST(f_{b} AS DOUBLE) AS {b}" for b in BANDS) + f" FROM cp {_COMPLETE}",
    TS + ",\n" + o.median_fill_ctes("tis", "clear", "cp")))
def q_complete_prompts(spark, d):
    """Partial-row prompts parsed back and completed by the back-off fill."""
    t = rc.tables(spark, d)
    prompts = tx.impute_prompt(impute_rows(spark, d), COLS, seed=SEED)
    parsed = tx.text_to_row(prompts, COLS, text_col="prompt")
    typed = parsed.select("row_id", *[F.when(F.col(c) != tx.PLACEHOLDER, F.col(c)).alias(c) for c in COLS])
    typed = tx.coerce_columns(typed, COLS)
    return fill.impute(typed, t.clear.select(*[F.col(c).cast("double") for c in COLS]), BANDS)


PROMPT_COLS = ["c_mktsegment", "c_nationkey", "c_acctbal"]
PROMPT_CONTEXTS = [["c_mktsegment", "c_nationkey"], ["c_nationkey"], ["c_mktsegment"], []]


def _prompt_kind(k: str) -> str:
    """Every customer's prompt by its key: which cells it gives, and in which order."""
    return f"({mix_sql(k, SEED)} % 5)"


def customer_prompts(spark, d):
    """Prompts of mixed types: two cells in either order, one cell, a wrong number, or nothing but a name."""
    c = table(spark, d, "customer")
    seg = F.concat(F.lit("c_mktsegment is "), F.col("c_mktsegment"))
    nat = F.concat(F.lit("c_nationkey is "), F.col("c_nationkey").cast("string"))
    kind = mix(F.col("c_custkey"), SEED) % 5
    text = (F.when(kind == 0, F.concat(seg, F.lit(", "), nat, F.lit(", c_acctbal is")))
            .when(kind == 1, F.concat(nat, F.lit(", "), seg))
            .when(kind == 2, F.concat(nat, F.lit(", c_mktsegment is")))
            .when(kind == 3, F.concat(F.lit("c_nationkey is many, "), seg)).otherwise("c_acctbal is"))
    return c.select("c_custkey", text.alias("prompt"))


def _customer_prompt_sql() -> str:
    kind = _prompt_kind("c_custkey")
    ctes = [f"p AS (SELECT c_custkey, CASE WHEN {kind} IN (0, 1, 3) THEN c_mktsegment END AS seg, "
            f"CASE WHEN {kind} IN (0, 1, 2) THEN c_nationkey END AS nat FROM customer)"]
    seen = "c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL"
    ctes += [f"b2 AS (SELECT c_mktsegment AS seg, c_nationkey AS nat, median(c_acctbal) AS v FROM customer WHERE {seen} "
             "GROUP BY ALL)",
             "bn AS (SELECT c_nationkey AS nat, median(c_acctbal) AS v FROM customer WHERE c_nationkey IS NOT NULL "
             "GROUP BY ALL)",
             "bs AS (SELECT c_mktsegment AS seg, median(c_acctbal) AS v, CAST(trunc(median(c_nationkey)) AS INTEGER) AS n "
             "FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ALL)",
             "al AS (SELECT median(c_acctbal) AS v, CAST(trunc(median(c_nationkey)) AS INTEGER) AS n FROM customer)",
             "cm AS (SELECT c_mktsegment AS seg, c_nationkey AS nat, count(*) AS n FROM customer "
             "WHERE c_mktsegment IS NOT NULL GROUP BY ALL)",
             "mn AS (SELECT nat, arg_min(seg, (-n, seg)) AS s FROM cm WHERE nat IS NOT NULL GROUP BY nat)",
             "ma AS (SELECT arg_min(seg, (-n, seg)) AS s FROM (SELECT seg, sum(n) AS n FROM cm GROUP BY seg))"]
    return ("WITH " + ",\n".join(ctes) + "\nSELECT p.c_custkey, COALESCE(p.seg, mn.s, (SELECT s FROM ma)) AS c_mktsegment, "
            "COALESCE(p.nat, bs.n, (SELECT n FROM al)) AS c_nationkey, "
            "COALESCE(b2.v, bn.v, bs.v, (SELECT v FROM al)) AS c_acctbal FROM p "
            "LEFT JOIN b2 ON b2.seg = p.seg AND b2.nat = p.nat LEFT JOIN bn ON bn.nat = p.nat "
            "LEFT JOIN bs ON bs.seg = p.seg LEFT JOIN mn ON mn.nat = p.nat")


@query("complete_customer_prompts", _customer_prompt_sql())
def q_complete_customer_prompts(spark, d):
    train = table(spark, d, "customer").select(*PROMPT_COLS)
    return pr.complete_prompts(customer_prompts(spark, d), train, "c_custkey", PROMPT_CONTEXTS)


# ------------------------------------------------------------------ U1 / U2 batch models

def _doy_medians(t):
    # one row per date: bounded by the calendar, safe to ship to the workers
    rows = t.clear.groupBy("DOY").agg(*[F.median(b).alias(b) for b in BANDS]).collect()
    return {int(r["DOY"]): [r[b] for b in BANDS] for r in rows}


def _median_model(table_: dict, drop_every: int = 0):
    def model(pdf, seed):
        keep = np.ones(len(pdf), dtype=bool)
        if drop_every:
            keep = ((pdf["row_id"].to_numpy() * 31 + seed) % drop_every) != 0
        for i, b in enumerate(BANDS):
            vals = pdf[b].astype("float64").to_numpy()
            median = pdf["DOY"].map({doy: row[i] for doy, row in table_.items()}).to_numpy(dtype="float64")
            pdf[b] = np.where(np.isnan(vals) & keep, median, vals)
        return pdf
    return model


def _date_median_sql(where: str = "") -> str:
    meds = ", ".join(f"median({b}) AS m_{b}" for b in BANDS)
    cols = ", ".join(f"COALESCE(CAST({b} AS DOUBLE), CAST(m_{b} AS DOUBLE)) AS {b}" for b in BANDS)
    return o.with_scene(f"SELECT * FROM (SELECT row_id, PID, DOY, {cols} FROM tis LEFT JOIN dm USING (DOY)) {where}",
                        TS + f",\ndm AS (SELECT DOY, {meds} FROM clear GROUP BY DOY)")


@query("impute_with", _date_median_sql())
def q_impute_with(spark, d):
    t = rc.tables(spark, d)
    return udf.impute_with(impute_rows(spark, d), _median_model(_doy_medians(t)), BANDS, SEED)


@query("impute_with_retry", _date_median_sql("WHERE " + " AND ".join(f"{b} IS NOT NULL" for b in BANDS)))
def q_impute_with_retry(spark, d):
    t = rc.tables(spark, d)
    model = _median_model(_doy_medians(t), drop_every=3)
    return udf.impute_with_retry(impute_rows(spark, d), model, ["row_id"], BANDS, max_retries=4, seed=SEED)


# ------------------------------------------------------------------ artefacts and files

@query("split_reuse", o.with_scene(
    "SELECT *, 'test' AS split FROM te UNION ALL SELECT *, 'train' AS split FROM tr",
    _rank_cte("te", "clear", 0.05, SEED, True) + ",\n" + _rank_cte("tr", "clear", 0.05, SEED, False)))
def q_split_reuse(spark, d):
    t = rc.tables(spark, d)
    # the stored split belongs to its rows, seed and share: other data get another folder
    what = t.clear.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*t.clear.columns) % (1 << 40))).first()
    key = zlib.crc32(f"{d}|{tuple(what)}|{SEED}|0.05".encode())
    path = f"{checkpoint_dir(spark).rstrip('/')}/split-{key:08x}"
    return art.split_reuse(spark, path, lambda: sp.exact_split(t.clear, ["PID", "DOY"], 0.05, SEED))


@query("model_roundtrip", o.with_scene(_FILLED_SEL, _FILLED_ALL))
def q_model_roundtrip(spark, d):
    t = rc.tables(spark, d)
    path = _scratch(spark, "fill-model")
    art.save_fill_model(spark, path, fill.fit_contexts(t.clear, BANDS), {"method": "median", "bands": BANDS})
    fitted, attrs = art.load_fill_model(spark, path)
    return fill.impute_fitted(rc.impute_table(t), fitted, attrs["bands"])


@query("roundtrip_csv", o.with_scene("SELECT * FROM s0"))
def q_roundtrip_csv(spark, d):
    path = _scratch(spark, "scene-csv")
    df = _nulled(spark, d)
    src.write_csv(df, path)
    return src.read_csv_drop_unnamed(spark, path, df.schema)


@query("read_drop_unnamed", o.with_scene("SELECT * FROM s0"))
def q_read_drop_unnamed(spark, d):
    """Results written with a positional index column, read back without it."""
    path = _scratch(spark, "scene-indexed")
    df = _nulled(spark, d)
    indexed = df.select(F.monotonically_increasing_id().alias("Unnamed: 0"), *df.columns)
    src.write_csv(indexed, path)
    return src.read_csv_drop_unnamed(spark, path, indexed.schema)
