"""Registered queries: distributions, metrics, evaluation, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import BANDS, FILL_BANDS, mix_keys_sql, mix_sql
from tessera.operators import fill, metrics as m, sampling as sp, scene as sc
from tessera.plans import oracle as o
from tessera.plans import recover as rc
from tessera.plans.registry import DOY, X1, X2, Y1, Y2, _box_sql, _nulled, query
from tessera.sources.tables import table

# ------------------------------------------------------------------ inputs

# Baseline "classifier" over documents, scored against the labels table.
PRED_SQL = """preds AS (
  SELECT l.doc_id, l.quality, l.toxic,
         CAST(CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS INTEGER) AS pred_quality,
         CAST(CASE WHEN d.n_chars % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS pred_toxic,
         CAST(1 + l.doc_id % 3 AS DOUBLE) AS w
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def predictions(spark, d):
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    return j.select(
        "doc_id", "quality", "toxic",
        F.when(F.col("n_chars") >= 1000, 1).otherwise(0).cast("int").alias("pred_quality"),
        F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0).cast("int").alias("pred_toxic"),
        (F.lit(1) + F.col("doc_id") % 3).cast("double").alias("w"),
    )


def _with(body, *ctes):
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ------------------------------------------------------------------ E3, E5

@query("value_dist", """
SELECT c_mktsegment AS value, count(*) AS n,
       count(*) / (SELECT count(*) FROM customer WHERE c_mktsegment IS NOT NULL) AS p
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
def q_value_dist(spark, d):
    return m.value_dist(table(spark, d, "customer"), "c_mktsegment")


_NMISS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in FILL_BANDS)


@query("missing_counts", o.with_scene(
    f"SELECT PID, DOY, {_NMISS} AS n_missing, "
    f"(SELECT CAST(sum({_NMISS}) AS BIGINT) FROM ti) AS total_missing FROM ti"))
def q_missing_counts(spark, d):
    return m.missing_counts(rc.impute_table(rc.tables(spark, d)), ["PID", "DOY"], FILL_BANDS)


# ------------------------------------------------------------------ E6 MAE

@query("mae", "SELECT round(sum(abs(l_discount - l_tax)) / count(*), 9) AS mae FROM lineitem")
def q_mae(spark, d):
    return m.mae(table(spark, d, "lineitem"), "l_discount", "l_tax")


@query("mae_weighted", "SELECT round(sum(l_quantity * abs(l_discount - l_tax)) / sum(l_quantity), 9) "
       "AS mae FROM lineitem")
def q_mae_weighted(spark, d):
    return m.mae(table(spark, d, "lineitem"), "l_discount", "l_tax", weight="l_quantity")


@query("mae_multi", """
WITH e AS (SELECT sum(abs(l_discount - l_tax)) / count(*) AS m0,
                  sum(abs(l_tax - l_discount * CAST(0.5 AS DOUBLE))) / count(*) AS m1 FROM lineitem)
SELECT 'o0' AS output, round(m0, 9) AS mae FROM e
UNION ALL SELECT 'o1' AS output, round(m1, 9) AS mae FROM e
UNION ALL SELECT 'uniform_average' AS output, round((m0 + m1) / 2, 9) AS mae FROM e""")
def q_mae_multi(spark, d):
    li = table(spark, d, "lineitem").select(
        F.array("l_discount", "l_tax").alias("p"),
        F.array(F.col("l_tax"), F.col("l_discount") * F.lit(0.5)).alias("r"))
    return m.mae_multi(li, "p", "r")


# ------------------------------------------------------------------ E7 accuracy, E9 PRF

@query("accuracy", _with("SELECT round(avg(CASE WHEN pred_quality = quality THEN 1.0 ELSE 0.0 END), 9) "
                         "AS accuracy FROM preds", PRED_SQL))
def q_accuracy(spark, d):
    return m.accuracy(predictions(spark, d), "pred_quality", "quality")


@query("accuracy_count", _with("SELECT round(sum(CASE WHEN pred_quality = quality THEN 1.0 ELSE 0.0 END), 9) "
                               "AS accuracy FROM preds", PRED_SQL))
def q_accuracy_count(spark, d):
    return m.accuracy(predictions(spark, d), "pred_quality", "quality", normalize=False)


@query("accuracy_weighted", _with(
    "SELECT round(sum(w * CASE WHEN pred_quality = quality THEN 1.0 ELSE 0.0 END) / sum(w), 9) "
    "AS accuracy FROM preds", PRED_SQL))
def q_accuracy_weighted(spark, d):
    return m.accuracy(predictions(spark, d), "pred_quality", "quality", weight="w")


@query("accuracy_multilabel", _with(
    "SELECT round(avg(CASE WHEN [pred_quality, pred_toxic] = [quality, toxic] THEN 1.0 ELSE 0.0 END), 9) "
    "AS accuracy FROM preds", PRED_SQL))
def q_accuracy_multilabel(spark, d):
    p = predictions(spark, d)
    return m.accuracy(p, F.array("pred_quality", "pred_toxic"), F.array("quality", "toxic"))


@query("prf_weighted", _with("""
SELECT round(sum(support * pr) / sum(support), 9) AS precision,
       round(sum(support * rc) / sum(support), 9) AS recall,
       round(sum(support * CASE WHEN pr + rc > 0 THEN 2.0 * pr * rc / (pr + rc) ELSE 0.0 END)
             / sum(support), 9) AS f1
FROM (SELECT COALESCE(a.support, 0) AS support,
             COALESCE(CAST(a.tp AS DOUBLE) / NULLIF(CAST(b.npred AS DOUBLE), 0), 0.0) AS pr,
             COALESCE(CAST(a.tp AS DOUBLE) / NULLIF(CAST(a.support AS DOUBLE), 0), 0.0) AS rc
      FROM (SELECT quality AS cls, count(*) AS support,
                   sum(CASE WHEN pred_quality = quality THEN 1 ELSE 0 END) AS tp FROM preds GROUP BY quality) a
      FULL JOIN (SELECT pred_quality AS cls, count(*) AS npred FROM preds GROUP BY pred_quality) b
      ON a.cls = b.cls) t""", PRED_SQL))
def q_prf_weighted(spark, d):
    return m.prf_weighted(predictions(spark, d), "pred_quality", "quality")


# ------------------------------------------------------------------ E8 / K9 evaluation

def _l1l2_sql(test_cte: str, train_cte: str) -> str:
    masked = ("tem AS (SELECT CAST(NULL AS INTEGER) AS B02, CAST(NULL AS INTEGER) AS B03, "
              "CAST(NULL AS INTEGER) AS B04, PID, DOY FROM te)")
    ok = "f_B02 IS NOT NULL AND f_B03 IS NOT NULL AND f_B04 IS NOT NULL"
    imp = f"imp AS (SELECT PID, DOY, f_B02 AS i2, f_B03 AS i3, f_B04 AS i4 FROM fl WHERE {ok})"
    ctes = ",\n".join([test_cte, train_cte, masked, o.median_fill_ctes("tem", "tr", "fl"), imp])
    l1 = "abs(te.B02 - i2) + abs(te.B03 - i3) + abs(te.B04 - i4)"
    l2 = "sqrt((te.B02 - i2) * (te.B02 - i2) + (te.B03 - i3) * (te.B03 - i3) + (te.B04 - i4) * (te.B04 - i4))"
    return o.with_scene(
        f"SELECT round(COALESCE(avg({l1}), 0.0), 6) AS L1, round(COALESCE(avg({l2}), 0.0), 6) AS L2, "
        "count(imp.PID) AS n_matched, CAST(sum(CASE WHEN imp.PID IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
        "AS n_unmatched FROM te LEFT JOIN imp ON te.PID = imp.PID AND te.DOY = imp.DOY", ctes)


def _evaluate(train, test):
    masked = sc.mask_bands(test.select("PID", "DOY", *BANDS), BANDS)
    imputed = fill.impute(masked, train, BANDS)
    return m.l1_l2(test, imputed)


@query("l1_l2", _l1l2_sql(
    f"te AS (SELECT * FROM clear WHERE DOY = {DOY} AND {_box_sql('clear')})",
    f"tr AS (SELECT * FROM clear WHERE NOT (DOY = {DOY} AND {_box_sql('clear')}))"))
def q_l1_l2(spark, d):
    train, test = sc.aoi_holdout(rc.tables(spark, d).clear, DOY, X1, Y1, X2, Y2)
    return _evaluate(train, test)


def _rank_cte(name: str, src: str, frac: float, seed: int, test: bool) -> str:
    h = mix_keys_sql(["PID", "DOY"], seed)
    cmp = "<" if test else ">="
    return (f"{name} AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (ORDER BY {h}, PID, DOY) - 1 AS _r "
            f"FROM {src}) WHERE _r {cmp} ceil({frac} * (SELECT count(*) FROM {src})))")


EVAL_FRAC, SPLIT_FRAC, SEED = 0.2, 0.05, 42


@query("evaluate_holdout", _l1l2_sql(_rank_cte("te", "clear", EVAL_FRAC, SEED, True),
                                     _rank_cte("tr", "clear", EVAL_FRAC, SEED, False)))
def q_evaluate_holdout(spark, d):
    train, test = sp.exact_split(rc.tables(spark, d).clear, ["PID", "DOY"], EVAL_FRAC, SEED)
    return _evaluate(train, test)


# ------------------------------------------------------------------ E10 histogram

@query("band_histogram", o.with_scene("""
SELECT CAST(b.i AS INTEGER) AS bin, coalesce(h.n, 0) AS n FROM range(256) b(i) LEFT JOIN (
  SELECT LEAST(CAST(floor((CAST(B02 AS DOUBLE) - mn) * CAST(256 AS DOUBLE)
               / CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END) AS INTEGER), 255) AS bin, count(*) AS n
  FROM s0, (SELECT CAST(min(B02) AS DOUBLE) AS mn, CAST(max(B02) AS DOUBLE) AS mx FROM s0) mm
  WHERE B02 IS NOT NULL GROUP BY 1) h ON h.bin = b.i"""))
def q_band_histogram(spark, d):
    return m.band_histogram(_nulled(spark, d), "B02", 256)


# ------------------------------------------------------------------ G3 split, G4 shuffle, G5 balance

@query("split_test", o.with_scene("SELECT * FROM te", _rank_cte("te", "clear", SPLIT_FRAC, SEED, True)))
def q_split_test(spark, d):
    return sp.exact_split(rc.tables(spark, d).clear, ["PID", "DOY"], SPLIT_FRAC, SEED)[1]


@query("split_train", o.with_scene("SELECT * FROM tr", _rank_cte("tr", "clear", SPLIT_FRAC, SEED, False)))
def q_split_train(spark, d):
    return sp.exact_split(rc.tables(spark, d).clear, ["PID", "DOY"], SPLIT_FRAC, SEED)[0]


@query("shuffle_rows", o.with_scene(
    f"SELECT *, row_number() OVER (ORDER BY {mix_keys_sql(['PID', 'DOY'], SEED)}, PID, DOY) - 1 AS pos FROM clear"))
def q_shuffle_rows(spark, d):
    return sp.shuffled_positions(rc.tables(spark, d).clear, ["PID", "DOY"], SEED)


BALANCE_N = 1000


@query("balanced_sample", f"""
WITH r AS (SELECT doc_id, quality, toxic,
                  row_number() OVER (PARTITION BY quality ORDER BY {mix_sql('doc_id', SEED)}, doc_id) - 1 AS rk
           FROM labels),
c AS (SELECT LEAST(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)) AS n0 FROM labels)
SELECT doc_id, quality, toxic FROM r WHERE quality IN (0, 1) AND rk < floor(LEAST({BALANCE_N}, (SELECT n0 FROM c)) / 2)""")
def q_balanced_sample(spark, d):
    return sp.balanced_sample(table(spark, d, "labels"), "quality", "doc_id", BALANCE_N, SEED, classes=(0, 1))


# ------------------------------------------------------------------ C10, C11, D3

ROW_IDS = list(range(0, 70001, 10000))
SLICE = (1000, 2000)
_ROWNUM = "rn AS (SELECT *, row_number() OVER (ORDER BY DOY, Y, X) - 1 AS row_id FROM data)"


@query("rows_by_id", o.with_scene(
    "SELECT rn.*, l.pos FROM rn JOIN (VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(ROW_IDS))
    + ") AS l(pos, rid) ON rn.row_id = l.rid", _ROWNUM))
def q_rows_by_id(spark, d):
    return rc.ordered(spark, d).rows(ROW_IDS, place="pos")


@query("row_slice", o.with_scene(f"SELECT * FROM rn WHERE row_id >= {SLICE[0]} AND row_id < {SLICE[1]}",
                                 _ROWNUM))
def q_row_slice(spark, d):
    return rc.ordered(spark, d).slice(*SLICE)


@query("anchor_series", o.with_scene(
    f"SELECT * FROM data WHERE PID = (SELECT PID FROM clear WHERE DOY = {DOY} "
    f"ORDER BY {mix_sql('PID', SEED)}, PID LIMIT 1)"))
def q_anchor_series(spark, d):
    t = rc.tables(spark, d)
    return sp.anchor_series(rc.prepared(spark, d), t.clear, DOY, SEED)


@query("impute_mode", o.with_scene(
    "SELECT f_B02 AS B02, f_B03 AS B03, f_B04 AS B04, B05, NDVI, X, Y, DOY, PID FROM fm "
    "WHERE f_B02 IS NOT NULL AND f_B03 IS NOT NULL AND f_B04 IS NOT NULL",
    ",\n".join(
        [f"mc{i}_{b} AS (SELECT {', '.join(list(ctx) + [b])}, count(*) AS n FROM clear WHERE {b} IS NOT NULL "
         f"GROUP BY {', '.join(list(ctx) + [b])})"
         for i, ctx in enumerate(fill.DEFAULT_CONTEXTS) for b in BANDS]
        + [f"mm{i}_{b} AS (SELECT {''.join(c + ', ' for c in ctx)}arg_max({b}, (n, -{b})) AS c{i}_{b} "
           f"FROM mc{i}_{b} {'GROUP BY ' + ', '.join(ctx) if ctx else ''})"
           for i, ctx in enumerate(fill.DEFAULT_CONTEXTS) for b in BANDS]
        + ["fm AS (SELECT ti.*, " + ", ".join(
            f"COALESCE({b}, mm0_{b}.c0_{b}, mm1_{b}.c1_{b}, mm2_{b}.c2_{b}) AS f_{b}" for b in BANDS)
           + " FROM ti " + " ".join(
               f"LEFT JOIN mm0_{b} ON ti.PID = mm0_{b}.PID LEFT JOIN mm1_{b} ON ti.DOY = mm1_{b}.DOY "
               f"CROSS JOIN mm2_{b}" for b in BANDS) + ")"])))
def q_impute_mode(spark, d):
    t = rc.tables(spark, d)
    return fill.impute(rc.impute_table(t), t.clear, method="mode")



def _ctx_counts_sql() -> str:
    long = " UNION ALL ".join(f"SELECT PID, DOY, '{b}' AS band, {b} AS value FROM clear WHERE {b} IS NOT NULL"
                              for b in BANDS)
    parts = [
        "SELECT 'PID' AS context, PID, CAST(NULL AS INTEGER) AS DOY, band, value, count(*) AS n FROM lg "
        "GROUP BY PID, band, value",
        "SELECT 'DOY' AS context, CAST(NULL AS INTEGER) AS PID, DOY, band, value, count(*) AS n FROM lg "
        "GROUP BY DOY, band, value",
        "SELECT 'all' AS context, CAST(NULL AS INTEGER) AS PID, CAST(NULL AS INTEGER) AS DOY, band, value, "
        "count(*) AS n FROM lg GROUP BY band, value",
    ]
    return o.with_scene(" UNION ALL ".join(parts), f"lg AS ({long})")


@query("fit_contexts", _ctx_counts_sql())
def q_fit_contexts(spark, d):
    return fill.context_counts(rc.tables(spark, d).clear)
