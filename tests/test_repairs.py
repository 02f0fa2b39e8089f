"""Independence of the hash choices, and inputs that used to lose data."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.expr import float_text, mix, mix_sql, pick, uniform, uniform_sql
from tessera.operators import fill, ids, metrics, sampling, scene, synth, text, udf

IDS = [p * 1000 + d for p in range(1500) for d in (171, 179, 187, 195)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i,) for i in IDS], "row_id long").cache()


def chi2(counts, cells, n):
    return sum((counts.get(c, 0) - n / len(cells)) ** 2 for c in cells) / (n / len(cells))


def test_all_orders_occur(rows):
    df = rows.select("row_id", *[F.lit(i).alias(c) for i, c in enumerate("abcde")])
    got = Counter(r.text for r in text.row_text_shuffled(df, list("abcde"), seed=3).collect())
    parts = [f"{c} is {i}" for i, c in enumerate("abcde")]
    orders = [", ".join(p) for p in itertools.permutations(parts)]
    assert set(got) == set(orders) and chi2(got, orders, len(IDS)) < 119 + 4 * math.sqrt(2 * 119)
    tail = Counter(r.text for r in text.row_text_conditional(df, list("abcde"), 2).collect())
    assert len(tail) == 6


@pytest.mark.parametrize("n", [2, 3, 4, 6])
def test_even_picks(rows, n):
    got = Counter(r[0] for r in rows.select(pick(F.col("row_id"), n, 7)).collect())
    assert set(got) == set(range(n)) and chi2(got, range(n), len(IDS)) < n + 5 * math.sqrt(2 * n)


def test_bands_are_drawn_independently(spark, rows):
    train = spark.createDataFrame([(1, a, b) for a in (1, 2) for b in (3, 4)], "DOY int, B02 int, B03 int")
    todo = rows.select("row_id", F.lit(1).alias("DOY"), F.lit(None).cast("int").alias("B02"),
                       F.lit(None).cast("int").alias("B03"))
    got = Counter((r.B02, r.B03) for r in
                  synth.impute_draw(todo, train, "row_id", ["B02", "B03"], temperature=0.7).collect())
    cells = [(float(a), float(b)) for a in (1, 2) for b in (3, 4)]
    assert chi2(got, cells, len(IDS)) < 3 + 5 * math.sqrt(6)


def test_hash_uses_all_bits_and_matches_sql(spark):
    import duckdb

    keys = [0, 1, -1, 2**31, 2**32 + 5, -2**40, 2**62, 140_000_000_000]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for stream in (0, 3):
        got = [tuple(r) for r in df.select(mix(F.col("k"), 9, stream), uniform(F.col("k"), 9, stream)).collect()]
        want = [duckdb.sql(f"SELECT {mix_sql(str(k), 9, stream)}, {uniform_sql(str(k), 9, stream)}").fetchall()[0]
                for k in keys]
        assert got == want and len(set(got)) == len(keys)


def test_synthesize_gives_n_rows_or_raises(spark):
    train = spark.createDataFrame([(d, d * 10 + i, i) for d in (1, 2) for i in range(4)], "DOY int, B02 int, B03 int")
    keys = spark.range(5).withColumnRenamed("id", "k")
    out = synth.synthesize(keys, "k", train, "DOY", ["B02", "B03"], n=100).collect()
    assert len(out) == 100
    # chained: each pair was seen together
    assert {(r.DOY, r.B02, r.B03) for r in out} <= {(d, d * 10.0 + i, float(i)) for d in (1, 2) for i in range(4)}
    empty = train.withColumn("B02", F.lit(None).cast("int"))
    with pytest.raises(RuntimeError):
        synth.synthesize(keys, "k", empty, "DOY", ["B02"], n=3, max_rounds=2)


def test_intervals_meet_at_any_temperature(spark):
    counts = spark.createDataFrame([(i, 1 + i % 7) for i in range(60)], "value int, n long")
    cdf = sorted((r.lo, r.hi) for r in synth.cdf_table(counts, "value", temperature=0.7).collect())
    assert cdf[0][0] == 0 and cdf[-1][1] == 1 and all(a[1] == b[0] for a, b in zip(cdf, cdf[1:]))


def test_mode_keeps_each_bands_type(spark):
    train = spark.createDataFrame([(1, 171, 5, 0.5), (1, 171, 5, 0.5)], "PID int, DOY int, B02 int, NDVI double")
    todo = spark.createDataFrame([(1, 171, None, None)], train.schema)
    assert fill.impute(todo, train, ["B02", "NDVI"], method="mode").first()[2:] == (5, 0.5)


def test_uncastable_column_stays(spark):
    df = spark.createDataFrame([("a7", "1", 2.9), ("3", "2", 3.1)], "a string, b string, c double")
    out = scene.project_cast(df, ["a", "b", "c"], keep=())
    assert out.dtypes == [("a", "string"), ("b", "int"), ("c", "int")]
    assert sorted(tuple(r) for r in out.collect()) == [("3", 2, 3), ("a7", 1, 2)]


def test_null_key_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 2), (None, 3), (1, 2), (0, 9)], "X int, Y int")
    assert sorted(map(tuple, ids.dense_ids(df, ["X", "Y"]).collect()), key=str) == \
        [(0, 9, 0), (1, 2, 1), (1, 2, 1), (None, 3, None)]


def test_histogram_has_every_bin(spark):
    got = {r.bin: r.n for r in metrics.band_histogram(spark.createDataFrame([(0,), (0,), (10,)], "v int"), "v").collect()}
    assert len(got) == 256 and got[0] == 2 and got[255] == 1 and sum(got.values()) == 3


def test_absent_class_gives_no_sample(spark):
    df = spark.createDataFrame([(i, 1) for i in range(9)], "k long, c int")
    assert sampling.balanced_sample(df, "c", "k", 4).count() == 0
    both = df.unionByName(spark.createDataFrame([(i, 0) for i in range(20, 25)], "k long, c int"))
    assert Counter(r.c for r in sampling.balanced_sample(both, "c", "k", 100).collect()) == {0: 2, 1: 2}


def test_exact_split_with_further_keys(spark):
    df = spark.createDataFrame([(p, d, z) for p in range(9) for d in (1, 1001) for z in range(4)], "p int, d int, z int")
    for frac in (0, 0.05, 0.5, 1):
        train, test = sampling.exact_split(df, ["p", "d", "z"], frac)
        assert test.count() == math.ceil(frac * 72) and train.count() + test.count() == 72
        assert train.intersect(test).count() == 0


def test_float_text_is_pythons(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, 0.00044, 12345678.0, 1e16, 1e15, 1e-4, 1e-5, -2.5e-7, 1.5e300, 123456789.125, 0.1, 1e22, 9.5e-05]
    values += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 20) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", float_text("v").alias("t")).collect()
    # the JVM may print a digit more than the shortest form, never another number
    assert [r.t for r in got if float(r.t) != r.v or ("e" in r.t) != ("e" in repr(r.v))] == []
    assert [r.t for r in got[:14]] == [repr(v) for v in values[:14]]


def test_line_break_in_a_value(spark):
    df = spark.createDataFrame([(1, "B02 is 3\n4, B03 is 5")], "row_id long, text string")
    assert tuple(text.text_to_row(df, ["B02", "B03"]).first())[1:] == ("3\n4", "5")


def test_batch_rows_leaves_the_session_alone(spark):
    df = spark.range(20).select(F.col("id").alias("k"), F.lit(None).cast("double").alias("b")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def model(pdf, seed):
        pdf["b"] = float(len(pdf))
        return pdf

    got = udf.impute_with(df, model, ["b"], batch_rows=6).collect()
    assert Counter(r.b for r in got) == {6.0: 18, 2.0: 2}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_log_folders_are_no_patterns(spark, tmp_path):
    import json

    from tessera.operators import runlog

    paths = []
    for i, name in enumerate(["run[0]", "run[1]", "a b+c", "deep/run[0]"]):
        folder = tmp_path / name
        folder.mkdir(parents=True)
        (folder / "t.json").write_text(json.dumps({"log_history": [{"step": i, "loss": 0.5}, {"step": i + 10}]}))
        paths.append(str(folder / "t.json"))
    got = sorted((r.run, r.step) for r in runlog.read_trainer_states(spark, paths).collect())
    assert got == sorted((i, s) for i in range(4) for s in (i, i + 10))


def test_run_ledger_and_scene_csv(spark, tmp_path):
    from tessera.sources import artefacts, scene as source

    for i in range(2):
        artefacts.append_run(spark, str(tmp_path / "ledger"), run=i, note="n")
    assert sorted(r.run for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == [0, 1]
    merges = spark.createDataFrame([(0, "a", "b", 3)], "rank int, a string, b string, n long")
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "ab")], "id long, token string")
    artefacts.save_tokenizer(str(tmp_path / "tok"), vocab, merges)
    back, rules = artefacts.load_tokenizer(spark, str(tmp_path / "tok"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vocab.collect()))
    assert [(r.a, r.b) for r in rules.collect()] == [("a", "b")]
    assert source.read_scene_csv is not None


def test_rows_of_one_hash_are_parted_by_their_keys(spark):
    df = spark.createDataFrame([(k, "v") for k in range(50)], "k long, v string")
    rows = sampling.hashed(df, F.lit(70_000).cast("long"))
    for cut in (0, 1, 17, 50, 60):
        kept = rows.filter(sampling.rank_below(rows, ["k"], cut))
        assert sorted(r.k for r in kept.collect()) == list(range(min(cut, 50)))
    with pytest.raises(ValueError, match="null key"):
        sampling.exact_split(df.unionByName(df.limit(1).withColumn("k", F.lit(None).cast("long"))), ["k"], 0.5)
    plan = rows.filter(F.col("_h") < 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("monotonically_increasing_id")  # the filter stays above the hash


def test_one_maximum_for_the_frame_and_dates_in_list_order(spark):
    df = spark.createDataFrame([(1, 5), (None, 7)], "a int, b int")
    assert sorted(tuple(r) for r in scene.fill_with_max(df, ["a", "b"]).collect()) == [(1, 5), (7, 7)]
    assert scene.fill_with_max(df, ["a"]).filter("a is null").count() == 0
    days = spark.createDataFrame([(171, 1), (187, 2), (203, 3), (171, 4)], "DOY int, v int")
    assert [r.DOY for r in scene.select_doys(days, [187, 171]).collect()] == [187, 171, 171]
    assert [r.DOY for r in scene.select_doys(days, [203, 203]).collect()] == [203, 203]


def test_prompts_print_numbers_as_the_corpus(spark):
    df = spark.createDataFrame([(1, 0.00044, 7, None), (2, 3.0, 8, 1)], "row_id long, x double, y int, z int")
    got = {r.row_id: r.enc for r in text.partial_row_text(df, ["x", "y", "z"]).collect()}
    assert got == {1: "x is 0.00044, y is 7", 2: "x is 3, y is 8, z is 1"}
    whole = {r.row_id: r.text for r in text.row_text(df, ["x", "y", "z"]).collect()}
    assert whole[1].startswith(got[1])


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_ids_shuffle_rows_once(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 2, 3, 9]), rnd.choice([None, math.nan, 0.5, 2.0]), i) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "X int, Y double, v int")
    got = ids.dense_ids(df, ["X", "Y"], "id", n=5)
    assert "hashpartitioning" not in plan_of(got) and got.columns == ["X", "Y", "v", "id"]

    def key(x, y):
        return x, math.inf if math.isnan(y) else y  # NaN is the largest number

    known = sorted({key(x, y) for x, y, _ in rows if x is not None and y is not None})
    want = Counter((i, None if x is None or y is None else known.index(key(x, y))) for x, y, i in rows)
    assert Counter((r.v, r.id) for r in got.collect()) == want
    assert ids.dense_ids(df.limit(0), ["X", "Y"]).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_go_on_from_partition_to_partition(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice("aaaaaab") if i < 190 else rnd.choice("cdef"), i, rnd.choice([0, 1, 5, 1 << 40])) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, 500, 1)], "g string, k int, n long")
    got = ids.cumulative_sum(df, ["k"], "n", "upto", group=["g"], n=parts)
    assert "Window" not in plan_of(got) and "Exchange" not in plan_of(got)
    want = {i: sum(n for g, j, n in rows if g == own and j <= i) for own, i, _ in rows}
    assert {r.k: r.upto for r in got.collect()} == want
    whole = ids.cumulative_sum(df.withColumn("n", F.col("n").cast("double")), ["k"], "n", "upto", n=parts)
    every = [*rows, (None, 500, 1)]
    assert {r.k: r.upto for r in whole.collect()} == {i: sum(n for _, j, n in every if j <= i) for _, i, _ in every}
    assert ids.cumulative_sum(df.limit(0), ["k"], "n", group=["g"], n=parts).count() == 0
    large = spark.createDataFrame([("a", i, (1 << 63) - 9) for i in range(2)], "g string, k int, n long")
    with pytest.raises(Exception, match="64 bits"):
        ids.cumulative_sum(large, ["k"], "n", "upto", group=["g"], n=parts).collect()


def test_draws_are_looked_up_without_a_second_shuffle(spark):
    starts = spark.createDataFrame([(g, 10 * i, f"{g}-{i}") for g in (1, 2, 3) for i in range(40)],
                                   "_g long, _from long, _value string").repartition(4)
    rows = spark.range(3000).selectExpr("id AS k", "1 + id % 3 AS _g", "id * 7 % 400 AS _pos").repartition(6)
    got = synth.interval_lookup(rows, starts, "_value", "v", ["k"])
    assert "Window" not in plan_of(got) and "Exchange" not in plan_of(got)
    assert {r.k: r.v for r in got.collect()} == {k: f"{1 + k % 3}-{k * 7 % 400 // 10}" for k in range(3000)}


def test_modes_of_many_small_groups_take_one_shuffle(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, 0.0, -0.0, math.nan, 1.5]), rnd.choice([None, 2.5, 3.5]))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "PID int, a double, b double")
    few = fill.modes(df, ["PID"], ["a", "b"])
    assert plan_of(few).count("Exchange") == 1
    monkeypatch.setattr(fill, "FEW_ROWS", -1)
    assert sorted(map(str, few.collect())) == sorted(map(str, fill.modes(df, ["PID"], ["a", "b"]).collect()))
