"""Training-log source and analytics on hand-written log files."""

import json

from tessera.operators import runlog as rl
from tessera.sources.ordered import OrderedTable, write_ordered


def test_read_trainer_states_and_stitch(spark, tmp_path):
    logs = [[{"epoch": 1.0, "learning_rate": 1e-4, "loss": 1.0, "step": 100},
             {"epoch": 2.0, "learning_rate": 1e-4, "loss": 0.8, "step": 200}],
            [{"epoch": 1.56, "learning_rate": 3.90625e-06, "loss": 0.4483, "step": 200}]]
    paths = []
    for i, lh in enumerate(logs):
        p = tmp_path / f"run{i}.json"
        p.write_text(json.dumps({"log_history": lh}, indent=2))
        paths.append(str(p))
    flat = rl.read_trainer_states(spark, paths)
    assert sorted((r["run"], r["step"]) for r in flat.collect()) == [(0, 100), (0, 200), (1, 200)]
    st = {(r["run"], r["step"]): r["global_step"] for r in rl.stitch_steps(flat).collect()}
    assert st == {(0, 100): 100, (0, 200): 200, (1, 200): 400}
    log = rl.ordered_log(flat.select("run", "step", "loss"), str(tmp_path / "log"))
    d = {(r["run"], r["step"]): r["delta"] for r in rl.loss_delta(log).collect()}
    assert d[(0, 100)] == 0.0
    assert abs(d[(0, 200)] + 0.2) < 1e-12 and abs(d[(1, 200)] - (0.4483 - 0.8)) < 1e-12


def test_states_of_many_runs(spark, tmp_path):
    rows = [{"run": 5, "log_history": [{"loss": 1.5, "step": 10}, {"loss": 1.0, "step": 20}]},
            {"run": 7, "log_history": []}, {"run": 8, "log_history": None}, {"run": 2, "log_history": [{"step": 1}]}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got = sorted(tuple(r)[:4] for r in rl.read_state_lines(spark, str(tmp_path)).collect())
    assert got == [(2, 0, 1, None), (5, 0, 10, 1.5), (5, 1, 20, 1.0)]


def test_ordered_table_reads_by_position(spark, tmp_path):
    n = 1000
    df = spark.range(n).selectExpr("id * 7919 % 1009 AS a", "CAST(id % 5 AS INT) AS b", "CAST(id AS DOUBLE) AS v") \
        .repartition(5)
    path = str(tmp_path / "t")
    write_ordered(df, ["a", "b"], path, 6)
    t = OrderedTable(spark, path)
    want = sorted(((r.a, r.b, r.v) for r in df.collect()))
    assert t.total == n and len(t.offsets) == 6
    assert [(r.row_id, r.a) for r in t.positions().orderBy("row_id").collect()] == [(i, w[0]) for i, w in enumerate(want)]
    part = t.slice(150, 400)
    assert sorted((r.row_id, r.a) for r in part.collect()) == [(i, want[i][0]) for i in range(150, 400)]
    assert len(part.inputFiles()) < 6 and t.slice(5, 5).count() == 0 and t.slice(n, n + 9).count() == 0
    assert [(r._pos, r.a) for r in t.rows([999, 0, 999, 5000]).collect()] == [(0, want[999][0]), (1, want[0][0]),
                                                                             (2, want[999][0])]
    before = {r.a: r.p for r in t.with_previous("v", "p").collect()}
    assert before == {w[0]: (want[i - 1][2] if i else None) for i, w in enumerate(want)}
    write_ordered(df.limit(0), ["a", "b"], str(tmp_path / "e"))
    empty = OrderedTable(spark, str(tmp_path / "e"))
    assert empty.total == 0 and empty.positions().count() == 0 and empty.with_previous("v", "p").count() == 0


def test_log_tail_cut_sizes(spark, tmp_path):
    log = spark.createDataFrame([(r, s, float(s)) for r in range(2) for s in range(1, 13)],
                                "run int, step long, loss double")
    cuts = {r["cut"]: r["count"] for r in rl.log_tail(rl.ordered_log(log, str(tmp_path / "l"))).groupBy("cut").count().collect()}
    n = 24
    assert cuts["n//12"] == n - n // 12 and cuts["n//2"] == n - n // 2
    assert cuts["n//2+n//4"] == n - (n // 2 + n // 4)
