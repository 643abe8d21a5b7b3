import json

import pytest

from corpusloom.operators import profiles, task_bank, verifiers
from corpusloom.sources import restart


@pytest.mark.parametrize("schema", sorted(task_bank.DRAWS))
@pytest.mark.parametrize("split", task_bank.SPLITS)
def test_each_schema_s_solution_is_right(schema, split):
    capability = next(c for c, own in task_bank.SCHEMAS.items() if schema in own)
    for seed in range(6):
        task = task_bank.make_task(seed, split, seed / 5, capability, schema)
        assert verifiers.verify_one(json.loads(task["answer"]), task["solution"])[0] and task == task_bank.make_task(seed, split, seed / 5, capability, schema)
        assert not verifiers.verify_one(json.loads(task["answer"]), "je passe")[0]


def test_tasks_are_drawn_by_weight_and_unknown_ones_refused():
    made = [task_bank.make_task(n)["capability"] for n in range(600)]
    assert all(abs(made.count(c) / 600 - w) < 0.07 for c, w in task_bank.CAPABILITIES.items())
    for bad in ({"split": "sealed"}, {"capability": "x"}, {"capability": "code", "schema": "mean_three"}):
        with pytest.raises(ValueError):
            task_bank.make_task(1, **bad)


def test_bank_files(spark, tmp_path):
    bank = task_bank.tasks(spark, 60, "dev", 5)
    manifest = task_bank.write_bank(bank, str(tmp_path / "bank"))
    assert sum(r["tasks"] for r in manifest.collect()) == 60
    back = task_bank.read_bank(spark, str(tmp_path / "bank"))
    assert sorted(back.collect()) == sorted(bank.collect()) and sorted(manifest.collect()) == sorted(task_bank.bank_manifest(bank).collect())
    with pytest.raises(FileExistsError):
        task_bank.write_bank(bank, str(tmp_path / "bank"))


def test_code_runs_over_its_tests():
    spec = {"kind": "code", "function_name": "f", "tests": [[[2], 4], [[-1], -2]]}
    code = lambda body: verifiers.verify_one(spec, f"```python\ndef f(n):\n    {body}\n```")
    assert code("return 2 * n")[:2] == (True, 1.0) and code("return 2 * n")[4] is None
    assert code("return 4")[0] is False and abs(code("return 4")[1] - 0.35) < 1e-9 and code("return 4")[4] == "code_tests"
    assert code("return n / 0")[4] == "code_tests" and code("return open(n)")[4] == "code_call_forbidden" and code("return n.real")[4] == "code_node_Attribute"
    assert code("while True: pass")[4] == "code_timeout" and verifiers.verify_one(spec, "def g(n): return 1")[4] == "code_function" and verifiers.verify_one(spec, "def f(")[4] == "code_syntax"


def test_restartable_builds(spark, tmp_path):
    root, calls = str(tmp_path), []

    def make():
        calls.append(1)
        return spark.createDataFrame([(1, "a", "train", 5), (2, "b", "val", 1)], "id long, t string, split string, tokens long")

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "rubbish").write_text("left by an interrupted build")
    report = restart.build_source(spark, root, "s", 10, "tok1", make)
    assert report["rows"] == 2 and restart.build_source(spark, root, "s", 10, "tok1", make) == report and len(calls) == 1 and not (tmp_path / "s" / "rubbish").exists()
    for target, recipe in ((11, "tok1"), (10, "tok2")):
        with pytest.raises(ValueError):
            restart.build_source(spark, root, "s", target, recipe, make)
    pool = f"{root}/s/rows"
    assert restart.reusable_pool(spark, pool, "tokens", "split", 5).count() == 2 and restart.reusable_pool(spark, pool, "tokens", "split", 6) is None
    assert restart.reusable_pool(spark, f"{root}/none", "tokens", "split", 1) is None
    make().limit(1).write.mode("append").parquet(pool)
    with pytest.raises(ValueError):
        restart.build_source(spark, root, "s", 10, "tok1", make)


def test_refinement_refuses_another_task(spark):
    schema = "position long, task_id string, k long, successes long, initial_successes long, first_success long, entropy double"
    rows = spark.createDataFrame([(0, "a", 4, 1, 1, 0, 1.0), (1, "b", 4, 2, 2, 1, 0.5)], schema)
    old = spark.createDataFrame([(0, "a", 2, 2, 2, 1, 0.4)], schema)
    got = {r["position"]: r for r in profiles.refine(rows, old).collect()}
    assert (got[0]["k"], got[0]["successes"], got[0]["initial_successes"], got[0]["first_success"], got[0]["entropy"]) == (6, 3, 2, 1, 0.8) and got[1]["k"] == 4
    with pytest.raises(Exception, match="another task"):
        profiles.refine(rows, old.selectExpr("position", "'z' as task_id", "k", "successes", "initial_successes", "first_success", "entropy")).collect()
