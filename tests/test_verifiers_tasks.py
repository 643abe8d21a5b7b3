import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import generators, preferences, profiles, programs, verifiers


@pytest.mark.parametrize(
    ("spec", "text", "want"),
    [
        ({"kind": "integer", "value": 12}, "Réponse : 12", None),
        ({"kind": "integer", "value": 12}, "12 ou 13", "number_ambiguous"),
        ({"kind": "integer", "value": 12}, "12,0", "number_wrong"),
        ({"kind": "rational", "value": "1/2"}, "donc 0,5", None),
        ({"kind": "integer", "value": 12}, "douze", "number_missing"),
        ({"kind": "integer", "value": 12, "strict_number_only": True}, "12.", "number_only_format"),
        ({"kind": "choice", "value": "Élan", "choices": ["Élan", "Lynx"]}, "c'est un elan", None),
        ({"kind": "choice", "value": "Élan", "choices": ["Élan", "Lynx"]}, "élan ou lynx", "choice_conflict"),
        ({"kind": "choice", "value": "Élan"}, "élancé", "choice_missing"),
        ({"kind": "abstain"}, "Information insuffisante.", None),
        ({"kind": "abstain"}, "42", "abstain_missing"),
        ({"kind": "json", "value": {"n": 1}, "json_schema": {"n": "integer"}}, '```json\n{"n": 1}\n```', None),
        ({"kind": "json", "value": {"n": 1}, "json_schema": {"n": "integer"}}, '{"n": true}', "json_type"),
        ({"kind": "json", "value": {"n": 1}, "json_schema": {"n": "integer"}}, '{"n": 1, "m": 2}', "json_keys"),
        ({"kind": "json", "value": {"n": 1}, "json_schema": {"n": "integer"}}, "[1]", "json_not_object"),
        ({"kind": "json", "value": {"n": 1}, "json_schema": {"n": "integer"}}, "{", "json_invalid"),
        ({"kind": "code", "function_name": "f"}, "```python\ndef f(x):\n    return sum(x)\n```", None),
        ({"kind": "code", "function_name": "f"}, "def f(x):\n    return open(x)", "code_call_forbidden"),
        ({"kind": "code", "function_name": "f"}, "import os\ndef f(x):\n    return 1", "code_node_Import"),
        ({"kind": "integer", "value": 1}, "<think>1</think> ", "empty_final"),
        ({"kind": "integer", "value": 1}, None, "empty_final"),
    ],
)
def test_typed_verdicts(spec, text, want):
    got = verifiers.verify_one(spec, text)
    assert got[4] == want and got[0] == (want is None)


def test_code_runs_in_isolation():
    good = "def f(x):\n    return x + 1"
    assert verifiers.run_code(good, "f", [[[1], 2], [[2], 3]]) == (1.0, 2, 2)
    assert verifiers.run_code(good, "f", [[[1], 2], [[2], 4]])[1:] == (1, 2)
    assert verifiers.run_code("def f(x):\n    while True:\n        pass", "f", [[[1], 2]], 0.5)[0] == 0.0


def test_strict_scores():
    assert verifiers.strict_score("num", "5", [], "Calcul 2 + 3. Réponse : 5") == ("correct", "numeric_final_unique")
    assert verifiers.strict_score("num", "5", [], "5 ou 6")[0] == "manual_review"
    assert verifiers.strict_score("num", "5", [], "0,5")[0] == "incorrect"
    assert verifiers.strict_score("choix", "Léa", ["Léa", "Max"], "C'est Lea.")[0] == "correct"
    assert verifiers.strict_score("choix", "Léa", ["Léa", "Max"], "je pense que peut-être Léa a raison ici")[0] == "manual_review"
    assert verifiers.fact_score("paris", "Paris. Non, Lyon.") == "correct" and verifiers.fact_score("lyon", "Paris. Non, Lyon.") == "incorrect"


def test_program_tasks_hold_what_they_promise(spark):
    rows = programs.tasks(spark, 120).collect()
    for r in rows:
        node = json.loads(r["program_ast"])
        assert programs.program_split(node) == r["split"] and programs.program_key(node) == r["program_key"]
        if r["objective"] in ("execute", "number_only"):
            assert str(programs.evaluate(node)) == r["target"]
        if r["objective"] == "order_steps":
            assert r["target"] in r["valid_orders"]
        if r["objective"] == "find_error":
            wrong = []
            for line in r["prompt"].split("\n")[1:]:
                number, rest = line.split(". ", 1)
                left, right = rest.replace("×", "*").replace("−", "-").split(" = ")
                values = {f"r{i + 1}": int(x.rsplit("= ", 1)[1]) for i, x in enumerate(r["prompt"].split("\n")[1:])}
                if eval(left, {}, values) != int(right):  # noqa: S307 arithmetic of our own making
                    wrong.append(number)
            assert wrong == [r["target"]]
    assert rows == programs.tasks(spark, 120).repartition(5).sort("id").collect() or len(rows) == programs.tasks(spark, 120).count()
    assert programs.program_key({"op": "add", "args": [{"op": "const", "value": 2}, {"op": "const", "value": 3}]}) == programs.program_key({"op": "add", "args": [{"op": "const", "value": 3}, {"op": "const", "value": 2}]})
    assert verifiers.score_program_output(programs.tasks(spark, 60).withColumn("output", F.col("answer"))).where("not success").isEmpty()
    with pytest.raises(ValueError):
        programs.make_task(1, "train", "find_error", 2, 5)


def test_problems_are_right_and_repeatable(spark):
    own = generators.problems(spark, 300, 9)
    a, b = own.orderBy("n").collect(), own.repartition(7).orderBy("n").collect()
    assert a == b and len({r["family"] for r in a}) >= 10
    conversations = generators.as_conversations(own)
    assert conversations.where(~generators.well_formed(F.col("m"))).isEmpty()
    kept = generators.unique_until_budget(conversations, 3000).collect()
    assert 0 < len(kept) < 300 and max(Counter(r["q"] for r in kept).values()) == 1


def test_pairs_follow_the_rules(spark):
    candidate = lambda i, text="t", stopped=True: (f"c{i}", f"{text}{i}", stopped, 0.0)
    rows = [("p1", [candidate(1), candidate(2), candidate(3), candidate(4)]), ("p2", [candidate(1), candidate(2)]), ("p3", [candidate(1, stopped=False), candidate(2)]), ("p4", [candidate(1), candidate(2)])]
    candidates = spark.createDataFrame(rows, "prompt_id string, candidates array<struct<candidate_id:string,text:string,stopped:boolean,repeat_ratio:double>>")
    schema = "prompt_id string, ranking array<string>, scores map<string,int>, unsafe array<string>"
    a = [("p1", ["c1", "c2", "c3", "c4"], {"c1": 4, "c2": 3, "c3": 1, "c4": 0}, []), ("p2", ["c1", "c2"], {"c1": 3, "c2": 1}, []), ("p3", ["c1", "c2"], {"c1": 3, "c2": 1}, []), ("p4", ["c1", "c2"], {"c1": 2, "c2": 2}, [])]
    b = [("p1", ["c1", "c3", "c2", "c4"], {"c1": 4, "c2": 2, "c3": 2, "c4": 0}, []), ("p2", ["c2", "c1"], {"c1": 1, "c2": 3}, []), a[2], a[3]]
    got = preferences.preference_pairs(candidates, spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    by = {(r["prompt_id"], r["rejected_id"]): r for r in got}
    assert by[("p1", "c4")]["margin"] == 4 and by[("p1", "c3")]["margin"] == 2 and ("p1", "c2") not in by
    assert by[("p2", None)]["reason"] == "judge_top_disagreement" and by[("p3", None)]["reason"] == "chosen_invalid" and by[("p4", None)]["reason"] == "no_clear_margin"


def test_forged_judgments_are_named(spark):
    rows = [(["a", "b"], {"a": 2, "b": 1}, []), (["a"], {"a": 2, "b": 1}, []), (["a", "b"], {"a": 1, "b": 2}, []), (["a", "b"], {"a": 9, "b": 1}, []), (["a", "b"], {"a": 2, "b": 1}, ["z"])]
    frame = spark.createDataFrame(rows, "r array<string>, s map<string,int>, u array<string>")
    ids = F.array(F.lit("a"), F.lit("b"))
    assert [x["p"] for x in frame.select(preferences.judgment_problem(F.col("r"), F.col("s"), F.col("u"), ids).alias("p")).collect()] == [None, "ranking", "incoherent", "scores", "unsafe_unknown"]


def test_gates_and_bridges(spark):
    rows = spark.createDataFrame([("c", "s1", 0.4, 2, 4), ("c", "s2", 0.3, 0, 4), ("c", "s2", 0.2, 0, 4)], "capability string, schema_id string, difficulty double, successes int, k int")
    schemas = spark.createDataFrame([("c", "s1"), ("c", "s2"), ("c", "s3")], "capability string, schema_id string")
    assert {(r["schema_id"], r["difficulty"]) for r in profiles.bridge_schemas(schemas, rows).collect()} == {("s2", 0.2), ("s3", 0.2)}
    assert [r["weight"] for r in profiles.frontier_weights(rows).collect()] == [0.25]
