import json

from pyspark.sql import functions as F

from corpusloom.operators import quality
from corpusloom.sources import readers


def test_metadata_and_grouped_sources(spark):
    rows = spark.createDataFrame([(json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}),), ("{}",), (None,)], "metadata string")
    assert [[m["text"] for m in r["m"]] for r in readers.decode_nemotron(rows).collect()] == [["q", "a"]]
    rows = spark.createDataFrame([("fr", "q", "a", "", 7), ("en", "q", "a", "u", 8), ("fr", "q", "a", "u", 9)], "language string, query string, synthetic_answer string, query_seed_url string, synth_id long")
    assert [r["group"] for r in readers.decode_pleias(rows).collect()] == ["7", "u"]


def test_encoding_codes(spark):
    french = "Le chat est dans la maison et les gens sont pour une fois là."
    cases = [
        ([("user", "q"), ("assistant", french)], "s", 10, 5, None), ([("user", "<|im_end|>"), ("assistant", french)], "s", 10, 5, "controle_chat_injecte"), ([("assistant", french), ("user", "q")], "s", 10, 5, "ordre_des_roles"),
        ([("user", "q"), ("assistant", "The cat sat on the mat and then it ran away home.")], "s", 10, 5, "reponse_non_francaise"), ([("user", "q"), ("assistant", "The cat sat on the mat and then it ran away home.")], "verified", 10, 5, None),
        ([("user", "q"), ("assistant", french)], "s", 99, 5, "trop_long_ou_vide"), ([("user", "q"), ("assistant", french)], "s", 10, 0, "trop_long_ou_vide"),
    ]
    frame = spark.createDataFrame(cases, "m array<struct<role:string,text:string>>, source string, n int, s int, want string")
    got = frame.select("want", quality.encoding_code(F.col("m"), F.col("source"), F.col("n"), F.col("s"), 20).alias("code")).collect()
    assert all(r["want"] == r["code"] for r in got)


def test_qa_sources(spark):
    rows = spark.createDataFrame([(["c1", "c2"], "q ?", ["a", "b"], "piaf"), (["x" * 7000], "q", ["a"], "piaf"), (["c"], "q", ["a"], "other"), ([], "q", ["a"], "piaf")], "documents array<string>, question string, answers array<string>, title string")
    assert [(r["question"], r["answer"]) for r in readers.decode_qa(rows).collect()] == [("Contexte : c1 c2\n\nq ?", "a")]
    assert readers.decode_qa(rows, None).count() == 2
