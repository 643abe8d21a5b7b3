import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, sinks
from corpusloom.streaming import metrics

CHAT = "array<struct<role:string,text:string>>"


def test_tolerant_and_strict_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"t": "x"}\n\n{broken\n{"t": "y", "m": [{"role": "user", "text": "q"}]}\n')
    rows = readers.read_jsonl_tolerant(spark, str(path)).cache()
    assert rows.where(F.col(readers.CORRUPT).isNull()).count() == 2 and rows.where(F.col(readers.CORRUPT).isNotNull()).count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path)).collect()


def test_parquet_projection(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("t", "i", 1)], "text string, id string, extra int").write.parquet(path)
    assert readers.read_parquet(spark, [path]).columns == ["text", "id", "file"]
    with pytest.raises(ValueError):
        readers.read_parquet(spark, [path], ("url",))


def test_decoders(spark):
    gsm = spark.createDataFrame([("Q", "2+2=<<2+2=4>>4\n#### 4"), ("Q", "no mark"), ("", "a #### 1")], "question string, answer string")
    got = readers.decode_gsm8k(gsm).collect()
    assert len(got) == 1 and got[0]["m"][1]["text"] == "<think>\n2+2=4\n</think>\nLa réponse est 4."
    dolphin = spark.createDataFrame(
        [([("user", "q"), ("assistant", "<|begin_of_thought|>t<|end_of_thought|><|begin_of_solution|>s<|end_of_solution|>")],), ([("user", "q"), ("assistant", "plain")],)],
        "messages array<struct<role:string,content:string>>",
    )
    got = readers.decode_dolphin(dolphin).collect()
    assert len(got) == 1 and got[0]["m"][1]["text"] == "<think>\nt\n</think>\ns"
    human = spark.createDataFrame([("human", "human", False, "ctx", [("user", "q"), ("assistant", "a")]), ("bot", "human", False, None, [("user", "q"), ("assistant", "a")])], f"author string, style string, code boolean, context string, conversation {CHAT}")
    got = readers.decode_chat_human(human).collect()
    assert len(got) == 1 and got[0]["m"][0]["text"] == "Contexte :\nctx\n\nq"
    alpaca = spark.createDataFrame([("i", "x", "o"), ("i", None, "o"), ("", "x", "o")], "instruction string, input string, output string")
    assert [r["m"][0]["text"] for r in readers.decode_alpaca(alpaca).collect()] == ["i\n\nx", "i"]
    hermes = spark.createDataFrame([("Dis bonjour", "Bonjour.", False), ("Combien font 2", "Quatre.", False), ("Dis", "```x```", False), ("Dis", "Oui.", True)], "prompt string, accepted_completion string, bad_entry boolean")
    hermes = hermes.withColumn("bad_prompt_detected", F.lit(False)).withColumn("bad_response_detected", F.lit(None).cast("boolean"))
    assert readers.decode_openhermes(hermes).count() == 1
    messages = spark.createDataFrame([([("user", "q", None), ("tool", "z", None), ("assistant", None, "a")],), ([("user", "q", None)],)], "messages array<struct<role:string,content:string,text:string>>")
    assert [[m["role"] for m in r["m"]] for r in readers.decode_messages(messages).collect()] == [["user", "assistant"]]
    qa = spark.createDataFrame([("Question : a ?\nRéponse : b\nRéponse : c",), ("none",)], "t string")
    assert [(r["m"][0]["text"], r["m"][1]["text"]) for r in readers.decode_qa_text(qa).collect()] == [("a ?\nRéponse : b", "c")]


def test_message_trees(spark):
    schema = "message_tree_id string, message_id string, parent_id string, role string, lang string, deleted boolean, synthetic boolean, review_result boolean, rank int, quality double, text string, row_ord long"
    row = lambda tree, own, parent, role, rank, q, text, n, lang="fr": (tree, own, parent, role, lang, False, False, True, rank, q, text, n)
    rows = [
        row("t", "r", None, "prompter", None, 0.0, "Q", 0), row("t", "a1", "r", "assistant", 0, 0.6, "low", 1), row("t", "a2", "r", "assistant", None, 0.9, "high", 2),
        row("t", "a3", "r", "assistant", 1, 1.0, "ranked", 3), row("t", "p", "a2", "prompter", None, 0.1, "more", 4),
        row("u", "r2", None, "prompter", None, 0.0, "Q", 5), row("u", "b", "r2", "assistant", 0, 0.2, "poor", 6), row("v", "r3", None, "prompter", None, 0.0, "Q", 7, "en"),
        row("w", "r4", None, "prompter", None, 0.0, "Q4", 8), row("w", "c", "r4", "assistant", 0, 0.7, "A4", 9),
    ]
    got = {r["tree"]: [m["text"] for m in r["m"]] for r in readers.decode_oasst(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"w": ["Q4", "A4"]}  # t ends on a question, u's answer is poor, v is not French


def test_token_files_round_trip(spark, tmp_path):
    import numpy as np

    folder = tmp_path / "bins"
    folder.mkdir()
    np.array([5, 6, 0, 7, 0], "<u2").tofile(folder / "a.bin")
    np.array([0, 1, 0, 1, 0], np.uint8).tofile(folder / "a.mask")
    got = readers.read_token_files(spark, str(folder / "*.bin"), str(folder / "*.mask")).orderBy("document").collect()
    assert [(r["tokens"], r["mask"]) for r in got] == [([5, 6, 0], [0, 1, 0]), ([7, 0], [1, 0])]
    rows = spark.createDataFrame([(2, [7, 0], [1, 0]), (1, [5, 6, 0], [0, 1, 0])], "doc_id long, t array<int>, m array<int>")
    shards = sinks.write_token_shards(rows, str(tmp_path / "shards"), "t", "m").orderBy("first").collect()
    assert b"".join(bytes(s["ids"]) for s in shards) == np.array([5, 6, 0, 7, 0], "<u2").tobytes()


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.publish(spark.range(3).toDF("i"), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(1).toDF("i"), path)
    with pytest.raises(Exception):
        sinks.publish(spark.range(3).select(F.raise_error(F.lit("x")).alias("i")), path, overwrite=True)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir() if "stage" in p.name] == []


def test_running_average_continues_over_batches(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    schema = "run string, step long, loss double"

    def add(name, rows):
        (log / name).write_text("\n".join(json.dumps(dict(zip(("run", "step", "loss"), r))) for r in rows))

    def drive():
        metrics.run_to_table(metrics.running_average(metrics.read_log(spark, str(log), schema), 0.5), str(tmp_path / "out"), str(tmp_path / "check"))
        return {(r["run"], r["step"]): r["ema"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    add("1.json", [("a", 1, 4.0), ("a", 2, 2.0), ("b", 1, 1.0)])
    assert drive() == {("a", 1): 4.0, ("a", 2): 3.0, ("b", 1): 1.0}
    add("2.json", [("a", 2, 9.0), ("a", 3, 1.0)])
    assert drive()[("a", 3)] == 2.0


def test_counting_windows_reset(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text("\n".join(json.dumps({"key": "k", "seq": i, "ok": i % 2 == 0}) for i in range(7)))
    metrics.run_to_table(metrics.counting_windows(metrics.read_log(spark, str(log), "key string, seq long, ok boolean"), 3), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r["window"], round(r["rate"], 3)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0.667), (1, 0.333)]
