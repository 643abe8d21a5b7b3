import pytest
from pyspark.sql import functions as F

from corpusloom.functions import exact
from corpusloom.functions import text as X
from corpusloom.operators import quality


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


LONG = "Une phrase simple pour les gens qui lisent dans le calme. " * 6


def codes(spark, text):
    return one(spark, quality.document_code(F.col("t")), t=text)


def test_document_codes(spark):
    assert codes(spark, LONG) is None
    assert codes(spark, None) == "not_text"
    assert codes(spark, "") == "too_short"
    assert codes(spark, LONG + X.IM_START) == "special_token"
    assert codes(spark, LONG + "please buy cheap viagra") == "spam"
    assert codes(spark, "�" * 300) == "replacement_chars"
    assert codes(spark, "1234567890 " * 40) == "few_letters"
    assert codes(spark, "\n".join(["la même ligne encore une fois, oui"] * 12)) == "repeated_lines"


def conversation(spark, answer, source="chat_human", prompt="Bonjour ?", extra=()):
    m = [("user", prompt), ("assistant", answer), *extra]
    rows = spark.createDataFrame([(source, m)], "source string, m array<struct<role:string,text:string>>")
    return quality.clean_conversations(rows).first()


def test_conversation_codes(spark):
    assert conversation(spark, "Oui.")["reject"] is None
    assert conversation(spark, "<think>a")["reject"] == "balises_think_invalides"
    assert conversation(spark, "<think>a</think>")["reject"] == "reponse_finale_vide"
    assert conversation(spark, "x" * 2000)["reject"] == "reponse_trop_longue"
    assert conversation(spark, "un deux trois quatre " * 40)["reject"] == "repetition"
    assert conversation(spark, "Je suis ChatGPT.")["reject"] == "identite_etrangere"
    assert conversation(spark, "Je suis ChatGPT.", "identity")["reject"] is None
    assert conversation(spark, "J'ai 30 ans.")["reject"] == "persona_inventee"
    assert conversation(spark, "J'ai 30 ans.", "gsm8k")["reject"] is None
    assert conversation(spark, "Oui.", prompt="x" * 1900)["reject"] == "prompt_trop_long"
    assert conversation(spark, "", extra=[("system", "s")])["reject"] == "tour_manquant"
    assert conversation(spark, "Oui.", "nowhere")["reject"] == "messages_absents"


def test_empty_thinking_is_removed(spark):
    got = conversation(spark, "<think> </think>Oui.")
    assert got["note"] == "think_retire" and got["clean"][1]["text"] == "Oui."


def test_first_failing_message_names_the_code(spark):
    got = conversation(spark, "Je suis ChatGPT.", extra=[("user", "Et ?"), ("assistant", "<think>b")])
    assert got["reject"] == "identite_etrangere"


def test_alternation(spark):
    rows = [([("system", "s"), ("user", "a"), ("assistant", "b")],), ([("assistant", "b"), ("user", "a")],), ([("user", "a")],), ([],)]
    frame = spark.createDataFrame(rows, "m array<struct<role:string,text:string>>")
    assert [r["x"] for r in frame.select(quality.alternates(F.col("m")).alias("x")).collect()] == [True, False, False, False]


def test_rendering_skips_blank_messages(spark):
    frame = spark.createDataFrame([([("user", " a "), ("assistant", ""), ("assistant", "b")],)], "m array<struct<role:string,text:string>>")
    got = frame.select(X.render_chat(F.col("m")).alias("t"), X.chat_segments(F.col("m"), True).alias("s")).first()
    assert got["t"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert [s["learn"] for s in got["s"]] == [False, False, False, True] and got["s"][3]["text"] == "<think>\n\n</think>\nb<|im_end|>\n"


@pytest.mark.parametrize(
    ("text", "want"), [("a</think> b", "b"), ("a<think>b", "a"), ("x<|im_end|>", "x"), ("p</think>q</think>r", "r")]
)
def test_visible_final(spark, text, want):
    assert one(spark, X.visible_final(F.col("t")), t=text) == want


def test_last_numbers(spark):
    assert one(spark, X.last_number(F.col("t")), t="de 3 à 1 200 km") == "1200"
    assert one(spark, X.last_number(F.col("t")), t="rien") is None
    assert one(spark, X.last_decimal(F.col("t")), t="soit 0,5") == "0,5"


def test_passage_three_times():
    base = "abcdefghijklmnopqrstuvwxyz0123456789"
    assert exact.has_triple("x" + base * 3 + "y") and not exact.has_triple(base * 2 + "z" + base)
    assert exact.has_triple("ab" * 60) and not exact.has_triple("ab" * 20) and not exact.has_triple("")


def test_unicode_forms(spark):
    frame = spark.createDataFrame([("éß",), (None,)], "t string")
    got = frame.select(exact.nfc("t").alias("n"), exact.casefold("t").alias("c"), exact.fold("t").alias("f")).collect()
    assert got[0]["n"] == "éß" and got[0]["c"].endswith("ss") and got[0]["f"] == "ess" and got[1]["n"] is None


def test_distilled_codes(spark):
    def code(raw, ok="true"):
        frame = spark.createDataFrame([(raw, "maths", ok == "true")], "r string, k string, ok boolean")
        return frame.select(quality.distilled_code(F.col("r"), F.col("k"), 20, 10, F.col("ok")).alias("x")).first()["x"]

    assert code("<think>a</think>b") is None and code("b") == "sans_think" and code("<think>a</think>") == "final_vide"
    assert code("<think>a</think>漢") == "cjk" and code("<think>" + "a" * 30 + "</think>b") == "think_trop_long"
    assert code("<think>a</think>" + "b" * 11) == "final_trop_long" and code("<think>a</think>b", "false") == "reponse_fausse"
