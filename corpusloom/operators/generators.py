"""Seeded generators of problems and conversations, partition-independent: row n depends on (seed, n) only.

The wording is this engine's own; each family gives a question, its worked steps and a computed answer.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import THINK, THINK_END
from .budget import take_budget
from .dedup import first_by

Problem = tuple[str, list[str], int | str, int]
PEOPLE = ("Aline", "Bastien", "Carole", "Driss", "Elsa", "Farid", "Gaëlle", "Hugo")
THINGS = ("billes", "timbres", "pommes", "cartes", "livres", "crayons")


def stream(seed: int, *parts: object) -> random.Random:
    return random.Random(int.from_bytes(hashlib.sha256(":".join(map(str, (seed, *parts))).encode()).digest()[:8], "big"))


def steps_add(a: int, b: int) -> list[str]:
    """a + b by tens and ones."""
    tens, ones = b // 10 * 10, b % 10
    return [f"{a} + {tens} = {a + tens}", f"{a + tens} + {ones} = {a + b}"] if tens and ones else [f"{a} + {b} = {a + b}"]


def steps_sub(a: int, b: int) -> list[str]:
    tens, ones = b // 10 * 10, b % 10
    return [f"{a} - {tens} = {a - tens}", f"{a - tens} - {ones} = {a - b}"] if tens and ones else [f"{a} - {b} = {a - b}"]


def steps_mul(a: int, b: int) -> list[str]:
    tens, ones = a // 10 * 10, a % 10
    return [f"{tens} × {b} = {tens * b}", f"{ones} × {b} = {ones * b}", f"{tens * b} + {ones * b} = {a * b}"] if tens and ones else [f"{a} × {b} = {a * b}"]


def steps_div(a: int, b: int) -> list[str]:
    return [f"{b} × {a // b} = {b * (a // b)}", f"{a} ÷ {b} = {a // b}" + (f" reste {a % b}" if a % b else "")]


def _calc(r: random.Random) -> Problem:
    a, b, op = r.randint(11, 99), r.randint(11, 99), r.choice("+-×")
    a, b = (max(a, b), min(a, b)) if op == "-" else (a, b if op != "×" else r.randint(2, 9))
    steps = {"+": steps_add, "-": steps_sub, "×": steps_mul}[op](a, b)
    return f"Combien font {a} {op} {b} ?", steps, {"+": a + b, "-": a - b, "×": a * b}[op], 1


def _left(r: random.Random) -> Problem:
    a = r.randint(20, 90)
    b = r.randint(2, a - 1)
    return f"{r.choice(PEOPLE)} possède {a} {r.choice(THINGS)} et en offre {b}. Combien en reste-t-il ?", steps_sub(a, b), a - b, 1


def _buy(r: random.Random) -> Problem:
    n, price, paid = r.randint(2, 9), r.randint(2, 12), 200
    return f"{n} {r.choice(THINGS)} coûtent {price} € pièce. Que rend-on sur {paid} € ?", [*steps_mul(price, n), *steps_sub(paid, n * price)], paid - n * price, 2


def _share(r: random.Random) -> Problem:
    k, each = r.randint(2, 9), r.randint(2, 12)
    return f"On répartit {k * each} {r.choice(THINGS)} entre {k} enfants. Combien chacun ?", steps_div(k * each, k), each, 1


def _rest(r: random.Random) -> Problem:
    a, b = r.randint(20, 99), r.randint(3, 9)
    return f"Quel est le reste de {a} divisé par {b} ?", steps_div(a, b), a % b, 2


def _series(r: random.Random) -> Problem:
    start, step = r.randint(1, 20), r.randint(2, 9)
    seen = [start + step * k for k in range(4)]
    return f"Quel nombre suit {', '.join(map(str, seen))} ?", [f"l'écart est {step}", *steps_add(seen[-1], step)], seen[-1] + step, 2


def _unit(r: random.Random) -> Problem:
    n = r.randint(2, 40)
    name, small, factor = r.choice((("mètres", "centimètres", 100), ("heures", "minutes", 60), ("kilos", "grammes", 1000)))
    return f"Combien de {small} font {n} {name} ?", [f"{n} × {factor} = {n * factor}"], n * factor, 1


def _parity(r: random.Random) -> Problem:
    n = r.randint(10, 999)
    return f"{n} est-il pair ou impair ?", [f"le dernier chiffre est {n % 10}"], "impair" if n % 2 else "pair", 1


def _order(r: random.Random) -> Problem:
    a, b, c = r.sample(PEOPLE, 3)
    return f"{a} dépasse {b}, et {b} dépasse {c}. Qui est en tête ?", [f"{a} > {b} > {c}"], a, 2


def _compare(r: random.Random) -> Problem:
    a, b = r.sample(range(10, 99), 2)
    return f"{a} est-il plus grand que {b} ? Réponds oui ou non.", [f"{a} {'>' if a > b else '<'} {b}"], "oui" if a > b else "non", 1


def _ratio(r: random.Random) -> Problem:
    n, m, unit = r.randint(2, 6), r.randint(7, 12), r.randint(2, 9)
    return f"{n} {r.choice(THINGS)} valent {n * unit} €. Que valent {m} ?", [*steps_div(n * unit, n), *steps_mul(m, unit)], m * unit, 2


def _mean(r: random.Random) -> Problem:
    middle, gap = r.randint(10, 40), r.randint(1, 9)
    return f"Quelle est la moyenne de {middle - gap}, {middle} et {middle + gap} ?", [f"somme {3 * middle}", *steps_div(3 * middle, 3)], middle, 2


def _clock(r: random.Random) -> Problem:
    h, m, d = r.randint(6, 18), r.choice((0, 15, 30, 45)), r.choice((20, 35, 50, 75))
    total = h * 60 + m + d
    return f"Il est {h} h {m:02d}. Quelle heure dans {d} minutes ?", [f"{h * 60 + m} + {d} = {total} minutes"], f"{total // 60} h {total % 60:02d}", 2


def _weekday(r: random.Random) -> Problem:
    names = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
    k, n = r.randrange(7), r.randint(8, 40)
    return f"Nous sommes {names[k]}. Quel jour dans {n} jours ?", [f"{n} = 7 × {n // 7} + {n % 7}"], names[(k + n) % 7], 2


def _interval(r: random.Random) -> Problem:
    a = r.randint(3, 40)
    b = a + r.randint(4, 30)
    return f"Combien de pages de la page {a} à la page {b}, les deux comprises ?", [*steps_sub(b, a), f"{b - a} + 1 = {b - a + 1}"], b - a + 1, 2


#: Families with their weights.
FAMILIES: dict[str, tuple[Callable[[random.Random], Problem], int]] = {
    "calcul": (_calc, 4), "reste": (_left, 3), "achat": (_buy, 3), "partage": (_share, 2), "modulo": (_rest, 1), "suite": (_series, 2), "unite": (_unit, 2), "parite": (_parity, 1),
    "ordre": (_order, 1), "comparaison": (_compare, 1), "proportion": (_ratio, 2), "moyenne": (_mean, 1), "horaire": (_clock, 1), "jour": (_weekday, 1), "intervalle": (_interval, 1),
}


def make_problem(seed: int, n: int) -> dict:
    r = stream(seed, "problem", n)
    family = r.choices(list(FAMILIES), [w for _, w in FAMILIES.values()])[0]
    question, steps, answer, level = FAMILIES[family][0](r)
    return {"n": n, "family": family, "q": question, "steps": steps, "ans_num": answer if isinstance(answer, int) else None, "ans_text": str(answer), "level": level}


PROBLEM_SCHEMA = "n long, family string, q string, steps array<string>, ans_num long, ans_text string, level int"


def problems(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """`count` problems, row n from (seed, n)."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([make_problem(seed, int(n)) for n in batch["id"]]).astype({"ans_num": "Int64"})

    return spark.range(count).mapInPandas(run, PROBLEM_SCHEMA)


def as_conversations(rows: DataFrame, plain_share: float = 0.30, seed: int = 0) -> DataFrame:
    """Problems as conversations; a share of the easy ones answers without thinking."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("n").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    final = F.concat(F.lit("La réponse est "), F.col("ans_text"), F.lit("."))
    thought = F.concat(F.lit(THINK + "\n"), F.array_join("steps", "\n"), F.lit(f"\n{THINK_END}\n"), final)
    answer = F.when((F.col("level") == 1) & (u < plain_share), final).otherwise(thought)
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("text")), F.struct(F.lit("assistant").alias("role"), answer.alias("text")))
    return rows.select("n", "family", "q", m.alias("m"), "ans_text")


def as_documents(rows: DataFrame, each: int = 4) -> DataFrame:
    """Pretraining documents of `each` problems with their steps."""
    block = F.concat(F.col("q"), F.lit("\n"), F.array_join("steps", "\n"), F.lit("\nRéponse : "), F.col("ans_text"))
    grouped = rows.groupBy(F.floor(F.col("n") / each).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("x"))
    return grouped.select("doc", F.array_join(F.transform("x", lambda p: p["b"]), "\n\n").alias("t"))


def well_formed(m: Column) -> Column:
    """A user and an assistant turn, balanced thinking marks, the answer inside the last turn."""
    last = F.element_at(m, -1)["text"]
    return (F.size(m) >= 2) & (F.regexp_count(last, F.lit(THINK)) == F.regexp_count(last, F.lit(THINK_END))) & F.contains(last, F.col("ans_text"))


def unique_until_budget(conversations: DataFrame, characters: int) -> DataFrame:
    """Well-formed conversations with distinct prompts, in order, until their characters reach the budget."""
    kept = first_by(conversations.where(well_formed(F.col("m"))), "q", ["n"])
    size = F.aggregate("m", F.lit(0), lambda a, x: a + F.length(x["text"]))
    return take_budget(kept, None, ["n"], size, F.lit(characters))


def distillation_tasks(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Problems as teacher tasks: 60 % plain, 25 % with an instruction, 15 % chat."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:kind:"), F.col("n").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    kind = F.when(u < 0.15, "chat").when(u < 0.40, "consigne").otherwise("maths")
    check = F.when(kind == "consigne", F.when(F.col("ans_num").isNotNull(), "nombre_seul").when(F.col("ans_text").isin("oui", "non"), "oui_non").otherwise("max_mots"))
    return rows.select("n", kind.alias("kind"), "q", check.alias("check"), "ans_num", "ans_text")


def identity_kernel(spark: SparkSession, name: str, facts: dict[str, str]) -> DataFrame:
    """A small fixed set of conversations about the assistant itself."""
    rows = [(i, "identity", [("user", q), ("assistant", a.format(name=name))]) for i, (q, a) in enumerate(sorted(facts.items()))]
    return spark.createDataFrame(rows, "n long, source string, m array<struct<role:string,text:string>>")
