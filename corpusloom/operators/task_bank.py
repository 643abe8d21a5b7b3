"""Seeded tasks with verifiable answers over six capabilities, and banks of them as files.

A schema draws its numbers and says its answer as a verifier's spec; its wordings are by split, so that a held-out
split never shows a wording of the training one. Task n depends on (seed, n) only.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import publish
from .generators import stream

# The capabilities with their weights, and their schemas.
CAPABILITIES = {"reasoning_program": 0.40, "grounded": 0.15, "constraints": 0.15, "code": 0.10, "uncertainty": 0.10, "state_tracking": 0.10}
SCHEMAS = {
    "reasoning_program": ("linear_equation", "mean_three", "exact_percentage", "small_power", "signed_product"),
    "grounded": ("grounded_year", "grounded_rooms", "grounded_height"),
    "constraints": ("constraint_number_only", "constraint_json"),
    "code": ("code_0", "code_1", "code_2"),
    "uncertainty": ("contradictory_sources",),
    "state_tracking": ("state_update",),
}
SPLITS = ("train", "dev")
TRACED_FROM = 0.75


@dataclass
class Draw:
    """What a schema drew: the values of its wordings, the answer's spec, a right answer, and how it comes about."""

    slots: dict
    answer: dict
    solution: str
    program: dict
    trace: list[str] = field(default_factory=list)


def _whole(value: int, slots: dict, program: dict, trace: list[str], **more: object) -> Draw:
    return Draw(slots, {"kind": "integer", "value": value, **more}, str(value), program, trace)


def _equation(r: random.Random, reach: int) -> Draw:
    x, a = r.randint(-reach, reach), r.randint(2, reach)
    return _whole(x, {"a": a, "b": x + a}, {"op": "solve_add", "offset": a, "total": x + a}, [f"{x + a} − {a} = {x}"])


def _mean(r: random.Random, reach: int) -> Draw:
    middle, up, down = r.randint(2, reach), r.randint(1, reach), r.randint(1, reach)
    values = r.sample([middle + up, middle + down, middle - up - down], 3)
    return _whole(middle, dict(zip("abc", values)), {"op": "mean", "args": values}, [f"somme {sum(values)}", f"{sum(values)} ÷ 3 = {middle}"])


def _percentage(r: random.Random, reach: int) -> Draw:
    rate = r.choice((5, 10, 20, 25, 50))
    base = 100 // rate * r.randint(2, 2 + reach)
    return _whole(base * rate // 100, {"rate": rate, "base": base}, {"op": "percentage", "base": base, "rate": rate}, [f"{base} × {rate} ÷ 100 = {base * rate // 100}"])


def _power(r: random.Random, reach: int) -> Draw:
    base, exponent = r.randint(2, 6 + reach // 16), r.choice((2, 3))
    return _whole(base**exponent, {"base": base, "exponent": exponent}, {"op": "pow", "base": base, "exponent": exponent}, [" × ".join([str(base)] * exponent) + f" = {base**exponent}"])


def _product(r: random.Random, reach: int) -> Draw:
    a, b = r.choice((-1, 1)) * r.randint(2, 5 + reach // 4), r.randint(2, 5 + reach // 5)
    return _whole(a * b, {"a": a, "b": b}, {"op": "mul", "args": [a, b]}, [f"{a} × {b} = {a * b}"])


def _notice(name: str) -> Callable[[random.Random, int], Draw]:
    ask = {"year": "Quelle est l'année d'ouverture ?", "rooms": "Combien y a-t-il de salles ?", "height": "Combien de mètres de haut ?"}[name]

    def draw(r: random.Random, reach: int) -> Draw:
        own = {"year": r.randint(1850, 2015), "rooms": r.randint(4, 40), "height": r.randint(10, 120)}
        place = r.choice(("Valmont", "Lignières", "Castelbrun", "Roqueval", "Saint-Amand"))
        text = f"Le musée de {place}, haut de {own['height']} mètres, compte {own['rooms']} salles. Il accueille le public depuis {own['year']}."
        return _whole(own[name], {"text": text, "ask": ask}, {"op": "extract", "field": name, "context_sha256": hashlib.sha256(text.encode()).hexdigest()}, [f"{name} = {own[name]}"])

    return draw


def _bare_sum(r: random.Random, reach: int) -> Draw:
    a, b = r.randint(2, 20 + reach), r.randint(2, 20 + reach)
    return _whole(a + b, {"a": a, "b": b}, {"op": "add", "args": [a, b], "format": "number"}, [f"{a} + {b} = {a + b}"], strict_number_only=True)


def _json_sum(r: random.Random, reach: int) -> Draw:
    a, b = r.randint(2, 20 + reach), r.randint(2, 20 + reach)
    value = {"operation": "addition", "resultat": a + b}
    answer = {"kind": "json", "value": value, "json_schema": {"operation": "string", "resultat": "integer"}}
    return Draw({"a": a, "b": b}, answer, json.dumps(value), {"op": "add", "args": [a, b], "format": "json"}, [f"{a} + {b} = {a + b}"])


def _function(stem: str, arguments: str, body: str, tests: list) -> Callable[[random.Random, int], Draw]:
    def draw(r: random.Random, reach: int) -> Draw:
        name = f"{stem}_{r.randrange(10**6)}"
        answer = {"kind": "code", "function_name": name, "tests": tests}
        return Draw({"name": name, "arguments": arguments}, answer, f"def {name}({arguments}):\n    return {body}", {"op": "python_tests", "function": name})

    return draw


def _contradiction(r: random.Random, reach: int) -> Draw:
    a, b = r.sample(("K-31", "M-08", "P-77", "T-52", "V-19"), 2)
    return Draw({"a": a, "b": b}, {"kind": "abstain"}, "Les informations se contredisent.", {"op": "unanswerable", "reason": "equal_authority_contradiction"}, [f"{a} et {b} ont la même autorité"])


def _update(r: random.Random, reach: int) -> Draw:
    shades = ["blanc", "noir", "ocre", "violet", "gris"]
    a, b, c = r.sample(shades, 3)
    return Draw({"a": a, "b": b, "c": c}, {"kind": "choice", "value": c, "choices": shades}, c, {"op": "last_write_wins", "values": [a, b, c]}, [f"{b} remplace {a}", f"{c} remplace {b}"])


DRAWS: dict[str, Callable[[random.Random, int], Draw]] = {
    "linear_equation": _equation, "mean_three": _mean, "exact_percentage": _percentage, "small_power": _power, "signed_product": _product, "grounded_year": _notice("year"), "grounded_rooms": _notice("rooms"),
    "grounded_height": _notice("height"), "constraint_number_only": _bare_sum, "constraint_json": _json_sum, "code_0": _function("triple", "n", "3 * n", [[[2], 6], [[-1], -3], [[0], 0]]),
    "code_1": _function("ecart", "a, b", "abs(a - b)", [[[7, 3], 4], [[3, 7], 4], [[5, 5], 0]]), "code_2": _function("pairs", "valeurs", "sum([1 for v in valeurs if v % 2 == 0])", [[[[1, 2, 4]], 2], [[[]], 0], [[[3]], 0]]),
    "contradictory_sources": _contradiction, "state_update": _update,
}
GROUNDED = {"train": ("{text}\n{ask}", "Notice : {text}\nQuestion : {ask}"), "dev": ("D'après ce seul passage, réponds.\n{text}\n{ask}",)}
CODE = {
    "triple": {"train": ("Donne le code Python de `{name}({arguments})`, qui triple son argument.",), "dev": ("Fonction Python `{name}({arguments})` : trois fois n. Le code seul.",)},
    "ecart": {"train": ("Donne le code Python de `{name}({arguments})`, la distance entre deux nombres.",), "dev": ("Fonction Python `{name}({arguments})` : valeur absolue de la différence. Le code seul.",)},
    "pairs": {"train": ("Donne le code Python de `{name}({arguments})`, qui compte les nombres pairs.",), "dev": ("Fonction Python `{name}({arguments})` : combien de pairs dans la liste. Le code seul.",)},
}
WORDINGS: dict[str, dict[str, tuple[str, ...]]] = {
    "linear_equation": {"train": ("Un nombre augmenté de {a} donne {b}. Quel est ce nombre ?", "Si y + {a} = {b}, combien vaut y ?"), "dev": ("Que faut-il ajouter à {a} pour obtenir {b} ?",)},
    "mean_three": {"train": ("Moyenne de {a}, {b} et {c} ?", "Trois notes : {a}, {b}, {c}. Quelle moyenne ?"), "dev": ("Par quel même nombre remplacer {a}, {b} et {c} sans changer leur somme ?",)},
    "exact_percentage": {"train": ("{rate} % de {base} ?", "Prends {rate} pour cent de {base}."), "dev": ("Une remise de {rate} % sur {base} € fait combien d'euros ?",)},
    "small_power": {"train": ("{base} à la puissance {exponent} ?", "Que vaut {base}^{exponent} ?"), "dev": ("Multiplie {exponent} facteurs égaux à {base}.",)},
    "signed_product": {"train": ("Combien font {a} fois {b} ?", "Produit de {a} et de {b} ?"), "dev": ("Avec son signe, que donne ({a}) × ({b}) ?",)},
    "grounded_year": GROUNDED, "grounded_rooms": GROUNDED, "grounded_height": GROUNDED,
    "constraint_number_only": {"train": ("{a} + {b} ? Le nombre, rien d'autre.",), "dev": ("Écris uniquement la somme de {a} et {b}, en chiffres.",)},
    "constraint_json": {"train": ("Additionne {a} et {b} ; rends un objet JSON avec operation (\"addition\") et resultat (entier).",), "dev": ("Un objet JSON, clés operation et resultat, pour l'addition {a} + {b}.",)},
    "code_0": CODE["triple"], "code_1": CODE["ecart"], "code_2": CODE["pairs"],
    "contradictory_sources": {"train": ("Une affiche dit {a}, une autre dit {b} ; aucune ne prime. Quel code est le bon ?",), "dev": ("Deux registres égaux en droit portent {a} et {b}. Lequel est certain ?",)},
    "state_update": {"train": ("Le mur était {a}. On l'a peint en {b}, puis en {c}. De quelle couleur est-il ?",), "dev": ("Couleur notée {a}, corrigée en {b}, corrigée encore en {c}. Laquelle vaut maintenant ?",)},
}
TASK = (
    "task_id string, schema_id string, surface_id string, split string, capability string, difficulty double, prompt string, answer string, solution string, program string, trace array<string>, seed long, requires_trace boolean"
)


def make_task(seed: int, split: str = "train", difficulty: float = 0.35, capability: str | None = None, schema: str | None = None) -> dict:
    """One task; capability and schema are drawn where they are not named."""
    if split not in SPLITS:
        raise ValueError("sealed tasks are not made here")
    difficulty = min(1.0, max(0.0, float(difficulty)))
    r = stream(seed, "bank", split)
    capability = capability or r.choices(list(CAPABILITIES), list(CAPABILITIES.values()))[0]
    if capability not in SCHEMAS or (schema is not None and schema not in SCHEMAS[capability]):
        raise ValueError(f"unknown capability or schema: {capability}, {schema}")
    schema = schema or r.choice(SCHEMAS[capability])
    drawn = DRAWS[schema](r, 16 + round(160 * difficulty))
    wordings = WORDINGS[schema][split]
    k = r.randrange(len(wordings))
    prompt, surface = wordings[k].format(**drawn.slots), f"{split}:{k}"
    return {
        "task_id": hashlib.sha256(f"{seed}|{schema}|{surface}|{prompt}".encode()).hexdigest()[:20], "schema_id": schema, "surface_id": surface, "split": split, "capability": capability,
        "difficulty": difficulty, "prompt": prompt, "answer": json.dumps(drawn.answer, ensure_ascii=False, sort_keys=True), "solution": drawn.solution,
        "program": json.dumps(drawn.program, ensure_ascii=False, sort_keys=True), "trace": drawn.trace, "seed": seed,
        "requires_trace": capability == "reasoning_program" and difficulty >= TRACED_FROM,
    }


def tasks(spark: SparkSession, count: int, split: str = "train", seed: int = 0) -> DataFrame:
    """`count` tasks, their difficulties in turn from 0 to 1."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([make_task(seed + int(n), split, int(n) % 11 / 10) for n in batch["id"]])

    return spark.range(count).mapInPandas(run, TASK)


def write_bank(bank: DataFrame, path: str) -> DataFrame:
    """Publish a bank as JSON lines, and return its manifest: by split and capability the tasks and a digest of theirs."""
    publish(bank, path, "json")
    return bank_manifest(read_bank(bank.sparkSession, path))


def bank_manifest(bank: DataFrame) -> DataFrame:
    """By split and capability: tasks, and a digest that does not depend on their order."""
    return bank.groupBy("split", "capability").agg(F.count("*").alias("tasks"), F.bit_xor(F.xxhash64("task_id", "prompt", "answer")).alias("digest"))


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a bank; a broken line is an error."""
    return spark.read.schema(TASK).option("mode", "FAILFAST").json(path)
