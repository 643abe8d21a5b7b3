"""Secret findings with false positives removed by a random forest, in DataFrame functions only.

Candidates are of two kinds. A run is MIN_LENGTH or more key characters with a digit, a capital inside, or a
telling name, whatever else its word holds; any other character is a border, so a word (a URL, minified JSON,
unspaced code) may have several. Its name is what stands ahead of it behind `=` or `:`. An assigned value is
what a telling name is set to, in one word or over blanks (`password = x`), or the password of scheme://user:x@host:
any characters, ASSIGNED_LENGTH or more (one or more in a URL). It counts where no run of its word does.

Features: length; character transitions, both changes of class and the surprise of its letter pairs under a
table of transitions; dictionary coverage; the shape of a file path, and words of the file path the text is from;
its name; and the words ahead and behind. The dictionary and the transitions come from a word list (the words of
a public vocabulary in the query). The forest is trained by Spark ML on labelled findings (by default a table made
by rule from hashes: keys, tokens and passwords against digests, numbers, paths, identifiers and placeholders; pass
your own table for another corpus) and then written out as one Column expression, so that scanning is a projection.

Bounded fit: TRAINING_ROWS labelled findings, DICTIONARY_WORDS words, TREES trees of depth DEPTH, whatever the corpus.

Defined results: a null or empty text has no candidate and gives no row; a null id stays null; repeated rows give
their findings again; equal candidates at several places, of one word too, are a row each; other columns are not
read; an empty table gives an empty result. Words are cut at white space; texts of any length are scanned whole.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH, ASSIGNED_LENGTH = 12, 4
TRAINING_ROWS = 6000
TREES, DEPTH, SEED = 24, 7, 17
#: Probability from which a candidate is a secret.
THRESHOLD = 0.5

KEY = r"[A-Za-z0-9+/_~.\-]"
ROUGH = KEY + "{12,}"
#: Where a run begins; the run at the start of a piece with its padding, which is no `=` ahead of a value.
START = f"(?<!{KEY})(?={KEY}{{12}})"
VALUE = rf"""^{KEY}{{12,}}(?:={{1,2}}(?!["'`\\(\[{{<]*[A-Za-z0-9+/_~\-=]))?"""
#: The name at the end of what is left of a run; each stretch of name characters is tried once.
NAME = r"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+([A-Za-z_][A-Za-z0-9_.\-]*+)[\\"'`)\]}]*[=:]+>?[\\"'`(\[{<]*$"""
OPENING, FIELD_BORDERS = "([{<\\\"'`", "?&;{}|"
#: The user of scheme://user:password@host, left of the password.
USER = r"//[^\s/?#:@]*:$"
TELLING = r"(?i)(?:secret|token|passw|passwd|pwd|api_?-?key|apikey|auth|bearer|credential|private|access_?-?key|client_?-?key|signature)"
HARMLESS = r"(?i)(?:commit|sha-?\d|md5|checksum|digest|hash|uuid|guid|version|revision|example|sample|dummy|placeholder|page|order|phone|card|call|tel|https?:|file|path|build|date)"
#: A telling name, and what it is set to in one word; the end of `name =` over words; the password of a URL.
TELLING_NAME = rf"([A-Za-z0-9_.\-]{{0,40}}{TELLING}[A-Za-z0-9_.\-]{{0,40}})"
SETS = TELLING + r"""[A-Za-z0-9_.\-]{0,40}[\\"'`)\]]*[=:]"""
GLUED = TELLING_NAME + r"""[\\"'`)\]]*(?::=|=>|[=:])+[\\"'`(\[{<]*([^\s"'`\\<>=:][^\s"'`\\<>]{3,})"""
SPACED = TELLING_NAME + r"""[\\"'`)\]]*\s*(?::=|=>|[=:])+$"""
URL_PASSWORD = r"://[^\s/?#:@]*:([^\s/@]+)@"
QUOTED = r"""^[\\"'`(\[{]*([^\s"'`\\<>=:][^\s"'`\\<>]{3,})"""
SHAPE = "[0-9]|[a-z][A-Z]"
#: Characters ahead of a word in which the name it is set to is looked for.
NAME_REACH = 120
#: Names of placeholders, and words of file paths whose findings are made up.
PLACEHOLDER = r"(?i)(?:change_?-?me|your[_-]|example|sample|dummy|placeholder|xxxx|\*\*\*|<[a-z_-]+>|\$\{|\{\{|^\$[A-Za-z_]|^%[A-Za-z_]|redacted|insert[_-]|^null$|^none$|^true$|^false$|^undefined$|getenv|environ|process\.env)"
MADE_UP_PATH = r"(?i)(?:^|[/_.\-])(?:tests?|specs?|fixtures?|mocks?|examples?|samples?|docs?|demo)(?:[/_.\-]|$)"
#: Words that keys do not hold by chance, used where no word list is given.
DICTIONARY = (
    "access", "address", "admin", "build", "change", "class", "client", "column", "config", "content", "count", "data", "date", "default", "dummy", "error", "event", "example", "file",
    "function", "home", "host", "image", "index", "item", "list", "local", "main", "message", "method", "module", "name", "number", "order", "page", "password", "path", "python", "release",
    "request", "response", "sample", "script", "secret", "server", "service", "size", "string", "style", "table", "test", "text", "time", "token", "user", "value", "version", "with", "your",
)
#: Most words of a dictionary, and the length from which a word counts.
DICTIONARY_WORDS, WORD_LENGTH = 8000, 4
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length", "changes", "surprise", "digits", "capitals", "marks", "hex", "distinct", "coverage", "segments", "extension", "number", "placeholder", "named", "telling", "harmless", "after_telling",
    "after_harmless", "made_up",
)


@dataclass
class Words:
    """A dictionary, and the surprise in bits of each letter behind each other one (26 a row) in its words."""

    dictionary: list[str]
    surprise: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.dictionary = sorted({w for w in self.dictionary if len(w) >= WORD_LENGTH and re.fullmatch("[a-z]+", w)})
        counts = [[1.0] * 26 for _ in LETTERS]
        for w in self.dictionary:
            for x, y in zip(w, w[1:]):
                counts[ord(x) - 97][ord(y) - 97] += 1
        self.surprise = [round(-math.log2(n / sum(row)), 4) for row in counts for n in row]


def vocabulary_words(path: str, most: int = DICTIONARY_WORDS) -> list[str]:
    """The first whole words of a vocabulary file of the tokenizers library, the most frequent ones."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end = model.get("end_of_word_suffix") or ""
    ranked = sorted((rank, x.removesuffix(end).lower()) for x, rank in model["vocab"].items() if x.endswith(end))
    return [w for _, w in ranked if len(w) >= WORD_LENGTH and re.fullmatch("[a-z]+", w)][:most]


def _features(value: Column, name: Column, before: Column, after: Column, path: Column, words: Words) -> dict[str, Column]:
    """The forest's inputs of a candidate, its name, the words around it and the file path it is from."""
    size = F.length(value).cast("double")
    changes = F.regexp_count(value, F.lit(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"))
    listed = ", ".join(f"'{w}'" for w in words.dictionary) or "''"
    # Pairs of letters, and the table's surprise at each: its places are 26 x first + second.
    codes = F.transform(F.split(F.lower(value), ""), lambda c: F.ascii(c) - 97)
    table = F.from_json(F.lit(json.dumps(words.surprise)), "array<double>")
    pairs = F.filter(F.zip_with(codes, F.slice(codes, 2, 1 << 30), lambda x, y: F.when(x.between(0, 25) & y.between(0, 25), x * 26 + y)), lambda p: p.isNotNull())
    bits = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.element_at(table, p + 1))
    context = F.concat_ws(" ", before, name)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": size,
        "changes": changes / size,
        "surprise": F.when(F.size(pairs) > 0, bits / F.size(pairs)).otherwise(0.0),
        "digits": F.regexp_count(value, F.lit("[0-9]")) / size,
        "capitals": F.regexp_count(value, F.lit("[A-Z]")) / size,
        "marks": F.regexp_count(value, F.lit("[^A-Za-z0-9]")) / size,
        "hex": yes(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "coverage": _covered(listed) / size,
        "segments": F.regexp_count(value, F.lit(r"[/.\-]")) / size,
        "extension": yes(value.rlike(r"\.[A-Za-z]{1,5}$") & value.rlike("[/.]")),
        "number": yes(value.rlike(r"^[0-9.+\-/:]+$")),
        "placeholder": yes(value.rlike(PLACEHOLDER)),
        "named": yes(name != ""),
        "telling": yes(context.rlike(TELLING)),
        "harmless": yes(context.rlike(HARMLESS)),
        "after_telling": yes(after.rlike(f"^[^A-Za-z]*{TELLING}")),
        "after_harmless": yes(after.rlike(f"^[^A-Za-z]*{HARMLESS}")),
        "made_up": yes(F.coalesce(path, F.lit("")).rlike(MADE_UP_PATH)),
    }


def _covered(listed: str) -> Column:
    """The characters of the column `value` inside dictionary words; a constant list is a hash set to Catalyst."""
    return F.expr(f"aggregate(regexp_extract_all(value, '[A-Z]?[a-z]+|[A-Z]+', 0), 0, (n, x) -> n + if(lower(x) in ({listed}), length(x), 0))")


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, salt: str = "fit") -> DataFrame:
    """(value, name, before, after, path, label): findings made by rule from hashes, half secrets and half look-alikes."""
    base = spark.range(rows).select(
        "id", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), F.sha2(F.concat(F.lit(salt + "/"), F.col("id").cast("string")), 256).alias("g")
    )
    base = base.withColumn("b", F.concat(F.base64(F.unhex("h")), F.base64(F.unhex("g")))).withColumn("m", F.regexp_replace("b", "[^A-Za-z0-9]", ""))
    base = base.withColumn("u", F.regexp_replace(F.upper("b"), "[^A-Z0-9]", "")).withColumn("r", F.conv(F.substring("h", 1, 6), 16, 10).cast("int"))
    base = base.withColumn("d", F.translate(F.substring("g", 1, 20), "abcdef", "012345"))
    plain = "element_at(array('the end','of and','see','in that','with','was','de la','und die','text is','to be'), 1 + r % 10)"
    told = "element_at(array('password','passwd','pwd','secret','DB_PASSWORD','SECRET_KEY','auth_token','api_key'), 1 + r % 8)"
    spoken = "element_at(array('correct','horse','battery','dragon','summer','winter','purple','monkey','soleil','orange'), 1 + r % 10)"
    spoken2 = "element_at(array('staple','tiger','sunshine','letmein','rocket','maison','shadow'), 1 + int(r / 10) % 7)"
    word = "element_at(array('getUser','fileIndex','retry_count','max_size','module-name','event.handler','orderItem','tableColumn','release','image_page'), 1 + r % 10)"
    after = "element_at(array('and','de','the','fin','encore','with',''), 1 + r % 7)"
    harmless = "element_at(array('checksum','commit','version','example'), 1 + r % 4)"
    kinds = [
        ("concat('AKIA', substr(u, 1, 16))", "''", plain, 1),
        ("substr(h, 1, 12 + r % 20)", "element_at(array('password','passwd','pwd','secret','auth_token'), 1 + r % 5)", plain, 1),
        ("substr(h, 1, 32 + r % 16)", "''", "element_at(array('token =','secret:','api_key =','apikey :','access_key =','bearer'), 1 + r % 6)", 1),
        ("substr(b, 1, 24 + r % 24)", "element_at(array('api_key','client_secret','AccessKey','auth','token'), 1 + r % 5)", plain, 1),
        ("concat(element_at(array('ghp_','gho_','xoxb-','glpat-','npm_'), 1 + r % 5), substr(m, 1, 30 + r % 8))", "''", plain, 1),
        ("concat(element_at(array('sk_live_','sk-','AIza','rk_test_'), 1 + r % 4), substr(m, 1, 24 + r % 16))", "''", plain, 1),
        ("substr(m, 1, 16 + r % 30)", "element_at(array('password','SECRET_KEY','private_key','token'), 1 + r % 4)", plain, 1),
        ("concat('eyJ', substr(m, 1, 30), '.eyJ', substr(m, 31, 30))", "''", "element_at(array('authorization bearer','see','the token'), 1 + r % 3)", 1),
        ("concat(" + spoken + ", " + spoken2 + ", if(r % 3 = 0, substr(d, 1, 2), ''))", told, plain, 1),
        ("concat(substr(m, 1, 3 + r % 4), element_at(array('!','&','#','$','@','%'), 1 + r % 6), substr(m, 9, 2 + r % 6), element_at(array('!','','?','*'), 1 + r % 4))", told, plain, 1),
        ("concat(" + spoken + ", substr(d, 1, 2), element_at(array('!','','#','.'), 1 + r % 4))", told, plain, 1),
        ("concat(" + spoken + ", '-', " + spoken2 + ", '-', " + spoken + ")", told, plain, 1),
        ("substr(d, 1, 12 + r % 8)", "''", plain, 0),
        ("substr(h, 1, element_at(array(32, 40, 64), 1 + r % 3))", "''", "element_at(array('commit','sha256 digest','md5 checksum','hash of','revision'), 1 + r % 5)", 0),
        ("concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", "element_at(array('','id','uuid'), 1 + r % 3)", plain, 0),
        ("concat('/usr/lib/', " + word + ", '/', substr(d, 1, 2), '/', " + word + ", '.py')", "''", plain, 0),
        ("concat('www.example', substr(d, 1, 1), '.com/', " + word + ", '/', substr(d, 2, 4))", "''", plain, 0),
        ("concat('20', substr(d, 1, 2), '-0', substr(d, 3, 1), '-1', substr(d, 4, 1), element_at(array('.build-','-release-','.12.'), 1 + r % 3), substr(d, 5, 2))", "''", plain, 0),
        ("concat(" + word + ", 'Value', substr(d, 1, 2), " + word + ")", "element_at(array('','name','key','token_name'), 1 + r % 4)", plain, 0),
        ("element_at(array('<password>', '${DB_PASSWORD}', '{{token}}', 'null', 'None', 'true', 'os.environ', 'process.env.TOKEN', 'xxxxxxxx', '********', 'changeme', 'redacted'), 1 + r % 12)", told, plain, 0),
        ("concat('get', initcap(" + spoken + "), '(', substr(d, 1, 1), ')')", told, plain, 0),
        ("concat(" + spoken + ", '_', " + spoken2 + ", '.', element_at(array('json','txt','yaml','pem'), 1 + r % 4))", "element_at(array('token_file','password_path','auth_file','secret_path'), 1 + r % 4)", plain, 0),
        ("substr(h, 1, 40)", "''", "element_at(array('token =','secret:','api_key ='), 1 + r % 3)", 0, "element_at(array('tests/fixtures/a.py','docs/example.md','spec/mock_data.json'), 1 + r % 3)"),
        ("element_at(array('changeme', 'your_api_key_here', 'xxxxxxxxxxxx', 'example_token_', 'test_password_', 'default-value-'), 1 + r % 6) || substr(d, 1, 2) || 'xxxx'", "element_at(array('password','token','secret'), 1 + r % 3)", plain, 0),
    ]
    each = [
        base.where(F.pmod("id", F.lit(len(kinds))) == k).select(
            "id", F.expr(v).alias("value"), F.expr(n).alias("name"), F.expr(p).alias("before"), F.expr(f"if(r % {9 if label else 3} = 0, {harmless}, {after})").alias("after"),
            F.expr(path[0] if path else "element_at(array('', 'src/main.py', 'app/config.yaml', 'notes.txt'), 1 + r % 4)").alias("path"), F.lit(float(label)).alias("label"),
        )
        for k, (v, n, p, label, *path) in enumerate(kinds)
    ]
    return reduce(DataFrame.unionByName, each).where(F.length("value") >= ASSIGNED_LENGTH)


@dataclass
class Forest:
    """A fitted scanner: the forest's trees as Spark ML writes them out, and the words of its features."""

    trees: list[str]
    words: Words


#: Fitted scanners of the default findings, by their word lists: fitting again would give the same one.
_fitted: dict[tuple, Forest] = {}


def train(labelled: DataFrame, words: list[str] | None = None, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest fitted on labelled (value, name, before, after, path, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = Words(list(words or DICTIONARY)[:DICTIONARY_WORDS])
    rows = with_features(labelled, known).select("label", *FEATURES)
    ordered = rows.coalesce(1).sortWithinPartitions("label", *FEATURES)  # a fixed order, for equal trees everywhere
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ordered)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(data.select("label", "features"))
    return Forest([t.toDebugString for t in forest.trees], known)


def fitted(spark: SparkSession, words: list[str] | None = None) -> Forest:
    """The forest of the default findings, fitted once in a driver."""
    key = tuple(words or ())
    if key not in _fitted:
        _fitted[key] = train(labelled_findings(spark), words)
    return _fitted[key]


def with_features(found: DataFrame, words: Words) -> DataFrame:
    """Candidates with the forest's inputs as columns of their own, since the forest reads them many times over."""
    inputs = _features(F.col("value"), F.col("name"), F.col("before"), F.col("after"), F.col("path"), words)
    return found.select("*", *[F.round(inputs[f].cast("double"), 9).alias(f) for f in FEATURES])


def tree_nodes(text: str) -> list[tuple[int, float, int, int, float]]:
    """One tree as nodes (feature, split, node if at most, node if above, value); a leaf leads to itself."""
    lines = [x.strip() for x in text.split("\n") if re.search(r"\b(If|Else|Predict)\b", x)]
    nodes: list[tuple[int, float, int, int, float]] = []
    at = 0

    def grow() -> int:
        nonlocal at
        line, own = lines[at], len(nodes)
        at += 1
        leaf = re.match(r"Predict: (\S+)", line)
        nodes.append((0, 0.0, own, own, float(leaf[1]) if leaf else 0.0))
        if not leaf:
            test = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            low = grow()
            at += 1  # its Else
            nodes[own] = (int(test[1]), float(test[2]), low, grow(), 0.0)
        return own

    grow()
    return nodes


def score(trees: list[str]) -> Column:
    """The share of trees that call a candidate (its feature columns) a secret. The forest is one literal; a
    fold over the depth walks each tree."""
    fields = ("f", "split", "low", "high", "value")
    node = ", ".join("{} {}".format(n, t) for n, t in zip(fields, ("int", "double", "int", "int", "double")))
    forest = json.dumps([[dict(zip(fields, n)) for n in tree_nodes(t)] for t in trees])
    inputs = F.array(*[F.col(f) for f in FEATURES])
    literal = F.from_json(F.lit(forest), f"array<array<struct<{node.replace(' ', ':').replace(',:', ',')}>>>")

    def step(tree: Column, own: Column) -> Column:
        here = F.element_at(tree, own + 1)
        return F.when(F.element_at(inputs, here["f"] + 1) <= here["split"], here["low"]).otherwise(here["high"])

    votes = F.transform(literal, lambda tree: F.element_at(tree, F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), lambda own, _: step(tree, own)) + 1)["value"])
    return F.aggregate(votes, F.lit(0.0), lambda a, v: a + v) / F.lit(float(len(trees)))


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, position, name, value, before, after, path) of every candidate; position counts words from 0. `path`
    names a column of file paths, if docs has one."""
    source = F.col(path) if path else F.lit(None)
    rough = docs.select("doc_id", "text", source.cast("string").alias("path")).where(F.col("text").rlike(f"{ROUGH}|{TELLING}|{URL_PASSWORD}"))
    words = rough.select("doc_id", "path", F.split("text", r"\s+").alias("w"))
    ahead = lambda i: F.array_join(F.slice("w", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " ")
    sets = lambda i: F.when(i > 0, F.element_at("w", F.greatest(i, F.lit(1))).rlike("[=:>]$")).otherwise(False)
    spaced = lambda i: F.when(sets(i), F.regexp_extract(F.right(ahead(i), F.lit(NAME_REACH)), SPACED, 1)).otherwise("")
    holds = lambda x, i: x.rlike(f"{ROUGH}|{SETS}|{URL_PASSWORD}") | (spaced(i) != "")
    places = F.filter(F.transform("w", lambda x, i: F.when(F.length(x) >= ASSIGNED_LENGTH, F.when(holds(x, i), i))), lambda i: i.isNotNull())
    near = F.transform(
        places,
        lambda i: F.struct(
            i.alias("position"), F.element_at("w", i + 1).alias("word"), ahead(i).alias("ahead"), spaced(i).alias("spaced"),
            F.coalesce(F.try_element_at("w", i + 2), F.lit("")).alias("after"),
        ),
    )
    flat = words.select("doc_id", "path", F.explode(near).alias("f")).select("doc_id", "path", "f.*")
    # One pass over the word for both kinds: the pieces of its runs, and its assigned values.
    glued = lambda k: F.when(F.col("word").rlike(SETS), F.regexp_extract("word", GLUED, k)).otherwise("")
    own = F.struct(F.regexp_extract("word", URL_PASSWORD, 1).alias("url"), glued(1).alias("glued"), glued(2).alias("set"), F.regexp_extract("word", QUOTED, 1).alias("quoted"))
    # Each piece but a first one without a run starts with a run; the piece before it is what is left of it.
    pieces = flat.select("*", F.split("word", START).alias("p"), own.alias("own"))
    runs = F.transform("p", lambda x, i: F.struct(x.alias("piece"), F.when(i > 0, F.element_at("p", F.greatest(i, F.lit(1)))).otherwise("").alias("left"), F.lit("").alias("name"), F.lit("").alias("value")))
    run = lambda x: x.rlike(ROUGH)
    # A value that holds a run is one already, where the run counts.
    assigned = F.array(
        F.struct(F.lit("password").alias("name"), F.when(run(F.col("own.url")), "").otherwise(F.col("own.url")).alias("value")),
        F.struct(F.col("own.glued").alias("name"), F.when((F.col("own.url") != "") | run(F.col("own.set")), "").otherwise(F.col("own.set")).alias("value")),
        F.struct(F.col("spaced").alias("name"), F.when((F.col("spaced") == "") | (F.col("own.url") != "") | (run(F.col("own.quoted")) & F.col("own.quoted").rlike(SHAPE)), "").otherwise(F.col("own.quoted")).alias("value")),
    )
    closed = F.transform(assigned, lambda v: F.struct(F.lit("").alias("piece"), F.lit("").alias("left"), v["name"].alias("name"), F.regexp_replace(v["value"], r"[,;.)\]}]+$", "").alias("value")))
    each = pieces.select("doc_id", "path", "position", "ahead", "after", F.explode(F.concat(runs, F.filter(closed, lambda v: v["value"] != ""))).alias("r")).select("doc_id", "path", "position", "ahead", "after", "r.*")
    valued = each.withColumn("is_run", F.col("value") == "").withColumn("value", F.when(F.col("value") != "", F.col("value")).otherwise(F.regexp_replace(F.regexp_extract("piece", VALUE, 0), r"[.\-]+$", "")))
    valued = valued.where(F.when(F.col("is_run"), F.length("value") >= MIN_LENGTH).otherwise(True))
    user = F.col("left").rlike(USER) & F.col("piece").rlike(f"^{KEY}{{12,}}={{0,2}}@")
    named = valued.withColumn("name", F.when(~F.col("is_run"), F.col("name")).when(user, "password").otherwise(F.regexp_extract("left", NAME, 1)))
    rest = F.translate(F.rtrim(F.regexp_replace("left", NAME, ""), F.lit(OPENING)), FIELD_BORDERS, "," * len(FIELD_BORDERS))
    field_of = F.when(user, "").otherwise(F.substring_index(rest, ",", -1))
    before = F.concat_ws(" ", F.when(~F.col("left").rlike("^" + ROUGH), F.col("ahead")), F.when(field_of != "", field_of))
    shape = ~F.col("is_run") | F.col("value").rlike(SHAPE) | F.col("name").rlike(TELLING)
    return named.where(shape).select("doc_id", "position", "name", "value", before.alias("before"), "after", "path")


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """Every candidate of docs with its features, probability and verdict `is_secret`."""
    wide = with_features(candidates(docs, path), forest.words)
    return wide.withColumn("probability", F.round(score(forest.trees), 6)).withColumn("is_secret", F.col("probability") >= threshold)


def scan_documents(docs: DataFrame, labelled: DataFrame | None = None, words: list[str] | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, position, name, value_sha256, n_chars, probability, is_secret) of every candidate of docs."""
    forest = train(labelled, words) if labelled is not None else fitted(docs.sparkSession, words)
    found = scan(docs, forest, path=path)
    return found.select("doc_id", "position", "name", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"), "probability", "is_secret")


def redact(docs: DataFrame, forest: Forest, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret's value replaced by a mark, a short one only where it stands between borders; rows are
    joined by doc_id."""
    found = scan(docs, forest).where("is_secret").groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("_values"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left")
    apart = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), v, F.lit(r"\E(?![A-Za-z0-9_])"))
    without = lambda t, v: F.when(F.length(v) >= MIN_LENGTH, F.replace(t, v, F.lit(mark))).otherwise(F.regexp_replace(t, apart(v), F.lit(mark)))
    clean = F.when(F.col("_values").isNull(), F.col("text")).otherwise(F.aggregate("_values", F.col("text"), without))
    return joined.select(*[clean.alias("text") if c == "text" else docs[c] for c in docs.columns])
