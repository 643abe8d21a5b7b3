"""Column functions over text: normalisation, word n-grams, quality signals, chat rendering.

Case folding is `lower` throughout, so that every function can be stated in SQL; `exact` has the Unicode
forms. Words are runs of letters, numbers and underscores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of the chat format.
EOT = "<|endoftext|>"
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
THINK = "<think>"
THINK_END = "</think>"
SPECIALS = (EOT, IM_START, IM_END, THINK, THINK_END)

# The French signal words.
FRENCH_WORDS = ("le", "la", "les", "de", "des", "une", "est", "et", "pour", "dans", "vous", "qui")

WORD = r"[\p{L}\p{N}_]+"
FRENCH_TOKEN = r"[A-Za-zÀ-ÿ']+"

# Fixed patterns of the document and answer filters.
SPAM = (
    r"(?i)(?:write (?:my|a|your) (?:paper|essay)|buy (?:cheap )?(?:essays|viagra)|(?:masterpapers|paperhelp)\.com"
    r"|veuillez activer javascript|votre compte a bien été créé)"
)
BOOK_NOISE = r"(?i)(?:gutenberg|proofread|transcrib|e-?text|etext|distributed|online|http|www\.|copyright)"
FOREIGN_ASSISTANT = (
    r"(?i)(?:\b(?:chatgpt|openai|gpt-?4|luciole|qwen|mistral|llama|claude)\b"
    r"|\ben tant que (?:modèle de langage|intelligence artificielle|ia)\b)"
)
INVENTED_PERSONA = r"(?i)(?:\bje m['’]appelle\s+[A-ZÀ-ÖØ-Ý][\wÀ-ÿ-]+|\bj['’]ai\s+\d{1,3}\s+ans\b)"
COARSE = r"(?i)\b(?:salope|connard|connasse|putain|enculé|encule|pute|merde)\b"
CONTROL_TAG = r"(?i)(?:<\|(?:im_start|im_end|endoftext)\|>|</?think>)"
TRIPLE_REPEAT = r"(?s)(.{30,}?)\1\1"
REFUSALS = ("en tant qu'intelligence artificielle", "en tant que modèle de langage", "je ne peux pas répondre")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: what stands inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean(text: Column) -> Column:
    """`squeeze` with NULs as blanks; null is empty."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), "\\x00", " "))


def fingerprint(text: Column) -> Column:
    """Digest of the squeezed lower-case text: equal for texts that differ in case and blanks only."""
    return F.sha2(F.lower(squeeze(text)), 256)


def stable_bucket(key: Column, buckets: int) -> Column:
    """The first 8 bytes of sha256(key), big-endian, modulo `buckets`."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """The n-grams of an array of words, each joined by blanks, which words do not hold; none if it is shorter.
    Strings, since distinct arrays are told apart by comparing each with all others."""
    none = F.array().cast("array<string>")
    gram = lambda w: lambda i: F.array_join(F.slice(w, i, n), " ")
    return let(items, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), gram(w))).otherwise(none))


def _unique(items: Column, n: int) -> Column:
    """Distinct over all n-grams of an array; null without any."""
    return F.when(F.size(items) >= n, F.size(F.array_distinct(ngrams(items, n))) / (F.size(items) - (n - 1)))


def unique_share(text: Column, n: int = 4) -> Column:
    """Distinct over all word n-grams; null without any."""
    return let(words(text), lambda w: _unique(w, n))


def repetition(text: Column, n: int = 4, floor: int = 80) -> Column:
    """1 - distinct/total word n-grams; 0 under `floor` words or without n-grams."""
    return let(words(text), lambda w: F.when(F.size(w) < floor, F.lit(0.0)).otherwise(F.coalesce(1.0 - _unique(w, n), F.lit(0.0))))


def repetition_penalty(text: Column, n: int = 4) -> Column:
    """How far the distinct share falls under 0.95, over 0.5, within 0..1; 0 under 20 words."""
    part = lambda w: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.95 - _unique(w, n)) / 0.5))
    return let(words(text), lambda w: F.when(F.size(w) < 20, F.lit(0.0)).otherwise(F.coalesce(part(w), F.lit(0.0))))


def rambling_penalty(text: Column) -> Column:
    """The worse repetition penalty of the thinking part and of what follows it."""
    plain = F.replace(F.replace(text, F.lit(IM_END), F.lit(" ")), F.lit(EOT), F.lit(" "))
    at = F.locate(THINK_END, plain)
    ahead = F.replace(F.substring(plain, F.lit(1), at - 1), F.lit(THINK), F.lit(" "))
    behind = F.substring(plain, at + len(THINK_END), F.length(plain))
    return F.when(at > 0, F.greatest(repetition_penalty(ahead), repetition_penalty(behind))).otherwise(repetition_penalty(plain))


def looks_french(text: Column) -> Column:
    """True under 40 characters, else with three of the signal words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(FRENCH_TOKEN), F.lit(0)))
    return (F.length(text) < 40) | (F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in FRENCH_WORDS]))) >= 3)


def letter_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}")) / F.greatest(F.length(text), F.lit(1))


def full_lines(text: Column) -> Column:
    """The trimmed lines of a text that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_share(text: Column) -> Column:
    """Distinct over all full lines; 1 without any."""
    return let(full_lines(text), lambda x: F.when(F.size(x) > 0, F.size(F.array_distinct(x)) / F.size(x)).otherwise(F.lit(1.0)))


def clean_book(text: Column) -> Column:
    """The text without the lines that look like a book's digital imprint."""
    return F.trim(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(BOOK_NOISE)), "\n"), F.lit(" \n\t\r"))


def clean_oral(text: Column) -> Column:
    """Speaker marks as dialogue dashes."""
    return F.trim(F.regexp_replace(F.trim(text), r"\[speaker\d+:?\]\s*", "\n— "), F.lit(" \n\t\r"))


def has_special(text: Column) -> Column:
    out = F.lit(False)
    for token in SPECIALS:
        out = out | F.contains(text, F.lit(token))
    return out


# Thinking blocks and final answers


def think_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1))


def without_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think>(.*?)</think>", ""), F.lit(" \n\t\r"))


def tags_balanced(text: Column) -> Column:
    opens, closes = F.regexp_count(text, F.lit("(?i)<think>")), F.regexp_count(text, F.lit("(?i)</think>"))
    return (opens == closes) & (opens == F.size(think_blocks(text)))


def visible_final(text: Column) -> Column:
    """What follows the last closing mark; what precedes an opening one that is never closed."""
    plain = F.replace(F.replace(text, F.lit(IM_END), F.lit("\n")), F.lit(EOT), F.lit("\n"))
    out = F.when(F.contains(plain, F.lit(THINK_END)), F.substring_index(plain, THINK_END, -1)).otherwise(F.substring_index(plain, THINK, 1))
    return F.trim(out, F.lit(" \n\t\r"))


def last_number(text: Column) -> Column:
    """The last digit group, inner blanks removed; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9](?:[0-9 ]*[0-9])?"), F.lit(0))
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(" "), F.lit(""))


def last_decimal(text: Column) -> Column:
    """The last number with thousands blanks and decimal comma; null without one."""
    plain = F.translate(text, "  ", "  ")
    found = F.regexp_extract_all(plain, F.lit(r"[0-9]+(?: [0-9]{3})*(?:,[0-9]+)?"), F.lit(0))
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(" "), F.lit(""))


# Conversations: arrays of struct(role, text)


def full_messages(messages: Column) -> Column:
    """The messages that aren't blank, their text trimmed."""
    trimmed = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.trim(F.coalesce(m["text"], F.lit("")), F.lit(" \n\t\r")).alias("text")))
    return F.filter(trimmed, lambda m: m["text"] != "")


def render_chat(messages: Column) -> Column:
    """A conversation in the chat format."""
    return F.array_join(F.transform(full_messages(messages), lambda m: F.concat(F.lit(IM_START), m["role"], F.lit("\n"), m["text"], F.lit(IM_END + "\n"))), "")


def chat_segments(messages: Column, ensure_think: bool = False) -> Column:
    """array<struct<text, learn>>: a header and a body for each message; only assistant bodies are learnt."""

    def pair(m: Column) -> Column:
        own = m["role"] == "assistant"
        body = m["text"]
        if ensure_think:
            body = F.when(own & ~F.startswith(body, F.lit(THINK)), F.concat(F.lit(f"{THINK}\n\n{THINK_END}\n"), body)).otherwise(body)
        head = F.struct(F.concat(F.lit(IM_START), m["role"], F.lit("\n")).alias("text"), F.lit(False).alias("learn"))
        return F.array(head, F.struct(F.concat(body, F.lit(IM_END + "\n")).alias("text"), own.alias("learn")))

    return F.flatten(F.transform(full_messages(messages), pair))


def by_role(messages: Column, role: str) -> Column:
    """The texts of a role's messages, in order."""
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["text"])


def prompt_fingerprint(messages: Column) -> Column:
    return fingerprint(F.array_join(F.transform(by_role(messages, "user"), lambda x: F.coalesce(x, F.lit(""))), "\n"))
