"""Column builders for text: normal forms, tokens, shingles, hashes, buckets and classifications."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width and dash characters and what they stand for.
WIDE = "０１２３４５６７８９＋，．／⁄　−‐‑‒–—﹣－"
PLAIN = "0123456789+,.// --------"

# Problem types and their words, the first type that matches counts.
PROBLEM_TYPES = (
    ("geometry", "triangle|circle|angle|polygon|rectangle|square|rhombus|trapezoid|parallelogram|geometry|geometric|perimeter|circumference|radius|diameter|hypotenuse|coordinate plane|solid|sphere|cone|cylinder"),
    ("number_theory", "prime|divisor|divisible|factorization|remainder|modulo|congruent|gcd|lcm|greatest common|least common|integer solution|diophantine|perfect square"),
    ("combinatorics_probability", "probability|permutation|combination|arrange|arrangement|how many ways|choose|selected|committee|outcomes?|dice|cards?|urn"),
    ("algebra", "equation|polynomial|function|sequence|series|roots?|inequality|logarithm|exponential|coefficient|matrix|determinant"),
)
OTHER_TYPE = "arithmetic_word_problem"


def plain_characters(text: Column) -> Column:
    return F.translate(text, WIDE, PLAIN)


def collapse(text: Column) -> Column:
    """White space of any script as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


_COUNT = "[0-9][0-9,]*"
#: A number that touches neither a letter nor an underscore: sign, decimals and a denominator belong to it.
NUMBER = rf"(?<![a-z_])[+-]?{_COUNT}(?:[.][0-9]+)?(?:\s*/\s*{_COUNT})?(?![a-z_])"


def template(text: Column) -> Column:
    """The words and numbers of a text in lower case, each number as <num>; all else but < and > is dropped.

    Compatibility forms are left to normal_form."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"{NUMBER}|[a-z<>]+"), F.lit(0))
    return F.array_join(F.transform(found, lambda t: F.when(t.rlike("[0-9]"), "<num>").otherwise(t)), " ")


# Money, units and the words that aren't names though they begin with a capital.
CURRENCY_WORDS = "usd eur gbp dollars? euros? pounds? rupees? won yen cents? rs[.]"
UNIT_WORDS = "millimeters? centimeters? meters? kilometers? inches? feet foot yards? miles? grams? kilograms? ounces? pounds? liters? litres? gallons? seconds? minutes? hours? days? weeks? months? years? degrees? radians? percent percentage mph kmh km/h m/s square\\s+units? cubic\\s+units?"


def placeholder_template(text: Column, plain_words: list[str]) -> Column:
    """Lower case with URLs, money, units, numbers and capitalised words (but for plain_words) as placeholders."""
    words = lambda listed: rf"(?i)\b(?:{'|'.join(listed.split())})\b"
    steps = (
        (r"(?i)https?://\S+", "<url>"),
        (rf"[$€£¥₹₩]|{words(CURRENCY_WORDS)}", "<currency>"),
        (words(UNIT_WORDS), "<unit>"),
        (rf"(?<![A-Za-z_])[+\-−]?\s*(?:{_COUNT}(?:[.][0-9]+)?|[.][0-9]+)(?:\s*/\s*{_COUNT})?(?![A-Za-z_])", "<num>"),
    )
    for pattern, name in steps:
        text = F.regexp_replace(text, pattern, f" {name} ")
    text = F.regexp_replace(text, rf"\b(?!(?i:{'|'.join(plain_words)})\b)[A-Z][a-z]{{2,}}\b", "<name>")
    return collapse(F.lower(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(template(text), F.lit("[a-z]+|<num>"), F.lit(0))


def shingles(words: Column, width: int = 3) -> Column:
    """The set of `width` consecutive words; fewer words make one, none an empty set."""
    # slices side by side: no lambda looks the words up, so the optimizer may inline them without a cost that squares
    n = F.greatest(F.size(words) - (width - 1), F.lit(0))
    runs = F.arrays_zip(*(F.slice(words, F.lit(i + 1), n).alias(f"w{i}") for i in range(width)))
    joined = F.transform(runs, lambda r: F.concat_ws(" ", *(r[f"w{i}"] for i in range(width))))
    return F.when(F.size(words) >= width, F.array_distinct(joined)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def normal_form(kind: str = "NFKC"):
    """A vectorised function for Unicode normal forms and case folding, which the engine has none for."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize(kind, t).casefold())

    return run


def stable_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by a unit separator: the order of every deterministic choice."""
    return F.sha2(F.concat_ws("\u001f", *(p.cast("string") for p in parts)), 256)


def hash_fold(key: Column, folds: int) -> Column:
    """sha256 of the key modulo `folds`, digit by digit, so any modulus works on all 256 bits."""
    digits = F.transform(F.split(F.sha2(key.cast("string"), 256), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % folds)


def bounded_bucket(value: Column, bounds: list[int], prefix: str) -> Column:
    """prefixLOW_HIGH of the first bound that the value doesn't pass, prefixLOW_plus beyond the last."""
    names = F.array(*(F.lit(f"{prefix}{a + 1}_{b}") for a, b in zip([0, *bounds], [*bounds, "plus"], strict=True)))
    passed = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value))
    return F.when(value.isNotNull(), F.get(names, passed))


def first_match(text: Column, rules: tuple[tuple[str, str], ...], other: str) -> Column:
    return F.coalesce(*(F.when(text.rlike(rf"(?iU)\b(?:{words})\b"), F.lit(name)) for name, words in rules), F.lit(other))


def problem_type(question: Column) -> Column:
    return first_match(question, PROBLEM_TYPES, OTHER_TYPE)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w)) for w in words))


def answer_sign(answer: Column) -> Column:
    return F.when(answer.startswith("-"), "negative").when(answer == "0", "zero").otherwise("positive")


def digit_count(answer: Column) -> Column:
    return F.greatest(F.length(F.regexp_replace(F.regexp_replace(answer, "^-", ""), "^0+", "")), F.lit(1))


def numeric_signature(text: Column) -> Column:
    """The numbers of a text in order, thousands commas dropped, joined by commas."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"-?[0-9][0-9,]*"), F.lit(0)), lambda n: F.translate(n, ",", "")), ",")


def last_nonempty_line(text: Column) -> Column:
    return F.get(F.reverse(F.filter(F.split(text, r"\R"), lambda line: F.trim(line) != "")), F.lit(0))


def head_tail(text: Column, head: int, tail: int) -> Column:
    """The text, or its beginning and end about a mark when it is longer."""
    return F.when(F.char_length(text) <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(" … "), F.right(text, F.lit(tail))))
