"""PII spans: high-recall generators propose overlapping candidates, boosted trees judge them, calibrated thresholds select.

DataFrame functions only. Patterns are written so that the regex engine neither recurses by the length of a match nor
rescans a run from each of its characters: a separator between two characters of a run is first replaced, one for one, by
a control character, after which a run is a plain character class. Replacements keep all offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("number", "masked_email")
KINDS = BASE_KINDS + ADDED_KINDS

_MARK = "\u0001"
_LOCAL = f"[A-Za-z0-9._%+{_MARK}-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
CARD = f"[0-9][0-9{_MARK}]{{12,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = f"[0-9][0-9{_MARK}]{{7,}}+"
MASKED = r"(?i)[a-z0-9._%+-]{1,64}\x20?[\[({]\x20?at\x20?[\])}]\x20?[a-z0-9-]{1,63}(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\.)[a-z]{2,24}"

#: Generated examples that each kind's trees are fitted on, and as many that its threshold is calibrated on.
FIT_ROWS = 2000
ROUNDS, RATE = 24, 0.4
#: Lowest precision on the calibration examples.
PRECISION = 0.95
FEATURES = {
    "number": ("digits", "marks", "groups", "luhn", "zero", "variety", "personal", "other", "left"),
    "masked_email": ("common_domain", "brackets", "spaced_dot", "local_length", "personal", "other", "left"),
}

# Words before a number that speak for and against a person's number, in four languages.
PERSONAL = "ssn|social|passport|account|acct|iban|card|phone|tel|mobile|call|fax|id|licen[cs]e|konto|ausweis|telefon|steuer|compte|carte|passeport|cuenta|tarjeta|pasaporte|dni|t[ée]l[ée]fono"
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|eu|uk|co"
OTHER = "order|invoice|version|page|figure|isbn|issn|doi|total|price|eur|usd|born|year|since|line|serial|sku|part|seite|preis|prix|precio|commande|factura|build|commit"


_SPAN = "struct<start:int,stop:int,value:string,before:string>"
#: Matches that are located at a time; arrays that grow are copied with every step.
LOCATED = 512


def _parts(view: Column, pattern: str) -> Column:
    """The matches of `pattern` in `view`, each with what is between it and the one before; the rest without a match."""
    none = F.expr("cast(array() as array<struct<gap:string,hit:string>>)")
    parts = F.arrays_zip(F.split(view, pattern, -1).alias("gap"), F.regexp_extract_all(view, F.lit(pattern), F.lit(0)).alias("hit"))
    return F.when(view.rlike(pattern), parts).otherwise(none)


def _located(parts: Column) -> Column:
    """The matches as an array of (start, stop, value, before), offsets in code points. Blocks of matches are located from
    their own start and then moved. parts must be a column of its own, as it is looked up for each block."""
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        found = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("value"), F.right(x["gap"], F.lit(24)).alias("before"))
        return F.struct(stop.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], found)).alias("out"))

    def moved(acc: Column, block: Column) -> Column:
        spans = F.transform(block["out"], lambda s: F.struct((acc["at"] + s["start"]).alias("start"), (acc["at"] + s["stop"]).alias("stop"), s["value"].alias("value"), s["before"].alias("before")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], spans).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(LOCATED)), lambda i: F.aggregate(F.slice(parts, i, LOCATED), begin, step))
    return F.when(F.size(parts) == 0, empty).otherwise(F.aggregate(blocks, begin, moved, lambda acc: acc["out"]))


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (F.lit(1) + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.translate(value, f"{_MARK}+ ().-", "")


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """docs with one array of located candidates for each kind; base kinds hold only valid ones."""
    clean = F.translate(text, _MARK, "\u0002")
    with_views = docs.withColumns(
        {
            "_text": text,
            "_mail_view": F.when(F.contains(text, F.lit("@")), F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)).otherwise(""),
            "_number_view": F.when(text.rlike("[0-9]{2}|[0-9][ -][0-9]"), F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", _MARK)).otherwise(""),
        }
    )
    masked_view = F.when(F.contains(F.col("_text"), F.lit("at")) & F.col("_text").rlike(r"(?i)[\[({]\x20?at\x20?[\])}]"), F.col("_text")).otherwise("")
    views = {"email": (F.col("_mail_view"), EMAIL), "ip": (F.col("_text"), IP), "numbers": (F.col("_number_view"), NUMBER), "phone": (F.col("_text"), PHONE), "masked": (masked_view, MASKED)}
    parted = with_views.withColumns({f"_p_{kind}": _parts(*view) for kind, view in views.items()})
    located = parted.withColumns({f"_{kind}": _located(F.col(f"_p_{kind}")) for kind in views})
    is_card = lambda s: F.char_length(_digits(s["value"])).between(13, 19) & _luhn(_digits(s["value"]))
    return located.withColumns(
        {
            "_ip": F.filter("_ip", lambda s: s["value"].rlike(IP_VALID)),
            "_phone": F.filter("_phone", lambda s: F.char_length(_digits(s["value"])).between(9, 15)),
            "_card": F.filter("_numbers", is_card),
            "_number": F.filter("_numbers", lambda s: F.char_length(_digits(s["value"])).between(8, 19) & ~is_card(s)),
        }
    )


def _rated(df: DataFrame) -> DataFrame:
    """df with each added kind's candidates as their places and the kind's own features."""

    def context(s: Column) -> dict[str, Column]:
        before, last = F.lower(s["before"]), F.right(s["before"], F.lit(1))
        return {
            "personal": before.rlike(rf"(?:^|[^a-z])(?:{PERSONAL})[^a-z]").cast("int"),
            "other": before.rlike(rf"(?:^|[^a-z])(?:{OTHER})[^a-z]").cast("int"),
            "left": F.when(last.rlike("[A-Za-z]"), 2).when(last.rlike("[$€£#.,/:]"), 1).otherwise(0),
        }

    def number(s: Column) -> dict[str, Column]:
        digits = _digits(s["value"])
        n = F.char_length(digits)
        return {
            "digits": n,
            "marks": F.char_length(s["value"]) - n,
            "groups": F.size(F.array_distinct(F.transform(F.split(s["value"], _MARK), F.char_length))),  # different lengths of groups
            "luhn": _luhn(digits).cast("int"),
            "zero": digits.startswith("0").cast("int"),
            "variety": F.size(F.array_distinct(F.split(digits, ""))),
            **context(s),
        }

    def masked(s: Column) -> dict[str, Column]:
        value = F.lower(s["value"])
        return {
            "common_domain": value.rlike(rf"[^a-z](?:{DOMAINS})$").cast("int"),
            "brackets": F.char_length(value) - F.char_length(F.translate(value, "[({", "")),
            "spaced_dot": value.rlike(r"[\])}]\x20|\x20[\[({]").cast("int"),
            "local_length": F.char_length(F.regexp_extract(value, r"^[a-z0-9._%+-]+", 0)),
            **context(s),
        }

    def rated(values, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), *(c.cast("int").alias(f) for f, c in values(s).items() if f in FEATURES[kind]))

    return df.withColumns({"_number": F.transform("_number", rated(number, "number")), "_masked_email": F.transform("_masked", rated(masked, "masked_email"))})


# ------------------------------------------------------------------ the trees


@dataclass(frozen=True)
class Trees:
    """Depth-two trees over named features, as (feature, cut, (feature, cut, low, high), (feature, cut, low, high)), and the
    threshold of the probability."""

    features: tuple[str, ...]
    base: float
    trees: tuple
    threshold: float = 1.01

    def column(self, s: Column) -> Column:
        def leaf(t) -> Column:
            return F.when(s[self.features[t[0]]] <= t[1], F.lit(t[2])).otherwise(F.lit(t[3]))

        total = reduce(lambda a, b: a + b, (F.when(s[self.features[f]] <= c, leaf(a)).otherwise(leaf(b)) for f, c, a, b in self.trees), F.lit(self.base))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def values(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, c, a, b in self.trees:
            low, high = (np.where(x[:, t[0]] <= t[1], t[2], t[3]) for t in (a, b))
            total += np.where(x[:, f] <= c, low, high)
        return 1 / (1 + np.exp(-total))


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, int]:
    best = (-1.0, 0, 0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[rows, f])[:-1]:
            low = rows & (x[:, f] <= cut)
            high = rows & ~low
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, int(cut))
    return best


def boost(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], rounds: int = ROUNDS, rate: float = RATE) -> Trees:
    """Gradient boosting of depth-two trees under logistic loss with Newton leaves."""
    p = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
    base, trees = math.log(p / (1 - p)), []
    total = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        everything = np.ones(len(y), bool)
        _, f, c = _best(x, g, h, everything)
        sides = []
        for side in (x[:, f] <= c, x[:, f] > c):
            _, f2, c2 = _best(x, g, h, side)
            low, high = side & (x[:, f2] <= c2), side & (x[:, f2] > c2)
            sides.append((f2, c2, *(round(float(rate * g[r].sum() / (h[r].sum() + 1)), 9) for r in (low, high))))
        trees.append((f, c, *sides))
        low, high = (np.where(x[:, t[0]] <= t[1], t[2], t[3]) for t in sides)
        total += np.where(x[:, f] <= c, low, high)
    return Trees(features, base, tuple(trees))


def calibrated(trees: Trees, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Trees:
    """With the lowest threshold from which on the examples reach the precision, halfway to the next score below it (1.01,
    so none, if nowhere)."""
    scores = trees.values(x)
    levels = np.unique(scores)
    fit = [i for i, c in enumerate(levels) if y[scores >= c].mean() >= precision]
    if not fit:
        return trees
    below = levels[fit[0] - 1] if fit[0] else 0.0
    return Trees(trees.features, trees.base, trees.trees, round(float(levels[fit[0]] + below) / 2, 9))


# Texts about a candidate and the forms it takes (A, B, C: runs of three, two and four digits; M: a masked address), for
# and against a person's data. The trees are fitted on the first set and calibrated on the second, which shares neither
# texts nor forms with it.
FIT_FORMS = {
    "number": (
        ("My SSN: ", "passport no ", "account ", "call ", "tel. ", "mobile ", "Konto ", "cuenta ", "compte ", "of the ", ""),
        ("AAA-BB-CCCC", "CCCC CCCC BB", "BB BB BB BB BB", "AAA AAA AAA", "CCCCCCCCBB", "BBCCCCCCC AAA"),
        ("order ", "invoice ", "version ", "ISBN ", "total ", "price $", "commit ", "serial ", "of the ", "build.", "the ", "x", ""),
        ("CCCCCCCC", "CCCC-BB-BB", "CCCCCCCCCCCCCCCC", "00000000BB", "CCCCCCCCCCCCC", "AAAAAAAAAAAAAAAAAA", "11111111AA"),
    ),
    "masked_email": (
        ("mail ", "write to ", ""),
        ("jo.doe [at] mailB [dot] com", "anna(at)mailB.org", "k_lee {at} hostB.de", "max.m [at] postB (dot) fr"),
        ("look ", "it was ", ""),
        ("it (at) end.Then", "we (at) times.so", "pause [at] last.When", "one (at) a.Time"),
    ),
}
CALIBRATION_FORMS = {
    "number": (
        ("licence ", "fax ", "dial ", "her number is ", "DNI ", "Telefon ", "reach me on ", "IBAN DE", "and "),
        ("AAA BB CCCC", "BBB BBB BBBB", "CCCC-CCCC", "AAA-AAA-CCCC", "BB CCC CCC", "CCCCCCCAA"),
        ("figure ", "since ", "part ", "EUR ", "row ", "lot no. ", "batch ", "sku-", "and "),
        ("CCCCCCCCBBBB", "CCCCBBBB", "AAAAAAAAAA", "22222222BB", "CCCC-CCCC-CCCC-CCCC", "BBBBBBBBBBB"),
    ),
    "masked_email": (
        ("contact: ", "e-mail me, ", "von "),
        ("sue.b[at]firmB[dot]net", "r.ray (at) schoolB (dot) edu", "pat99 [at] webB.info", "lu {at} siteB {dot} io"),
        ("stop ", "so ", "und "),
        ("here (at) once.More", "meet [at] noon.Please", "look (at) him.Now", "sold {at} cost.Only"),
    ),
}


def _examples(spark: SparkSession, rows: int, kind: str, forms: dict) -> DataFrame:
    """Generated texts with one candidate of the kind each, and its label."""

    def pick(options, salt: int) -> str:
        listed = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
        return f"element_at(array({listed}), cast(pmod(xxhash64(id, {salt}), {len(options)}) + 1 as int))"

    def filled(form: str) -> str:
        for letters, n, salt in (("CCCC", 4, 5), ("AAA", 3, 6), ("BB", 2, 7), ("C", 1, 8), ("B", 1, 9)):
            form = f"replace({form}, '{letters}', lpad(cast(pmod(xxhash64(id, {salt}), {10**n}L) as string), {n}, '0'))"
        return form

    yes, yes_forms, no, no_forms = forms[kind]
    label = "cast(pmod(xxhash64(id, 20), 2) as int)"
    text = f"if({label} = 1, concat({pick(yes, 1)}, {filled(pick(yes_forms, 3))}), concat({pick(no, 2)}, {filled(pick(no_forms, 4))}))"
    return spark.range(rows).selectExpr("id", f"concat({text}, ' then') AS text", f"{label} AS label")


def _table(spark: SparkSession, rows: int, kind: str, forms: dict) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the examples' candidates."""
    rated = _rated(candidates(_examples(spark, rows, kind, forms), F.col("text"))).select("id", "label", F.explode(f"_{kind}").alias("f"))
    got = sorted((r["id"], r["label"], *(r["f"][n] for n in FEATURES[kind])) for r in rated.collect())
    table = np.array(got, dtype=np.int64).reshape(len(got), 2 + len(FEATURES[kind]))
    return table[:, 2:], table[:, 1].astype(float)


def fit_trees(spark: SparkSession, rows: int = FIT_ROWS) -> dict[str, Trees]:
    """Each added kind's trees, fitted on one set of generated examples and calibrated on another with other texts and
    forms, so that a threshold tells how the trees do on what they haven't seen."""
    out = {}
    for kind in ADDED_KINDS:
        x, y = _table(spark, rows, kind, FIT_FORMS)
        out[kind] = calibrated(boost(x, y, FEATURES[kind]), *_table(spark, rows, kind, CALIBRATION_FORMS)) if len(y) else Trees(FEATURES[kind], 0.0, ())
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: dict[str, Trees] | None = None) -> DataFrame:
    """Per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Valid base spans always stay; number and masked_email candidates are added where their probability reaches the
    threshold calibrated for their kind. Spans may overlap. Null and empty texts have none. Rows are judged one by one,
    without a shuffle: repeated rows get equal results, an empty table gives no rows, other columns are ignored.
    """
    trees = trees or fit_trees(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_raw"))
    found = _rated(candidates(rows, F.col("_raw")))

    def selected(kind: str) -> Column:
        return F.filter(f"_{kind}", lambda s: trees[kind].column(s) >= trees[kind].threshold)

    chosen = found.withColumns({f"_{kind}": selected(kind) for kind in ADDED_KINDS})

    def named(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))

    joined = chosen.withColumns({f"_s_{k}": named(k) for k in KINDS})
    count = lambda k: F.size(f"_s_{k}").cast("long")
    return joined.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.concat(*(f"_s_{k}" for k in BASE_KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*(f"_s_{k}" for k in KINDS)), ",").alias("spans"),
        (count("number") + count("masked_email")).alias("n_added"),
    )
