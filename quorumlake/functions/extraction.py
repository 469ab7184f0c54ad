"""Answers from model output, as column expressions: explicit markers first, then a last line that is an integer, then the
last integer of the body. A text is read as its markers with what follows each; numbers are read as whole expressions, so
that a part of a decimal or a fraction never counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import plain_characters

CANONICAL = r"^-?(?:0|[1-9][0-9]*)$"
# The markers, the words of an answer sentence, and the signs of notation about a number.
FINAL_NAME, BOX_NAME = "FINAL_ANSWER", "boxed"
SENTENCE_LEADS = ("therefore", "thus", "hence", "so")
CURRENCIES = "€£¥₹₩"
SELECTED_NAME = "SELECTED_CANDIDATE"

_GROUPED = "[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])"
_UNSIGNED = f"(?:{_GROUPED}|[0-9]+)"
_SIGNED = rf"[+-]?\s*{_UNSIGNED}"
_TEX = rf"\\d?frac(?:\s*\{{\s*{_UNSIGNED}\s*\}}){{2}}"
_POINT, _SLASH = r"\s*\.\s*[0-9]+", rf"\s*/\s*{_UNSIGNED}"
#: A number with all that makes it something else than an integer: decimals, fractions, mixed numbers.
NUMBER = rf"(?U)[+-]?\s*(?:{_UNSIGNED}(?:{_POINT}(?:{_SLASH})?|{_SLASH}(?:{_POINT})?|\s+{_UNSIGNED}{_SLASH}|\s*{_TEX})?|\.\s*[0-9]+|{_TEX})"
#: Notation before a number, and what may close it.
_OPENING = rf"(?U)^(?:\s|\*\*|\\?\$|[{CURRENCIES}}}]|\\[(\[])+"
_CLOSING = r"\\[)\]]|\\?\$|\*\*"
_MARKER = rf"(?i:{FINAL_NAME}\s*:|\\{BOX_NAME}\s*\{{)"
#: From a box's brace to the one that closes it, with one level of braces inside at most.
_BOX = r"^((?:[^{}\r\n]|\{[^{}\r\n]*\})*)\}"
_BLANK = r"(?U)^\s*$"


def _strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def _last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def normalise_integer(raw: Column) -> Column:
    """Blanks, commas and a plus sign dropped, -0 as 0; null unless canonical."""
    value = F.regexp_replace(F.regexp_replace(plain_characters(raw), r"(?U)[\s,]", ""), r"^\+", "")
    value = F.when(value == "-0", "0").otherwise(value)
    return F.when(value.rlike(CANONICAL), value)


def parse_candidate(text: Column, explicit: bool = False) -> Column:
    """The canonical integer that a short text begins with, when only notation and words follow; an explicit one may end
    in a point and zeros. Null when it states none."""
    bare = F.regexp_replace(plain_characters(text), _OPENING, "")
    zeros = r"(?:\s*\.\s*0+)?" if explicit else ""
    number = rf"(?U)^({_SIGNED}){zeros}"
    rest = F.regexp_replace(F.regexp_replace(bare, number, ""), _CLOSING, "")
    return F.when(bare.rlike(number) & ~rest.rlike(r"[0-9+*=^]|\n.*\S"), normalise_integer(F.regexp_extract(bare, number, 1)))


def last_integer(text: Column) -> Column:
    """The last canonical integer that stands by itself."""
    whole = F.filter(F.regexp_extract_all(plain_characters(text), F.lit(NUMBER), F.lit(0)), lambda n: n.rlike(rf"(?U)^{_SIGNED}$"))
    return _last(F.filter(F.transform(whole, normalise_integer), lambda v: v.isNotNull()))


def last_line(text: Column) -> Column:
    """The last line that isn't blank."""
    return _last(F.filter(F.split(text, "\\R|[\u001c-\u001e]"), lambda line: ~line.rlike(_BLANK)))


def occurrences(text: Column) -> Column:
    """The explicit markers in their order: array of (kind, content, closed, value, numeric).

    kind is final or boxed; content is the rest of the line, or what a closed box holds; value the integer it states."""
    pieces = F.split(text, _MARKER, -1)
    marks = F.regexp_extract_all(text, F.lit(_MARKER), F.lit(0))
    follow = F.slice(pieces, F.lit(2), F.size(marks))
    # from the last marker to the first: a piece without a line's end goes on with the marker after it
    begin = F.struct(F.lit("").alias("line"), _strings().alias("lines"))
    zipped = F.reverse(F.arrays_zip(marks.alias("mark"), follow.alias("piece")))

    def step(acc: Column, x: Column) -> Column:
        line = F.when(F.contains(x["piece"], F.lit("\n")), F.substring_index(x["piece"], "\n", 1)).otherwise(F.concat(x["piece"], acc["line"]))
        return F.struct(F.concat(x["mark"], line).alias("line"), F.array_append(acc["lines"], line).alias("lines"))

    lines = F.reverse(F.aggregate(zipped, begin, step, lambda acc: acc["lines"]))
    each = F.arrays_zip(marks.alias("mark"), follow.alias("piece"), lines.alias("line"))

    def told(x: Column) -> Column:
        box = F.contains(x["mark"], F.lit("{"))
        closed = ~box | x["line"].rlike(_BOX)
        content = F.when(box & closed, F.regexp_extract(x["line"], _BOX, 1)).otherwise(x["line"])
        return F.struct(
            F.when(box, "boxed").otherwise("final").alias("kind"),
            content.alias("content"),
            closed.alias("closed"),
            F.when(closed, parse_candidate(content, explicit=True)).alias("value"),
            content.rlike("[0-9０-９]").alias("numeric"),
            (box & closed & (F.char_length(content) >= F.char_length(x["piece"])) & F.contains(x["line"], F.lit("\\"))).alias("around"),
        )

    found = F.transform(each, told)
    # a box inside a box is part of its content
    return F.filter(found, lambda o, i: (i == 0) | (o["kind"] == "final") | ~F.coalesce(F.get(found, i - 1)["around"], F.lit(False)))


def extract_answers(rows: DataFrame, text: str, out: str = "extraction") -> DataFrame:
    """rows with a struct (answer, path, failure_reason, explicit_candidates). Built-in functions only."""
    raw = F.col(text)
    blank = raw.isNull() | raw.rlike(_BLANK)
    marked = F.contains(F.upper(raw), F.lit(FINAL_NAME)) | F.contains(F.lower(raw), F.lit(BOX_NAME))
    none = F.expr("cast(array() as array<struct<kind:string,content:string,closed:boolean,value:string,numeric:boolean,around:boolean>>)")
    df = rows.withColumn("_found", F.when(~blank & marked, occurrences(raw)).otherwise(none))
    values = lambda keep: F.transform(F.filter("_found", lambda o: o["value"].isNotNull() & keep(o)), lambda o: o["value"])
    df = df.withColumns(
        {
            "_explicit": values(lambda o: F.lit(True)),
            "_final": _last(values(lambda o: o["kind"] == "final")),
            "_unread": F.exists("_found", lambda o: o["value"].isNull() & o["numeric"]),
            "_line": F.when(~blank & (F.size("_found") == 0), parse_candidate(last_line(raw))),
        }
    )
    df = df.withColumn("_body", F.when(~blank & (F.size("_found") == 0) & F.col("_line").isNull(), last_integer(raw)))
    reason = (
        F.when(blank, "no_supported_answer_marker")
        .when(F.size(F.array_distinct("_explicit")) > 1, "conflicting_explicit_answers")
        .when(F.col("_unread"), "non_integer_only")
        .when(F.size("_explicit") > 0, None)
        .when(F.size("_found") > 0, "no_supported_answer_marker")
        .when(F.coalesce("_line", "_body").isNotNull(), None)
        .otherwise(F.when(raw.rlike("[0-9０-９]"), "non_integer_only").otherwise("no_supported_answer_marker"))
    )
    df = df.withColumn("_reason", reason)
    good = F.col("_reason").isNull()
    answer = F.when(good, F.coalesce("_final", _last(F.col("_explicit")), "_line", "_body"))
    path = (
        F.when(~good, "none").when(F.col("_final").isNotNull(), "final_answer_marker").when(F.size("_explicit") > 0, "boxed").when(F.col("_line").isNotNull(), "standalone_last_line").otherwise("last_integer")
    )
    result = F.struct(answer.alias("answer"), path.alias("path"), F.col("_reason").alias("failure_reason"), F.col("_explicit").alias("explicit_candidates"))
    return df.withColumn(out, result).select(*[c for c in rows.columns if c.lower() != out.lower()], out)


# ------------------------------------------------------- older and other readers

_ATOM = r"[+\-−–—]?\s*(?:[0-9][0-9,]*(?:\.[0-9]+|\s*/\s*[0-9][0-9,]*)?|\.[0-9]+)"
_MONEY = rf"\\?[${CURRENCIES}]"
_VALUE = rf"(?:(?:{_MONEY})?\s*(?:[+\-−–—]?\s*{_TEX}|{_ATOM}))"
_B0_FINAL = rf"(?im)\bFINAL[_ ]ANSWER\s*:\s*(?:\*\*|\}})?\s*(?:\\\(\s*)?({_VALUE})\s*(?:\\\))?\s*(?:%|\\text\{{[^{{}}\r\n]+\}})?\s*(?:\*\*)?(?=\s*[.!]?\s*$)"
_B0_BOX = rf"\\{BOX_NAME}\s*\{{([^{{}}\r\n]+)\}}"
_B0_SENTENCE = rf"(?im)^(?:\s*(?:{'|'.join(SENTENCE_LEADS)})[, ]+)?\s*(?:the\s+)?(?:final\s+)?answer\s+(?:is|equals?)\s*[:=]?\s*({_VALUE})\s*[.!]?\s*$"
_B0_LINE = rf"^\s*({_VALUE})\s*[.!]?\s*$"


def baseline_value(raw: Column) -> Column:
    """A number as the first policy writes it: an integer, a decimal or a plain fraction; null for anything else."""
    value = F.regexp_replace(F.translate(raw, "−–—", "---"), rf"\\[()]|{_MONEY}|[\s,]", "")
    value = F.regexp_replace(value, r"^([+-]?)\\d?frac\{([0-9]+)\}\{([0-9]+)\}$", "$1$2/$3")
    value = F.regexp_replace(F.regexp_replace(value, r"^\+", ""), r"^(-?[0-9]+)\.0+$", "$1")
    return F.when(value.rlike(r"^-?(?:[0-9]+(?:\.[0-9]+)?|[0-9]+/[0-9]+)$"), value)


def extract_baseline(rows: DataFrame, text: str, out: str = "baseline") -> DataFrame:
    """rows with a struct (answer, path, failure_reason, explicit_candidates) by the first policy: markers, boxes, a
    sentence that states the answer, or a last line that is a number; never a number from the body."""
    raw = F.col(text)

    def all_values(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), baseline_value)
        return F.coalesce(F.filter(found, lambda v: v.isNotNull()), _strings())

    df = rows.withColumns({"_f": all_values(_B0_FINAL), "_b": all_values(_B0_BOX), "_s": all_values(_B0_SENTENCE)})
    df = df.withColumn("_e", F.when(F.size("_f") + F.size("_b") > 0, F.concat("_f", "_b")).otherwise(F.col("_s")))
    line = last_line(raw)
    single = F.when(line.rlike(_B0_LINE), baseline_value(F.regexp_extract(line, _B0_LINE, 1)))
    clash = F.size(F.array_distinct("_e")) > 1
    answer = F.when(~clash, F.coalesce(_last(F.col("_f")), _last(F.col("_b")), _last(F.col("_s")), single))
    path = F.when(answer.isNull(), "none").when(F.size("_f") > 0, "final_answer_marker").when(F.size("_b") > 0, "boxed").otherwise("standalone_last_line")
    reason = F.when(clash, "conflicting_explicit_answers").when(answer.isNull(), "no_supported_answer_marker")
    return df.withColumn(out, F.struct(answer.alias("answer"), path.alias("path"), reason.alias("failure_reason"), F.col("_e").alias("explicit_candidates"))).select(*rows.columns, out)


def explicit_values(text: Column) -> Column:
    """(values, malformed): the integers that the markers state, in order, and whether a marker states none but has digits."""
    found = occurrences(text)
    return F.struct(F.transform(F.filter(found, lambda o: o["value"].isNotNull()), lambda o: o["value"]).alias("values"), F.exists(found, lambda o: o["value"].isNull() & o["numeric"]).alias("malformed"))


def last_stated(text: Column) -> Column:
    """The last integer of each of the forms marker, box and "answer is", in the order of their places."""
    value = r"([+-]?\s*[0-9][0-9,]*)"
    # the text up to a form's last match tells its place
    forms = (rf"(?is)^(.*){FINAL_NAME}\s*:\s*\$?{value}", rf"(?s)^(.*)\\{BOX_NAME}\s*\{{([^{{}}\r\n]+)\}}", rf"(?is)^(.*)\banswer\s+is\s*:?\s*\$?{value}")
    each = F.array(*(F.when(text.rlike(p), F.struct(F.char_length(F.regexp_extract(text, p, 1)).alias("at"), normalise_integer(F.regexp_extract(text, p, 2)).alias("value"))) for p in forms))
    return F.transform(F.array_sort(F.filter(each, lambda o: o["value"].isNotNull())), lambda o: o["value"])


def normalise_trace(rows: DataFrame, text: str) -> DataFrame:
    """rows with trace, status, source and candidate: a safe integer that the text states is appended as a final line.

    Safe is what a marker, a box or a last line states; the body's last integer is not. A text whose last line already is
    that final line stays as it is."""
    e = extract_answers(rows, text, "_e")
    raw, answer = F.coalesce(F.col(text), F.lit("")), F.col("_e.answer")
    safe = answer.isNotNull() & (F.col("_e.path") != "last_integer")
    line = F.concat(F.lit(f"{FINAL_NAME}: "), answer)
    status = (
        F.when(F.col("_e.failure_reason") == "conflicting_explicit_answers", "conflicting_explicit_answers")
        .when(~safe, "no_safe_integer_candidate")
        .when(last_line(raw) == line, "already_canonical_final_line")
        .otherwise("appended_final_answer")
    )
    done = e.withColumn("status", status).withColumn("source", F.when(safe, F.col("_e.path")).otherwise("none")).withColumn("candidate", F.when(safe, answer))
    trace = F.when(F.col("status") == "appended_final_answer", F.concat(F.regexp_replace(raw, r"(?U)\s+$", ""), F.lit("\n"), line, F.lit("\n"))).otherwise(raw)
    return done.withColumn("trace", trace).drop("_e")


def resolve_selection(rows: DataFrame, text: str, candidates: str) -> DataFrame:
    """rows with position, origin, selected, stated, resolved, resolution, valid and mismatch: the last selected position of
    `text` looked up in `candidates`, an array of (position, origin, answer); else the answer that the text states."""
    e = extract_answers(rows, text, "_e")
    asked = _last(F.regexp_extract_all(F.col(text), F.lit(rf"(?i){SELECTED_NAME}\s*:\s*([0-9]+)"), F.lit(1)))
    e = e.withColumn("position", asked.try_cast("int"))
    e = e.withColumn("_c", F.get(F.filter(candidates, lambda c: c["position"] == F.col("position")), F.lit(0)))
    selected, stated = F.col("_c.answer"), F.col("_e.answer")
    return (
        e.withColumn("origin", F.col("_c.origin"))
        .withColumn("selected", selected)
        .withColumn("stated", stated)
        .withColumn("resolved", F.coalesce(selected, stated))
        .withColumn("resolution", F.when(selected.isNotNull(), "selected_candidate_answer").when(stated.isNotNull(), "selector_final_answer_fallback").otherwise("none"))
        .withColumn("valid", F.col("_c").isNotNull())
        .withColumn("mismatch", F.coalesce(selected != stated, F.lit(False)))
        .drop("_c", "_e")
    )
