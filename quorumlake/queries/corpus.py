"""Text, predicates, extraction, deduplication and similarity over documents and derived texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import text as X
from quorumlake.functions.extraction import extract_answers, extract_baseline, last_stated, normalise_trace, resolve_selection
from quorumlake.operators.selection import winner
from quorumlake.operators.similarity import contamination_cascade, similarity_join
from quorumlake.queries.registry import POOL, Tables, query

#: Texts to extract from: nine forms of an answer, by line item.
_RAW = """CASE l_partkey % 9 WHEN 0 THEN 'work ' || l_linenumber || chr(10) || 'FINAL_ANSWER: ' || (l_suppkey % 50)
 WHEN 1 THEN 'so \\boxed{' || (l_suppkey % 50) || '} follows' WHEN 2 THEN 'steps' || chr(10) || (l_suppkey % 50)
 WHEN 3 THEN 'we get ' || (l_suppkey % 50) || ' apples in all.' WHEN 4 THEN 'FINAL_ANSWER: 3' || chr(10) || '\\boxed{' || (l_suppkey % 50) || '}'
 WHEN 5 THEN 'FINAL_ANSWER: 3.5 or so' WHEN 6 THEN 'no number here' WHEN 7 THEN 'FINAL_ANSWER: 1,' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') || '.00' ELSE 'about 2.75 or 7/8' END"""
_RAW_SPARK = _RAW.replace("chr(10)", "'\\n'").replace("VARCHAR", "STRING").replace("\\boxed", "\\\\boxed")
_S = "CAST(l_suppkey % 50 AS VARCHAR)"


def _raw(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_RAW_SPARK).alias("raw"))


@query(f"""WITH x AS (SELECT l_partkey % 9 AS k, l_suppkey, {_S} AS s FROM lineitem), y AS (SELECT k,
 CASE k WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN s WHEN 4 THEN CASE WHEN s = '3' THEN '3' END WHEN 7 THEN '1' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') END AS answer,
 CASE WHEN k = 0 OR k = 7 OR (k = 4 AND s = '3') THEN 'final_answer_marker' WHEN k = 1 THEN 'boxed' WHEN k = 2 THEN 'standalone_last_line' WHEN k = 3 THEN 'last_integer' ELSE 'none' END AS path,
 CASE WHEN k = 4 AND s <> '3' THEN 'conflicting_explicit_answers' WHEN k IN (5, 8) THEN 'non_integer_only' WHEN k = 6 THEN 'no_supported_answer_marker' END AS failure_reason FROM x)
 SELECT answer, path, failure_reason, count(*) AS n FROM y GROUP BY 1, 2, 3""")
def f1_extract_answer(t: Tables) -> DataFrame:
    return extract_answers(_raw(t), "raw").groupBy("extraction.answer", "extraction.path", "extraction.failure_reason").agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT l_partkey % 9 AS k, {_S} AS s FROM lineitem) SELECT CASE WHEN k = 4 AND s <> '3' THEN 'conflict' WHEN k IN (5, 8) THEN 'non_integer' WHEN k = 6 THEN 'missing' WHEN k IN (2, 3) THEN 'body_only' ELSE 'same' END AS category, count(*) AS n FROM x GROUP BY 1""")
def p15_extraction_changes(t: Tables) -> DataFrame:
    """The explicit-only policy beside the full one: what the body fallback adds and what both refuse."""
    e = extract_answers(_raw(t), "raw").select("extraction.*")
    kind = F.when(F.col("failure_reason") == "conflicting_explicit_answers", "conflict").when(F.col("failure_reason") == "non_integer_only", "non_integer").when(F.col("failure_reason").isNotNull(), "missing").when(F.col("path").isin("standalone_last_line", "last_integer"), "body_only").otherwise("same")
    return e.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH x AS (SELECT {_RAW} AS raw FROM lineitem) SELECT regexp_matches(raw, 'FINAL_ANSWER') AS marker, contains(raw, 'boxed') AS boxed, regexp_matches(raw, '[0-9]') AS digits, length(raw) - length(replace(raw, chr(10), '')) AS newlines, count(*) AS n FROM x GROUP BY 1, 2, 3, 4")
def p14_format_observations(t: Tables) -> DataFrame:
    raw = F.col("raw")
    return _raw(t).groupBy(raw.rlike("FINAL_ANSWER").alias("marker"), raw.rlike(r"\\boxed").alias("boxed"), raw.rlike("[0-9]").alias("digits"), F.regexp_count(raw, F.lit("\n")).cast("long").alias("newlines")).agg(F.count("*").alias("n"))


@query(f"WITH x AS (SELECT {_RAW} AS raw, l_partkey % 9 AS k, {_S} AS s FROM lineitem) SELECT DISTINCT raw, CASE WHEN k = 0 THEN 'FINAL_ANSWER: ' || s WHEN k = 2 THEN s WHEN k = 4 THEN '\\boxed{{' || s || '}}' ELSE raw END AS last_line, k IN (0, 5, 7) AS marker_last FROM x")
def f24_last_line(t: Tables) -> DataFrame:
    line = X.last_nonempty_line(F.col("raw"))
    return _raw(t).select("raw", line.alias("last_line"), line.rlike(r"(?i)^\s*(?:\*\*)?\s*FINAL_ANSWER\s*:").alias("marker_last")).distinct()


_FORMS = ("+7", "1,234", "-0", "007", "12 ", "3.5", "abc", "-15", "１２", "－3")
_FORMS_SQL = ", ".join(f"({i}, '{v}')" for i, v in enumerate(_FORMS))


@query("SELECT * FROM (VALUES (0, '7'), (1, '1234'), (2, '0'), (3, NULL), (4, '12'), (5, NULL), (6, NULL), (7, '-15'), (8, '12'), (9, '-3')) v(i, value)")
def f3_f4_normalise_integer(t: Tables) -> DataFrame:
    from quorumlake.functions.extraction import normalise_integer

    return t.spark.sql(f"SELECT * FROM VALUES {_FORMS_SQL} AS v(i, raw)").select("i", normalise_integer(F.col("raw")).alias("value"))


@query("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed FROM documents")
def f10_collapse_whitespace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.lower(X.collapse(F.col("text"))).alias("collapsed"))


_TEMPLATE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9][0-9,]*', ' <num> ', 'g'), '[^a-z<>]+', ' ', 'g'), ' +', ' ', 'g'))"


def _template(text):
    """The plain variant, without sign, decimal and look-around, that SQL can also say."""
    numbers = F.regexp_replace(F.lower(text), "[0-9][0-9,]*", " <num> ")
    return F.trim(F.regexp_replace(F.regexp_replace(numbers, "[^a-z<>]+", " "), " +", " "))


@query(f"SELECT doc_id, {_TEMPLATE} AS template FROM documents")
def f12_template(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", _template(F.col("text")).alias("template"))


@query()
def f11_placeholder_template(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.placeholder_template(F.col("text"), ["the", "a", "an", "and", "if", "find", "how", "what"]).alias("template"))


@query()
def f12_number_template(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.template(F.col("text")).alias("template"))


@query()
def f13_f14_normal_form(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normal_form()(F.col("text")).alias("folded"))


_WORDS = f"w AS (SELECT doc_id, regexp_extract_all({_TEMPLATE}, '[a-z]+|<num>') AS words FROM documents)"


@query(f"WITH {_WORDS}, s AS (SELECT doc_id, len(words) AS n, CASE WHEN len(words) = 0 THEN 0 WHEN len(words) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) END AS shingles, len(list_distinct(words)) AS tokens FROM w) SELECT doc_id, n, shingles, tokens FROM s")
def f15_f16_shingles_and_tokens(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", F.regexp_extract_all(_template(F.col("text")), F.lit("[a-z]+|<num>"), F.lit(0)).alias("words"))
    return w.select("doc_id", F.size("words").cast("long").alias("n"), F.size(X.shingles(F.col("words"))).cast("long").alias("shingles"), F.size(F.array_distinct("words")).cast("long").alias("tokens"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '-?[0-9][0-9,]*'), lambda x: replace(x, ',', '')), ',') AS signature FROM documents")
def f17_numeric_signature(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.numeric_signature(F.col("text")).alias("signature"))


@query("SELECT doc_id, length(text) - length(replace(text, '$', '')) AS dollars, length(text) - length(replace(text, chr(10), '')) AS newlines FROM documents")
def f18_signal_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *((F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit(c)))).cast("long").alias(n) for c, n in (("$", "dollars"), ("\n", "newlines"))))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 50) || ' … ' || right(text, 30) END AS excerpt FROM documents")
def f19_head_tail(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.head_tail(F.col("text"), 50, 30).alias("excerpt"))


@query("SELECT item_id, replace('Question: {question}' || chr(10) || 'Answer:', '{question}', text) AS prompt FROM benchmark")
def f20_prompt_rendering(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.replace(F.lit("Question: {question}\nAnswer:"), F.lit("{question}"), F.col("text")).alias("prompt"))


@query("SELECT item_id, regexp_replace(text, '[.]?\\s*$', '') || chr(10) || 'FINAL_ANSWER: ' || (item_id % 7) AS target FROM benchmark")
def f21_f22_targets(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.concat(F.regexp_replace("text", r"[.]?\s*$", ""), F.lit("\nFINAL_ANSWER: "), (F.col("item_id") % 7).cast("string")).alias("target"))


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS k, {_S} AS s, '1' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') AS long FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN k IN (0, 1, 2) THEN s WHEN k = 4 AND s = '3' THEN '3' WHEN k = 7 THEN long || '' END AS answer,
 CASE WHEN k IN (0, 7) OR (k = 4 AND s = '3') THEN 'final_answer_marker' WHEN k = 1 THEN 'boxed' WHEN k = 2 THEN 'standalone_last_line' ELSE 'none' END AS path,
 CASE WHEN k = 4 AND s <> '3' THEN 'conflicting_explicit_answers' WHEN k IN (3, 4, 5, 6, 8) AND NOT (k = 4 AND s = '3') THEN 'no_supported_answer_marker' END AS failure_reason FROM x""")
def f2_baseline_extractor(t: Tables) -> DataFrame:
    return extract_baseline(_raw(t), "raw").select("l_orderkey", "l_linenumber", "baseline.answer", "baseline.path", "baseline.failure_reason")


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS k, {_S} AS s, '1' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') AS long FROM lineitem) SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN s WHEN 1 THEN s WHEN 4 THEN '3,' || s WHEN 5 THEN '3' WHEN 7 THEN long ELSE '' END AS stated FROM x")
def f9_last_stated(t: Tables) -> DataFrame:
    return _raw(t).select("l_orderkey", "l_linenumber", F.array_join(last_stated(F.col("raw")), ",").alias("stated"))


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS k, {_S} AS s, '1' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') AS long, {_RAW} AS raw FROM lineitem),
 y AS (SELECT *, CASE WHEN k = 0 THEN 'already_canonical_final_line' WHEN k IN (1, 2, 7) OR (k = 4 AND s = '3') THEN 'appended_final_answer' WHEN k = 4 THEN 'conflicting_explicit_answers' ELSE 'no_safe_integer_candidate' END AS status, CASE WHEN k = 7 THEN long WHEN k IN (0, 1, 2) OR (k = 4 AND s = '3') THEN s END AS candidate FROM x)
 SELECT l_orderkey, l_linenumber, status, candidate, CASE WHEN status = 'appended_final_answer' THEN raw || chr(10) || 'FINAL_ANSWER: ' || candidate || chr(10) ELSE raw END AS trace FROM y""")
def f22_trace_normaliser(t: Tables) -> DataFrame:
    return normalise_trace(_raw(t), "raw").select("l_orderkey", "l_linenumber", "status", "candidate", "trace")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS p, l_suppkey % 50 AS a FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN p > 0 THEN p END AS position, CASE WHEN p IN (1, 2, 3) THEN 10 * p END AS origin, CASE WHEN p IN (1, 2, 3) THEN CAST(a + p - 1 AS VARCHAR) ELSE CAST(a AS VARCHAR) END AS resolved,
 CASE WHEN p IN (1, 2, 3) THEN 'selected_candidate_answer' ELSE 'selector_final_answer_fallback' END AS resolution, p IN (1, 2, 3) AS valid, p IN (2, 3) AS mismatch FROM x""")
def f23_selector_output(t: Tables) -> DataFrame:
    """The last selected number looked up among three candidates; the fourth isn't there, and none is asked for at 0."""
    x = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("p"), (F.col("l_suppkey") % 50).alias("a"))
    asked = F.when(F.col("p") > 0, F.format_string("SELECTED_CANDIDATE: 9\nthen selected_candidate : %d\n", "p")).otherwise("none fits\n")
    listed = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(10 * i).alias("origin"), (F.col("a") + i - 1).cast("string").alias("answer")) for i in (1, 2, 3)))
    x = x.select("l_orderkey", "l_linenumber", F.concat(asked, F.lit("FINAL_ANSWER: "), F.col("a").cast("string")).alias("text"), listed.alias("listed"))
    return resolve_selection(x, "text", "listed").select("l_orderkey", "l_linenumber", "position", "origin", "resolved", "resolution", "valid", "mismatch")


@query("SELECT doc_id, CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, '@') THEN 'mail' WHEN contains(text, '!!') THEN 'shout' ELSE 'prose' END AS coarse, len(regexp_split_to_array(trim(text), '\\s+')) AS words FROM documents")
def f25_f26_coarse_path_and_words(t: Tables) -> DataFrame:
    has = lambda s: F.contains("text", F.lit(s))
    return t.documents.select("doc_id", F.when(has("|"), "table").when(has("@"), "mail").when(has("!!"), "shout").otherwise("prose").alias("coarse"), F.size(F.split(F.regexp_replace("text", r"^ +| +$", ""), r"\s+")).cast("long").alias("words"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), 'ns', 42, doc_id)) AS h FROM documents")
def hash_stable(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.stable_hash(F.lit("ns"), F.lit(42), F.col("doc_id")).alias("h"))


@query("SELECT doc_id, list_reduce(list_prepend(0, list_transform(string_split(sha256('fold' || doc_id), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, d: (a * 16 + d) % 7) AS fold FROM documents")
def w16_hash_folds(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.hash_fold(F.concat(F.lit("fold"), F.col("doc_id").cast("string")), 7).cast("long").alias("fold"))


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN n_chars > 12000 THEN 'too_long' WHEN regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN 'control_character' WHEN regexp_matches(lower(text), 'https?://|www[.]') THEN 'visual_dependency'
 WHEN regexp_matches(lower(text), '\\b(python|import|def)\\b') THEN 'code' WHEN len(regexp_split_to_array(trim(text), '\\s+')) < 20 THEN 'too_short' WHEN regexp_matches(text, '([.][.][.]|[,;:=+*/])$') THEN 'truncated' END AS reason FROM documents""")
def p4_quality_cascade(t: Tables) -> DataFrame:
    text, low = F.col("text"), F.lower("text")
    rules = (
        (F.trim(text) == "", "empty"),
        (F.col("n_chars") > 12000, "too_long"),
        (text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "control_character"),
        (low.rlike(r"https?://|www[.]"), "visual_dependency"),
        (low.rlike(r"\b(python|import|def)\b"), "code"),
        (F.size(F.split(F.trim(text), r"\s+")) < 20, "too_short"),
        (text.rlike(r"([.][.][.]|[,;:=+*/])$"), "truncated"),
    )
    return t.documents.select("doc_id", F.coalesce(*(F.when(c, r) for c, r in rules)).alias("reason"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN contains(text, '###') THEN 'marks' END], lambda x: x IS NOT NULL), ',') AS failures FROM documents")
def p5_quality_failures(t: Tables) -> DataFrame:
    has = lambda s: F.contains("text", F.lit(s))
    rules = ((F.col("n_chars") < 200, "short"), (F.col("n_chars") > 5000, "long"), (has("!!"), "shouting"), (has(" | "), "table"), (has("###"), "marks"))
    return t.documents.select("doc_id", F.array_join(F.array_compact(F.array(*(F.when(c, r) for c, r in rules))), ",").alias("failures"))


@query("SELECT doc_id, regexp_matches(lower(text), 'https?://|www[.]|[.](png|jpg|gif)') AS visual, regexp_matches(lower(text), '(licensed|license|copyright)') AS legal FROM documents")
def p6_dependency_predicates(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", low.rlike(r"https?://|www[.]|[.](png|jpg|gif)").alias("visual"), low.rlike("(licensed|license|copyright)").alias("legal"))


@query("SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'copyright') AS legal, contains(lower(text), 'password') OR contains(lower(text), 'token') AS secret FROM documents")
def p7_keyword_flags(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.contains_any(F.col("text"), ["license", "copyright"]).alias("legal"), X.contains_any(F.col("text"), ["password", "token"]).alias("secret"))


_QUESTIONS = "SELECT p_partkey, ['a triangle with ', 'the prime number ', 'choose cards ', 'the equation of ', 'apples and '][CAST(p_partkey % 5 AS INT) + 1] || p_name AS q FROM part"


@query(f"WITH q AS ({_QUESTIONS}) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'geometry' WHEN 1 THEN 'number_theory' WHEN 2 THEN 'combinatorics_probability' WHEN 3 THEN 'algebra' ELSE 'arithmetic_word_problem' END AS kind FROM q")
def p8_problem_type(t: Tables) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("a triangle with ", "the prime number ", "choose cards ", "the equation of ", "apples and "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", X.problem_type(F.concat(lead, "p_name")).alias("kind"))


@query("SELECT doc_id, CASE WHEN n_chars <= 500 THEN 'chars_1_500' WHEN n_chars <= 2000 THEN 'chars_501_2000' WHEN n_chars <= 8000 THEN 'chars_2001_8000' ELSE 'chars_8001_plus' END AS bucket FROM documents")
def p9_bounded_buckets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.bounded_bucket(F.col("n_chars"), [500, 2000, 8000], "chars_").alias("bucket"))


_ANSWERS = "SELECT s_suppkey, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS a FROM supplier"


@query(f"WITH a AS ({_ANSWERS}) SELECT s_suppkey, CASE WHEN a[1] = '-' THEN 'negative' WHEN a = '0' THEN 'zero' ELSE 'positive' END AS sign, length(replace(a, '-', '')) AS digits FROM a")
def p10_sign_and_digits(t: Tables) -> DataFrame:
    a = F.floor("s_acctbal").cast("long").cast("string")
    return t.supplier.select("s_suppkey", X.answer_sign(a).alias("sign"), X.digit_count(a).cast("long").alias("digits"))


@query("SELECT doc_id, n_chars > 4000 OR contains(text, '|') AS hard, concat_ws('|', lang, CASE WHEN n_chars <= 1000 THEN 's' ELSE 'l' END) AS stratum FROM documents")
def p11_composite_predicates(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ((F.col("n_chars") > 4000) | F.contains("text", F.lit("|"))).alias("hard"), F.concat_ws("|", "lang", F.when(F.col("n_chars") <= 1000, "s").otherwise("l")).alias("stratum"))


@query(f"WITH {POOL}, c AS (SELECT id, count(*) FILTER (WHERE answer = gold) AS c FROM pool JOIN gold USING (id) GROUP BY id) SELECT id, c, CASE WHEN c = 0 THEN 0 WHEN c = 1 THEN 1 WHEN c <= 3 THEN 2 ELSE 3 END AS cap FROM c")
def p12_case_caps(t: Tables) -> DataFrame:
    c = t.pool.join(t.gold.select("id", "gold"), "id").groupBy("id").agg(F.count_if(F.col("answer") == F.col("gold")).alias("c"))
    return c.withColumn("cap", F.when(F.col("c") == 0, 0).when(F.col("c") == 1, 1).when(F.col("c") <= 3, 2).otherwise(3))


@query(f"WITH {POOL} SELECT id, sample_index FROM pool WHERE NOT hit_max AND answer IS NOT NULL AND path IN ('final_answer_marker', 'boxed')")
def p13_completed_only(t: Tables) -> DataFrame:
    return t.pool.where(~F.col("hit_max") & F.col("answer").isNotNull() & F.col("path").isin("final_answer_marker", "boxed")).select("id", "sample_index")


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def w5_j7_exact_text_winner(t: Tables) -> DataFrame:
    copies = t.documents.groupBy("text").agg(F.count("*").alias("copies"))
    return winner(t.documents.select("text", "doc_id"), ["text"], F.col("doc_id")).join(copies, "text")


@query(f"WITH n AS (SELECT doc_id, {_TEMPLATE} AS template FROM documents), f AS (SELECT template, min(doc_id) AS first_id FROM n WHERE template <> '' GROUP BY 1) SELECT n.doc_id, f.first_id FROM n LEFT JOIN f USING (template)")
def j8_template_first(t: Tables) -> DataFrame:
    n = t.documents.select("doc_id", _template(F.col("text")).alias("template"))
    first = n.where("template != ''").groupBy("template").agg(F.min("doc_id").alias("first_id"))
    return n.join(first, "template", "left").select("doc_id", "first_id")


def _sets_sql(table: str, key: str, prefix: str = "") -> str:
    """Words w, shingle sets s and their items e of a table, under names with the prefix."""
    words = _WORDS.replace("w AS", f"{prefix}w AS", 1).replace("doc_id", key).replace("documents", table)
    return f"""{words}, {prefix}s AS (SELECT {key}, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS items FROM {prefix}w),
 {prefix}e AS (SELECT {key}, len(items) AS n, unnest(items) AS item FROM {prefix}s)"""


_SETS, _BENCHMARK_SETS = _sets_sql("documents", "doc_id"), _sets_sql("benchmark", "item_id", "b")
_AGAINST = f"{_SETS}, {_BENCHMARK_SETS}, o AS (SELECT a.doc_id AS l, b.item_id AS r, any_value(a.n) AS ln, any_value(b.n) AS rn, count(*) AS overlap FROM e a JOIN be b ON a.item = b.item GROUP BY 1, 2), nr AS (SELECT l, first(r ORDER BY overlap / (ln + rn - overlap) DESC, r) AS near FROM o WHERE overlap / (ln + rn - overlap) >= 0.8 GROUP BY l), n AS (SELECT doc_id, text, n_chars, {_TEMPLATE} AS template FROM documents), p AS (SELECT item_id, text, {_TEMPLATE} AS template FROM benchmark), ex AS (SELECT text, min(item_id) AS x FROM p GROUP BY 1), te AS (SELECT template, min(item_id) AS y FROM p WHERE template <> '' GROUP BY 1), c AS (SELECT n.doc_id, n_chars, n.text, CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'template' WHEN near IS NOT NULL THEN 'near' ELSE 'none' END AS kind, coalesce(x, y, near) AS match FROM n LEFT JOIN ex USING (text) LEFT JOIN te USING (template) LEFT JOIN nr ON nr.l = n.doc_id)"


def _sets(t: Tables) -> DataFrame:
    """Words are a column of their own, so that a shingle reads them and doesn't find them anew."""
    rows = t.documents.select(F.col("doc_id").alias("key"), "text", _template(F.col("text")).alias("template"))
    return rows.withColumn("words", F.regexp_extract_all("template", F.lit("[a-z]+|<num>"), F.lit(0))).withColumn("items", X.shingles(F.col("words")))


def _benchmark_sets(t: Tables) -> DataFrame:
    rows = t.benchmark.select(F.col("item_id").alias("key"), "text", _template(F.col("text")).alias("template"))
    return rows.withColumn("words", F.regexp_extract_all("template", F.lit("[a-z]+|<num>"), F.lit(0))).withColumn("items", X.shingles(F.col("words")))


@query(f"WITH {_SETS} SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS overlap, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 9) AS jaccard FROM e a JOIN e b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8")
def j9_set_similarity_join(t: Tables) -> DataFrame:
    """All pairs of documents, each once."""
    s = _sets(t)
    return similarity_join(s, s, 0.8, once=True).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {_WORDS}, d AS (SELECT doc_id, list_distinct(words) AS items FROM w), e AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM d) SELECT DISTINCT l AS doc_id FROM (SELECT a.doc_id AS l FROM e a JOIN e b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.9)")
def j10_near_duplicate_ids(t: Tables) -> DataFrame:
    """Every document that has a near-duplicate among all others."""
    s = _sets(t).withColumn("items", F.array_distinct("words"))
    return similarity_join(s, s, 0.9, once=True).select(F.explode(F.array("l", "r")).alias("doc_id")).distinct()


@query(f"WITH {_AGAINST} SELECT doc_id, kind, match FROM c")
def j11_contamination_cascade(t: Tables) -> DataFrame:
    """Every document against the whole benchmark as the protected side."""
    return contamination_cascade(_sets(t), _benchmark_sets(t), 0.8).withColumnRenamed("key", "doc_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j4_anti_join(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, l.toxic IS NOT DISTINCT FROM 1 AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j6_audit_flags(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic", F.lit(True).alias("hit")), "doc_id", "left").select("doc_id", F.col("hit").isNotNull().alias("labelled"), F.col("toxic").eqNullSafe(1).alias("toxic"))


@query("SELECT doc_id, len(list_filter(range(1, len(string_split(text, chr(10)))), lambda i: string_split(text, chr(10))[i] = string_split(text, chr(10))[i + 1] AND string_split(text, chr(10))[i] <> '')) AS repeats FROM documents WHERE contains(text, chr(10))")
def w11_repeated_lines(t: Tables) -> DataFrame:
    d = t.documents.where(F.contains("text", F.lit("\n"))).select("doc_id", F.split("text", "\n").alias("lines"))
    pairs = F.arrays_zip(F.slice("lines", F.lit(1), F.size("lines") - 1).alias("a"), F.slice("lines", F.lit(2), F.size("lines")).alias("b"))
    return d.select("doc_id", F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != ""))).cast("long").alias("repeats"))
