"""Secret scans with corpus-wide ownership: how many repositories and owners share each candidate tells examples from live keys."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import slices, small_batches, tidied, written

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # what is left of the runs [0-9a-f]+ when those under 24 drop
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A value with as many distinct owners is a widely copied example.
COPIED_OWNERS = 3
#: Bits per character from which a value can be a generated one.
LIVE_BITS = 3.0

_CANDIDATE = "kind int, start int, stop int, hash string, live boolean"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find_candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in code points: the three base kinds, then opaque strings apart from all of these."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in out)
    for m in OPAQUE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and value.upper() != value.lower() and value not in (value.upper(), value.lower()) and not any(s < m.end() and m.start() < e for s, e in base):
            out.append((3, m.start(), m.end(), value))
    return out


def _scan(batches):
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())])
    for batch in (piece for whole in batches for piece in slices(whole, whole.num_columns - 1)):
        rows = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            rows.append([{"kind": k, "start": s, "stop": e, "hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "live": entropy(v) >= LIVE_BITS} for k, s, e, v in find_candidates(text or "")])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(kind))], names=[*batch.schema.names[:-1], "found"])


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_cols: tuple[str, ...] = ("source",), copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Base spans (assign, access, hex) always stay. Each candidate's hash is counted over the whole corpus by distinct
    repositories and owners: with copied_owners or more it is a widely copied example (n_copied), with one owner and the
    entropy of a generated value it is live-looking (n_live). Opaque strings without a tell-tale name become spans only
    when live-looking. Only hashes leave the scan, never the values.

    Null and empty texts have no spans. A null repository or owner is one of its own. Repeated rows are scanned each and
    count once as owners. A text's candidates are one array; the corpus counts are pre-aggregated, so a value in a third
    of all rows is a row a task. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    name = lambda cols: F.to_json(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(cols))))
    rows = docs.select(F.col(id_col).alias("doc_id"), name(repo_cols).alias("repo"), name(owner_cols).alias("owner"), F.col(text_col).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    scanned = written(rows.mapInArrow(tidied(_scan), f"doc_id {id_type}, repo string, owner string, found array<struct<{_CANDIDATE.replace(' ', ':').replace(',:', ',')}>>").withColumn("_row", F.monotonically_increasing_id()))
    each = scanned.where(F.size("found") > 0).select("_row", "repo", "owner", F.inline("found"))
    owners = each.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    judged = each.join(owners, "hash").withColumn("alive", F.expr("live and owners = 1"))
    per_row = judged.groupBy("_row").agg(
        F.collect_list(F.when(F.expr("kind = 3 and alive"), F.struct("start", "kind", "stop"))).alias("added"),
        F.count_if(F.expr("alive")).alias("n_live"),
        F.count_if(F.col("owners") >= copied_owners).alias("n_copied"),
    )
    spans = lambda test: F.transform(F.filter("found", test), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop")))
    out = scanned.join(per_row, "_row", "left").withColumn("_base", F.array_sort(spans(lambda c: c["kind"] < 3)))
    out = out.withColumn("_all", F.when(F.col("added").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", "added"))))
    count = lambda k: F.size(F.filter("found", lambda c: c["kind"] == k)).cast("long")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_all")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_copied", zero).alias("n_copied"),
    )
