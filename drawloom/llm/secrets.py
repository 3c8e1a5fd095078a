"""Secret scan with corpus-wide ownership frequency.

Patterns give candidates; the hash of each candidate's value is counted over the
whole corpus by distinct owners, repositories and texts.  A value that several owners
or repositories or very many texts hold is a widely copied example; one that a single
one holds looks live.
High-entropy tokens outside the base patterns become spans only if they are
owner-specific.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, texts_of

# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 characters or more
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key")
#: Kinds in the order of ties.
KINDS = ("assign", "access", "hex", "token")
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits per character from which a bare token is a candidate.
MIN_ENTROPY = 3.5

SPAN = "struct<start:int,end:int,kind:string,h:binary>"


def base_candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, leftmost and non-overlapping within a kind."""
    out = []
    if ASSIGN_HINT.search(text.lower()):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def bare_candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Tokens of 20 characters or more with letters, digits and high entropy, outside the base spans."""
    covered: list[list[int]] = []  # disjoint runs of the base spans, which come by start
    for start, end, _, _ in base:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out, at = [], 0
    for m in BARE.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at < len(covered) and covered[at][0] < m.end():
            continue
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= MIN_ENTROPY:
            out.append((m.start(), m.end(), "token", v))
    return out


def listed(spans: list[tuple[int, int, str, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts_of(batch, "_text"):
            base = base_candidates(text)
            spans = base + bare_candidates(text, base)
            kinds = Counter(x[2] for x in base)
            rows.append({
                "_key": hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "n_assign": kinds["assign"], "n_access": kinds["access"], "n_hex": kinds["hex"],
                "base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(),
                "_found": [{"start": a, "end": b, "kind": k, "h": hashlib.blake2b(v.encode(), digest_size=16).digest()} for a, b, k, v in spans],
            })
        found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("h", pa.binary())]))
        schema = pa.schema([("_key", pa.binary()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("_found", found)])
        made = pa.RecordBatch.from_pylist(rows, schema)
        kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "_text"]
        yield pa.record_batch([c for _, c in kept] + made.columns, names=[n for n, _ in kept] + made.schema.names)


def ownership(found: DataFrame) -> DataFrame:
    """_h, n_owners, n_repos, n_seen (different texts) of each candidate value over the whole corpus.

    Takes rows (_h, _owner, _repo, _key).  Copies meet in two steps, first by value,
    owner and repository (or text), so a value that a third of all rows hold is one row
    per pair when it is counted.
    """
    pairs = found.select("_h", "_owner", "_repo").distinct()
    owners = pairs.groupBy("_h", "_owner").agg(F.count(F.lit(1)).alias("_repos")).groupBy("_h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("_repos").alias("n_repos"))
    seen = found.select("_h", "_key").distinct().groupBy("_h").agg(F.count(F.lit(1)).alias("n_seen"))
    return owners.join(seen.hint("merge"), "_h")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: str | Column = "source", repo: str | Column = "source", max_live_owners: int = 1, max_live_repos: int = 1, max_live_texts: int = 100) -> DataFrame:
    """Secrets of every document, one row per input row.

    Columns: the id, n_assign, n_access, n_hex (long), base_sha256, spans (string, all
    spans as kind:start:end by start, then kind), n_live and n_copied (long, spans
    whose value has at most ``max_live_owners`` owners, ``max_live_repos`` repositories
    and ``max_live_texts`` different texts, or more of one of these), max_owners,
    max_repos and max_texts (long, most owners, repositories and different texts of one
    of its values).  A repository is told apart within its owner.  Null and empty texts have no spans; a
    null owner or repository is one of its own; documents that repeat each get a row,
    and their owners count once.  An empty table gives no rows.
    """
    owner, repo = (F.col(x) if isinstance(x, str) else x for x in (owner, repo))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(owner.cast("string"), F.lit("\0")).alias("_owner"), F.coalesce(repo.cast("string"), F.lit("\0")).alias("_repo"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    scanned = materialize(arrow_map(rows, scan_batches, f"_id {kind}, _owner string, _repo string, _key binary, n_assign long, n_access long, n_hex long, base_sha256 string, _found array<{SPAN}>"), "secrets")
    held = scanned.filter(F.size("_found") > 0)
    each = held.select("_owner", "_repo", "_key", F.explode("_found").alias("_f")).withColumn("_h", F.col("_f.h"))
    # A written table, so that a value in very many texts is a skewed join that AQE can split.
    counted = materialize(ownership(each.select("_h", "_owner", "_repo", "_key")), "secret-owners")
    # One verdict list for each different text: its spans are the same wherever it stands.
    texts = each.groupBy("_key", "_f", "_h").agg(F.count(F.lit(1)).alias("_n")).select("_key", "_f", "_h")
    judged = texts.join(counted.hint("merge"), "_h").groupBy("_key").agg(F.collect_list(F.struct(F.col("_f.start").alias("start"), F.expr("array_position(array('assign','access','hex','token'), _f.kind)").alias("k"), F.col("_f.end").alias("end"), F.col("_f.kind").alias("kind"), F.col("n_owners").alias("owners"), F.col("n_repos").alias("repos"), F.col("n_seen").alias("texts"))).alias("_all"))
    live = lambda x: (x["owners"] <= max_live_owners) & (x["repos"] <= max_live_repos) & (x["texts"] <= max_live_texts)
    most = lambda c: F.coalesce(F.array_max(F.transform("_all", lambda x: x[c])), F.lit(0)).cast("long").alias(f"max_{c}")
    judged = judged.withColumn("_all", F.array_sort(F.filter("_all", lambda x: (x["kind"] != "token") | live(x))))
    judged = judged.select(
        "_key", F.array_join(F.transform("_all", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("spans"), F.size(F.filter("_all", live)).cast("long").alias("n_live"),
        F.size(F.filter("_all", lambda x: ~live(x))).cast("long").alias("n_copied"), most("owners"), most("repos"), most("texts"),
    )
    head = [F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256"]
    zero = F.lit(0).cast("long")
    with_spans = held.drop("_found").join(judged, "_key").select(*head, "spans", "n_live", "n_copied", "max_owners", "max_repos", "max_texts")
    without = scanned.filter(F.size("_found") == 0).select(*head, F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_copied"), zero.alias("max_owners"), zero.alias("max_repos"), zero.alias("max_texts"))
    return with_spans.unionByName(without)
