"""Secret scans with corpus-wide ownership frequency.

Candidates come from built-in regular expressions, run only on texts that hold
one of their cheap literal marks.  The hash of each candidate is then counted
over the whole corpus: in how many repositories and for how many owners it
occurs.  A candidate of many owners is a widely copied example; one of few
owners that looks random is reported as live.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: (kind, literal marks in lower case, expression, group)
PATTERNS: tuple[tuple[str, tuple[str, ...], str, int], ...] = (
    ("aws_key", ("akia", "asia"), r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", 1),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"\b(gh[pousr]_[0-9A-Za-z]{36})\b", 1),
    ("slack_token", ("xox",), r"\b(xox[abprs]-[0-9A-Za-z-]{10,})", 1),
    ("stripe_key", ("k_live_",), r"\b([rs]k_live_[0-9A-Za-z]{16,})\b", 1),
    ("google_key", ("aiza",), r"\b(AIza[0-9A-Za-z_-]{35})", 1),
    ("jwt", ("eyj",), r"\b(eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})", 1),
    ("private_key", ("private key-----",), r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/=\s]{16,}-----END)", 1),
    ("assignment", ("token", "secret", "passw", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey"), r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']([0-9A-Za-z+/=_.:~-]{8,})[\"']", 1),
)
#: Owners from which on a candidate counts as a copied example.
MIN_OWNERS = 3
#: Distinct characters that a live-looking secret has at least.
MIN_DISTINCT = 8
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your[_-]|xxxx|0123456789|abcdefgh"
MASK = "[REDACTED]"


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("secret"))


def candidates(text: Column, low: Column) -> Column:
    """Array of (kind, secret), sorted and without repeats; empty for null text.

    ``low`` is the text in lower case, made in an inner projection so that it is
    made once.
    """
    none = F.array().cast("array<string>")
    found = []
    for kind, marks, pattern, group in PATTERNS:
        marked = F.lit(False)
        for m in marks:
            marked = marked | F.contains(low, F.lit(m))
        all_ = F.when(marked, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)
        found.append(F.transform(all_, _named(kind)))
    return F.when(text.isNull(), F.array().cast("array<struct<kind:string,secret:string>>")).otherwise(F.array_sort(F.array_distinct(F.concat(*found))))


def hashed(found: Column) -> Column:
    """Candidates as (kind, hash, poor): what leaves the first projection instead of them."""
    poor = lambda s: s.rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split(s, ""))) < MIN_DISTINCT)
    return F.transform(found, lambda c: F.struct(c["kind"].alias("kind"), F.sha2(c["secret"], 256).alias("hash"), poor(c["secret"]).alias("poor")))


def _distinct(name: str) -> Column:
    """Number of distinct values; null is one of its own."""
    return F.count_distinct(name) + F.max(F.col(name).isNull().cast("int"))


def _owned(found: DataFrame, min_owners: int) -> DataFrame:
    """(hash, n_repos, n_owners, verdict) from (hash, poor, repo, owner)."""
    counts = found.groupBy("hash").agg(_distinct("repo").alias("n_repos"), _distinct("owner").alias("n_owners"), F.first("poor").alias("poor"))
    verdict = F.when(F.col("n_owners") >= min_owners, "copied_example").when(F.col("poor"), "placeholder").otherwise("live")
    return counts.select("hash", "n_repos", "n_owners", verdict.alias("verdict"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", min_owners: int = MIN_OWNERS) -> DataFrame:
    """(doc_id, kind, secret_hash, n_repos, n_owners, verdict): every candidate of each row.

    ``verdict`` is ``copied_example`` (``min_owners`` owners or more),
    ``placeholder`` or ``live``.  A candidate is hashed where it is found; only
    hashes are counted, stored and returned.  Null and empty texts give nothing;
    a null repository or owner counts as one of its own, apart from an empty one;
    a repeated row repeats its candidates but adds no repository.  A row names a
    candidate once for each kind, however often it holds it.
    """
    each = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"), F.lower(F.col(text)).alias("low"))
    each = each.select("doc_id", "repo", "owner", F.explode(hashed(candidates(F.col("text"), F.col("low")))).alias("c"))
    each = written(each.select("doc_id", "repo", "owner", "c.*"), "candidates")
    met = each.drop("repo", "owner", "poor").join(_owned(each, min_owners), "hash")
    return met.select("doc_id", "kind", F.col("hash").alias("secret_hash"), "n_repos", "n_owners", "verdict")


def masked(text: str, secrets: list[str]) -> str:
    """``text`` with every stretch that places of ``secrets`` cover replaced by one mask.

    Places are looked up in the text as it was, so a secret that holds, is part
    of or overlaps another is covered whole; places that only touch stay apart.
    """
    spans = []
    for s in secrets:
        at = text.find(s)
        while at >= 0:
            spans.append((at, at + len(s)))
            at = text.find(s, at + 1)
    out, done, end = [], 0, -1
    for a, b in sorted(spans):
        if a >= end:
            out += [text[done:a], MASK]
        done = end = max(end, b)
    return "".join([*out, text[done:]])


def _masker():
    @F.arrow_udf("string")
    def run(text: pa.Array, secrets: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not s else masked(t, s) for t, s in zip(text.to_pylist(), secrets.to_pylist(), strict=True)], pa.string())

    return run


def redacted(docs: DataFrame, *, text: str = "text", repo: str = "doc_id", owner: str = "source", min_owners: int = MIN_OWNERS) -> DataFrame:
    """``docs`` with every live secret replaced by :data:`MASK`; no row goes.

    ``n_chars``, where there is such a column, follows the text.  Rows without a
    candidate (null and empty texts among them) pass as they are: only the few
    others are stored, with the hashes of their candidates, and meet the verdicts
    by their lists of hashes, so texts are not shuffled and ids may be null or
    repeat; repeated rows are masked alike.  Owners count as in :func:`scan`.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"), F.lower(F.col(text)).alias("low"))
    whole = whole.select("row", "repo", "owner", F.explode(F.array(hashed(candidates(F.col("text"), F.col("low"))))).alias("list"))  # a generator, so that filters don't repeat the search
    plain = whole.where(F.size("list") == 0).select("row.*")
    some = written(whole.where(F.size("list") > 0), "suspects")
    live = _owned(some.select("repo", "owner", F.explode("list").alias("c")).select("repo", "owner", "c.*"), min_owners).where("verdict = 'live'").select("hash")
    keyed = some.select("row", F.array_distinct(F.transform("list", lambda c: c["hash"])).alias("key"))
    lists = keyed.select("key").distinct().select("key", F.explode("key").alias("hash")).join(live, "hash").groupBy("key").agg(F.collect_set("hash").alias("live"))
    met = keyed.join(lists, "key", "left").select("row", "live", F.col(f"row.`{text}`").alias("text"), F.lower(F.col(f"row.`{text}`")).alias("low"))
    own = F.filter(F.transform(candidates(F.col("text"), F.col("low")), lambda c: c["secret"]), lambda s: F.array_contains("live", F.sha2(s, 256)))
    clean = _masker()(F.col("text"), own)
    safe = met.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`") for c in names])
    if "n_chars" in names:
        safe = safe.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return plain.unionByName(safe.select(*[F.col(f"`{c}`") for c in names]))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = " UNION ALL ".join(f"SELECT doc_id, source, {quote(kind)} AS kind, unnest(regexp_extract_all(text, {quote(pattern)}, {group})) AS secret FROM documents" for kind, _, pattern, group in PATTERNS)
    return f"""
WITH found AS (SELECT DISTINCT * FROM ({parts})),
owned AS (SELECT secret, count(DISTINCT doc_id) AS n_repos, count(DISTINCT source) + max((source IS NULL)::INT) AS n_owners FROM found GROUP BY secret)
SELECT doc_id, kind, sha256(secret) AS secret_hash, n_repos::BIGINT AS n_repos, n_owners::BIGINT AS n_owners,
       CASE WHEN n_owners >= {MIN_OWNERS} THEN 'copied_example'
            WHEN regexp_matches(secret, {quote(PLACEHOLDER)}) OR len(list_distinct(string_split(secret, ''))) < {MIN_DISTINCT} THEN 'placeholder' ELSE 'live' END AS verdict
FROM found JOIN owned USING (secret)
"""


ORACLE = _oracle()
