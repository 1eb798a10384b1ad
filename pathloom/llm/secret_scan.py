"""Secret scan by corpus-wide ownership.

Candidates are found by patterns (kinds below): keys and tokens by their form, others as the value of
a setting whose name holds a keyword, in code, JSON, YAML or .env form, quoted or bare; bare values
end at a blank or at , ; & <, and values under `least_chars` are too short to look random. They are known
from then on only by the SHA-256 of
their value; hexadecimal values are compared in lower case. Over the whole corpus each hash is
counted by distinct repositories and owners. A value that many owners or repositories hold is a
copied example, whatever it looks like; one that a single owner holds and that looks random is
reported as live.

    widely_copied     at least `copied_owners` owners or `copied_repositories` repositories
    placeholder       reads as an example, or has under `least_symbols` different characters
    owner_specific    one owner (or none is named): looks live
    shared            a few owners

The owner of a document is its source, its repository the source and language together; both are
parameters. The result has a row for each document and value; values themselves are never in it.

Defined results: null and empty texts have no candidates. A null owner counts as no owner, and a
repository is null only if all its parts are. Rows with a null doc_id are counted and reported
under null. Repeated rows add to n_here and change nothing else. A table that lacks an owner or
repository column has none for all rows. A very long text is searched whole, by patterns without
deep recursion. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common

KINDS = {
    "cloud_key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "code_host_token": r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b",
    "chat_token": r"\b(xox[abprs]-[A-Za-z0-9-]{10,})",
    "map_key": r"\b(AIza[0-9A-Za-z_-]{35})",
    "web_token": r"\b(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]{64,})-----END",
    "assigned": r"""(?i)(?:token|secret|api_?key|passw(?:or)?d|credential)[^\n"']{0,12}["']([A-Za-z0-9+/_=.-]{16,})["']""",
}
#: Settings of any form, for what "assigned" above leaves: a name that holds a keyword and may be quoted, = or :, and a
#: quoted value, or a bare one to a blank or , ; & <. The repeats that never give back (*+) keep Java from deep recursion;
#: without their + the patterns mean the same, to RE2 as well.
NAME = r"(?i)(?:token|secret|api_?key|passw(?:or)?d|credential)[A-Za-z0-9_.-]*+[\"'\]]{0,2}[ \t]*+(?::=|=>|[:=])[ \t]*+"
BARE = r"([^\s\"'`,;&<:=>][^\s\"'`,;&<]*)(?:[\s,;&<]|\z)"
SETTINGS = [*[NAME + rf"[bru]?{q}([^{q}\\\n]*+(?:\\[^\n][^{q}\\\n]*+)*+){q}" for q in "\"'`"], NAME + BARE]
#: Calls and references (f(x), ${x}, {{x}}, <x>) are no values.
REFERENCE = r"^(?:\$[{(]|\{\{|<)"
CALL = r"^[A-Za-z0-9_.]+[(\[]"
CLOSERS = r"[.)\]}>]+$"
#: Every kind's matches contain one of these: texts without any are not looked at further.
VENDORS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "AIza", "eyJ", "PRIVATE KEY-----"]
KEYWORDS = ["token", "secret", "apikey", "api_key", "passw", "credential"]
PLACEHOLDER = r"(?i)example|changeme|placeholder|your[_-]|x{6,}|0{8,}|123456789|abcdefgh"


@dataclass(frozen=True)
class SecretParams:
    owner: str = "source"
    repository: tuple[str, ...] = ("source", "lang")
    copied_owners: int = 3
    copied_repositories: int = 5
    least_symbols: int = 8
    least_chars: int = 8


def matches(kind: str, pattern: str, text: Column | str = "text") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def hinted(text: str = "text") -> Column:
    """Whether a text holds any vendor's mark or, in any case, a keyword."""
    return common.holds_any(text, VENDORS, KEYWORDS)


def settings(p: SecretParams) -> Column:
    """Assigned values that the pattern of the kind leaves; what it takes is cut out first, so that none counts twice."""
    rest = F.regexp_replace("text", KINDS["assigned"], "\n")
    *quoted, bare = [matches("assigned", r, rest) for r in SETTINGS]
    bare = F.filter(bare, lambda c: ~c["value"].rlike(CALL))
    bare = F.transform(bare, lambda c: F.struct(c["kind"].alias("kind"), F.regexp_replace(c["value"], CLOSERS, "").alias("value")))
    return F.filter(F.concat(*quoted, bare), lambda c: (F.length(c["value"]) >= p.least_chars) & ~c["value"].rlike(REFERENCE))


def candidates(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, owner, repository, kind, value of every match."""
    named = {c.lower() for c in docs.columns}
    owner = F.col(p.owner).cast("string") if p.owner.lower() in named else F.lit(None).cast("string")
    parts = [F.col(c).cast("string") for c in p.repository if c.lower() in named]
    repository = F.nullif(F.concat_ws("/", *parts), F.lit("")) if parts else F.lit(None).cast("string")
    found = F.concat(*[matches(k, r) for k, r in KINDS.items()], settings(p))
    return (
        docs.filter(hinted())
        .select("doc_id", owner.alias("owner"), repository.alias("repository"), F.explode(found).alias("c"))
        .select("doc_id", "owner", "repository", "c.kind", F.when(F.col("c.kind") == "assigned", F.col("c.value")).otherwise(F.regexp_replace("c.value", r"\s", "")).alias("value"))
    )


def scan(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    hexadecimal = F.col("value").rlike("^[0-9A-Fa-f]+$")
    value = F.when(hexadecimal, F.lower("value")).otherwise(F.col("value"))
    here = (
        candidates(docs, p).withColumn("value", value)
        .select("doc_id", "owner", "repository", "kind", F.sha2("value", 256).alias("secret_hash"), F.length("value").alias("n_chars"),
                F.col("value").rlike(PLACEHOLDER).alias("reads"), F.size(F.array_distinct(F.split("value", ""))).alias("symbols"))
        .groupBy("doc_id", "owner", "repository", "kind", "secret_hash", "n_chars", "reads", "symbols").agg(F.count(F.lit(1)).alias("n_here"))
    )
    here = common.stored(here)  # a few rows a document with a secret; texts are read and searched once
    # the distinct pairs shrink on the map side; a value in a million documents is one row a task and owner
    spread = here.groupBy("secret_hash").agg(
        F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"), F.count_distinct("doc_id").alias("n_docs")
    )
    verdict = (
        F.when((F.col("n_owners") >= p.copied_owners) | (F.col("n_repositories") >= p.copied_repositories), "widely_copied")
        .when(F.col("reads") | (F.col("symbols") < p.least_symbols), "placeholder")
        .when(F.col("n_owners") <= 1, "owner_specific")
        .otherwise("shared")
    )
    return here.join(spread, "secret_hash").select("doc_id", "owner", "repository", "kind", "secret_hash", "n_chars", "n_here", "n_docs", "n_repositories", "n_owners", verdict.alias("verdict"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_settings() -> str:
    rest = f"regexp_replace(text, {quoted(KINDS['assigned'])}, chr(10), 'g')"
    all_ = [f"regexp_extract_all({rest}, {quoted(r.replace('*+', '*'))}, 1)" for r in SETTINGS]
    bare = f"list_transform(list_filter({all_[-1]}, lambda v: NOT regexp_matches(v, {quoted(CALL)})), lambda v: regexp_replace(v, {quoted(CLOSERS)}, ''))"
    return f"list_filter(list_concat({', '.join([*all_[:-1], bare])}), lambda v: length(v) >= 8 AND NOT regexp_matches(v, {quoted(REFERENCE)}))"


REPOSITORY = "nullif(concat_ws('/', source, lang), '')"
ORACLE = f"""
WITH found AS (
  {" UNION ALL ".join(f"SELECT doc_id, source AS owner, {REPOSITORY} AS repository, '{k}' AS kind, unnest(regexp_extract_all(text, {quoted(r)}, 1)) AS raw FROM documents" for k, r in KINDS.items())}
  UNION ALL SELECT doc_id, source, {REPOSITORY}, 'assigned', unnest({oracle_settings()}) FROM documents
), named AS (
  SELECT doc_id, owner, repository, kind, CASE WHEN regexp_full_match(v, '[0-9A-Fa-f]+') THEN lower(v) ELSE v END AS v
  FROM (SELECT *, CASE WHEN kind = 'assigned' THEN raw ELSE regexp_replace(raw, '\\s', '', 'g') END AS v FROM found)
), here AS (
  SELECT doc_id, owner, repository, kind, sha256(v) AS secret_hash, CAST(length(v) AS INTEGER) AS n_chars, regexp_matches(v, {quoted(PLACEHOLDER)}) AS reads,
         len(list_distinct(string_split(v, ''))) AS symbols, count(*) AS n_here
  FROM named GROUP BY ALL
), spread AS (
  SELECT secret_hash, count(DISTINCT owner) AS n_owners, count(DISTINCT repository) AS n_repositories, count(DISTINCT doc_id) AS n_docs FROM here GROUP BY 1
)
SELECT doc_id, owner, repository, kind, secret_hash, n_chars, n_here, n_docs, n_repositories, n_owners,
  CASE WHEN n_owners >= 3 OR n_repositories >= 5 THEN 'widely_copied' WHEN reads OR symbols < 8 THEN 'placeholder' WHEN n_owners <= 1 THEN 'owner_specific' ELSE 'shared' END AS verdict
FROM here JOIN spread USING (secret_hash)
"""
