"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds the pairs of
blob and rule version that have been scanned, and their findings. A scan looks only at pairs that
the ledger does not hold, each once however many paths share the blob, and findings are joined back
to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern``'s first group is the secret; a match must contain one of ``literals`` in lower case."""

    name: str
    version: int
    pattern: str
    literals: tuple[str, ...]


_EDGE = r"(?:^|[^A-Za-z0-9_])"
RULES = (
    Rule("aws_access_key", 1, _EDGE + r"((?:AKIA|ASIA)[0-9A-Z]{16})", ("akia", "asia")),
    Rule("github_token", 1, _EDGE + r"(gh[pousr]_[A-Za-z0-9]{36,})", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 1, _EDGE + r"(xox[abprs]-[A-Za-z0-9-]{10,})", ("xox",)),
    Rule("google_api_key", 1, _EDGE + r"(AIza[0-9A-Za-z_-]{35})", ("aiza",)),
    Rule("private_key", 1, r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", ("private key-----",)),
    Rule("json_web_token", 1, _EDGE + r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", ("eyj",)),
    Rule(
        "assigned_secret", 2,
        _EDGE + r"""[A-Za-z0-9_.-]*(?i:token|secret|password|passwd|api_key|apikey|access_key)["']?[ \t]*[:=][ \t]*["']([^"' \t\n\r]{8,})["']""",
        ("token", "secret", "passw", "api_key", "apikey", "access_key"),
    ),
    Rule("connection_password", 1, r"[a-z][a-z0-9+]{2,}://[A-Za-z0-9_.-]+:([^@/ \t\n\r:]{3,})@", ("://",)),
)

PAIRS = "blob_id string, rule string, rule_version int"
FINDINGS = f"{PAIRS}, nth int, secret_sha256 string, secret_chars int"


def _hits(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Places in ``rules`` whose literals the text contains; no other rule can match."""
    lowered = F.lower(text)
    places = []
    for i, rule in enumerate(rules):
        any_of = F.lit(False)
        for literal in rule.literals:
            any_of = any_of | F.contains(lowered, F.lit(literal))
        places.append(F.when(any_of, F.lit(i)))
    return F.array_compact(F.array(*places))


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """(doc_id, path, blob_id, text) of every version; rows with a null text are no version."""
    at = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", id_col))) if path is None else path
    text = F.col(text_col).cast("string")
    return docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), at.alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("text"))


def scan_blobs(found: DataFrame, rules: tuple[Rule, ...] = RULES, scanned: DataFrame | None = None) -> DataFrame:
    """Findings of the pairs of blob and rule version that are not in ``scanned``; each pair is scanned once."""
    rows = found.select("blob_id", "text", _hits(F.col("text"), rules).alias("hits")).where(F.size("hits") > 0)
    blobs = rows.dropDuplicates(["blob_id"]).select("blob_id", "text", F.explode("hits").alias("place"))
    names = F.array(*(F.lit(r.name) for r in rules))
    numbers = F.array(*(F.lit(r.version) for r in rules))
    pairs = blobs.select("blob_id", "text", "place", names[F.col("place")].alias("rule"), numbers[F.col("place")].alias("rule_version"))
    if scanned is not None:
        pairs = pairs.join(scanned.select("blob_id", "rule", "rule_version"), ["blob_id", "rule", "rule_version"], "left_anti")
    matches = F.lit(None).cast("array<string>")
    for i, rule in enumerate(rules):
        matches = F.when(F.col("place") == i, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(1))).otherwise(matches)
    each = pairs.select("blob_id", "rule", "rule_version", F.posexplode(matches).alias("nth", "secret"))
    return each.select("blob_id", "rule", "rule_version", "nth", F.sha2("secret", 256).alias("secret_sha256"), F.length("secret").alias("secret_chars"))


def at_all_paths(found: DataFrame, findings: DataFrame) -> DataFrame:
    paths = found.select("doc_id", "path", "blob_id").distinct()
    return paths.join(findings, "blob_id").select("doc_id", "path", "blob_id", "rule", "rule_version", "nth", "secret_sha256", "secret_chars")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """(doc_id, path, blob_id, rule, rule_version, nth, secret_sha256, secret_chars) from an empty ledger.

    A row for each match of each rule in each version; the secret itself is never returned. A null
    text is no version and an empty one has no findings. Rows that repeat path and text are one
    version; several texts at one path are several. A null id stays null and is an empty part of the
    path, as a null source or language is; a null path that is given stays null. An empty table
    gives an empty result. Columns other than id, text and those of the path (source and lang) are
    not read. Texts are scanned whole.
    """
    found = versions(docs, id_col, text_col, path)
    return at_all_paths(found, scan_blobs(found, rules))


class Ledger:
    """Scanned pairs and their findings as Parquet below one folder, added to by each scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", PAIRS)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).distinct()

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
        """Scans what is new, adds it to the ledger, and returns the findings of all of ``docs``.

        Findings are written before the pairs they belong to, so that a scan that breaks off is done
        again and not lost.
        """
        found = versions(docs, id_col, text_col, path)
        before = self.scanned()
        scan_blobs(found, rules, before).write.mode("append").parquet(f"{self.folder}/findings")
        every = self.spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int")
        pairs = found.select("blob_id").distinct().crossJoin(F.broadcast(every)).join(before, ["blob_id", "rule", "rule_version"], "left_anti")
        pairs.write.mode("append").parquet(f"{self.folder}/scanned")
        wanted = self.findings().join(F.broadcast(every), ["rule", "rule_version"], "left_semi")
        return at_all_paths(found, wanted)


def _sql() -> str:
    parts = [
        f"""SELECT DISTINCT blob_id, '{r.name}' AS rule, {r.version} AS rule_version, """
        f"""unnest(regexp_extract_all(text, '{r.pattern.replace("'", "''")}', 1)) AS secret, """
        f"""unnest(range(len(regexp_extract_all(text, '{r.pattern.replace("'", "''")}', 1)))) AS nth FROM versions"""
        for r in RULES
    ]
    return f"""
WITH versions AS (
  SELECT DISTINCT doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce(doc_id::VARCHAR, '')) AS path, sha256(text) AS blob_id, text FROM documents WHERE text IS NOT NULL),
findings AS ({" UNION ALL ".join(parts)})
SELECT doc_id, path, blob_id, rule, rule_version::INT AS rule_version, nth::INT AS nth, sha256(secret) AS secret_sha256, length(secret)::INT AS secret_chars
FROM versions JOIN findings USING (blob_id)
"""


SQL = _sql()
