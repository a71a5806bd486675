"""Secrets in every version of every file, by an incremental ledger of blobs.

Each historical version is addressed by its content: a blob is the SHA-256 of the text's UTF-8
bytes. The ledger is a Parquet table with a row for each blob and scan: (blob, scanned, found), the
rules that were applied, as `name@version`, and what they found. A scan reads each unseen pair of
blob and rule version once, whatever number of paths and versions hold that blob: rules that a blob
has met before are not tried on it again, and a changed rule (a new version) is tried alone. The
findings are then joined back to all paths. All of it is DataFrame expressions.

A scan adds its rows in one write, after which they count; a scan that dies leaves the ledger as it
was. Two scans at once may try a pair twice, and reading folds what they found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, sized, written
from .pii import spans


@dataclass(frozen=True)
class Rule:
    """A pattern in Java's syntax; a match makes a finding if `least` code points are left of it without `lead`."""

    name: str
    version: int
    pattern: str
    lead: str = ""
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_LEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Three base rules, and formats that are secrets by their own marks.
BASE = (
    Rule("assign", 1, _LEAD + r"[A-Za-z0-9+/_.=-]++", _LEAD, 8),
    # a shorter run holds no longer one, so the bounds stand in the patterns
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]++ )*PRIVATE KEY-----"),
    Rule("github", 1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", 1, r"(?<![A-Za-z0-9-])xox[abeprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)
RULES = BASE + ADDED
#: Marks without which these rules have nothing to find, so that few texts are searched for matches.
_SIGNS = {"pem": " PRIVATE KEY-----", "github": "gh", "slack": "xox", "jwt": ".eyJ", "access": "AKIA"}

FOUND = "array<struct<start:int,kind:int,end:int,rule:string>>"
LEDGER = f"blob binary, scanned array<string>, found {FOUND}"
#: Blobs with over this share of all rows are at most so many; what is found in them is broadcast.
HOT = 100_000


def blob(text: Column) -> Column:
    """The address of a text's content; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """What a rule finds in a text, leftmost and non-overlapping; matches that fall short are dropped without a retry."""
    hits = spans(text, rule.pattern, kind)
    if rule.least:
        tail = (lambda v: F.regexp_replace(v, f"^{rule.lead}", "")) if rule.lead else (lambda v: v)
        hits = F.filter(hits, lambda s: F.length(tail(s["value"])) >= rule.least)
    hits = F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(rule.key).alias("rule")))
    may = F.contains(text, F.lit(_SIGNS[rule.name])) if rule.name in _SIGNS else F.rlike(text, F.lit(rule.pattern))
    return F.when(may, hits).otherwise(F.array().cast(FOUND))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, scanned, found), one row a blob: the rules it has met and what they found. A ledger that isn't there is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    merged = spark.read.schema(LEDGER).parquet(path).groupBy("blob")
    return merged.agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))


def unseen(addresses: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, id, todo) of the blobs that some rule has not met: the least id that holds it, and those rules as bits by their place."""
    blobs = addresses.groupBy("blob").agg(F.min("id").alias("id"))
    todo = sum((F.when(F.array_contains("scanned", F.lit(r.key)), 0).otherwise(1 << k) for k, r in enumerate(rules)), F.lit(0).cast("long"))
    return blobs.join(ledger.select("blob", "scanned"), "blob", "left").select("blob", "id", todo.alias("todo")).where("todo <> 0")


def scan(history: DataFrame, ledger_path: str, rules=RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bring the ledger up to date with history and return (the columns of history without its text, blob, found).

    history has a row for each version of each path: `id` names the version, further columns (path,
    commit, ...) may have any names and come back as they are, in a struct `row`. found is an array of
    (start, kind, end, rule) by start, then kind, in code points; kind is the place of the rule in
    `rules`. Null texts are empty, texts of any length are scanned whole, null and repeated ids and
    repeated rows get their findings each, and an empty history gives no rows and leaves the ledger
    as it was.

    Rows that share a blob are folded before anything is dealt out, so a text of which there are very
    many copies is scanned once. Of rows alike in blob and id each is scanned, with one row kept.
    """
    spark = history.sparkSession
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    key = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    versions = history.select(F.struct(*[quoted(c) for c in history.columns if c != text]).alias("row"), key(id).alias("id"), quoted(text).alias("text"), blob(quoted(text)).alias("blob"))
    addresses = written(versions.select("row", "id", "blob"), "addresses")
    ledger = read_ledger(spark, ledger_path)
    new = written(unseen(addresses, ledger, rules), "unseen")
    # texts travel only beyond the size that may be broadcast: of a blob, one; by blob and id, so that no blob gathers its copies
    met = versions.select("blob", "id", "text").join(sized(new), ["blob", "id"])
    unmet = lambda k: F.col("todo").bitwiseAND(F.lit(1 << k)) != 0
    apply = lambda r, k: F.when(unmet(k), rule_spans(F.col("t"), r, k)).otherwise(F.array().cast(FOUND))
    keys = F.array_compact(F.array(*[F.when(unmet(k), F.lit(r.key)) for k, r in enumerate(rules)]))
    found = met.withColumn("t", F.coalesce("text", F.lit(""))).select("blob", keys.alias("scanned"), F.array_sort(F.concat(*[apply(r, k) for k, r in enumerate(rules)])).alias("found"))
    # rows alike in blob and id have found the same
    found = found.groupBy("blob").agg(F.any_value("scanned").alias("scanned"), F.any_value("found").alias("found"))
    if new.limit(1).count():
        found.write.mode("append").parquet(ledger_path)
    return with_findings(addresses, read_ledger(spark, ledger_path), rules)


def with_findings(addresses: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """(row, id, blob, found) for each row of addresses (row, id, blob): what the rules as they now are have found.

    Findings of other versions of a rule stay in the ledger and are left out. Blobs that hold more
    than a HOT-th of all rows are at most HOT, so their findings are broadcast, and no task meets
    all rows of one of them; the others are joined by their blob.
    """
    kinds = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    now = F.filter("found", lambda s: s["rule"].isin([r.key for r in rules]))
    now = F.array_sort(F.transform(now, lambda s: F.struct(s["start"].alias("start"), kinds[s["rule"]].alias("kind"), s["end"].alias("end"), s["rule"].alias("rule"))))
    hits = ledger.select("blob", now.alias("found")).where(F.size("found") > 0)
    held = addresses.groupBy("blob").agg(F.count("*").alias("rows"))
    hits = written(hits.join(held, "blob"), "hits")
    most = addresses.count() // HOT
    none = F.array().cast(FOUND)
    if hits.count() <= HOT:
        return addresses.join(F.broadcast(hits.select("blob", "found")), "blob", "left").select("row", "id", "blob", F.coalesce("found", none).alias("found"))
    hot = hits.where(F.col("rows") > most).select("blob", F.col("found").alias("hot"))
    first = addresses.join(F.broadcast(hot), "blob", "left")
    rest = first.where("hot IS NULL").join(hits.where(F.col("rows") <= most).select("blob", "found"), "blob", "left")
    return first.where("hot IS NOT NULL").select("row", "id", "blob", F.col("hot").alias("found")).union(rest.select("row", "id", "blob", F.coalesce("found", none).alias("found")))


def joined(found: Column, rules=RULES) -> Column:
    """rule:start:end of findings, joined by commas."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for each row of docs (doc_id, text, ...), with a ledger of its own."""
    rows = docs.select("doc_id", "text")
    return scan(rows, scratch_path(docs.sparkSession, "ledger")).select(F.col("row.doc_id").alias("doc_id"), "found")
