"""Personal data: base patterns, and terms that disclose the entities with which they stand.

All of it is DataFrame expressions. Base spans come from four patterns. Each distinct value is a
protected entity; the words of the documents that hold it are the terms that may disclose it. Over
the whole corpus, a term's disclosure of an entity is its pointwise mutual information with it as a
share of the entity's information content:

    (log N df(t, e) / (df(t) df(e))) / (log N / df(e))

with counts of rows: N of all, df(t) with the term, df(e) with the entity, df(t, e) with both,
anywhere in the text. 1 means that whoever reads the term knows the entity. From `general` on a
term is generalised to its kind, from `remove` on it is removed, wherever it stands in the
documents that hold the entity; documents without personal data stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, written

#: Documents that must hold term and entity together, shares from which terms are generalised or removed.
SUPPORT, GENERAL, REMOVE = 2, 0.9, 0.97
#: Entities, or numbers of rows, that may be broadcast.
ENTITIES = 1_000_000
#: The base patterns. Possessive runs and the looks behind find what the plain
#: patterns find from left to right, without trying every start inside a run again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}_])\p{L}[\p{L}\p{M}]{2,}+(?![\p{N}_])"
#: Matches that are folded at once.
FEW = 64
KINDS = ("email", "ip", "card", "phone", "term")
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Matches of a pattern from left to right as an array of spans; positions are code points.

    The pieces between matches and the matches alternate, so positions are running sums of lengths.
    """
    none = F.array().cast(SPAN)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), pair["hit"].alias("value"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunk(acc, part):
        moved = F.transform(part["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + part["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    few = F.aggregate(pairs, begin, step, lambda acc: acc["out"])
    # each step copies what is found so far, so very many matches are folded in chunks of about their root
    size = F.ceil(F.sqrt(F.size(hits))).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.size(hits), size), lambda k: F.aggregate(F.slice(pairs, k, size), begin, step))
    many = F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), chunk, lambda acc: acc["out"]))
    return F.when(F.size(hits) == 0, none).when(F.size(hits) <= FEW, few).otherwise(many)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, k: a + _weighed(F.substring(digits, k, F.lit(1)).cast("int"), k))
    return total % 10 == 0


def _weighed(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind; null texts count as empty."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    email = F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, 0)).otherwise(none)
    low = lambda part: F.length(F.regexp_replace(part, "^0+", "")) < 3
    small = lambda part: low(part) | ((F.length(F.regexp_replace(part, "^0+", "")) == 3) & (F.right(part, F.lit(3)).cast("int") <= 255))
    ip = F.filter(spans(text, IP, 1), lambda s: F.forall(F.split(s["value"], "\\."), small))
    card = F.filter(spans(text, CARD, 2), lambda s: _luhn(s["value"]))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE, 3), lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def joined(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def _entities(base: Column) -> Column:
    """Hashes of the distinct values of base spans."""
    return F.array_distinct(F.transform(base, lambda m: F.xxhash64(F.concat_ws(":", m["kind"], F.lower(m["value"])))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing(docs: DataFrame, support: int = SUPPORT, general: float = GENERAL, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(at, doc_id, text, base) for each row of docs, written once, and (at, start, end, share) of disclosing terms.

    at numbers the rows, so that repeated ones and those without id are told apart; text is kept
    for rows with base spans, and for all if `texts`. Every count is of rows.

    A term can reach the share only with an entity that as many rows hold as the term, about: both
    are in `support` rows, and N / df(t) >= (N / df(e)) ** general. Pairs of a row are built of
    terms and entities for which that holds, and added up before they are shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text", base_spans(F.col("text")).alias("base"))
    rows = written(rows.withColumn("text", F.when(F.lit(texts) | (F.size("base") > 0), F.col("text"))), "spans")
    total = float(rows.count())
    held = rows.where(F.size("base") > 0)
    mentions = held.select("at", F.explode(_entities(F.col("base"))).alias("entity"))
    entities = written(mentions.groupBy("entity").agg(F.count("*").alias("holders")).where(F.col("holders") >= support), "entities")
    most = entities.agg(F.max("holders")).first()[0]
    if most is None:
        return rows, rows.select("at", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("share")).where("false")
    log = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    bound = lambda holders: F.lit(total) / F.pow(F.lit(total) / holders, F.lit(general)) * (1 + 1e-9)
    met = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("met"))
    met = met.where((F.col("met") >= support) & (F.col("met") <= bound(F.lit(float(most))))).select(F.xxhash64("term").alias("term"), "met")
    busy = mentions.join(sized(entities, ENTITIES), "entity").groupBy("at").agg(F.collect_list(F.struct("entity", "holders")).alias("entities"))
    busy = written(busy, "busy")  # of one row each
    words = held.join(sized(busy.select("at"), ENTITIES), "at", "left_semi").select("at", F.explode(_terms(F.col("text"))).alias("term")).select("at", F.xxhash64("term").alias("term"))
    words = written(words.join(written(met, "met"), "term"), "words")
    pairs = words.join(busy, "at").select("at", "term", "met", F.explode("entities").alias("e")).select("at", "term", "met", "e.*").where(F.col("met") <= bound(F.col("holders")))
    share = log(F.lit(total) * F.col("both") / (F.col("met") * F.col("holders"))) / F.greatest(log(F.lit(total) / F.col("holders")), F.lit(1e-9))
    rated = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("met").alias("met"), F.first("holders").alias("holders")).where(F.col("both") >= support)
    rated = sized(written(rated.withColumn("share", share).where(F.col("share") >= general).select("entity", "term", "share"), "rated"))
    # the rated terms of a row, then their places in its text; terms inside base spans are told by those
    marked = written(pairs.join(rated, ["entity", "term"]).groupBy("at", "term").agg(F.max("share").alias("share")), "marked")
    places = held.join(sized(written(marked.select("at").distinct(), "rows"), ENTITIES), "at", "left_semi")
    places = places.select("at", "base", F.explode(spans(F.col("text"), TERM, 4)).alias("s"))
    places = places.where(~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (b["end"] > F.col("s.start"))))
    places = places.select("at", F.xxhash64(F.lower("s.value")).alias("term"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    return rows, places.join(marked, ["at", "term"]).select("at", "start", "end", "share")


def sanitised(docs: DataFrame, support: int = SUPPORT, general: float = GENERAL, remove: float = REMOVE, texts: bool = True) -> DataFrame:
    """(doc_id, base, terms, spans[, clean_text]) for each row of docs (doc_id, text, ...).

    base and spans are arrays of (start, kind, end, value); terms tells of each disclosing term
    whether it is removed. clean_text has `[EMAIL]` and so on for base spans, `[TERM]` for
    generalised terms, and nothing for removed ones. Null texts count as empty and texts of any
    length are read whole; repeated rows count and get their spans each, and so do rows without
    id; other columns are ignored; an empty table gives no rows.
    """
    rows, terms = disclosing(docs, support, general, texts)
    shape = "array<struct<start:int,end:int,removed:boolean>>"
    grouped = terms.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "end", (F.col("share") >= remove).alias("removed")))).alias("terms"))
    # rows with terms alone are joined, so that no other text is dealt out
    grouped = written(grouped, "terms")
    with_terms = sized(grouped.select("at"), ENTITIES)
    found = rows.join(with_terms, "at", "left_semi").join(grouped, "at").select("doc_id", "text", "base", F.col("terms").cast(shape).alias("terms"))
    bare = rows.join(with_terms, "at", "left_anti").select("doc_id", "text", "base", F.array().cast(shape).alias("terms"))
    out = found.union(bare)
    added = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"), F.lit("").alias("value")))
    out = out.withColumn("spans", F.when(F.size("terms") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")))
    if not texts:
        return out.drop("text")
    marks = [f"[{k.upper()}]" for k in KINDS]
    # spans that begin inside the one before are told by it; what is kept lies between the others
    gone = lambda s: (s["kind"] == 4) & F.exists("terms", lambda x: (x["start"] == s["start"]) & x["removed"])
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.when(gone(s), F.lit("")).otherwise(F.element_at(F.array(*map(F.lit, marks)), s["kind"] + 1)))).alias("out")))
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"] + 1, F.length("text"))))
    return out.withColumn("clean_text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).drop("text")
