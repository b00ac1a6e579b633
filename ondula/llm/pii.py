"""Personal data and what gives it away, in DataFrame functions only.

Base spans - emails, IP addresses, card and phone numbers - are matched by pattern, leftmost and non-overlapping for each kind. Quantifiers are possessive and look
behind for a run's start where that cannot change the matches, so a long run of digits or letters costs linear time and no stack.

Information-theoretic spans: the values found are the protected entities. For an entity e and a word t outside the base spans of a text, with document counts c(.)
over all N documents, PMI(t; e) = log(N c(t,e) / (c(t) c(e))) says how much t tells of e, and IC(e) = log(N / c(e)) how much there is to tell. Where their
ratio, discounted by c(t,e) / (c(t,e) + DISCOUNT), passes GENERALISE and c(t,e) PMI passes EVIDENCE, the word gives the entity away: all its occurrences in texts with e are spans `term` and are
generalised to a placeholder; above REMOVE they are removed. Most entities are in one document, which proves nothing about its words; their evidence is pooled
over classes - an e-mail's domain, a network, the first digits of a number - that are entities too.

Scale: the spans and distinct words of all texts are found in one scan and written, with the texts of rows that have personal data. Pairs of word and entity are
made only where counts allow them to tell: c(t,e) <= c(e) and c(t,e) <= c(t) bound PMI by log(N / c(t)) and by IC(e), which drops no telling word. Entities that stand in the
same documents have the same counts with every word, and so have words that stand in the same of the documents with personal data: each such set (told by hashes of
its documents) is one class, and pairs are made of classes. A group of copies is one pair, whatever the number of its words and entities.
Counts are pre-aggregated in each task before they are shuffled; the sides of joins are written, so that Spark can split a hot entity.

Defined cases: a null text is empty and has no spans. Repeated rows are separate documents with equal spans. Texts without a match pass unchanged. An empty table gives no
rows. Other columns are ignored by `spans` and kept by `sanitise`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import documents, stored, text_of, written

_LOCAL = "A-Za-z0-9._%+-"
#: Patterns in the order of the result.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Shared documents are discounted by c / (c + DISCOUNT): one alone proves little, as every word of an entity's only document is in it.
DISCOUNT = 0.5
GENERALISE = 0.8
REMOVE = 0.95
#: PMI is IC(e) at most, so c(t,e) / (c(t,e) + DISCOUNT) must reach GENERALISE: rarer words and entities are in no telling pair.
LEAST = math.ceil(round(GENERALISE * DISCOUNT / (1 - GENERALISE), 9))
#: Nats that the shared documents must tell together, c(t,e) PMI: below, a rare word may be with a frequent class by chance.
EVIDENCE = 12.0
TERM = r"\p{L}{3,}"
#: Elements that are summed in one go, and characters that are rewritten in one go.
GROUP = 128
PART = 4096
_PLACES = "array<struct<start:int,end:int,remove:boolean>>"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    places = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10)).cast("int"))
    return F.length(digits).between(13, 19) & (F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0)


def _checker(kind: str):
    return lambda span: _valid(kind, span["value"])


def _running(steps: Column) -> Column:
    """Running sums of an array of ints. Sums are taken in groups of GROUP and then over the groups, as an array that grows by one is copied each time."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / GROUP).cast("int")), lambda k: F.slice(steps, k * GROUP + 1, F.lit(GROUP)))
    none = F.array().cast("array<int>")

    def sums(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")), lambda acc: acc["out"])

    totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda acc, x: acc + x))
    before = F.zip_with(sums(totals, F.lit(0)), totals, lambda x, own: x - own)
    return F.when(F.size(steps) > 0, F.flatten(F.zip_with(groups, before, sums))).otherwise(none)


def _starts(text: Column, found: Column, pattern: str) -> Column:
    """Where the matches `found` of a pattern start: the texts between matches give the offsets."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
    before = F.concat(F.array(F.lit(0)), F.transform(found, F.length))
    return F.when(F.size(found) > 0, _running(F.transform(F.arrays_zip(gaps.alias("gap"), F.slice(before, F.lit(1), F.size(found)).alias("before")), lambda x: x["gap"] + x["before"]))).otherwise(F.array().cast("array<int>"))


def _placed(kind: str, found: Column, starts: Column) -> Column:
    """The matches as spans."""
    span = lambda v, at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value"))
    return F.zip_with(found, starts, span)


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds one span array per kind; `text` must not be null."""
    hints = {"email": "@", "phone": "+"}
    found = {}
    for kind, pattern in PATTERNS.items():
        every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        found[f"found_{kind}"] = F.when(F.contains(F.col(text), F.lit(hints[kind])), every).otherwise(F.array().cast("array<string>")) if kind in hints else every
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"at_{kind}": _starts(F.col(text), F.col(f"found_{kind}"), pattern) for kind, pattern in PATTERNS.items()})
    rows = rows.withColumns({kind: _placed(kind, F.col(f"found_{kind}"), F.col(f"at_{kind}")) for kind in PATTERNS}).drop(*found, *[f"at_{k}" for k in PATTERNS])
    return rows.withColumns({kind: F.filter(kind, _checker(kind)) for kind in PATTERNS})


def _rewritten(text: Column, marks: Column, put) -> Column:
    """The text with marks (in the order of their starts) replaced; a mark that starts inside an earlier one only widens it.

    The text is taken in parts of PART characters, so that no step reads it from its start. put: from a mark and the characters of it in a part to what stands for them.
    """

    def part(piece: Column, k: Column) -> Column:
        base = k * PART
        near = F.filter(marks, lambda m: (m["start"] < base + F.length(piece)) & (m["end"] > base))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, m: Column) -> Column:
            begin, end = F.greatest(m["start"] - base, acc["at"]), F.least(m["end"] - base, F.length(piece))
            gap = F.substring(piece, acc["at"] + 1, begin - acc["at"])
            new = F.concat(acc["out"], gap, put(m, F.greatest(F.lit(0), end - begin), m["start"] - base >= acc["at"]))
            return F.struct(F.greatest(acc["at"], end).alias("at"), new.alias("out"))

        return F.aggregate(near, start, step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.length(piece))))

    return F.concat_ws("", F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), part))


def _blank(text: Column, marks: Column) -> Column:
    """The text with its spans blanked, of the same length."""
    return _rewritten(text, marks, lambda m, size, fresh: F.repeat(F.lit(" "), size))


def _class(span: Column) -> Column:
    """The class of an entity: an e-mail's domain, an IP address without its last number, the first six digits of a card or phone."""
    digits = F.substring(F.regexp_replace(span["value"], "[^0-9]", ""), 1, 6)
    host = F.lower(F.substring_index(span["value"], "@", -1))
    name = F.when(span["kind"] == "email", host).when(span["kind"] == "ip", F.substring_index(span["value"], ".", 3)).otherwise(digits)
    return F.xxhash64(F.lit("class"), span["kind"], name)


def _spanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_no, row_key, id, the four span arrays, entities, blank, words), written: one scan of the texts. `blank` is null without spans."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = base_spans(rows.withColumn("row_key", F.xxhash64("id", "text")))
    every = F.concat(*PATTERNS)
    entities = F.array_distinct(F.concat(F.transform(every, lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))), F.transform(every, _class)))
    marks = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    rows = rows.select("row_no", "row_key", "id", *PATTERNS, entities.alias("entities"), F.when(F.size(every) > 0, _blank(F.col("text"), marks)).alias("blank"), "text")
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("blank", "text"), F.lit(TERM), F.lit(0)))
    return written(rows.withColumn("words", F.array_distinct(F.transform(found, F.lower))).drop("text"), "pii-spans")


def _occurrences(rows: DataFrame) -> DataFrame:
    """Adds `terms`: all places of the told words (term, remove) in `blank`, as an array of (start, end, remove)."""
    rows = rows.withColumn("found", F.regexp_extract_all("blank", F.lit(TERM), F.lit(0)))
    rows = rows.withColumn("at", _starts(F.col("blank"), F.col("found"), TERM))
    rows = rows.withColumns({"every": F.transform("told", lambda t: t["term"]), "removed": F.transform(F.filter("told", lambda t: t["remove"]), lambda t: t["term"])})
    hits = F.filter(F.zip_with("found", "at", lambda v, at: F.struct(F.lower(v).alias("term"), at.alias("start"), (at + F.length(v)).alias("end"))), lambda x: F.array_contains("every", x["term"]))
    return rows.withColumn("terms", F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array_contains("removed", x["term"]).alias("remove"))))


def _same_rows(count: str) -> Column:
    """One number for all groups that have the same rows and count."""
    return F.xxhash64(F.first(count), F.bit_xor(F.xxhash64("row_no")), F.bit_xor(F.xxhash64("row_no", F.lit(1))), F.count(F.lit(1)))


def term_spans(spanned: DataFrame) -> DataFrame:
    """(row_no, terms) of rows in which words give an entity away, written; terms: array of (start, end, remove)."""
    n = F.lit(float(max(spanned.count(), 1)))
    seen = spanned.select("row_no", F.explode("entities").alias("entity"), F.lit(1).alias("one"))
    entities = stored(seen.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"), _same_rows("one").alias("e")).filter(F.col("c_e") >= LEAST))
    known = written(seen.join(entities, "entity").select("row_no", "e", "c_e").distinct(), "pii-known")
    counts = spanned.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c_t")).filter(F.col("c_t") >= LEAST)
    # a word above the bound of every entity is in no pair
    least = F.log(n / F.col("c_e")) * GENERALISE - 1e-6
    top = entities.agg(F.min(least).alias("least"))
    counts = stored(counts.join(F.broadcast(top), F.log(n / F.col("c_t")) >= F.col("least")).drop("least"))
    held = spanned.join(known.select("row_no").distinct(), "row_no", "left_semi").select("row_no", F.explode("words").alias("term"))
    words = stored(held.join(counts, "term"))
    alike = stored(words.groupBy("term").agg(_same_rows("c_t").alias("t")))
    classes = stored(words.join(alike, "term").select("row_no", "t", "c_t").distinct())
    can_tell = (F.log(n / F.col("c_t")) >= least) & (F.col("c_t") * F.log(n / F.col("c_e")) >= EVIDENCE) & (F.col("c_e") * F.log(n / F.col("c_t")) >= EVIDENCE - 1e-6)
    places = written(classes.join(known, "row_no").filter(can_tell), "pii-places")
    pairs = places.groupBy("e", "t", "c_e", "c_t").agg(F.count(F.lit(1)).alias("c_te")).filter(F.col("c_te") >= LEAST)
    share = F.log(n * F.col("c_te") / (F.col("c_t") * F.col("c_e"))) / F.greatest(F.log(n / F.col("c_e")), F.lit(1e-9)) * F.col("c_te") / (F.col("c_te") + DISCOUNT)
    told = F.col("c_te") * F.log(n * F.col("c_te") / (F.col("c_t") * F.col("c_e")))
    telling = stored(pairs.filter(told >= EVIDENCE).select("e", "t", share.alias("share")).filter(F.col("share") >= GENERALISE - 1e-9))
    hits = stored(places.join(telling, ["e", "t"]).groupBy("row_no", "t").agg(F.max(F.col("share") >= REMOVE).alias("remove")))
    named = words.join(alike.join(hits.select("t").distinct(), "t", "left_semi"), "term").join(hits, ["row_no", "t"])
    told = stored(named.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("term", "remove"))).alias("told")))
    found = spanned.select("row_no", "blank").join(told, "row_no")
    out = written(_occurrences(found).select("row_no", "terms"), "pii-terms")
    for table in (told, hits, telling, classes, alike, words, counts, entities):
        table.unpersist()
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_terms of every row."""
    spanned = _spanned(docs, id_col, text_col)
    told = term_spans(spanned)
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = spanned.select("row_no", F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], F.concat_ws(",", *[F.transform(k, label) for k in PATTERNS]).alias("base"))
    joined = base.join(told, "row_no", "left")
    terms = F.transform(F.coalesce("terms", F.array().cast(_PLACES)), lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size(terms) > 0, F.concat_ws(",", terms)))
    return joined.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), both.alias("spans"), F.size(terms).cast("long").alias("n_terms"))


def _masked(text: Column, marks: Column) -> Column:
    """The text with marks (start, end, put) replaced, from the left."""
    return _rewritten(text, marks, lambda m, size, fresh: F.when(fresh, m["put"]).otherwise(F.lit("")))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with personal data replaced by its kind and telling words generalised or removed."""
    spanned = _spanned(docs, id_col, text_col)
    told = term_spans(spanned)
    marked = spanned.filter("blank is not null").join(told, "row_no", "left")
    base = F.transform(F.concat(*PATTERNS), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("put")))
    terms = F.transform(F.coalesce("terms", F.array().cast(_PLACES)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["remove"], F.lit("")).otherwise(F.lit("<TERM>")).alias("put")))
    marks = written(marked.select("row_key", F.array_sort(F.concat(base, terms)).alias("marks")).dropDuplicates(["row_key"]), "pii-marks")
    columns = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.xxhash64(docs[id_col], text_of(text_col)).alias("row_key"), text_of(text_col).alias("text"))
    # rows that may hold personal data are told by a pattern, so the others meet no shuffle
    possible = F.rlike("text", F.lit(r"@|\+[0-9]|[0-9][\x20.-]?[0-9]"))
    done = keyed.filter(possible).join(marks, "row_key", "left").withColumn("clean", F.when(F.col("marks").isNotNull(), _masked(F.col("text"), F.col("marks"))).otherwise(F.col(f"row.{text_col}")))
    out = done.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns])
    return keyed.filter(~possible).select("row.*").unionByName(out)


def op2(spark, sf_dir: str) -> DataFrame:
    return spans(documents(spark, sf_dir))
