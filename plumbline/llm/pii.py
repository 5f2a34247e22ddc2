"""Personal data and information-theoretic sanitisation, in DataFrame functions alone.

Base spans come from four patterns whose matches are checked (numbers of at most 255, Luhn digits, digit counts). The
positions follow from splitting a text at its matches: a match starts where the pieces and matches before it end.

Terms that reveal a protected entity are found from the whole corpus. The unit of all counts is a distinct document
text, so that copies do not count twice; a term t and an entity e meet in a document when a line holds both, however far
apart. t discloses e when their pointwise mutual information reaches the information content of e but for ``SLACK``
bits, which is p(e|t) >= 2^-SLACK (the count of e cancels out), in ``SUPPORT`` distinct documents at least. A term that is
common elsewhere never qualifies: t and e meet in no more documents than e has, so only entities of ``SUPPORT`` documents
and terms of at most 2^SLACK times the documents of an entity on their line are paired, which loses nothing.
Occurrences of disclosing terms become spans of kind ``term``; ``sanitise`` generalises every span to its kind.

Running positions along a text are folded in blocks of about the square root of the number of matches, so that a text of
many matches costs little more than its length.

The patterns keep to possessive loops and anchored starts, so that long runs neither overflow the stack nor cost
quadratic time; they match what the plain patterns match.

Defined results: a null or empty text has no spans; spans of different kinds may overlap; repeated rows are judged each
for itself; a null ``doc_id`` keeps its base spans and gets term spans like any other row; extra columns pass through
``sanitise`` and are left out of ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import restored, set_aside, written

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}{3,}"
KINDS = ("email", "ip", "card", "phone")
#: Distinct documents in which a term and an entity must meet.
SUPPORT = 3
#: Bits that the mutual information may lack to the entity's information content.
SLACK = 1
#: What every text with a base span holds.
HINT = r"@|[0-9]\.[0-9]|[0-9][\x20-]?[0-9]|\+[0-9]"
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
STATE = "struct<at:bigint,spans:" + SPAN + ">"
#: Matches that are folded in one go.
BLOCK = 64


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid_ip(match: Column) -> Column:
    """Four parts of at most 255; leading zeros do not count."""
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid_card(match: Column) -> Column:
    own = digits(match)
    each = F.transform(F.filter(F.split(F.reverse(own), ""), lambda c: c != ""), lambda c, i: luhn(c.cast("int"), i))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.length(own).between(13, 19) & (F.when(F.length(own).between(13, 19), total).otherwise(1) % 10 == 0)


def luhn(digit: Column, place: Column) -> Column:
    double = digit * 2
    return F.when(place % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(digit)


def valid_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


CHECKS = {"email": (EMAIL, lambda m: F.lit(True)), "ip": (IP, valid_ip), "card": (CARD, valid_card), "phone": (PHONE, valid_phone)}


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_blocks(items: Column, total, combine, each) -> Column:
    """``each(start, block)`` for consecutive blocks of an array; ``start`` combines the totals of the blocks before."""

    def own(xs: Column) -> Column:
        size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(xs)))).cast("int")
        ids = F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / size).cast("int"))
        return let(F.transform(ids, lambda i: F.slice(xs, i * size + 1, size)), starting)

    def starting(blocks: Column) -> Column:
        kind = "struct<at:bigint,before:array<bigint>>"
        zero = F.struct(F.lit(0).alias("at"), F.array().alias("before")).cast(kind)
        step = lambda s, b: F.struct(combine(s["at"], total(b)).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")).cast(kind)
        return F.zip_with(F.aggregate(blocks, zero, step, lambda s: s["before"]), blocks, each)

    return let(items, own)


def located(text: Column, pattern: str, kind: str, accept) -> Column:
    """Spans of the accepted matches, in order; positions in code points, end exclusive."""
    none = F.array().cast(SPAN)

    def width(state: Column, pair: Column) -> Column:
        return state + F.length(pair["gap"]) + F.length(pair["match"])

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        own = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))
        spans = F.when(accept(pair["match"]), F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans")).cast(STATE)

    def block(start: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, F.struct(start.alias("at"), none.alias("spans")).cast(STATE), step, lambda s: s["spans"])

    def of(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        found = in_blocks(pairs, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), width), lambda x, y: x + y, block)
        return F.when(F.size(matches) > 0, F.flatten(found)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base``: the checked spans of the four kinds, by kind and start."""
    own = F.coalesce(F.col(text), F.lit(""))
    kinds = [F.when(own.rlike(hint), located(own, *CHECKS[k][:1], k, CHECKS[k][1])).otherwise(F.array().cast(SPAN)) for k, hint in zip(KINDS, ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]"), strict=True)]
    return docs.withColumn("base", F.concat(*kinds))


def key_of(text: str) -> Column:
    """A digest that names a text."""
    return F.md5(F.col(text).cast("binary")).alias("_key")


def words(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def disclosing(docs: DataFrame, text: str = "text", support: int = SUPPORT, slack: int = SLACK) -> DataFrame:
    """Terms (``term``) whose presence gives away a protected entity, from all documents."""
    texts = docs.where(F.col(text).isNotNull()).groupBy(key_of(text)).agg(F.any_value(text).alias("text"))
    texts = written(texts, "pii-texts")
    lines = texts.where(F.col("text").rlike(HINT)).select("_key", F.posexplode(F.split("text", "\n")).alias("at", "line"))  # no span holds a line break
    lines = lines.where(F.col("line").rlike(HINT))
    spans = with_base(lines, "line").select("_key", "at", "line", F.explode("base").alias("span"))
    entity = F.substring("line", F.col("span.start").cast("int") + 1, (F.col("span.end") - F.col("span.start")).cast("int"))
    held = written(spans.select("_key", "at", entity.alias("entity")).distinct(), "pii-entities")
    known = held.groupBy("entity").agg(F.count_distinct("_key").alias("held")).where(F.col("held") >= support)
    hits = written(held.join(known, "entity"), "pii-hits")
    if hits.isEmpty():
        return hits.select(F.col("entity").alias("term"))
    places = hits.groupBy("_key", "at").agg(F.max("held").alias("most"))
    told = lines.join(places, ["_key", "at"]).select("_key", "at", "most", F.explode(words(F.col("line"))).alias("term"))
    counts = texts.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= support)
    rare = told.join(counts, "term").where(F.col("docs") <= F.col("most") * (1 << slack))
    met = rare.join(hits, ["_key", "at"]).where((F.col("docs") <= F.col("held") * (1 << slack)) & ~F.contains(F.lower("entity"), F.col("term")))
    pairs = met.select("_key", "entity", "term", "docs").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n"), F.any_value("docs").alias("docs"))
    return written(pairs.where((F.col("n") >= support) & (F.col("n") * (1 << slack) >= F.col("docs"))).select("term").distinct(), "pii-terms")


def with_spans(docs: DataFrame, text: str = "text", support: int = SUPPORT, slack: int = SLACK) -> DataFrame:
    """Add ``base`` and ``spans`` (the base spans, then spans of disclosing terms)."""
    based = with_base(docs, text)
    terms = disclosing(docs, text, support, slack)
    if terms.isEmpty():
        return based.withColumn("spans", F.col("base"))
    places = docs.select(text, key_of(text)).select("_key", F.explode(words(F.col(text))).alias("term")).join(terms, "term")
    places = written(places.groupBy("_key").agg(F.collect_set("term").alias("_terms")), "pii-places")  # at most a text's words
    joined = based.withColumn("_key", key_of(text)).join(places, "_key", "left")
    own = located(F.col(text), WORD, "term", lambda m: F.array_contains(F.col("_terms"), F.lower(m)))
    spans = F.when(F.col("_terms").isNotNull(), F.concat("base", own)).otherwise(F.col("base"))
    return joined.withColumn("spans", spans).drop("_key", "_terms")


def generalised(spanned: DataFrame, spans: str, text: str = "text") -> DataFrame:
    """Replace each span by its kind in brackets; of overlapping spans the first names the kind and all are covered."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def furthest(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("bigint"), lambda a, s: F.greatest(a, s["end"]))

    def piece(start: Column, block: Column) -> Column:
        """The text from where the blocks before end to where this one ends, its spans replaced."""
        return let(F.substring(F.col(text), start.cast("int") + 1, (F.greatest(start, furthest(block)) - start).cast("int")), lambda own: replaced(own, start, block))

    def replaced(own: Column, start: Column, block: Column) -> Column:
        def step(state: Column, span: Column) -> Column:
            before = F.substring(own, (state["at"] - start).cast("int") + 1, (span["start"] - state["at"]).cast("int"))
            out = F.when(span["start"] >= state["at"], F.concat(state["out"], before, F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

    pieces = F.array_join(in_blocks(ordered, furthest, F.greatest, piece), "")
    rest = F.substring(F.col(text), F.array_max(F.transform(spans, lambda s: s["end"])).cast("int") + 1, F.length(text))
    return spanned.withColumn(text, F.when(F.size(spans) > 0, F.concat(pieces, rest)).otherwise(F.col(text)))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts with every span generalised to its kind in brackets; ``n_chars``, if there, follows the new text.

    A second look finds what only the removal of a neighbour has turned into a match.
    """
    once = generalised(with_spans(set_aside(docs, text), text), "spans", text).drop("base", "spans")
    out = restored(generalised(with_base(once, text), "base", text), docs, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7(docs: DataFrame) -> DataFrame:
    out = with_spans(docs.select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
