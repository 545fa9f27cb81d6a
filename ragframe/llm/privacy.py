"""Operator 8: personal data, and sanitisation by information content; DataFrame functions only.

Base detectors find e-mail addresses, network addresses, card and telephone numbers with their places. Sanitisation follows
Sanchez and Batet: a term discloses a protected entity where their pointwise mutual information, estimated from the corpus, comes
near the entity's information content. An entity is one address or number as it was found, in a normal form. Co-occurrence is
counted over contexts: runs of some dozens of terms and entities of a line, so that a long line gives no more pairs than its length.
In a context that holds an entity, terms that disclose it are generalised (to names or words) or, where they disclose nearly all,
removed.

Nothing here grows faster than a text: places are running sums in two levels (scan), a line's items are cut once, and spans meet
their texts by a digest of the text, which no rerun of a lost task changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that a long run costs no more than its length: a run is entered at its start alone (or where the
# match before ended), and given up whole. They find what [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and the others find.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text may have a match.
HINTS = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?+){15}[0-9]", "phone": r"\+[0-9]"}


#: What a line without entities is cut into beside its letters, where it may have some: a number of a kind, or any other characters.
TOKEN = "|".join([PATTERNS["phone"], PATTERNS["ip"], PATTERNS["card"], r"\p{L}++", r"[^\p{L}0-9+]++", r"[\s\S]"])
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Settings:
    #: A term discloses an entity where PMI(entity; term) >= IC(entity) / alpha.
    alpha: float = 1.25
    #: At this share of IC and above the term is removed; below, it is generalised.
    remove_share: float = 0.95
    #: Terms and entities of a context.
    context: int = 50
    #: Letters of a term.
    least_letters: int = 2
    #: Places that the spans of a text are dealt over, since a text may be copied without bound.
    copies: int = 16


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def runs(a: Column, size: int) -> Column:
    """An array cut into arrays of `size` items; none of an empty one."""
    n = F.size(a)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(a, i * size + 1, size))
    return F.when(n > 0, cuts).otherwise(F.slice(F.array(a), 1, 0))


def scan(a: Column, merge: Callable[[Column, Column], Column], size: int = 128) -> Column:
    """For each item of an array of int, what merge makes of all before it, from 0.

    Each run of items is folded alone from what the runs before it give: appending to a short array costs little, to a long one much.
    """
    zero = F.lit(0)

    def one(items: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda x, y: F.struct(merge(x["at"], y).alias("at"), F.concat(x["out"], F.array(x["at"])).alias("out"))
        return F.aggregate(items, state, step, lambda x: x["out"])

    return let(runs(a, size), lambda r: F.flatten(F.zip_with(r, one(F.transform(r, lambda x: F.aggregate(x, zero, merge)), zero), one)))


def running(lengths: Column) -> Column:
    """Where each item begins when items of these lengths lie end to end."""
    return let(lengths, lambda x: scan(x, lambda a, b: a + b))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _valid(kind: str, m: Column) -> Column:
    """Whether a match passes its kind's test."""
    if kind == "ip":
        # leading zeros don't count; a part of over three other digits is over 255
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        d = _digits(m)
        luhn = F.aggregate(
            F.sequence(F.lit(1), F.length(d)),
            F.lit(0),
            lambda a, i: a + F.when(i % 2 == 1, F.substring(d, -i, F.lit(1)).cast("int")).otherwise(F.substring(d, -i, F.lit(1)).cast("int") * 2 - F.when(F.substring(d, -i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
        )
        return F.when(F.length(d).between(16, 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Spans (kind, start, end) of the valid matches: places add up from the lengths of matches and of what lies between them."""

    def places(x: Column) -> Column:
        between = F.slice(x["between"], 1, F.size(x["found"]))
        begins = running(F.zip_with(between, x["found"], lambda b, m: F.length(b) + F.length(m)))
        starts = F.zip_with(begins, between, lambda i, b: i + F.length(b))
        span = lambda m, i: F.when(_valid(kind, m), F.struct(F.lit(kind).alias("kind"), i.alias("start"), (i + F.length(m)).alias("end")))
        return F.filter(F.zip_with(x["found"], starts, span), lambda v: v.isNotNull())

    cut_up = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"), F.split(text, PATTERNS[kind], -1).alias("between"))
    return F.when(text.rlike(HINTS[kind]), let(cut_up, places)).otherwise(F.array().cast(SPANS)).cast(SPANS)


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds s_email, s_ip, s_card and s_phone: spans in code points, end exclusive, leftmost and without overlap in each kind."""
    return df.select("*", *[_spans(F.col(text), k).alias(f"s_{k}") for k in KINDS])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _may(text: Column) -> Column:
    """A cheap test that a text or line may hold an entity."""
    some = F.lit(False)
    for k in KINDS:
        some = some | text.rlike(HINTS[k])
    return text.rlike("[@0-9]") & some


def _token_kind(t: Column) -> Column:
    number = F.when(t.rlike(r"^\+[0-9]"), F.when(_valid("phone", t), "phone")).when(t.rlike(r"^[0-9]+\."), F.when(_valid("ip", t), "ip")).otherwise(F.when(t.rlike("^[0-9]") & _valid("card", t), "card"))
    return F.when(t.rlike(r"^\p{L}"), "term").otherwise(number)


def _normal(kind: Column, t: Column) -> Column:
    """The same for all ways of writing an entity; terms in lower case."""
    return F.when(kind.isin("card", "phone"), _digits(t)).otherwise(F.lower(t))


def _items(line: Column) -> Column:
    """Terms and entities of a line in order: kind, value, start, end. A line is read once, e-mail addresses first."""

    def cut_up(x: Column) -> Column:
        inside = lambda b: F.transform(F.regexp_extract_all(b, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("t"), _token_kind(t).alias("k")))
        address = lambda m: F.when(m.isNotNull(), F.array(F.struct(m.alias("t"), F.lit("email").alias("k")))).otherwise(F.array().cast("array<struct<t:string,k:string>>"))
        return F.flatten(F.zip_with(x["between"], x["found"], lambda b, m: F.concat(inside(b), address(m))))

    def placed(tokens: Column) -> Column:
        item = lambda x, i: F.when(x["k"].isNotNull(), F.struct(x["k"].alias("kind"), _normal(x["k"], x["t"]).alias("value"), i.alias("start"), (i + F.length(x["t"])).alias("end")))
        return F.filter(F.zip_with(tokens, running(F.transform(tokens, lambda x: F.length(x["t"]))), item), lambda v: v.isNotNull())

    parts = F.struct(F.split(line, PATTERNS["email"], -1).alias("between"), F.regexp_extract_all(line, F.lit(PATTERNS["email"]), F.lit(0)).alias("found"))
    return let(let(parts, cut_up), placed)


def entity_contexts(docs: DataFrame, s: Settings, text: str) -> DataFrame:
    """key (digest of the text), entities (kind:value, distinct) and terms (value, start, end in the text) of each context of the lines
    that may hold an entity."""
    lines = docs.filter(_may(F.col(text))).select(F.md5(F.col(text).cast("binary")).alias("key"), F.split(text, "\n").alias("lines"))
    placed = F.zip_with("lines", running(F.transform("lines", lambda x: F.length(x) + 1)), lambda x, i: F.when(_may(x), F.struct(x.alias("line"), i.alias("begin"))))
    each = lines.select("key", F.explode(F.filter(placed, lambda x: x.isNotNull())).alias("x")).select("key", "x.line", "x.begin")
    contexts = each.select("key", "begin", F.explode(let(_items(F.col("line")), lambda i: runs(i, s.context))).alias("items"))
    own = F.array_distinct(F.transform(F.filter("items", lambda x: x["kind"] != "term"), lambda x: F.concat_ws(":", x["kind"], x["value"])))
    terms = F.transform(F.filter("items", lambda x: x["kind"] == "term"), lambda x: F.struct(x["value"].alias("value"), (x["start"] + F.col("begin")).alias("start"), (x["end"] + F.col("begin")).alias("end")))
    return contexts.select("key", own.alias("entities"), terms.alias("terms"))


def term_counts(docs: DataFrame, contexts: DataFrame, s: Settings, text: str) -> DataFrame:
    """term and n, the contexts that hold it; the empty term has the number of all contexts."""
    letters = lambda line: F.filter(F.split(F.lower(line), r"[^\p{L}]+"), lambda x: x != "")
    counted = lambda x: F.concat(F.array(F.lit("")), F.array_distinct(x))
    in_line = lambda t: F.when(F.size(t) == 0, t).when(F.size(t) <= s.context, counted(t)).otherwise(F.flatten(F.transform(runs(t, s.context), counted)))
    plain = F.filter(F.split(text, "\n"), lambda x: ~_may(x))
    rest = docs.select(F.explode(F.flatten(F.transform(plain, lambda x: let(letters(x), in_line)))).alias("term"))
    held = contexts.select(F.explode(counted(F.transform("terms", lambda x: x["value"]))).alias("term"))
    return rest.unionByName(held).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def disclosing_terms(docs: DataFrame, contexts: DataFrame, s: Settings, text: str) -> DataFrame:
    """entity, term and share (of the entity's information content) of the terms that disclose an entity of their context.

    With N contexts, PMI(e; t) = log2(N n(e,t) / (n(e) n(t))) and IC(e) = log2(N / n(e)). Every pair that meets is judged.
    """
    met = contexts.filter(F.size("entities") > 0)
    each = met.select(F.explode("entities").alias("entity"), F.array_distinct(F.transform("terms", lambda x: x["value"])).alias("terms"))
    entities = each.groupBy("entity").agg(F.count(F.lit(1)).alias("with"))
    pairs = each.select("entity", F.explode("terms").alias("term")).filter(F.length("term") >= s.least_letters).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    counts = term_counts(docs, contexts, s, text)
    # terms that meet no entity are never looked up; the number of contexts comes along as the empty term
    wanted = cut(counts.join(pairs.select("term").distinct().unionByName(counts.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi"))
    total = wanted.filter(F.col("term") == "").select(F.col("n").alias("all"))  # one row
    joined = pairs.join(wanted, "term").join(entities, "entity").join(F.broadcast(total), F.lit(True)).filter(F.col("with") < F.col("all"))
    pmi = F.log2(F.col("all") * F.col("both") / (F.col("with") * F.col("n")))
    return joined.select("entity", "term", (pmi / F.log2(F.col("all") / F.col("with"))).alias("share")).filter(F.col("share") >= 1 / s.alpha)


def extra_spans(docs: DataFrame, s: Settings, text: str) -> DataFrame:
    """key and extra: the spans that the method adds to a text, in order; a term that discloses several entities is one span."""
    contexts = cut(entity_contexts(docs, s, text))
    terms = disclosing_terms(docs, contexts, s, text)
    places = contexts.filter(F.size("entities") > 0).select("key", F.explode("entities").alias("entity"), "terms").select("key", "entity", F.explode("terms").alias("x"))
    places = places.select("key", "entity", F.col("x.value").alias("term"), "x.start", "x.end").distinct()
    one = places.join(terms, ["entity", "term"]).groupBy("key", "start", "end").agg(F.max("share").alias("share"))
    span = F.struct(F.when(F.col("share") >= s.remove_share, "removed").otherwise("generalised").alias("kind"), "start", "end")
    return one.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("extra"))


def personal_data(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (long), base_sha256, spans (kind:start:end, base kinds as listed, then `generalised` and
    `removed` terms) and clean_text: base spans are replaced by their kind in brackets, generalised terms by [NAME] (capitalised) or
    [WORD], and removed ones left out.

    Null is an empty text. Columns of docs with these names are replaced, others stay, whatever their names. Equal texts get equal
    spans, in every row; an empty table gives no rows and no terms. A corpus whose contexts all hold an entity tells nothing of it.
    """
    new = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean_text")
    names, at = docs.columns, docs.columns.index(text)
    # own columns have numbers in here, so that no name clashes
    df = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("t", F.coalesce(F.col(f"c{at}"), F.lit("")))
    extra = extra_spans(df.select("t"), s, "t").select("key", F.explode(F.sequence(F.lit(0), F.lit(s.copies - 1))).alias("salt"), "extra")
    found = with_base_spans(df, "t").withColumn("key", F.md5(F.col("t").cast("binary"))).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(s.copies)).cast("int"))
    out = found.join(extra, ["key", "salt"], "left").withColumn("base", F.concat(*[f"s_{k}" for k in KINDS]))
    out = out.withColumn("every", F.concat("base", F.coalesce("extra", F.array().cast(SPANS))))
    made = [F.size(f"s_{k}").cast("long") for k in KINDS]
    made += [F.sha2(_joined(F.col("base")), 256), _joined(F.col("every")), _replaced(F.col("t"), F.col("every"))]
    kept = [i for i, n in enumerate(names) if n not in new or i == at]
    return out.select(*[f"c{i}" for i in kept], *[x.alias(f"m{i}") for i, x in enumerate(made)]).toDF(*[names[i] for i in kept], *new)


def _replaced(text: Column, spans: Column, size: int = 64) -> Column:
    """The text with spans replaced; of spans that overlap, the one that begins first (the longer, if both do) stands for all.

    Each run of spans is cut from its own stretch of the text, whose beginning is sought once.
    """

    def mark(kind: Column, first: Column) -> Column:
        word = F.when(F.lower(first) == first, "[WORD]").otherwise("[NAME]")
        return F.when(kind == "removed", "").when(kind == "generalised", word).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))

    def stretch(own: Column) -> Column:
        first = F.get(own, F.lit(0))["from"]
        segment = F.substring(text, first + 1, F.element_at(own, -1)["start"] - first + 1)
        one = lambda seg, x: F.concat(F.substring(seg, x["from"] - first + 1, x["start"] - x["from"]), mark(x["kind"], F.substring(seg, x["start"] - first + 1, F.lit(1))))
        return let(segment, lambda seg: F.array_join(F.transform(own, lambda x: one(seg, x)), ""))

    def done(order: Column) -> Column:
        reach = let(F.transform(order, lambda x: -x["neg"]), lambda e: scan(e, lambda a, b: F.greatest(a, b)))
        led = F.filter(F.zip_with(order, reach, lambda x, r: F.struct(r.alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["from"])
        body = let(led, lambda x: F.array_join(F.transform(runs(x, size), stretch), ""))
        return F.concat(body, F.substring(text, F.array_max(F.transform(order, lambda x: -x["neg"])) + 1, F.length(text)))

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(order, done)).otherwise(text)
