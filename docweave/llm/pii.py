"""Personal data in documents: patterns for entities, and terms that give entities away.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. An entity that several unlike
texts hold is protected as a value: the corpus shows which words occur beside it, and a word t discloses the
entity e as far as its pointwise mutual information reaches e's information content,
``log2(N n(e,t) / (n(e) n(t))) / log2(N / n(e))``. Words above the threshold are spans too, in the documents that
hold the entity. Near copies would make all their words disclosures, so a pair needs several texts that differ
in their least shingle.

Any entity, also one of a single text, is held against the words near it: the chance of the entity given such a word
is counted over all documents and smoothed by ``PRIOR`` observations of what the word tells of the entity's kind, so
that ``log2(P(e|t) N / n(e)) / log2(N / n(e))`` needs no least number of texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import let, table, written
from docweave.llm.decontamination import shingle_hashes, words_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LEAST_TEXTS = 3
THRESHOLD = 0.8
REMOVE_FROM = 0.95
# Characters before and after an entity whose words are near it, and the weight of what a word tells of the kind.
NEAR_CHARS = 100
PRIOR = 1.0
BROADCAST_ROWS = 100_000
BROADCAST_TERMS = 1_000_000

# The patterns of the kinds, with possessive repeats so that no text can make them backtrack. An
# e-mail address starts where its run of characters does, or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            digit = F.substring(d, i, F.lit(1)).cast("int")
            doubled = F.when((F.length(d) - i) % 2 == 1, F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)).otherwise(digit)
            return s + doubled

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(digits, lambda d: total(d) % 10 == 0)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"),
        "card": n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
    }[kind]


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of all matches, leftmost and non-overlapping, in code points: what lies between them gives their places."""

    def place(m: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(s: Column, i: Column) -> Column:
            value = F.get(m["found"], i)
            span = let(
                s["at"] + F.length(F.get(m["between"], i)),
                lambda start: F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")),
            )
            return let(span, lambda e: F.struct(e["end"].alias("at"), F.concat(s["out"], F.array(e)).alias("out")))

        return F.when(F.size(m["found"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m["found"]) - 1), first, step, lambda s: s["out"]))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.coalesce(let(both, place), F.array().cast(f"array<{SPAN}>"))


def entity_spans(text: Column) -> Column:
    """All valid entities of a text, by kind, then by place."""

    def of_kind(t: Column, kind: str) -> Column:
        found = F.filter(matches(t, F.lit(PATTERNS[kind]), kind), lambda s: _valid(kind, s["value"]))
        return F.when(_may_hold(kind, t), found).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.coalesce(text, F.lit("")), lambda t: F.concat(*[of_kind(t, kind) for kind in KINDS]))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of all spans; what follows them keeps its place."""

    def blank(t: Column, ordered: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(s: Column, p: Column) -> Column:
            start = F.greatest(p["start"], s["at"])
            between = F.substring(t, s["at"] + 1, start - s["at"])
            return F.struct(F.greatest(p["end"], s["at"]).alias("at"), F.concat(s["out"], between, F.repeat(F.lit(" "), p["end"] - start)).alias("out"))

        return F.aggregate(ordered, first, step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))))

    return blank(text, F.array_sort(spans, lambda a, b: a["start"] - b["start"]))


def _terms(masked: Column) -> Column:
    """Distinct words outside all entities."""
    return F.array_distinct(words_of(masked))


def _near_terms(masked: Column, span: Column, chars: int) -> Column:
    """Distinct whole words among ``chars`` characters on either side of the span."""
    start = F.greatest(span["start"] - chars - 1, F.lit(0))
    before = F.substring(masked, start + 1, span["start"] - start)
    before = F.when(start > 0, F.regexp_replace(before, r"^[\p{L}\p{N}]++", "")).otherwise(before)
    # A word that the last character belongs to goes on behind it, unless the text ends there.
    after = F.substring(masked, span["end"] + 1, F.lit(chars + 1))
    after = F.when(F.length(after) > chars, F.regexp_replace(after, r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++$", "")).otherwise(after)
    return F.array_distinct(words_of(F.concat(before, F.lit(" "), after)))


def _least_shingle(text: Column) -> Column:
    return F.coalesce(F.array_min(shingle_hashes(words_of(text), 5)), F.xxhash64(text))


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, sent to all tasks if it is counted small."""
    return F.broadcast(df) if df.count() <= rows else df


def _of_terms(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, with_term): how many rows hold each of the candidates."""
    words = rows.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    if candidates.count() <= BROADCAST_TERMS:
        words = words.join(F.broadcast(candidates), "term", "left_semi")
        return words.groupBy("term").agg(F.count("*").alias("with_term"))
    return words.groupBy("term").agg(F.count("*").alias("with_term")).join(candidates, "term", "left_semi")


def disclosing_terms(
    rows: DataFrame, found: DataFrame, least_texts: int = LEAST_TEXTS, threshold: float = THRESHOLD, chars: int = NEAR_CHARS, prior: float = PRIOR
) -> DataFrame:
    """(entity, term, disclosure) of all terms whose disclosure reaches ``threshold``.

    ``rows`` are (text_key, text), a digest and the text; ``found`` has the entity spans of those with any. All
    rows count for the frequencies. Words anywhere in the texts of an entity are rated by plain counts if
    ``least_texts`` unlike texts hold both; words within ``chars`` characters of an entity always are, by smoothed
    counts. The higher value counts.
    """
    entity = F.transform("found", _entity)
    hold = written(found.select("text_key", F.explode(F.array_distinct(entity)).alias("entity")).distinct(), "holders")
    # The texts with entities: how often each occurs, and what is near its entities.
    keys = written(found.select("text_key").distinct(), "holding-keys")
    holding = written(rows.join(_small(keys), "text_key", "left_semi"), "holding", "zstd")
    weights = _small(written(holding.groupBy("text_key").agg(F.count("*").alias("copies")), "weights"))
    single = holding.dropDuplicates(["text_key"]).join(_small(found), "text_key")
    single = written(single.select("text_key", "text", "found", _masked(F.col("text"), F.col("found")).alias("masked")), "holding-texts", "zstd")
    spans = single.select("text_key", "masked", F.explode("found").alias("s"))
    near = spans.select("text_key", _entity(F.col("s")).alias("entity"), F.col("s.kind").alias("kind"), F.explode(_near_terms(F.col("masked"), F.col("s"), chars)).alias("term"))
    near = written(near.distinct().join(weights, "text_key"), "near")

    # Words anywhere in the texts of entities that several texts hold, with the least shingle that near copies share.
    frequent = hold.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= least_texts).select("entity")
    pairs = written(hold.join(_small(written(frequent, "frequent")), "entity"), "shared")
    shared = single.join(_small(written(pairs.select("text_key").distinct(), "shared-keys")), "text_key", "left_semi")
    texts = shared.select("text_key", _least_shingle(F.col("text")).alias("unlike"), _terms(F.col("masked")).alias("terms"))
    texts = written(texts, "shared-texts")
    counted = texts.join(weights, "text_key").select("text_key", "unlike", "copies", F.explode("terms").alias("term"))
    joint = pairs.join(counted, "text_key").groupBy("entity", "term").agg(F.sum("copies").alias("joint"), F.count_distinct("unlike").alias("support"))
    joint = written(joint.filter(F.col("support") >= least_texts).select("entity", "term", "joint"), "joint")

    candidates = written(joint.select("term").union(near.select("term")).distinct(), "candidates")
    of_term = written(_of_terms(rows, candidates), "of-term")
    of_term = F.broadcast(of_term) if of_term.count() <= BROADCAST_TERMS else of_term
    of_entity = _small(written(hold.join(weights, "text_key").groupBy("entity").agg(F.sum("copies").alias("with_entity")), "of-entity"))
    kinds = hold.select("text_key", F.split_part("entity", F.lit(":"), F.lit(1)).alias("kind")).distinct()
    of_kind = F.broadcast(written(kinds.join(weights, "text_key").groupBy("kind").agg(F.sum("copies").alias("with_kind")), "of-kind"))
    n = F.lit(float(max(rows.count(), 2)))
    own = F.greatest(F.log2(n / F.col("with_entity")), F.lit(1e-9))

    plain = joint.join(of_entity, "entity").join(of_term, "term")
    plain = plain.select("entity", "term", (F.log2(n * F.col("joint") / (F.col("with_entity") * F.col("with_term"))) / own).alias("disclosure"))
    beside = near.groupBy("entity", "kind", "term").agg(F.sum("copies").alias("joint"))
    kind_terms = near.select("text_key", "kind", "term", "copies").distinct().groupBy("kind", "term").agg(F.sum("copies").alias("kind_joint"))
    told = kind_terms.join(of_kind, "kind").join(of_term, "term")
    of_kind_given = (F.col("kind_joint") + prior * F.col("with_kind") / n) / (F.col("with_term") + prior)
    told = written(told.select("kind", "term", "with_kind", "with_term", of_kind_given.alias("kind_given")), "kind-terms")
    told = F.broadcast(told) if told.count() <= BROADCAST_TERMS else told
    smoothed = beside.join(told, ["kind", "term"]).join(of_entity, "entity")
    given = (F.col("joint") + prior * F.col("kind_given") * F.col("with_entity") / F.col("with_kind")) / (F.col("with_term") + prior)
    smoothed = smoothed.select("entity", "term", (F.log2(given * n / F.col("with_entity")) / own).alias("disclosure"))
    rated = plain.union(smoothed).filter(F.col("disclosure") >= threshold)
    return written(rated.groupBy("entity", "term").agg(F.max("disclosure").alias("disclosure")), "disclosing")


def term_spans(rows: DataFrame, found: DataFrame, terms: DataFrame, remove_from: float = REMOVE_FROM) -> DataFrame:
    """(text_key, terms): spans of disclosing terms in the texts that hold their entity, clear of entity spans.

    A span's value says what becomes of the term: ``remove``, or ``generalise`` where it discloses less.
    """
    strongest = F.max("disclosure").alias("disclosure")
    hold = found.select("text_key", F.explode(F.array_distinct(F.transform("found", _entity))).alias("entity"))
    told = hold.distinct().join(_small(terms), "entity").groupBy("text_key", "term").agg(strongest)
    strong = F.col("disclosure") >= remove_from
    listed = told.groupBy("text_key").agg(
        F.sort_array(F.collect_list(F.when(strong, F.col("term")))).alias("strong"), F.sort_array(F.collect_list(F.when(~strong, F.col("term")))).alias("weak")
    )
    listed = _small(written(listed, "told"))
    texts = rows.join(listed, "text_key").dropDuplicates(["text_key"]).join(_small(found), "text_key")

    def spans(column: str, action: str) -> Column:
        choice = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(column, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        found = F.when(F.size(column) > 0, matches(F.col("text"), choice, TERM)).otherwise(F.array().cast(f"array<{SPAN}>"))
        clear = F.filter(found, lambda s: ~F.exists("found", lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"])))
        return F.transform(clear, lambda s: s.withField("value", F.lit(action)))

    both = F.array_sort(F.concat(spans("strong", "remove"), spans("weak", "generalise")), lambda a, b: a["start"] - b["start"])
    return written(texts.select("text_key", both.alias("terms")), "term-spans")


def private_spans(docs: DataFrame, text_column: str = "text", least_texts: int = LEAST_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_terms``, arrays of spans (kind, start, end, value); same-named columns are replaced.

    A null text counts as empty and has no spans. Repeated rows and null ids are rows like others.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.md5(text).alias("text_key"), text.alias("text"))
    likely = rows.filter(reduce(Column.__or__, [_may_hold(kind, F.col("text")) for kind in KINDS]))
    spans = likely.select("text_key", entity_spans(F.col("text")).alias("found")).filter(F.size("found") > 0)
    found = written(spans.dropDuplicates(["text_key"]), "entities")
    told = term_spans(rows, found, disclosing_terms(rows, found, least_texts, threshold))
    spans = found.join(told, "text_key", "left")
    spans = _small(written(spans.toDF("pii_key", "pii_base", "pii_terms"), "spans"))
    none = F.array().cast(f"array<{SPAN}>")
    kept = [c for c in docs.columns if c not in ("pii_base", "pii_terms")]
    keyed = docs.select(*kept, F.md5(text).alias("pii_own_key"))
    joined = keyed.join(spans, F.col("pii_own_key") == F.col("pii_key"), "left")
    return joined.select(*kept, F.coalesce("pii_base", none).alias("pii_base"), F.coalesce("pii_terms", none).alias("pii_terms"))


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with entities and weaker terms generalised to their kind in brackets and stronger terms removed."""

    def replace(t: Column, ordered: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(s: Column, p: Column) -> Column:
            tag = F.when((p["kind"] == TERM) & (p["value"] == "remove"), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]")))
            extended = F.concat(s["out"], F.substring(t, s["at"] + 1, p["start"] - s["at"]), tag)
            overlapping = p["start"] < s["at"]
            return F.struct(F.greatest(p["end"], s["at"]).alias("at"), F.when(overlapping, s["out"]).otherwise(extended).alias("out"))

        return F.aggregate(ordered, first, step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))))

    by_place = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    return F.when(F.size(spans) > 0, replace(text, by_place)).otherwise(text)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with counts, digest and places of the personal data found in them."""
    found = private_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [_count(kind) for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.concat("pii_base", "pii_terms")).alias("spans")
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
