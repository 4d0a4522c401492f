"""Personal data: fixed patterns, and terms that disclose a protected entity.

The entities are the values the patterns find. Terms are runs of four or more letters and digits. For
each term t that shares a text with entity e the corpus gives the share of e's information that t
reveals: log2(P(e|t) / P(e)) / log2(1 / P(e)), from document frequencies over all documents. Pairs that
reach ``GENERALISE`` and occur in ``SUPPORT`` different texts mark the term wherever it stands, also in
texts that do not write the entity out; from ``REMOVE`` on the term is to be removed, not generalised.

Everything is DataFrame operations. Document frequencies are summed before they are shuffled. Exact copies
of a text are one row with a weight before terms meet entities, and entities of fewer than ``SUPPORT``
texts go before, which loses no pair. Positions of terms are looked for in texts that hold one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import joined, let, matches, replace_spans, with_text
from riskpanel.session import materialize

#: Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone", "term")
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The contract's patterns in forms that read a text once. A match may begin at the end of the one before
#: it (\G) or where the run of its first class begins; elsewhere inside a run it could only fail again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9][0-9\x20-]+"
#: A dot that no domain label follows; it may stand in a local part only, as the underscore may.
LOOSE_DOT = r"\.(?![A-Za-z0-9-])"
#: A blank or hyphen that does not part two digits.
LOOSE_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

TERM = r"[\p{L}\p{N}]{4,}"
NO_TERM = r"[^\p{L}\p{N}\uE000]+"
#: Stands for what a span covers, so that a term that touches a span is not taken for a whole one.
COVER = "\uE000"
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
SPAN = "array<struct<place:int,start:int,end:int,kind:string,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether a digit string's checksum, each second digit from the right doubled, is a multiple of ten."""

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, at, F.lit(1)).cast("int")
        twice = digit * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when((F.length(digits) - at) % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def spans_of(text: Column, kind: str, pattern: str, gate: Column, keep, value) -> Column:
    found = F.filter(matches(text, pattern), lambda m: keep(m["text"]))
    shaped = F.transform(found, lambda m: F.struct(
        F.lit(KINDS.index(kind)).alias("place"), m["start"].alias("start"), m["end"].alias("end"),
        F.lit(kind).alias("kind"), value(m["text"]).alias("value"),
    ))
    return F.when(gate, shaped).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind its spans in ``text``, which must not be null, in order."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    card = lambda m: F.length(digits(m)).between(13, 19) & luhn(digits(m))
    return {
        "email": spans_of(F.regexp_replace(text, LOOSE_DOT, "_"), "email", EMAIL, F.contains(text, F.lit("@")),
                          lambda m: F.lit(True), F.lower),
        "ip": spans_of(text, "ip", IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
                       lambda m: F.regexp_like(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$")), lambda m: m),
        "card": spans_of(F.regexp_replace(text, LOOSE_SEPARATOR, "x"), "card", CARD,
                         F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), card, digits),
        "phone": spans_of(text, "phone", PHONE, F.contains(text, F.lit("+")),
                          lambda m: F.length(digits(m)).between(9, 15), digits),
    }


def terms_of(text: Column) -> Column:
    """The different terms of ``text`` in lower case, without those that ``COVER`` touches."""
    whole = F.filter(F.split(text, NO_TERM, -1), lambda w: (F.length(w) >= 4) & ~F.contains(w, F.lit(COVER)))
    return F.array_distinct(F.transform(whole, F.lower))


def uncovered(text: Column) -> Column:
    """``text`` with blanks for its own ``COVER`` signs."""
    return F.translate(text, COVER, " ")


def all_spans(found: Column) -> Column:
    return F.concat(*[found[k] for k in KINDS[:4]])


def mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, key, found, entities, terms``: spans by kind for each row, and for rows with spans their
    entities and the terms that no span overlaps; written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id", text.alias("text"), F.struct(*[s.alias(k) for k, s in base_spans(text).items()]).alias("found")
    )
    spans = all_spans(F.col("found"))
    covers = F.array_sort(F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(COVER).alias("mark"))
    ))
    entities = F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["value"])))
    has = F.size(spans) > 0
    return materialize(found.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("key"), "found", F.when(has, entities).alias("entities"),
        F.when(has, terms_of(replace_spans(uncovered(F.col("text")), covers))).alias("terms"),
    ), "pii-mentions")


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``term, disclosed``: terms that give an entity away, with the largest share of one."""
    texts = materialize(found.where("entities is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")
    ), "pii-texts")
    written = texts.select("key", "copies", F.explode("entities").alias("entity"))
    entities = materialize(
        written.groupBy("entity").agg(F.sum("copies").alias("entity_docs"), F.count("*").alias("texts"))
        .where(F.col("texts") >= SUPPORT).drop("texts"), "pii-entities"
    )
    often = written.join(entities, "entity", "left_semi").groupBy("key").agg(F.collect_list("entity").alias("often"))
    pairs = (
        texts.select("key", "copies", "terms").join(often, "key")
        .select("copies", "often", F.explode("terms").alias("term"))
        .select("copies", "term", F.explode("often").alias("entity"))
        .groupBy("entity", "term").agg(F.sum("copies").alias("pair_docs"), F.count("*").alias("texts"))
        .where(F.col("texts") >= SUPPORT)
    )
    whole = docs.select(F.count("*").alias("all_docs"))
    corpus = docs.select(F.explode(terms_of(uncovered(F.col("text")))).alias("term")).groupBy("term").agg(
        F.count("*").alias("term_docs"))
    pairs = pairs.join(entities, "entity").join(corpus, "term").join(F.broadcast(whole))
    told = F.log2(F.col("pair_docs") / F.col("term_docs") * F.col("all_docs") / F.col("entity_docs"))
    share = F.when(F.col("entity_docs") < F.col("all_docs"), told / F.log2(F.col("all_docs") / F.col("entity_docs")))
    return materialize(
        pairs.select("term", share.alias("disclosed")).where(F.col("disclosed") >= GENERALISE)
        .groupBy("term").agg(F.max("disclosed").alias("disclosed")), "pii-strong"
    )


def places(text: Column, spans: Column, strong: Column) -> Column:
    """Where terms of ``strong``, an array of term and share, stand in ``text`` and no span overlaps them."""
    known = F.struct(
        F.map_from_entries(strong).alias("shares"), spans.alias("spans"), F.zip_with(
            F.split(text, TERM, -1), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)),
            lambda gap, term: F.struct(F.length(gap).alias("gap"), F.coalesce(term, F.lit("")).alias("term")),
        ).alias("pieces"))

    def marked(both: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            start = state["at"] + piece["gap"]
            end = start + F.length(piece["term"])
            share = F.element_at(both["shares"], F.lower(piece["term"]))
            free = ~F.exists(both["spans"], lambda o: (o["start"] < end) & (start < o["end"]))
            one = F.struct(
                F.lit(4).alias("place"), start.alias("start"), end.alias("end"), F.lit("term").alias("kind"), share.alias("disclosed")
            )
            kept = F.when(share.isNotNull() & free, F.concat(state["out"], F.array(one))).otherwise(state["out"])
            return F.struct(end.alias("at"), kept.alias("out"))

        none = F.expr("cast(array() as array<struct<place:int,start:int,end:int,kind:string,disclosed:double>>)")
        return F.aggregate(both["pieces"], F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])

    return let(known, marked)


def with_terms(docs: DataFrame) -> DataFrame:
    """:func:`mentions` with ``terms``, the disclosing places of each row in order (null if none)."""
    found = mentions(docs)
    strong = disclosing(docs, found)
    texts = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("key"), "text")
    held = texts.select("key", F.explode(terms_of(uncovered(F.col("text")))).alias("term")).join(strong, "term")
    holders = materialize(held.groupBy("key").agg(F.collect_set(F.struct("term", "disclosed")).alias("strong")), "pii-holders")
    hit = texts.join(holders, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("strong").alias("strong"))
    hit = hit.select("key", "text", "strong", F.struct(*[s.alias(k) for k, s in base_spans(F.col("text")).items()]).alias("found"))
    terms = materialize(
        hit.select("key", places(F.col("text"), all_spans(F.col("found")), F.col("strong")).alias("terms"))
        .where(F.size("terms") > 0), "pii-terms"
    )
    return found.drop("terms", "entities").join(terms, "key", "left")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term`` for each row of ``docs``.

    Null and empty texts have no spans. Repeated rows and null ids stay as they are, and copies of a
    text get the same spans. An empty table gives no rows. Columns other than id and text are not read.
    """
    found = F.col("found")
    base = F.concat(*[found[k] for k in KINDS[:4]])
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    terms = F.coalesce(plain(F.col("terms")), F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))
    return with_terms(docs).select(
        "doc_id",
        *[F.size(found[k]).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(plain(base), terms)).alias("spans"),
        F.size(terms).cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced by their kind, and the terms that
    disclose most removed. Rows are matched by their text, so copies are treated alike; a null text stays.
    """
    marked = with_terms(docs).where((F.size(all_spans(F.col("found"))) > 0) | F.col("terms").isNotNull()).groupBy("key").agg(
        F.first("found").alias("found"), F.first("terms").alias("terms")
    )
    base = F.transform(
        F.concat(*[F.col("found")[k] for k in KINDS[:4]]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark")),
    )
    terms = F.transform(
        F.coalesce("terms", F.expr("cast(array() as array<struct<place:int,start:int,end:int,kind:string,disclosed:double>>)")),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosed"] >= REMOVE, "").otherwise("[TERM]").alias("mark")),
    )
    marked = materialize(marked.select(F.col("key").alias("__key"), F.array_sort(F.concat(base, terms)).alias("__marks")), "pii-marks")
    rows = docs.withColumn("__key", F.md5(F.col("text").cast("binary"))).join(marked, "__key", "left")
    text = F.when(F.col("__marks").isNull(), F.col("text")).otherwise(replace_spans(F.col("text"), F.col("__marks")))
    return with_text(rows, text).select(*docs.columns)
