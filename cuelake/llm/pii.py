r"""Personal data: exact patterns, and terms that give a protected entity away.

Patterns find the protected entities (e-mail and IP addresses, card and phone numbers). A term of a text that
mentions an entity discloses it as far as the corpus says so: its pointwise mutual information with the entity,
log2 of df(entity, term) N / (df(entity) df(term)), as a share of the information that the entity's own name
carries, log2 of N / df(entity). All four numbers count whole texts, equal texts once. From GENERALISE on a term is
generalised, from REMOVE on it is removed, everywhere in the texts that mention the entity. DataFrame functions alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, read_table

#: kind -> pattern, leftmost and not overlapping. They match what the plain forms match,
#:   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)   [0-9]([\x20-]?[0-9])+   \+[0-9][\x20().0-9-]+[0-9]
#: but never go back into a run that can't match, so that long runs take linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
TERM = r"[\p{L}\p{N}]{3,}+"
#: Shares of an entity's information, and the different texts in which term and entity must meet: a single meeting is no
#: evidence, since every rare word of a text would then disclose whatever the text mentions once.
GENERALISE, REMOVE, SUPPORT = 0.8, 0.98, 2
#: Up to this many rows and bytes a table of terms or texts is broadcast; beyond either, it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20
#: Characters of a piece of a text, from which parts are cut: a cut never counts characters from the beginning of the text.
PIECE = 4096

_PLACES = "array<struct<s:int,e:int,text:string>>"


def _passes(kind: str) -> Callable[[Column], Column]:
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        return lambda x: F.forall(F.split(x, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(part, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return lambda x: let(digits(x), lambda d: F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False)))
    if kind == "phone":
        return lambda x: F.length(digits(x)).between(9, 15)
    return lambda x: x.isNotNull()


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of ints under step (a sum, a maximum).

    Arrays grow by copying, so totals are taken in blocks as long as the blocks are many: n elements cost n to the
    power 1.5 copies, and those of a few thousand no more than a scan.
    """
    none = F.array().cast("array<int>")
    onto = lambda total, x: F.when(total.isNull(), x).otherwise(step(total, x))
    grow = lambda acc, x: F.concat(acc, F.array(onto(F.try_element_at(acc, F.lit(-1)), x)))

    def in_blocks(of: Column) -> Column:
        length = F.ceil(F.sqrt(F.size(of))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(of) / length).cast("int") - 1), lambda b: F.aggregate(F.slice(of, b * length + 1, length), none, grow))
        total = lambda blocks: F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), none, grow)
        joined = lambda blocks: let(total(blocks), lambda t: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: step(F.get(t, F.greatest(i - 1, F.lit(0))), x))))))
        return let(cut, joined)

    return let(values, lambda of: F.when(F.size(of) == 0, none).otherwise(in_blocks(of)))


def places(text: Column, pattern: str, passes: Callable[[Column], Column]) -> Column:
    """array of (s, e, text) of the pattern's matches that pass; code points, end exclusive."""
    none = F.array().cast(_PLACES)

    def placed(matches: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda gap, m: gap + F.length(m)), lambda a, b: a + b)
        each = F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("text")))
        return F.filter(each, lambda x: passes(x["text"]))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.exists(m, passes), placed(m)).otherwise(none))


def base_places(text: Column, kind: str) -> Column:
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
    found = places(text, PATTERNS[kind], _passes(kind))
    return found if gate is None else F.when(gate, found).otherwise(F.array().cast(_PLACES))


def _merged(spans: Column) -> Column:
    """Sorted spans (s, e, label), overlapping ones made one; the first gives the label."""

    def joined(of: Column, reach: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | (F.get(of, i)["s"] >= F.get(reach, F.greatest(i - 1, F.lit(0)))))
        last = lambda all_, k: F.coalesce(F.get(all_, k + 1), F.size(of)) - 1
        return let(opens, lambda all_: F.transform(all_, lambda i, k: F.struct(F.get(of, i)["s"].alias("s"), F.get(reach, last(all_, k)).alias("e"), F.get(of, i)["label"].alias("label"))))

    ends = lambda of: running(F.transform(of, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    return let(spans, lambda of: F.when(F.size(of) == 0, of).otherwise(let(ends(of), lambda reach: joined(of, reach))))


def _replaced(text: Column, merged: Column, label: Callable[[Column], Column]) -> Column:
    """The text with label(span) for every one of the merged spans; there is at least one."""

    def between(pieces: Column, start: Column, stop: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
        head = F.substring(F.get(pieces, first), start % PIECE + 1, F.least(stop - first * PIECE, F.lit(PIECE)) - start % PIECE)
        middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.when(last > first, F.substring(F.get(pieces, last), F.lit(1), stop % PIECE)).otherwise("")
        return F.concat(F.coalesce(head, F.lit("")), middle, F.coalesce(tail, F.lit("")))

    def rebuilt(spans: Column, pieces: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, F.greatest(i - 1, F.lit(0)))["e"])
        parts = F.transform(spans, lambda x, i: F.concat(between(pieces, before(i), x["s"]), label(x)))
        return F.concat(F.array_join(parts, ""), between(pieces, F.element_at(spans, -1)["e"], F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(merged, lambda spans: let(pieces, lambda p: rebuilt(spans, p)))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _entity(kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.regexp_replace(F.lower(text), "[ ().-]", "") if kind in ("card", "phone") else F.lower(text))


def _base(text: Column) -> Column:
    return let(F.struct(*[base_places(text, k).alias(k) for k in PATTERNS]), lambda x: x)


def _spans(found: Column, label: Callable[[str], Column]) -> list[Column]:
    return [F.transform(found[k], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), label(k).alias("label"))) for k in PATTERNS]


def _blanked(text: Column, base: Column) -> Column:
    """The text with every character of a base span a blank."""

    def blank(spans: Column) -> Column:
        return F.when(F.size(spans) == 0, text).otherwise(_replaced(text, _merged(spans), lambda x: F.repeat(F.lit(" "), x["e"] - x["s"])))

    return let(F.array_sort(F.concat(*_spans(base, lambda _: F.lit("")))), blank)


def _terms(text: Column) -> Column:
    """The different terms of a text, in lower case, what base spans hold apart."""
    return F.array_distinct(F.transform(F.regexp_extract_all(let(_base(text), lambda x: _blanked(text, x)), F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))


def _bytes(name: str, kind: str) -> Column:
    """Of a column's value: strings as they are, a map of strings by its keys and 16 an entry, anything else 8."""
    if kind == "string":
        return F.octet_length(name)
    if kind.startswith("map<string"):
        return F.aggregate(F.map_keys(name), F.lit(0).cast("long"), lambda total, k: total + F.octet_length(k) + 16)
    return F.lit(8)


def _sent(table: DataFrame) -> DataFrame:
    row = sum((F.coalesce(_bytes(c, kind), F.lit(0)).cast("long") for c, kind in table.dtypes), F.lit(0))
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def _texts() -> Column:
    """The set of different texts that a group's rows name, as two hashes of 64 bits and their number: what comes in the same texts is one class."""
    return F.struct(*[F.bit_xor(F.xxhash64("text_hash", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)], F.count("*").alias("n"))


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per different text: text_hash, n (how often it comes), entities (array): a table of the shared folder."""
    rows = docs.select(F.xxhash64(_text(text_col)).alias("text_hash"), _base(_text(text_col)).alias("x"))
    names = F.array_distinct(F.concat(*[F.transform(F.col("x")[k], lambda p: _entity(k, p["text"])) for k in PATTERNS]))
    each = rows.select("text_hash", names.alias("entities")).groupBy("text_hash").agg(F.count("*").alias("n"), F.first("entities").alias("entities"))
    return materialize(each, "mentions")


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """text_hash, term, share: of each text the terms that disclose an entity which it mentions, with the greatest share.

    found: as mentions() gives it. An entity counts from `support` texts on. With share >= GENERALISE, df(term) is at most
    N ** (1 - GENERALISE) * df(entity) ** GENERALISE: commoner terms are dropped before any pair is made, which loses none.
    A text of n entities and n terms makes no n * n pairs where it is the most crowded one of its entities, or where they
    come in the same texts: a directory and its copies, say.
    """
    total = float(found.count())
    named = found.select("text_hash", F.explode("entities").alias("entity"))
    # entities of the same texts have the same numbers, and so have terms: one of each class stands for all
    classes = named.groupBy("entity").agg(_texts().alias("class")).filter(F.col("class.n") >= support)
    shared = named.join(classes, "entity").select("text_hash", F.col("class").alias("entity"), F.col("class.n").alias("df_entity")).distinct()
    shared = materialize(shared, "shared-entities")
    if shared.isEmpty():
        return shared.select("text_hash", F.lit("").alias("term"), F.lit(0.0).alias("share"))
    at = materialize(shared.groupBy("text_hash").agg(F.max("df_entity").alias("most"), F.count("*").alias("held")), "sharing-texts")
    text_hash = F.xxhash64(_text(text_col)).alias("text_hash")
    sharing = docs.select(text_hash, _text(text_col).alias("text")).join(_sent(at.select("text_hash", "most")), "text_hash")
    terms = sharing.select("text_hash", "most", F.explode(_terms(F.col("text"))).alias("term")).distinct()
    terms = materialize(terms, "terms")
    candidates = terms.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("most"), _texts().alias("texts")).filter(F.col("n") >= support)
    candidates = materialize(candidates.select("term", "most", "texts"), "candidate-terms")
    # every copy of a text counts by its share of the copies, so that the text counts once
    copies = materialize(found.filter("n > 1").select("text_hash", "n"), "copied-texts")
    every = docs.select(text_hash, _terms(_text(text_col)).alias("terms")).join(_sent(copies), "text_hash", "left").select(F.explode("terms").alias("term"), (1 / F.coalesce("n", F.lit(1))).alias("part"))
    # counted before they are joined: what moves is a row a term and task
    of_term = every.groupBy("term").agg(F.round(F.sum("part")).alias("df_term")).join(_sent(candidates), "term")
    bound = lambda df: F.pow(F.lit(total), F.lit(1 - GENERALISE)) * F.pow(df.cast("double"), F.lit(GENERALISE)) * 1.000001
    rare = materialize(of_term.filter(F.col("df_term") <= bound(F.col("most"))).select("term", F.struct("df_term", "texts").alias("like")), "rare-terms")
    held = materialize(terms.select("text_hash", "term").join(_sent(rare), "term").select("text_hash", "term", "like"), "held-terms")
    kinds = materialize(held.select("text_hash", "like").distinct(), "held-classes")
    # what meets in two texts meets in another than the entity's most crowded one, so that text makes no pairs: it is looked up
    crowded = shared.join(at.select("text_hash", "held"), "text_hash").groupBy("entity").agg(F.max(F.struct("held", "text_hash")).alias("last")).select("entity", F.col("last.text_hash").alias("last"))
    rows = shared.join(crowded, "entity").withColumn("last", F.when(F.lit(support > 1), F.col("last")))
    makes = rows.filter(~F.col("text_hash").eqNullSafe(F.col("last")))
    close = F.col("like.df_term") <= bound(F.col("df_entity"))
    met = materialize(makes.join(kinds, "text_hash").filter(close).groupBy("entity", "like", "df_entity", "last").agg(F.count("*").alias("n")), "met-classes")
    also = kinds.select(F.col("text_hash").alias("last"), "like", F.lit(1).alias("also"))
    pairs = met.join(also, ["last", "like"], "left").withColumn("df_pair", F.col("n") + F.coalesce("also", F.lit(0))).filter(F.col("df_pair") >= support)
    carried = F.log2(F.lit(total) / F.col("df_entity"))
    mutual = F.log2(F.col("df_pair") * F.lit(total) / (F.col("df_entity").cast("double") * F.col("like.df_term")))
    share = F.when(carried > 0, mutual / carried).otherwise(0.0)
    flagged = pairs.select("entity", "like", "last", "also", share.alias("share")).filter(F.col("share") >= GENERALISE)
    flagged = materialize(flagged, "disclosing-pairs")
    # the texts of a pair: those that made it, and the entity's most crowded one if it holds the term
    made = makes.select("text_hash", "entity").join(kinds, "text_hash").join(flagged.select("entity", "like", "share"), ["entity", "like"]).select("text_hash", "like", "share")
    looked = flagged.filter("also = 1").select(F.col("last").alias("text_hash"), "like", "share")
    most = made.unionByName(looked).groupBy("text_hash", "like").agg(F.max("share").alias("share"))
    return held.join(most, ["text_hash", "like"]).select("text_hash", "term", "share")


def _flagged(docs: DataFrame, text_col: str, support: int) -> DataFrame:
    """text_hash, flagged: term -> whether it is removed; a row for every text that holds such a term."""
    found = mentions(docs, text_col)
    terms = disclosing_terms(docs, found, text_col, support)
    each = terms.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", (F.col("share") >= REMOVE).alias("remove")))).alias("flagged"))
    return materialize(each, "flagged-terms")


def _with_places(docs: DataFrame, text_col: str, support: int) -> DataFrame:
    """__row (all columns of docs), __text (never null), text_hash, __base, __terms (s, e, text, remove): what there is to replace."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(row.alias("__row"), _text(text_col).alias("__text"), F.xxhash64(_text(text_col)).alias("text_hash"))
    rows = rows.join(_sent(_flagged(docs, text_col, support)), "text_hash", "left").withColumn("__base", _base(F.col("__text")))
    rows = rows.withColumn("__blanked", F.when(F.col("flagged").isNotNull(), _blanked(F.col("__text"), F.col("__base"))).otherwise(""))
    each = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["text"]).alias("text"), F.element_at("flagged", F.lower(x["text"])).alias("remove"))
    found = F.transform(places(F.col("__blanked"), TERM, lambda x: x.isNotNull()), each)
    return rows.withColumn("__terms", F.filter(found, lambda x: x["remove"].isNotNull())).drop("__blanked", "flagged")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """One row per row of docs: id, text_hash, places per kind, and terms: array of (s, e, text, remove).

    A null text is an empty one and has no spans. Equal texts, repeated rows among them, are one text in the statistics
    and have equal spans; ids play no part, so they may be null or repeated. Extra columns are not read. A text whose
    entities no other text mentions keeps every term. An empty table gives no rows.
    """
    rows = _with_places(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", support)
    return rows.select(F.col("__row.id").alias(id_col), "text_hash", "__base.*", F.col("__terms").alias("terms"))


def _written(kinds: tuple[str, ...]) -> Column:
    written = lambda k: F.transform(F.col("terms" if k == "term" else k), lambda x: F.concat_ws(":", F.lit(k), x["s"], x["e"]))
    return F.array_join(F.concat(*map(written, kinds)), ",")


def _ordered(base: Column, terms: Column) -> Column:
    """Base spans with their labels, and terms with a general word or nothing; of spans that begin together the longer one leads."""
    general = F.transform(terms, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["remove"], "").when(x["text"].rlike(r"^[0-9]+$"), "[NUMBER]").otherwise("[TERM]").alias("label")))
    return F.array_sort(F.concat(*_spans(base, lambda k: F.lit(LABELS[k])), general), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, support: int = SUPPORT) -> DataFrame:
    """docs with text_col sanitised, columns and rows as they were; a null text stays null. length_col, if given, becomes the new length.

    Texts are handled where they lie: what is joined to them is the short table of texts that hold a disclosing term.
    Nulls, repeated rows, empty tables and other columns as in find(); id_col is not read.
    """
    rows = _with_places(docs, text_col, support).select("__row", "__text", _ordered(F.col("__base"), F.col("__terms")).alias("__spans"))
    rows = rows.withColumn("__merged", _merged(F.col("__spans")))
    clean = F.when(F.size("__merged") == 0, F.col("__text")).otherwise(_replaced(F.col("__text"), F.col("__merged"), lambda x: x["label"]))
    clean = F.when(F.col(f"__row.`{text_col}`").isNotNull(), clean)
    new = {text_col: F.col("__new")} | ({length_col: F.length("__new").cast(docs.schema[length_col].dataType)} if length_col else {})
    return rows.select("__row", clean.alias("__new")).select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_written(tuple(PATTERNS)), 256).alias("base_sha256"), _written(KINDS).alias("spans"))
