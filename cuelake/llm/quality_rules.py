"""Quality rules: a ledger of measurements and failure bits, judged afterwards by versioned policies.

Every rule is evaluated once a document; its outcome is one bit. A policy is a mask of the bits
that reject, so a change of policy, or its ablation, reads the ledger and never the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, read_table, words_of

#: Words in a window of the repeated-words measurement.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: name -> (bit, condition of failure over the measurements).
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_words": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "4 * n_symbols > n_words"),
    "repeated_lines": (3, "2 * n_dup_lines > n_lines AND n_dup_lines > 3"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
}
#: version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask_of(policy: str) -> int:
    return sum(1 << RULES[rule][0] for rule in POLICIES[policy])


def _repeated_words(words: Column) -> Column:
    """How many words lie in a window that the text holds twice or more. Windows are told apart by XXH64."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))

    def windows(pair: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(pair, i + k) for k in range(0, WINDOW, 2)]))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda n, x: n + x)

    def twice(ranked: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        kept = F.filter(ranked, lambda x, i: same(x, F.get(ranked, i + 1)) | ((i > 0) & same(x, F.get(ranked, F.greatest(i - 1, F.lit(0))))))
        return let(F.array_sort(F.transform(kept, lambda x: x["i"])), covered)

    def count(hs: Column) -> Column:
        ranked = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ranked, twice))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(pairs, windows), count))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, the measurements (long) and failed_rules, the bits of the rules it fails.

    A null text is an empty one: no words, so it fails few_words and, having nothing to repeat, no other rule.
    Rows are judged one by one, so repeated rows give repeated results and an empty table gives none.
    Columns of docs other than the two named are not read and cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated_words(w).alias("n_repeat_words"))
    by_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    measured = docs.select(
        F.col(id_col),
        let(words_of(text), by_words).alias("w"),
        let(lines, by_lines).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
    ).select(id_col, *[F.col(c).cast("long").alias(c) for c in ("w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")])
    measured = measured.toDF(id_col, *MEASURES)
    bits = sum((F.when(F.expr(failed), 1 << bit).otherwise(0) for bit, failed in RULES.values()), F.lit(0))
    return measured.withColumn("failed_rules", bits.cast("long"))


def judge(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Add kept: whether no rule of the policy rejects the row of the ledger."""
    return rows.withColumn("kept", F.col("failed_rules").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows it fails, rows that it alone rejects, rows kept without it. From the bits alone."""
    mask = mask_of(policy)
    hit = F.col("failed_rules").bitwiseAND(F.lit(mask))
    by_bits = rows.groupBy(hit.alias("bits")).agg(F.count("*").alias("n"))
    rules = by_bits.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).alias("bit")) for r in POLICIES[policy]])).alias("x")).select("bits", "n", "x.*")
    has = rules["bits"].bitwiseAND(rules["bit"]) != 0
    alone = rules["bits"] == rules["bit"]
    return rules.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_rejected_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, columns unchanged."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    return judge(ledger(packed, "row", "text"), policy).filter("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(materialize(ledger(read_table(spark, sf_dir, "documents")), "quality-ledger"))
    base = F.col("failed_rules").bitwiseAND(F.lit(mask_of("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failed_rules")


_BITS = " + ".join(f"CASE WHEN {failed} THEN {1 << bit} ELSE 0 END" for bit, failed in RULES.values())
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
),
ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)
),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_rules & {mask_of("base")}) <> 0 AS base_failed, (failed_rules & {mask_of("v1")}) = 0 AS kept, n_lines, failed_rules
FROM b
"""
