"""Number reading, text normalisation and token overlap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermark.catalog.base import cents, query, scaled, table, text_of
from ledgermark.functions.numbers import (
    clean_num,
    decimals,
    expand_scaled_words,
    is_number,
    last_number,
    numbers_equal,
    percent_factor,
    round_n,
    sign_of,
    strip_digit_commas,
    to_number,
    word_scale,
)
from ledgermark.functions.scoring import answer_bags, bag_f1, bag_overlap, numbers_agree, round2, same_span_set
from ledgermark.functions.text import normalise_answer, ws_tokens


@query(
    """
WITH p AS (SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) * 10 + 3 AS t FROM part),
r AS (SELECT *, CASE p_size % 3 WHEN 0 THEN (t + 50) // 100 * 100 WHEN 1 THEN (t + 5) // 10 * 10 ELSE t END
              + CASE WHEN p_partkey % 5 = 0 THEN CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 10 ELSE 1 END ELSE 0 END AS ref FROM p),
d AS (SELECT *, CASE WHEN ref % 100 = 0 THEN 1 WHEN ref % 10 = 0 THEN 2 ELSE 3 END AS places FROM r)
SELECT p_partkey, places, CASE places WHEN 1 THEN (t + 50) // 100 * 100 WHEN 2 THEN (t + 5) // 10 * 10 ELSE t END = ref AS same,
       abs(t - ref) * 1000 <= greatest(t, ref) OR CASE places WHEN 1 THEN (t + 50) // 100 * 100 WHEN 2 THEN (t + 5) // 10 * 10 ELSE t END = ref AS close,
       (t + 50) // 100 AS tenths
FROM d"""
)
def finqa_equal(spark, sf_dir):
    """NUM-1, NUM-2, NUM-3: prices against themselves at fewer decimals, some one step off.

    Prices get a third decimal of 3, so no rounding meets an exact tie.
    """
    t = cents("p_retailprice") * 10 + 3
    step = F.when(F.col("p_size") % 3 == 0, F.lit(100)).when(F.col("p_size") % 3 == 1, F.lit(10)).otherwise(F.lit(1))
    off = F.when(F.col("p_partkey") % 5 == 0, step).otherwise(F.lit(0))
    ref = F.floor((F.col("t") + F.floor(step / 2)) / step) * step + off
    rows = table(spark, sf_dir, "part").withColumn("t", t).withColumn("ref", ref.cast("double") / 1000)
    pred = F.col("t").cast("double") / 1000
    return rows.select(
        "p_partkey",
        decimals("ref").alias("places"),
        numbers_equal(pred, "ref").alias("same"),
        numbers_equal(pred, "ref", is_close=True).alias("close"),
        scaled(round_n(pred, 1), 10).alias("tenths"),
    )


@query(
    """
WITH c AS (SELECT c_custkey, c_nationkey, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS c, c_custkey % 6 AS form FROM customer)
SELECT c_custkey,
  CASE form WHEN 0 THEN ' ' || (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') || ' million'
            WHEN 1 THEN (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0')
            WHEN 2 THEN (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0')
            WHEN 3 THEN '-' || (c // 100) || ' thousand'
            WHEN 4 THEN (c // 100) || ' of ' || c_nationkey ELSE 'no figure' END AS cleaned,
  form < 4 AS numeric,
  (CASE form WHEN 3 THEN -(c // 100) * 100 WHEN 4 THEN c_nationkey * 100 WHEN 5 THEN NULL ELSE c END)::VARCHAR AS last_cents,
  (CASE form WHEN 0 THEN c * 100000000 WHEN 1 THEN -c * 100 WHEN 2 THEN c WHEN 3 THEN -(c // 100) * 10000000
            WHEN 4 THEN c_nationkey * 10000 END)::VARCHAR AS value_e4,
  CASE form WHEN 1 THEN -1 ELSE 1 END AS sign,
  (CASE form WHEN 0 THEN 1000000 WHEN 3 THEN 1000 ELSE 1 END)::BIGINT AS scale,
  (CASE form WHEN 2 THEN 1 ELSE 100 END)::BIGINT AS percent_e2
FROM c"""
)
def number_parse(spark, sf_dir):
    """NUM-4..11: balances written out in six ways and read back."""
    c, whole = F.abs(cents("c_acctbal")), F.floor(F.abs(cents("c_acctbal")) / 100)
    part = F.lpad((c % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    form = F.col("c_custkey") % 6
    text = (
        F.when(form == 0, text_of("$ ", grouped, ".", part, " million"))
        .when(form == 1, text_of("(", whole, ".", part, ")"))
        .when(form == 2, text_of(whole, ".", part, "%"))
        .when(form == 3, text_of("-", grouped, " thousand"))
        .when(form == 4, text_of(grouped, " of ", F.col("c_nationkey")))
        .otherwise(F.lit("no figure"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("t")).select(
        "c_custkey",
        clean_num("t").alias("cleaned"),
        is_number("t").alias("numeric"),
        scaled(last_number("t"), 100).cast("string").alias("last_cents"),
        scaled(to_number("t"), 10000).cast("string").alias("value_e4"),
        sign_of("t").alias("sign"),
        word_scale("t").cast("bigint").alias("scale"),
        scaled(percent_factor("t"), 100).alias("percent_e2"),
    )


@query(
    """
SELECT s_suppkey,
  'cash of ' || (s_suppkey * 1000000 + s_nationkey * 10000) || ', debt of ' || (1000 + s_suppkey) || '000000000 and 1' || lpad(s_nationkey::VARCHAR, 3, '0') || ' staff' AS expanded,
  'cash of ' || s_suppkey || '.' || lpad(s_nationkey::VARCHAR, 2, '0') || ' million, debt of ' || (1000 + s_suppkey) || ' billion and 1' || lpad(s_nationkey::VARCHAR, 3, '0') || ' staff' AS plain
FROM supplier"""
)
def expand_scaled(spark, sf_dir):
    """NUM-12, NUM-13: scaled words written as digits."""
    text = text_of(
        "cash of ", F.col("s_suppkey"), ".", F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), " million, debt of ",
        F.format_number(F.col("s_suppkey") + 1000, 0), " billion and 1,", F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), " staff",
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("t"))
    return rows.select("s_suppkey", expand_scaled_words("t").alias("expanded"), strip_digit_commas("t").alias("plain"))


# The same rules token by token. \\x01 fences off words, because \\b sees ASCII letters only there.
_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
_CLEAN = "translate(t, '''\"\\$€£¥%(),[]', '')"
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_WORDS = f"list_filter(string_split_regex({_CLEAN}, '\\s+'), lambda w: w <> '')"
_LAST = rf"list_last(regexp_extract_all({_CLEAN}, '[+-]?\d+(?:\.\d+)?|[+-]?\.\d+'))"


def normalised_sql(text: str) -> str:
    """SQL for STR-7. Only tokens without a scale word are covered, as in the corpus."""
    negative = rf"regexp_matches(t, '\([\d.\s]+\)')"
    percent = rf"regexp_matches(t, '[\d.\s]%')"
    value = f"round(CAST({_LAST} AS DOUBLE) * CASE WHEN {negative} THEN -1 ELSE 1 END * CASE WHEN {percent} THEN 0.01::DOUBLE ELSE 1 END, 4)"
    number = (
        f"CASE WHEN starts_with(ltrim({_LAST}, '+-'), '.') THEN t "
        f"WHEN contains({_LAST}, '.') OR {percent} THEN CAST({value} AS VARCHAR) "
        f"ELSE CASE WHEN (starts_with({_LAST}, '-') <> {negative}) AND ltrim({_LAST}, '+-0') <> '' THEN '-' ELSE '' END "
        f"|| CASE WHEN ltrim({_LAST}, '+-0') = '' THEN '0' ELSE ltrim({_LAST}, '+-0') END END"
    )
    token = (
        f"CASE WHEN regexp_matches(t, '\\d') AND len({_WORDS}) = 1 AND regexp_matches({_WORDS}[1], '{_FLOAT}') "
        f"THEN {number} ELSE translate(t, {_PUNCT}, '') END"
    )
    joined = f"array_to_string(list_transform(string_split(lower({text}), ' '), lambda t: {token}), ' ')"
    fenced = rf"regexp_replace({joined}, '([\pL\pN_]+)', chr(1) || '\1' || chr(1), 'g')"
    bare = f"regexp_replace(regexp_replace({fenced}, chr(1) || '(a|an|the)' || chr(1), ' ', 'g'), chr(1), '', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


def ws_tokens_sql(text: str) -> str:
    """SQL for STR-8."""
    marks = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~‘’´]"""
    squeezed = rf"trim(regexp_replace(lower({text}), '\s+', ' ', 'g'))"
    each = f"regexp_replace(regexp_replace(w, '^{marks}+', ''), '{marks}+$', '')"
    return f"list_transform(string_split({squeezed}, ' '), lambda w: {each})"


_CORPUS_SQL = "SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'b' || item_id AS id, text FROM benchmark"


@query(
    f"""
SELECT id, md5({normalised_sql("text")}) AS normalised_md5, length({normalised_sql("text")})::BIGINT AS normalised_chars,
       len({ws_tokens_sql("text")})::BIGINT AS words, md5(array_to_string({ws_tokens_sql("text")}, ' ')) AS words_md5
FROM ({_CORPUS_SQL})"""
)
def normalise_text(spark, sf_dir):
    """STR-1..8 over every document and benchmark item, whole."""
    documents = table(spark, sf_dir, "documents").select(text_of("d", F.col("doc_id")).alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(text_of("b", F.col("item_id")).alias("id"), "text")
    corpus = documents.unionAll(items)
    done = corpus.select("id", normalise_answer("text").alias("n"), ws_tokens("text").alias("w"))
    return done.select(
        "id",
        F.md5("n").alias("normalised_md5"),
        F.length("n").cast("bigint").alias("normalised_chars"),
        F.size("w").cast("bigint").alias("words"),
        F.md5(F.array_join("w", " ")).alias("words_md5"),
    )


def _bag_sql(norm: str) -> str:
    return f"list_distinct(list_filter(string_split({norm}, ' '), lambda w: w <> ''))"


@query(
    f"""
WITH d AS (SELECT doc_id, {_bag_sql(normalised_sql("text"))} AS b FROM documents),
i AS (SELECT item_id, {_bag_sql(normalised_sql("text"))} AS b FROM benchmark),
j AS (SELECT doc_id, item_id, len(list_intersect(d.b, i.b))::DOUBLE AS n, len(d.b)::DOUBLE AS nd, len(i.b)::DOUBLE AS ni,
             list_filter(i.b, lambda w: regexp_matches(w, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?$')) AS gold_numbers, d.b AS b
      FROM d JOIN i ON doc_id % (SELECT count(*) FROM benchmark) = item_id),
f AS (SELECT *, CASE WHEN nd = 0 THEN 1.0::DOUBLE ELSE n / nd END AS p, CASE WHEN ni = 0 THEN 1.0::DOUBLE ELSE n / ni END AS r FROM j)
SELECT doc_id, item_id, n::BIGINT AS overlap, nd::BIGINT AS doc_words, ni::BIGINT AS item_words,
       round_even(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * p * r / (p + r) END * 100, 0)::BIGINT AS f1_pct,
       n = nd AND n = ni AS same, len(gold_numbers) = 0 OR list_has_any(gold_numbers, b) AS numbers_agree
FROM f"""
)
def token_f1(spark, sf_dir):
    """SCO-1, SCO-2, SCO-4, SET-2, SET-3: every document against a benchmark item.

    The documents go round all items. Each side is normalised once, before the
    join, which adaptive execution broadcasts or splits by size.
    """
    n_items = table(spark, sf_dir, "benchmark").count()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") % n_items).alias("item_id"), F.get(answer_bags(F.array("text"))["bags"], F.lit(0)).alias("db")
    )
    items = table(spark, sf_dir, "benchmark").select(
        "item_id", F.get(answer_bags(F.array("text"))["bags"], F.lit(0)).alias("ib")
    )
    pairs = docs.join(items, "item_id")
    return pairs.select(
        "doc_id",
        "item_id",
        bag_overlap("db", "ib").cast("bigint").alias("overlap"),
        F.size("db").cast("bigint").alias("doc_words"),
        F.size("ib").cast("bigint").alias("item_words"),
        scaled(round2(bag_f1("db", "ib")), 100).alias("f1_pct"),
        same_span_set("db", "ib").alias("same"),
        numbers_agree("ib", "db").alias("numbers_agree"),
    )
