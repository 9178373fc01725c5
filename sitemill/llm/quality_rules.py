"""Quality rules by document, shrunk by host: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm.common import BLANKS, let, read, shared_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A host is turned away where the shrunk rate of any one rule is above this.
MAX_HOST_RATE = 0.8
#: A list of turned-away hosts up to this length is broadcast; a longer one is joined by a shuffle, whose skew Spark splits.
BROADCAST_HOSTS = 50_000


#: Bits of a packed long that hold a window's place; longer documents skip the packing.
_PLACE_BITS = 21


def _twins(packed: Column) -> Column:
    """The places of sorted packed longs whose upper bits equal a neighbour's."""
    high = lambda c: F.shiftright(c, _PLACE_BITS)
    kept = F.filter(
        packed,
        lambda r, k: ((k > 0) & (high(F.get(packed, k - 1)) == high(r))) | F.coalesce(high(F.get(packed, k + 1)) == high(r), F.lit(False)),
    )
    return F.transform(kept, lambda r: r.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int"))


def _covered(words: Column, places: Column) -> Column:
    """Of the 3-word windows at the places, those that occur twice or more as strings; how many words they cover.

    Words hold no blanks, so a blank joins them without doubt.
    """

    def starts(rows: Column) -> Column:
        twice = F.filter(
            rows,
            lambda r, k: ((k > 0) & (F.get(rows, k - 1)["w"] == r["w"])) | F.coalesce(F.get(rows, k + 1)["w"] == r["w"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda r: r["i"]))

    def widths(at: Column) -> Column:
        each = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    rows = F.transform(
        places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))
    )
    return let(let(F.sort_array(rows), starts), widths)


def _repeated(words: Column) -> Column:
    """How many words lie in a 3-word window that the array holds twice or more.

    A sort of hashes finds the few windows that may repeat; only these are compared as strings, so the count is exact.
    """
    last = F.size(words) - 3
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    packed = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(window(i), _PLACE_BITS).bitwiseOR(i.cast("long")))
    short = let(F.sort_array(packed), _twins)
    places = F.when(last < (1 << _PLACE_BITS), short).otherwise(F.sequence(F.lit(0), last))
    found = let(places, lambda at: F.when(F.size(at) > 0, _covered(words, at)).otherwise(F.lit(0)))
    return F.when(last >= 0, found).otherwise(F.lit(0))


def document_rules(docs: DataFrame) -> DataFrame:
    """One row per document: its id and host (source), five counts and whether a rule fails.

    A null text counts as one without words. Repeated rows are judged one by one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = let(
        F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+"))
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    measured = F.struct(
        let(
            words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words"))
        ).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).alias("n_symbols"),
    )
    out = docs.select("doc_id", F.col("source").alias("host"), F.inline(F.array(measured)))
    out = out.select(
        "doc_id", "host", F.col("w.n_words").cast("long").alias("n_words"), F.col("w.word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"), F.col("l.n_lines").cast("long").alias("n_lines"),
    )
    return out.withColumns(
        {
            "fails_short": F.col("n_words") < MIN_WORDS,
            "fails_repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
            "fails_symbols": 10 * F.col("n_symbols") > F.col("n_words"),
            "fails_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        }
    )


RULES = ("fails_short", "fails_repeats", "fails_symbols", "fails_lines")


def host_rates(rules: DataFrame) -> DataFrame:
    """One row per host: documents, and for each rule the failure rate shrunk by an empirical beta prior.

    The prior of a rule has the mean m and the variance v of the rates over hosts: a + b = m (1 - m) / v - 1, by moments, at least 1
    and at most a million; where all hosts agree it is a million, so that each host takes the mean. Rows without a host form none.
    """
    named = rules.filter(F.col("host").isNotNull())
    hosts = named.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(r).alias(r) for r in RULES])
    rate = {r: F.col(r) / F.col("n_docs") for r in RULES}
    prior = hosts.agg(*[x for r in RULES for x in (F.avg(rate[r]).alias(f"m_{r}"), F.coalesce(F.var_pop(rate[r]), F.lit(0.0)).alias(f"v_{r}"))])
    joined = hosts.crossJoin(F.broadcast(prior))  # the prior is a single row

    def shrunk(r: str) -> Column:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(v > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(F.lit(1e6))
        return ((F.col(r) + m * weight) / (F.col("n_docs") + weight)).alias(r.replace("fails_", "rate_"))

    return joined.select("host", "n_docs", *[shrunk(r) for r in RULES])


def judge(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """document_rules with base_failed, the host's worst shrunk rate and kept.

    The per-document measures are written once, since host rates and the join back both read them. Only hosts that are turned away
    are joined back. Documents without a host are judged alone; no rows give no rows.
    """
    rules = shared_table(document_rules(docs), "quality-rules")
    rates = host_rates(rules).select("host", F.greatest(*[r.replace("fails_", "rate_") for r in RULES]).alias("host_rate"))
    turned_away = shared_table(rates.filter(F.col("host_rate") > max_host_rate), "quality-hosts")
    if turned_away.count() <= BROADCAST_HOSTS:
        turned_away = F.broadcast(turned_away)
    out = rules.join(turned_away, "host", "left")
    failed = F.col("fails_short") | F.col("fails_repeats")
    return out.withColumns({"base_failed": failed, "kept": ~failed & F.col("host_rate").isNull()})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^ \t\n\v\f\r]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls FROM d),
g AS (SELECT doc_id, i, w.ws[i] || ' ' || w.ws[i + 1] || ' ' || w.ws[i + 2] AS g
      FROM w, unnest(generate_series(1, len(w.ws) - 2)) AS s(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(ws) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3, 10 * n_dup_lines > 3 * n_lines AS f4 FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, count_if(f1) AS c1, count_if(f2) AS c2, count_if(f3) AS c3, count_if(f4) AS c4 FROM f WHERE host IS NOT NULL GROUP BY host),
u AS (UNPIVOT h ON c1, c2, c3, c4 INTO NAME rule VALUE c),
p AS (SELECT rule, avg(c / n) AS mu, var_pop(c / n) AS v FROM u GROUP BY rule),
q AS (SELECT rule, mu, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, mu * (1 - mu) / v - 1)) ELSE 1e6 END AS k FROM p),
b AS (SELECT DISTINCT host FROM u JOIN q USING (rule) WHERE (c + mu * k) / (n + k) > 0.8)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND b.host IS NULL AS kept
FROM f LEFT JOIN b ON b.host = f.host
"""
