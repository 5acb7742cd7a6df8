"""Quality rules with host verdicts (operator 4), DataFrame functions only.

Per document the rules count words, symbols, repeated lines and words lying in
repeated word windows.  Rule failures are then aggregated by host, each host's
failure rate is shrunk towards the corpus by an empirical beta prior (moments
over hosts, without the noise within them), and the verdict on the host is joined back: a document of
a condemned host must also pass the stricter rules, elsewhere it need not.  A
document without any failure is kept whatever its host.

Everything of a document is computed in its row (no explode, no shuffle of
words); the only shuffle is the partial aggregation by host.  The features are
written once, so the texts are read once.

Edge cases: a null or empty text has no words and fails the base rules; a null
host is a host of its own; where all hosts have one document, nothing tells
hosts apart and each gets the corpus rate; repeated rows count and are returned one by one;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_bounded, materialize, table

# Fixed values of the contract.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# The stricter rules, in percent where not said otherwise.
STRICT_SYMBOL_PERCENT = 10
STRICT_REPEAT_PERCENT = 15
STRICT_DUP_LINES = 3
MAX_WORD_CHARS = 12
HOST_FAILURE_RATE = 0.5
MAX_BROADCAST_HOSTS = 100_000
# The prior.
PRIOR_ROUNDS = 4
EVEN_HOSTS = 10
MAX_RHO = 0.99
MAX_STRENGTH = 1e6


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, though used per element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    spaced = F.translate(text, "\t\n\u000b\u000c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _pairwise(hashes: Column, gap: int) -> Column:
    """Hash of each value with the one ``gap`` after it."""
    return _let(
        hashes,
        lambda h: F.when(F.size(h) <= gap, F.array().cast("array<bigint>")).otherwise(
            F.zip_with(
                F.slice(h, 1, F.greatest(F.size(h) - gap, F.lit(0))),
                F.slice(h, gap + 1, F.greatest(F.size(h) - gap, F.lit(0))),
                lambda a, b: F.xxhash64(a, b),
            )
        ),
    )


def window_hashes(words: Column) -> Column:
    """64-bit hash of each window of eight words, by doubling: 1, 2, 4, 8."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    return _pairwise(_pairwise(_pairwise(one, 1), 2), 4)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window found at least twice in the text."""

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(r: Column) -> Column:
            return F.array_sort(
                F.transform(
                    F.filter(
                        r,
                        lambda x, k: ((k > 0) & (F.get(r, k - 1)["h"] == x["h"]))
                        | ((k < F.size(r) - 1) & (F.get(r, k + 1)["h"] == x["h"])),
                    ),
                    lambda x: x["i"],
                )
            )

        return F.aggregate(
            _let(ranked, repeats),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct(
                (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")
            ),
            lambda acc: acc["n"],
        )

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def features(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\u000b\u000c\r", "")) > 0)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        F.length(F.translate(text, " \t\n\u000b\u000c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(
            words_of(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(window_hashes(w)).cast("long").alias("r")),
        ).alias("w"),
    ).select(
        "doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words")
    )


def rule_failures(rows: DataFrame) -> DataFrame:
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    strict = (
        (100 * F.col("n_symbols") > STRICT_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_repeat_words") > STRICT_REPEAT_PERCENT * n)
        | (F.col("n_dup_lines") >= STRICT_DUP_LINES)
        | (F.col("word_chars") > MAX_WORD_CHARS * n)
    )
    return rows.withColumn("base_failed", base).withColumn("failed", base | strict)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta of the hosts' failure rates (n_docs, n_failed), by moments.

    The spread of the raw rates also holds each host's binomial noise, so the
    noise that the hosts' sizes make expected is taken off; what is left, as a
    share of the variance of a single document, is the correlation rho within a
    host, and the prior's strength is 1 / rho - 1.  A host weighs n / (1 + rho
    (n - 1)), refined in ``PRIOR_ROUNDS`` rounds, so a hot host doesn't set the
    prior alone.  A spread that rests on few hosts of several documents is
    trusted less: ``EVEN_HOSTS`` hosts without spread count besides them.

    Each round is one row from a histogram of (n_docs, n_failed).
    """
    alike = materialize(hosts.groupBy("n_docs", "n_failed").agg(F.count("*").alias("hosts")), "quality-prior")
    n, h, rate = F.col("n_docs"), F.col("hosts"), F.col("n_failed") / F.col("n_docs")
    mean, rho = 0.0, 0.0
    for _ in range(PRIOR_ROUNDS):
        w = n / (1 + F.lit(rho) * (n - 1))
        sums = (h * w, h * w * rate, h * w * rate * rate, h * w * w, h * w / n, h * w * w / n, h * w * (1 - 1 / n), h * w * w * (1 - 1 / n) * (1 - 1 / n))
        weight, first, second, square, noise, noise_square, told, told_square = alike.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in sums)).first()
        if not weight:
            break
        mean = min(max(first / weight, 1e-6), 1 - 1e-6)
        noise, spread = noise - noise_square / weight, weight - square / weight
        rho = 0.0
        # Hosts of one document tell nothing of the spread between hosts.
        if spread - noise > 1e-9 * weight:
            seen = told * told / told_square
            rho = max(0.0, ((second - first * first / weight) / (mean * (1 - mean)) - noise) / (spread - noise)) * seen / (seen + EVEN_HOSTS)
        rho = min(rho, MAX_RHO)
    strength = min(1 / rho - 1, MAX_STRENGTH) if rho else MAX_STRENGTH
    return mean * strength, (1 - mean) * strength


def host_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = HOST_FAILURE_RATE,
) -> DataFrame:
    """Features, verdicts and the host's shrunk failure rate per document."""
    rows = rule_failures(materialize(features(docs, id_col, text_col, host_col), "quality-features"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
    hosts = materialize(hosts, "quality-hosts")
    alpha, beta = beta_prior(hosts)
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    condemned = hosts.select(F.col("host").alias("bad_host"), shrunk.alias("host_rate")).where(F.col("host_rate") > max_rate)
    joined = join_bounded(rows, condemned, F.col("host").eqNullSafe(F.col("bad_host")), "left", MAX_BROADCAST_HOSTS)
    condemned_host = F.col("host_rate").isNotNull()
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(~(condemned_host & F.col("failed"))).alias("kept"),
        condemned_host.alias("host_condemned"),
    )


def op4_host_quality(spark, sf_dir: str) -> DataFrame:
    return host_quality(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), n AS (
  SELECT *, len(w) AS n_words, row_number() OVER () AS rid FROM w
), win AS (
  SELECT rid, i, w[i:i + 7] AS k FROM n, unnest(range(1, n_words - 6)) AS u(i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + j) AS r FROM rep, unnest(range(8)) AS u(j) GROUP BY rid
), f AS (
  SELECT doc_id, host, n_words::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM n LEFT JOIN cov USING (rid)
), v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
), x AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_repeat_words > 15 * n_words
            OR n_dup_lines >= 3 OR word_chars > 12 * n_words AS failed FROM v
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM x GROUP BY host
), g0 AS (
  SELECT n, k, count(*) AS c, k / n AS p, 1 - 1 / n AS u FROM h GROUP BY n, k
), r0 AS (
  SELECT 0.0::DOUBLE AS rho, 0.0::DOUBLE AS mu
"""


def _prior_sql(i: int) -> str:
    """One round of ``beta_prior``: s has the sums, t the moments, r rho and mean."""
    return f"""), s{i} AS (
  SELECT sum(c * w) AS w, sum(c * w * p) AS a, sum(c * w * p * p) AS b, sum(c * w * w) AS q, sum(c * w / n) AS e,
         sum(c * w * w / n) AS f, sum(c * w * u) AS j, sum(c * w * w * u * u) AS l
  FROM (SELECT g0.*, n / (1 + rho * (n - 1)) AS w FROM g0, r{i - 1})
), t{i} AS (
  SELECT least(greatest(a / w, 1e-6), 1 - 1e-6) AS mu, b - a * a / w AS v, e - f / w AS noise, w - q / w AS spread, j * j / nullif(l, 0) AS seen, w FROM s{i}
), r{i} AS (
  SELECT mu, CASE WHEN spread - noise > 1e-9 * w
                  THEN least(greatest(0, (v / (mu * (1 - mu)) - noise) / (spread - noise)) * seen / (seen + {EVEN_HOSTS}), {MAX_RHO}) ELSE 0 END AS rho
  FROM t{i}
"""


OP4_SQL += "".join(_prior_sql(i) for i in range(1, PRIOR_ROUNDS + 1)) + f"""), z AS (
  SELECT mu, CASE WHEN rho > 0 THEN least(1 / rho - 1, {MAX_STRENGTH}) ELSE {MAX_STRENGTH} END AS st FROM r{PRIOR_ROUNDS}
), c AS (
  SELECT host, true AS bad FROM h, z WHERE (k + mu * st) / (n + st) > {HOST_FAILURE_RATE}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (failed AND bad IS NOT NULL) AS kept, bad IS NOT NULL AS host_condemned
FROM x LEFT JOIN c ON x.host IS NOT DISTINCT FROM c.host
"""


def quality_by_ending(spark, sf_dir: str) -> DataFrame:
    """The same with the character a text ends with as its host: texts that one
    template has cut or closed alike.  Unlike the sources of the given tables,
    such hosts differ, and some are condemned."""
    docs = table(spark, sf_dir, "documents")
    return host_quality(docs.withColumn("source", F.substring(F.coalesce("text", F.lit("")), -1, 1)))


BY_ENDING_SQL = OP4_SQL.replace("source AS host", "substr(coalesce(text, ''), -1) AS host")
