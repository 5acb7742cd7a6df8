"""Registered queries: for each name a DataFrame function and its SQL.

Text rules also run over a few written rows in Bengali, as the tables hold none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches, encoding
from ..functions import patterns as P
from ..functions import text as T
from ..operators import answering, boundaries, chunking, documents, embedding, evaluation, language, memory, search
from ..sources import changing, files
from ..sources import store as stores
from . import engine
from .chunk_sql import CHUNK, ChunkSql

S, W = T.sql_text, T.sql_words

SAMPLES = [
    (-1, "নদী   জল"),
    (-2, "ক‍খ ও গ‌ঘ﻿"),
    (-3, "সন্ ধ্যা নামে, পাখ ির ডাক"),
    (-4, "১২abc আর abc১২ এবং 5টি"),
    (-5, "a\t\tb  \n  c\n\n\n\nd"),
    (-6, "কি ং বা [ি] ং"),
    (-7, "আজ নদীতে অনেক জল।। কে যাবে ?? আমি যাব !! ( ঠিক ) আছে"),
    (-8, "নদী মানে river here"),
    (-9, "12345 67890 !!"),
    (-10, "ছোট"),
    (-11, "Where is the river নদী?"),
    (-12, "উত্তর: নদী"),
    (-13, "প্রশ্ন: কী?\nউত্তর: জল"),
    (-14, "উত্তর: a b c d"),
    (-15, "one two three four"),
    (-16, "  নদী  "),
    (-17, "1.2 নদীর সংজ্ঞা"),
    (-18, "উত্তর\nক) এক\nখ) দুই\nগ) তিন"),
    (-19, "• one\n• two"),
    (-20, ""),
    (-21, "কোথায় গেল? কেন গেল? এবং কখন?"),
    (-22, "x = y ≤ z"),
]
EVAL_SAMPLES = [
    (-1, "what is the blue fish?", "blue whale 12", "blue whale", "the blue fish swam 12 miles"),
    (-2, "how long is it", "the river is long", "the river is long", "the river is long and wide"),
    (-3, "who?", "the of", "of", "x y"),
    (-4, "why", "not sure", "sure", "some context"),
    (-5, "কে যাবে", "blue whale", "whale", "w " * 59 + "w"),
    (-6, "নদী কোথায় নদী", "নদী ২৭ বছর", "নদী ২৭", "উত্তর নদী ২৭ মাইল"),
    (-7, "where", "", "a", "x"),
    (-8, "আজ সাতাশ তারিখ", "সাতাশ দিন", "সাতাশ রাত", "তারিখ সাতাশ. because it rained all day. and more"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches.bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores (one small file) is dealt to
    all of them; a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(SAMPLES, "doc_id bigint, text string")
    docs = _spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.text_of("text").alias("text")).unionByName(own)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else S(x) for x in r) + ")" for r in rows)


TEXTS = f"t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents UNION ALL SELECT * FROM (VALUES {_values(SAMPLES)}) AS v(doc_id, x))"
Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _text_query(name: str, columns: dict[str, tuple]) -> None:
    """A query that maps every text; columns: name -> (Column function, SQL of x)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir).select("doc_id", *(f(F.col("text")).alias(c) for c, (f, _) in columns.items()))

    Q[name] = run, f"WITH {TEXTS} SELECT doc_id, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items()) + " FROM t"


def _trim(x: str) -> str:
    return T.sql_rewrite(x, P.TRIM)


# --- normalization ------------------------------------------------------------

_artifacts = f"translate(translate(x, {S(P.ZERO_WIDTH)}, ''), {S(P.WIDE_SPACES)}, {S(' ' * len(P.WIDE_SPACES))})"
_text_query("clean_text", {"clean": (T.clean_text, T.sql_rewrite("x", P.CLEAN))})
_text_query("normalize_whitespace", {"norm": (T.normalize_whitespace, T.sql_rewrite("x", P.WHITESPACE))})
_text_query("strip_artifacts", {"norm": (T.strip_artifacts, _artifacts)})
_text_query("script_boundary_spacing", {"norm": (T.script_boundary_spacing, T.sql_rewrite("x", P.SCRIPT_BOUNDARY))})
_text_query(
    "rejoin_marks",
    {
        "intended": (T.rejoin_marks, T.sql_rewrite("x", P.REJOIN_INTENDED)),
        "observed": (lambda c: T.rejoin_marks(c, "observed"), T.sql_rewrite("x", P.REJOIN_OBSERVED)),
    },
)
_text_query("nfc_normalize", {"norm": (T.nfc, "nfc_normalize(x)")})


def _sql_normalize(x: str) -> str:
    x = f"nfc_normalize({x})"
    x = f"translate(translate({x}, {S(P.ZERO_WIDTH)}, ''), {S(P.WIDE_SPACES)}, {S(' ' * len(P.WIDE_SPACES))})"
    return T.sql_rewrite(x, [*P.REJOIN_INTENDED, *P.SCRIPT_BOUNDARY, *P.WHITESPACE])


_text_query("normalize_text", {"norm": (T.normalize, _sql_normalize("x"))})
_text_query("clean_ocr", {"norm": (T.clean_ocr, T.sql_rewrite(_sql_normalize("x"), P.OCR))})

#: Texts as they look once their bytes were read in the wrong table, also twice.
BROKEN_SAMPLES = [
    (-101, "nadÄ«'s cafÃ© costs 5â‚¬ â€” donâ€™t ask"),
    (-102, "à¦¨à¦¦à§€ à¦œà¦²"),
    (-103, "naÃƒÂ¯ve"),
    (-104, "MÃ¼ller ðŸ˜€"),
    (-105, "NÃO, Âge, „Ü“ and Ø"),
    (-106, "à\u00a0 lone â and Ã at the end Ã"),
]


def _repaired(s: SparkSession, d: str) -> DataFrame:
    own = s.createDataFrame(BROKEN_SAMPLES, "doc_id bigint, text string")
    rows = _texts(s, d).unionByName(own)
    # The documents once more, broken by the reader that takes bytes for Latin-1.
    docs = _spread(_read(s, d, "documents").select("doc_id", "text"))
    broken = docs.select((-1000 - F.col("doc_id")).alias("doc_id"), F.decode(F.encode(T.text_of("text"), "UTF-8"), "ISO-8859-1").alias("text"))
    return rows.unionByName(broken).select("doc_id", encoding.repair_encoding("text").alias("norm"))


_MADE = "list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: chr(('0x' || b)::INT))"
Q["repair_encoding"] = (
    _repaired,
    f"WITH {TEXTS}, b AS (SELECT * FROM t UNION ALL SELECT * FROM (VALUES {_values(BROKEN_SAMPLES)}) AS v(doc_id, x) "
    f"UNION ALL SELECT -1000 - doc_id, array_to_string({_MADE}, '') FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)) "
    f"SELECT doc_id, {encoding.sql_repair('x')} AS norm FROM b",
)

# --- classification -----------------------------------------------------------

_text_query(
    "text_issues",
    {n: (lambda c, n=n: T.text_issues(c)[n], T.sql_match("x", p)) for n, p in P.ISSUES.items()}
    | {
        "character_count": (lambda c: F.length(c), "length(x)::INT"),
        "normalized_count": (lambda c: F.length(T.nfc(c)), "length(nfc_normalize(x))::INT"),
    },
)
_text_query("content_flags", {n: (lambda c, n=n: T.content_flags(c)[n], T.sql_match("x", p)) for n, p in P.FLAGS.items()})

_bn, _letters = T.sql_count("x", f"[{P.BENGALI}]"), T.sql_count("x", f"[a-zA-Z{P.BENGALI}]")
_share = f"({_bn} / nullif({_letters}, 0))"
_CHUNK_LANGUAGE = (
    f"CASE WHEN length({_trim('x')}) < 10 OR {_letters} = 0 THEN 'unknown' WHEN {_share} > 0.7 THEN 'bn' "
    f"WHEN {_share} > 0.3 THEN 'mixed' ELSE 'en' END"
)


def _contained(x: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {S(n)})::INT" for n in needles) + ")"


_QUERY_LANGUAGE = (
    f"CASE WHEN length({_trim('x')}) < 3 OR {_letters} = 0 THEN 'en' WHEN {_share} > 0.5 OR "
    f"{_contained('lower(x)', P.QUERY_BENGALI)} > {_contained('lower(x)', P.QUERY_ENGLISH)} THEN 'bn' "
    f"WHEN {_share} > 0.2 THEN 'mixed' ELSE 'en' END"
)


def _sql_content_type(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    wordy = f"len(list_filter({lines}[1:3], lambda r: len({W('r')}) <= 2)) = 0"
    return (
        f"CASE WHEN {T.sql_any(_trim(f'lower({x})'), P.ANSWER_WORDS)} AND len({lines}) > 3 THEN 'answer_table' "
        f"WHEN {T.sql_match(x, P.MCQ)} THEN 'mcq' "
        f"WHEN length({x}) - length(replace({x}, '|', '')) > 2 OR (len({lines}) > 2 AND {wordy}) THEN 'table' "
        f"WHEN length({_trim(x)}) < 150 AND {T.sql_match(x, P.HEADING)} THEN 'heading' "
        f"WHEN {T.sql_match(x, P.LIST)} THEN 'list' "
        f"WHEN {T.sql_match(x, P.EQUATION)} AND length({x}) < 200 THEN 'equation' "
        f"WHEN {T.sql_any(_trim(f'lower({x})'), P.DEFINITION_WORDS)} AND length({x}) < 300 THEN 'definition' ELSE 'paragraph' END"
    )


def _sql_question_type(x: str) -> str:
    cases = " ".join(f"WHEN {T.sql_any(f'lower({x})', ns)} THEN {S(name)}" for name, ns in P.QUESTION_TYPES)
    return f"CASE {cases} ELSE 'other_questions' END"


_text_query("chunk_language", {"language": (T.chunk_language, _CHUNK_LANGUAGE)})
_text_query("query_language", {"language": (T.query_language, _QUERY_LANGUAGE)})
_text_query("content_type", {"content_type": (T.content_type, _sql_content_type("x"))})
_text_query("question_type", {"question_type": (T.question_type, _sql_question_type("x"))})
_EMBED = f"array_to_string({W('x')}, ' ')"
_text_query(
    "embed_input",
    {
        "passage": (
            T.embed_input,
            f"CASE WHEN {_EMBED} = '' THEN '' WHEN starts_with({_EMBED}, 'query:') OR starts_with({_EMBED}, 'passage:') THEN {_EMBED} ELSE 'passage: ' || {_EMBED} END",
        ),
        "query": (T.query_input, f"'query: ' || {_trim('x')}"),
    },
)
_text_query("cache_key", {"cache_key": (T.cache_key, "md5(x)")})


def _sql_postprocess(observed: bool) -> tuple[str, str, str]:
    p, q, cut = S(P.ANSWER_PREFIX), S(P.QUESTION_PREFIX), len(P.ANSWER_PREFIX) + (0 if observed else 1)
    a = _trim("x")
    a = f"CASE WHEN starts_with({a}, {p}) THEN {_trim(f'substring({a}, {cut})')} ELSE {a} END"
    return a, p, q


def _postprocess_sql() -> str:
    steps = []
    for name, observed in (("intended", False), ("observed", True)):
        a, p, q = _sql_postprocess(observed)
        labelled = f"list_filter(string_split({name}_a, chr(10)), lambda r: starts_with({_trim('r')}, {p}))"
        last = _trim(f"string_split(({labelled})[-1], {p})[2]")
        steps.append((name, a, f"CASE WHEN contains({name}_a, {q}) AND contains({name}_a, {p}) AND len({labelled}) > 0 THEN {last} ELSE {name}_a END"))
    one = ", ".join(f"{a} AS {n}_a" for n, a, _ in steps)
    two = ", ".join(f"{b} AS {n}_b" for n, _, b in steps)
    three = ", ".join(f"CASE WHEN len({W(f'{n}_b')}) > 3 THEN array_to_string(({W(f'{n}_b')})[1:2], ' ') ELSE {n}_b END AS {n}" for n, _, _ in steps)
    return f"WITH {TEXTS}, a AS (SELECT doc_id, {one} FROM t), b AS (SELECT doc_id, {two} FROM a) SELECT doc_id, {three} FROM b"


Q["postprocess_answer"] = (
    lambda s, d: _texts(s, d).select(
        "doc_id",
        answering.postprocess_answer("text").alias("intended"),
        answering.postprocess_answer("text", "observed").alias("observed"),
    ),
    _postprocess_sql(),
)

# --- documents and pages ------------------------------------------------------


def _doc_statistics(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")
    return documents.assemble(docs).drop("full_text")


Q["doc_statistics"] = (
    _doc_statistics,
    f"SELECT doc_id, 1 AS total_pages, length(coalesce(text, ''))::INT AS total_characters, "
    f"len({W('coalesce(text, chr(32))')})::INT AS total_words, length(coalesce(text, ''))::INT AS avg_chars_per_page FROM documents",
)
Q["doc_exact_dedup"] = (
    lambda s, d: documents.exact_dedup(_read(s, d, "documents")),
    f"SELECT sha256({_trim('lower(coalesce(text, chr(32)))')}) AS text_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
)
_HIDDEN = "'(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->'"
_VISIBLE = f"regexp_replace(regexp_replace(coalesce(html, ''), {_HIDDEN}, ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_VISIBLE = _trim(f"regexp_replace({_VISIBLE}, {S(P.SPACE + '+')}, ' ', 'g')")
Q["page_text_stats"] = (
    lambda s, d: files.html_pages(_read(s, d, "pages")).select(
        F.col("doc_id").alias("page_id"), F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), F.size(T.words(F.col("text"))).alias("n_words")
    ),
    f"SELECT page_id, md5({_VISIBLE}) AS text_md5, length({_VISIBLE})::INT AS n_chars, len({W(_VISIBLE)})::INT AS n_words FROM pages",
)


def _flatten_tables(s: SparkSession, d: str) -> DataFrame:
    rows = _read(s, d, "nation").groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list(F.array(F.format_string("%02d", "n_nationkey"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name"))))).alias("g")
    )
    return rows.select("n_regionkey", documents.flatten_tables(F.array("g", F.array().cast("array<array<string>>"), F.slice("g", 1, 1))).alias("text"))


_ROW = "printf('%02d', n_nationkey) || ' | ' || coalesce(CASE WHEN n_nationkey % 3 > 0 THEN n_name END, '') || chr(10)"
Q["flatten_tables"] = (
    _flatten_tables,
    "SELECT n_regionkey, chr(10) || 'Table 1:' || chr(10) || string_agg(r, '' ORDER BY r) || chr(10) || chr(10) || 'Table 3:' || chr(10) || min(r) || chr(10) AS text "
    f"FROM (SELECT n_regionkey, {_ROW} AS r FROM nation) GROUP BY 1",
)

_SCANNED = "coalesce(text, '') || ' scanned'"


def _ocr_fallback(s: SparkSession, d: str) -> DataFrame:
    pages = _read(s, d, "documents").select("doc_id", "text", F.lit("text").alias("extraction_method"))
    got = documents.with_ocr_fallback(pages, F.concat(T.text_of("text"), F.lit(" scanned")))
    return got.select("doc_id", "extraction_method", F.md5(T.text_of("text")).alias("text_md5"))


_SHORT_PAGE = f"length({_trim('coalesce(text, chr(32))')}) < 50 AND length({_trim(_SCANNED)}) > length({_trim('coalesce(text, chr(32))')})"
Q["ocr_fallback"] = (
    _ocr_fallback,
    f"SELECT doc_id, CASE WHEN {_SHORT_PAGE} THEN 'ocr_fallback' ELSE 'text' END AS extraction_method, "
    f"md5(CASE WHEN {_SHORT_PAGE} THEN {_SCANNED} ELSE coalesce(text, '') END) AS text_md5 FROM documents",
)

# --- chunking -----------------------------------------------------------------


def _sql_parts(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {S(pattern)}), lambda p: {_trim('p')}), lambda p: p <> '')"


_BN, _EN, _ANY = f"[।!?]+{P.SPACE}*", f"[.!?]+{P.SPACE}+", "[।.!?]+"
_FOUND = (
    f"CASE l WHEN 'bn' THEN {_sql_parts('x', _BN)} WHEN 'mixed' THEN list_concat({_sql_parts('x', _BN)}, {_sql_parts('x', _EN)}) "
    f"WHEN 'en' THEN {_sql_parts('x', _EN)} ELSE []::VARCHAR[] END"
)
_CLEANED = f"{TEXTS}, c AS (SELECT doc_id, {T.sql_rewrite('x', P.CLEAN)} AS x FROM t)"
_SENTENCES = (
    f"{_CLEANED}, d AS (SELECT doc_id, x, {_CHUNK_LANGUAGE} AS l FROM c), e AS (SELECT *, {_FOUND} AS f FROM d), "
    f"s AS (SELECT doc_id, x, l, CASE WHEN len(f) > 0 THEN f ELSE {_sql_parts('x', _ANY)} END AS p FROM e)"
)


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", T.clean_text("text").alias("text"))


Q["sentence_split"] = (
    lambda s, d: _cleaned(s, d).select(
        "doc_id", F.posexplode(chunking.sentences(F.col("text"), T.chunk_language("text"))).alias("n", "sentence")
    ),
    f"WITH {_SENTENCES} SELECT doc_id, (i - 1)::INT AS n, p[i] AS sentence FROM s, unnest(range(1, len(p) + 1)) AS u(i)",
)

_OVER = "length(CASE WHEN a.cur = '' THEN b.s ELSE a.cur || ' ' || b.s END) > 512 AND a.cur <> ''"
_TAIL = "a.own[greatest(len(a.own) - 1, 1):]"
_FOLD_OVERLAP = f"""list_reduce(list_transform(p, lambda q: {{'own': []::VARCHAR[], 'cur': '', 'out': []::VARCHAR[], 's': q}}), lambda a, b: {{
  'own': CASE WHEN {_OVER} THEN list_append({_TAIL}, b.s) ELSE list_append(a.own, b.s) END,
  'cur': CASE WHEN {_OVER} THEN array_to_string(list_append({_TAIL}, b.s), ' ') WHEN a.cur = '' THEN b.s ELSE a.cur || ' ' || b.s END,
  'out': CASE WHEN {_OVER} AND length({_trim('a.cur')}) >= 100 THEN list_append(a.out, {_trim('a.cur')}) ELSE a.out END,
  's': ''}}, {{'own': []::VARCHAR[], 'cur': '', 'out': []::VARCHAR[], 's': ''}})"""
_FOLD_LONG = f"""list_reduce(list_transform(p, lambda q: {{'cur': '', 'out': []::VARCHAR[], 's': q}}), lambda a, b: {{
  'cur': CASE WHEN {_OVER} THEN b.s WHEN a.cur = '' THEN b.s ELSE a.cur || ' ' || b.s END,
  'out': CASE WHEN {_OVER} THEN list_append(a.out, a.cur) ELSE a.out END,
  's': ''}}, {{'cur': '', 'out': []::VARCHAR[], 's': ''}})"""


def _folded(fold: str, content: str) -> str:
    kept = f"CASE WHEN length({_trim('r.cur')}) >= 100 THEN list_append(r.out, {content}) ELSE r.out END"
    return f"{_SENTENCES}, g AS (SELECT doc_id, l, {fold} AS r FROM s), h AS (SELECT doc_id, l, {kept} AS k FROM g)"


_EACH = "FROM h, unnest(range(1, len(k) + 1)) AS u(i)"
_SENT_SQL = (
    f"WITH {_folded(_FOLD_OVERLAP, _trim('r.cur'))}, j AS (SELECT doc_id, l, i, k[i] AS x {_EACH}) "
    f"SELECT doc_id, 'page_1_sent_' || (i - 1) AS chunk_id, (i - 1)::INT AS chunk_index, l AS language, {_sql_content_type('x')} AS content_type, "
    f"len({W('x')})::INT AS word_count, length(x)::INT AS char_count, x AS content FROM j"
)
Q["sentence_chunks"] = (
    lambda s, d: _cleaned(s, d).select("doc_id", F.explode(chunking.sentence_chunks(F.col("text"), F.lit(1))).alias("c")).select("doc_id", "c.*"),
    _SENT_SQL,
)
Q["chunk_markdown"] = (
    lambda s, d: _cleaned(s, d)
    .select("doc_id", F.explode(chunking.sentence_chunks(F.col("text"), F.lit(1))).alias("c"))
    .select("doc_id", "c.*")
    .select("doc_id", "chunk_id", files.chunk_markdown().alias("markdown")),
    "SELECT doc_id, chunk_id, '## ' || chunk_id || ' (' || content_type || ', ' || language || ')' || chr(10) || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) AS markdown "
    f"FROM ({_SENT_SQL})",
)
Q["long_split_chunks"] = (
    lambda s, d: _cleaned(s, d).select(
        "doc_id", F.posexplode(chunking.long_split(chunking.sentences(F.col("text"), T.chunk_language("text")))).alias("n", "content")
    ),
    f"WITH {_folded(_FOLD_LONG, 'r.cur')} SELECT doc_id, (i - 1)::INT AS n, k[i] AS content {_EACH}",
)


def _by_line(s: SparkSession, d: str, semantics: str) -> DataFrame:
    """Lines stand for paragraphs: the tables have no blank lines."""
    made = chunking.structure_chunks(F.col("text"), F.lit(1), separator="\n", semantics=semantics)
    return _texts(s, d).select("doc_id", F.posexplode(made).alias("seq", "c")).select("doc_id", "seq", "c.*")


_CHUNKS = ChunkSql(_CHUNK_LANGUAGE, _sql_content_type, _trim, _FOUND, _sql_parts("x", _ANY), _FOLD_LONG)
_LINES = "string_split(x, chr(10))"


def _structure_sql(observed: bool) -> str:
    seq = "(row_number() OVER (PARTITION BY doc_id ORDER BY place, late, n) - 1)::INT AS seq"
    return f"WITH {TEXTS}, {_CHUNKS.structure('t', _LINES, observed)} SELECT doc_id, {seq}, {CHUNK} FROM made"


Q["structure_chunks_observed"] = (lambda s, d: _by_line(s, d, "observed"), _structure_sql(True))
Q["structure_chunks_intended"] = (lambda s, d: _by_line(s, d, "intended"), _structure_sql(False))
Q["paragraph_chunks"] = (
    lambda s, d: _texts(s, d)
    .select("doc_id", F.posexplode(chunking.paragraph_chunks(F.col("text"), F.lit(1), separator="\n")).alias("seq", "c"))
    .select("doc_id", "seq", "c.*"),
    f"WITH {TEXTS}, {_CHUNKS.paragraphs('t', _LINES)} "
    f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, n) - 1)::INT AS seq, {CHUNK} FROM para",
)


def _deduped(s: SparkSession, d: str) -> DataFrame:
    pages = _texts(s, d).withColumn("page_number", F.lit(1))
    return chunking.chunk_pages(pages, "sentences")


_DEDUP_SQL = (
    f"SELECT * FROM ({_SENT_SQL}) WHERE char_count >= 100 "
    f"QUALIFY row_number() OVER (PARTITION BY doc_id, {_trim('lower(content)')} ORDER BY chunk_index) = 1"
)
Q["chunk_dedup"] = (
    lambda s, d: _deduped(s, d).select("doc_id", "chunk_id", "chunk_index", "language", "content_type", "word_count", "char_count", "content"),
    f"SELECT * FROM ({_DEDUP_SQL})",
)
Q["chunk_type_distribution"] = (
    lambda s, d: chunking.chunk_statistics(_deduped(s, d)).withColumn("avg_chars", F.round("avg_chars", 6)),
    f"SELECT content_type, count(*) AS n_chunks, round(avg(char_count), 6) AS avg_chars FROM ({_DEDUP_SQL}) GROUP BY 1",
)

Q["chunk_overall"] = (
    lambda s, d: _deduped(s, d).agg(F.count("*").alias("n_chunks"), F.round(F.avg("char_count"), 6).alias("avg_chunk_size"), F.countDistinct("language").alias("n_languages")),
    f"SELECT count(*) AS n_chunks, round(avg(char_count), 6) AS avg_chunk_size, count(DISTINCT language) AS n_languages FROM ({_DEDUP_SQL})",
)


def _mixed_sql() -> str:
    """Paragraphs of the documents with multiple-choice questions, sentences of
    the others; of equal contents the first."""
    clean = f"SELECT doc_id, {T.sql_rewrite('x', P.CLEAN)} AS x, {T.sql_match('x', P.FLAGS['has_mcq'])} AS flagged FROM (SELECT doc_id, text AS x FROM documents WHERE text <> '')"
    blank = f"regexp_split_to_array(x, {S(f'{chr(10)}{P.SPACE}*{chr(10)}+')})"
    sentences = (
        f"d AS (SELECT doc_id, x, {_CHUNK_LANGUAGE} AS l FROM m WHERE NOT mcq), e AS (SELECT *, {_FOUND} AS f FROM d), "
        f"s AS (SELECT doc_id, l, CASE WHEN len(f) > 0 THEN f ELSE {_sql_parts('x', _ANY)} END AS p FROM e), g AS (SELECT doc_id, {_FOLD_OVERLAP} AS r FROM s), "
        f"h AS (SELECT doc_id, CASE WHEN length({_trim('r.cur')}) >= 100 THEN list_append(r.out, {_trim('r.cur')}) ELSE r.out END AS k FROM g), "
        f"j AS (SELECT doc_id, i - 1 AS i, k[i] AS x {_EACH})"
    )
    return (
        f"WITH c AS ({clean}), m AS (SELECT doc_id, x, flagged OR contains(lower(x), 'mcq') AS mcq FROM c), own AS (SELECT * FROM m WHERE mcq), "
        f"{_CHUNKS.paragraphs('own', blank)}, {sentences}, a AS (SELECT doc_id, i, n, content, chunk_id, content_type, length(raw)::INT AS char_count FROM para "
        f"UNION ALL SELECT doc_id, i, 0, x, 'page_1_sent_' || i, {_sql_content_type('x')}, length(x)::INT FROM j) "
        f"SELECT doc_id, chunk_id, content_type, char_count FROM a WHERE char_count >= 100 "
        f"QUALIFY row_number() OVER (PARTITION BY doc_id, {_trim('lower(content)')} ORDER BY i, n) = 1"
    )


Q["chunk_mixed_strategy"] = (
    lambda s, d: chunking.chunk_pages(_read(s, d, "documents").select("doc_id", F.lit(1).alias("page_number"), "text"), "mixed").select(
        "doc_id", "chunk_id", "content_type", "char_count"
    ),
    _mixed_sql(),
)

# --- language ------------------------------------------------------------------


def held_out() -> F.Column:
    """A fifth of the documents, by a digest of the id, that no model learns from."""
    return F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("bigint") % 5 == 0


def _detected(s: SparkSession, d: str, grams: int | None, only: str | None = None) -> DataFrame:
    """The language of every document (or of those where ``only`` holds), by a model
    of those that aren't held out, alone and where the rule for chunks leaves it open."""
    docs = _spread(_read(s, d, "documents").select("doc_id", "text", "lang")).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    counts = stores.written(language.gram_counts(docs.where("NOT held_out")), stores.session_folder(s, "grams"))
    model = stores.written(language.entries(counts, grams), stores.session_folder(s, "language-model"))
    asked = docs if only is None else docs.where(only)
    rule = T.chunk_language("text", lambda _: F.lit(_OPEN)).alias("rule")
    rows = asked.select("doc_id", "held_out", "lang", rule).join(language.detected(asked, model), "doc_id", "left")
    chunk_language = F.when(F.col("rule") == _OPEN, F.coalesce("detected", F.lit("en"))).otherwise(F.col("rule"))
    return rows.select("doc_id", "held_out", "lang", "detected", chunk_language.alias("chunk_language"))


_OPEN = "?"
_ONLY_LETTERS = _trim(T.sql_rewrite("lower(x)", [(r"\P{L}+", " ")]))
_LETTERS = f"' ' || {_ONLY_LETTERS} || ' '"
_MOST = f"(SELECT gram FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= {language.GRAMS})"


def _detected_sql(known: str) -> str:
    return f"""
WITH x AS (SELECT doc_id, lang, coalesce(text, '') AS x, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % 5 = 0, false) AS held_out FROM documents),
l AS (SELECT *, {_LETTERS} AS t FROM x), ch AS (SELECT doc_id, lang, held_out, regexp_extract_all(t, '(?s).') AS c FROM l),
g AS (SELECT doc_id, lang, held_out, gram, count(*) AS n FROM (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM ch) GROUP BY ALL),
k AS (SELECT lang, gram, sum(n) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
v AS (SELECT DISTINCT gram FROM {known}),
tot AS (SELECT lang, sum(n) AS total FROM k JOIN v USING (gram) GROUP BY lang),
m AS (SELECT v.gram, tot.lang AS of, round(ln((coalesce(k.n, 0) + 1) / (total + (SELECT count(*) FROM v))) * {language.SCALE})::BIGINT AS weight FROM v CROSS JOIN tot LEFT JOIN k ON k.gram = v.gram AND k.lang = tot.lang),
sc AS (SELECT doc_id, of, sum(n * weight) AS score FROM g JOIN m USING (gram) GROUP BY ALL),
best AS (SELECT doc_id, of AS detected FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, of) = 1)
SELECT x.doc_id, held_out, lang, detected, {_CHUNK_LANGUAGE.replace("ELSE 'en'", "ELSE coalesce(detected, 'en')")} AS chunk_language FROM x LEFT JOIN best USING (doc_id)"""


Q["detect_language"] = lambda s, d: _detected(s, d, language.GRAMS), _detected_sql(_MOST)
Q["language_accuracy"] = (
    lambda s, d: language.accuracy(_detected(s, d, None, "held_out")).withColumn("accuracy", F.round("accuracy", 6)),
    f"SELECT count(*) AS n, round(count(*) FILTER (detected = lang) / count(*), 6) AS accuracy FROM ({_detected_sql("k")}) WHERE held_out AND lang IS NOT NULL",
)

# --- sentence boundaries ---------------------------------------------------------


def _boundary_model(s: SparkSession, texts: DataFrame, kept: int | None) -> tuple[DataFrame, DataFrame]:
    counts = stores.written(boundaries.word_counts(texts), stores.session_folder(s, "word-counts"))
    types = stores.written(boundaries.types_of(counts), stores.session_folder(s, "word-types"))
    short = stores.written(boundaries.abbreviations(types, kept=kept), stores.session_folder(s, "abbreviations"))
    breaks = stores.written(boundaries.breaks_of(counts, short), stores.session_folder(s, "breaks"))
    return short, stores.written(boundaries.starters_of(breaks, types, kept=kept), stores.session_folder(s, "starters"))


def _boundaries(s: SparkSession, d: str) -> DataFrame:
    """The sentences of every document, by what all documents teach."""
    texts = _spread(_read(s, d, "documents").select("doc_id", "text"))
    return boundaries.sentences(texts, *_boundary_model(s, texts, None))


def _boundary_scores(s: SparkSession, d: str) -> DataFrame:
    short, begins = _boundary_model(s, _read(s, d, "documents"), boundaries.KEPT)
    rows = short.withColumn("kind", F.lit("abbreviation")).unionByName(begins.withColumn("kind", F.lit("starter")))
    return rows.select("kind", "type", F.round("score", 3).alias("score"))


def _sql_core(w: str) -> str:
    return f"regexp_replace({w}, {S(boundaries.CORE)}, '', 'g')"


def _sql_type(core: str) -> str:
    return f"CASE WHEN {T.sql_match(core, boundaries.DOTTED)} OR {T.sql_match(core, boundaries.PLAIN)} THEN lower(regexp_replace({core}, {S('[.]$')}, '')) END"


def _sql_ll(k: str, n: str, p: str) -> str:
    return f"({k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def _sql_clamp(p: str) -> str:
    return f"greatest({boundaries.LEAST}::DOUBLE, least(1 - {boundaries.LEAST}::DOUBLE, {p}))"


_B = boundaries
_RATIO = f"2 * ({_sql_ll('dotted', '(dotted + plain)', str(_B.CERTAIN))} - {_sql_ll('dotted', '(dotted + plain)', _sql_clamp('periods / words'))})"
_GAIN = f"2 * ({_sql_ll('ab', 'a', _sql_clamp('ab / a'))} + {_sql_ll('(b - ab)', '(n - a)', _sql_clamp('(b - ab) / greatest(n - a, 1)'))} - {_sql_ll('ab', 'a', _sql_clamp('b / n'))} - {_sql_ll('(b - ab)', '(n - a)', _sql_clamp('b / n'))})"
_BEST = f" ORDER BY score DESC, type LIMIT {_B.KEPT}"


def _boundary_sql(kept: str) -> str:
    return f"""
wl AS (SELECT doc_id, {W("coalesce(text, '')")} AS w FROM documents),
o AS (SELECT doc_id, i, w[i] AS w, w[i + 1] AS nxt, i = len(w) AS final, {_sql_core('w[i]')} AS core FROM wl, unnest(range(1, len(w) + 1)) AS u(i)),
ty AS (SELECT *, {_sql_type('core')} AS type FROM o),
types AS (SELECT type, (count(*) FILTER (ends_with(core, '.')))::DOUBLE AS dotted, (count(*) FILTER (NOT ends_with(core, '.')))::DOUBLE AS plain FROM ty GROUP BY 1),
tot AS (SELECT sum(dotted) AS periods, sum(dotted + plain) AS words FROM types),
ab0 AS (SELECT type, dotted, plain, periods, words, length(type) - length(replace(type, '.', '')) AS inn FROM types, tot WHERE type IS NOT NULL AND dotted > 0),
abbr AS (SELECT type, round({_RATIO} * exp(-(length(type) - inn)) * (inn + 1) * pow(length(type) - inn, -plain), 6) AS score FROM ab0 WHERE score >= {_B.ABBREVIATION}{kept}),
ends AS (SELECT *, {T.sql_match('w', _B.ENDS)} AS ending, {T.sql_match('w', _B.SURE)} AS sure, type IN (SELECT type FROM abbr) AS short, coalesce({T.sql_match('type', _B.INITIAL)}, false) AS initial, {_sql_type(_sql_core('nxt'))} AS nt FROM ty),
brk AS (SELECT nt AS type, count(*)::DOUBLE AS ab FROM ends WHERE NOT final AND ending AND (sure OR NOT (coalesce(short, false) OR initial)) GROUP BY 1),
st0 AS (SELECT brk.type, ab, dotted + plain AS b, (SELECT sum(ab) FROM brk) AS a, words AS n FROM brk JOIN types ON types.type = brk.type, tot),
starter AS (SELECT type, round({_GAIN}, 6) AS score FROM st0 WHERE n / a > b / ab AND score >= {_B.STARTER}{kept})"""


_ENDED = f"ending AND (sure OR NOT (coalesce(short, false) OR initial) OR (coalesce(nt IN (SELECT type FROM starter), false) AND {T.sql_match(_sql_core('nxt'), '^' + chr(92) + 'p{Lu}')}))"
Q["boundary_scores"] = (
    _boundary_scores,
    f"WITH {_boundary_sql(_BEST)} SELECT 'abbreviation' AS kind, type, round(score, 3) AS score FROM abbr UNION ALL SELECT 'starter', type, round(score, 3) FROM starter",
)
Q["sentence_boundaries"] = (
    _boundaries,
    f"WITH {_boundary_sql("")}, cut AS (SELECT doc_id, i, w, coalesce(sum(CASE WHEN NOT final AND {_ENDED} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS n FROM ends) "
    "SELECT doc_id, n, string_agg(w, ' ' ORDER BY i) AS sentence FROM cut GROUP BY 1, 2",
)

# --- embeddings and search ----------------------------------------------------


def _cache_miss(s: SparkSession, d: str) -> DataFrame:
    cached = _read(s, d, "documents").where("doc_id % 3 = 0").select(T.cache_key("text").alias("cache_key"), F.lit("m").alias("model"))
    return embedding.cache_misses(_read(s, d, "documents"), cached, "m").select("cache_key")


Q["cache_miss"] = (
    _cache_miss,
    "SELECT DISTINCT md5(coalesce(text, '')) AS cache_key FROM documents WHERE md5(coalesce(text, '')) NOT IN "
    "(SELECT md5(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)",
)


def _search(metric: str, k: int, threshold: float | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        vectors = _read(s, d, "embeddings")
        return search.topk(vectors, _queries(vectors), k, metric, threshold)

    return run


def _queries(vectors: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_SCORE = {
    "cosine": "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])",
    "ip": "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])",
    "l2": "1 / (1 + list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) ^ 2)",
}


def _sql_search(metric: str, k: int, threshold: float | None = None) -> str:
    where = "" if threshold is None else f" WHERE score >= {threshold}"
    return (
        f"SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank "
        f"FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round({_SCORE[metric]}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0){where}) WHERE rank <= {k}"
    )


for _m in search.METRICS:
    Q[f"topk_{_m}"] = _search(_m, 10), _sql_search(_m, 10)
Q["topk_threshold"] = _search("cosine", 10, 0.3), _sql_search("cosine", 10, 0.3)


IVF_CELLS, IVF_PROBES = 32, 24


def _ivf_recall(s: SparkSession, d: str) -> DataFrame:
    """The search by cells, around a fixed table of centroids: the first vectors.
    These vectors are nearly orthogonal, so most cells must be probed."""
    vectors = _read(s, d, "embeddings")
    centroids = np.array([r[0] for r in vectors.orderBy("vec_id").limit(IVF_CELLS).select("embedding").collect()])
    indexed = search.assign_cells(vectors, centroids)
    found = search.topk(indexed, _queries(vectors), 10, cells=(centroids, IVF_PROBES))
    exact = search.topk(vectors, _queries(vectors), 10)
    return search.recall(found, exact).withColumn("recall", F.round("recall", 4))


_CELL_SCORE = "list_cosine_similarity({0}.embedding::DOUBLE[], c.embedding::DOUBLE[])"
Q["ivf_recall"] = (
    _ivf_recall,
    f"WITH c AS (SELECT vec_id AS cell, embedding FROM embeddings ORDER BY vec_id LIMIT {IVF_CELLS}), "
    f"a AS (SELECT v.vec_id, arg_max(cell, {_CELL_SCORE.format('v')}) AS cell FROM embeddings v, c GROUP BY 1), "
    f"p AS (SELECT v.vec_id AS query_id, cell FROM embeddings v, c WHERE v.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY {_CELL_SCORE.format('v')} DESC, cell) <= {IVF_PROBES}), "
    f"e AS ({_sql_search('cosine', 10)}), f AS (SELECT e.query_id, e.vec_id FROM e JOIN a USING (vec_id) JOIN p ON p.query_id = e.query_id AND p.cell = a.cell) "
    "SELECT (SELECT count(*) FROM e) AS wanted, (SELECT count(*) FROM f) AS found, round((SELECT count(*) FROM f) / (SELECT count(*) FROM e), 4) AS recall",
)


LSH_BITS, LSH_PROBES = 5, 24


def _lsh_recall(s: SparkSession, d: str) -> DataFrame:
    """The search by sides of hyperplanes, with the first vectors as planes."""
    vectors = _read(s, d, "embeddings")
    planes = np.array([r[0] for r in vectors.orderBy("vec_id").limit(LSH_BITS).select("embedding").collect()], np.float64)
    cells = search.Hyperplanes(np.zeros(planes.shape[1]), planes)
    found = search.topk(search.assign_cells(vectors, cells), _queries(vectors), 10, cells=(cells, LSH_PROBES))
    exact = search.topk(vectors, _queries(vectors), 10)
    return search.recall(found, exact).withColumn("recall", F.round("recall", 4))


_SIDE = "list_inner_product({0}.embedding::DOUBLE[], p.embedding::DOUBLE[])"
Q["lsh_recall"] = (
    _lsh_recall,
    f"WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS bit, embedding FROM embeddings ORDER BY vec_id LIMIT {LSH_BITS}), "
    f"sides AS (SELECT v.vec_id, bit, {_SIDE.format('v')} AS side FROM embeddings v, p), a AS (SELECT vec_id, sum(CASE WHEN side >= 0 THEN 1 << bit::INT ELSE 0 END) AS cell FROM sides GROUP BY 1), "
    f"costs AS (SELECT vec_id AS query_id, cell, sum(CASE WHEN (side >= 0) <> ((cell >> bit::INT) & 1 = 1) THEN abs(side) ELSE 0 END) AS cost FROM sides, range({1 << LSH_BITS}) AS r(cell) WHERE vec_id % 50 = 0 GROUP BY ALL), "
    f"pr AS (SELECT query_id, cell FROM costs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cost, cell) <= {LSH_PROBES}), "
    f"e AS ({_sql_search('cosine', 10)}), f AS (SELECT e.query_id, e.vec_id FROM e JOIN a USING (vec_id) JOIN pr ON pr.query_id = e.query_id AND pr.cell = a.cell) "
    "SELECT (SELECT count(*) FROM e) AS wanted, (SELECT count(*) FROM f) AS found, round((SELECT count(*) FROM f) / (SELECT count(*) FROM e), 4) AS recall",
)


def _pairwise(s: SparkSession, d: str) -> DataFrame:
    v = _read(s, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = v.join(nxt, "vec_id")
    return pairs.select("vec_id", F.round(embedding.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(embedding.norm(F.col("embedding")), 6).alias("norm"))


Q["pairwise_cosine"] = (
    _pairwise,
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, "
    "round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)


def _store(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "embeddings").select(
        F.col("vec_id").alias("pos"),
        F.concat(F.lit("chunk_"), F.col("vec_id") % 400).alias("chunk_id"),
        F.concat(F.lit("text "), F.col("label")).alias("text"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.col("embedding").alias("vector"),
    )


_STORE = "st AS (SELECT vec_id AS pos, 'chunk_' || vec_id % 400 AS chunk_id, 'text ' || label AS text, label FROM embeddings)"
Q["get_by_id"] = (
    lambda s, d: search.get_by_id(_store(s, d), "chunk_7").select("pos", "chunk_id", "text", F.col("metadata")["label"].alias("label"), "score"),
    f"WITH {_STORE} SELECT pos, chunk_id, text, label::VARCHAR AS label, 1.0::DOUBLE AS score FROM st WHERE chunk_id = 'chunk_7' ORDER BY pos DESC LIMIT 1",
)
Q["index_stats"] = (
    lambda s, d: search.store_statistics(_store(s, d)),
    "SELECT count(*) AS total_vectors, coalesce(max(len(embedding)), 0)::INT AS dimension, "
    "round(coalesce(max(len(embedding)), 0) * count(*) * 4 / 1048576 + count(*) * 100 / 1048576, 2) AS index_size_mb, "
    "'flat' AS index_type, 'cosine' AS metric, count(*) AS total_chunks FROM embeddings",
)


Q["metadata_lookup"] = (
    lambda s, d: _store(s, d).select("pos", F.coalesce(F.try_element_at("metadata", F.lit("label")), F.lit("none")).alias("label"), F.coalesce(F.try_element_at("metadata", F.lit("page")), F.lit("0")).alias("page")),
    f"WITH {_STORE} SELECT pos, coalesce(MAP {{'label': label::VARCHAR}}['label'], 'none') AS label, coalesce(MAP {{'label': label::VARCHAR}}['page'], '0') AS page FROM st",
)


def _upsert(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    changes = search.latest(store).where("pos % 4 = 0").withColumn("text", F.concat(F.lit("new "), F.col("chunk_id")))
    return search.upsert(store, changes).select("pos", "chunk_id", "text")


_LATEST = "la AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY pos DESC) = 1)"
Q["store_upsert"] = (
    _upsert,
    f"WITH {_STORE}, {_LATEST} SELECT st.pos, st.chunk_id, coalesce('new ' || c.chunk_id, st.text) AS text FROM st "
    "LEFT JOIN (SELECT chunk_id FROM la WHERE pos % 4 = 0) c ON c.chunk_id = st.chunk_id",
)
Q["store_delete"] = (
    lambda s, d: search.delete(_store(s, d), _store(s, d).where("pos % 7 = 0")).select("pos", "chunk_id"),
    f"WITH {_STORE} SELECT pos, chunk_id FROM st WHERE chunk_id NOT IN (SELECT chunk_id FROM st WHERE pos % 7 = 0)",
)


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    """The store, written and loaded again with its settings."""
    path = stores.session_folder(s, "store")
    stores.save_store(_store(s, d), path, metric="cosine", index_type="flat", dimension=64)
    rows = stores.load_store(s, path, metric="cosine", dimension=64)
    return rows.select("pos", "chunk_id", "text", F.size("vector").alias("dimension"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


Q["store_round_trip"] = (
    _round_trip,
    "SELECT vec_id AS pos, 'chunk_' || vec_id % 400 AS chunk_id, 'text ' || label AS text, len(embedding)::INT AS dimension, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
)
Q["bundle_ids"] = (
    lambda s, d: stores.bundle_rows(
        _read(s, d, "embeddings").orderBy("vec_id").select(F.col("label").cast("string").alias("text"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("own_"), "vec_id")).alias("chunk_id"))
    ).select("pos", "chunk_id", "text"),
    "SELECT n AS pos, CASE WHEN vec_id % 3 = 0 THEN 'own_' || vec_id ELSE 'chunk_' || n END AS chunk_id, label::VARCHAR AS text FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings)",
)


def _append(s: SparkSession, d: str) -> DataFrame:
    grown = search.append(_store(s, d), _store(s, d).where("pos % 5 = 0"))
    return search.latest(grown).groupBy("text").agg(F.count("*").alias("n"))


Q["store_append"] = (
    _append,
    f"WITH {_STORE}, g AS (SELECT *, pos AS o FROM st UNION ALL SELECT *, pos + (SELECT max(pos) + 1 FROM st) FROM st WHERE pos % 5 = 0), "
    "l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY o DESC) = 1) SELECT text, count(*) AS n FROM l GROUP BY 1",
)



def _store_changes(s: SparkSession, d: str) -> DataFrame:
    """A store on disk after an append, an update, a deletion and a compaction."""
    store = changing.ChangingStore(s, stores.session_folder(s, "store"))
    store.create(_store(s, d))
    store.append(_store(s, d).where("pos % 5 = 0").withColumn("chunk_id", F.concat(F.lit("more_"), "pos")))
    number = F.regexp_extract("chunk_id", "\\d+", 0).cast("int")
    changes = store.read().where(number % 4 == 0).select("chunk_id").distinct().select("chunk_id", F.concat(F.lit("new "), "chunk_id").alias("text"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("array<float>").alias("vector"))
    store.update(changes)
    store.delete(store.read().where(number % 7 == 0))
    store.compact()
    rows = store.read()
    return rows.groupBy("chunk_id", "text").agg(F.count("*").alias("n"), F.round(F.sum(F.col("vector")[0].cast("double")), 5).alias("first"), F.max(F.col("metadata")["label"]).alias("label"))


Q["store_changes"] = (
    _store_changes,
    f"WITH {_STORE.replace('label FROM', 'label, embedding[1]::DOUBLE AS e FROM')}, g AS (SELECT * FROM st UNION ALL SELECT pos, 'more_' || pos, text, label, e FROM st WHERE pos % 5 = 0), "
    "k AS (SELECT *, regexp_extract(chunk_id, '[0-9]+')::INT AS i FROM g) "
    "SELECT chunk_id, CASE WHEN i % 4 = 0 THEN 'new ' || chunk_id ELSE text END AS text, count(*) AS n, round(sum(e), 5) AS first, max(label::VARCHAR) AS label FROM k WHERE i % 7 <> 0 GROUP BY 1, 2",
)

# --- answering and memory -----------------------------------------------------


def _context(s: SparkSession, d: str) -> DataFrame:
    vectors = _read(s, d, "embeddings")
    contents = _read(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    queries = _queries(vectors)
    hits = search.topk(vectors, queries, 5, "cosine", 0.3)
    got = answering.retrieve_context(hits, contents, queries)
    return got.select("query_id", "n_sources", F.md5("context").alias("context_md5"), F.round("confidence", 6).alias("confidence"))


_CONTEXT_SQL = f"""
WITH h AS ({_sql_search('cosine', 5, 0.3)}), j AS (SELECT h.*, coalesce(text, '') AS c FROM h JOIN documents d ON d.doc_id = h.vec_id),
q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, count(vec_id)::INT AS n_sources, md5(coalesce(string_agg(c, chr(10) || chr(10) ORDER BY rank), '')) AS context_md5,
  round(CASE WHEN count(vec_id) = 0 THEN 0 ELSE least(0.6 * avg(score) + 0.2 * least(count(vec_id) / 3.0, 1) + 0.2 * least(sum(length(c)) / 1000.0, 1), 1) END, 6)::DOUBLE AS confidence
FROM q LEFT JOIN j USING (query_id) GROUP BY query_id"""
Q["retrieve_context"] = _context, _CONTEXT_SQL
Q["confidence"] = (lambda s, d: _context(s, d).select("query_id", "confidence"), f"SELECT query_id, confidence FROM ({_CONTEXT_SQL})")

_MESSAGES = "m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant'))"
_PAIRS = f"WITH {_MESSAGES} SELECT conv_id, (i // 2)::INT AS pair, max(text) FILTER (i % 2 = 0) AS question, max(text) FILTER (i % 2 = 1) AS answer FROM m GROUP BY 1, 2 HAVING count(*) = 2"
Q["history_pairs"] = lambda s, d: memory.history_pairs(_read(s, d, "conversations")), _PAIRS
Q["recent_memory"] = (
    lambda s, d: memory.recent_memory(_read(s, d, "conversations")),
    f"WITH {_MESSAGES} SELECT conv_id, chr(10) || chr(10) || 'Recent conversation:' || chr(10) || "
    "string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS memory FROM m WHERE r <= 4 GROUP BY 1",
)
Q["memory_by_turn"] = (
    lambda s, d: memory.memory_by_turn(_read(s, d, "conversations")),
    f"WITH {_MESSAGES}, l AS (SELECT *, string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lines FROM m) "
    "SELECT conv_id, turn, text, coalesce(chr(10) || chr(10) || 'Recent conversation:' || chr(10) || lines, '') AS memory FROM l WHERE role = 'user'",
)
Q["clear_memory"] = (
    lambda s, d: memory.clear_memory(_read(s, d, "conversations"), _read(s, d, "conversations").where("role = 'system'")).select("conv_id", "turn"),
    "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
)


def _asked(s: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every benchmark item as a question, the documents' texts, the embedded
    questions, and the k documents that each finds."""
    embedder = embedding.HashingEmbedder()
    contents = _read(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    store = embedding.encode(contents.where(T.text_of("content") != ""), embedder, "content").select("vec_id", "embedding")
    asked = _read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    prefixed = asked.select("query_id", F.concat(F.lit("query: "), F.trim(T.text_of("question"))).alias("q"))
    queries = embedding.encode(prefixed, embedder, "q", prefix=False)
    return asked, contents, queries, search.topk(store, queries, k, "cosine", 0.3)


def _sql_embedded(name: str, source: str) -> str:
    """CTE ``name`` (id, dim, v): embeddings of the texts p of ``source``."""
    grams = "list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2])"
    return (
        f"{name}_g AS (SELECT id, md5(unnest({grams})) AS h FROM (SELECT id, regexp_extract_all(p, '(?s).') AS c FROM ({source}))), "
        f"{name}_n AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN substr(h, 9, 1) >= '8' THEN 1 ELSE -1 END) AS n FROM {name}_g GROUP BY ALL), "
        f"{name} AS (SELECT id, dim, (n / sqrt(nullif(sum(n * n) OVER (PARTITION BY id), 0)))::FLOAT::DOUBLE AS v FROM {name}_n)"
    )


def _sql_passage(x: str) -> str:
    one = f"array_to_string({W(x)}, ' ')"
    return f"CASE WHEN {one} = '' THEN '' WHEN starts_with({one}, 'query:') OR starts_with({one}, 'passage:') THEN {one} ELSE 'passage: ' || {one} END"


_ASKED = "SELECT item_id AS id, 'query: ' || trim(coalesce(text, '')) AS p FROM benchmark"


def found_sql(k: int) -> str:
    """CTE found (query_id, vec_id, score, rank): the search by text."""
    docs = f"SELECT doc_id AS id, {_sql_passage('text')} AS p FROM documents WHERE text <> ''"
    return (
        f"{_sql_embedded('sv', docs)}, {_sql_embedded('qv', _ASKED)}, "
        "sn AS (SELECT id, sqrt(sum(v * v)) AS n FROM sv GROUP BY id), qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM qv GROUP BY id), "
        "dots AS (SELECT qv.id AS q, sv.id AS d, sum(qv.v * sv.v) AS dot FROM qv JOIN sv USING (dim) GROUP BY ALL), "
        "scored AS (SELECT q AS query_id, d AS vec_id, round(dot / (qn.n * sn.n), 6) AS score FROM dots JOIN qn ON qn.id = q JOIN sn ON sn.id = d), "
        "found AS (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored WHERE score >= 0.3 "
        f"QUALIFY rank <= {k})"
    )


def _embedded_documents(s: SparkSession, d: str) -> DataFrame:
    """Every document's embedding, a row for each coordinate that isn't zero."""
    docs = _read(s, d, "documents").where(T.text_of("text") != "")
    rows = embedding.encode(docs, embedding.HashingEmbedder(), "text").select("doc_id", F.posexplode("embedding").alias("dim", "v"))
    return rows.where("v <> 0").select("doc_id", "dim", F.round(F.col("v").cast("double"), 6).alias("v"))


_PASSAGE_OF = f"SELECT doc_id AS id, {_sql_passage('text')} AS p FROM documents WHERE text <> ''"
Q["embed_documents"] = (
    _embedded_documents,
    f"WITH {_sql_embedded('sv', _PASSAGE_OF)} SELECT id AS doc_id, dim::INT AS dim, round(v, 6) AS v FROM sv WHERE v <> 0",
)


def _cache_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Texts embedded through a cache table in two parts that overlap; the table
    has each distinct text once."""
    cache = stores.EmbeddingCache(s, stores.session_folder(s, "cache"))
    docs, embedder = _read(s, d, "documents").select("doc_id", "text"), embedding.HashingEmbedder(8)
    cache.encode(docs.where("doc_id % 3 > 0"), embedder)
    rows = cache.encode(docs, embedder)
    rows = rows.groupBy("cache_key").agg(F.count("*").alias("n_documents"), F.max(F.size("vector")).alias("dimension"))
    return rows.join(cache.load().groupBy("cache_key").agg(F.count("*").alias("n_cached")), "cache_key")


Q["cache_round_trip"] = (
    _cache_round_trip,
    "SELECT md5(coalesce(text, '')) AS cache_key, count(*) AS n_documents, 8 AS dimension, 1::BIGINT AS n_cached FROM documents GROUP BY 1",
)
Q["search_by_text"] = lambda s, d: _asked(s, d, 10)[3], f"WITH {found_sql(10)} SELECT query_id, vec_id, score, rank FROM found"


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Every benchmark item, answered by the extractive stand-in from the
    documents that its own embedding finds among theirs."""
    asked, contents, queries, hits = _asked(s, d, 5)
    context = answering.retrieve_context(hits, contents, queries)
    rows = asked.join(context, "query_id", "left").withColumn("memory", F.lit(""))
    return answering.answer(rows, answering.ExtractiveGenerator()).select("query_id", "query_language", "answer", "model_used", F.round("confidence", 6).alias("confidence"))


def _prompts(s: SparkSession, d: str) -> DataFrame:
    asked, contents, queries, hits = _asked(s, d, 5)
    rows = asked.join(answering.retrieve_context(hits, contents, queries), "query_id")
    return rows.select("query_id", F.md5(answering.prompt(F.col("context"), F.col("question"))).alias("prompt_md5"), F.length("context").alias("context_length"))


_BEFORE, _BETWEEN, _AFTER = (S(x) for x in answering.PROMPT.replace("{context}", "\0").replace("{question}", "\0").split("\0"))
Q["build_prompt"] = (
    _prompts,
    f"WITH {found_sql(5)}, j AS (SELECT found.*, coalesce(text, '') AS c FROM found JOIN documents ON doc_id = vec_id), "
    "b AS (SELECT item_id AS query_id, any_value(text) AS question, coalesce(string_agg(c, chr(10) || chr(10) ORDER BY rank), '') AS context FROM benchmark LEFT JOIN j ON query_id = item_id GROUP BY 1) "
    f"SELECT query_id, md5({_BEFORE} || context || {_BETWEEN} || question || {_AFTER}) AS prompt_md5, length(context)::INT AS context_length FROM b",
)
Q["valid_questions"] = (
    lambda s, d: answering.valid_questions(_read(s, d, "conversations").withColumn("question", F.col("text"))).select("conv_id", "turn"),
    "SELECT conv_id, turn FROM conversations WHERE length(text) BETWEEN 1 AND 1000",
)


def answers_sql(more: str = "") -> str:
    """Answers to all benchmark items; ``more`` columns of (question, context, n)."""
    parts = f"list_filter(list_transform(string_split(replace(context, '।', '.'), '.'), lambda p: {_trim('p')}), lambda p: p <> '')"
    shared = f"list_transform(parts, lambda p: len(list_intersect(wanted, {W('lower(p)')})))"
    a, p, q = _sql_postprocess(False)
    labelled = f"list_filter(string_split(a, chr(10)), lambda r: starts_with({_trim('r')}, {p}))"
    last = _trim(f"string_split(({labelled})[-1], {p})[2]")
    return (
        f"WITH {found_sql(5)}, j AS (SELECT found.*, coalesce(text, '') AS c FROM found JOIN documents ON doc_id = vec_id), "
        "b AS (SELECT item_id AS query_id, any_value(coalesce(text, '')) AS question, coalesce(string_agg(c, chr(10) || chr(10) ORDER BY rank), '') AS context, count(vec_id) AS n, "
        "round(CASE WHEN count(vec_id) = 0 THEN 0 ELSE least(0.6 * avg(score) + 0.2 * least(count(vec_id) / 3.0, 1) + 0.2 * least(sum(length(c)) / 1000.0, 1), 1) END, 6)::DOUBLE AS confidence "
        "FROM benchmark LEFT JOIN j ON query_id = item_id GROUP BY item_id), "
        f"r AS (SELECT *, {W('lower(question)')} AS wanted, {parts} AS parts FROM b), z AS (SELECT *, {shared} AS shared FROM r), "
        "x AS (SELECT *, coalesce(parts[list_position(shared, list_max(shared))], '') AS x FROM z), "
        f"y AS (SELECT *, {a} AS a FROM x), w AS (SELECT *, CASE WHEN contains(a, {q}) AND contains(a, {p}) AND len({labelled}) > 0 THEN {last} ELSE a END AS b FROM y) "
        f"SELECT query_id, {_QUERY_LANGUAGE.replace('(x', '(question')} AS query_language, "
        f"CASE WHEN context = '' THEN {S(answering.NOT_FOUND)} WHEN len({W('b')}) > 3 THEN array_to_string(({W('b')})[1:2], ' ') ELSE b END AS answer, "
        f"CASE WHEN context = '' THEN 'none' ELSE 'extractive' END AS model_used, CASE WHEN context = '' THEN 0 ELSE confidence END AS confidence{more} FROM w"
    )


Q["ask_batch"] = _answers, answers_sql()



def _answer_sources(s: SparkSession, d: str) -> DataFrame:
    """What a client is shown behind each answer: the sources by rank."""
    asked, contents, queries, hits = _asked(s, d, 5)
    meta = _read(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.create_map(F.lit("lang"), "lang").alias("metadata"))
    context = answering.retrieve_context(hits, contents.join(meta, "vec_id"), queries)
    rows = asked.join(context, "query_id", "left").withColumn("memory", F.lit(""))
    out = answering.answer(rows, answering.ExtractiveGenerator()).select("query_id", "model_used", F.explode("sources").alias("s"))
    return out.select("query_id", "model_used", "s.rank", "s.score", "s.chunk_id", F.md5("s.content").alias("content_md5"), F.col("s.metadata")["lang"].alias("lang"))


Q["answer_sources"] = (
    _answer_sources,
    f"WITH {found_sql(5)} SELECT query_id, CASE WHEN string_agg(coalesce(text, ''), '') OVER (PARTITION BY query_id) = '' THEN 'none' ELSE 'extractive' END AS model_used, "
    "rank, score, vec_id::VARCHAR AS chunk_id, md5(coalesce(text, '')) AS content_md5, lang FROM found JOIN documents ON doc_id = vec_id",
)


def _engine_search(s: SparkSession, d: str) -> DataFrame:
    """Search by text in a store that an engine has saved and another loaded."""
    docs = _read(s, d, "documents").where(T.text_of("text") != "").orderBy("doc_id")
    bundle = embedding.encode(docs, embedding.HashingEmbedder(), "text", "vector").select(
        F.col("doc_id").cast("string").alias("chunk_id"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"), "vector"
    )
    path = stores.session_folder(s, "store")
    engine.Engine(s).build_from_bundle(bundle, path)
    opened = engine.Engine(s)
    opened.load(path)
    asked = _read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), T.text_of("text").alias("text"))
    found = opened.search(asked, 10, 0.3)
    return found.select("query_id", "rank", "score", "chunk_id", F.length("content").alias("length"), F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


Q["engine_search"] = (
    _engine_search,
    f"WITH {found_sql(10)} SELECT query_id, rank, score, vec_id::VARCHAR AS chunk_id, length(text)::INT AS length, lang, source FROM found JOIN documents ON doc_id = vec_id",
)

Q["json_fields"] = (
    lambda s, d: _read(s, d, "events").select("event_id", F.from_json("props", "k bigint, missing string").alias("p")).select("event_id", "p.k", F.coalesce("p.missing", F.lit("none")).alias("missing"), F.to_json(F.struct(F.col("p.k").alias("k"))).alias("again")),
    "SELECT event_id, (props->>'k')::BIGINT AS k, coalesce(props->>'missing', 'none') AS missing, '{\"k\":' || (props->>'k') || '}' AS again FROM events",
)

# --- evaluation ---------------------------------------------------------------


def _eval_rows(s: SparkSession, d: str) -> DataFrame:
    """Pairs of the conversations: the question is also the answer under test,
    the reply is truth and context.  Written rows cover what the tables lack."""
    pairs = memory.history_pairs(_read(s, d, "conversations"))
    own = s.createDataFrame(EVAL_SAMPLES, "id bigint, question string, answer string, truth string, context string")
    return pairs.select(
        (F.col("conv_id") * 1000 + F.col("pair")).alias("id"), "question", F.col("question").alias("answer"), F.col("answer").alias("truth"), F.col("answer").alias("context")
    ).unionByName(own)


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(_eval_rows(s, d), 6)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(S(v) for v in values) + "]"


def _content(x: str, drop: list[str]) -> str:
    return f"list_filter(list_distinct({W(f'lower({x})')}), lambda w: NOT list_contains({_list(drop)}, w))"


def _all(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {S(pattern)})"


def _both(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


_ga, _gc = _content("answer", P.STOP_WORDS), _content("context", P.STOP_WORDS)
_an, _cn = _all("answer", "\\p{Nd}+"), _all("context", "\\p{Nd}+")
_GROUND = f"""CASE WHEN answer = '' OR context = '' OR len({_ga}) = 0 THEN 0 ELSE least({_both(_ga, _gc)} / len({_ga})
 + CASE WHEN len(list_filter(string_split(lower(answer), '.'), lambda p: length(p) > 10 AND contains(lower(context), p))) > 0 THEN 0.2 ELSE 0 END
 + CASE WHEN len({_an}) > 0 AND len(list_filter({_an}, lambda n: NOT list_contains({_cn}, n))) = 0 THEN 0.1 ELSE 0 END, 1) END"""
_rq, _rc = _content("question", P.QUESTION_WORDS), f"list_distinct({W('lower(context)')})"
_qe, _ce = _all("question", f"[{P.ENTITY}]+"), _all("context", f"[{P.ENTITY}]+")
_RELEVANT = f"""CASE WHEN question = '' OR context = '' THEN 0 WHEN len({_rq}) = 0 THEN 0.5 ELSE least({_both(_rq, _rc)} / len({_rq})
 + CASE WHEN {T.sql_any('lower(context)', P.ANSWER_MARKS)} THEN 0.1 ELSE 0 END + CASE WHEN {_both(_rq, _rc)} >= 1 THEN 0.2 ELSE 0 END
 + least(0.3, 0.1 * len(list_filter({_qe}, lambda e: length(e) > 2 AND list_contains({_ce}, e)))), 1) END"""
_sa, _st = _content("answer", P.COMMON_WORDS), _content("truth", P.COMMON_WORDS)
_sn, _tn = _all("lower(answer)", P.NUMBER_WORDS), _all("lower(truth)", P.NUMBER_WORDS)
_se, _te = _all("answer", f"[{P.ENTITY}]{{3,}}"), _all("truth", f"[{P.ENTITY}]{{3,}}")
_SIMILAR = f"""CASE WHEN answer = '' OR truth = '' THEN 0 WHEN len({_sa}) = 0 OR len({_st}) = 0
 THEN CASE WHEN contains(lower(answer), lower(truth)) OR contains(lower(truth), lower(answer)) THEN 0.8 ELSE 0 END
 ELSE least({_both(_sa, _st)} / len(list_distinct(list_concat({_sa}, {_st})))
 + CASE WHEN len(list_intersect({_sn}, {_tn})) > 0 THEN 0.3 ELSE 0 END
 + least(0.2, 0.1 * len(list_filter({_te}, lambda e: list_contains({_se}, e)))), 1) END"""
_aw, _cw = f"len({W('answer')})", f"len({W('context')})"
_UTIL = f"""CASE WHEN answer = '' OR context = '' THEN 0 WHEN {T.sql_any('lower(answer)', P.GENERIC_PHRASES)} THEN 0.1
 WHEN {_cw} > 50 AND {_aw} < 5 THEN 0.2 ELSE least(0.7 * ({_GROUND}) + 0.3 * least({_aw} / greatest(0.1 * {_cw}, 1), 1), 1) END"""
_EVAL = f"""
WITH p AS ({_PAIRS}), r AS (SELECT conv_id * 1000 + pair AS id, question, question AS answer, answer AS truth, answer AS context FROM p
 UNION ALL SELECT * FROM (VALUES {_values(EVAL_SAMPLES)}) AS v(id, question, answer, truth, context)),
e AS (SELECT id, round(({_GROUND})::DOUBLE, 6) AS groundedness, round(({_RELEVANT})::DOUBLE, 6) AS relevance,
 round(({_SIMILAR})::DOUBLE, 6) AS semantic_similarity, round(({_UTIL})::DOUBLE, 6) AS context_utilization,
 {_sql_question_type('question')} AS question_type, {_aw}::INT AS answer_length, {_cw}::INT AS context_length FROM r)"""


def _metric(name: str, *more: str) -> tuple:
    return (lambda s, d: _evaluated(s, d).select("id", name, *more)), f"{_EVAL} SELECT " + ", ".join(("id", name, *more)) + " FROM e"


Q["eval_groundedness"] = _metric("groundedness", "answer_length", "context_length")
Q["eval_relevance"] = _metric("relevance", "question_type")
Q["eval_similarity_lexical"] = _metric("semantic_similarity")
Q["eval_context_utilization"] = _metric("context_utilization")
_PASSAGES = "SELECT id, {0} AS p FROM r WHERE answer <> '' AND truth <> ''"
Q["eval_similarity_embedded"] = (
    lambda s, d: evaluation.evaluate(_eval_rows(s, d), 6, embedding.HashingEmbedder()).select("id", "semantic_similarity"),
    f"{_EVAL}, {_sql_embedded('av', _PASSAGES.format(_sql_passage('answer')))}, {_sql_embedded('tv', _PASSAGES.format(_sql_passage('truth')))}, "
    "dots AS (SELECT av.id, sum(av.v * tv.v) AS dot FROM av JOIN tv USING (id, dim) GROUP BY 1), "
    "an AS (SELECT id, sqrt(sum(v * v)) AS n FROM av GROUP BY 1), tn AS (SELECT id, sqrt(sum(v * v)) AS n FROM tv GROUP BY 1) "
    "SELECT r.id, round(coalesce(dot / (an.n * tn.n), 0), 6)::DOUBLE AS semantic_similarity FROM r LEFT JOIN dots USING (id) LEFT JOIN an USING (id) LEFT JOIN tn USING (id)",
)


def _bin(c: str) -> str:
    return f"CASE WHEN {c} >= 0.7 THEN 'good' WHEN {c} >= 0.4 THEN 'fair' ELSE 'poor' END"


_BINS = ", ".join(f"count(*) FILTER ({_bin(c)} = '{b}') AS {c}_{b}" for c in ("groundedness", "relevance") for b in ("good", "fair", "poor"))
_MEANS = ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in ("groundedness", "relevance", "semantic_similarity", "context_utilization"))
Q["eval_summary"] = lambda s, d: evaluation.summary(_evaluated(s, d)), f"{_EVAL} SELECT count(*) AS total_questions, {_MEANS}, {_BINS} FROM e"
Q["eval_distribution"] = (
    lambda s, d: evaluation.distribution(_evaluated(s, d)),
    f"{_EVAL} SELECT metric, {_bin('score')} AS bin, count(*) AS n FROM (SELECT 'groundedness' AS metric, groundedness AS score FROM e "
    "UNION ALL SELECT 'relevance', relevance FROM e) GROUP BY 1, 2",
)
Q["eval_by_type"] = (
    lambda s, d: evaluation.by_type(_evaluated(s, d)),
    f"{_EVAL} SELECT question_type, count(*) AS n, round(avg(groundedness), 6) AS avg_groundedness, round(avg(relevance), 6) AS avg_relevance, "
    "round(avg(semantic_similarity), 6) AS avg_semantic_similarity FROM e GROUP BY 1",
)


#: Measures of (question, answer, context), and chunks of the documents alone.
GROUND_SQL, RELEVANT_SQL, UTIL_SQL, QUESTION_TYPE_SQL = _GROUND, _RELEVANT, _UTIL, _sql_question_type("question")
DOCUMENT_CHUNKS_SQL = _DEDUP_SQL.replace(TEXTS, "t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS x FROM documents)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql is not None}
