"""SQL of the chunkers by paragraph, by structure and mixed, for comparison.

The structure scan is written as sets: sections become groups by windows over
the sections before them, and groups and single sections become numbered events.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import text as T
from ..operators.chunking import MIN_SIZE, SIZE

W = T.sql_words


class ChunkSql:
    """Builds the statements from the catalog's expressions for a text x: its
    language, content type, trimmed form, sentences (of x in language l, then the
    fallback) and the fold r of sentences p into long parts."""

    def __init__(self, language: str, content_type: Callable[[str], str], trim: Callable[[str], str], found: str, fallback: str, fold: str):
        self.language, self.content_type, self.trim = language, content_type, trim
        self.found, self.fallback, self.fold = found, fallback, fold

    def long_parts(self, name: str, source: str, keys: str) -> str:
        """CTE ``name`` (keys, n, c): the parts of each long x of ``source``."""
        kept = f"CASE WHEN length({self.trim('r.cur')}) >= {MIN_SIZE} THEN list_append(r.out, r.cur) ELSE r.out END"
        return (
            f"{name}_e AS (SELECT {keys}, x, {self.found} AS f FROM {source} WHERE length(x) > {SIZE}), "
            f"{name}_s AS (SELECT {keys}, CASE WHEN len(f) > 0 THEN f ELSE {self.fallback} END AS p FROM {name}_e), "
            f"{name}_g AS (SELECT {keys}, {self.fold} AS r FROM {name}_s), {name}_k AS (SELECT {keys}, {kept} AS parts FROM {name}_g), "
            f"{name} AS (SELECT {keys}, n - 1 AS n, parts[n] AS c FROM {name}_k, unnest(range(1, len(parts) + 1)) AS u(n))"
        )

    def sections(self, source: str, separator: str) -> str:
        """CTE sec (doc_id, i, x, l, k): the sections that are long enough."""
        return (
            f"cut AS (SELECT doc_id, {separator} AS s FROM {source}), "
            f"piece AS (SELECT doc_id, i - 1 AS i, {self.trim('s[i]')} AS x FROM cut, unnest(range(1, len(s) + 1)) AS u(i)), "
            f"sec AS (SELECT doc_id, i, x, {self.language} AS l, {self.content_type('x')} AS k FROM piece WHERE length(x) >= {MIN_SIZE})"
        )

    def paragraphs(self, source: str, separator: str) -> str:
        """CTE para (doc_id, i, n, chunk columns)."""
        return (
            f"{self.sections(source, separator)}, {self.long_parts('part', 'sec', 'doc_id, i, l, k')}, para AS ("
            f"SELECT doc_id, i, 0 AS n, x AS content, 'page_1_para_' || i AS chunk_id, i AS chunk_index, l AS language, k AS content_type, x AS raw FROM sec WHERE length(x) <= {SIZE} "
            f"UNION ALL SELECT doc_id, i, n, {self.trim('c')}, 'page_1_para_' || i || '_sub_' || n, i * 100 + n, l, k, c FROM part)"
        )

    def structure(self, source: str, separator: str, observed: bool) -> str:
        """CTE made (doc_id, place, late, n, chunk columns): all chunks, in order of
        the section at which they are made, a group's before the section's own."""
        prose, stop = "k IN ('paragraph', 'definition')", "k IN ('mcq', 'answer_table')"
        ahead = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        was_prose = "coalesce(before IN ('paragraph', 'definition'), false)"
        return (
            f"{self.sections(source, separator)}, "
            f"w AS (SELECT *, {prose} AS prose, last_value(CASE WHEN {prose} OR {stop} THEN k END IGNORE NULLS) {ahead} AS before FROM sec), "
            f"v AS (SELECT *, prose AND (before IS DISTINCT FROM k) AS opens, {was_prose} AND (({prose} AND before <> k) OR {stop}) AS closes, prose OR (k = 'table' AND {was_prose}) AS member FROM w), "
            "y AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM v), "
            "held AS (SELECT doc_id, g, string_agg(CASE WHEN opens THEN x WHEN prose THEN chr(10) || chr(10) || x ELSE chr(10) || chr(10) || 'Table:' || chr(10) || x END, '' ORDER BY i) AS x, "
            "max(k) FILTER (prose) AS k FROM y WHERE member GROUP BY doc_id, g), "
            "shut AS (SELECT doc_id, g - opens::INT AS g, i, l FROM y WHERE closes), "
            "ev AS (SELECT doc_id, i AS place, 1 AS late, x, k, l FROM y WHERE NOT member "
            f"UNION ALL SELECT doc_id, coalesce(i, 1000000000), 0, x, k, coalesce(shut.l, {self.language}) FROM held LEFT JOIN shut USING (doc_id, g)), "
            f"{self.long_parts('part', 'ev', 'doc_id, place, late, l, k')}, "
            "has AS (SELECT doc_id, place, late, count(*) AS m FROM part GROUP BY ALL), "
            f"num AS (SELECT ev.*, coalesce(sum((length(x) <= {SIZE} OR m > 0)::INT) OVER (PARTITION BY doc_id ORDER BY place, late ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS i "
            "FROM ev LEFT JOIN has USING (doc_id, place, late)), "
            f"made AS (SELECT doc_id, place, late, 0 AS n, {self.trim('x')} AS content, 'page_1_' || k || '_' || i AS chunk_id, i AS chunk_index, l AS language, k AS content_type, x AS raw FROM num WHERE length(x) <= {SIZE} "
            f"UNION ALL SELECT doc_id, place, late, n, {self.trim('c')}, 'page_1_para_' || i || '_sub_' || n, i * 100 + n, part.l, part.k, c FROM part JOIN num USING (doc_id, place, late)"
            + (" WHERE n = 0)" if observed else ")")
        )


CHUNK = f"content, chunk_id, chunk_index::INT AS chunk_index, language, content_type, len({W('raw')})::INT AS word_count, length(raw)::INT AS char_count"
