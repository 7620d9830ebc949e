"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from bookpulse.llm import quality_rules

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = rf"""
WITH item AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), size AS (SELECT DISTINCT m FROM pattern
), place AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS words
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM doc, size WHERE len(w) >= m)
), found AS (
  SELECT DISTINCT p.r, p.m, p.i, q.item_id FROM place p JOIN pattern q ON p.m = q.m AND p.words = q.words
), hit AS (
  SELECT r, count(DISTINCT word) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS word FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_OP7 = r"""
WITH page AS (
  SELECT source, text, count(*) AS copies FROM documents WHERE source IS NOT NULL GROUP BY source, text
), total AS (SELECT source, sum(copies) AS pages FROM page GROUP BY source
), line AS (
  SELECT source, copies, unnest(list_distinct(list_transform(string_split(text, chr(10)),
    lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM page
), bad AS (
  SELECT source, list(line) AS lines FROM (
    SELECT source, line, sum(copies) AS on_pages, count(*) AS texts FROM line WHERE line <> '' GROUP BY source, line
  ) JOIN total USING (source) WHERE texts >= 2 AND on_pages > pages * 0.1 GROUP BY source
), cut AS (
  SELECT doc_id, d.source, text, string_split(text, chr(10)) AS old,
    list_filter(string_split(text, chr(10)), lambda x:
      NOT list_contains(coalesce(lines, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
  FROM documents d LEFT JOIN bad ON d.source = bad.source
)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  coalesce(len(old), 0) AS n_lines, coalesce(len(old) - len(kept), 0) AS n_dropped
FROM cut
"""

_OP9 = """
WITH page AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), first AS (
  SELECT payload_digest, min(page_id) AS first FROM page WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to,
  true AS verified
FROM page LEFT JOIN first USING (payload_digest)
"""

_OP11 = r"""
WITH doc AS (
  SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS other
  FROM documents
), hashed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, {leaf} AS h,
    CASE WHEN other IS NOT NULL THEN {other} END AS o
  FROM doc
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY key) AS n
  FROM hashed
), {docs}
source AS (
  SELECT '' AS key, key AS of, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM doc_top
), {sources}
doc_start AS (SELECT *, coalesce(o, h) AS f, '' AS siblings FROM leaf
), {folds}
source_start AS (
  SELECT d.doc_id, d.h AS leaf, s.h AS subroot, '' AS key, s.i, d.f, d.siblings FROM doc_end d JOIN source s ON d.key = s.of
), {source_folds}
done AS (SELECT e.*, t.h AS root FROM source_end e, source_top t)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, f AS folded_root, f = root AS verified FROM done
"""


def _op11(levels: int = 7) -> str:
    """Unrolled for up to 16 ** levels documents a source, and as many sources."""
    def fields(text: str) -> str:
        return "sha256({})".format(" || ".join(
            f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)))

    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: list_transform(range(8), lambda j: (ascii(c) >> j) & 1)))), "
        "lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    )

    def tree(name: str, base: str) -> str:
        out = [f"{name}_0 AS (SELECT key, i, n, h FROM {base}"]
        for k in range(levels):
            used, run = f"n > {16 ** k}", "OVER (PARTITION BY key, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(
                f"{name}_step_{k} AS (SELECT key, i, {used} AS used, "
                f"CASE WHEN {used} THEN coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS before, "
                f"CASE WHEN {used} THEN coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS after "
                f"FROM {name}_{k}")
            out.append(
                f"{name}_{k + 1} AS (SELECT key, i // 16 AS i, n, CASE WHEN {used} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h "
                f"FROM {name}_{k} GROUP BY key, i // 16, n")
        out.append(f"{name}_top AS (SELECT key, h FROM {name}_{levels}")
        return "\n), ".join(out) + "\n),"

    def folds(name: str, columns: str) -> str:
        out, before = [], f"{name}_start"
        for k in range(levels):
            after = f"{name}_fold_{k}" if k + 1 < levels else f"{name}_end"
            out.append(
                f"{after} AS (SELECT {columns}, a.key, a.i, CASE WHEN used THEN sha256(before || f || after) ELSE f END AS f, "
                f"siblings || before || after AS siblings FROM {before} a JOIN {name}_step_{k} s ON s.key = a.key AND s.i = a.i // {16 ** k}")
            before = after
        return "\n), ".join(out) + "\n),"

    return (
        _OP11.replace("{crc}", crc).replace("{leaf}", fields("text")).replace("{other}", fields("other"))
        .replace("{docs}", tree("doc", "leaf")).replace("{sources}", tree("source", "source"))
        .replace("{folds}", folds("doc", "doc_id, h")).replace("{source_folds}", folds("source", "doc_id, leaf, subroot"))
    )


_OP12 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')),
      lambda x: x) AS lines
  FROM documents
), triple AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS words
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM doc WHERE len(w) > 2)
), often AS (SELECT r, words FROM triple GROUP BY r, words HAVING count(*) > 1
), again AS (
  SELECT r, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT r, unnest(generate_series(i, i + 2)) AS place FROM triple JOIN often USING (r, words)) GROUP BY r
), stop AS (SELECT list(s) || list(upper(s[1]) || s[2:]) AS words FROM (SELECT unnest([{stop}]) AS s)
), measured AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(w, lambda x: list_contains(words, x))) AS n_stop_words,
    len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM doc LEFT JOIN again USING (r), stop
), verdict AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([{rules}], lambda x: x IS NOT NULL) AS failed
  FROM measured
)
SELECT * EXCLUDE failed, array_to_string(failed, ',') AS failed_rules, NOT base_failed AND len(failed) = 0 AS kept FROM verdict
"""

_OP13 = rf"""
WITH asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
  GROUP BY item_id, term
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE len({_WORDS}) > 0
), corpus AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM doc
), found AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM found GROUP BY term), corpus
), norm AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * n_docs) // n_terms) AS m FROM doc, corpus
), scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN found USING (term) JOIN weight USING (term) JOIN norm USING (r) GROUP BY item_id, r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _op12() -> str:
    def sides(rule) -> str:
        low = [] if rule.low is None else [f"1000 * {rule.part} < {rule.low} * {rule.whole}"]
        high = [] if rule.high is None else [f"1000 * {rule.part} > {rule.high} * {rule.whole}"]
        return f"CASE WHEN {' OR '.join(low + high)} THEN '{rule.name}' END"

    words = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return _OP12.replace("{stop}", words).replace("{rules}", ", ".join(map(sides, quality_rules.RULES)))


ORACLES = {"op1_decontaminate": _OP1, "op7_line_dedup": _OP7, "op9_warc": _OP9, "op11_merkle": _op11(), "op12_quality_rules": _op12(),
           "op13_ranked_search": _OP13}
