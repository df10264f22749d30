"""Columns that SQL can express, of queries whose models it can't: urls' parts and rules, base figures of quality, base counts of personal data."""

import duckdb
import pytest

from rowkeel.llm import queries

BLANK = r"[^\x20\x09-\x0D]+"
SQL = {
    "op4_urlfilter": r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rule(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path, (SELECT h || rule.p FROM rule WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rule.p) ORDER BY length(h || rule.p) DESC LIMIT 1) AS rule FROM p
""",
    "op7_qualityrules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{BLANK}') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
       len(list_filter(ls, lambda l: regexp_matches(l, '{BLANK}'))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '{BLANK}')))) AS n_dup_lines,
       coalesce(n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN rep USING (doc_id)
""",
    "op10_pii": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
             regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phones, list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS cards FROM d)
SELECT doc_id, n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0)) AS n_ip,
       len(list_filter(cards, lambda c: length(c) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN (length(c) - i) % 2 = 0 THEN c[i]::INT ELSE (2 * c[i]::INT) // 10 + (2 * c[i]::INT) % 10 END)) % 10 = 0)) AS n_card,
       len(list_filter(phones, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM f
""",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_base_columns_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(queries.queries()[name](spark, sf_dir).select(*names).collect()) == rows(got.fetchall())
