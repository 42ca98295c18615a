"""The same rows in SQL (DuckDB's dialect) for the operators that SQL can express, by brute force."""

from __future__ import annotations

from .lines import MIN_SITES
from .rules import COMMON_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Components of links (a, b) among ids (id), as comp(id, component).
COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(id, to_id) AS (SELECT id, id FROM ids UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.to_id),
comp AS (SELECT id, min(to_id) AS component FROM reach GROUP BY id)"""

OP2 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
ids AS (SELECT doc_id AS id FROM d),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.id = d.doc_id"""

OP4 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS s, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM win) WHERE nth > 1),
cov AS (SELECT DISTINCT doc_id, p + k AS p, true AS c FROM rep, range(20) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
left_over AS (SELECT doc_id, count(c) AS n, string_agg(word, ' ' ORDER BY p) FILTER (c IS NULL) AS kept FROM words LEFT JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)"""

OP5 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
ids AS (SELECT vec_id AS id FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9), {COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM both_ways w WHERE w.a = vec_id) AS n_links, component AS component_id, vec_id = component AS kept FROM v JOIN comp ON comp.id = vec_id"""


def _listed() -> str:
    each = " ".join("WHEN '" + code + "' THEN [" + ", ".join(f"'{w}'" for w in words) + "]" for code, words in COMMON_WORDS.items())
    return f"CASE lang {each} ELSE [] END"


def _count(pattern: str) -> str:
    return f"length(regexp_replace(t, '[^{pattern}]+', '', 'g'))"


def _distance(a: str, b: str) -> str:
    p, q = f"({a}[i] / list_sum({a}))", f"({b}[i] / list_sum({b}))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    inner = f"({part(p)} + {part(q)}) / 2"
    return f"CASE WHEN n_words >= 50 AND len({a}) > 0 AND list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda i: {inner})), 0)) END"


def _rules() -> str:
    space, mark = r"\x20\x09-\x0D", r".,;:!?''\"()\-"
    n = 1 + max(map(len, COMMON_WORDS.values()))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, CASE WHEN lang IN ({', '.join(f"'{c}'" for c in COMMON_WORDS)}) THEN lang ELSE '' END AS lang FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win), range(3) t(k) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[{space}]+', '', 'g')) AS word_chars, {_count('#*$%&|<>')} AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines, {_listed()} AS listed,
  [{_count(r'\p{Ll}')}, {_count(r'\p{Lu}')}, {_count(space)}, {_count(r'\p{Nd}')}, {_count(mark)}]::DOUBLE[] AS five,
  list_filter(regexp_extract_all(lower(t), '\p{{L}}+'), lambda x: list_contains({_listed()}, x)) AS found FROM d),
g AS (SELECT f.*, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, list_append(five, length(t) - list_sum(five)) AS classes,
  CASE WHEN len(listed) > 0 THEN list_append(list_transform(listed, lambda l: CAST(len(list_filter(found, lambda x: x = l)) AS DOUBLE)), CAST(n_words - len(found) AS DOUBLE)) ELSE [] END AS common FROM f LEFT JOIN rep USING (doc_id)),
r AS (SELECT lang, [{', '.join(f'sum(classes[{i}])' for i in range(1, 7))}] AS ref_classes, [{', '.join(f'sum(common[{i}])' for i in range(1, n + 1))}] AS ref_common FROM g GROUP BY lang),
j AS (SELECT *, {_distance('classes', 'ref_classes')} AS js_a, {_distance('common', 'ref_common')} AS js_b FROM g JOIN r USING (lang)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(js_a, 0) <= 0.27 AND coalesce(js_b, 0) <= 0.36 AS kept, round(js_a, 6) AS js_classes, round(js_b, 6) AS js_common FROM b"""


OP7 = _rules()

OP8 = rf"""WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text <> ''),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
m AS (SELECT bare, count(DISTINCT site) AS sites, min((doc_id, pos)) AS first FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT b.doc_id, b.pos, b.line, m.bare IS NOT NULL AND m.first <> (b.doc_id, b.pos) AS gone FROM b LEFT JOIN m USING (bare)),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS left_over FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN n_removed > 0 THEN coalesce(left_over, '') ELSE d.text END AS text FROM documents d LEFT JOIN o USING (doc_id)"""
