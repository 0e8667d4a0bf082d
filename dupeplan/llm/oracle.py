"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import math

from dupeplan.llm import license

_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _licenses() -> str:
    """Words of whole texts, places of phrases, and the share of each template's words that a line holds, or a run of words over line breaks that is as long as the template over the threshold."""
    words = lambda t: f"list_filter(string_split_regex({t}, '{_GAP}'), lambda x: x <> '')"
    places, labels = [], []
    for phrase, label in license.PHRASES.items():
        own = phrase.split(" ")
        at = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(own))
        places.append(f"list_filter(range(0, greatest(len(w) - {len(own) - 1}, 0)), lambda i: {at})")
        labels.append(f"CASE WHEN len({places[-1]}) > 0 THEN ['{label}'] ELSE [] END")
    listed = lambda body: "[" + ", ".join(f"'{t}'" for t in sorted(set(license.tokens_of(body)))) + "]"
    length = lambda body: math.ceil(len(license.tokens_of(body)) / license.THRESHOLD - 1e-9)
    templates = ", ".join(f"('{label}', {listed(body)}, {length(body)})" for label, body in license.TEMPLATES)
    enough = lambda own: f"len(list_intersect({own}, body)) >= {license.THRESHOLD} * len(body) - 1e-9"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}') AS t FROM documents),
s AS (SELECT r, doc_id, {words("t")} AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n, flatten([{", ".join(places)}]) AS places, flatten([{", ".join(labels)}]) AS base FROM s),
lines AS (SELECT r, list_distinct({words("line")}) AS own FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
x(label, body, l) AS (VALUES {templates}),
runs AS (SELECT r, label, body, w[i : i + l - 1] AS own FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s, x WHERE {enough("w")})),
m AS (SELECT r, label, CAST(len(list_intersect(own, body)) AS DOUBLE) / len(body) AS share FROM (SELECT r, label, body, own FROM lines, x UNION ALL FROM runs) WHERE {enough("own")}),
f AS (SELECT r, list(DISTINCT label) AS more, max(share) AS most FROM m GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ','), '') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN f USING (r)"""


#: All windows of 100 bytes; those that are not the first of their bytes cover what goes.
_REPEATS = """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT r, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p FROM d)),
again AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY s ORDER BY r, p) AS k FROM w) WHERE k > 1),
marked AS (SELECT r, p, CASE WHEN lag(p) OVER o IS NULL OR p > lag(p) OVER o + 100 THEN 1 ELSE 0 END AS starts FROM again WINDOW o AS (PARTITION BY r ORDER BY p)),
spans AS (SELECT r, min(p) AS a, max(p) + 100 AS b FROM (SELECT r, p, sum(starts) OVER (PARTITION BY r ORDER BY p) AS k FROM marked) GROUP BY r, k),
kept AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS after FROM (SELECT r, a, b FROM spans UNION ALL SELECT r, len(h) // 2, NULL FROM d)),
rest AS (SELECT r, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS h FROM kept JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(rest.h)) AS kept_sha256
FROM d JOIN rest USING (r) LEFT JOIN (SELECT r, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY r) USING (r)"""

SQL = {"op7_license_scan": _licenses(), "op9_suffix_dedup": _REPEATS}
