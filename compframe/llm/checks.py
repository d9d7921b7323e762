"""DuckDB SQL for what SQL can express of the registered queries."""

from __future__ import annotations

CHECKS: dict[str, str] = {}

#: Words of every document, numbered from 0.
_WORDS = r"""
words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents))"""

CHECKS["op8_substrings"] = f"""
WITH {_WORDS},
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS t, n
  FROM words),
marked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1 AS again FROM windows WHERE i + 20 <= n),
covered AS (
  SELECT w.doc_id, w.word, w.i,
    coalesce(max(m.again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN marked m USING (doc_id, i)),
summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN summed s USING (doc_id)
"""


def _centroid_rounds(k: int = 16, rounds: int = 3) -> str:
    """Assignments and centroids of every round, each a CTE of its own."""
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = [f"""kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster, v AS c
  FROM kept QUALIFY cluster < {k})"""]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS (SELECT rid, vec_id, v, cluster, {far} AS distance FROM kept, c{r}
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT cluster, j, sum(x) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY cluster, j),
m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return ",\n".join(out)


CHECKS["op13_centroids"] = f"""
WITH {_centroid_rounds()}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _with(x: str, cost: str, edit: str, line: str | None) -> str:
    """A path of least cost, edits and repaired lines, with one more edit in front."""
    lines = f"list_prepend({line}, {x}.t)" if line else f"{x}.t"
    return f"{{'c': {cost} + {x}.c, 'a': '{edit}' || {x}.a, 't': {lines}}}"


def _conversation_paths() -> str:
    """Cheapest paths from every turn to the end, by state: nothing yet, after s, after u, after a."""
    onward, names = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    kept = {0: "WHEN 's' THEN x1 WHEN 'u' THEN x2", 1: "WHEN 'u' THEN x2", 2: "WHEN 'a' THEN x3", 3: "WHEN 'u' THEN x2"}
    base = []
    for q in range(4):
        to = f"CASE left(role, 1) {kept[q]} END"
        base.append(_least(
            _with(f"x{q}", "4", "D", None),
            f"CASE WHEN fault NOT IN (1, 2) THEN {_with(f'x{onward[q]}', '3 + extra', 'R', chr(39) + names[q] + ':' + chr(39) + ' || text')} END",
            f"CASE WHEN fault NOT IN (1, 2) AND {to} IS NOT NULL THEN {_with(f'({to})', 'extra', 'K', chr(39).join(('role || ', ':', ' || text')))} END")
            + f" AS x{q}")
    out = f"SELECT conv_id, i, {', '.join(base)} FROM (SELECT d.*, r.role, r.text, r.fault, CASE r.fault WHEN 3 THEN 3 ELSE 0 END AS extra FROM paths d JOIN judged r USING (conv_id, i))"
    for _ in range(3):
        more = [_least(f"x{q}", _with(f"x{onward[q]}", "3", "I", f"'{names[q]}:'")) + f" AS x{q}" for q in range(4)]
        out = f"SELECT conv_id, i, {', '.join(more)} FROM ({out})"
    return f"SELECT conv_id, i - 1, x0, x1, x2, x3 FROM ({out})"


CHECKS["op11_conversations"] = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc_table),
harmed AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), copy) AS i FROM harmed),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 3 ELSE 0 END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed),
sizes AS (
  SELECT conv_id, count(judged.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN judged USING (conv_id) GROUP BY conv_id),
paths AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS x0, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} AS x1,
    {{'c': 3, 'a': 'I', 't': ['assistant:']}} AS x2, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS x3
  FROM sizes
  UNION ALL
  {_conversation_paths()})
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(x0.c AS BIGINT) AS cost, x0.a AS audit,
  sha256(array_to_string(x0.t, chr(10))) AS repaired_sha256
FROM sizes JOIN paths USING (conv_id) WHERE i = 0
"""
