"""SQL (DuckDB) that says the same as the queries on conversations."""

from __future__ import annotations

#: CRC-32 of short ASCII strings: a table of 256 remainders, made by its rule.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, n: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS k"""


def crc(s: str) -> str:
    """CRC-32 of the expression ``s``, where ``k`` of CRC_TABLE can be seen."""
    chars = f"list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda a, b: xor(a // 256, k[1 + xor(a, b) % 256])), 4294967295)"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _edit(state: str, letter: str, cost: str, turn: str | None = None) -> str:
    """A way of editing on from ``state``: (cost so far, letters, turns)."""
    turns = f"{state}.x" if turn is None else f"list_append({state}.x, {turn})"
    return f"{{'k': ({state}.k + {cost})::BIGINT, 'a': {state}.a || '{letter}', 'x': {turns}}}"


def _kept(initial: str, *states: str) -> list[str]:
    cost = f"CASE WHEN f IN ('b', 'd') OR i <> '{initial}' THEN 1000000000 WHEN f = 't' THEN 3 ELSE 0 END"
    return [_edit(s, "K", cost, "r || ':' || x") for s in states]


def _rerole(role: str, *states: str) -> list[str]:
    cost = "CASE WHEN f IN ('b', 'd') THEN 1000000000 WHEN f = 't' THEN 6 ELSE 3 END"
    return [_edit(s, "R", cost, f"'{role}:' || x") for s in states]


def _closed(e: dict[str, str]) -> tuple[str, str]:
    """The states after user and after assistant, once empty turns may follow."""
    user = _least(e["u"], *(_edit(e[s], "I", "3", "'user:'") for s in ("n", "s", "a")))
    return user, _least(e["a"], _edit("u", "I", "3", "'assistant:'"))


_AFTER = {"n": "en", "s": "es", "u": "eu", "a": "ea"}
_NEVER = "{'k': 1000000000::BIGINT, 'a': '', 'x': []::VARCHAR[]}"
_BEGIN = "{'k': 0::BIGINT, 'a': '', 'x': []::VARCHAR[]}"

OP11 = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations, crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS r, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS x, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE harm <> 0
),
placed AS (SELECT *, left(r, 1) AS i, rtrim(x, E' \\t\\n\\x0b\\f\\r') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS rn FROM harmed),
faults AS (
  SELECT *, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY rn) > 1 THEN 'd' WHEN right(t, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS f,
    lag(i) OVER (PARTITION BY conv_id ORDER BY rn) AS before
  FROM placed
),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows_left
  FROM faults GROUP BY conv_id
),
dp AS (
  SELECT c AS conv_id, 0::BIGINT AS rn, {_BEGIN} AS n, {_NEVER} AS s, {{'k': 3::BIGINT, 'a': 'I', 'x': ['user:']}} AS u, {{'k': 6::BIGINT, 'a': 'II', 'x': ['user:', 'assistant:']}} AS a FROM (SELECT DISTINCT conv_id AS c FROM conversations)
  UNION ALL
  SELECT conv_id, rn, en AS n, es AS s, u, {_closed(_AFTER)[1]} AS a FROM (
    SELECT *, {_closed(_AFTER)[0]} AS u FROM (
      SELECT dp.conv_id, dp.rn + 1 AS rn, {_edit("n", "D", "4")} AS en, {_least(_edit("s", "D", "4"), *_kept("s", "n"))} AS es,
        {_least(_edit("u", "D", "4"), *_kept("u", "n", "s", "a"), *_rerole("user", "n", "s", "a"))} AS eu, {_least(_edit("a", "D", "4"), *_kept("a", "u"), *_rerole("assistant", "u"))} AS ea
      FROM dp JOIN faults ON faults.conv_id IS NOT DISTINCT FROM dp.conv_id AND faults.rn = dp.rn + 1
    )
  )
),
best AS (SELECT dp.conv_id, {_least("dp.n", "dp.a")} AS b, gaps, blank, duplicate, truncated, illegal FROM dp LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.rn = coalesce(facts.rows_left, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.k AS cost, b.a AS audit,
  sha256(array_to_string(b.x, chr(10))) AS repaired_sha256
FROM best
"""

OP13 = f"""
WITH crc AS ({CRC_TABLE}),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {crc("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM turns), crc),
built AS (
  SELECT convs.c, 0 AS own, p, {{'r': r, 'x': x}} AS t FROM convs JOIN turns ON turns.c = convs.c - convs.c % 5 AND p <= h
  UNION ALL
  SELECT convs.c, 1, p, {{'r': r, 'x': x}} FROM convs JOIN turns ON turns.c = convs.c AND p > h
),
whole AS (SELECT convs.c, coalesce(list(t ORDER BY own, p) FILTER (t IS NOT NULL), []) AS s FROM convs LEFT JOIN built ON built.c = convs.c GROUP BY convs.c),
members AS (SELECT c, s, len(s) AS n, unnest(range(len(s) + 1)) AS d FROM whole),
nodes AS (SELECT d, s[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].x) END) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM members GROUP BY d, s[1:d]),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
above AS (SELECT unnest(range(d + 1)) AS a, k, saved, n_children FROM known),
sums AS (SELECT a AS d, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM known x JOIN sums USING (d, k) LEFT JOIN nodes p ON p.d = x.d - 1 AND p.k = x.k[1:x.d - 1]
"""
