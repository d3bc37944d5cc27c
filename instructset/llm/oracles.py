"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import string

_WORD = r"[^\x20\x09-\x0D]+"

#: Words with A-Z as a-z; shingles of three words, or all words if there are fewer.
NEAR_DUPLICATES = f"""WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
        THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) m USING (doc_id)"""

#: Windows of 35 words; words hold no spaces, so a joined window is its word sequence.
SUBSTRINGS = f"""WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
    FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM split LEFT JOIN kept k USING (doc_id)"""


def _clusters(k: int, rounds: int, dimensions: int, salt: int, scale: int) -> str:
    """All rounds one after another. Products of integers this small are exact as doubles."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v
        FROM kept QUALIFY k < {k})""",
    ]
    inner = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
    distance = " + ".join(
        [inner.format(a="x.v", b="x.v"), inner.format(a="c.v", b="c.v"), f"-2 * {inner.format(a='x.v', b='c.v')}"]
    )
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, x.v, k, ({distance})::BIGINT AS d FROM kept x CROSS JOIN c{i} c
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
                SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY p) AS v FROM (
                    SELECT k, p, sum(x)::BIGINT AS t, count(*) AS n FROM (
                        SELECT k, unnest(v) AS x, unnest(range(1, {dimensions + 1})) AS p FROM a{i}) GROUP BY k, p) GROUP BY k) m USING (k))"""
            )
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
        (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} c USING (k)"""


CLUSTERS = _clusters(40, 5, 64, 2, 256)


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, edit: str, line: str | None = None) -> str:
    """A state's cost, audit and text after one more edit."""
    body = f"{state}.b" if line is None else f"coalesce({state}.b || chr(10), '') || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'b': {body}}}"


def _spread(states: dict[str, str], source: str) -> str:
    """Columns n, s, u, a from ``source`` with insertions: a user's row leads to u from n, s and a, an assistant's to a from u."""
    made = ", ".join(f"{way} AS {name}" for name, way in states.items())
    user = _least("u", *[_way(x, "3", "I", "'user:'") for x in "nsa"])
    assistant = _least("a", _way("u", "3", "I", "'assistant:'"))
    return f"""SELECT * REPLACE ({assistant} AS a) FROM (SELECT * REPLACE ({user} AS u) FROM (SELECT *, {made} FROM {source}))"""


_START = "{'c': 0::BIGINT, 'a': '', 'b': NULL::VARCHAR}"
_NEVER = "{'c': 1000000000::BIGINT, 'a': '', 'b': NULL::VARCHAR}"
_KEPT = "role || ':' || text"


def _after_row(initial: str, sources: str, role: str | None) -> list[str]:
    """Ways into a state by a kept row of an initial and by a row with another role."""
    out = []
    for x in sources:
        old = f'"o{x}"'
        out.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_way(old, 'more', 'K', _KEPT)} ELSE {_NEVER} END")
        if role:
            out.append(f"CASE WHEN NOT gone THEN {_way(old, '3 + more', 'R', f"'{role}:' || text")} ELSE {_NEVER} END")
    return out


_ROW = {
    "n": _way('"on"', "4", "D"),
    "s": _least(_way("os", "4", "D"), *_after_row("s", "n", None)),
    "u": _least(_way("ou", "4", "D"), *_after_row("u", "nsa", "user")),
    "a": _least(_way("oa", "4", "D"), *_after_row("a", "u", "assistant")),
}

_FIRST = {"n": _START, "s": _NEVER, "u": _NEVER, "a": _NEVER}
_NEXT = """(SELECT f.*, p.n AS "on", p.s AS os, p.u AS ou, p.a AS oa
            FROM steps p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)"""

#: Rows are ordered by turn, nulls first, then by role and the text's MD5. The cheapest edits are found row by row, one way for
#: each state of the pattern.
CONVERSATIONS = f"""WITH RECURSIVE bits AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, x:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(0, 256)) AS i)),
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    chances AS (SELECT named.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS chance FROM named, bits),
    damaged AS (SELECT conv_id, turn, CASE WHEN chance = 4 THEN 'user' ELSE role END AS role,
            CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN chance = 3 THEN [1, 2] ELSE [1] END) AS copy FROM chances WHERE chance <> 0),
    placed AS MATERIALIZED (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text
            ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare,
            lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS met, row_number() OVER w > 1 AS later
        FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
    faults AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS initial, bare = '' AS blank, bare <> '' AND again > 1 AS duplicate,
            bare <> '' AND again = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, bare = '' OR again > 1 AS gone,
            CASE WHEN bare <> '' AND again = 1 AND right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM placed),
    steps AS (SELECT conv_id, 0::BIGINT AS i, n, s, u, a FROM ({_spread(_FIRST, "(SELECT DISTINCT conv_id FROM conversations)")})
        UNION ALL SELECT conv_id, i, n, s, u, a FROM ({_spread(_ROW, _NEXT)})),
    sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
            count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
            count(*) FILTER (later AND met NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY 1),
    ends AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, {_least("p.n", "p.a")}.c AS cost,
        {_least("p.n", "p.a")}.a AS audit, sha256(coalesce({_least("p.n", "p.a")}.b, '')) AS repaired_sha256
    FROM ends e LEFT JOIN sums m ON m.conv_id IS NOT DISTINCT FROM e.conv_id
        JOIN steps p ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.i = coalesce(m.n, 0)"""
