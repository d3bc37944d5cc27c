"""SQL for ROUGE scores and for the stems of their tokens."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from instructset.functions import stem as S
from instructset.functions.text import SENTENCE_END

METRICS = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def _shape(word: str) -> str:
    for pattern, new in S.SHAPE:
        word = f"regexp_replace({word}, '{pattern}', '{new}', 'g')"
    return word


def _like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _cut(word: str, n: str | int) -> str:
    return f"substr({word}, 1, greatest(length({word}) - {n}, 0))"


def _measured(word: str) -> str:
    return _like(_shape(word), S.MEASURED)


def _short(word: str) -> str:
    shape = _shape(word)
    return f"(({_like(shape, S.SHORT_END)} AND NOT {_like(word, '[wxy]$')}) OR {_like(shape, S.SHORT_WHOLE)})"


def _suffix(suffixes: Iterable[str]) -> str:
    return f"regexp_extract(w, '({'|'.join(suffixes)})$', 1)"


def _swap(rules: Mapping[str, str], accept: bool) -> str:
    left = _cut("w", f"length({_suffix(rules)})")
    new = " ".join(f"WHEN '{old}' THEN '{text}'" for old, text in rules.items())
    fits = f"AND {_measured(left)}" if accept else ""
    return f"CASE WHEN {_suffix(rules)} <> '' {fits} THEN {left} || CASE {_suffix(rules)} {new} END ELSE w END"


def _past() -> str:
    left = "regexp_replace(w, '(ed|ing)$', '')"
    shape, last = _shape(left), f"right({left}, 1)"
    double = f"length({left}) > 1 AND {last} = substr({left}, length({left}) - 1, 1) AND {_like(shape, '[^aeiou]$')}"
    once = f"{_like(shape, S.MEASURED)} AND NOT {_like(shape, S.MEASURED_TWICE)} AND {_short(left)}"
    return f"""CASE WHEN w LIKE '%ied' THEN {_cut("w", 3)} || CASE WHEN length(w) = 4 THEN 'ie' ELSE 'i' END
        WHEN w LIKE '%eed' THEN CASE WHEN {_measured(_cut("w", 3))} THEN {_cut("w", 1)} ELSE w END
        WHEN NOT {_like("w", "(ed|ing)$")} OR NOT {_like(shape, "[aeiou]")} THEN w
        WHEN {_like(left, "(at|bl|iz)$")} THEN {left} || 'e'
        WHEN {double} THEN CASE WHEN {_like(left, "[lsz]$")} THEN {left} ELSE {_cut(left, 1)} END
        WHEN {once} THEN {left} || 'e' ELSE {left} END"""


def _steps() -> list[str]:
    residual = _cut("w", f"length({_suffix(S.RESIDUAL)})")
    before = _cut("w", 1)
    size = f"({_like(_shape(before), S.MEASURED_TWICE)} OR ({_measured(before)} AND NOT {_short(before)}))"
    return [
        f"CASE WHEN {_like('w', '^.ies$')} THEN {before} ELSE {_swap(S.PLURAL, False)} END",
        _past(),
        f"CASE WHEN length(w) > 2 AND w LIKE '%y' AND {_like(_shape(before), '[^aeiou]$')} THEN {before} || 'i' ELSE w END",
        f"CASE WHEN w LIKE '%alli' AND {_measured(_cut('w', 4))} THEN {_cut('w', 2)} ELSE w END",
        f"""CASE WHEN w LIKE '%logi' THEN CASE WHEN {_measured(_cut("w", 3))} THEN {before} ELSE w END
            ELSE {_swap(S.DERIVED, True)} END""",
        _swap(S.ADJECTIVAL, True),
        f"""CASE WHEN {_suffix(S.RESIDUAL)} <> '' AND ({_suffix(S.RESIDUAL)} <> 'ion' OR {_like(residual, "[st]$")})
            AND {_like(_shape(residual), S.MEASURED_TWICE)} THEN {residual} ELSE w END""",
        f"CASE WHEN w LIKE '%e' AND {size} THEN {before} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {_like(_shape(before), S.MEASURED_TWICE)} THEN {before} ELSE w END",
    ]


def stems(source: str) -> str:
    """Common table expressions that end in ``stems (token, stem)`` for the column ``token`` of ``source``."""
    chain = [f"stem0 AS (SELECT DISTINCT token, token AS w FROM {source} WHERE length(token) > {S.UNSTEMMED_LENGTH})"]
    steps = _steps()
    for i, step in enumerate(steps):
        # Written down at each step, or the text of one would be repeated within the next.
        chain.append(f"stem{i + 1} AS MATERIALIZED (SELECT token, {step} AS w FROM stem{i})")
    known = " ".join(f"WHEN '{word}' THEN '{stem}'" for word, stem in S.IRREGULAR.items())
    chain.append(f"stems AS (SELECT token, CASE token {known} ELSE w END AS stem FROM stem{len(steps)})")
    return ", ".join(chain)


def sentence_lines(text: str, strip) -> str:
    return f"regexp_replace({strip(text)}, '{SENTENCE_END}', concat('\\1', chr(10)), 'g')"


def scores(texts: str, stem: bool) -> str:
    """``WITH …`` up to ``scores (id, rouge1, rouge2, rougeL, rougeLsum)``, from common table expressions that end in
    ``texts (id, a, b)``.

    A longest common subsequence is found row by row: a cell is the best of the cells above and left of it, where a
    match adds one to the cell diagonally before. For the union over lines all rows are kept, and the way back prefers a match,
    then the cell above."""
    token = "coalesce(stem, token)" if stem else "token"
    chain = f", {stems('raw')}" if stem else ""
    joined = "LEFT JOIN stems USING (token)" if stem else ""
    step = """list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
        CASE WHEN b[k] = a[{i}] THEN coalesce(above[k - 1], 0) + 1 ELSE above[k] END))::INT)"""
    return f"""WITH RECURSIVE {texts},
    sided AS (SELECT id, 'a' AS side, string_split(lower(a), chr(10)) AS ls FROM texts
        UNION ALL SELECT id, 'b', string_split(lower(b), chr(10)) FROM texts),
    split AS (SELECT id, side, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM sided),
    raw AS (SELECT id, side, k, unnest(ts) AS token, unnest(range(1, len(ts) + 1)) AS p
        FROM (SELECT id, side, k, regexp_extract_all(line, '[a-z0-9]+') AS ts FROM split)){chain},
    flat AS MATERIALIZED (SELECT id, side, k, p, {token} AS t, row_number() OVER (PARTITION BY id, side ORDER BY k, p) AS place
        FROM raw {joined}),
    sizes AS (SELECT id, count(*) FILTER (side = 'a') AS m, count(*) FILTER (side = 'b') AS n FROM flat GROUP BY id),
    ones AS (SELECT id, side, t AS g, count(*) AS c FROM flat GROUP BY ALL),
    twos AS (SELECT id, side, g, count(*) AS c FROM (SELECT id, side, t || ' ' || lead(t) OVER (PARTITION BY id, side ORDER BY place) AS g
        FROM flat) WHERE g IS NOT NULL GROUP BY ALL),
    hit1 AS (SELECT id, sum(least(x.c, y.c)) AS h FROM ones x JOIN ones y USING (id, g) WHERE x.side = 'a' AND y.side = 'b' GROUP BY id),
    hit2 AS (SELECT id, sum(least(x.c, y.c)) AS h FROM twos x JOIN twos y USING (id, g) WHERE x.side = 'a' AND y.side = 'b' GROUP BY id),
    seqs AS (SELECT id, list(t ORDER BY place) FILTER (side = 'a') AS a, list(t ORDER BY place) FILTER (side = 'b') AS b FROM flat GROUP BY id),
    rows_of AS (SELECT id, list_transform(a, lambda x: list_transform(b, lambda y: (x = y)::INT)) AS m, b FROM seqs
        WHERE a IS NOT NULL AND b IS NOT NULL),
    longest AS (SELECT id, list_max(list_reduce(list_prepend(list_transform(b, lambda y: 0), m), lambda above, match:
        list_transform(range(1, len(match) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
            CASE WHEN match[k] = 1 THEN coalesce(above[k - 1], 0) + 1 ELSE above[k] END))::INT))) AS h FROM rows_of),
    lines AS (SELECT id, side, k, list(t ORDER BY p) AS ts FROM flat GROUP BY ALL),
    compared AS MATERIALIZED (SELECT x.id, x.k, y.k AS l, x.ts AS a, y.ts AS b FROM lines x JOIN lines y ON x.id = y.id
        WHERE x.side = 'a' AND y.side = 'b' AND list_has_any(x.ts, y.ts)),
    steps AS (SELECT id, k, l, a, b, 0 AS i, list_transform(b, lambda y: 0) AS above FROM compared
        UNION ALL SELECT id, k, l, a, b, i + 1, {step.format(i="i + 1")} FROM steps WHERE i < len(a)),
    tables AS MATERIALIZED (SELECT id, k, l, i, above AS row FROM steps),
    walk AS (SELECT id, k, l, a, b, len(a) AS i, len(b) AS j, NULL::BIGINT AS found FROM compared
        UNION ALL SELECT w.id, w.k, w.l, w.a, w.b,
            CASE WHEN w.a[w.i] = w.b[w.j] OR coalesce(t.row[w.j - 1], 0) <= u.row[w.j] THEN w.i - 1 ELSE w.i END,
            CASE WHEN w.a[w.i] = w.b[w.j] OR coalesce(t.row[w.j - 1], 0) > u.row[w.j] THEN w.j - 1 ELSE w.j END,
            CASE WHEN w.a[w.i] = w.b[w.j] THEN w.i END
        FROM walk w JOIN tables t ON t.id = w.id AND t.k = w.k AND t.l = w.l AND t.i = w.i
            JOIN tables u ON u.id = w.id AND u.k = w.k AND u.l = w.l AND u.i = w.i - 1
        WHERE w.i > 0 AND w.j > 0),
    united AS (SELECT id, a[found] AS g, count(*) AS c FROM (SELECT DISTINCT id, k, a, found FROM walk WHERE found IS NOT NULL) GROUP BY ALL),
    hits AS (SELECT id, sum(least(united.c, x.c, y.c)) AS h FROM united JOIN ones x USING (id, g) JOIN ones y USING (id, g)
        WHERE x.side = 'a' AND y.side = 'b' GROUP BY id),
    scores AS (SELECT texts.id, coalesce(2.0 * hit1.h / (m + n), 0)::DOUBLE AS rouge1,
            coalesce(2.0 * hit2.h / (greatest(m - 1, 0) + greatest(n - 1, 0)), 0)::DOUBLE AS rouge2,
            coalesce(2.0 * longest.h / (m + n), 0)::DOUBLE AS "rougeL", coalesce(2.0 * hits.h / (m + n), 0)::DOUBLE AS "rougeLsum"
        FROM texts LEFT JOIN sizes USING (id) LEFT JOIN hit1 USING (id) LEFT JOIN hit2 USING (id)
            LEFT JOIN longest USING (id) LEFT JOIN hits USING (id))"""


def report(texts: str, stem: bool, percent: bool, digits: int, by: str = "") -> str:
    """Means of all metrics as ``metric, value``; ``by`` is a column of ``texts`` that has means of its own."""
    mean = "100 * avg({m})" if percent else "avg({m})"
    key, grouped = (f"{by}, ", f"JOIN texts USING (id) GROUP BY {by}") if by else ("", "")
    parts = [
        f"""SELECT {key}'{m}' AS metric, round({mean.format(m=f'"{m}"')}, {digits}) AS value FROM scores {grouped}""" for m in METRICS
    ]
    return f"{scores(texts, stem)} {' UNION ALL '.join(parts)}"
