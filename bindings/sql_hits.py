"""SQL forms of positional pattern hits, for the checking engine."""

from __future__ import annotations

from bindings.text import ADMIT_GENERIC_SQL, ADMIT_GO_SQL, DOC_SQL, SCANNABLE_SQL
from estatelens.plans.corpus import corpus_sql


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def hits(source: str, rules: list[tuple[int, str, tuple[int, ...]]], content: str = "content", key: str = "project_id, path") -> str:
    """SELECT of key, rule, g1, g2, i, start, end and line for every match of every rule."""
    parts = []
    for number, pattern, groups in rules:
        p = lit(pattern)
        g1 = f"unnest(regexp_extract_all({content}, {p}, {groups[0]}))" if groups else "CAST(NULL AS VARCHAR)"
        g2 = f"unnest(regexp_extract_all({content}, {p}, {groups[1]}))" if len(groups) > 1 else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT {key}, {number} AS rule, {g1} AS g1, {g2} AS g2, unnest(range(1, len(ms) + 1)) AS i, ms, gaps FROM"
            f" (SELECT {key}, {content}, regexp_extract_all({content}, {p}) AS ms, regexp_split_to_array({content}, {p}) AS gaps"
            f" FROM {source} WHERE regexp_matches({content}, {p}))"
        )
    union = " UNION ALL ".join(parts)

    def total(expr: str) -> str:
        return f"coalesce(list_sum(list_transform({expr}, lambda s: length(s))), 0)"

    def lines(expr: str) -> str:
        return f"coalesce(list_sum(list_transform({expr}, lambda s: length(s) - length(replace(s, chr(10), '')))), 0)"

    start = f"{total('gaps[1:i]')} + CASE WHEN i > 1 THEN {total('ms[1:i-1]')} ELSE 0 END"
    line = f"1 + {lines('gaps[1:i]')} + CASE WHEN i > 1 THEN {lines('ms[1:i-1]')} ELSE 0 END"
    return (
        f"SELECT {key}, rule, g1, g2, i, CAST({start} AS BIGINT) AS b, CAST({start} + length(ms[i]) AS BIGINT) AS e,"
        f" CAST({line} AS BIGINT) AS line FROM ({union})"
    )


CORPUS = f"""{corpus_sql()},
live AS (SELECT files.* FROM files JOIN projects USING (project_id, commit_sha)),
mods AS (SELECT DISTINCT project_id, TRUE AS is_mod FROM live WHERE path = 'go.mod'),
based AS (SELECT live.*, coalesce(is_mod, FALSE) AS is_mod, split_part(path, '/', -1) AS base FROM live LEFT JOIN mods USING (project_id)),
adm AS (SELECT * FROM based WHERE CASE WHEN is_mod THEN {ADMIT_GO_SQL} ELSE {ADMIT_GENERIC_SQL} END),
shape AS (SELECT project_id, bool_or(path = 'go.mod' OR regexp_matches(path, '\\.go$')) AS has_go FROM adm GROUP BY 1),
go_files AS (SELECT adm.* FROM adm JOIN shape USING (project_id) WHERE has_go),
other_files AS (SELECT adm.* FROM adm JOIN shape USING (project_id) WHERE NOT has_go),
scannable AS (SELECT * FROM other_files WHERE {SCANNABLE_SQL}),
code AS (SELECT * FROM other_files WHERE NOT {DOC_SQL})"""


def with_corpus(*ctes: str) -> str:
    return "WITH " + ",\n".join([CORPUS, *ctes])
