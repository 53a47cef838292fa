"""Independent formulations of the operators in DuckDB SQL, used only for checking."""

from __future__ import annotations

from faultline import seeds
from faultline.functions.text import WHITESPACE


def quoted(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def values_table(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(
        str(v) if isinstance(v, (int, float)) else quoted(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


SPACE = "'" + WHITESPACE.replace("'", "''") + "'"
BASENAME = "list_last(string_split({0}, '/'))"


def basename(path: str) -> str:
    return f"CASE WHEN {BASENAME.format(path)} <> '' THEN {BASENAME.format(path)} ELSE {path} END"


def suffix(path: str) -> str:
    return f"regexp_extract({BASENAME.format(path)}, '^.+(\\.[^.]+)$', 1)"


def is_allowed(path: str) -> str:
    return (f"({BASENAME.format(path)} IN {in_list(seeds.ALLOWED_NAMES)} "
            f"OR lower({suffix(path)}) IN {in_list(seeds.ALLOWED_SUFFIXES)})")


def is_blocked(path: str) -> str:
    listed = "[" + ", ".join(map(quoted, seeds.BLOCKED_DIRS)) + "]"
    return f"list_has_any(string_split({path}, '/'), {listed})"


def language(path: str) -> str:
    return (f"CASE WHEN lower({suffix(path)}) = '.py' THEN 'py' "
            f"WHEN lower({suffix(path)}) IN ('.js', '.jsx', '.ts', '.tsx') THEN 'js' END")


def strip(text: str) -> str:
    return f"trim({text}, {SPACE})"


def severity_rank(column: str) -> str:
    return f"CASE {column} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


def case_map(column: str, mapping: dict, other: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN {quoted(k) if isinstance(k, str) else k} THEN {quoted(v) if isinstance(v, str) else v}"
        for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {other} END"


def canonical(column: str) -> str:
    return (f"coalesce({case_map(column, seeds.CATEGORY_ALIASES)}, "
            f"{case_map(f'upper({column})', seeds.CATEGORY_ALIASES)}, lower({column}))")


# ---------------------------------------------------------------------------
# Rules: every match with its offset
# ---------------------------------------------------------------------------

# RE2 has no look-ahead: the unsafe YAML rule is matched without it and the
# rest of the line is looked at afterwards.
YAML_RULE, YAML_PLAIN, YAML_SAFE = "py07", r"yaml\.load\s*\(", r"Loader\s*=\s*yaml\.SafeLoader"


def matches_sql(rules, source: str = "files", name: str = "matches") -> str:
    """CTE of (project_id, file_path, rule_id, line_number, match_no, rest)."""
    blocks = []
    for rule in rules:
        regex = YAML_PLAIN if rule.rule_id == YAML_RULE else rule.regex
        if rule.ignore_case:
            regex = "(?i)" + regex
        where = f"regexp_matches(content, {quoted(regex)})"
        if rule.lang != "any":
            where = f"({language('file_path')}) = '{rule.lang}' AND " + where
        block = f"""SELECT project_id, file_path, content, {quoted(rule.rule_id)} AS rule_id, i,
            len(array_to_string(ps[1:i], '')) + len(array_to_string(ms[1:i-1], '')) AS lead,
            len(array_to_string(ps[1:i], '')) + len(array_to_string(ms[1:i], '')) AS tail
          FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM (
            SELECT project_id, file_path, content,
              string_split_regex(content, {quoted(regex)}) AS ps,
              regexp_extract_all(content, {quoted(regex)}) AS ms
            FROM {source} WHERE {where}))"""
        if rule.rule_id == YAML_RULE:
            block = (f"SELECT * FROM ({block}) WHERE NOT regexp_matches("
                     f"string_split(substr(content, tail + 1), chr(10))[1], {quoted(YAML_SAFE)})")
        blocks.append(block)
    union = " UNION ALL ".join(blocks)
    return f"""{name} AS (
      SELECT project_id, file_path, rule_id, line_number,
        CAST(row_number() OVER (PARTITION BY project_id, file_path, rule_id, line_number ORDER BY i) AS INTEGER) AS match_no,
        trim(string_split(content, chr(10))[line_number], {SPACE}) AS code_snippet
      FROM (SELECT *, CAST(1 + lead - len(replace(left(content, lead), chr(10), '')) AS INTEGER) AS line_number
            FROM ({union})))"""


def masked_sql(text: str, values) -> str:
    """``text`` with the captured values of each (regex, group) masked in turn."""
    hidden = ("CASE WHEN length(v) <= 8 THEN repeat('*', length(v)) ELSE "
              "left(v, 4) || repeat('*', length(v) - 8) || right(v, 4) END")
    for regex, group in values:
        found = f"regexp_extract_all({text}, {quoted(regex)}, {group})"
        text = (f"list_reduce({found}, lambda done, v: replace(done, v, {hidden}), {text})")
    return text
