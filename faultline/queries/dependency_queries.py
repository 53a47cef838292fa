"""Queries over declared dependencies, advisories, frameworks and file counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import versions
from faultline.operators import dependencies, score
from faultline.queries import fixtures, oracle
from faultline.sources import manifests

PACKAGE = ("project_id", "manifest_path", "position", "package", "declared_name", "version")
BASE = oracle.basename("file_path")


def requirements(spark, sf_dir):
    return manifests.requirements(fixtures.files(spark, sf_dir)).select(*PACKAGE)


def npm_packages(spark, sf_dir):
    return manifests.npm_packages(fixtures.files(spark, sf_dir)).select(*PACKAGE)


def packages_cte() -> str:
    token = oracle.quoted(versions.REQUIREMENT)
    return f"""requirement_lines AS (
        SELECT project_id, file_path, CAST(i - 1 AS INTEGER) AS position, {oracle.strip('ls[i]')} AS line
        FROM (SELECT project_id, file_path, string_split(content, chr(10)) AS ls,
              unnest(generate_series(1, len(string_split(content, chr(10))))) AS i
              FROM files WHERE {BASE} = 'requirements.txt')),
      requirements AS (SELECT project_id, file_path AS manifest_path, position,
          lower(regexp_extract(line, {token}, 1)) AS package,
          regexp_extract(line, {token}, 1) AS declared_name,
          nullif(regexp_extract(line, {token}, 3), '') AS version, 6 AS source_rank
        FROM requirement_lines
        WHERE line <> '' AND NOT regexp_matches(line, '^[#-]') AND regexp_extract(line, {token}, 1) <> ''),
      npm_entries AS (SELECT project_id, file_path, ks[i] AS name, vs[i] AS declared, CAST(i - 1 AS INTEGER) AS position FROM (
        SELECT *, unnest(generate_series(1, len(ks))) AS i FROM (
          SELECT project_id, file_path,
            list_concat(json_keys(content, '$.dependencies'), json_keys(content, '$.devDependencies')) AS ks,
            list_concat(json_extract_string(content, '$.dependencies.*'),
                        json_extract_string(content, '$.devDependencies.*')) AS vs
          FROM files WHERE {BASE} = 'package.json' AND NOT list_contains(string_split(file_path, '/'), 'node_modules')
            AND json_valid(content)))),
      npm AS (SELECT project_id, file_path AS manifest_path, position, lower(name) AS package,
          name AS declared_name,
          nullif(regexp_replace(declared, '^[~^>=<\\s]+', ''), '') AS version, 7 AS source_rank
        FROM npm_entries),
      packages AS (SELECT * FROM requirements UNION ALL SELECT * FROM npm)"""


def key_sql(version: str) -> str:
    """Release numbers as a list; the gate is applied by the caller."""
    digits = f"regexp_extract(trim({version}), '^[vV]?(\\d+(?:\\.\\d+)*)', 1)"
    return (f"list_transform(string_split(regexp_replace({digits}, '(\\.0+)+$', ''), '.'), "
            "lambda n: TRY_CAST(n AS HUGEINT))")


def advisories_cte() -> str:
    table = oracle.values_table(
        "advisories", "package, bound, severity, advisory_id, fixed_version, summary", seeds.ADVISORIES)
    gate = oracle.quoted(versions.RELEASE)
    return f"""{packages_cte()}, {table},
      affected AS (SELECT p.*, a.bound, a.severity, a.advisory_id, a.fixed_version, a.summary
        FROM (SELECT * FROM packages WHERE regexp_matches(trim(version), {gate})) p
        JOIN advisories a USING (package) WHERE {key_sql('p.version')} < {key_sql('a.bound')}),
      dependency_findings AS (SELECT project_id, 'dependency manifest' AS file_path,
          CAST(NULL AS INTEGER) AS line_number, 'insecure-dependency' AS category, severity,
          85 AS confidence, source_rank, manifest_path AS origin, position AS rule_ord,
          'Vulnerable dependency: ' || package AS title,
          package || ' ' || version || ' is listed in ' || advisory_id || '. ' || summary AS description,
          'What can happen where it is used: ' || lower(summary) AS impact,
          'Move ' || package || ' to ' || fixed_version || ' or newer.' AS recommendation,
          'dependency-advisory' AS source_tool, package || '==' || version AS code_snippet
        FROM affected)"""


FOUND = ("project_id", "file_path", "line_number", "category", "severity", "confidence", "origin",
         "rule_ord", "title", "description", "impact", "recommendation", "source_tool", "code_snippet")


def advisories(spark, sf_dir):
    packages = manifests.declared_packages(fixtures.files(spark, sf_dir))
    return dependencies.dependency_findings(packages).select(*FOUND)


def frameworks_cte(with_files: bool = False) -> str:
    arms = [f"SELECT project_id, {oracle.quoted(label)} AS label FROM files WHERE {BASE} IN "
            f"('requirements.txt', 'pyproject.toml') AND contains(lower(content), {oracle.quoted(m)})"
            for m, label in seeds.PYTHON_MARKERS.items()]
    npm = [f"SELECT project_id, {oracle.quoted(label)} AS label FROM npm_entries WHERE name = {oracle.quoted(m)}"
           for m, label in seeds.NPM_MARKERS.items()]
    head = packages_cte() + ", " if with_files else ""
    return f"""{head}labels_found AS ({' UNION '.join(arms + npm)}),
      frameworks AS (SELECT project_id, string_agg(label, ',' ORDER BY label) AS detected_frameworks
        FROM labels_found GROUP BY project_id)"""


def frameworks(spark, sf_dir):
    found = dependencies.detected_frameworks(fixtures.files(spark, sf_dir, fixtures.BY_BATCH))
    return found.select("project_id", F.array_join("detected_frameworks", ",").alias("detected_frameworks"))


def counters_select() -> str:
    suffix = oracle.suffix("file_path")
    return f"""SELECT project_id, count(*) AS total_files,
      count(*) FILTER (file_path LIKE '%.py') AS python_files,
      count(*) FILTER (regexp_matches(file_path, '\\.(js|jsx|ts|tsx)$')) AS javascript_files,
      count(*) FILTER ({BASE} IN {oracle.in_list(seeds.CONFIG_NAMES)} OR {suffix} IN ('.yml', '.yaml')) AS config_files
      FROM files GROUP BY project_id"""


def file_counters(spark, sf_dir):
    return score.file_counters(fixtures.files(spark, sf_dir))


def version_order(spark, sf_dir):
    """Comparable form of versions in many spellings, made from part and supplier keys."""
    table = fixtures.select(fixtures.read(spark, sf_dir, "part"), {"p_partkey": "p_partkey", "version": VERSION})
    v = F.col("version")
    return table.select(
        "p_partkey", "version", versions.release_key(v).isNotNull().alias("comparable"),
        versions.is_below(v, F.lit("3.2.18")).alias("below"), versions.npm_version(F.concat(F.lit("^ "), v)).alias("npm"))


VERSION = """CASE p_partkey % 7 WHEN 0 THEN '3.2.' || CAST(p_partkey % 40 AS STRING)
  WHEN 1 THEN CAST(p_partkey % 6 AS STRING) || '.0.0' WHEN 2 THEN '3.2.' || CAST(p_partkey % 40 AS STRING) || 'rc1'
  WHEN 3 THEN 'v3.' || CAST(p_size AS STRING) WHEN 4 THEN '3.2.' || CAST(p_partkey % 40 AS STRING) || '.post2'
  WHEN 5 THEN CAST(p_size AS STRING) || '.x' ELSE '3.2.17.' || CAST(p_partkey % 3 AS STRING) || '+local.1' END"""

VERSION_SQL = f"""WITH v AS (SELECT p_partkey, {VERSION} AS version FROM part),
  g AS (SELECT *, regexp_matches(version, {oracle.quoted(versions.RELEASE)}) AS comparable FROM v)
  SELECT p_partkey, version, comparable,
    comparable AND {key_sql('version')} < [3, 2, 18]::HUGEINT[] AS below, version AS npm FROM g"""

SPECIFIERS = (">=3.2.10, <3.2.20", "!=3.2.5", "~=3.2.17", "==3.2.*", ">3.2.12", "===3.2.7")


def specifiers(spark, sf_dir):
    """Every made version against a specifier of another form."""
    table = fixtures.select(fixtures.read(spark, sf_dir, "part"), {"p_partkey": "p_partkey", "version": VERSION})
    named = table.withColumn("specifier", F.element_at(F.lit(list(SPECIFIERS)), (F.col("p_partkey") % len(SPECIFIERS) + 1).cast("int")))
    v = F.col("version")
    return named.select("p_partkey", "version", "specifier", versions.satisfies(
        versions.version_key(v), versions.clauses(F.col("specifier"))).alias("affected"))


SPECIFIERS_SQL = f"""WITH v AS (SELECT p_partkey, {VERSION} AS version FROM part),
  k AS (SELECT *, {key_sql('version')} AS k, version NOT LIKE '%.x' AND version NOT LIKE '%rc1' AS final,
    version LIKE '%.post2' AS post FROM v)
  SELECT p_partkey, version, {oracle.quoted('|'.join(SPECIFIERS))}.string_split('|')[p_partkey % 6 + 1] AS specifier,
    final AND CASE p_partkey % 6 WHEN 0 THEN k >= [3, 2, 10]::HUGEINT[] AND k < [3, 2, 20]::HUGEINT[]
      WHEN 1 THEN post OR k <> [3, 2, 5]::HUGEINT[]
      WHEN 2 THEN k >= [3, 2, 17]::HUGEINT[] AND k[1] = 3 AND k[2] = 2
      WHEN 3 THEN k[1] = 3 AND coalesce(k[2], 0) = 2
      WHEN 4 THEN k > [3, 2, 12]::HUGEINT[]
      ELSE version = '3.2.7' END AS affected FROM k"""

FILES = fixtures.files_sql()
QUERIES = {
    "q_requirements": requirements, "q_npm_deps": npm_packages, "q_advisories": advisories,
    "q_frameworks": frameworks, "q_file_counters": file_counters, "q_versions": version_order, "q_specifiers": specifiers,
}
ORACLES = {
    "q_requirements": f"WITH {FILES}, {packages_cte()} SELECT {', '.join(PACKAGE)} FROM requirements",
    "q_npm_deps": f"WITH {FILES}, {packages_cte()} SELECT {', '.join(PACKAGE)} FROM npm",
    "q_advisories": f"WITH {FILES}, {advisories_cte()} SELECT {', '.join(FOUND)} FROM dependency_findings",
    "q_frameworks": f"WITH {fixtures.files_sql(fixtures.BY_BATCH)}, {frameworks_cte(True)} SELECT * FROM frameworks",
    "q_file_counters": f"WITH {FILES} {counters_select()}",
    "q_versions": VERSION_SQL,
    "q_specifiers": SPECIFIERS_SQL,
}
