"""Source trees derived from the given tables.

The given tables hold no source trees, so every query sees them through the
expressions below.  Each expression is plain SQL that Spark and DuckDB read
alike; the checks use the same text.  Every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline import seeds
from faultline.session import spread

ID = "CAST(doc_id AS STRING)"

FILE_PATH = f"""CASE doc_id % 16
  WHEN 7  THEN 'web/src/f'            || {ID} || '.js'
  WHEN 8  THEN 'web/src/components/F' || {ID} || '.tsx'
  WHEN 9  THEN 'server/f'             || {ID} || '.ts'
  WHEN 10 THEN 'd' || {ID} || '/requirements.txt'
  WHEN 11 THEN 'd' || {ID} || '/package.json'
  WHEN 13 THEN 'node_modules/f'       || {ID} || '.js'
  WHEN 14 THEN 'assets/f'             || {ID} || '.png'
  ELSE 'backend/f' || {ID} || '.py' END"""

# The text as the inside of a JSON string.
_ESCAPED = "text"
for _sign, _name in (("chr(92)", "chr(92)"), ("'\"'", "'\"'"), ("chr(10)", "'n'"), ("chr(13)", "'r'"), ("chr(9)", "'t'")):
    _ESCAPED = f"replace({_ESCAPED}, {_sign}, chr(92) || {_name})"
JSON_TEXT = _ESCAPED

CONTENT = f"""CASE doc_id % 16
  WHEN 10 THEN 'requests==2.' || CAST(doc_id % 40 AS STRING) || '.0' || chr(10)
    || 'Flask>=0.12.2' || chr(10) || '# note' || chr(10) || '-r base.txt' || chr(10)
    || 'pyyaml' || chr(10) || 'django==3.2.' || CAST(doc_id % 30 AS STRING)
    || CASE WHEN doc_id % 3 = 0 THEN 'rc1' ELSE '' END || chr(10) || text
  WHEN 11 THEN '{{"dependencies": {{"express": "^4.17.' || CAST(doc_id % 5 AS STRING)
    || '", "react": "18.2.0"}}, "devDependencies": {{"lodash": "4.17.2", "axios": "latest"}}, "description": "'
    || {JSON_TEXT} || '"}}'
  ELSE text || chr(10) || CASE doc_id % 16
    WHEN 0  THEN 'x = eval(user_input)'
    WHEN 1  THEN 'os.system(cmd)' || chr(10) || 'h = hashlib.md5(b)' || chr(10) || 'k = sha1(b) + md5(b)'
    WHEN 2  THEN 'subprocess.run(' || chr(10) || '  cmd,' || chr(10) || '  shell=True)'
    WHEN 3  THEN 'password = "correct horse"'
    WHEN 4  THEN 'a = yaml.load(data)' || chr(10) || 'b = yaml.load(data, Loader=yaml.SafeLoader)'
    WHEN 5  THEN 'name = request.args.get("n")' || chr(10) || 'return f"<b>{{name}}</b>"'
    WHEN 6  THEN 'try:' || chr(10) || '    run()' || chr(10) || 'except:' || chr(10) || '    pass'
    WHEN 7  THEN 'el.innerHTML = x; document.cookie = y'
    WHEN 8  THEN 'return <div dangerouslySetInnerHTML={{h}} />'
    WHEN 13 THEN 'el.innerHTML = x'
    WHEN 14 THEN 'el.innerHTML = x'
    WHEN 9  THEN 'app.use(cors({{ origin: "*" }}))' || chr(10) || 'const api_key: "abcd1234"'
    WHEN 12 THEN 'os.system(a); subprocess.call(a, shell=True)' || chr(10) || 'os.system(b)' || chr(10)
      || 'requests.get(u, verify=False)' || chr(10) || 'DEBUG = True'
    ELSE 'ok = 1' END
  END"""

# A whole source as one project, and about seven documents as one project.
BY_SOURCE = "source"
BY_BATCH = "source || '-' || CAST(CAST(floor(doc_id / 140.0) AS BIGINT) AS STRING)"

# Archives: one per batch; odd sources have a wrapper directory, some entries
# climb out, some are directories, sizes follow the document length.
ENTRY_PATH = f"""CASE WHEN doc_id % 397 = 5 THEN '../' ELSE '' END
  || CASE WHEN length(source) % 2 = 1 THEN 'wrap/' ELSE '' END || ({FILE_PATH})
  || CASE WHEN doc_id % 16 = 15 THEN '.d/' ELSE '' END"""
ENTRY = {
    "project_id": BY_BATCH, "entry_ord": "doc_id", "entry_path": ENTRY_PATH,
    "is_dir": "doc_id % 16 = 15", "size": "n_chars * 1000",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def select(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    return table.selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])


def files(spark: SparkSession, sf_dir: str, project: str = BY_SOURCE) -> DataFrame:
    """``project_id, file_path, content`` of every document."""
    return select(documents(spark, sf_dir), {
        "project_id": project, "file_path": FILE_PATH, "content": CONTENT})


def files_sql(project: str = BY_SOURCE, admitted: bool = False) -> str:
    """The table ``files``; with ``admitted`` only what admission lets in, beside ``given_files``."""
    given = (f"SELECT {project} AS project_id, {FILE_PATH} AS file_path, {CONTENT} AS content FROM documents")
    if not admitted:
        return f"files AS ({given})"
    base = "list_last(string_split(file_path, '/'))"
    return (f"given_files AS ({given}), files AS (SELECT * FROM given_files "
            f"WHERE NOT list_has_any(string_split(file_path, '/'), {list(seeds.BLOCKED_DIRS)!r}) "
            f"AND ({base} IN {tuple(seeds.ALLOWED_NAMES)!r} "
            f"OR regexp_extract({base}, '(?s)^.+([.][^.]+)$', 1).lower() IN {tuple(seeds.ALLOWED_SUFFIXES)!r}))")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(documents(spark, sf_dir), ENTRY)


def entries_sql() -> str:
    columns = ", ".join(f"{text} AS {name}" for name, text in ENTRY.items())
    return f"entries AS (SELECT {columns} FROM documents)"
