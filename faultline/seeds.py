"""Dimension values of the engine, kept as plain Python data.

Everything here is small and fixed at plan-building time, so it is either
unrolled into column expressions or turned into a local relation whose size
Spark knows exactly.  Every public operator takes its table as an argument,
so a caller can pass an extended list instead.
"""

from __future__ import annotations

from typing import NamedTuple

# ---------------------------------------------------------------------------
# File admission
# ---------------------------------------------------------------------------

MEGABYTE = 1024 * 1024

# Upload limits.
MAX_UPLOAD_BYTES = 50 * MEGABYTE
MAX_TOTAL_BYTES = 500 * MEGABYTE
MAX_FILES = 5000
MAX_FILE_BYTES = 5 * MEGABYTE

# Admitted suffixes (compared in lower case).
ALLOWED_SUFFIXES = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs",
    ".java", ".kt", ".scala", ".groovy",
    ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs",
    ".php", ".rb", ".pl", ".sh", ".bash",
    ".html", ".htm", ".css", ".scss", ".less",
    ".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".cfg",
    ".env", ".example", ".properties",
    ".sql", ".txt", ".md", ".rst", ".dockerfile", ".lock",
)

# Admitted exact base names (two of them are literals with a star).
ALLOWED_NAMES = (
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore",
    "requirements.txt", "pyproject.toml", "setup.py", "setup.cfg",
    "Pipfile", "Pipfile.lock", "poetry.lock", "tox.ini",
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    ".npmrc", ".nvmrc",
    "Gemfile", "Gemfile.lock", "composer.json", "composer.lock",
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle",
    "go.mod", "go.sum", "Cargo.toml", "Cargo.lock",
    "*.csproj", "*.sln", "nuget.config",
    ".env", ".env.example", ".env.local", ".gitignore", ".editorconfig",
    "Makefile", "Procfile", ".github", ".gitlab-ci.yml", "Jenkinsfile",
)

# Directory names that are never scanned.
BLOCKED_DIRS = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "env",
    "myenv", "env3", "venv3", "virtualenv", "ENV", "site-packages",
    "dist", "build", "out", "target", "coverage", ".cache", ".tox",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "vendor",
    ".idea", ".vscode", ".vs", ".next", ".nuxt", ".svelte-kit",
    "bin", "obj", ".eggs", "*.egg-info",
)

# Languages the rules are written for, by lower-cased suffix.
LANGUAGE_SUFFIXES = {
    ".py": "py", ".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js",
}

# What counts as a configuration file in the file counters.
CONFIG_NAMES = (
    "package.json", "requirements.txt", "pyproject.toml", "Dockerfile",
    "docker-compose.yml", ".env", ".env.example",
)
CONFIG_SUFFIXES = (".yml", ".yaml")

# ---------------------------------------------------------------------------
# Severity, score and posture
# ---------------------------------------------------------------------------

# Severities from worst to mildest, penalty weight, score cap.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SEVERITY_WEIGHTS = {"CRITICAL": 12, "HIGH": 7, "MEDIUM": 3, "LOW": 1}
SCORE_CAPS = {"CRITICAL": 24, "HIGH": 49, "MEDIUM": 74, "LOW": 89}

# Posture label by lowest score of the band.
POSTURE_BANDS = (
    (90, "Excellent"), (75, "Good"), (50, "Needs Attention"),
    (25, "High Risk"), (0, "Critical Risk"),
)

# States a finding can be in; the first is the default.
FINDING_STATES = ("OPEN", "FIXED", "IGNORED", "FALSE_POSITIVE")

# Fixed value: how many findings of a scan are sent for explanation.
EXPLAIN_LIMIT = 25

# ---------------------------------------------------------------------------
# Categories
# ---------------------------------------------------------------------------

# Other spellings and tool ids of our categories.
CATEGORY_ALIASES = {
    "B605": "command-injection", "B602": "command-injection",
    "B603": "command-injection", "B604": "command-injection",
    "B608": "sql-injection",
    "B324": "weak-cryptography", "B303": "weak-cryptography",
    "B105": "hardcoded-secrets", "B106": "hardcoded-secrets",
    "B107": "hardcoded-secrets",
    "B110": "security-misconfiguration",
    "B310": "path-traversal",
    "B501": "sensitive-data-exposure", "B502": "sensitive-data-exposure",
    "B301": "insecure-deserialization", "B506": "insecure-deserialization",
    "hardcoded_secrets": "hardcoded-secrets",
    "HARDCODED-SECRETS": "hardcoded-secrets",
    "HARDCODED_SECRETS": "hardcoded-secrets",
    "WEAK-CRYPTOGRAPHY": "weak-cryptography",
    "WEAK_CRYPTOGRAPHY": "weak-cryptography",
    "COMMAND-INJECTION": "command-injection",
    "COMMAND_INJECTION": "command-injection",
    "SQL-INJECTION": "sql-injection",
    "SQL_INJECTION": "sql-injection",
}

# ---------------------------------------------------------------------------
# Rules
# ---------------------------------------------------------------------------


class Rule(NamedTuple):
    """One text rule.  ``regex`` must match at least one character.

    ``hints`` are literals of which every match contains at least one; they
    let a file skip the regular expression.  Give them in lower case for a
    rule that ignores case, and leave them empty when there are none.
    """

    rule_id: str
    lang: str
    regex: str
    title: str
    category: str
    severity: str
    confidence: int
    hints: tuple = ()
    ignore_case: bool = False
    description: str = ""
    impact: str = ""
    recommendation: str = ""
    example_fix: str | None = None
    tool: str = "pattern"


# Id, language, pattern, title, category, severity, confidence.
# The explaining texts are this project's own wording.
PATTERN_RULES = (
    Rule("py01", "py", r"\beval\s*\(",
         "Use of eval()", "unsafe-code-execution", "CRITICAL", 90, ("eval",),
         description="An expression string is evaluated at run time.",
         impact="Whoever controls the string runs code inside the process.",
         recommendation="Parse literals with ast.literal_eval or dispatch on known names.",
         example_fix="ast.literal_eval(text)"),
    Rule("py02", "py", r"\bexec\s*\(",
         "Use of exec()", "unsafe-code-execution", "CRITICAL", 88, ("exec",),
         description="Source text is compiled and executed at run time.",
         impact="Input reaching the executed text becomes code.",
         recommendation="Replace the executed text by ordinary functions."),
    Rule("py03", "py", r"subprocess\.(Popen|call|run|check_output)\([^)]*shell\s*=\s*True",
         "Unsafe subprocess execution (shell=True)", "command-injection", "HIGH", 85, ("subprocess.",),
         description="A child process is started through a shell.",
         impact="Shell metacharacters in an argument start further commands.",
         recommendation="Give the arguments as a list and leave the shell off.",
         example_fix="subprocess.run([program, argument])"),
    Rule("py04", "py", r"os\.system\s*\(",
         "Use of os.system()", "command-injection", "HIGH", 80, ("os.system",),
         description="A command line is handed to the system shell.",
         impact="Text spliced into the command line can start other programs.",
         recommendation="Start the program with subprocess.run and a list of arguments."),
    Rule("py05", "py", r"""["']SELECT .*["']\s*(\+|%|\.format\()""",
         "Potential SQL Injection via string concatenation", "sql-injection", "CRITICAL", 75, ("SELECT ",),
         description="A query text is assembled from string pieces.",
         impact="A crafted value can change the query and reach other rows.",
         recommendation="Bind the values as parameters.",
         example_fix='cursor.execute("SELECT name FROM t WHERE id = %s", (key,))'),
    Rule("py06", "py", r"pickle\.loads?\s*\(",
         "Insecure deserialization (pickle)", "insecure-deserialization", "HIGH", 80, ("pickle.load",),
         description="Pickled bytes are turned back into objects.",
         impact="A prepared pickle runs code while it is read.",
         recommendation="Exchange data as JSON, or check a signature first."),
    Rule("py07", "py", r"yaml\.load\s*\((?!.*Loader\s*=\s*yaml\.SafeLoader)",
         "Unsafe YAML load", "insecure-deserialization", "HIGH", 70, ("yaml.load",),
         description="YAML is read with a loader that can build any object.",
         impact="A prepared document can run code while it is read.",
         recommendation="Read with yaml.safe_load.",
         example_fix="yaml.safe_load(text)"),
    Rule("py08", "py", r"(md5|sha1)\s*\(",
         "Weak cryptographic hash", "weak-cryptography", "MEDIUM", 65, ("md5", "sha1"),
         description="A hash function with known collisions is called.",
         impact="Forged inputs can share a digest with genuine ones.",
         recommendation="Use SHA-256 or later, and a slow hash for passwords."),
    Rule("py09", "py", r"DEBUG\s*=\s*True",
         "Debug mode enabled", "security-misconfiguration", "MEDIUM", 70, ("DEBUG",),
         description="The debug switch is on in source.",
         impact="Error pages may show code and settings to strangers.",
         recommendation="Read the switch from the environment and default to off."),
    Rule("py10", "py", r"verify\s*=\s*False",
         "TLS certificate verification disabled", "sensitive-data-exposure", "HIGH", 78, ("verify",),
         description="A client call does not check the server certificate.",
         impact="A host in between can read and change the traffic.",
         recommendation="Leave verification on and add the missing CA instead."),
    Rule("py11", "py", r"""(password|passwd|secret|api_key|apikey|token)\s*=\s*['"][^'"\n]{4,}['"]""",
         "Hardcoded credential", "hardcoded-secrets", "CRITICAL", 70,
         ("password", "passwd", "secret", "api_key", "apikey", "token"), True,
         description="A literal is assigned to a name that suggests a credential.",
         impact="Everyone with the source, now or later, holds the credential.",
         recommendation="Read the value from the environment or a secret store and rotate it."),
    Rule("py12", "py", r"cursor\.execute\([^,)]*%\s*\(",
         "Potential SQL Injection via % formatting", "sql-injection", "HIGH", 70, ("cursor.execute",),
         description="A query is filled in with the % operator.",
         impact="A crafted value can change what the query does.",
         recommendation="Give the values as the second argument of execute."),
    Rule("py13", "py", r"open\([^)]*request\.(args|form|values|GET|POST)",
         "Potential path traversal", "path-traversal", "HIGH", 65, ("open(",),
         description="A path taken from a request is opened.",
         impact="Dots in the value reach files outside the intended directory.",
         recommendation="Resolve the path and refuse it outside a fixed base directory."),
    Rule("js01", "js", r"\beval\s*\(",
         "Use of eval()", "unsafe-code-execution", "CRITICAL", 88, ("eval",),
         description="A string is evaluated as script.",
         impact="Whoever controls the string runs script in this context.",
         recommendation="Use JSON.parse for data and plain functions for logic."),
    Rule("js02", "js", r"new Function\s*\(",
         "Dynamic code execution via Function constructor", "unsafe-code-execution", "HIGH", 75, ("new Function",),
         description="A function is compiled from strings.",
         impact="Text that reaches the constructor becomes code.",
         recommendation="Write the function statically."),
    Rule("js03", "js", r"child_process\.exec\s*\(",
         "Unsafe command execution", "command-injection", "HIGH", 80, ("child_process.exec",),
         description="A command line is handed to a shell.",
         impact="Spliced input can start further commands.",
         recommendation="Use execFile or spawn with a list of arguments."),
    Rule("js04", "js", r"dangerouslySetInnerHTML",
         "Potential Cross-Site Scripting (dangerouslySetInnerHTML)", "xss", "HIGH", 65, ("dangerouslySetInnerHTML",),
         description="Raw HTML is put into a component.",
         impact="Markup from a user may carry script.",
         recommendation="Sanitise the HTML first or render text."),
    Rule("js05", "js", r"\.innerHTML\s*=",
         "Potential DOM-based XSS via innerHTML", "xss", "MEDIUM", 55, (".innerHTML",),
         description="An element receives markup by assignment.",
         impact="Markup from a user may carry script.",
         recommendation="Assign textContent, or sanitise the markup."),
    Rule("js06", "js", r"""cors\(\s*\{\s*origin\s*:\s*['"]\*['"]""",
         "Insecure CORS configuration (wildcard origin)", "insecure-cors", "MEDIUM", 75, ("cors(",),
         description="Every origin may call this service from a browser.",
         impact="Foreign pages can send requests and read the answers.",
         recommendation="List the origins that are trusted."),
    Rule("js07", "js", r"""jwt\.sign\([^)]*algorithm\s*:\s*['"]none['"]""",
         "JWT signed with 'none' algorithm", "broken-authentication", "CRITICAL", 85, ("jwt.sign",), True,
         description="Tokens are issued without a signature.",
         impact="Anyone can write a token that is accepted.",
         recommendation="Sign with HS256 or RS256 and refuse unsigned tokens."),
    Rule("js08", "js", r"""(password|passwd|secret|api_key|apikey|token)\s*[:=]\s*['"][^'"\n]{4,}['"]""",
         "Hardcoded credential", "hardcoded-secrets", "CRITICAL", 68,
         ("password", "passwd", "secret", "api_key", "apikey", "token"), True,
         description="A literal is assigned to a name that suggests a credential.",
         impact="Everyone with the source, now or later, holds the credential.",
         recommendation="Read the value from process.env and rotate it."),
    Rule("js09", "js", r"document\.cookie",
         "Direct cookie manipulation", "sensitive-data-exposure", "LOW", 40, ("document.cookie",),
         description="Script reads or writes cookies itself.",
         impact="Cookies open to script can be stolen by injected script.",
         recommendation="Set cookies on the server with HttpOnly, Secure and SameSite."),
)

# Title, category, severity, confidence of the two syntax checks.
TAINT_RULE = Rule(
    "ast01", "py", "", "Reflected XSS in HTML response", "xss", "MEDIUM", 85,
    description="A request value is written into a returned page unescaped.",
    impact="A prepared link runs script in the reader's browser.",
    recommendation="Render through an autoescaping template or escape the value.",
    tool="taint")
SUPPRESSION_RULE = Rule(
    "ast02", "py", "", "Silent exception suppression", "security-misconfiguration", "LOW", 55,
    ("except",),
    description="A bare except clause does nothing.",
    impact="A failed security check can pass unseen.",
    recommendation="Catch the expected exception and log it.",
    tool="structure")

# Patterns of this project: secrets with a recognisable form.
SECRET_RULES = (
    Rule("sec01", "any", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
         "Cloud access key id", "hardcoded-secrets", "CRITICAL", 95, ("AKIA", "ASIA"),
         description="The text contains a cloud access key id.",
         impact="Together with its secret the key opens the account.",
         recommendation="Revoke the key and load it from a secret store.", tool="secret"),
    Rule("sec02", "any", r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
         "Private key in source", "hardcoded-secrets", "CRITICAL", 95, ("PRIVATE KEY-----",),
         description="The text contains a private key.",
         impact="The holder of the key can act as its owner.",
         recommendation="Replace the key pair and keep the new key out of the source.", tool="secret"),
    Rule("sec03", "any", r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
         "Source host token", "hardcoded-secrets", "CRITICAL", 95,
         ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         description="The text contains an access token of a source host.",
         impact="The token reads or writes repositories.",
         recommendation="Revoke the token and load it from a secret store.", tool="secret"),
    Rule("sec04", "any", r"\b[0-9a-f]{40}\b",
         "Long hexadecimal token", "hardcoded-secrets", "MEDIUM", 50, (),
         description="The text contains a 40-digit hexadecimal value.",
         impact="If the value is a credential, every reader of the source has it.",
         recommendation="Check the value; if it is a credential, rotate and move it.", tool="secret"),
)

# ---------------------------------------------------------------------------
# Dependencies and frameworks
# ---------------------------------------------------------------------------


class Advisory(NamedTuple):
    """A package is affected below ``bound``."""

    package: str
    bound: str
    severity: str
    advisory_id: str
    fixed_version: str
    summary: str


# Package, bound, severity, id.  Summaries are our own wording.
ADVISORIES = (
    Advisory("flask", "0.12.3", "HIGH", "PYSEC-2019-DEBUG", "0.12.3",
             "Debug information can leak to clients."),
    Advisory("django", "3.2.18", "CRITICAL", "CVE-2023-24580", "3.2.18",
             "Uploads can exhaust the service."),
    Advisory("requests", "2.20.0", "HIGH", "CVE-2018-18074", "2.20.0",
             "Credentials follow a redirect to another host."),
    Advisory("pyyaml", "5.4", "CRITICAL", "CVE-2020-14343", "5.4",
             "The default loader can run code."),
    Advisory("lodash", "4.17.21", "HIGH", "CVE-2021-23337", "4.17.21",
             "Templates allow command injection."),
    Advisory("express", "4.17.3", "MEDIUM", "CVE-2022-24999", "4.17.3",
             "Query strings can exhaust the service."),
    Advisory("axios", "0.21.2", "HIGH", "CVE-2021-3749", "0.21.2",
             "A regular expression can exhaust the service."),
    Advisory("jsonwebtoken", "9.0.0", "CRITICAL", "CVE-2022-23529", "9.0.0",
             "Verification can be bypassed in some set-ups."),
    Advisory("pillow", "9.0.1", "CRITICAL", "CVE-2022-22817", "9.0.1",
             "Prepared images can run code."),
)

# How a dependency finding is labelled.
DEPENDENCY_CATEGORY = "insecure-dependency"
DEPENDENCY_CONFIDENCE = 85
DEPENDENCY_PATH = "dependency manifest"

# Framework label by marker.
PYTHON_MARKERS = {
    "fastapi": "FastAPI", "flask": "Flask", "django": "Django",
    "sqlalchemy": "SQLAlchemy", "pydantic": "Pydantic",
}
NPM_MARKERS = {
    "react": "React", "next": "Next.js", "vue": "Vue", "express": "Express",
    "@nestjs/core": "NestJS", "svelte": "Svelte",
}

# ---------------------------------------------------------------------------
# External tool reports
# ---------------------------------------------------------------------------

# Severity and confidence of external tools in our terms.
SEMGREP_SEVERITY = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
SEMGREP_CONFIDENCE = 80
BANDIT_CONFIDENCE = {"HIGH": 85, "MEDIUM": 65, "LOW": 40}
BANDIT_OTHER_CONFIDENCE = 50
DEFAULT_CATEGORY = "security-misconfiguration"

# ---------------------------------------------------------------------------
# Security areas
# ---------------------------------------------------------------------------


class Area(NamedTuple):
    name: str
    kind: str
    path_patterns: tuple
    text_patterns: tuple


# Area, kind, path patterns, category/title patterns.
AREAS = (
    Area("Frontend", "ui",
         (".jsx", ".tsx", ".vue", ".svelte", "src/components/", "src/pages/",
          "src/views/", "frontend/", "client/", "public/"),
         ("xss", "cross-site scripting", "dom injection", "csrf",
          "cross-site request forgery", "open redirect", "clickjacking")),
    Area("Backend", "compute",
         ("backend/", "server/", "controllers/", "handlers/", "middleware/"),
         ("command injection", "rce", "remote code execution", "code execution",
          "deserialization", "server-side request forgery")),
    Area("API", "interface",
         ("api/", "endpoints/", "graphql/", "rest/", "swagger", "openapi"),
         ("api key exposure", "insecure endpoint", "rate limiting",
          "broken access control")),
    Area("Database", "data",
         (".sql", "database/", "db/", "migrations/", "schema/", "queries/"),
         ("sql injection", "sqli", "sql_injection", "nosql injection",
          "hardcoded_sql", "sql_expression", "sql expression", "raw sql",
          "raw_sql", "orm injection")),
    Area("Authentication", "identity",
         ("auth/", "authentication/", "oauth/", "jwt/"),
         ("authentication bypass", "auth bypass", "brute force",
          "session fixation", "session hijacking", "broken authentication",
          "default credentials", "missing authentication")),
    Area("Authorization", "access",
         ("permissions/", "roles/", "policies/", "rbac/", "acl/"),
         ("authorization bypass", "privilege escalation", "idor",
          "insecure direct object reference", "broken access control",
          "missing authorization")),
    Area("Configuration", "config",
         (".env", "config/", ".yml", ".yaml", ".toml", ".ini",
          "docker-compose", "dockerfile", "settings.", ".cfg"),
         ("misconfiguration", "insecure default", "debug mode",
          "verbose error", "insecure configuration")),
    Area("Dependencies", "supply-chain",
         ("package.json", "package-lock", "requirements.txt", "pipfile",
          "pom.xml", "build.gradle", "gemfile", "cargo.toml", "go.mod",
          "yarn.lock"),
         ("vulnerable dependency", "outdated dependency",
          "known vulnerability", "supply chain")),
    Area("Cryptography", "crypto",
         ("crypto/", "encryption/", "certs/", "ssl/", "tls/", ".pem", ".crt"),
         ("weak cipher", "insecure hash", "md5", "sha1", "broken crypto",
          "cryptography", "weak-cryptography", "weak_cryptography",
          "weak cryptography", "weak hashing", "hashlib",
          "insecure encryption", "deprecated algorithm")),
    Area("Secrets", "secrets",
         ("secrets/", "vault/", ".key", "credentials/"),
         ("hardcoded secret", "leaked credential", "exposed secret",
          "hardcoded password", "hardcoded api key", "private key exposure",
          "secret in source")),
    Area("File System", "storage",
         ("upload/", "download/", "storage/", "media/"),
         ("path traversal", "file inclusion", "directory traversal", "lfi",
          "rfi", "unrestricted upload", "arbitrary file")),
    Area("Network", "network",
         ("network/", "socket/", "proxy/", "websocket/"),
         ("ssrf", "server-side request forgery", "dns rebinding", "open port")),
    Area("Infrastructure", "infra",
         ("k8s/", "kubernetes/", "terraform/", "deploy/", "ci/", ".github/",
          "ansible/", "helm/"),
         ("container escape", "docker vulnerability",
          "kubernetes misconfiguration", "iam misconfiguration",
          "terraform misconfiguration")),
)

# Area of a finding no pattern claims, by path ending.
FALLBACK_AREAS = (
    (r"\.(py|rb|go|java|cs|php)$", "Backend"),
    (r"\.(js|jsx|ts|tsx|vue|svelte)$", "Frontend"),
    (r"\.(sql|db|sqlite)$", "Database"),
    (r"\.(ya?ml|toml|ini|cfg|conf|json)$", "Configuration"),
)
FALLBACK_AREA = "Backend"

# Areas that are drawn connected when both are present.
ADJACENT_AREAS = (
    ("Frontend", "API"), ("Frontend", "Authentication"),
    ("API", "Backend"), ("API", "Authentication"), ("API", "Authorization"),
    ("Backend", "Database"), ("Backend", "File System"),
    ("Backend", "Network"), ("Backend", "Authentication"),
    ("Backend", "Authorization"), ("Backend", "Cryptography"),
    ("Authentication", "Database"), ("Authentication", "Cryptography"),
    ("Authentication", "Secrets"), ("Authorization", "Database"),
    ("Database", "Secrets"), ("Database", "Cryptography"),
    ("Configuration", "Secrets"), ("Configuration", "Infrastructure"),
    ("Dependencies", "Backend"), ("Dependencies", "Frontend"),
    ("Cryptography", "Secrets"), ("Cryptography", "Network"),
    ("Infrastructure", "Network"), ("Infrastructure", "Backend"),
    ("File System", "Infrastructure"),
)

# Severity rank in the graph (higher is worse).
GRAPH_RANKS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}

# Layout of the area ellipse and of the file circles.
LAYOUT_CENTRE = (50.0, 50.0)
LAYOUT_RADII = (30.0, 26.0)
LAYOUT_PAIR_X = (30.0, 70.0)
CHILD_RADIUS = 8
CHILD_CROWD = 5

# ---------------------------------------------------------------------------
# Dashboard
# ---------------------------------------------------------------------------

# Displayed base score by severity, and risk bands.
CVSS = {"critical": 9.5, "high": 7.5, "medium": 5.0, "low": 2.5}
CVSS_DEFAULT = 5.0
RISK_BANDS = (
    (75, "critical", "Critical Exposure"), (50, "high", "Elevated Risk"),
    (25, "medium", "Moderate Risk"), (0, "low", "Low Risk"),
)
