"""Column layouts of the tables the engine reads and writes."""

from __future__ import annotations

FILES = "project_id string, file_path string, content string"

PAYLOAD = "project_name string, files array<struct<filename:string,source_code:string>>"

SEMGREP_REPORT = (
    "results array<struct<check_id:string,path:string,start:struct<line:int>,"
    "extra:struct<severity:string,message:string,lines:string,metadata:struct<category:string>>>>")

BANDIT_REPORT = (
    "results array<struct<test_name:string,test_id:string,issue_severity:string,"
    "issue_confidence:string,filename:string,line_number:int,issue_text:string,code:string>>")

PACKAGE_JSON = "dependencies map<string,string>, devDependencies map<string,string>"

# Findings as producers emit them.  The three ordering columns stand for the
# position a finding has in a producer's list.
RAW_FINDING = (
    "project_id string, file_path string, line_number int, category string, severity string, "
    "confidence int, source_rank int, origin string, rule_ord int, match_ord int, rule_id string, "
    "title string, description string, impact string, recommendation string, example_fix string, "
    "source_tool string, code_snippet string, attack_path array<string>")

FINDINGS = (
    "scan_id string, project_id string, finding_id string, fingerprint string, title string, category string, "
    "severity string, confidence int, file_path string, line_number int, description string, "
    "impact string, recommendation string, example_fix string, source_tool string, "
    "code_snippet string, attack_path array<string>, ai_explanation string, "
    "ai_reasoning_summary string, ai_confidence int, status string, created_at timestamp_ntz, "
    "source_rank int, origin string, rule_ord int, match_ord int")

REPORTS = (
    "scan_id string, project_name string, scan_date timestamp_ntz, overall_score int, "
    "security_posture string, total_findings bigint, critical_count bigint, high_count bigint, "
    "medium_count bigint, low_count bigint, explanations_available string")

SCAN_METADATA = (
    "scan_id string, total_files bigint, python_files bigint, javascript_files bigint, "
    "config_files bigint, detected_frameworks array<string>, scan_duration double")

# Submissions that were not scanned, and why.
REFUSALS = "submission string, project_name string, scan_date timestamp_ntz, reason string"

# What was appended: one row per finished append, and the place of every scan and refusal.
COMMITS = "commit_id string, scans bigint, refusals bigint"
SCAN_INDEX = "scan_id string, commit_id string, scan_day date"

STATUS_CHANGES = "finding_id string, status string, changed_at timestamp, change_id bigint"


def names(layout: str) -> list[str]:
    """Column names of a flat layout string."""
    depth, found, word = 0, [], ""
    for ch in layout + ",":
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            found.append(word.split()[0])
            word = ""
        else:
            word += ch
    return found
