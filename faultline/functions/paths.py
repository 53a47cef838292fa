"""Path expressions: admission, language, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import seeds

# Folder below which scans keep their working copies; a deployment may name its own.
WORK_MARKER = "scan_work"


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    """Path parts without empty and ``.`` parts."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def basename(path: Column) -> Column:
    """Last part; the whole path when that part is empty."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last != "", last).otherwise(path)


def suffix(path: Column) -> Column:
    """Ending from the last dot of the base name; none for dotfiles."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def is_allowed(path: Column) -> Column:
    return basename(path).isin(*seeds.ALLOWED_NAMES) | F.lower(suffix(path)).isin(*seeds.ALLOWED_SUFFIXES)


def in_blocked_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, seeds.BLOCKED_DIRS)))


def is_unsafe_entry(path: Column) -> Column:
    """Archive path that is absolute, climbs, or names a drive."""
    return (
        path.startswith("/")
        | F.array_contains(F.split(path, "/"), "..")
        | slashes(path).rlike("(?s)^.:")
    )


def inline_name(name: Column) -> Column:
    """Submitted file name with forward slashes and without leading ones."""
    return F.regexp_replace(slashes(F.coalesce(name, F.lit(""))), "^/+", "")


def is_unsafe_inline(name: Column) -> Column:
    """Whether a name as given by :func:`inline_name` must be refused."""
    return F.exists(F.split(name, "/"), lambda p: p.isin("", ".", ".."))


def language(path: Column) -> Column:
    """``py`` or ``js`` by lower-cased suffix, else null."""
    ending = F.lower(suffix(path))
    routed = F.lit(None).cast("string")
    for name in dict.fromkeys(seeds.LANGUAGE_SUFFIXES.values()):
        endings = [e for e, lang in seeds.LANGUAGE_SUFFIXES.items() if lang == name]
        routed = F.when(ending.isin(*endings), name).otherwise(routed)
    return routed


def counted_language(path: Column) -> Column:
    """Language for the file counters, which compare endings case-sensitively."""
    scripts = [e for e, lang in seeds.LANGUAGE_SUFFIXES.items() if lang == "js"]
    is_script = F.lit(False)
    for ending in scripts:
        is_script = is_script | path.endswith(ending)
    return F.when(path.endswith(".py"), "py").when(is_script, "js")


def is_config(path: Column) -> Column:
    return basename(path).isin(*seeds.CONFIG_NAMES) | suffix(path).isin(*seeds.CONFIG_SUFFIXES)


def relative_path(path: Column, root: Column, marker: str = WORK_MARKER) -> Column:
    """Path below ``root``; else below ``<marker>/<id>/[project/]``; else the base name."""
    plain = slashes(path)
    below_root = F.when(path.startswith(F.concat(root, F.lit("/"))),
                        F.substr(path, F.length(root) + 2))
    after = F.when(F.contains(plain, F.lit(marker + "/")),
                   F.regexp_extract(plain, f"(?s)^.*?\\Q{marker}\\E/(.*)$", 1))
    rest = F.regexp_replace(F.regexp_replace(after, "(?s)^[^/]*/", ""), "^project/", "")
    below_marker = F.when(F.contains(after, F.lit("/")), rest).otherwise(after)
    last = F.element_at(F.split(path, "/"), -1)
    chosen = F.coalesce(below_root, below_marker, last)
    return F.when(chosen.isin("", "."), last).otherwise(chosen)


def graph_path(path: Column, marker: str = WORK_MARKER) -> Column:
    """Path as the graph shows it; ``unknown`` when there is none."""
    plain = slashes(path)
    inner = F.regexp_extract(plain, f"\\Q{marker}\\E/[0-9a-fA-F-]+/(.+)$", 1)
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown").when(inner != "", inner).otherwise(plain)
