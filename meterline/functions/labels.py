"""Scalar display functions as Column expressions (O9.1-O9.4, O9.10).

All of them are built from regexp / array higher-order functions so they stay
inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference for equal labels) -------------
# Model-id patterns, tried in this order:
#   claude-<type>-<major>-<minor>-<8 digit date>  -> Type-major.minor
#   claude-<type>-<major>-<8 digit date>          -> Type-major
#   claude-<type>-<major>-<minor>                 -> Type-major.minor
#   claude-<type>-<major>                         -> Type-major
MODEL_RE_MINOR_DATE = r"^claude-(\w+)-(\d+)-(\d+)-\d{8}"
MODEL_RE_DATE = r"^claude-(\w+)-(\d+)-\d{8}"
MODEL_RE_MINOR = r"^claude-(\w+)-(\d+)-(\d+)$"
MODEL_RE_MAJOR = r"^claude-(\w+)-(\d+)$"
# Known non-Claude names and their labels.
KNOWN_MODEL_LABELS = {
    "gpt-4o": "gpt-4o",
    "gpt-4o-mini": "gpt-4o-mini",
    "gpt-4": "gpt-4",
    "gpt-3.5-turbo": "gpt-3.5",
}
# Fallback label length.
MODEL_LABEL_MAX = 12
SYNTHETIC_MODEL = "<synthetic>"

# Project-name patterns.
SRC_PROJECT_RE = r"(?:^|-)(?:go_)?(?:src|react_src|python_src)[_-]([A-Za-z][A-Za-z0-9_-]+)"
BLOG_PROJECT_RE = r"blog-([a-z]+)-([a-z]+)"
SYSTEM_SEGMENT_RE = r"^(Volumes?|Users?|home|var|tmp|opt|usr|bin|lib|etc|[A-Z0-9]+_[A-Z0-9]+|^\d+[A-Z]+$)$"
USER_NAME_RE = r"^[a-z]+$"
USER_NAME_MAX = 8
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _title(c: Column) -> Column:
    return F.initcap(F.lower(c))


def model_label(col) -> Column:
    """Short display label of a model id (O9.1)."""
    m = _c(col)
    known = F.create_map(*[F.lit(x) for kv in KNOWN_MODEL_LABELS.items() for x in kv])

    def grp(rx, i):
        return F.regexp_extract(m, rx, i)

    return (
        F.when(m.rlike(MODEL_RE_MINOR_DATE),
               F.concat(_title(grp(MODEL_RE_MINOR_DATE, 1)), F.lit("-"), grp(MODEL_RE_MINOR_DATE, 2),
                        F.lit("."), grp(MODEL_RE_MINOR_DATE, 3)))
        .when(m.rlike(MODEL_RE_DATE),
              F.concat(_title(grp(MODEL_RE_DATE, 1)), F.lit("-"), grp(MODEL_RE_DATE, 2)))
        .when(m.rlike(MODEL_RE_MINOR),
              F.concat(_title(grp(MODEL_RE_MINOR, 1)), F.lit("-"), grp(MODEL_RE_MINOR, 2),
                       F.lit("."), grp(MODEL_RE_MINOR, 3)))
        .when(m.rlike(MODEL_RE_MAJOR),
              F.concat(_title(grp(MODEL_RE_MAJOR, 1)), F.lit("-"), grp(MODEL_RE_MAJOR, 2)))
        .otherwise(F.coalesce(F.element_at(known, m), F.substring(m, 1, MODEL_LABEL_MAX)))
    )


def is_real_model(col) -> Column:
    """Model counts in model lists: non-empty and not the synthetic marker."""
    m = _c(col)
    return m.isNotNull() & (m != "") & (m != SYNTHETIC_MODEL)


def project_short_name(col) -> Column:
    """Last path segment, 'unknown' for an empty path (O9.3)."""
    p = _c(col)
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit("unknown")).otherwise(
        F.element_at(F.split(p, "/"), -1))


def short_file_label(col) -> Column:
    """'subagents/<file>' for sub-agent logs, else the file name (O9.4)."""
    p = _c(col)
    parts = F.split(p, "/")
    idx = F.array_position(parts, "subagents")
    return F.when((idx > 0) & (idx < F.size(parts)),
                  F.concat(F.lit("subagents/"), F.element_at(parts, (idx + 1).cast("int")))
                  ).otherwise(F.element_at(parts, -1))


def project_label(col) -> Column:
    """Readable project name from a project path (O9.2).

    Order of rules: the directory after 'projects' (else the last part), one
    leading '-' removed; then src-<name>; then blog-<a>-<b>; then the last
    one or two meaningful '-' segments, where system segments and short
    lower-case words (unless a '*_src' segment came before) are skipped.
    """
    p = F.coalesce(_c(col), F.lit(""))
    parts = F.split(p, "/")
    idx = F.array_position(parts, "projects")
    after = F.element_at(parts, (idx + 1).cast("int"))
    name0 = F.when((idx > 0) & (idx < F.size(parts)) & (after != ""), after).otherwise(
        F.element_at(parts, -1))
    name = F.when(name0.startswith("-"), F.substring(name0, 2, 1 << 30)).otherwise(name0)

    segs = F.split(name, "-")
    n = F.size(segs)
    # position-aware view of the segments: struct(i, s), i is 1-based
    indexed = F.transform(segs, lambda s, i: F.struct((i + 1).alias("i"), s.alias("s")))

    def is_sys(s):
        return s.rlike(SYSTEM_SEGMENT_RE)

    def found_before(i):
        # a '*_src' segment that is not a system segment appeared before i
        return F.exists(indexed, lambda e: (e["i"] < i) & e["s"].endswith("_src") & ~is_sys(e["s"]))

    def next_seg(i):
        return F.element_at(segs, (i + 1).cast("int"))

    # first src trigger whose next segment exists and is not a system segment
    triggers = F.filter(
        indexed,
        lambda e: (~is_sys(e["s"]))
        & (e["s"].endswith("_src") | ((e["s"] == "src") & found_before(e["i"])))
        & (e["i"] < n) & ~is_sys(next_seg(e["i"])))
    src_hit = F.when(F.size(triggers) > 0,
                     F.concat(F.lit("src-"), next_seg(F.element_at(triggers, 1)["i"])))

    meaningful = F.transform(
        F.filter(indexed, lambda e: (~is_sys(e["s"]))
                 & ~(e["s"].rlike(USER_NAME_RE) & ~found_before(e["i"]) & (F.length(e["s"]) < USER_NAME_MAX))
                 & (F.length(e["s"]) > 2)),
        lambda e: e["s"])
    k = F.size(meaningful)
    tail = (F.when(k >= 2, F.concat(F.element_at(meaningful, -2), F.lit("-"), F.element_at(meaningful, -1)))
            .when(k == 1, F.element_at(meaningful, -1))
            .otherwise(F.element_at(segs, -1)))

    src_re = F.regexp_extract(name, SRC_PROJECT_RE, 1)
    blog1 = F.regexp_extract(name, BLOG_PROJECT_RE, 1)
    blog2 = F.regexp_extract(name, BLOG_PROJECT_RE, 2)
    return (F.when((p == "") | (p == "unknown"), F.lit("unknown"))
            .when(name.rlike(SRC_PROJECT_RE), F.concat(F.lit("src-"), src_re))
            .when(name.rlike(BLOG_PROJECT_RE), F.concat(F.lit("blog-"), blog1, F.lit("-"), blog2))
            .otherwise(F.coalesce(src_hit, tail)))
