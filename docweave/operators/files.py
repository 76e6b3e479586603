"""Operators over the table of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_duplicates(files: DataFrame) -> DataFrame:
    """``duplicate_of``: the lowest id with the same content, null for the first itself."""
    first = files.filter("sha256 is not null").groupBy("sha256").agg(F.min("id").alias("first_id"))
    joined = files.join(first, "sha256", "left")
    return joined.withColumn("duplicate_of", F.when(F.col("first_id") != F.col("id"), F.col("first_id"))).drop("first_id")


def copy_text(files: DataFrame, columns: tuple[str, ...] = ("status", "text_source", "text", "error")) -> DataFrame:
    """Copies get what was read from their original, unless they are skipped."""
    original = files.filter("duplicate_of is null").select(F.col("id").alias("duplicate_of"), *[F.col(c).alias(f"first_{c}") for c in columns])
    joined = files.join(original, "duplicate_of", "left")
    takes = F.col("duplicate_of").isNotNull() & (F.col("status") != "skipped")
    return joined.select(*[F.when(takes, F.col(f"first_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in files.columns])


def to_read(files: DataFrame) -> DataFrame:
    """Files whose text is still to be read: new originals."""
    return files.filter("status = 'new' and duplicate_of is null")


def to_extract(files: DataFrame) -> DataFrame:
    """Files that extraction works on; copies are among them, skipped files and archives are not."""
    return files.filter("status != 'skipped' and kind != 'zip'")


def directory_pattern(pattern: str) -> str:
    """A regular expression for paths below directories that a pattern names: a leading ``/`` ties it to the
    root, a bare name matches at any depth, ``*`` and ``?`` stay within a name, ``**`` crosses names."""
    rooted, body = pattern.startswith("/"), pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i]))
            i += 1
    return ("^" if rooted or "/" in body else "(?:^|/)") + out + "/"


def in_directories(path: Column, patterns: list[str]) -> Column:
    """Whether a path lies below a directory that one of the patterns names."""
    return path.rlike("|".join(f"(?:{directory_pattern(p)})" for p in patterns)) if patterns else F.lit(False)


_FIELD = re.compile(r"\{(company|job_id|title|category|area)(?::((?:[^{}]|\{[^{}]*\})+))?\}")


def folder_pattern(pattern: str) -> tuple[str, list[str]]:
    """A regular expression for paths and the fields that its groups capture, in order.

    Segments are separated by ``/``; ``{company}``, ``{title}``, ``{category}``, ``{area}`` and ``{job_id}`` capture
    text within one, ``{job_id:REGEX}`` what matches; ``**`` stands for any segments, a space for white space.
    A segment that has a job id is captured whole, as ``job``.
    """
    out, fields = "^", []
    segments = pattern.strip("/").split("/")
    for at, segment in enumerate(segments):
        if segment == "**":
            out += "(?:[^/]+/)*"
            continue
        body, last = "", 0
        for m in _FIELD.finditer(segment):
            body += re.escape(segment[last : m.start()]).replace(r"\ ", r"\s+")
            inner = re.sub(r"\((?!\?)", "(?:", m[2]) if m[2] else "[^/]+?"
            body += f"({inner})"
            last = m.end()
        body += re.escape(segment[last:]).replace(r"\ ", r"\s+").replace(r"\*", "[^/]*")
        named = [m[1] for m in _FIELD.finditer(segment)]
        if "job_id" in named or "title" in named:
            body, named = f"({body})", ["job", *named]
        fields += named
        out += body + ("/" if at < len(segments) - 1 else "(?:/|$)")
    return out, fields


CONTEXT = ("area", "company", "job", "job_id", "title", "category")


def folder_context(path: Column, patterns: list[str]) -> dict[str, Column]:
    """Columns for area, company, job, job_id, title and category from the first pattern that fits a path.

    The area is the first segment unless a pattern captures it. Where no pattern is given the category is
    the second segment. A job without an id has its title as id.
    """
    parts = F.split(path, "/")
    found: dict[str, Column] = {c: F.lit(None).cast("string") for c in CONTEXT}
    for pattern in reversed(patterns):
        regex, fields = folder_pattern(pattern)
        fits = path.rlike(regex)
        for name in CONTEXT:
            value = F.nullif(F.trim(F.regexp_extract(path, regex, fields.index(name) + 1)), F.lit("")) if name in fields else F.lit(None).cast("string")
            found[name] = F.when(fits, value).otherwise(found[name])
    found["area"] = F.coalesce(found["area"], F.when(F.size(parts) > 1, parts[0]))
    if not patterns:
        found["category"] = F.when(F.size(parts) > 2, parts[1])
    found["job_id"] = F.coalesce(found["job_id"], found["title"])
    return found


def with_context(files: DataFrame, patterns: list[str]) -> DataFrame:
    context = folder_context(F.col("path"), patterns)
    names = {"area": "area", "company": "folder_company", "job": "folder_job", "job_id": "folder_job_id", "title": "folder_job_title", "category": "folder_category"}
    return files.withColumns({names[k]: v for k, v in context.items()})


def pattern_share(paths: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """``profile, share``: the share of paths that one of a profile's folder patterns fits."""
    shares = [F.avg(F.col("path").rlike("|".join(f"(?:{folder_pattern(p)[0]})" for p in ps)).cast("double")).alias(name) for name, ps in patterns.items()]
    return paths.agg(*shares).select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in patterns]), F.array(*[F.col(f"`{n}`") for n in patterns])))).toDF("profile", "share")
