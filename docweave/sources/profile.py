"""Profiles: what a JSON file says of a dataset's folders, numbers and owner, and which profile fits a dataset."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..build import Options
from ..functions.text import GENERIC_DOMAINS
from ..operators import extract
from ..operators import files as ops

#: The share of paths that a profile's folder patterns must fit for it to be suggested.
SUGGESTED = 0.3


@dataclass(frozen=True)
class Profile:
    """The settings of a profile; a key that its file lacks has the default."""

    name: str = "default"
    folder_patterns: tuple[str, ...] = ()
    skip_directories: tuple[str, ...] = ()
    job_id: str | None = None
    owner: str | None = None
    owner_domain: str | None = None
    types: dict[str, str] = field(default_factory=lambda: dict(extract.TYPE_OF_PREFIX))
    generic_domains: tuple[str, ...] = GENERIC_DOMAINS

    def options(self, owner: str | None = None) -> Options:
        """Options of a build; an owner that is given goes before the profile's."""
        return Options(patterns=self.folder_patterns, skip_directories=self.skip_directories, job_id=self.job_id, owner=owner or self.owner, types=self.types, owner_domain=None if owner else self.owner_domain, generic_domains=self.generic_domains)


#: Keys of a profile file, and the fields that they set.
KEYS = {"folderPatterns": "folder_patterns", "skipDirectories": "skip_directories", "jobIdPattern": "job_id", "owner": "owner", "ownerDomain": "owner_domain", "documentPrefixes": "types", "genericEmailDomains": "generic_domains"}


def parse(name: str, text: str) -> Profile:
    """A profile from JSON. Unknown keys are an error, so that a misspelt one is seen."""
    raw = json.loads(text)
    known = {*KEYS, "legalSuffixes"}
    if unknown := sorted(set(raw) - known):
        raise ValueError(f"profile {name}: unknown keys {', '.join(unknown)}")
    if raw.get("legalSuffixes") is not None:
        warnings.warn(f"profile {name}: legalSuffixes is not used, names are compared without the usual ones", stacklevel=2)
    values = {KEYS[k]: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in KEYS and v is not None}
    return Profile(name, **values)


def read(spark: SparkSession, path: str) -> dict[str, Profile]:
    """The profiles in a folder of JSON files, or in one file, by name; any file system that Spark reads."""
    rows = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_name AS name", "value").collect()
    return {n: parse(n, r["value"]) for r in sorted(rows) if (n := r["name"].removesuffix(".json"))}


def suggested(paths: DataFrame, profiles: dict[str, Profile]) -> Profile | None:
    """The profile whose folder patterns fit most of ``path``, if enough; the later by name of equal ones. A share for each comes to the driver."""
    patterned = {n: list(p.folder_patterns) for n, p in profiles.items() if p.folder_patterns}
    if not patterned:
        return None
    shares = sorted((r["share"] or 0.0, r["profile"]) for r in ops.pattern_share(paths, patterned).collect())
    share, name = shares[-1]
    return profiles[name] if share >= SUGGESTED else None


def chosen(paths: DataFrame, profiles: dict[str, Profile], own: Profile | None = None, asked: str | None = None, default: str | None = None) -> Profile:
    """The dataset's own profile, else the one asked for, else the default by name, else the suggested one, else the defaults."""
    for name in (asked, default):
        if own is None and name is not None:
            own = profiles[name]
    return own or suggested(paths, profiles) or Profile()
