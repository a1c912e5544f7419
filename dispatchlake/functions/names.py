"""Run names, repository ids and manifest paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The run-name grammar and its limits.
LONGEST_NAME = 200
LONGEST_CONTRIBUTOR = 39
LONGEST_REPOSITORY = 193
LONGEST_SEGMENT = 96
EXTENSION = r"\.(jsonl|ndjson)$"
ARTIFACT = r"^(?:raw|window-cb[1-9][0-9]*)$"
SLUG = r"^[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?$"
CONTRIBUTOR = r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$"
REPOSITORY_SEGMENT = r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?$"
CAPTURED = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})t([0-9]{2})-([0-9]{2})-([0-9]{2})z$"
# Published names older than the grammar.
EXEMPT_NAMES = (
    "glm52-q1t-t158-mtp-k3.jsonl",
    "hy3-oq2e-mtp-k2.jsonl",
    "laguna-s21-oq4e-ar.jsonl",
    "qwen36-27b-mtp-k3.jsonl",
    "qwen36-35b-a3b-k1.jsonl",
)
HUB = "https://huggingface.co/"


def _unclear(value: Column) -> Column:
    return F.contains(value, F.lit("..")) | F.contains(value, F.lit("--"))


def _is_path(name: Column) -> Column:
    return name.rlike(r"[/\\\x00]")


def run_name(name: Column) -> Column:
    """Parts of a run name as a struct, NULL when the name does not follow the grammar."""
    stem = F.regexp_replace(name, EXTENSION, "")
    artifact = F.element_at(F.split(stem, r"\."), -1)
    identity = F.regexp_replace(stem, r"\.[^.]*$", "")
    fields = F.split(identity, "__")
    slugs = F.split(F.get(fields, 0), "--")
    owner, repository = F.get(slugs, 0), F.get(slugs, 1)
    contributor, captured = F.get(fields, 1), F.get(fields, 2)

    def part(index: int) -> Column:
        return F.regexp_extract(captured, CAPTURED, index).try_cast("int")

    # Years below 100 cannot be told from two-digit ones; a 60th second does not exist.
    moment = F.when(
        (part(1) >= 100) & (part(6) < 60),
        F.try_make_timestamp_ntz(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(16,6)")),
    )
    good = (
        (F.length(name) > 0)
        & (F.length(name) <= LONGEST_NAME)
        & ~_is_path(name)
        & name.rlike(EXTENSION)
        & F.contains(stem, F.lit("."))
        & artifact.rlike(ARTIFACT)
        & (F.size(fields) == 3)
        & (F.size(slugs) == 2)
        & owner.rlike(SLUG)
        & ~_unclear(owner)
        & repository.rlike(SLUG)
        & ~_unclear(repository)
        & contributor.rlike(CONTRIBUTOR)
        & ~_unclear(contributor)
        & (F.length(contributor) <= LONGEST_CONTRIBUTOR)
        & captured.rlike(CAPTURED)
        & moment.isNotNull()
    )
    return F.when(
        F.coalesce(good, F.lit(False)),
        F.struct(
            F.concat_ws("/", owner, repository).alias("repository_slug"),
            contributor.alias("contributor"),
            F.date_format(moment.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capture_utc"),
            artifact.alias("artifact"),
            F.concat(F.lit("."), F.regexp_extract(name, EXTENSION, 1)).alias("extension"),
        ),
    )


def name_errors(name: Column) -> Column:
    """What is wrong with a run name, as a list of codes; empty for valid and exempt names."""
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "empty-name"),
            F.when(F.length(name) > LONGEST_NAME, "name-too-long"),
            F.when(_is_path(name), "not-a-basename"),
            F.when((F.length(name) > 0) & run_name(name).isNull(), "grammar-mismatch"),
        )
    )
    return F.when(name.isin(*EXEMPT_NAMES), F.array().cast("array<string>")).otherwise(found)


def repository_url(repository: Column) -> Column:
    """Link for an ``owner/name`` id, NULL when it is not a safe one."""
    parts = F.split(repository, "/")

    def fine(segment: Column) -> Column:
        return (
            (F.length(segment) <= LONGEST_SEGMENT) & segment.rlike(REPOSITORY_SEGMENT) & ~_unclear(segment)
        )

    good = (F.length(repository) <= LONGEST_REPOSITORY) & (F.size(parts) == 2) & F.forall(parts, fine)
    return F.when(good, F.concat(F.lit(HUB), repository))


def path_is_safe(path: Column) -> Column:
    """A relative POSIX path to a capture file that stays below its root."""
    steps = F.split(path, "/")
    return F.coalesce(
        ~path.rlike(r"[\\\x00]")
        & ~path.rlike(r"^[A-Za-z]:")
        & ~F.exists(steps, lambda s: s.isin("", ".", ".."))
        & F.element_at(steps, -1).rlike(r"(?i)^.+\.(jsonl|ndjson)$"),
        F.lit(False),
    )
