"""Text tests: keywords, automation accounts, commit messages, names and slugs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskpanel import constants as K


def minimal_words(words: Iterable[str]) -> list[str]:
    """The words that can decide a substring match: one that contains another never does."""
    unique = sorted(set(words), key=len)
    return [w for i, w in enumerate(unique) if not any(u in w for u in unique[:i])]


def mentions_any(text: Column, words: Iterable[str]) -> Column:
    """True when any word occurs as a substring; text must already be lower case.

    Plain substring searches in generated code: several times faster on long texts than one
    regular expression with as many alternatives.
    """
    hits = [F.contains(text, F.lit(w)) for w in minimal_words(words)]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def text_blob(*parts: Column) -> Column:
    """Lower-cased parts joined by one space each; blank text becomes null."""
    joined = F.trim(F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])))
    return F.when(joined != "", joined)


def is_bot(login: Column) -> Column:
    """Known automation account, or a login that ends in the bot suffix; null is no bot."""
    low = F.lower(login)
    return F.coalesce(low.endswith(K.BOT_SUFFIX) | low.isin(*K.BOT_LOGINS), F.lit(False))


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def first_non_blank(*candidates: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def is_empty_message(message: Column) -> Column:
    return F.coalesce(F.trim(message), F.lit("")).isin(*K.EMPTY_COMMIT_MESSAGES)


def is_merge_message(message: Column) -> Column:
    return F.coalesce(F.trim(message).rlike(K.MERGE_COMMIT_PATTERN), F.lit(False))


def is_conventional_message(message: Column) -> Column:
    return F.coalesce(F.trim(message).rlike(K.CONVENTIONAL_COMMIT_PATTERN), F.lit(False))


def references_issue(message: Column) -> Column:
    return F.coalesce(message.rlike(K.ISSUE_REFERENCE_PATTERN), F.lit(False))


def valid_entity_id(text: Column) -> Column:
    """The trimmed id when it is a safe plain name, else null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), trimmed)


def package_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[-_.]+", "-"))


def repo_slug(entity: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(entity)), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.when(slug != "", slug)


def fallback_repo_names(entity: Column, owner: str, suffix: str = "-plugin") -> Column:
    """Repository names a naming convention suggests, best guess first."""
    slug = repo_slug(entity)
    long_name = F.concat(F.lit(f"{owner}/"), slug, F.lit(suffix))
    short_name = F.concat(F.lit(f"{owner}/"), slug)
    names = F.when(slug.endswith(suffix), F.array(long_name)).otherwise(
        F.array(long_name, short_name)
    )
    return F.when(slug.isNotNull(), names)


def tri_state(value: Column) -> Column:
    """Boolean from a boolean or its text; other text is unknown."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def feature_family(name: Column) -> Column:
    return (
        F.when(name.startswith("advisory_"), "Advisory History")
        .when(name.startswith("swh_"), "Software Heritage")
        .when(name.startswith("gharchive_"), "GitHub Archive")
        .otherwise("Other")
    )
