"""Keyword lists: validation, one literal pattern for all words, profiles."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WORDS, MAX_WORD = 100, 150
MAX_PROFILE_BYTES, MAX_NAME = 262_144, 80

#: Words used when the caller names none (fixed values).
DEFAULT_WORDS = (
    "Highly Confidential", "Confidential (Restricted)", "Confidentiality", "Confidential", "Internal Use Only", "Draft",
    "機密", "僅限內部使用", "草稿",
)


class KeywordError(ValueError):
    """A keyword list or profile that breaks the rules."""


def normalize(words: list[str] | tuple[str, ...] | None = None) -> list[str]:
    """Trimmed, without blanks, each once in the order given; 1 to 100 words of 150 characters at most."""
    kept = list(dict.fromkeys(w.strip() for w in (DEFAULT_WORDS if words is None else words) if w.strip()))
    if not 1 <= len(kept) <= MAX_WORDS or max(map(len, kept)) > MAX_WORD:
        raise KeywordError("give 1 to 100 keywords that are not blank, of 150 characters at most")
    return kept


def longest_first(words: list[str]) -> list[str]:
    return sorted(words, key=lambda w: -len(w))


def spark_pattern(words: list[str] | tuple[str, ...] | None = None) -> str:
    """One case-insensitive alternation of quoted literals, the longest first so that it wins where several begin."""
    quoted = ("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in longest_first(normalize(words)))
    return "(?iu)" + "|".join(quoted)


def normalized_column(words: Column) -> Column:
    """The same rules for an array column; a list that breaks them is null."""
    kept = F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: F.length(w) > 0))
    valid = F.size(kept).between(1, MAX_WORDS) & F.forall(kept, lambda w: F.length(w) <= MAX_WORD)
    return F.when(valid, kept)


def longest_first_column(words: Column) -> Column:
    """Stable: words of equal length keep their order."""
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("k"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(placed), lambda s: s["w"])


def profile_problem(raw: Column) -> Column:
    """Why a profile's JSON text is not valid, or null. Version exactly 1, a name of 1 to 80 characters without control
    characters, keywords that are strings without ; CR LF NUL and pass ``normalize``, no other fields."""
    one = F.get_json_object(raw, "$.schema_version")
    # parsed as strings with their quotes, so that types can be told apart
    fields = F.from_json(raw, "schema_version STRING, name STRING, keywords ARRAY<STRING>")
    words = fields["keywords"]
    name = F.trim(fields["name"])
    text_words = F.regexp_count(F.regexp_extract(raw, r'"keywords"\s*:\s*\[([^\]]*)\]', 1), F.lit(r'"(?:[^"\\]|\\.)*"'))
    return (
        F.when(F.octet_length(raw) > MAX_PROFILE_BYTES, "too large")
        .when(F.json_object_keys(raw).isNull(), "no JSON object")
        .when(~raw.rlike(r'"schema_version"\s*:\s*1\s*[,}]') | one.isNull(), "schema_version")
        .when(~raw.rlike(r'"name"\s*:\s*"') | name.isNull() | ~F.length(name).between(1, MAX_NAME) | name.rlike(r"[\x00-\x1f\x7f]"), "name")
        .when(words.isNull() | (text_words != F.size(words)), "keywords")
        .when(F.exists(words, lambda w: w.rlike(r"[;\r\n\x00]")) | normalized_column(words).isNull(), "keywords")
    )


def read_profile(raw: bytes) -> dict:
    """A profile's fields, checked on the driver by the same rules."""
    if len(raw) > MAX_PROFILE_BYTES:
        raise KeywordError("a profile has 256 KiB at most")
    try:
        data = json.loads(raw.decode("utf-8-sig"))
    except (UnicodeDecodeError, ValueError) as error:
        raise KeywordError("a profile is UTF-8 JSON") from error
    if not isinstance(data, dict) or set(data) != {"schema_version", "name", "keywords"}:
        raise KeywordError("a profile has schema_version, name and keywords")
    if type(data["schema_version"]) is not int or data["schema_version"] != 1:
        raise KeywordError("schema_version is 1")
    name, words = data["name"], data["keywords"]
    if not isinstance(name, str) or not 1 <= len(name.strip()) <= MAX_NAME or any(ord(c) < 32 or ord(c) == 127 for c in name):
        raise KeywordError("a name has 1 to 80 characters, no control characters")
    if not isinstance(words, list) or not all(isinstance(w, str) and not any(c in w for c in ";\r\n\0") for w in words):
        raise KeywordError("keywords are strings without ; and line ends")
    return {"schema_version": 1, "name": name.strip(), "keywords": normalize(words)}
