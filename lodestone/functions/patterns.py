"""Patterns of the audit and the column expressions that count them.

The patterns keep to the subset that Java's regular expressions and RE2 read
alike: no look-around, no back-references, no possessive quantifiers. Runs that
a pattern tries anew from each of their characters are bounded, so that a long
token takes no more than linear time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public shapes of credential tokens.
CREDENTIALS = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}",
    "openai_key": r"\bsk-[A-Za-z0-9_-]{20,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned_token": r"\btoken\s*=\s*\S+",
}
# Shapes of personal data. Hits are candidates, not verdicts.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}",
    "phone": r"\+?[0-9][0-9 ().-]{8,}[0-9]",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"aws_access_key": "IA", "github_token": "_", "openai_key": "sk-", "private_key": "PRIVATE KEY-----", "assigned_token": "token", "email": "@", "ipv4": "."}
LICENCE = r"(?i)\blicen[sc]ed?\b"
# Fixed value: the first line of the public large-file pointer format.
STUB = r"^version https://git-lfs\.github\.com/spec/v1\n"


def hits(text: Column, pattern: str, literal: str | None = None) -> Column:
    """How often ``pattern`` occurs in ``text``; 0 where it is null, or lacks the literal that it needs."""
    found = F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.coalesce(F.when(text.contains(literal), found) if literal else found, F.lit(0))


def needs(name: str, pattern: str) -> str | None:
    """The literal without which the pattern can't occur, if it is one of those above."""
    return NEEDS.get(name) if (CREDENTIALS | PERSONAL).get(name) == pattern else None


def any_of(text: Column, patterns: dict[str, str]) -> Column:
    """Whether any of the patterns occurs: those that need a literal by themselves, the others in one pass."""
    plain = [f"(?:{p})" for k, p in patterns.items() if not needs(k, p)]
    out = text.rlike("|".join(plain)) if plain else F.lit(False)
    for k, p in patterns.items():
        if literal := needs(k, p):
            out = (text.contains(literal) & text.rlike(p)) | out
    return out


def licence_lines_of(text: Column) -> Column:
    """The lines of ``text`` that mention a licence.

    Lines are split first: a pattern that takes the whole line would retry
    from each character of it.
    """
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(LICENCE))


def spare(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name in taken:
        name += "_"
    return name


def first_class(subject: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The class of the first rule whose pattern is found in ``subject``."""
    out = None
    for name, pattern in rules:
        out = (F.when if out is None else out.when)(subject.rlike(pattern), F.lit(name))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))
