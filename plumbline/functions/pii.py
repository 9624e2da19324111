"""Personal-data patterns and column-name hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind, pattern, smallest and largest byte length the pattern applies to.
CONTENT_PATTERNS: dict[str, tuple[str, int | None, int | None]] = {
    "email": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", None, None),
    "phone number": (r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", None, None),
    "SSN": (r"^\d{3}-\d{2}-\d{4}$", 11, 11),
    "credit card": (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4,7}\b", 14, None),
    "IP address": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", None, None),
    "date of birth": (r"\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b", None, None),
    "postal code": (r"\b\d{5}(?:-\d{4})?\b|(?i)\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b", None, None),
}
# Name fragments, tested in this order.
NAME_HINTS: dict[str, str] = {
    "email": r"email|e_mail|e-mail",
    "phone number": r"phone|mobile|cell|tel|fax",
    "SSN": r"ssn|social_security|socialsecurity|social-security",
    "IP address": r"ip_address|ipaddress|ip_addr|client_ip|user_ip|server_ip|source_ip|dest_ip|remote_ip|^ip$",
    "postal code": r"address|street|zip|postal|postcode",
    "date of birth": r"dob|birth",
}
# How serious a finding is.
SEVERITY: dict[str, str] = {
    "email": "warning",
    "phone number": "warning",
    "SSN": "error",
    "credit card": "error",
    "IP address": "warning",
    "date of birth": "warning",
    "postal code": "info",
}
# Fragments of names that reports mark as personal.
REPORT_NAME_FRAGMENTS = (
    "email", "phone", "ssn", "social_security", "address", "name", "first_name",
    "last_name", "firstname", "lastname", "dob", "date_of_birth", "birth", "passport",
    "license", "credit_card", "card_number", "zip", "postal", "ip_address", "ip",
)


def matches(cleaned: Column, kind: str) -> Column:
    """Whether a cleaned cell contains personal data of one kind."""
    pattern, shortest, longest = CONTENT_PATTERNS[kind]
    hit = cleaned.rlike(pattern)
    if shortest is not None:
        hit = (F.octet_length(cleaned) >= shortest) & hit
    if longest is not None:
        hit = (F.octet_length(cleaned) <= longest) & hit
    return hit


def name_hint(column: Column) -> Column:
    """Kind suggested by a column name alone, or null."""
    lowered = F.lower(column)
    return F.coalesce(*[F.when(lowered.rlike(p), F.lit(kind)) for kind, p in NAME_HINTS.items()])


def severity_of(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(s)) for k, s in SEVERITY.items()])


def is_personal_name(column: Column) -> Column:
    return F.lower(column).rlike("|".join(REPORT_NAME_FRAGMENTS))
