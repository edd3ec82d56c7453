"""Column expressions over text, paths, URLs and identifiers."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from talespark.functions import times
from talespark.functions.basic import let  # noqa: F401
from talespark.functions.times import epoch_of

# The white space characters that text is trimmed of and split at.
WHITESPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# Shapes of secrets, in the order in which they are replaced, and the marker.
SECRET_PATTERNS = [
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{16,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
]
REDACTED = "[REDACTED]"

#: The URL name space of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def normalize_text(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WHITESPACE + "+", " "))


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def redact(c: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        c = F.regexp_replace(c, _unicode(pattern), REDACTED)
    return c


def secret_hits(c: Column) -> Column:
    """Numbers (from 0) of the patterns that a text matches."""
    return F.filter(F.array(*(F.when(c.rlike(_unicode(p)), F.lit(i)) for i, p in enumerate(SECRET_PATTERNS))), lambda x: x.isNotNull())


def slugify(c: Column, default: str = "session-note") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


@functools.cache
def _folds() -> dict[str, str]:
    """Letters that full case folding turns into something else than their lower case, by its
    rule, and the capital sigma, whose lower case depends on its place in a word."""
    return {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c.lower() or c == "\u03a3"}


@functools.cache
def _fold_class() -> str:
    """A pattern for one of these letters, as ranges of neighbours."""
    at = sorted(map(ord, _folds()))
    first = [c for c in at if c - 1 not in set(at)]
    last = [c for c in at if c + 1 not in set(at)]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last)) + "]"


def fold(c: Column) -> Column:
    """Full case folding: like lower case, but one letter may become several (sharp s, ligatures),
    and a final sigma is a sigma. Texts without such a letter, nearly all, are only lower-cased."""
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in _folds().items())), F.lit(","), F.lit(":"))
    letters = F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), F.lower(x)))
    special = c.rlike(r"[^\x00-\x7F]") & c.rlike(_fold_class())
    return F.when(special, F.array_join(letters, "")).otherwise(F.lower(c))


def normalize_path(c: Column) -> Column:
    """Back slashes, no trailing one, mounted drives as drives, case folded."""
    p = F.regexp_replace(F.replace(c, F.lit("/"), F.lit("\\")), r"\\+$", "")
    drive = F.regexp_replace(F.regexp_replace(p, r"^\\mnt\\([A-Za-z])(\\|$)", "$1:\\\\"), r"\\+$", "")
    return fold(F.when(p.rlike(r"^\\mnt\\[A-Za-z](\\|$)"), drive).otherwise(p))


def ancestors(path: Column) -> Column:
    """A normalised path and all directories above it."""
    parts = F.split(path, r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "\\"))


def normalize_repo_url(c: Column) -> Column:
    u = F.replace(F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", ""), F.lit("\\"), F.lit("/"))
    u = F.regexp_replace(F.regexp_replace(u, r"^git@([^:]+):", "https://$1/"), r"\.git$", "")
    return fold(F.regexp_replace(u, "/+$", ""))


def normalize_git_remote(c: Column) -> Column:
    """The other form of a repository's URL: ``ssh://git@`` reads as https, and ``.git`` goes
    whatever its case, behind slashes too. Null stays null."""
    u = F.regexp_replace(F.replace(strip(c), F.lit("\\"), F.lit("/")), r"\Agit@([^:]*):", "https://$1/")
    u = F.regexp_replace(F.regexp_replace(u, r"(?i)\Assh://git@", "https://"), r"/+\z", "")
    return fold(F.regexp_replace(u, r"(?i)\.git\z", ""))


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def strip(c: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(c, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


# What marks the user's own request, injected instructions and surroundings in a user message.
REQUEST_MARKERS = ["## My request for Codex:", "## My request for Codex"]
INSTRUCTION_HEADING = "# AGENTS.md instructions for"
INSTRUCTION_TAGS = ["<INSTRUCTIONS>", "</INSTRUCTIONS>"]
ENVIRONMENT_TAG = "<environment_context>"


def clean_user_text(c: Column) -> Column:
    """What the user wrote: the part behind a request marker, else nothing for a message
    of instructions only, else the text without instruction and environment blocks."""
    opened, closed = INSTRUCTION_TAGS
    body = F.regexp_replace(c, rf"(?s)\A(?=.*{opened}).*?{closed}", "")
    whole = F.regexp_replace(body, rf"(?s){ENVIRONMENT_TAG}.*", "")
    whole = F.when(c.rlike(rf"\A{WHITESPACE}*{INSTRUCTION_HEADING.replace('.', '[.]')}"), "").otherwise(whole)
    for mark in reversed(REQUEST_MARKERS):
        whole = F.when(c.contains(mark), F.regexp_replace(c, rf"(?s)\A.*?{mark}", "")).otherwise(whole)
    return strip(whole)


def event_epoch(c: Column) -> Column:
    """:func:`times.event_epoch` of the text without white space at its ends."""
    return times.event_epoch(strip(c))


def time_key(c: Column) -> Column:
    """Order of times: those with a zone by instant, then the others by text."""
    e = epoch_of(c)
    return F.struct(F.when(e.isNull(), 1).otherwise(0).alias("zoneless"), F.coalesce(e, F.lit(0.0)).alias("epoch"), F.when(e.isNull(), F.coalesce(c, F.lit(""))).otherwise("").alias("text"))


def local_time(c: Column, pattern: str, zone_hours: int = 9) -> Column:
    """A time with a zone, as ``day`` or ``clock`` at a fixed offset whatever the session's
    zone; null without a zone."""
    seconds = F.floor(epoch_of(c)).cast("long") + zone_hours * 3600
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    s = F.pmod(seconds, F.lit(86400))
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    if pattern == "day":
        return day.cast("string")
    return F.when(s.isNotNull(), F.concat_ws(":", part(F.floor(s / 3600)), part(F.pmod(F.floor(s / 60), F.lit(60))), part(F.pmod(s, F.lit(60)))))


def is_uuid(c: Column) -> Column:
    """32 hexadecimal digits, with or without hyphens, braces and a urn prefix."""
    bare = F.regexp_replace(F.replace(F.replace(c, F.lit("urn:")), F.lit("uuid:")), r"^[{}]+|[{}]+$", "")
    return F.replace(bare, F.lit("-")).rlike("^[0-9a-fA-F]{32}$")
