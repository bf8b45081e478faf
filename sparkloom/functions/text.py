"""Text functions as column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of secrets in command lines; a first group is kept, without one the whole match is replaced.
SECRET_PATTERNS = (
    r"(?i)(authorization:\s*(?:bearer|basic)\s+)[^\s'\"]+",
    r"(?i)((?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*)[^\s'\",;&]+",
    r"(?i)(--(?:password|token|secret|api-key)[ =])[^\s'\"]+",
    r"([a-z][a-z0-9+.-]*://[^\s:/@]+:)[^\s@/]+(?=@)",
)
#: Topics of a query and the words that show them, in order of precedence.
INTENTS = (
    ("security", ("security", "secret", "credential", "token", "auth")), ("tests", ("test", "pytest", "coverage")), ("database", ("database", "sql", "query", "schema")),
    ("api", ("api", "endpoint", "route", "http")), ("concurrency", ("lock", "thread", "async", "race")), ("architecture", ("architecture", "module", "design")), ("bug", ("bug", "error", "fix", "crash")),
)


def strip_ansi(text: Column) -> Column:
    """Without terminal escape sequences."""
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def compact(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def redact(text: Column) -> Column:
    """Values behind telling names, in headers, flags and addresses replaced by ***."""
    for p in SECRET_PATTERNS:
        text = F.regexp_replace(text, p, "$1***")
    return text


def normalize_query(text: Column) -> Column:
    """No NUL, forward slashes, white space collapsed, no punctuation at the ends."""
    t = F.regexp_replace(F.regexp_replace(text, "\x00", ""), r"\\", "/")
    return F.regexp_replace(compact(t), r"^[\s,;:!?.]+|[\s,;:!?.]+$", "")


def query_terms(text: Column, most: int = 24) -> Column:
    """Identifiers and their snake, kebab, dot and camel parts, in lower case, each once, ``most`` at most."""
    spread = F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    words = F.concat(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.regexp_extract_all(F.lower(spread), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), 1, most)


def query_class(text: Column) -> Column:
    """exact_symbol, file_path, natural_language or mixed."""
    one = ~F.trim(text).rlike(r"\s")
    path = r"[\w.-]+(?:/[\w.-]+)+|[\w-]+\.(?:py|js|ts|md|json|yaml|toml|sh)"
    symbol = r"[A-Za-z_]\w*(?:_\w+|[a-z][A-Z]\w*|\(\)|\.\w+|::\w+)"
    inside = text.rlike(rf"(?:^|\s)(?:{path}|{symbol})(?:\s|$)")
    return F.when(one & F.trim(text).rlike(f"^(?:{path})$"), "file_path").when(one & F.trim(text).rlike(f"^(?:{symbol})$"), "exact_symbol").when(~one & inside, "mixed").otherwise("natural_language")


def intent(text: Column) -> Column:
    """The first topic one of whose words stands in the text, else general."""
    out = None
    for name, words in INTENTS:
        hit = F.lower(text).rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def canonical_path(path: Column) -> Column:
    """Forward slashes, no empty or dot parts; null for absolute paths, drives, NUL or a way up."""
    p = F.regexp_replace(path, r"\\", "/")
    bad = p.rlike("^/|^[A-Za-z]:|\x00|(^|/)\\.\\.(/|$)")
    return F.when(~bad, F.array_join(F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")), "/"))


def path_tier(path: Column) -> Column:
    """0 for sources and configuration, 1 for documents, 2 for old or generated paths."""
    return F.when(path.rlike(r"(?i)(^|/)(archive|old|history|legacy)(/|$)"), 2).when(path.rlike(r"(?i)\.(md|rst|txt)$|(^|/)(docs|notes)/"), 1).otherwise(0)


def estimate_tokens(text: Column) -> Column:
    """A token for each 3.4 bytes, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.octet_length(text) / F.lit(3.4)))


def estimate_code_tokens(text: Column) -> Column:
    """The larger of the sum over pieces (a token for each 4 bytes of a word, one for a sign) and one for each 3.4 bytes."""
    pieces = F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0))
    each = F.aggregate(pieces, F.lit(0).cast("long"), lambda s, p: s + F.ceil(F.octet_length(p) / F.lit(4)))
    return F.greatest(F.lit(1).cast("long"), each, F.ceil(F.octet_length(text) / F.lit(3.4)))


def head_tail(text: Column, head: int, tail: int) -> Column:
    """The first and last lines, with a line in between that says how many are left out."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    cut = F.array(F.concat(F.lit("... "), n - head - tail, F.lit(" lines ...")))
    short = F.concat(F.slice(lines, 1, head), cut, F.slice(lines, n - tail + 1, tail))
    return F.when(n <= head + tail, text).otherwise(F.array_join(short, "\n"))


def cut_at_line(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut behind the last whole line (without its line end) where there is one."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), "\n")
    return F.when(F.length(text) <= most, text).when(F.instr(head, "\n") > 0, F.substring(head, F.lit(1), at)).otherwise(head)


def fingerprint(*labels: Column) -> Column:
    """16 hex digits of the digest of labels in lower case."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(c) for c in labels]), 256), 1, 16)


def hash_bucket(text: Column, of: int = 100) -> Column:
    """A whole number below ``of`` from the first 8 hex digits of the SHA-256 digest."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), F.lit(of))


def split_of(text: Column) -> Column:
    """train, calibration or test: 80, 10 and 10 of a hundred hash buckets."""
    b = hash_bucket(text)
    return F.when(b < 80, "train").when(b < 90, "calibration").otherwise("test")
