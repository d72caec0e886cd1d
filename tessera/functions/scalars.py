"""Column functions: identifiers, coercion, secrets, schedules. All are built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secret-like strings, each matched from the start of a trimmed value; the sixth in any case.
SECRET_PATTERNS = (
    r"^[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+$",
    r"-----BEGIN [A-Z ]+-----",
    r"^AKIA[0-9A-Z]{16}$",
    r"^AIza[0-9A-Za-z\-_]{35}$",
    r"^xox[baprs]-[0-9A-Za-z\-]+",
    r"^Bearer\s+[A-Za-z0-9\-_\.=]{20,}$",
    r"^[A-Za-z0-9\+\/=]{24,}$",
)
ANY_CASE = SECRET_PATTERNS[5]
SECRET_MIN_CHARS = 20
SECRET_MIN_ENTROPY = 3.2

#: All characters that count as white space at the ends of a text.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

#: What Python's float() accepts: digits, also grouped by underscores, with optional fraction and exponent, inf and nan.
_DIGITS = r"\d+(?:_\d+)*"
FLOAT_TEXT = rf"^[+-]?((({_DIGITS})(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE))


def stable_id(*parts: Column | str) -> Column:
    """A content id: SHA-256 over the parts as a JSON array of texts and nulls, so different parts never read alike."""
    return F.sha2(F.to_json(F.array(*[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])), 256)


def coerce_float(text: Column | str) -> Column:
    """Number in a text, or null: lists, words (true and false among them) and type suffixes are not numbers."""
    t = stripped(F.col(text) if isinstance(text, str) else text)
    return F.when(t.rlike(FLOAT_TEXT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def entropy(text: Column | str) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text.

    The sorted characters are passed once: a run of c equal ones adds c * log2(c), and the entropy of n characters is
    log2(n) less the sum over n.
    """
    t = F.col(text) if isinstance(text, str) else text
    n = F.length(t).cast("double")
    letters = F.array_sort(F.filter(F.split(t, ""), lambda c: c != ""))
    weight = lambda c: c * F.log2(F.greatest(c, F.lit(1.0)))
    state = lambda last, run, total: F.struct(last.alias("last"), run.alias("run"), total.alias("total"))
    start = state(F.lit(""), F.lit(0.0), F.lit(0.0))
    step = lambda acc, c: F.when(acc["last"] == c, state(c, acc["run"] + 1.0, acc["total"])).otherwise(state(c, F.lit(1.0), acc["total"] + weight(acc["run"])))
    runs = F.aggregate(letters, start, step, lambda acc: acc["total"] + weight(acc["run"]))
    return F.when(n == 0, F.lit(0.0)).when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - runs / n))


def is_sensitive(text: Column | str) -> Column:
    """Secret-like: at least 20 characters after trimming, and a known pattern or high entropy. Null is not.

    The length is tested before any pattern, the patterns before the entropy.
    """
    t = stripped(F.col(text) if isinstance(text, str) else text)
    known = F.lit(False)
    for p in SECRET_PATTERNS:
        known = known | t.rlike(("(?i)" if p == ANY_CASE else "") + ("" if p.startswith("^") else "^") + p)
    judged = F.when(F.length(t) < SECRET_MIN_CHARS, F.lit(False)).when(known, F.lit(True)).otherwise(entropy(t) >= SECRET_MIN_ENTROPY)
    return F.coalesce(judged, F.lit(False))


def is_sensitive_bytes(raw: Column | str) -> Column:
    """Bytes: 20 or more are secret-like at once, fewer are judged as text."""
    b = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.when(F.octet_length(b) >= SECRET_MIN_CHARS, F.lit(True)).otherwise(is_sensitive(F.decode(b, "UTF-8"))), F.lit(False))


def within_bytes(text: Column | str, limit: int) -> Column:
    return F.octet_length(text) <= limit


def backoff_ms(attempts: Column | str, least: int = 250, most: int = 60_000) -> Column:
    """Exponential backoff: 100 ms doubled for every attempt, held between least and most. No jitter."""
    a = F.col(attempts) if isinstance(attempts, str) else attempts
    return F.least(F.lit(most), F.greatest(F.lit(least), (F.pow(F.lit(2.0), F.least(a, F.lit(40))) * 100).cast("long"))).cast("long")


def jittered_ms(delay: Column, share: float = 0.2, seed: int = 0) -> Column:
    """delay spread evenly by up to share in either direction; reproducible for a seed and partitioning."""
    return F.greatest(F.lit(0), F.round(delay * (1 + (F.rand(seed) * 2 - 1) * share))).cast("long")


def one_of(value: Column | str, allowed: list[str]) -> Column:
    """The value if it is allowed, else null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isin(*allowed), v)


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp's wall clock; the session's time zone plays no part for zone-less ones."""
    t = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(t).cast("long") * 3600 + F.minute(t) * 60
    return ((days * 86400 + clock) * 1000 + F.floor(F.extract(F.lit("SECOND"), t) * 1000)).cast("long")


def iso_ms(ms: Column | str) -> Column:
    """Milliseconds since 1970 as ISO 8601 in UTC, with milliseconds."""
    m = F.col(ms) if isinstance(ms, str) else ms
    day, clock = F.floor(m / 86_400_000).cast("int"), F.pmod(m, F.lit(86_400_000))
    two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
    time = F.concat(two(clock / 3_600_000), F.lit(":"), two(F.pmod(clock, F.lit(3_600_000)) / 60_000), F.lit(":"), two(F.pmod(clock, F.lit(60_000)) / 1000), F.lit("."), F.lpad(F.pmod(clock, F.lit(1000)).cast("string"), 3, "0"))
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd"), F.lit("T"), time, F.lit("Z"))


def time_bucket(ms: Column, seconds: int) -> Column:
    return F.floor(ms / (seconds * 1000)).cast("long")


def elapsed_ms(now: Column | int, then: Column) -> Column:
    """Time since then, never negative."""
    n = F.lit(now) if isinstance(now, int) else now
    return F.greatest(F.lit(0).cast("long"), n - then)


def topic(kind: str, step_type: Column | str) -> Column:
    return F.format_string(f"{kind}.%s.v1", step_type)


def required_count(fan_in: Column, size: Column) -> Column:
    """n of 'count:n', whatever its sign; all dependencies where n is no whole number."""
    n = F.regexp_extract(F.lower(fan_in), r"^count:\s*([+-]?\d+(?:_\d+)*)\s*$", 1)
    return F.coalesce(F.replace(n, F.lit("_"), F.lit("")).try_cast("int"), size)
