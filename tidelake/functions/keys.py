"""Deterministic keys, pseudonyms and text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelake.functions.scalar import utc_text

# The pseudonym scheme. Changing one changes every token.
PSEUDONYM_NAMESPACE = "synthetic-customer-contact-v1"
EMAIL_DOMAIN = "synthetic-example.com"
PHONE_PREFIX = "+3538"
PHONE_MODULUS = 10_000_000_000
CONSENT_SCALE = 10_000
CONSENT_THRESHOLD = 7_500

# Text patterns. An e-mail address is
#   \b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b
# written so that each run of local characters is read once: a match may start at any word
# boundary of the run, so it is enough that the run starts at one or has one inside.
# A phone number has at least eight digits, each optionally led by a plus sign, with
# blanks, brackets, dots or dashes between them. A run that is cut off by a further digit
# can always be widened to include it, so "eight in a row somewhere" is the whole test.
EMAIL_PATTERN = (
    r"(?U)(?<![A-Za-z0-9._%+-])"
    r"(?:\b|(?=[A-Za-z0-9_]++[.%+-]|[.%+-]++[A-Za-z0-9_]))"
    r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
)
PHONE_PATTERN = r"(?U)\d(?:[\s().-]*+\+?+\d){7}"
STATE_PATTERN = r"^(?:[A-Z]{2}|UNKNOWN)$"
SENSITIVE_NAME_PATTERN = "email|phone|address|zip_code|postal|consent"


def _text(part: Column | str) -> Column:
    return (F.col(part) if isinstance(part, str) else part).cast("string")


def record_key(*parts: Column | str) -> Column:
    """SHA-256 (lower hex) of the parts joined by a pipe, NULL as empty text."""
    texts = [F.coalesce(_text(part), F.lit("")) for part in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def review_key(review_id, order_id, created, answered, occurrence) -> Column:
    return record_key(review_id, order_id, utc_text(created), utc_text(answered), occurrence)


def composite_key(*parts: Column | str) -> Column:
    """Parts joined by a pipe; NULL if any part is NULL."""
    texts: list[Column] = []
    for part in parts:
        if texts:
            texts.append(F.lit("|"))
        texts.append(_text(part))
    return F.concat(*texts)


def _digest(purpose: str, entity: Column | str) -> Column:
    return F.sha2(
        F.concat_ws("|", F.lit(PSEUDONYM_NAMESPACE), F.lit(purpose), _text(entity)), 256
    )


def _leading_integer(digest: Column) -> Column:
    """First eight digest bytes as an unsigned big-endian integer."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def pseudonym_email(entity: Column | str) -> Column:
    return F.concat(F.substring(_digest("email", entity), 1, 24), F.lit("@" + EMAIL_DOMAIN))


def pseudonym_phone(entity: Column | str) -> Column:
    number = (_leading_integer(_digest("phone", entity)) % F.lit(PHONE_MODULUS)).cast("bigint")
    return F.concat(F.lit(PHONE_PREFIX), F.lpad(number.cast("string"), 10, "0"))


def pseudonym_consent(entity: Column | str) -> Column:
    bucket = _leading_integer(_digest("marketing-consent", entity)) % F.lit(CONSENT_SCALE)
    return bucket < F.lit(CONSENT_THRESHOLD)


def looks_like_email(text: Column | str) -> Column:
    value = _text(text)
    return F.contains(value, F.lit("@")) & F.regexp_like(value, F.lit(EMAIL_PATTERN))


def looks_like_phone(text: Column | str) -> Column:
    return F.regexp_like(_text(text), F.lit(PHONE_PATTERN))


def is_state_code(text: Column | str) -> Column:
    return F.regexp_like(_text(text), F.lit(STATE_PATTERN))
