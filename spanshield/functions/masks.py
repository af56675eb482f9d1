"""Masked forms of detected values (Column -> Column, built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanshield.patterns import WS, WS_CHARS

STARS = "***"


def mask_secret(s: Column) -> Column:
    """``sk-abcdefgh12345678`` -> ``sk-abcd***-5678``.

    Up to 4 characters -> ``***``. The kept prefix runs through the first ``-`` or ``:`` (else the
    first character); a rest of at most 8 bytes -> prefix + ``***``; else prefix + first 4 +
    ``***-`` + last 4 characters of the rest.
    """
    before_sep = F.length(F.regexp_extract(s, "^[^:-]*", 0))
    has_sep = before_sep < F.length(s)
    keep = F.when(has_sep, before_sep + 1).otherwise(F.lit(1))
    prefix = F.substring(s, 1, keep)
    rest = F.substring(s, keep + 1, 2147483647)
    long_form = F.concat(prefix, F.substring(rest, 1, 4), F.lit(STARS + "-"), F.right(rest, F.lit(4)))
    return (F.when(F.length(s) <= 4, F.lit(STARS))
            .when(F.octet_length(rest) <= 8, F.concat(prefix, F.lit(STARS)))
            .otherwise(long_form))


def mask_secret_kv(s: Column) -> Column:
    """``api_key=abcdefghijklmnop`` -> ``api_key=abcd***-mnop`` (key kept, value via mask_secret)."""
    before_sep = F.length(F.regexp_extract(s, "^[^=:]*", 0))
    has_sep = before_sep < F.length(s)
    key = F.substring(s, 1, before_sep + 1)
    value = F.btrim(F.substring(s, before_sep + 2, 2147483647), F.lit("\"' "))
    return F.when(has_sep, F.concat(key, mask_secret(value))).otherwise(mask_secret(s))


def mask_fio(s: Column) -> Column:
    """``Иван Иванов`` -> ``Иван И***``: first word kept, later words reduced to an initial."""
    words = F.filter(F.split(s, f"{WS}+", -1), lambda w: F.length(w) > 0)
    masked = F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.left(w, F.lit(1)), F.lit(STARS))))
    return F.when(F.size(words) == 0, F.lit(STARS)).otherwise(F.array_join(masked, " "))


def mask_email(s: Column) -> Column:
    """``user@company.com`` -> ``u***@c***.com``; a local part of at most 2 bytes -> ``***``."""
    local = F.substring_index(s, "@", 1)
    domain = F.substring(s, F.length(local) + 2, 2147483647)
    has_dot = F.instr(domain, ".") > 0
    tld = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    dom = F.left(domain, F.length(domain) - F.length(tld))
    masked_local = F.when(F.octet_length(local) <= 2, F.lit(STARS)).otherwise(F.concat(F.left(local, F.lit(1)), F.lit(STARS)))
    masked_domain = F.when(has_dot, F.concat(F.left(dom, F.lit(1)), F.lit(STARS), tld)) \
        .otherwise(F.concat(F.left(domain, F.lit(1)), F.lit(STARS)))
    return F.when(F.instr(s, "@") > 0, F.concat(masked_local, F.lit("@"), masked_domain)).otherwise(F.lit("***@***"))


def mask_phone(s: Column) -> Column:
    """``+7 999 123-45-67`` -> ``+7 ***-**-4567``.

    Kept prefix: through the first whitespace, ``(`` or ``-`` (else the first 2 characters), only
    when the digits start with 7 or 8. Fewer than 10 ASCII digits -> ``***``.
    """
    digits = F.regexp_replace(s, "[^0-9]", "")
    upto = F.length(F.regexp_extract(s, f"^[^{WS_CHARS}(\\-]*", 0))
    has_sep = upto < F.length(s)
    prefix = F.when(F.substring(digits, 1, 1).isin("7", "8"),
                    F.when(has_sep, F.substring(s, 1, upto + 1)).otherwise(F.left(s, F.lit(2)))).otherwise(F.lit(""))
    return F.when(F.length(digits) >= 10, F.concat(prefix, F.lit(STARS + "-**-"), F.right(digits, F.lit(4)))) \
        .otherwise(F.lit(STARS))


def mask_company(s: Column) -> Column:
    """``ООО «Ромашка»`` -> ``ООО «Р***``; without a separator the first 4 characters + ``***``."""
    legal = F.regexp_extract(s, "^[^ \"«]*", 0)
    has_sep = F.length(legal) < F.length(s)
    after = F.substring(s, F.length(legal) + 2, 2147483647)
    name = F.btrim(after, F.lit("\"«»"))
    quote = F.when(F.startswith(after, F.lit("\"")), F.lit("\"")).when(F.startswith(after, F.lit("«")), F.lit("«")).otherwise(F.lit(""))
    first = F.coalesce(F.nullif(F.left(name, F.lit(1)), F.lit("")), F.lit("*"))
    return F.when(has_sep, F.concat(legal, F.lit(" "), quote, first, F.lit(STARS))) \
        .otherwise(F.concat(F.left(s, F.lit(4)), F.lit(STARS)))


def mask_for_type(vtype: str, s: Column) -> Column:
    return {
        "SECRET": mask_secret,
        "SECRET_KV": mask_secret_kv,
        "PII_FIO": mask_fio,
        "PII_EMAIL": mask_email,
        "PII_PHONE": mask_phone,
        "PII_COMPANY": mask_company,
    }[vtype](s)
