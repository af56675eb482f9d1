"""Detector patterns and dictionaries.

Java regex flavour (Spark). Rust-style Unicode classes are spelled out explicitly so the same
character sets hold without relying on engine flags:

* ``WS`` is the Unicode White_Space property (what ``char::is_whitespace`` and a Unicode ``\\s``
  accept).
* ``DIGIT`` is ``\\p{Nd}`` (a Unicode ``\\d``).
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

WS_CHARS = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WS = f"[{WS_CHARS}]"
DIGIT = "\\p{Nd}"

# ---------------------------------------------------------------------------------------------
# Must equal the reference's detector rules for identical results.
# ---------------------------------------------------------------------------------------------

# Secret prefixes, matched ASCII-case-insensitively anywhere in the text.
SECRET_PREFIXES = ["sk-", "pk-", "authorization:", "x-api-key:"]
# A prefix value stops at whitespace or one of these characters.
SECRET_VALUE_STOP = "\"',}"
# Minimum prefix-value length (bytes) and cut-off when no stop character follows (bytes).
SECRET_VALUE_MIN_BYTES = 16
SECRET_VALUE_MAX_BYTES = 64

# Key words of key = value secrets; the value needs at least 12 characters.
SECRET_KV_KEYS = ["api_key", "apikey", "api-key", "access_token", "access-token", "token",
                  "secret", "password", "bearer"]

# Violation types, their audit labels and token prefixes (type, label, token prefix).
VIOLATION_TYPES = [
    ("SECRET", "secret", "KEY"),
    ("PII_FIO", "pii_fio", "FIO"),
    ("PII_COMPANY", "pii_company", "ORG"),
    ("PII_EMAIL", "pii_email", "EML"),
    ("PII_PHONE", "pii_phone", "PHN"),
]

# Local parts of machine accounts; such e-mail addresses are not personal data.
SERVICE_USERS = [
    "root", "admin", "administrator", "www", "web", "mail", "smtp",
    "imap", "pop", "pop3", "postmaster", "postgres", "mysql", "redis",
    "mongodb", "node", "python", "java", "ruby", "php", "nginx", "apache",
    "daemon", "bin", "sys", "sysadmin", "operator", "sshd",
    "git", "gitlab", "jenkins", "build", "ci", "deploy",
    "ubuntu", "debian", "centos", "fedora", "alpine", "arch",
    "grafana", "prometheus", "elastic", "kibana", "logstash",
    "nobody", "ftp", "sftp", "ldap", "dns", "dhcp",
    "ai_proxy", "proxy", "gateway", "vault", "certbot", "acme",
]
# Look-back window before an e-mail match (bytes) for connection-string and ssh/git context.
EMAIL_LOOKBACK_BYTES = 60

# Three-digit landline area codes accepted for phone numbers (9xx mobile codes always pass).
LANDLINE_CODES = [
    "301", "302", "302", "309", "341", "342", "343", "345", "346", "347", "349", "350", "351",
    "352", "353", "354", "355", "356", "357", "358", "359", "365", "366", "367", "381", "382",
    "383", "384", "385", "387", "388", "390", "391", "394", "395", "398", "401", "411", "413",
    "415", "416", "421", "423", "424", "426", "427", "434", "435", "442", "475", "472", "473",
    "474", "481", "482", "483", "484", "485", "486", "487", "491", "492", "493", "494", "495",
    "496", "498", "499", "811", "812", "813", "814", "815", "816", "817", "818", "820", "821",
    "822", "823", "824", "826", "831", "833", "834", "835", "836", "841", "842", "843", "844",
    "845", "846", "847", "848", "849", "851", "852", "855", "861", "862", "863", "864", "865",
    "866", "867", "869", "871", "872", "873", "877", "878", "879", "881", "882", "884", "885",
    "886", "891", "892", "893", "896", "897",
]

# Legal forms for the (disabled by default) company detector.
COMPANY_FORMS = ["ООО", "ЗАО", "ОАО", "АО", "ИП", "ПАО", "НКО"]

# Token written forms: [CORE] (inner spaces allowed), q_CORE], ‹CORE›, the JSON-escaped
# spelling \\u2039CORE\\u203a, and bare CORE.
TOKEN_TYPES = ["KEY", "FIO", "ORG", "EML", "PHN"]
# New tokens carry TOKEN_HEX_LEN hex digits (64 bits: no collisions at any vault size in practice);
# the 6-digit form is still read, so replies that hold old tokens restore.
TOKEN_HEX_LEN = 16
LEGACY_HEX_LEN = 6
REDACTED = "[REDACTED]"
SESSION_KEY_FORMAT = "map:session:{user}:{domain}"
ANON_USER = "anon"

# ---------------------------------------------------------------------------------------------
# Patterns (Java syntax) built from the fixed values above.
# ---------------------------------------------------------------------------------------------

SECRET_PREFIX_RE = "(?i)(?:" + "|".join(p.replace("-", "\\-") for p in SECRET_PREFIXES) + ")"
SECRET_VALUE_RE = f"^[^{WS_CHARS}{SECRET_VALUE_STOP}]*"
# the look-ahead on the first letters only prunes start positions cheaply; it accepts every
# character any key word can start with under Unicode case folding
SECRET_PREFIX_VALUE_RE = SECRET_PREFIX_RE + SECRET_VALUE_RE[1:]
SECRET_KV_RE = ("(?iu)(?=[abpst])(?:" + "|".join(k.replace("-", "\\-") for k in SECRET_KV_KEYS) + ")"
                + f"{WS}*[:=]{WS}*[\"']?[a-zA-Z0-9_\\-.]{{12,}}")
API_KEY_RE = "(?:sk|pk)-(?:[a-zA-Z0-9]{20,}|[a-zA-Z0-9]{4,}-[a-zA-Z0-9]{16,})"
FIO_RE = f"[А-ЯЁ][а-яё]+{WS}+[А-ЯЁ][а-яё]+(?:{WS}+[А-ЯЁ][а-яё]+)?"
EMAIL_RE = "(?U)\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b"
COMPANY_RE = ("(?iU)\\b(?:" + "|".join(COMPANY_FORMS) + ")" + f"{WS}+[\"«]?[А-ЯЁA-Z][\\w{WS_CHARS}\\-.]{{1,40}}")
PHONE_RE = (f"(?:\\+7|8){WS}*\\(?{DIGIT}{{3}}\\)?{WS}*{DIGIT}{{3}}[{WS_CHARS}-]?{DIGIT}{{2}}"
            f"[{WS_CHARS}-]?{DIGIT}{{2}}")

TOKEN_CORE_RE = "(?:" + "|".join(TOKEN_TYPES) + f")_(?:[a-f0-9]{{{TOKEN_HEX_LEN}}}|[a-f0-9]{{{LEGACY_HEX_LEN}}})"
# One alternation over the five written forms; delimited forms come first so that at a given
# start the longest form wins (two forms never start at the same place with different cores).
TOKEN_ANY_RE = (f"\\[{WS}*{TOKEN_CORE_RE}{WS}*\\]"
                f"|q_{TOKEN_CORE_RE}\\]"
                f"|‹{TOKEN_CORE_RE}›"
                f"|\\\\u2039{TOKEN_CORE_RE}\\\\u203a"
                f"|{TOKEN_CORE_RE}")

TYPE_TO_PREFIX = {t: p for t, _, p in VIOLATION_TYPES}
TYPE_TO_LABEL = {t: lbl for t, lbl, _ in VIOLATION_TYPES}


@lru_cache(maxsize=None)
def first_names(path: str | None = None) -> tuple[str, ...]:
    """The first-name dictionary used by the name detector (one name per line).

    The list is a parameter: pass a path to use another dictionary. The default ships with the
    package (482 entries, 414 distinct).
    """
    if path is None:
        text = resources.files("spanshield.resources").joinpath("first_names.txt").read_text("utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            text = fh.read()
    return tuple(line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#"))


def python_regex(java_pattern: str) -> str:
    """The same pattern in Python ``re`` syntax (``\\x{HHHH}`` escapes rewritten)."""
    import re as _re
    return _re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: "\\u" + m.group(1).rjust(4, "0"), java_pattern)
