"""DuckDB SQL building blocks for the oracle side of the correctness check.

The oracle deliberately uses a *different* method from the Spark code: match positions come from
window-free list sums over ``regexp_split_to_array`` pieces, overlap resolution is a chain of
``NOT EXISTS`` anti-joins per priority layer, and the byte look-back is computed on characters.
Patterns are the RE2 spellings of ``spanshield.patterns`` (RE2 has no ``(?U)``; its ``\\b`` is
ASCII, the one documented deviation).
"""

from __future__ import annotations

from spanshield import patterns as P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    pattern = pattern.replace("(?iu)(?=[abpst])", "(?iu)")  # the look-ahead is a Java speed-up only
    return pattern.replace("(?iu)", "(?i)").replace("(?iU)", "(?i)").replace("(?U)", "")


def ascii_ci(word: str) -> str:
    out = []
    for ch in word:
        out.append(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ("\\-" if ch == "-" else ch))
    return "".join(out)


SECRET_PREFIX_RE2 = "(?:" + "|".join(ascii_ci(p) for p in P.SECRET_PREFIXES) + ")"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def spans_cte(src: str, pattern: str) -> str:
    """SELECT id, start, "end", text over all matches of ``pattern`` in ``src(id, text)``."""
    p = q(pattern)
    return f"""(SELECT id, start, start + length(mt) AS "end", mt AS text FROM (
      SELECT id, m[i] AS mt,
        CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
      FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT id, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g
        FROM {src} WHERE text IS NOT NULL AND regexp_matches(text, {p})))))"""


# --- masks (SQL text over a column expression) --------------------------------------------------
def mask_secret(s: str) -> str:
    k = f"length(regexp_extract({s}, '^[^:-]*'))"
    keep = f"(CASE WHEN {k} < length({s}) THEN {k} + 1 ELSE 1 END)"
    prefix = f"left({s}, {keep})"
    rest = f"substring({s}, {keep} + 1)"
    return (f"(CASE WHEN length({s}) <= 4 THEN '***' WHEN strlen({rest}) <= 8 THEN {prefix} || '***' "
            f"ELSE {prefix} || left({rest}, 4) || '***-' || right({rest}, 4) END)")


def mask_secret_kv(s: str) -> str:
    k = f"length(regexp_extract({s}, '^[^=:]*'))"
    val = f"trim(substring({s}, {k} + 2), '\"'' ')"
    return f"(CASE WHEN {k} < length({s}) THEN left({s}, {k} + 1) || {mask_secret(val)} ELSE {mask_secret(s)} END)"


def mask_fio(s: str) -> str:
    words = f"list_filter(regexp_split_to_array({s}, {q(P.WS + '+')}), lambda w: length(w) > 0)"
    return (f"(CASE WHEN len({words}) = 0 THEN '***' ELSE array_to_string(list_transform({words}, "
            f"lambda w, i: CASE WHEN i = 1 THEN w ELSE left(w, 1) || '***' END), ' ') END)")


def mask_email(s: str) -> str:
    local = f"split_part({s}, '@', 1)"
    domain = f"substring({s}, length({local}) + 2)"
    tld = f"('.' || split_part({domain}, '.', -1))"
    dom = f"left({domain}, length({domain}) - length({tld}))"
    ml = f"(CASE WHEN strlen({local}) <= 2 THEN '***' ELSE left({local}, 1) || '***' END)"
    md = f"(CASE WHEN strpos({domain}, '.') > 0 THEN left({dom}, 1) || '***' || {tld} ELSE left({domain}, 1) || '***' END)"
    return f"(CASE WHEN strpos({s}, '@') > 0 THEN {ml} || '@' || {md} ELSE '***@***' END)"


def mask_phone(s: str) -> str:
    digits = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    upto = f"length(regexp_extract({s}, {q('^[^' + P.WS_CHARS + '(\\-]*')}))"
    prefix = (f"(CASE WHEN left({digits}, 1) IN ('7', '8') THEN (CASE WHEN {upto} < length({s}) "
              f"THEN left({s}, {upto} + 1) ELSE left({s}, 2) END) ELSE '' END)")
    return f"(CASE WHEN length({digits}) >= 10 THEN {prefix} || '***-**-' || right({digits}, 4) ELSE '***' END)"


def valid_phone(s: str) -> str:
    digits = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    return (f"(length({digits}) = 11 AND left({digits}, 1) IN ('7', '8') AND (substring({digits}, 2, 1) = '9' "
            f"OR substring({digits}, 2, 3) IN ({', '.join(q(c) for c in dict.fromkeys(P.LANDLINE_CODES))})))")


def lookback(text: str, start: str) -> str:
    n = P.EMAIL_LOOKBACK_BYTES
    bc = f"substring({text}, greatest({start} - {n - 1}, 1), least({start}, {n}))"
    k = f"list_min(list_filter(range(0, {n + 1}), lambda k: strlen(substring({bc}, k + 1)) <= {n}))"
    tail = f"substring({bc}, {k} + 1)"
    return f"(CASE WHEN strlen({bc}) <= {n} THEN {bc} WHEN strlen({tail}) = {n} THEN {tail} ELSE '' END)"


IPV4_RE = "^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def service_address(email: str, text: str, start: str) -> str:
    before = lookback(text, start)
    return (f"(lower(split_part({email}, '@', 1)) IN ({', '.join(q(u) for u in P.SERVICE_USERS)}) "
            f"OR regexp_matches(split_part({email}, '@', 2), {q(IPV4_RE)}) "
            f"OR contains({before}, '://') OR ends_with({before}, 'ssh ') OR ends_with({before}, 'git@') "
            f"OR contains({before}, 'git clone '))")


def detector_ctes(src: str, names=None) -> dict[str, str]:
    """Candidate spans per detector (after each detector's own filter): id, start, end, type, text, masked."""
    names = names if names is not None else P.first_names()
    value_re = q(re2(P.SECRET_VALUE_RE))
    b1 = f"""(SELECT id, start, start + length(mt) AS "end", 'SECRET' AS type, mt AS text, {mask_secret('mt')} AS masked
      FROM (SELECT s.id, s.start, s.text || run AS mt,
                   run AS val
            FROM (SELECT p.*, substring(src.text, p."end" + 1) AS rest, regexp_extract(substring(src.text, p."end" + 1), {value_re}) AS run
                  FROM {spans_cte(src, SECRET_PREFIX_RE2)} p JOIN {src} src ON src.id = p.id) s)
      WHERE strlen(val) >= {P.SECRET_VALUE_MIN_BYTES})"""
    b2 = f"""(SELECT id, start, "end", 'SECRET' AS type, text, {mask_secret_kv('text')} AS masked FROM {spans_cte(src, re2(P.SECRET_KV_RE))})"""
    b3 = f"""(SELECT id, start, "end", 'SECRET' AS type, text, {mask_secret('text')} AS masked FROM {spans_cte(src, P.API_KEY_RE)})"""
    b4 = f"""(SELECT id, start, "end", 'PII_FIO' AS type, text, {mask_fio('text')} AS masked FROM {spans_cte(src, P.FIO_RE)}
      WHERE list_has_any(regexp_split_to_array(text, {q(P.WS + '+')})[1:2], {str_list(dict.fromkeys(names))}))"""
    b5 = f"""(SELECT e.id, e.start, e."end", 'PII_EMAIL' AS type, e.text, {mask_email('e.text')} AS masked
      FROM {spans_cte(src, re2(P.EMAIL_RE))} e JOIN {src} src ON src.id = e.id
      WHERE NOT {service_address('e.text', 'src.text', 'e.start')})"""
    b6 = f"""(SELECT id, start, "end", 'PII_PHONE' AS type, text, {mask_phone('text')} AS masked FROM {spans_cte(src, re2(P.PHONE_RE))}
      WHERE {valid_phone('text')})"""
    return {"b1": b1, "b2": b2, "b3": b3, "b4": b4, "b5": b5, "b6": b6}


def greedy_self(cte: str) -> str:
    """Spans of one detector that overlap no earlier span of the same detector."""
    return f"""(SELECT * FROM {cte} a WHERE NOT EXISTS (SELECT 1 FROM {cte} b WHERE b.id = a.id AND b.start < a.start
      AND b.start < a."end" AND b."end" > a.start))"""


def scan_sql(src: str, names=None) -> str:
    """Full scan: layered priority with anti-joins; columns id, ord, start, end, type, text, masked."""
    d = detector_ctes("src", names)
    layers = ["b1", "b2", "b3", "b4", "b5", "b6"]
    ctes = [f"src AS (SELECT * FROM {src})"]
    for name in layers:
        ctes.append(f"c_{name} AS {d[name] if name != 'b1' else greedy_self(d[name])}")
    ctes.append("l_b1 AS (SELECT * FROM c_b1)")
    for i, name in enumerate(layers[1:], start=1):
        prev = " UNION ALL ".join(f"SELECT id, start, \"end\" FROM l_{p}" for p in layers[:i])
        ctes.append(f"""l_{name} AS (SELECT * FROM c_{name} c WHERE NOT EXISTS (SELECT 1 FROM ({prev}) a
          WHERE a.id = c.id AND a.start < c."end" AND a."end" > c.start))""")
    union = " UNION ALL ".join(f"SELECT * FROM l_{n}" for n in layers)
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS INTEGER) AS ord, "
            f"CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", type, text, masked FROM ({union})")


def type_prefix(col: str) -> str:
    return "(CASE " + " ".join(f"WHEN {col} = {q(t)} THEN {q(p)}" for t, _, p in P.VIOLATION_TYPES) + " ELSE 'UNK' END)"


def rebuild_sql(src: str, spans: str, out: str = "out") -> str:
    """Rebuild text: ``src(id, text)``, ``spans(id, start, end, repl)`` sorted, non-overlapping."""
    return f"""(SELECT s.id, CASE WHEN a.id IS NULL THEN s.text ELSE a.body || substring(s.text, a.last_end + 1) END AS {out}
      FROM {src} s LEFT JOIN (
        SELECT r.id, string_agg(substring(s2.text, r.prev_end + 1, r.start - r.prev_end) || r.repl, '' ORDER BY r.start) AS body,
               max(r."end") AS last_end
        FROM (SELECT *, coalesce(lag("end") OVER (PARTITION BY id ORDER BY start), 0) AS prev_end FROM {spans}) r
        JOIN {src} s2 ON s2.id = r.id GROUP BY r.id) a ON a.id = s.id)"""


def tokens_sql(messages: str) -> str:
    """Detections of ``messages`` with session key and token core: msg_id, ord, start, end, type,
    text, masked, session_key, ts, core, hash."""
    src = f"(SELECT msg_id AS id, body AS text FROM {messages})"
    return f"""(SELECT sc.id AS msg_id, sc.ord, sc.start, sc."end", sc.type, sc.text, sc.masked, m.skey AS session_key, m.ts,
        {type_prefix('sc.type')} || '_' || left(sha256(sc.text || m.skey), {P.TOKEN_HEX_LEN}) AS core,
        sha256(sc.text || m.skey) AS hash
      FROM ({scan_sql(src)}) sc
      JOIN (SELECT msg_id, 'map:session:' || coalesce(user_id, 'anon') || ':' || host AS skey, ts FROM {messages}) m
        ON m.msg_id = sc.id)"""


TOKEN_CORE_RE2 = P.TOKEN_CORE_RE


def find_tokens_sql(src: str) -> str:
    """id, ord, start, end, token_text, core over ``src(id, text)``."""
    return f"""(SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS INTEGER) AS ord,
        start, "end", text AS token_text, regexp_extract(text, {q(TOKEN_CORE_RE2)}) AS core
      FROM {spans_cte(src, P.TOKEN_ANY_RE)})"""
