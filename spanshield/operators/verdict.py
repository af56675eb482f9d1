"""False-positive filter around an external judge.

The judge itself is outside Spark; these operators build its requests (deduplicated by hash = the
reference's cache key), parse its answers, and apply the verdicts with the reference's fail-open
rules. A message's detections lie in its row, so contexts, item numbers and prompts are computed
there: no body is shuffled, and only prompt hashes meet the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanshield.functions.spans import explode_spans, let, utf8_prefix_bytes

# Prompt text, labels and limits of the judge protocol.
PROMPT_HEADER = (
    "Task: classify each item as REAL personal data (1) or false positive (0).\n"
    "REAL (1): actual names of real people, real company names, real email addresses, real phone numbers.\n"
    "FALSE (0): code identifiers, variable names, function names, URLs, paths, example/placeholder data, generic words.\n\n"
)
PROMPT_FOOTER = "\nAnswer with ONLY comma-separated 1 or 0. Example: 1,0,1"
LABELS = {"PII_FIO": "PERSON_NAME", "PII_COMPANY": "COMPANY_NAME", "PII_EMAIL": "EMAIL", "PII_PHONE": "PHONE"}
MAX_ITEMS = 10
REFERENCE_PACK = 1024
CONTEXT_RADIUS_BYTES = 50
DETECTED = "[DETECTED]"
NO_CONTEXT = "[context unavailable]"


def _utf8_suffix_bytes(s: Column, max_bytes: int) -> Column:
    """Longest suffix of ``s`` of at most ``max_bytes`` UTF-8 bytes (cut at a character boundary)."""
    tail = F.right(s, F.lit(max_bytes))
    return F.reverse(utf8_prefix_bytes(F.reverse(tail), max_bytes))


def context_around(body: Column, needle: Column, radius: int = CONTEXT_RADIUS_BYTES) -> Column:
    """``radius`` bytes each side of the needle's first occurrence, snapped inward to
    character boundaries, every occurrence of the needle replaced by ``[DETECTED]``."""
    pos = F.instr(body, needle)
    before = _utf8_suffix_bytes(F.substring(body, F.lit(1), pos - 1), radius)
    after = utf8_prefix_bytes(F.substring(body, pos + F.length(needle), F.lit(2147483647)), radius)
    snippet = F.concat(before, needle, after)
    return F.when(pos > 0, F.replace(snippet, needle, F.lit(DETECTED))).otherwise(F.lit(NO_CONTEXT))


def label_of(vtype: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None))
    for t, lbl in LABELS.items():
        expr = expr.when(vtype == t, F.lit(lbl))
    return expr.otherwise(F.lit("OTHER"))


def contexts(body: Column, dets: Column) -> Column:
    """B14 in the row: each detection with the field ``context``."""
    return F.transform(dets, lambda d: d.withField("context", context_around(body, d["text"])))


def prompts(body: Column, dets: Column) -> Column:
    """A message's prompts, ``array<struct<part, n_items, prompt, ords>>``: its non-secret detections in
    order, at most ``MAX_ITEMS`` a prompt, each item with its context; ``ords`` are the items' places
    among all detections."""
    numbered = F.transform(dets, lambda d, i: F.struct(i.alias("ord"), d["type"].alias("type"), d["text"].alias("text")))
    pii = F.filter(numbered, lambda d: d["type"] != "SECRET")

    def line(x, i):
        return F.concat((i + 1).cast("string"), F.lit(". ["), label_of(x["type"]), F.lit("] \""), x["text"],
                        F.lit("\" — context: "), context_around(body, x["text"]), F.lit("\n"))

    def prompt(items, part):
        text = F.concat(F.lit(PROMPT_HEADER), F.array_join(F.transform(items, line), ""), F.lit(PROMPT_FOOTER))
        return F.struct(part.alias("part"), F.size(items).cast("long").alias("n_items"), text.alias("prompt"),
                        F.transform(items, lambda x: x["ord"]).alias("ords"))

    # an empty list has one empty part, which is dropped
    parts = let(pii, lambda a: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / MAX_ITEMS).cast("int")),
        lambda p: prompt(F.slice(a, p * MAX_ITEMS + 1, F.lit(MAX_ITEMS)), p)))
    return F.filter(parts, lambda p: p["n_items"] > 0)


def build_verdict_requests(messages: DataFrame, id_col: str = "msg_id", body_col: str = "body",
                           det_col: str = "detections") -> DataFrame:
    """Prompts of 1..10 PII items per message, as many as its items need, so that every item is
    judged; ``prompt_hash`` = SHA-256 of the prompt, ``ords`` = the items' ordinals. Nothing is shuffled."""
    p = messages.select(id_col, prompts(F.col(body_col), F.col(det_col)).alias("_p"))
    ex = explode_spans(p, "_p", [id_col]).select(id_col, "_e.part", "_e.n_items", "_e.prompt", "_e.ords")
    return ex.withColumn("prompt_hash", F.sha2("prompt", 256))


def distinct_requests(requests: DataFrame) -> DataFrame:
    """The judge is called once per distinct prompt (the reference's cache)."""
    return requests.select("prompt_hash", "prompt", "n_items").dropDuplicates(["prompt_hash"])


def parse_verdicts(responses: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``(prompt_hash, item, keep)``; unusable answers yield no rows (-> fail-open)."""
    first = F.substring(F.regexp_replace(F.col(raw_col), "^[\\p{javaWhitespace}\\x{85}\\x{A0}]+", ""), 1, 1)
    cleaned = F.regexp_replace(F.col(raw_col), "[^0-9,\\n ]", "")
    parts = F.filter(F.split(cleaned, "[,\\n ]", -1), lambda t: F.trim(t).isin("0", "1"))
    ok = first.isin("0", "1", "[", "{")
    v = responses.select("prompt_hash", F.when(ok, parts).otherwise(F.array().cast("array<string>")).alias("v"))
    return v.select("prompt_hash", F.posexplode_outer("v").alias("pos", "t")).where(F.col("t").isNotNull()) \
        .select("prompt_hash", (F.col("pos") + 1).alias("item"), (F.trim("t") == "1").alias("keep"))


def rejected(requests: DataFrame, verdicts: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """``(id, ord)`` of the detections that the judge answered 0 to: the requests' hashes and ordinals
    meet the answers, nothing else moves. A missing verdict (error, short answer) rejects nothing;
    extra verdicts are ignored."""
    no = verdicts.where(~F.col("keep")).select("prompt_hash", "item").distinct()
    items = requests.select(id_col, "prompt_hash", F.posexplode("ords").alias("item", "ord")).withColumn("item", F.col("item") + 1)
    return items.join(no, ["prompt_hash", "item"], "left_semi").select(id_col, "ord")


def apply_verdicts(dets: DataFrame, requests: DataFrame, verdicts: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Detection rows (``id``, ``ord``, ...) with ``keep``. Secrets are never asked about, so never
    dropped."""
    no = rejected(requests, verdicts, id_col).withColumn("_no", F.lit(True))
    return dets.join(no, [id_col, "ord"], "left").select(*dets.columns, F.col("_no").isNull().alias("keep"))


def label_centroids(vectors: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Reference set for E4 built from labelled vectors: one element-wise mean vector per label.

    Its size is the number of labels (bounded), whatever the number of vectors.
    """
    ex = vectors.select(label_col, F.posexplode(vec_col).alias("pos", "x"))
    per = ex.groupBy(label_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))


def embedding_flags(vectors: DataFrame, reference: DataFrame, threshold: float = 0.65,
                    vec_col: str = "embedding", id_col: str = "vec_id", ref_col: str = "centroid", packs: int = 1) -> DataFrame:
    """E4 (design-only in the reference): max cosine similarity against a small reference set;
    rows at or above ``threshold`` go to the second tier.

    The reference set is dealt by hash into ``packs`` rows, about ``REFERENCE_PACK`` vectors each if the
    caller, who knows the set, gives a pack for as many. A vector row meets every pack and compares
    inside the row; no pair rows are emitted, nothing runs while the plan is built, and Spark picks the
    join by the packs' actual size.
    """
    def norm(c):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))

    packed = reference.select(F.col(ref_col).alias("r")).groupBy(F.pmod(F.xxhash64("r"), F.lit(packs)).alias("_k")).agg(
        F.collect_list(F.struct(F.col("r"), norm(F.col("r")).alias("nr"))).alias("refs"))
    v = vectors.select(id_col, F.transform(vec_col, lambda x: x.cast("double")).alias("v")) \
        .withColumn("nv", norm(F.col("v")))
    every = F.lit(0).cast("long") if packs == 1 else F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))
    j = v.withColumn("_k", every).join(packed, "_k")
    cos = F.transform("refs", lambda r: F.aggregate(F.zip_with("v", r["r"], lambda a, b: a * b), F.lit(0.0),
                                                     lambda acc, x: acc + x) / (F.col("nv") * r["nr"]))
    best = j.select(id_col, F.array_max(cos).alias("max_cos"))
    if packs > 1:
        best = best.groupBy(id_col).agg(F.max("max_cos").alias("max_cos"))
    return best \
        .withColumn("flagged", F.col("max_cos") >= F.lit(threshold))
