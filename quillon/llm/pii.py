"""Personal data and secrets in text (operator 1), in DataFrame operations only.

Regular expressions propose spans; checksums (Luhn for cards, modulo 97 for IBANs) and ranges confirm them; words before a
span, within `CONTEXT` characters and back to the previous match of its kind at most, adjust its score. Kinds email, ip,
card and phone are kept whenever they are confirmed. Kinds iban, ssn and secret come on top: an IBAN needs its checksum, an
ssn a context word that lifts its score to `REPORT_FROM`, a secret (access key, assigned password or token, head of a
private key) its form. Possessive quantifiers and look-behind keep matching linear and without recursion on very long runs
of digits or address characters; the matches are the leftmost ones that do not overlap.

Positions are code points, end exclusive: running sums of the lengths of matches and of the stretches between them, so a
text's time grows with its length and number of matches. Null text is empty text; an empty table gives no rows; rows keep
their number, also where ids repeat; spans with equal starts are in the order of KINDS; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

CONTEXT = 40
REPORT_FROM = 0.7
#: Kinds in the order of equal starts: pattern, score before context, context words (as a pattern over lower-cased text).
_ADDRESS = "A-Za-z0-9._%+-"
KINDS: dict[str, tuple[str, float, str]] = {
    "email": (rf"(?:(?<![{_ADDRESS}])|\G)[{_ADDRESS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write|reach"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|address|host|server"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "call|phone|tel|fax|mobile"),
    "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 0.8, "iban|account|bank"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social|security|insurance"),
    "secret": (
        r"AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|(?i:password|passwd|secret|token|api[_-]?key)[ \t]{0,4}[=:][ \t]{0,4}[\x22\x27]?[A-Za-z0-9+/_.-]{8,200}",
        0.9,
        "secret|private|credential|login",
    ),
}
#: Running sums are gathered in stretches of this length.
_STRETCH = 256
BASE = ("email", "ip", "card", "phone")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)
    n = F.length(d)

    def add(total: Column, k: Column) -> Column:
        v = F.substr(d, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + v - F.when(v > 9, 9).otherwise(0)

    return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _mod97(x: Column) -> Column:
    turned = F.concat(F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(4)))

    def add(rest: Column, k: Column) -> Column:
        c = F.ascii(F.substr(turned, k, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), add) == 1


def _confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    if kind == "iban":
        return _mod97(x)
    return F.lit(True)


def _running_sums(lengths: Column) -> Column:
    """Sums of the entries up to each one, gathered in short stretches: appending to one long array would copy it each time."""

    def add(state: Column, x: Column) -> Column:
        at = state["at"] + x
        now = F.concat(state["now"], F.array(at))
        full = F.size(state["now"]) >= _STRETCH - 1
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"), F.when(full, F.array().cast("array<int>")).otherwise(now).alias("now"), at.alias("at")
        )

    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("now"), F.lit(0).alias("at"))
    return F.aggregate(lengths, start, add, lambda s: F.flatten(F.concat(s["done"], F.array(s["now"]))))


def _spans(kind: str, order: int, matches: Column) -> Column:
    """Confirmed spans of one kind: array of (s, o, k, e, score). matches: array of (m, b, e), the match, the stretch before, the end."""
    _, score, words = KINDS[kind]
    none = F.array().cast("array<struct<s:int,o:int,k:string,e:int,score:double>>")

    def span(x: Column) -> Column:
        points = F.lit(score) + F.when(F.lower(F.right(x["b"], F.lit(CONTEXT))).rlike(words), 0.4).otherwise(0.0)
        return F.struct((x["e"] - F.length(x["m"])).alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("k"), x["e"].alias("e"), points.alias("score"))

    found = F.transform(F.filter(matches, lambda x: _confirmed(kind, x["m"])), span)
    return F.when(F.size(matches) == 0, none).otherwise(found if kind in BASE else F.filter(found, lambda x: x["score"] >= REPORT_FROM))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and spans, an array of (s, o, k, e, score) sorted by start, then kind as listed in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A text without the sign that every match of a kind holds is not searched for it.
    needs = {"email": F.contains(F.col("_t"), F.lit("@")), "phone": F.contains(F.col("_t"), F.lit("+"))}
    digit = F.col("_t").rlike("[0-9]")
    empty = F.array().cast("array<string>")
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    found = found.select("_id", "_t", digit.alias("_digit"))
    worth = {k: F.lit(True) if k in ("email", "secret") else F.col("_digit") for k in KINDS}
    found = found.select("_id", "_t", *(F.when(worth[k] & needs.get(k, F.lit(True)), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(empty).alias(f"_{k}") for k, (p, _, _) in KINDS.items()))
    some = lambda k: F.size(f"_{k}") > 0
    found = found.select("_id", *(f"_{k}" for k in KINDS), *(F.when(some(k), F.slice(F.split("_t", p, -1), F.lit(1),
        F.size(f"_{k}"))).otherwise(empty).alias(f"_{k}_b") for k, (p, _, _) in KINDS.items()))
    ends = lambda k: _running_sums(F.zip_with(f"_{k}", f"_{k}_b", lambda m, b: F.length(m) + F.length(b)))
    found = found.select("_id", *(x for k in KINDS for x in (f"_{k}", f"_{k}_b")), *(F.when(some(k), ends(k)).otherwise(F.array().cast("array<int>")).alias(f"_{k}_e") for k in KINDS))
    zipped = [F.arrays_zip(F.col(f"_{k}").alias("m"), F.col(f"_{k}_b").alias("b"), F.col(f"_{k}_e").alias("e")) for k in KINDS]
    parts = [_spans(k, i, z) for i, (k, z) in enumerate(zip(KINDS, zipped))]
    return found.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")
    counts = [F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    base = F.filter(spans, lambda s: s["o"] < len(BASE))
    return find_pii(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"),
        written(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def _oracle() -> str:
    """The plain patterns of the contract in DuckDB, whose engine knows no look-behind and needs none."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": KINDS["iban"][0],
        "ssn": KINDS["ssn"][0],
        "secret": KINDS["secret"][0],
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"length({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 "
        f"THEN CAST(substr(reverse({digits}), k, 1) AS INT) ELSE (2 * CAST(substr(reverse({digits}), k, 1) "
        f"AS INT)) // 10 + (2 * CAST(substr(reverse({digits}), k, 1) AS INT)) % 10 END)) % 10 = 0"
    )
    mod97 = (
        "list_reduce(list_prepend(0, list_transform(range(1, length(m) + 1), lambda k: ascii(substr(substr(m, 5) || substr(m, 1, 4), k, "
        "1)))), lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1"
    )
    ip = "len(list_filter(string_split(m, '.'), lambda o: length(ltrim(o, '0')) > 3 OR CAST('0' || right(o, 3) AS INT) > 255)) = 0"
    ok = {"ip": ip, "card": luhn, "phone": f"length({digits}) BETWEEN 10 AND 15", "iban": mod97, "email": "true", "ssn": "true", "secret": "true"}
    each = []
    for o, (k, p) in enumerate(plain.items()):
        score = f"{KINDS[k][1]} + CASE WHEN regexp_matches(lower(right(b, {CONTEXT})), '{KINDS[k][2]}') THEN 0.4 ELSE 0.0 END"
        more = "" if k in BASE else f" AND {score} >= {REPORT_FROM}"
        each.append(f"""SELECT doc_id, {o} AS o, '{k}' AS k, s, s + length(m) AS e, {score} AS score FROM (
          SELECT doc_id, parts[i] AS b, ms[i] AS m, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
          FROM (SELECT doc_id, t, ms, parts, unnest(range(1, len(ms) + 1)) AS i
                FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS parts FROM d))
        ) WHERE {ok[k]}{more}""")
    union = " UNION ALL ".join(each)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, o, k, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, score, k || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS w FROM ({union})),
    g AS (SELECT doc_id, count(*) FILTER (k = 'email') AS n_email, count(*) FILTER (k = 'ip') AS n_ip, count(*) FILTER (k = 'card') AS n_card, count(*) FILTER (k = 'phone') AS n_phone,
      string_agg(w, ',' ORDER BY s, o) FILTER (o < 4) AS b, string_agg(w, ',' ORDER BY s, o) AS a, count(*) AS n_spans FROM f GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
      sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_spans, 0) AS n_spans
    FROM d LEFT JOIN g USING (doc_id)"""


ORACLE = _oracle()
