"""Text features, redaction and parsing as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rule names, patterns, replacements and word lists that results depend on.
REDACTION_RULES: tuple[tuple[str, str], ...] = (
    (
        "ADDRESS",
        r"\b\d{1,6}\s+[A-Z0-9][A-Z0-9\s.-]{2,}\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way|Circle|Cir)\b",
    ),
    (
        "CITY",
        r"\b(?:New\s+York|Brooklyn|Manhattan|Queens|Bronx|Staten\s+Island|Los\s+Angeles|Chicago|Houston|Phoenix|Philadelphia|San\s+Antonio|San\s+Diego|Dallas|San\s+Jose)\b",
    ),
    ("ZIP", r"\b\d{5}(?:-\d{4})?\b"),
    ("DATE_MDY", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("DATE_TEXT", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"),
    ("DATE_MMDDYY", r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-]\d{2,4}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("FAX", r"\b(?:fax|facsimile)[\s:]*(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("EMAIL", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("MRN_LABEL", r"\b(MRN|Medical\s*Record\s*#?|Med\s*Rec|Patient\s*ID|Record\s*Number)\b"),
    ("MRN_NUMBER", r"\b\d{6,10}\b"),
    ("HEALTH_PLAN", r"\b(?:member|policy|subscriber|beneficiary)\s*(?:id|#|number|no)[\s:]*[A-Z0-9]{6,}\b"),
    ("ACCOUNT", r"\b(?:account|acct)\s*(?:id|#|number|no)[\s:]*[A-Z0-9]{6,}\b"),
    ("CERTIFICATE", r"\b(?:certificate|license|permit)\s*(?:id|#|number|no)[\s:]*[A-Z0-9]{6,}\b"),
    ("VEHICLE", r"\b(?:VIN|vehicle\s*id|plate)[\s:]*[A-Z0-9]{6,}\b"),
    ("DEVICE", r"\b(?:device|serial|equipment)\s*(?:id|#|number|no)[\s:]*[A-Z0-9]{6,}\b"),
    ("URL", r"\bhttps?://\S+\b|\bwww\.\S+\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("UNIQUE_ID", r"\b[A-Z]{2,}\d{6,}\b"),
)
#: Pattern, replacement, whether case is ignored; applied in this order.
SIMPLE_RULES: tuple[tuple[str, str, bool], ...] = (
    (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[DATE]", False),
    (r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", "[DATE]", False),
    (r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b", "[DATE]", True),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b", "[TIME]", False),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]", False),
    (r"\(\d{3}\)\s*\d{3}[-.]?\d{4}\b", "[PHONE]", False),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]", False),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]", False),
    (r"\b(?:MRN|mrn|Medical Record Number)[\s:]*\d{6,10}\b", "[MRN]", True),
    (r"\b(?:age|aged)\s+(?:9\d|[1-9]\d{2,})\b", "age [>89]", True),
    (r"\b(?:9\d|[1-9]\d{2,})[\s-]year[\s-]old\b", "[>89]-year-old", True),
    (r"\b\d{5}(?:-\d{4})?\b", "[ZIP]", False),
)
CONTEXT_LABELS = (
    "name", "patient", "dob", "dateofbirth", "birth", "mrn", "acct", "account", "accession", "doctor", "physician", "surgeon", "provider", "initials",
    "id", "identifier", "number", "no", "ssn", "social",
)
AFTER_LABEL = 6
NEGATIONS = ("no", "not", "none", "negative", "absent", "without", "deny", "denied", "unremarkable", "normal", "benign")
UNCERTAIN = (
    "possible", "possibly", "probable", "probably", "suggest", "suggestive", "suspicious", "cannot exclude", "cannot rule out", "equivocal",
    "uncertain", "indeterminate", "likely", "unlikely", "may", "might",
)
NOT_REPORTED = ("not reported", "not stated", "not mentioned", "n/a", "none", "absent")
UNREADABLE = ("unclear", "illegible")
INTERPOLATIONS = {"MUSTACHE": "{{%s}}", "MUSTACHE_WITH_SPACE": "{{ %s }}", "FSTRING": "{%s}", "DOLLAR_BRACKETS": "${%s}", "JINJA": "{{ %s }}"}
# End of fixed values.


#: Rules whose every match has a digit, and a pattern that a text with a match of the others but CITY contains. What the rules
#: put in has neither, so a text without them need not be searched.
WITH_DIGIT = ("ADDRESS", "ZIP", "DATE_MDY", "DATE_TEXT", "DATE_MMDDYY", "PHONE", "FAX", "SSN", "MRN_NUMBER", "IP_ADDRESS", "UNIQUE_ID")
SIGNS = "@|https?:|www|mrn|rec|patient|member|policy|subscr|benef|account|acct|certif|licen|permit|vin|vehicle|plate|device|serial|equip"
#: White space, and an edge between a word of ASCII letters, digits and underscores and what is none: those of SQL.
_SPACE, _EDGE = r"\t\n\f\r ", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
#: The other letters that are S or K where case is ignored.
_FOLDED = {"s": "\u017f", "k": "\u212a"}

#: A text without these has the same matches in Java's engine as in SQL.
BEYOND = r"[^\x00-\x7F]|\x0B"


def as_in_sql(pattern: str, folded: bool = True) -> str:
    """A rule's pattern for Spark, with the matches that it has in SQL.

    To Java's engine letters beyond ASCII are part of a word when it looks for \\b, a vertical tab is white space, and ignored
    case has ASCII letters only.
    """
    out, at, in_class = "(?i)" if folded else "", 0, False
    while at < len(pattern):
        c, two = pattern[at], pattern[at : at + 2]
        if c == "\\":
            inside, outside = {r"\s": (_SPACE, f"[{_SPACE}]"), r"\S": (two, f"[^{_SPACE}]"), r"\b": (two, _EDGE)}.get(two, (two, two))
            out, at = out + (inside if in_class else outside), at + 2
            continue
        if c == "[" and not in_class or c == "]" and in_class:
            in_class = c == "["
            out += c
        elif folded and in_class and pattern[at : at + 3].lower() == "a-z":
            out, at = out + pattern[at : at + 3] + "".join(_FOLDED.values()), at + 2
        elif folded and c.lower() in _FOLDED:
            out += c + _FOLDED[c.lower()] if in_class else f"[{c}{_FOLDED[c.lower()]}]"
        else:
            out += c
        at += 1
    return out


def redact(text: Column, rules=REDACTION_RULES) -> Column:
    """Every match of each rule in turn becomes [NAME]; case is ignored. Rules that a text can't match are skipped."""

    def chain(some, spell) -> Column:
        out = text
        for name, pattern in some:
            out = F.regexp_replace(out, spell(pattern), f"[{name}]")
        return out

    def chosen(spell) -> Column:
        return F.when(text.rlike("[0-9]"), chain(rules, spell)).when(text.rlike(as_in_sql(SIGNS)), chain(wordy, spell)).otherwise(chain([r for r in wordy if r[0] == "CITY"], spell))

    wordy = [r for r in rules if r[0] not in WITH_DIGIT]
    return F.when(text.rlike(BEYOND), chosen(as_in_sql)).otherwise(chosen(lambda p: f"(?i){p}"))


def redact_simple(text: Column) -> Column:
    """Dates, times, phones, e-mail, SSN, record numbers, ages over 89 and ZIP codes replaced, in that order. NULL stays NULL."""

    def chain(spell) -> Column:
        out = text
        for pattern, new, folded in SIMPLE_RULES:
            out = F.regexp_replace(out, spell(pattern, folded), new.replace("$", r"\\$"))
        return out

    return F.when(text.rlike(BEYOND), chain(as_in_sql)).otherwise(chain(lambda p, folded: f"(?i){p}" if folded else p))


def redact_json(value: Column, kind: T.DataType) -> Column:
    """Every string inside a nested value redacted; field names and map keys stay."""
    if isinstance(kind, T.StringType):
        return redact_simple(value)
    if isinstance(kind, T.StructType):
        fields = F.struct(*(redact_json(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_json(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: redact_json(v, kind.valueType))
    return value


def rule_count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({as_in_sql(pattern)})"), F.lit(1)))


def spared(text: Column) -> Column:
    """The text with a sign for every character beyond ASCII, which spared_count() can search; NULL where it can't.

    A rule has as many matches in it as in the text itself, and its plain pattern, faster to search for, finds those of SQL.
    """
    return F.when(~text.rlike(r"[\x0B" + "".join(_FOLDED.values()) + "]"), F.regexp_replace(text, r"[^\x00-\x7F]", "\u00b6"))


def spared_count(spared: Column, text: Column, pattern: str) -> Column:
    """rule_count(), given spared(text)."""
    return F.when(spared.isNotNull(), F.size(F.regexp_extract_all(spared, F.lit(f"(?i)({pattern})"), F.lit(1)))).otherwise(rule_count(text, pattern))


def first_rule(token: Column, rules=REDACTION_RULES) -> Column:
    """Name of the first rule that the token has a match of, else NULL."""
    return F.coalesce(*(F.when(token.rlike(as_in_sql(p)), n) for n, p in rules))


def words(text: Column) -> Column:
    """Stretches without white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters, marks, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))


def basic_features(text: Column) -> dict[str, Column]:
    """Sizes of a text; all 0 where it is empty."""
    w = words(text)
    n = F.size(w)
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"[\t\n\r]", " ")) != ""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    total = F.length(F.array_join(w, ""))
    return {
        "n_chars": F.length(text),
        "n_words": n,
        "n_lines": F.when(F.length(text) > 0, lines).otherwise(0),
        "n_sentences": sentences,
        "avg_word_len": F.when(n > 0, F.round(total / n, 2)).otherwise(0.0),
        "n_numeric": F.size(F.filter(w, lambda x: x.rlike("^[0-9]+([.,][0-9]+)?$"))),
        "n_unique": F.size(F.array_distinct(F.transform(w, F.lower))),
        "lexical_diversity": F.when(n > 0, F.round(F.size(F.array_distinct(F.transform(w, F.lower))) / n, 4)).otherwise(0.0),
    }


def token_features(text: Column) -> dict[str, Column]:
    """Tokens, sentences, negations and phrases of uncertainty of a text; rates by token, 0 without tokens."""
    t = word_tokens(text)
    n = F.size(t)
    rate = lambda x, m: F.when(m > 0, F.round(x / m, 6)).otherwise(0.0)
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"[\t\n\r]", " ")) != ""))
    neg = F.size(F.filter(t, lambda x: x.isin(*NEGATIONS)))
    unsure = sum((F.contains(F.lower(text), F.lit(p)).cast("int") for p in UNCERTAIN), F.lit(0))
    return {
        "n_tokens": n,
        "n_unique": F.size(F.array_distinct(t)),
        "lexical_diversity": rate(F.size(F.array_distinct(t)), n),
        "avg_token_len": F.when(n > 0, F.round(F.length(F.array_join(t, "")) / n, 4)).otherwise(0.0),
        "n_sentences": sentences,
        "avg_sentence_len": rate(n, sentences),
        "n_negations": neg,
        "negation_rate": rate(neg, n),
        "n_uncertain": unsure,
        "uncertainty_rate": rate(unsure, n),
        "n_chars": F.length(text),
    }


def collapse(text: Column) -> Column:
    """Control characters dropped, stretches of white space made one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E\x0A\x0D\x09 -￿]", ""), r"[ \t\n\r]+", " "))


def case_id(key: Column) -> Column:
    return F.concat(F.lit("CASE_"), F.upper(F.substring(F.sha2(key, 256), 1, 12)))


def unfenced(text: Column) -> Column:
    """The contents of a ```json fence, or the text itself."""
    return F.regexp_replace(F.regexp_replace(text, "^[ \n]*```(json)?[ \n]*", ""), "[ \n]*```[ \n]*$", "")


def chunks(docs: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of `size` characters, each `overlap` into the one before: (id, chunk_no, chunk)."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text_col) - overlap) / step), F.lit(1)).cast("int")
    at = docs.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return at.select(id_col, "chunk_no", F.substring(F.col(text_col), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def after_labels(tokens: DataFrame, labels: tuple[str, ...], following: int, by: str, order: str) -> DataFrame:
    """Adds near_label: one of the `following` tokens before this one, in order, is a label."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-following, -1)
    is_label = F.col("token").isin(*labels).cast("int")
    return tokens.withColumn("near_label", F.coalesce(F.max(is_label).over(w), F.lit(0)) == 1)


def redaction_boxes(tokens: DataFrame, line: list[str], place: str, token: str = "token", following: int = AFTER_LABEL, broad_numbers: bool = False) -> DataFrame:
    """Boxes to redact: rows of tokens (with the columns `line` and `place`) and the rule that hits them.

    A token's first rule counts; bare record numbers only with broad_numbers. The `following` tokens after a label on its
    line are hit by CONTEXT_AFTER_LABEL, unless nothing is left of them once normalised. A box appears once for each rule.
    """
    norm = F.regexp_replace(F.lower(F.col(token)), "[^a-z0-9]+", "")
    w = Window.partitionBy(*line).orderBy(place).rowsBetween(-following, -1)
    near = F.coalesce(F.max(F.col("_norm").isin(*CONTEXT_LABELS).cast("int")).over(w), F.lit(0)) == 1
    t = tokens.withColumn("_norm", norm).withColumn("_near", near & (F.col("_norm") != ""))
    rules = F.array(first_rule(F.col(token)) if broad_numbers else first_rule_or_none(F.col(token)), F.when(F.col("_near"), "CONTEXT_AFTER_LABEL"))
    return t.withColumn("rule", F.explode(F.array_distinct(F.array_compact(rules)))).drop("_norm", "_near").distinct()


def first_rule_or_none(token: Column) -> Column:
    """Name of the first rule, NULL where that is the broad rule for numbers."""
    found = first_rule(token)
    return F.when(found != "MRN_NUMBER", found)


def parse_response(raw: Column) -> dict[str, Column]:
    """Whether a model's answer says that an element is present, and its value.

    The first {...} block counts if it is a JSON object: present unless all of its values are words for not reported.
    Otherwise such words, then words for unreadable, then any text decide.
    """
    raw = F.trim(raw)
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{[^{}]+\}", 0), "map<string,string>")
    values = F.transform(F.filter(F.map_values(parsed), lambda v: v.isNotNull()), lambda v: F.trim(v))
    is_json = parsed.isNotNull() & (F.size(F.coalesce(F.map_keys(parsed), F.array().cast("array<string>"))) > 0)
    low = F.lower(raw)
    said = lambda phrases: F.greatest(*(F.contains(low, F.lit(x)) for x in phrases))
    absent = said(NOT_REPORTED[:3])
    present = F.when(is_json, F.exists(values, lambda v: ~F.lower(v).isin(*NOT_REPORTED, "false"))).when(absent, False).otherwise(F.length(raw) > 0)
    value = F.when(is_json, F.array_join(F.filter(values, lambda v: v != ""), "; ")).when(absent, "Not reported").when(said(UNREADABLE), "Unclear (illegible)").otherwise(F.substring(raw, 1, 200))
    return {"present": present, "value": value}


def key_value_lines(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """A row for each `key: value` line of over 3 characters: (*keep, element, value); keys in lower case, spaces as underscores."""
    line = rows.select(*keep, F.explode(F.split(F.trim(F.col(text_col)), "\n")).alias("_l")).where(F.contains("_l", F.lit(":")) & (F.length("_l") > 3))
    key = F.replace(F.lower(F.trim(F.substring_index("_l", ":", 1))), F.lit(" "), F.lit("_"))
    return line.select(*keep, key.alias("element"), F.trim(F.expr("substr(_l, instr(_l, ':') + 1)")).alias("value"))


def explanation_fields(explanation: Column, names: list[str]) -> dict[str, Column]:
    """Columns from `key: value; key: value`: the last value of each name, NULL without one."""
    items = F.filter(F.split(explanation, ";"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    return {n: F.try_element_at(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), F.lit(-1)) for n in names}  # noqa: B023


def interpolate(template: Column, values: dict[str, Column], kind: str = "MUSTACHE") -> Column:
    """A template with its variables filled in, written in one of the INTERPOLATIONS."""
    for name, value in values.items():
        template = F.replace(template, F.lit(INTERPOLATIONS[kind] % name), value)
    return template


def json_path(document: Column, path: str, default: str = "") -> Column:
    """Text at a path like $.a.b of a JSON document, or the default."""
    return F.coalesce(F.get_json_object(document, path), F.lit(default))


SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_chunks(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the first separator that a text has and, in parts still too long, at later ones.

    Parts are joined up to the size again; a chunk begins with as many of the last one's parts as the overlap holds.
    """
    here = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, later = separators[here], separators[here + 1 :]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held and (joined := sep.join(held).strip()):
            out.append(joined)

    length = 0
    for part in list(text) if sep == "" else [p for p in text.split(sep) if p]:
        if len(part) >= size and later:
            flush()
            held, length = [], 0
            out += recursive_chunks(part, size, overlap, later)
            continue
        more = len(part) + (len(sep) if held else 0)
        if length + more > size and held:
            flush()
            while held and (length > overlap or length + len(part) + len(sep) > size):
                length -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held.pop(0)
            more = len(part) + (len(sep) if held else 0)
        held.append(part)
        length += more
    flush()
    return out


def chunked_recursively(docs: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, chunk) by separators; an Arrow batch at a time. Null and blank texts have no chunks."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_chunks(t or "", size, overlap))

    return docs.select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk_no", "chunk"))
