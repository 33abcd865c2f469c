"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds are email, ip, card (Luhn) and phone; the method adds IBANs confirmed by mod 97 and
US social security numbers, which need a nearby context word to reach ``min_score``. Scores are
whole per cents: a prior for the kind, a bonus for a passed checksum, and a bonus for a word of the
kind within ``context`` characters before the span (on either side for the kinds added). Base spans stay whatever their score.

Defined results: a null or empty text gives no spans and the hash of the empty string; null ids and
repeated rows pass through, one result row for each input row; an empty table gives an empty one; other input columns are ignored.
Very long texts are scanned whole, in time proportional to their length and matches. Spans of different kinds may overlap; of one kind they never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.spans import around, joined, listed, pieces, quoted, with_spans

# Runs are taken possessively and only from their start (or the end of the match before), which
# finds the same matches as the plain patterns in linear time and without recursion.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = f"(?:\\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
#: Characters of an IBAN, by country code as registered; other codes take the longest match.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_REGISTERED = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
_BY_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN = f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_LENGTH}|(?!{_REGISTERED})[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
SSN = "(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind -> prior, checksum bonus, context bonus (per cent), context words.
SCORES = {
    "email": (80, 0, 20, "mail|contact|write"),
    "ip": (50, 0, 30, "ip|address|host|server"),
    "card": (30, 40, 30, "card|visa|credit|payment|karte|tarjeta|carte"),
    "phone": (50, 0, 40, "phone|call|tel|fax|mobile"),
    "iban": (30, 50, 20, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (30, 0, 50, "ssn|social security"),
}


def luhn(digits: str) -> str:
    d = f"cast(substr({digits}, length({digits}) + 1 - i, 1) as int)"
    return (
        f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN {d} "
        f"WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END) % 10 = 0"
    )


def mod97(iban: str) -> str:
    """Of the compact IBAN with its first four characters moved to the end, letters as 10 to 35."""
    ch = f"substr(concat(substr({iban}, 5), substr({iban}, 1, 4)), i, 1)"
    return (
        f"aggregate(sequence(1, length({iban})), 0, (t, i) -> CASE WHEN {ch} BETWEEN '0' AND '9' "
        f"THEN (t * 10 + ascii({ch}) - 48) % 97 ELSE (t * 100 + ascii({ch}) - 55) % 97 END) = 1"
    )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = 40, min_score: int = 60) -> DataFrame:
    """doc_id and an array of struct<start,end,hit,score> for each kind, offsets in code points, end exclusive."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    df = with_spans(df, "__text", {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN})
    any_found = " OR ".join(f"size({k}) > 0" for k in KINDS)
    df = df.withColumn("__pieces", F.expr(f"CASE WHEN {any_found} THEN {pieces('__text')} END"))
    only = lambda x: f"regexp_replace({x}, '[^0-9]', '')"
    compact = "replace(s.hit, ' ', '')"
    ip_ok = quoted(f"^{BYTE}\\.{BYTE}\\.{BYTE}\\.{BYTE}$")
    tests = {
        "ip": f"s.hit RLIKE {ip_ok}",
        "card": f"length({only('s.hit')}) BETWEEN 14 AND 19 AND {luhn(only('s.hit'))}",
        "phone": f"length({only('s.hit')}) BETWEEN 10 AND 15",
        "iban": f"length({compact}) <= 34 AND {mod97(compact)}",
    }
    for k in KINDS:
        prior, checked, near, words = SCORES[k]
        base = prior + (checked if k in ("card", "iban") else 0)
        before, after = around("__pieces", "s.start", "s.end", context)
        found = f"lower({before}) RLIKE '{words}'" + (f" OR lower({after}) RLIKE '{words}'" if k not in BASE else "")
        score = f"{base} + CASE WHEN {found} THEN {near} ELSE 0 END"
        df = df.withColumn(k, F.expr(f"transform(filter({k}, s -> {tests.get(k, 'true')}), s -> named_struct('start', s.start, 'end', s.end, 'hit', s.hit, 'score', {score}))"))
        if k not in BASE:
            df = df.withColumn(k, F.expr(f"filter({k}, s -> s.score >= {min_score})"))
    return df.drop("__text", "__pieces")


def pii_digest(docs: DataFrame) -> DataFrame:
    df = find_pii(docs).withColumn("__base", F.expr(listed(BASE))).withColumn("__all", F.expr(listed(KINDS)))
    scored = "array_join(flatten(array(" + ", ".join(f"transform({k}, s -> concat('{k}:', s.start, ':', s.end, ':', s.score))" for k in KINDS) + ")), ',')"
    return df.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.expr(f"sha2({joined('__base')}, 256)").alias("base_sha256"),
        F.expr(joined("__all")).alias("spans"),
        F.expr(scored).alias("scored"),
    )
