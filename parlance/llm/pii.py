"""Personal data, with SQL functions only.

Expressions propose spans; checksums (Luhn for cards, mod 97 for account numbers) confirm them; words
nearby move a span's score. Spark has no function that returns the places of all matches, so they are
summed up from the lengths of the matches and of the text between them: ``regexp_extract_all`` and
``split`` walk the same matches, and ``length`` counts code points. The sums are formed by doubling
(every place adds the one 1, 2, 4, ... places before it), so n matches cost n log n, and the words near a
span are read from pieces of ``_PIECE`` code points, so no lookup walks the text from its start.

Each expression below finds exactly what the plain one in its comment finds, in time linear in the
text: possessive repeats cannot backtrack, and ``(?:\\G|(?<!x))`` lets a match begin only at the start
of a run of ``x`` or where the last match ended, as any later start in the same run fails the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base expressions and what the method adds, in the order in which kinds are listed.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # \b(two letters, two digits, then as many letters or digits as the country has, in groups or not)\b
    "iban": "",  # made below, from IBAN_LENGTHS
    # [0-9]{3}-[0-9]{2}-[0-9]{4}, no further digit, hyphen or plus beside it
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Characters of an account number by country, from the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_ACCOUNT = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
PATTERNS["iban"] = f"(?<![A-Za-z0-9_])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_ACCOUNT})(?![A-Za-z0-9_])"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A text without this is not searched: a cheap test before the expression, by a string or a short expression.
_NEEDS = {"email": "@", "phone": "+"}
_SHORT = {"ip": r"[0-9]\.[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "-[0-9]{2}-"}
_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: Words near a span that make it likelier, in the languages of the corpus. A span starts at its
#: kind's score, and a word within WINDOW code points before or after it adds LIFT. An added span
#: stays if it then scores ACCEPT or more, so a number without a checksum needs such a word.
CONTEXT = {
    "email": r"(?i)mail|contact|kontakt|correo|courriel|write to",
    "ip": r"(?i)\bip\b|host|server|address|adresse|dirección",
    "card": r"(?i)card|karte|carte|tarjeta|visa|payment",
    "phone": r"(?i)phone|call|tel|fax|mobile|ruf",
    "iban": r"(?i)iban|account|konto|compte|cuenta|bank",
    "ssn": r"(?i)ssn|social security",
}
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
LIFT, WINDOW, ACCEPT = 0.2, 40, 0.6
#: A text is cut into pieces of this many code points, so that words near a span are found without a walk.
_PIECE = 1024


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(
            (n - i) % 2 == 1,
            F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(digits, i, F.lit(1)).cast("int") + 1),
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (spaces allowed) leaves 1 when its rearranged digits are divided by 97."""
    bare = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    )
    return rest == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike(_PART))
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return mod97(s)
    return F.lit(True)


def _sums(lengths: Column) -> Column:
    """The running sums of an array of ints: after the step of width w, every place holds the sum of 2 w lengths."""
    widths = F.filter(F.array(*(F.lit(1 << i) for i in range(31))), lambda w: w < F.size(lengths))
    return F.aggregate(
        widths, lengths, lambda sums, w: F.transform(sums, lambda x, i: x + F.when(i >= w, F.get(sums, i - w)).otherwise(0))
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: a one-element array binds it to a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


_EMPTY = "array<struct<start:int,end:int,found:string>>"


def _spans(kind: str, text: Column) -> Column:
    """The valid matches of one kind: an array of (start, end, found), in order."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    both = F.struct(found.alias("found"), F.split(text, PATTERNS[kind], -1).alias("gaps"))

    def place(x: Column) -> Column:
        lengths = F.zip_with(x.found, F.slice(x.gaps, F.lit(1), F.size(x.found)), lambda m, g: F.length(m) + F.length(g))

        def spans(ends: Column) -> Column:
            each = F.zip_with(
                x.found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("found"))
            )
            return F.filter(each, lambda s: _valid(kind, s.found))

        return _bound(_sums(lengths), spans)

    might = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike(_SHORT.get(kind, PATTERNS[kind]))
    return F.when(might, _bound(both, place)).otherwise(F.array().cast(_EMPTY))


def _scored(kind: str) -> Column:
    """The spans of a kind as (start, end, score), added ones only if their score will do.

    ``pieces`` holds the text cut every ``_PIECE`` code points.
    """

    def part(begin: Column, end: Column) -> Column:
        at = F.floor(begin / _PIECE).cast("int")
        two = F.concat(F.coalesce(F.get("pieces", at), F.lit("")), F.coalesce(F.get("pieces", at + 1), F.lit("")))
        return F.substr(two, begin - at * _PIECE + 1, end - begin)

    def one(s: Column) -> Column:
        before, after = part(F.greatest(s.start - WINDOW, F.lit(0)), s.start), part(s.end, s.end + WINDOW)
        near = F.concat(before, F.lit(" "), after).rlike(CONTEXT[kind])
        score = F.round(F.lit(BASE_SCORE[kind]) + F.when(near, LIFT).otherwise(0.0), 6)
        if kind == "ssn":  # stands alone, and is none of the numbers that are never given out
            good = s.found.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)") & ~before.rlike("[0-9+-]$") & ~after.rlike("^[0-9-]")
            score = F.when(good, score).otherwise(0.0)
        return F.struct(s.start.alias("start"), s.end.alias("end"), score.alias("score"))

    spans = F.transform(kind, one)
    return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s.score >= ACCEPT)


def _joined(kinds: tuple[str, ...]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(
            kind, lambda s: F.concat(F.lit(f"{kind}:"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))
        )

    parts = [named(kind) for kind in kinds]
    return F.array_join(F.concat(*parts), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row, from the whole text.

    doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the four base kinds), spans (base spans,
    confirmed account numbers, and social security numbers with such a word nearby; ``kind:start:end`` in
    code points by kind, then start), max_score (of the best span after its context, null without spans). A
    null text is empty: no spans, and the digest of the empty string. Null doc_ids and repeated rows stay;
    columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    found = rows.select("doc_id", "text", *(_spans(k, F.col("text")).alias(k) for k in KINDS))
    some = reduce(lambda a, b: a | b, (F.size(k) > 0 for k in KINDS))
    cut = F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    found = found.select("doc_id", *KINDS, cut.alias("pieces")).select("doc_id", *(_scored(k).alias(k) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_joined(BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"),
        F.array_max(F.concat(*(F.transform(k, lambda s: s.score) for k in KINDS))).alias("max_score"),
    )


def query(docs: DataFrame) -> DataFrame:
    """The rows of query op4."""
    return find_pii(docs)


def _oracle() -> str:
    """The same rows from the plain expressions, by DuckDB's own functions."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": rf"\b(?:{_ACCOUNT})\b",
        "ssn": PATTERNS["ssn"],
    }
    luhn_sql = (
        "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN "
        "[0,2,4,6,8,1,3,5,7,9][d[i]::INT + 1] ELSE d[i]::INT END)) % 10 = 0"
    )
    bare = "replace(m, ' ', '')"
    turned = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    digits = (
        f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
        "THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')"
    )
    check = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(p, '0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])'))) = 0",
        "card": f"len(d) BETWEEN 13 AND 19 AND {luhn_sql}",
        "phone": "len(d) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_transform(string_split({digits}, ''), lambda x: x::BIGINT), lambda a, x: (a * 10 + x) % 97) = 1",
        "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND NOT regexp_matches(substr(text, s, 1), '[0-9+-]') "
        "AND NOT regexp_matches(substr(text, s + len(m) + 1, 1), '[0-9-]')",
    }
    steps = ["d0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for i, kind in enumerate(KINDS):
        steps.append(
            f"m_{kind} AS (SELECT r, text, unnest(regexp_extract_all(text, '{plain[kind]}')) AS m, "
            f"generate_subscripts(regexp_extract_all(text, '{plain[kind]}'), 1) AS i, "
            f"string_split_regex(text, '{plain[kind]}') AS g, regexp_extract_all(text, '{plain[kind]}') AS a "
            f"FROM d0 WHERE regexp_matches(text, '{plain[kind]}'))"
        )
        steps.append(
            f"p_{kind} AS (SELECT r, text, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, "
            "(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(a[1:i - 1], lambda x: len(x))), 0))::BIGINT AS s "
            f"FROM m_{kind})"
        )
        near = (
            f"(substr(text, greatest(s - {WINDOW}, 0) + 1, s - greatest(s - {WINDOW}, 0)) || ' ' || substr(text, s + len(m) + 1, {WINDOW}))"
        )
        steps.append(
            f"v_{kind} AS (SELECT r, {i} AS k, s, '{kind}:' || s || ':' || (s + len(m)) AS t, "
            f"round(({BASE_SCORE[kind]} + CASE WHEN regexp_matches({near}, '{CONTEXT[kind]}') THEN {LIFT} ELSE 0.0 END)::DOUBLE, 6) AS score "
            f"FROM p_{kind} WHERE {check[kind]}{'' if kind in BASE_KINDS else f' AND score >= {ACCEPT}'})"
        )
    steps.append("v AS (" + " UNION ALL ".join(f"SELECT * FROM v_{k}" for k in KINDS) + ")")
    counts = ", ".join(f"count(*) FILTER (k = {i})::BIGINT AS n_{k}" for i, k in enumerate(BASE_KINDS))
    steps.append(
        f"g AS (SELECT r, {counts}, string_agg(t, ',' ORDER BY k, s) FILTER (k < {len(BASE_KINDS)}) AS b, "
        "string_agg(t, ',' ORDER BY k, s) AS spans, round(max(score)::DOUBLE, 6) AS max_score FROM v GROUP BY r)"
    )
    out = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, {out}, sha256(coalesce(b, '')) AS base_sha256, "
        "coalesce(spans, '') AS spans, max_score FROM d0 LEFT JOIN g USING (r)"
    )


ORACLE_SQL = _oracle()
