"""Queries on dialogue acts, conversation state and the question policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.config import Config
from parlance.functions import text as T
from parlance.functions import vocabulary as V
from parlance.operators import dialogue as D
from parlance.operators import index as I
from parlance.operators import policy as P
from parlance.operators import state as ST
from parlance.plans import ranking
from parlance.plans import sql as S
from parlance.sources import adapters as A

_KEEP = Config()
_ERASE = Config(override_decay=0.0)


def _lookup(spark, sf_dir):
    return I.bucket_lookup(I.product_index(A.products(spark, sf_dir)))


def _state(spark, sf_dir, config=_KEEP):
    return ST.state(A.messages(spark, sf_dir), _lookup(spark, sf_dir), config)


def scan_category(spark, sf_dir):
    m = A.messages(spark, sf_dir).withColumn("id", F.struct("session_id", "turn"))
    out = D.scan_category(m, _lookup(spark, sf_dir))
    return out.select("id.session_id", "id.turn", "name", F.col("begin").cast("bigint").alias("begin"), F.col("words").cast("bigint").alias("words"))


def resolve_category(spark, sf_dir):
    m = A.messages(spark, sf_dir).withColumn("fragment", F.regexp_replace(T.normalise("message"), "^i'm looking for ", ""))
    return D.resolve_category(m, _lookup(spark, sf_dir), ["session_id", "turn"])


def parse_openings(spark, sf_dir):
    m = A.messages(spark, sf_dir).withColumn("id", F.struct("session_id", "turn"))
    out = D.parse_openings(m, _lookup(spark, sf_dir))
    return out.select("id.*", "category", "scenario", F.array_join("constraints", " | ").alias("constraints"), "exact")


def parse_replies(spark, sf_dir):
    r = A.messages(spark, sf_dir).select("session_id", "turn", D.parse_reply("message").alias("r"))
    return r.select("session_id", "turn", "r.kind", "r.attribute", F.array_join("r.constraints", " | ").alias("constraints"), "r.exact")


def split_payload(spark, sf_dir):
    m = A.messages(spark, sf_dir)
    return m.select(
        "session_id", "turn", F.array_join(D.split_payload(F.col("message")), " | ").alias("parts"),
        F.array_join(D.content_segments(F.col("message")), " | ").alias("content"),
    )


def state_fold(spark, sf_dir):
    """Known constraints after every turn, with their types and weights."""
    c = _state(spark, sf_dir)["constraints"]
    return c.select("session_id", "turn", "added", F.col("pos").cast("bigint").alias("pos"), "text", "kind", "value", "attribute", "weight")


def state_turns(spark, sf_dir):
    """Category and spent attributes after every turn."""
    t = _state(spark, sf_dir)["turns"]
    return t.select("session_id", "turn", "category", F.array_join("exhausted", ",").alias("exhausted"))


def erased_constraints(spark, sf_dir):
    """With full erasure: which constraints are active after every turn."""
    c = _state(spark, sf_dir, _ERASE)["constraints"]
    return c.select("session_id", "turn", "text", "added", "active")


def observed_tokens(spark, sf_dir):
    return _state(spark, sf_dir)["observed"]


def query_terms_weights(spark, sf_dir):
    return ST.query_terms(_state(spark, sf_dir)).select("session_id", "token", F.round("boost", 6).alias("boost"))


def retraction_penalty(spark, sf_dir):
    terms = ST.query_terms(_state(spark, sf_dir, _ERASE), _ERASE)
    return terms.select("session_id", "token", F.round("boost", 6).alias("boost"))


def _pool(spark, sf_dir):
    return I.product_index(A.products(spark, sf_dir)).withColumn("query", F.regexp_extract("category", r"^\S+", 0))


def _rounded(df):
    return df.withColumn("power", F.round("power", 6))


def attribute_entropy(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    parts = [P.typed_partition(pool, f"first_{n}").withColumn("attribute", F.lit(n)) for n in ("material", "color")]
    return _rounded(parts[0].unionByName(parts[1]))


def price_partition(spark, sf_dir):
    return _rounded(P.price_partition(_pool(spark, sf_dir)))


def lexical_partition(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    parts = [P.lexical_partition(pool, w).withColumn("attribute", F.lit(n)) for n, w in V.TRIGGERS.items()]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _states(spark, sf_dir):
    """Sessions that know their hard constraints; every second has spent the open question, every third feature."""
    s = ranking._sessions(spark, sf_dir).withColumn("n", F.substring("query", 2, 20).cast("bigint"))
    spent = F.filter(
        F.array(F.when(F.col("n") % 2 == 0, F.lit("other")), F.when(F.col("n") % 3 == 0, F.lit("feature")), F.when(F.col("n") % 5 == 0, F.lit("material"))),
        lambda x: x.isNotNull(),
    )
    known = F.array_distinct(F.transform("hard", lambda c: T.classify_constraint(c)))
    return s.select(F.col("query").alias("id"), F.regexp_extract("category", r"^\S+", 0).alias("query"), known.alias("known"), spent.alias("exhausted"))


def expected_gain(spark, sf_dir):
    rows = _states(spark, sf_dir).join(P.powers(_pool(spark, sf_dir)), "query")
    gain = P.expected_gain(F.col("attribute"), F.col("power"), F.col("known"), F.col("exhausted"))
    return rows.select("id", "attribute", F.round(gain, 6).alias("gain"))


def choose_question(spark, sf_dir):
    best = P.best_specific(_states(spark, sf_dir), P.powers(_pool(spark, sf_dir)))
    asked = {
        s: P.choose(F.col("best"), F.col("gain"), F.col("exhausted"), Config(clarify_strategy=s)).alias(f"ask_{s}")
        for s in ("none", "open", "infogain", "hybrid")
    }
    return best.select("id", *asked.values())


_OWN = (
    scan_category, resolve_category, parse_openings, parse_replies, split_payload, state_fold, state_turns, erased_constraints,
    observed_tokens, query_terms_weights, retraction_penalty, attribute_entropy, price_partition, lexical_partition,
    expected_gain, choose_question,
)
QUERIES = {f.__name__: f for f in _OWN}


def _q(s: str) -> str:
    return s.replace("'", "''")


def _seg(e: str) -> str:
    return f"trim({e}, ' .,;:!?-\"''')"


def _parts(e: str) -> str:
    return f"list_filter(list_transform(string_split({e}, ';'), lambda p: {_seg('p')}), lambda p: p <> '')"


def _content(e: str) -> str:
    return f"list_filter({_parts(e)}, lambda p: len({S.content_terms('p')}) > 0)"


_NO = "[]::VARCHAR[]"
_BASE = f"""{S.INDEX}, {A.MESSAGES_SQL},
lookup AS (SELECT {S.normalise("category")} AS norm_name, max(category) AS name FROM idx GROUP BY 1),
norm AS (SELECT session_id, turn, message, {S.normalise("message")} AS low FROM message),
w AS (SELECT session_id, turn, string_split(low, ' ') AS w FROM norm),
wb AS (SELECT *, unnest(range(1, len(w) + 1)) AS b FROM w),
wn AS (SELECT *, unnest(range(1, least(10, len(w) - b + 1) + 1)) AS n FROM wb),
scan AS (SELECT session_id, turn, name, b, n FROM (SELECT session_id, turn, b, n, trim(array_to_string(w[b:b + n - 1], ' '), ' .,;:!?-') AS norm_name FROM wn)
  JOIN lookup USING (norm_name) QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY n DESC, b) = 1)"""


def _resolve(source: str, name: str, keys: str) -> str:
    return f"""{name}_w AS (SELECT {keys}, string_split({S.normalise("fragment")}, ' ') AS w FROM {source}),
{name}_n AS (SELECT *, unnest(range(1, least(10, len(w)) + 1)) AS n FROM {name}_w),
{name}_r AS (SELECT {keys}, n, rtrim(array_to_string(w[1:n], ' '), ' .,;:') AS norm_name, ltrim(coalesce(array_to_string(w[n + 1:], ' '), ''), ' .,;:') AS remainder FROM {name}_n
  UNION ALL SELECT {keys}, 1000, rtrim(array_to_string(w, ' '), ' .,'), '' FROM {name}_w),
{name} AS (SELECT {keys}, name, remainder FROM {name}_r JOIN lookup USING (norm_name) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC) = 1)"""


_EXP, _MARK = len(V.EXPLORING_SUFFIX), len(V.REQUIREMENT_MARKER)
_OPEN = f"""{_BASE},
body AS (SELECT *, substr(low, {len(V.OPENING_PREFIX) + 1}) AS body FROM norm WHERE starts_with(low, '{_q(V.OPENING_PREFIX)}')),
piece AS (SELECT session_id, turn, 1 AS tier, body[:len(body) - {_EXP}] AS fragment, '' AS payload FROM body WHERE ends_with(body, '{_q(V.EXPLORING_SUFFIX)}')
  UNION ALL SELECT session_id, turn, 2, substr(body, 1, instr(body, '{_q(V.REQUIREMENT_MARKER)}') - 1), {_seg(f"substr(body, instr(body, '{_q(V.REQUIREMENT_MARKER)}') + {_MARK})")} FROM body WHERE contains(body, '{_q(V.REQUIREMENT_MARKER)}')
  UNION ALL SELECT session_id, turn, 3, body, '' FROM body),
{_resolve("piece", "got", "session_id, turn, tier")},
exact AS (SELECT session_id, turn, tier, name, CASE WHEN tier = 3 THEN {_seg("remainder")} ELSE payload END AS text FROM got JOIN piece USING (session_id, turn, tier)
  QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY tier) = 1),
residual AS (SELECT n.session_id, n.turn, n.low, s.name, CASE WHEN s.name IS NULL THEN n.low ELSE
  trim(array_to_string(list_concat(string_split(n.low, ' ')[1:b - 1], string_split(n.low, ' ')[b + n:]), ' '), ' .,;:-') END AS rest FROM norm n LEFT JOIN scan s USING (session_id, turn)),
opening AS (SELECT r.session_id, r.turn, coalesce(e.name, r.name) AS category,
  CASE WHEN e.tier = 1 THEN 'browsing' WHEN e.tier = 2 THEN 'buying' WHEN e.tier = 3 THEN 'intent_override'
    WHEN {S.has("low", V.BROWSE_CUES)} THEN 'browsing' WHEN {S.has("low", V.REQUIRE_CUES)} THEN 'buying' ELSE 'intent_override' END AS scenario,
  CASE WHEN e.tier IS NOT NULL THEN CASE WHEN e.text <> '' THEN [e.text] ELSE {_NO} END WHEN {S.has("low", V.BROWSE_CUES)} THEN {_NO} ELSE {_content("rest")} END AS constraints,
  e.tier IS NOT NULL AS exact FROM residual r LEFT JOIN exact e USING (session_id, turn))"""


def _retract() -> str:
    cases = " ".join(f"WHEN contains(low, '{_q(c)}') THEN substr(low, instr(low, '{_q(c)}') + {len(c)})" for c in V.RETRACT_CUES)
    return f"regexp_replace((CASE {cases} END), '^(?:.*?\\bis\\b|.*?\\bneed\\b)[:\\s]*', '')"


def _attr(pattern: str) -> str:
    name = f"trim(regexp_extract(low, '{_q(pattern)}', 1), ' .;:')"
    return f"CASE WHEN {name} IN {S._in(V.ATTRIBUTES)} THEN {name} END"


_FIND = "coalesce(" + ", ".join(
    f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9_])({a.replace('_', ' ')}|{a})([^a-z0-9_]|$)') THEN '{a}' END" for a in V.ATTRIBUTES
) + ")"
_REST = _content(_seg("CASE WHEN contains(low, ':') THEN substr(low, instr(low, ':') + 1) ELSE low END"))
_m = lambda p: f"regexp_matches(low, '{_q(p)}')"
_REPLY = f"""route AS (SELECT session_id, turn, low, CASE WHEN low = '' THEN 0 WHEN {_m(V.OVERRIDE)} THEN 1 WHEN {_m(V.NO_PREFERENCE)} THEN 2 WHEN {_m(V.NO_ADDITIONAL)} THEN 3
  WHEN {_m(V.DISCLOSURE)} THEN 4 WHEN contains(low, '{_q(V.ASK_MORE)}') THEN 5 WHEN {S.has("low", V.RETRACT_CUES)} THEN 6 WHEN {S.has("low", V.NEGATION_CUES)} THEN 7
  WHEN {S.has("low", V.ASK_MORE_CUES)} THEN 8 WHEN len({_REST}) > 0 THEN 9 ELSE 10 END AS r FROM norm),
reply AS (SELECT session_id, turn, CASE r WHEN 1 THEN 'override' WHEN 2 THEN 'boundary' WHEN 3 THEN 'no_additional' WHEN 4 THEN 'disclosure' WHEN 5 THEN 'ask_more'
    WHEN 6 THEN 'override' WHEN 7 THEN CASE WHEN {S.has("low", V.BOUNDARY_CUES)} THEN 'boundary' ELSE 'no_additional' END WHEN 8 THEN 'ask_more' WHEN 9 THEN 'disclosure' ELSE 'unknown' END AS kind,
  CASE r WHEN 2 THEN {_attr(V.NO_PREFERENCE)} WHEN 3 THEN {_attr(V.NO_ADDITIONAL)} WHEN 7 THEN {_FIND} END AS attribute,
  CASE r WHEN 1 THEN {_parts(f"regexp_extract(low, '{_q(V.OVERRIDE)}', 1)")} WHEN 4 THEN {_parts(f"regexp_extract(low, '{_q(V.DISCLOSURE)}', 1)")}
    WHEN 6 THEN {_content(_seg(_retract()))} WHEN 9 THEN {_REST} ELSE {_NO} END AS constraints, r <= 5 AS exact FROM route)"""
_STATE = f"""{_OPEN}, {_REPLY},
act AS (SELECT session_id, turn, 'opening' AS kind, category, NULL AS attribute, constraints FROM opening WHERE turn <= 1
  UNION ALL SELECT session_id, turn, kind, name, attribute, constraints FROM reply LEFT JOIN scan USING (session_id, turn) WHERE turn > 1),
ov AS (SELECT session_id, min(turn) AS o FROM act WHERE kind = 'override' GROUP BY 1),
said_c AS (SELECT session_id, turn AS added, kind, unnest(constraints) AS text, generate_subscripts(constraints, 1) - 1 AS pos FROM act WHERE kind IN ('opening', 'override', 'disclosure')),
con_all AS (SELECT *, {S.normalise("text")} AS k, kind = 'opening' AS prov FROM said_c LEFT JOIN ov USING (session_id) WHERE {S.normalise("text")} <> ''),
con AS (SELECT * FROM con_all QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY added, pos) = 1),
known AS (SELECT session_id, act.turn, added, pos, text, k, CASE WHEN prov AND o <= act.turn AND o > added THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM act JOIN con USING (session_id) WHERE added <= act.turn),
con0 AS (SELECT * FROM con_all QUALIFY row_number() OVER (PARTITION BY session_id, k, coalesce(added >= o, false) ORDER BY added, pos) = 1),
known0 AS (SELECT session_id, act.turn, added, pos, text, k, NOT coalesce(prov AND o <= act.turn AND o > added, false) AS active FROM act JOIN con0 USING (session_id) WHERE added <= act.turn
  QUALIFY row_number() OVER (PARTITION BY session_id, act.turn, k, active ORDER BY added, pos) = 1),
tok AS (SELECT session_id, token, min(turn) AS turn FROM (SELECT session_id, turn, unnest({S.content_terms("message")}) AS token FROM message) GROUP BY ALL),
turns AS (SELECT session_id, turn, first_value(category IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS category,
  list_sort(list_distinct(list(CASE WHEN kind IN ('no_additional', 'boundary') THEN coalesce(attribute, 'other') END) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING))) AS spent FROM act),
latest AS (SELECT session_id, max(turn) AS turn FROM turns GROUP BY 1)"""


def _terms_sql(known: str, active: str, boost: str) -> str:
    return f"""WITH {_STATE}, base AS (
  SELECT session_id, unnest({S.terms("category")}) AS token, 1.0::DOUBLE AS boost, true AS prot FROM turns JOIN latest USING (session_id, turn) WHERE category IS NOT NULL
  UNION ALL SELECT session_id, token, 0.55, false FROM tok
  UNION ALL SELECT session_id, unnest({S.terms("text")}), {boost}, true FROM {known} JOIN latest USING (session_id, turn) WHERE {active}),
top AS (SELECT session_id, token, max(boost) AS boost, max(prot) AS prot FROM base GROUP BY ALL),
gone AS (SELECT DISTINCT session_id, unnest({S.terms("text")}) AS token FROM {known} JOIN latest USING (session_id, turn) WHERE NOT ({active}))
SELECT session_id, token, round(CASE WHEN gone.token IS NOT NULL AND NOT coalesce(prot, false) THEN -0.35 ELSE boost END::DOUBLE, 6) AS boost FROM top FULL JOIN gone USING (session_id, token)"""


_POOL = f"{S.INDEX}, pool AS (SELECT *, regexp_extract(category, '^\\S+') AS query FROM idx)"


def _entropy(name: str, groups: str) -> str:
    return (
        f"{name}_g AS ({groups}), {name}_p AS (SELECT query, n::DOUBLE / sum(n) OVER (PARTITION BY query) AS p FROM {name}_g WHERE n > 0), "
        f"{name} AS (SELECT query, CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END::DOUBLE AS power FROM {name}_p GROUP BY 1)"
    )


_POWERS = ", ".join(
    [_entropy(f"e_{n}", f"SELECT query, coalesce(first_{n}, '-') AS g, count(*) AS n FROM pool GROUP BY ALL") for n in ("material", "color")]
    + [_entropy(f"e_{n}", f"SELECT query, {S.has('blob', w)} AS g, count(*) AS n FROM pool GROUP BY ALL") for n, w in V.TRIGGERS.items()]
)
_PRICE = (
    "pk AS (SELECT query, list_sort(list(price) FILTER (price IS NOT NULL)) AS k FROM pool GROUP BY 1), "
    "cut AS (SELECT query, k, k[len(k) // 4 + 1] AS q1, k[len(k) // 2 + 1] AS q2, k[3 * len(k) // 4 + 1] AS q3 FROM pk WHERE len(k) >= 4), "
    + _entropy("e_cut", "SELECT query, CASE WHEN price IS NULL THEN 0 WHEN price <= q1 THEN 1 WHEN price <= q2 THEN 2 WHEN price <= q3 THEN 3 ELSE 4 END AS g, count(*) AS n FROM pool JOIN cut USING (query) GROUP BY ALL")
    + ", e_budget AS (SELECT query, coalesce(power, 0) AS power FROM pk LEFT JOIN e_cut USING (query))"
)
_POWER_ROWS = " UNION ALL ".join(
    f"SELECT query, '{n}' AS attribute, power FROM e_{n}" for n in ("material", "color", "budget", *V.TRIGGERS)
) + " UNION ALL SELECT DISTINCT query, 'feature', 0.9::DOUBLE FROM pool"
_CHANCE = "CASE attribute " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.YIELD.items()) + " END"
_RANKC = "CASE attribute " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(V.PRODUCTIVE)) + " END"
_GAIN = f"""WITH {_POOL}, {ranking._SESSION}, {_POWERS}, {_PRICE}, power AS ({_POWER_ROWS}),
st AS (SELECT query AS id, regexp_extract(category, '^\\S+') AS query, list_transform(hard, lambda c: {S.route("c")}) AS known,
  list_filter([CASE WHEN n % 2 = 0 THEN 'other' END, CASE WHEN n % 3 = 0 THEN 'feature' END, CASE WHEN n % 5 = 0 THEN 'material' END], lambda x: x IS NOT NULL) AS spent
  FROM (SELECT *, substr(query, 2)::BIGINT AS n FROM sess)),
gain AS (SELECT id, attribute, spent, CASE WHEN list_contains(spent, attribute) THEN 0 ELSE {_CHANCE}::DOUBLE * CASE WHEN list_contains(known, attribute) THEN 0.2 ELSE 1.0 END * 1.5 * power END::DOUBLE AS gain FROM st JOIN power USING (query))"""

ORACLE_SQL = {
    "scan_category": f"WITH {_BASE} SELECT session_id, turn, name, b AS begin, n AS words FROM scan",
    "resolve_category": f"WITH {_BASE}, frag AS (SELECT session_id, turn, regexp_replace(low, '^i''m looking for ', '') AS fragment FROM norm), {_resolve('frag', 'got', 'session_id, turn')} SELECT * FROM got",
    "parse_openings": f"WITH {_OPEN} SELECT session_id, turn, category, scenario, coalesce(array_to_string(constraints, ' | '), '') AS constraints, exact FROM opening",
    "parse_replies": f"WITH {_BASE}, {_REPLY} SELECT session_id, turn, kind, attribute, coalesce(array_to_string(constraints, ' | '), '') AS constraints, exact FROM reply",
    "split_payload": f"WITH {A.MESSAGES_SQL} SELECT session_id, turn, coalesce(array_to_string({_parts('message')}, ' | '), '') AS parts, coalesce(array_to_string({_content('message')}, ' | '), '') AS content FROM message",
    "state_fold": f"WITH {_STATE} SELECT session_id, turn, added, pos, text, {S.kind('text')} AS kind, {S.kind_value('text')} AS value, {S.route('text')} AS attribute, weight FROM known",
    "state_turns": f"WITH {_STATE} SELECT session_id, turn, category, coalesce(array_to_string(list_filter(spent, lambda x: x IS NOT NULL), ','), '') AS exhausted FROM turns",
    "erased_constraints": f"WITH {_STATE} SELECT session_id, turn, text, added, active FROM known0",
    "observed_tokens": f"WITH {_STATE} SELECT session_id, token, turn FROM tok",
    "query_terms_weights": _terms_sql("known", "true", "2.2 * weight"),
    "retraction_penalty": _terms_sql("known0", "active", "2.2"),
    "attribute_entropy": f"WITH {_POOL}, {_POWERS} SELECT query, round(power, 6) AS power, 'material' AS attribute FROM e_material UNION ALL SELECT query, round(power, 6), 'color' FROM e_color",
    "price_partition": f"WITH {_POOL}, {_PRICE} SELECT query, round(power, 6) AS power FROM e_budget",
    "lexical_partition": f"WITH {_POOL}, {_POWERS} " + " UNION ALL ".join(f"SELECT query, round(power, 6) AS power, '{n}' AS attribute FROM e_{n}" for n in V.TRIGGERS),
    "expected_gain": f"{_GAIN} SELECT id, attribute, round(gain, 6) AS gain FROM gain",
    "choose_question": f"""{_GAIN}, top AS (SELECT id, attribute AS best, round(gain, 9) AS g FROM gain WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(gain, 9) DESC, {_RANKC}) = 1),
f AS (SELECT id, best, g, list_contains(spent, 'other') AS shut FROM st LEFT JOIN top USING (id))
SELECT id, NULL::VARCHAR AS ask_none, CASE WHEN NOT shut THEN 'other' ELSE best END AS ask_open, CASE WHEN g >= 0.08 THEN best WHEN NOT shut THEN 'other' END AS ask_infogain,
  CASE WHEN g >= 0.08 AND g > CASE WHEN shut THEN 0 ELSE 1.5 END THEN best WHEN NOT shut THEN 'other' ELSE best END AS ask_hybrid FROM f""",
}
