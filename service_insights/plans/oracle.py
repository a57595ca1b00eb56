"""DuckDB oracles: one SQL text per registered query, over the supplied
tables (views ``lineitem``, ``orders``, ``customer``, ``supplier``).

The derived service tables and the rule scorer are re-stated here in SQL,
independently of the DataFrame code, so each query is checked against a
second formulation. SQL is assembled from small text fragments because the
same CASE blocks recur in many queries.
"""
from __future__ import annotations

import json

from ..constants import (AC_VENT_TEMPS, BATTERY_AGE_YEARS, BATTERY_VOLTS, CLASSES, COMPONENTS_PER_SERVICE,
                         DEMO_DATE, DEMO_SERVICE_TYPE, DEMO_SERVICES, FRONT_PAD_CHOICES, N_TECHNICIANS,
                         REAR_PAD_CHOICES, SERVICE_DAYS_BACK, SERVICES_PER_VEHICLE, TREAD_CHOICES,
                         VEHICLES_PER_CUSTOMER, COMPONENT_KEYS, CONTRACT_PREFIX, CONTRACT_SUFFIX,
                         DEFAULT_PROMPT_FOOTER, DEFAULT_PROMPT_HEADER, EMAIL_PROMPT_INTRO, EMAIL_PROMPT_OUTRO,
                         MODEL_TYPES, NO_SIGNAL_REASONING, PHRASES, SEED_COMPONENTS, SERVICE_TYPES,
                         SPECIALIZATIONS, VEHICLE_MAKE)
from ..functions.rules import AC_RE, BALANCED, BATTERY_RE, BRAKES_RE, STRICT, TIRES_RE, Thresholds
from ..sources import generate
from . import queries as Q


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(lit(x) if isinstance(x, str) else str(x) for x in items) + "]"


def vc(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


# --- derived tables -------------------------------------------------------

_PHRASE_RULES = {  # presence, class index (0 Good, 1 Upcoming, 2 Urgent)
    "suspension": ("ln % 4 = 3", "q % 3"),
    "engine_oil": ("ln % 3 = 1", "d % 3"),
    "coolant": ("ln % 3 = 2", "t % 3"),
    "transmission_fluid": ("ln % 4 = 1", "(q + d) % 3"),
    "belts_hoses": ("ln % 5 = 2", "(q + t) % 3"),
    "lights_electrical": ("ln = 4", "rfi"),
    "wipers": ("ln = 2", "rfi"),
    "exhaust": ("ln = 3", "(d + t) % 3"),
}


def _band_sql(value: str, urgent: str, upcoming: str) -> str:
    return (f"CASE WHEN {value} IS NULL THEN NULL WHEN {urgent} THEN 'Urgent' "
            f"WHEN {upcoming} THEN 'Upcoming' ELSE 'Good' END")


def _tires_sql(a, b, c, d, th: Thresholds) -> str:
    mn = f"least({a}, {b}, {c}, {d})"
    return _band_sql(mn, f"{mn} < {th.tires_urgent_below}", f"{mn} <= {th.tires_upcoming_max}")


def _brakes_sql(f, r, th: Thresholds) -> str:
    mn = f"least({f}, {r})"
    return _band_sql(mn, f"{mn} < {th.brakes_urgent_below}", f"{mn} <= {th.brakes_upcoming_max}")


def _battery_sql(v, a, th: Thresholds) -> str:
    return _band_sql(v, f"({v} < {th.battery_urgent_volts_below} OR {a} >= {th.battery_urgent_age_min})",
                     f"({v} < {th.battery_upcoming_volts_below} OR {a} >= {th.battery_upcoming_age_min})")


def _ac_sql(t, th: Thresholds) -> str:
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} <= {th.ac_good_max} THEN 'Good' "
            f"WHEN {t} <= {th.ac_upcoming_max} THEN 'Upcoming' ELSE 'Urgent' END")


def _piece_columns() -> str:
    """p_<key> (text or NULL) and s_<key> (generator severity or NULL)."""
    lf, rf_, lr, rr = "(2 + q % 8)", "(2 + (q + 3) % 8)", "(2 + (q + d) % 8)", "(2 + (q + t) % 8)"
    front = "CASE WHEN d = 0 THEN 1.5 ELSE CAST(1 + d AS DOUBLE) END"
    front_txt = f"CASE WHEN d = 0 THEN '1.5' ELSE {vc('1 + d')} END"
    v = "(114 + pk % 15)"
    volts_txt = f"(CASE WHEN {v} < 120 THEN '11.' ELSE '12.' END || {vc(v + ' % 10')})"
    age = "(1 + sk % 7)"
    temp = f"({lst(AC_VENT_TEMPS)})[q % 6 + 1]"
    cols = {
        "tires": ("ln % 3 <> 0",
                  f"'Tread depth (32nds): LF ' || {vc(lf)} || ', RF ' || {vc(rf_)} || ', LR ' || "
                  f"{vc(lr)} || ', RR ' || {vc(rr)} || '.'",
                  _tires_sql(lf, rf_, lr, rr, BALANCED)),
        "brakes": ("ln % 2 = 1",
                   f"'Brake pad thickness: front ' || {front_txt} || 'mm, rear ' || {vc('2 + t')} || 'mm.'",
                   _brakes_sql(front, "CAST(2 + t AS DOUBLE)", BALANCED)),
        "battery": ("ln % 4 < 2",
                    f"'Battery: ' || {volts_txt} || 'V resting, age ' || {vc(age)} || ' yr.'",
                    _battery_sql(f"(CAST({v} AS DOUBLE) / 10.0)", age, BALANCED)),
        "ac": ("ln % 5 = 0", f"'A/C: vent temp ' || {vc(temp)} || '°F at max cool.'",
               _ac_sql(temp, BALANCED)),
    }
    out = []
    for key in COMPONENT_KEYS:
        if key in cols:
            cond, text, sev = cols[key]
        else:
            cond, idx = _PHRASE_RULES[key]
            text = f"({lst(PHRASES[key])})[{idx} + 1]"
            sev = f"(['Good', 'Upcoming', 'Urgent'])[{idx} + 1]"
        out.append(f"CASE WHEN {cond} THEN {text} END AS p_{key}")
        out.append(f"CASE WHEN {cond} THEN {sev} END AS s_{key}")
    return ",\n    ".join(out)


def fixture_ctes() -> str:
    """CTEs svc (service), veh (vehicle), cust (customer), tech (technician)."""
    pieces = ", ".join(f"p_{k}" for k in COMPONENT_KEYS)
    truth = " , ".join(f"""CASE WHEN s_{k} IS NOT NULL THEN '"{k}": "' || s_{k} || '"' END"""
                       for k in COMPONENT_KEYS)
    return f"""
g AS (
  SELECT l_orderkey, l_linenumber AS ln,
         CAST(min(l_quantity) AS INTEGER) AS q,
         CAST(round(min(l_discount) * 100) AS INTEGER) AS d,
         CAST(round(min(l_tax) * 100) AS INTEGER) AS t,
         min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_returnflag) AS rf,
         min(l_shipdate) AS ship
  FROM lineitem GROUP BY l_orderkey, l_linenumber
),
gp AS (
  SELECT *, CASE rf WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 1 END AS rfi FROM g
),
pc AS (
  SELECT *,
    {_piece_columns()}
  FROM gp
),
svc AS (
  SELECT l_orderkey * 10 + ln AS service_id,
         l_orderkey AS vehicle_id,
         CAST(sk AS INTEGER) AS technician_id,
         CAST(ship AS DATE) AS service_date,
         ({lst(SERVICE_TYPES)})[q % 6 + 1] AS service_type,
         concat_ws(' ', {pieces}) AS service_performed,
         CASE WHEN ln % 6 = 0 THEN NULL
              WHEN ln % 6 = 1 AND q % 5 = 0 THEN 'tires'
              WHEN ln % 6 = 2 AND rf = 'R' THEN 'wipers'
              ELSE '' END AS flag1,
         '{{' || concat_ws(', ', {truth}) || '}}' AS ground_truth
  FROM pc
),
veh AS (
  SELECT o_orderkey AS vehicle_id, o_custkey AS customer_id, {lit(VEHICLE_MAKE)} AS make,
         ({lst(MODEL_TYPES)})[o_orderkey % 6 + 1] AS model,
         CAST(2018 + o_orderkey % 7 AS INTEGER) AS year,
         '1HGBH41JX' || CASE WHEN length({vc('o_orderkey')}) < 8 THEN lpad({vc('o_orderkey')}, 8, '0') ELSE {vc('o_orderkey')} END AS vin,
         o_orderdate, o_orderstatus
  FROM orders
),
cust AS (
  SELECT c_custkey AS customer_id, 'Customer' AS first_name,
         regexp_extract(c_name, '[0-9]+', 0) AS last_name,
         lower(replace(c_name, '#', '.')) || '@example.com' AS email
  FROM customer
),
tech AS (
  SELECT CAST(s_suppkey AS INTEGER) AS technician_id,
         ({lst(SPECIALIZATIONS)})[s_suppkey % 5 + 1] AS specialization
  FROM supplier
)"""


# --- rule scorer in SQL -----------------------------------------------------

def _num(s: str, pattern: str, i: int, typ: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({s}, {lit(pattern)}, {i}), '') AS {typ})"


def _sentence(notes: str, pattern: str) -> str:
    return f"NULLIF(regexp_extract({notes}, {lit(pattern)}, 0), '')"


def rule_case(notes: str, key_col: str, th: Thresholds) -> tuple[str, str]:
    """(raw class or NULL, raw reasoning) SQL for any component key."""
    ts = _sentence(notes, TIRES_RE)
    bs = _sentence(notes, BRAKES_RE)
    bat = _sentence(notes, BATTERY_RE)
    acs = _sentence(notes, AC_RE)
    tires = _tires_sql(*[_num(ts, TIRES_RE, i, "INTEGER") for i in range(1, 5)], th)
    brakes = _brakes_sql(_num(bs, BRAKES_RE, 1, "DOUBLE"), _num(bs, BRAKES_RE, 2, "DOUBLE"), th)
    battery = _battery_sql(_num(bat, BATTERY_RE, 1, "DOUBLE"), _num(bat, BATTERY_RE, 2, "INTEGER"), th)
    ac = _ac_sql(_num(acs, AC_RE, 1, "INTEGER"), th)
    cls = [f"WHEN 'tires' THEN {tires}", f"WHEN 'brakes' THEN {brakes}",
           f"WHEN 'battery' THEN {battery}", f"WHEN 'ac' THEN {ac}"]
    why = [f"WHEN 'tires' THEN {ts}", f"WHEN 'brakes' THEN {bs}",
           f"WHEN 'battery' THEN {bat}", f"WHEN 'ac' THEN {acs}"]
    for key, (good, upcoming, urgent) in PHRASES.items():
        c, w = [], []
        for phrase, label in ((urgent, "Urgent"), (upcoming, "Upcoming"), (good, "Good")):
            c.append(f"WHEN contains({notes}, {lit(phrase)}) THEN '{label}'")
            w.append(f"WHEN contains({notes}, {lit(phrase)}) THEN {lit(phrase)}")
        cls.append(f"WHEN {lit(key)} THEN (CASE {' '.join(c)} END)")
        why.append(f"WHEN {lit(key)} THEN (CASE {' '.join(w)} END)")
    return (f"(CASE {key_col} {' '.join(cls)} END)", f"(CASE {key_col} {' '.join(why)} END)")


def scored_cte(name: str, keys: list[str], th: Thresholds, src: str = "svc") -> str:
    """CTE ``name``: one row per (service, key) with classification/reasoning
    and the key position ``pos`` (0-based, config order)."""
    raw_cls, raw_why = rule_case("service_performed", "component_key", th)
    return f"""
{name}_k AS (
  SELECT *, unnest({lst(keys)}) AS component_key, unnest(range({len(keys)})) AS pos
  FROM {src}
),
{name}_r AS (
  SELECT *, {raw_cls} AS raw_cls, {raw_why} AS raw_why FROM {name}_k
),
{name} AS (
  SELECT *, coalesce(raw_cls, 'Good') AS classification,
         CASE WHEN raw_cls IS NULL THEN {lit(NO_SIGNAL_REASONING)} ELSE raw_why END AS reasoning,
         coalesce(flag1 = component_key, FALSE) AS technician_flagged
  FROM {name}_r
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


ALL = COMPONENT_KEYS
DEMO = Q.CONFIGS["balanced"].keys


def _q(body: str, *scored: tuple[str, list[str], Thresholds]) -> str:
    return _with(fixture_ctes(), *[scored_cte(n, k, t) for n, k, t in scored]) + body


def response_ctes(run: int, name: str) -> str:
    """CTEs ``<name>_b`` (a row per service with its case ``c``) and ``name``
    (the entries that a cleaned answer of that case has, for c >= 4)."""
    second = ("brakes", "wipers")[run]
    levels = "['Good', 'Upcoming', 'Urgent']"
    return f"""
{name}_b AS (
  SELECT l_orderkey * 10 + ln AS service_id, l_orderkey AS vehicle_id, q, d,
         (l_orderkey * 10 + ln + {5 * run}) % 13 AS c,
         ({levels})[(q + {run}) % 3 + 1] AS t, ({levels})[(d + {run}) % 3 + 1] AS b FROM g
),
{name} AS (
  SELECT service_id, vehicle_id, c, 0 AS pos, CASE WHEN c = 10 THEN '' ELSE 'tires' END AS component_key,
         CASE WHEN c = 7 THEN 'URGENT!' WHEN c = 10 THEN NULL ELSE t END AS classification,
         CASE WHEN c = 9 THEN NULL WHEN c = 10 THEN 'x' ELSE 'tread ' || q END AS reasoning FROM {name}_b
  UNION ALL SELECT service_id, vehicle_id, c, 1, {lit(second)}, b, 'seen ' || d FROM {name}_b WHERE c <> 5
  UNION ALL SELECT service_id, vehicle_id, c, 2, 'horn', 'Good', 'loud' FROM {name}_b WHERE c = 6
  UNION ALL SELECT service_id, vehicle_id, c, 2, 'tires', 'Good', 'second look' FROM {name}_b WHERE c = 8
)"""


def config_cte() -> str:
    """CTE cfg: a row per part with its name, prompt, number of components,
    their keys (ks) and prompt lines (ls)."""
    n = len(SEED_COMPONENTS)
    keys, names, descs, rubrics = (lst([c[i] for c in SEED_COMPONENTS]) for i in range(4))
    at = f"((p_partkey + i) % {n} + 1)"
    line = (f"'- ' || ({names})[{at}] || ' (' || ({keys})[{at}] || ')' "
            f"|| CASE WHEN p_partkey % 5 = 0 OR ({descs})[{at}] = '' THEN '' ELSE ': ' || ({descs})[{at}] END "
            f"|| CASE WHEN p_partkey % 4 = 0 OR ({rubrics})[{at}] = '' THEN '' ELSE chr(10) || '    Rubric: ' || ({rubrics})[{at}] END")
    return f"""cfg AS (
  SELECT config_id, name, prompt_text, n,
         list_transform(range(n), lambda i: ({keys})[{at}]) AS ks, list_transform(range(n), lambda i: {line}) AS ls
  FROM (SELECT *, '0000000000cfg' || p_partkey AS config_id, 'Assess part ' || p_partkey || '.' AS prompt_text,
               CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '!!!' WHEN 2 THEN 'My Config' WHEN 3 THEN 'my-config' ELSE p_name END AS name,
               CASE WHEN p_partkey % 7 <= 2 THEN 0 ELSE p_partkey % 3 + 1 END AS n FROM part)
)"""


def _mix(of: str, field: str, i: int = 0, seed: int = 42) -> str:
    """The generator's integer mix."""
    p, c = generate.PRIME, generate.salt(seed, field, i)
    x = f"((({of}) % {p}) * {generate.FACTOR} + {c}) % {p}"
    return f"((({x}) * (({x}) % 65536 + 1) + {c}) % {p})"


def generator_ctes() -> str:
    """CTEs gveh (vehicles), gsvc (generated services) and demo (curated ones)."""
    n_demo, (vlo, vhi), (slo, shi) = generate.N_DEMO, VEHICLES_PER_CUSTOMER, SERVICES_PER_VEHICLE
    sid = "service_id"

    def choice(items, field, i=0):
        return f"({lst(items)})[{_mix(sid, field, i)} % {len(items)} + 1]"

    tr = [choice(TREAD_CHOICES, "tires", i) for i in range(4)]
    fi = f"[{_mix(sid, 'brakes front')} % {len(FRONT_PAD_CHOICES)} + 1]"
    front = f"({lst([float(x) for x in FRONT_PAD_CHOICES])}){fi}"
    front_txt = f"({lst([str(x) for x in FRONT_PAD_CHOICES])}){fi}"
    rear = choice(REAR_PAD_CHOICES, "brakes rear")
    lo, hi = (round(v * 10) for v in BATTERY_VOLTS)
    v10 = f"({lo} + {_mix(sid, 'battery v')} % {hi - lo + 1})"
    alo, ahi = BATTERY_AGE_YEARS
    age = f"({alo} + {_mix(sid, 'battery age')} % {ahi - alo + 1})"
    temp = choice(AC_VENT_TEMPS, "ac")
    made = {
        "tires": (f"'Tread depth (32nds): LF ' || {tr[0]} || ', RF ' || {tr[1]} || ', LR ' || {tr[2]} || ', RR ' || {tr[3]} || '.'",
                  _tires_sql(*tr, BALANCED)),
        "brakes": (f"'Brake pad thickness: front ' || {front_txt} || 'mm, rear ' || {rear} || 'mm.'",
                   _brakes_sql(front, f"CAST({rear} AS DOUBLE)", BALANCED)),
        "battery": (f"'Battery: ' || ({v10} // 10) || '.' || ({v10} % 10) || 'V resting, age ' || {age} || ' yr.'",
                    _battery_sql(f"(CAST({v10} AS DOUBLE) / 10.0)", age, BALANCED)),
        "ac": (f"'A/C: vent temp ' || {temp} || '°F at max cool.'", _ac_sql(temp, BALANCED)),
    }
    obs = []
    for key in COMPONENT_KEYS:
        text, sev = made.get(key) or (f"({lst(PHRASES[key])})[{_mix(sid, key)} % 3 + 1]",
                                      f"(['Good', 'Upcoming', 'Urgent'])[{_mix(sid, key)} % 3 + 1]")
        obs.append(f"{{'h': {_mix(sid, 'rank ' + key)}, 'k': {lit(key)}, 't': {text}, 's': {sev}}}")
    clo, chi = COMPONENTS_PER_SERVICE
    demo = ", ".join(
        f"({i + 1}, {i + 1}, {i % 10 + 1}, {lit(DEMO_DATE)}, {lit(DEMO_SERVICE_TYPE)}, {lit(notes)}, {lit(','.join(flagged or []))}, {lit(json.dumps(gt))})"
        for i, (notes, flagged, gt) in enumerate(DEMO_SERVICES))
    cols = "service_id, vehicle_id, technician_id, service_date, service_type, service_performed, flagged_keys, ground_truth"
    return f"""
gown AS (
  SELECT c_custkey AS customer_id, c_custkey * {vhi} + unnest(range(1, {vlo} + {_mix('c_custkey', 'nv')} % {vhi - vlo + 1} + 1)) + {n_demo} AS vehicle_id FROM customer
),
gveh AS (
  SELECT vehicle_id, customer_id FROM gown
  UNION ALL SELECT unnest(range(1, {n_demo + 1})), (SELECT min(c_custkey) FROM customer)
),
gids AS (
  SELECT vehicle_id, vehicle_id * {shi} + unnest(range(1, {slo} + {_mix('vehicle_id', 'ns')} % {shi - slo + 1} + 1)) + {n_demo} AS service_id FROM gown
),
gobs AS (
  SELECT service_id, vehicle_id,
         list_sort([{', '.join(obs)}])[1:{clo} + {_mix(sid, 'n')} % {chi - clo + 1}] AS obs FROM gids
),
gurg AS (SELECT *, list_filter(obs, lambda o: o.s = 'Urgent') AS urgent FROM gobs),
gsvc AS (
  SELECT service_id, vehicle_id, 1 + {_mix(sid, 'tech')} % {N_TECHNICIANS} AS technician_id,
         CAST(DATE {lit(generate.AS_OF)} - CAST({_mix(sid, 'day')} % {SERVICE_DAYS_BACK + 1} AS INTEGER) AS VARCHAR) AS service_date,
         {choice(SERVICE_TYPES, 'type')} AS service_type,
         array_to_string(list_transform(obs, lambda o: o.t), ' ') AS service_performed,
         CASE WHEN len(urgent) > 0 THEN urgent[{_mix(sid, 'flag')} % greatest(len(urgent), 1) + 1].k ELSE '' END AS flagged_keys,
         '{{' || array_to_string(list_transform(obs, lambda o: '"' || o.k || '": "' || o.s || '"'), ', ') || '}}' AS ground_truth
  FROM gurg
),
demo AS (SELECT * FROM (VALUES {demo}) AS v({cols}))"""


def oracle_sql() -> dict[str, str]:
    catch = "(NOT technician_flagged AND classification IN ('Urgent', 'Upcoming'))"
    out: dict[str, str] = {}
    out["sample_services"] = _q("""
SELECT service_id, service_type, service_performed, coalesce(flag1, '') AS flagged_keys
FROM svc ORDER BY service_id LIMIT 50""")
    out["extract_readings"] = _q(f"""
SELECT service_id,
  {_num(_sentence('service_performed', TIRES_RE), TIRES_RE, 1, 'INTEGER')} AS tread_lf,
  {_num(_sentence('service_performed', TIRES_RE), TIRES_RE, 2, 'INTEGER')} AS tread_rf,
  {_num(_sentence('service_performed', TIRES_RE), TIRES_RE, 3, 'INTEGER')} AS tread_lr,
  {_num(_sentence('service_performed', TIRES_RE), TIRES_RE, 4, 'INTEGER')} AS tread_rr,
  {_num(_sentence('service_performed', BRAKES_RE), BRAKES_RE, 1, 'DOUBLE')} AS pad_front_mm,
  {_num(_sentence('service_performed', BRAKES_RE), BRAKES_RE, 2, 'DOUBLE')} AS pad_rear_mm,
  {_num(_sentence('service_performed', BATTERY_RE), BATTERY_RE, 1, 'DOUBLE')} AS battery_volts,
  {_num(_sentence('service_performed', BATTERY_RE), BATTERY_RE, 2, 'INTEGER')} AS battery_age_yr,
  {_num('service_performed', AC_RE, 1, 'INTEGER')} AS ac_vent_f
FROM svc""")
    out["rule_severity"] = _q("""
SELECT service_id, component_key, classification, reasoning FROM a""", ("a", ALL, BALANCED))
    out["score_notes"] = _q("""
SELECT service_id, component_key, classification FROM a""", ("a", DEMO, BALANCED))
    out["assessments"] = _q("""
SELECT service_id, service_performed, component_key, classification, reasoning, technician_flagged
FROM a""", ("a", ALL, BALANCED))
    out["ai_catches"] = _q(f"""
SELECT service_id, component_key, classification, technician_flagged, {catch} AS ai_catch,
       CASE WHEN technician_flagged THEN 'Yes' WHEN {catch} THEN 'AI catch' ELSE 'No' END AS status
FROM a""", ("a", DEMO, BALANCED))
    out["catch_count"] = _q(f"""
SELECT component_key, CAST(count(*) FILTER (WHERE {catch}) AS BIGINT) AS n_catches
FROM a GROUP BY component_key""", ("a", DEMO, BALANCED))
    out["run_config"] = _q("""
SELECT service_id, service_performed, component_key, classification, reasoning, technician_flagged
FROM a""", ("a", DEMO, BALANCED))
    dist = """
dist AS (
  SELECT coalesce(NULLIF(component_key, ''), '?') AS component_key,
         coalesce(NULLIF(classification, ''), '?') AS classification,
         CAST(count(*) AS BIGINT) AS n
  FROM a GROUP BY 1, 2
)"""
    out["distribution"] = _with(fixture_ctes(), scored_cte("a", ALL, BALANCED), dist) + \
        "SELECT component_key, classification, n FROM dist"
    out["distribution_share"] = _with(fixture_ctes(), scored_cte("a", ALL, BALANCED), dist) + """
SELECT component_key, classification, n, total,
       CAST(n AS DOUBLE) / greatest(total, 1) AS share,
       CAST(CASE classification WHEN 'Urgent' THEN 1 WHEN 'Upcoming' THEN 2 ELSE 3 END AS INTEGER)
         AS class_order
FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY component_key) AS BIGINT) AS total FROM dist) x
WHERE classification IN ('Urgent', 'Upcoming', 'Good')"""
    out["distribution_pivot"] = _q("""
SELECT coalesce(NULLIF(component_key, ''), '?') AS component_key,
       CAST(count(*) FILTER (WHERE classification = 'Urgent') AS BIGINT) AS urgent,
       CAST(count(*) FILTER (WHERE classification = 'Upcoming') AS BIGINT) AS upcoming,
       CAST(count(*) FILTER (WHERE classification = 'Good') AS BIGINT) AS good,
       CAST(count(*) FILTER (WHERE coalesce(NULLIF(classification, ''), '?')
                             NOT IN ('Urgent', 'Upcoming', 'Good')) AS BIGINT) AS other,
       CAST(count(*) AS BIGINT) AS total
FROM a GROUP BY 1""", ("a", ALL, BALANCED))
    out["dedupe_assessments"] = _q("""
SELECT service_id, component_key, classification, reasoning FROM (
  SELECT *, row_number() OVER (PARTITION BY service_id, component_key
                               ORDER BY seq DESC, pos DESC) AS rn
  FROM (SELECT service_id, component_key, classification, reasoning, pos, 0 AS seq FROM a
        UNION ALL
        SELECT service_id, component_key, classification, reasoning, pos, 1 AS seq FROM b) u
) x WHERE rn = 1""", ("a", ALL, BALANCED), ("b", Q.CONFIGS["strict"].keys, STRICT))
    cmp_body = """
cmp AS (
  SELECT coalesce(a.service_id, b.service_id) AS service_id,
         CASE WHEN a.service_id IS NOT NULL THEN a.component_key ELSE b.component_key END
           AS component_key,
         CASE WHEN a.service_id IS NOT NULL THEN a.service_performed ELSE b.service_performed END
           AS service_performed,
         a.classification AS a_classification, a.reasoning AS a_reasoning,
         b.classification AS b_classification, b.reasoning AS b_reasoning,
         a.classification IS DISTINCT FROM b.classification AS differs
  FROM a FULL OUTER JOIN b
    ON a.service_id = b.service_id AND a.component_key IS NOT DISTINCT FROM b.component_key
)"""
    cmp = _with(fixture_ctes(), scored_cte("a", DEMO, BALANCED), scored_cte("b", DEMO, STRICT), cmp_body)
    out["compare_rows"] = cmp + "SELECT * FROM cmp"
    out["compare_diffs_only"] = cmp + "SELECT * FROM cmp WHERE differs"
    out["compare_summary"] = cmp + """
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE differs) AS BIGINT) AS disagreements FROM cmp"""
    urgent = """
urg AS (
  SELECT service_id, vehicle_id,
         coalesce(string_agg(component_key || ': ' || reasoning, '; '
                             ORDER BY component_key || ': ' || reasoning), '') AS urgent_reasons
  FROM a WHERE classification = 'Urgent' GROUP BY service_id, vehicle_id
),
uf AS (
  SELECT u.service_id, u.vehicle_id, c.customer_id, c.first_name, c.last_name, c.email,
         v.make, v.model, u.urgent_reasons
  FROM urg u JOIN veh v ON u.vehicle_id = v.vehicle_id
             JOIN cust c ON v.customer_id = c.customer_id
)"""
    uf = _with(fixture_ctes(), scored_cte("a", ALL, BALANCED), urgent)
    out["urgent_findings"] = uf + "SELECT * FROM uf"
    out["email_prompts"] = uf + f"""
SELECT service_id, customer_id,
       {lit(EMAIL_PROMPT_INTRO)} || 'Customer: ' || first_name || ' ' || last_name ||
       '. Vehicle: ' || make || ' ' || model || '. Findings needing attention: ' ||
       urgent_reasons || {lit(EMAIL_PROMPT_OUTRO)} AS email_prompt
FROM uf"""
    out["recommendations"] = _q("""
SELECT service_id, vehicle_id, service_performed, component_key, classification, reasoning,
       technician_flagged
FROM a""", ("a", ALL, BALANCED))
    out["followup_emails"] = uf + f"""
SELECT *,
  'Dear ' || first_name || ' ' || last_name || {lit("," + chr(10) * 2 + "Thank you for bringing your ")}
  || make || ' ' || model ||
  ' in for service. Our technician found items that need attention soon: ' || urgent_reasons ||
  {lit("." + chr(10) * 2 + "Please reply to this message to schedule the work at a time that suits you."
       + chr(10) * 2 + "Best regards," + chr(10) + "Your service team")} AS custom_email
FROM uf"""
    out["full_run_emails"] = out["followup_emails"]
    out["ledger_answers"] = _with(fixture_ctes()) + """
SELECT service_id, 'tires' AS component_key, 'Good' AS classification, substr(service_performed, 1, 24) AS reasoning,
       coalesce(flag1 = 'tires', false) AS technician_flagged FROM svc"""
    out["run_results"] = _q(f"""
SELECT {lit(Q.RUN_ID)} AS run_id, CAST(coalesce(service_id, 0) AS BIGINT) AS service_id,
       component_key, classification, reasoning
FROM a""", ("a", DEMO, BALANCED))
    out["selected_components"] = _q(f"""
SELECT service_id, component_key, classification, reasoning FROM a
WHERE component_key IN ({', '.join(lit(k) for k in Q.SELECTED)})""", ("a", ALL, BALANCED))
    vcols = "vehicle_id, customer_id, make, model, year, vin"
    merge_ctes = f"""
tgt AS (SELECT {vcols} FROM veh WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00'),
bat AS (SELECT vehicle_id, customer_id, make, model, CAST(year + 1 AS INTEGER) AS year, vin
        FROM veh WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00')"""
    out["merge_insert_only"] = _with(fixture_ctes(), merge_ctes) + """
SELECT * FROM tgt
UNION ALL
SELECT * FROM bat WHERE NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.vehicle_id = bat.vehicle_id)"""
    out["merge_upsert"] = _with(fixture_ctes(), merge_ctes) + """
SELECT * FROM tgt WHERE NOT EXISTS (SELECT 1 FROM bat WHERE bat.vehicle_id = tgt.vehicle_id)
UNION ALL
SELECT * FROM bat"""
    out["delete_by_keys"] = _with(fixture_ctes()) + f"""
SELECT {vcols} FROM veh
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F'
                                           AND o.o_orderkey = veh.vehicle_id)"""
    out["table_status"] = _with(fixture_ctes()) + """
SELECT table_name, n, bool_and(coalesce(n, 0) > 0) OVER () AS ready FROM (
  SELECT 'customer' AS table_name, CAST(count(*) AS BIGINT) AS n FROM cust
  UNION ALL SELECT 'vehicle', CAST(count(*) AS BIGINT) FROM veh
  UNION ALL SELECT 'technician', CAST(count(*) AS BIGINT) FROM tech
  UNION ALL SELECT 'service', CAST(count(*) AS BIGINT) FROM svc) x"""
    clean = response_ctes(0, "x")
    out["clean_responses"] = _with(fixture_ctes(), clean) + """
SELECT service_id, component_key, classification, reasoning FROM x WHERE c >= 4"""
    out["parse_status"] = _with(fixture_ctes(), clean) + """
SELECT CASE WHEN c = 0 THEN 'no_answer' WHEN c IN (1, 2, 4) THEN 'unparsed' WHEN c = 3 THEN 'empty' ELSE 'ok' END AS status,
       CAST(count(*) AS BIGINT) AS services,
       CAST(sum(CASE WHEN c < 5 THEN 0 WHEN c = 5 THEN 1 WHEN c IN (6, 8) THEN 3 ELSE 2 END) AS BIGINT) AS assessments
FROM x_b GROUP BY 1"""
    out["contract_violations"] = _with(fixture_ctes(), clean) + """
SELECT service_id, unnest(['tires', 'brakes']) AS component_key, 'missing' AS violation FROM x_b WHERE c < 5
UNION ALL SELECT service_id, 'brakes', 'missing' FROM x_b WHERE c = 5
UNION ALL SELECT service_id, 'horn', 'unexpected' FROM x_b WHERE c = 6
UNION ALL SELECT service_id, 'tires', 'bad_class' FROM x_b WHERE c = 7
UNION ALL SELECT service_id, unnest(['tires', '', '']), unnest(['missing', 'unexpected', 'bad_class']) FROM x_b WHERE c = 10"""
    out["response_distribution"] = _with(fixture_ctes(), clean) + """
SELECT coalesce(NULLIF(component_key, ''), '?') AS component_key,
       coalesce(NULLIF(classification, ''), '?') AS classification, CAST(count(*) AS BIGINT) AS n
FROM x WHERE c >= 4 GROUP BY 1, 2"""
    two = _with(fixture_ctes(), clean, response_ctes(1, "y"), """
ra AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id, component_key ORDER BY pos DESC) AS rn
                      FROM x WHERE c >= 4) WHERE rn = 1),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id, component_key ORDER BY pos DESC) AS rn
                      FROM y WHERE c >= 4) WHERE rn = 1)""")
    out["dedupe_stored"] = two + """
SELECT service_id, component_key, classification, reasoning FROM rb
UNION ALL SELECT service_id, component_key, classification, reasoning FROM ra
WHERE NOT EXISTS (SELECT 1 FROM rb WHERE rb.service_id = ra.service_id AND rb.component_key = ra.component_key)"""
    out["compare_stored"] = two + """
SELECT coalesce(ra.service_id, rb.service_id) AS service_id, coalesce(ra.component_key, rb.component_key) AS component_key,
       svc.service_performed,
       ra.classification AS a_classification, ra.reasoning AS a_reasoning,
       rb.classification AS b_classification, rb.reasoning AS b_reasoning,
       ra.classification IS DISTINCT FROM rb.classification AS differs
FROM ra FULL OUTER JOIN rb ON ra.service_id = rb.service_id AND ra.component_key = rb.component_key
LEFT JOIN svc ON svc.service_id = coalesce(ra.service_id, rb.service_id)"""
    out["runs_compare_totals"] = two + """
SELECT CAST((SELECT count(*) FROM ra FULL OUTER JOIN rb ON ra.service_id = rb.service_id AND ra.component_key = rb.component_key) + (SELECT count(*) FROM ra) AS BIGINT) AS total,
       CAST((SELECT count(*) FROM ra FULL OUTER JOIN rb ON ra.service_id = rb.service_id AND ra.component_key = rb.component_key
             WHERE ra.classification IS DISTINCT FROM rb.classification) AS BIGINT) AS disagreements"""
    out["urgent_findings_stored"] = _with(fixture_ctes(), clean, """
urg AS (
  SELECT service_id, vehicle_id,
         coalesce(string_agg(component_key || ': ' || reasoning, '; '
                             ORDER BY component_key || ': ' || reasoning), '') AS urgent_reasons
  FROM x WHERE c >= 4 AND classification = 'Urgent' GROUP BY service_id, vehicle_id
)""") + """
SELECT u.service_id, u.vehicle_id, c.customer_id, c.first_name, c.last_name, c.email, v.make, v.model, u.urgent_reasons
FROM urg u JOIN veh v ON u.vehicle_id = v.vehicle_id JOIN cust c ON v.customer_id = c.customer_id
WHERE v.o_orderdate < TIMESTAMP '1999-01-01 00:00:00'"""
    out["answer_faults"] = _with(fixture_ctes(), clean) + """
SELECT service_id,
       CASE c WHEN 0 THEN 'no_answer' WHEN 1 THEN 'prose' WHEN 2 THEN 'truncated' WHEN 3 THEN 'empty' WHEN 4 THEN 'fenced' ELSE 'ok' END AS fault,
       CAST(CASE WHEN c IN (0, 1, 3) THEN 0 WHEN c IN (2, 5) THEN 1 WHEN c IN (6, 8) THEN 3 ELSE 2 END AS INTEGER) AS whole_entries,
       CAST(CASE WHEN c = 2 THEN 1 END AS INTEGER) AS broken_at FROM x_b"""
    runs = _with(fixture_ctes(), clean, response_ctes(1, "y"), """
r AS (SELECT coalesce(NULLIF(component_key, ''), '?') AS k, coalesce(NULLIF(classification, ''), '?') AS cl, component_key, classification FROM x WHERE c >= 4
      UNION ALL SELECT coalesce(NULLIF(component_key, ''), '?'), coalesce(NULLIF(classification, ''), '?'), component_key, classification FROM y WHERE c >= 4)""")
    out["runs_distribution"] = runs + f"""
SELECT k AS component_key, cl AS classification, n, total, CAST(n AS DOUBLE) / total AS share,
       CAST(list_position({lst(CLASSES)}, cl) AS INTEGER) AS class_order
FROM (SELECT k, cl, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (PARTITION BY k) AS BIGINT) AS total FROM r GROUP BY k, cl)
WHERE cl IN ({', '.join(lit(c) for c in CLASSES)})"""
    out["runs_pivot"] = runs + f"""
SELECT k AS component_key, {', '.join(f"count(*) FILTER (cl = {lit(c)}) AS {c.lower()}" for c in CLASSES)},
       count(*) FILTER (cl NOT IN ({', '.join(lit(c) for c in CLASSES)})) AS other, count(*) AS total FROM r GROUP BY k"""
    out["runs_catches"] = runs + """
SELECT component_key, count(*) FILTER (classification IN ('Urgent', 'Upcoming')) AS n_catches FROM r GROUP BY component_key"""
    out["upsert_stored"], out["insert_stored"], out["delete_stored"] = out["merge_upsert"], out["merge_insert_only"], out["delete_by_keys"]
    out["urgent_findings_bucketed"] = out["urgent_findings_stored"]
    out["stored_status"] = """
SELECT 'customer' AS table_name, CAST(count(*) AS BIGINT) AS n, false AS ready FROM customer
UNION ALL SELECT 'vehicle', count(*), false FROM orders UNION ALL SELECT 'technician', count(*), false FROM supplier
UNION ALL SELECT 'service', NULL, false"""
    out["config_components"] = "WITH " + config_cte() + """
SELECT config_id, CAST(n AS INTEGER) AS n, array_to_string(ks, ',') AS keys FROM cfg"""
    out["composed_prompts"] = "WITH " + config_cte() + f"""
SELECT config_id, prompt_text || {lit(CONTRACT_PREFIX)} || array_to_string(ks, ', ') || {lit(CONTRACT_SUFFIX)} AS full_prompt FROM cfg"""
    header, footer = chr(10).join(DEFAULT_PROMPT_HEADER), chr(10).join(DEFAULT_PROMPT_FOOTER)
    out["default_prompts"] = "WITH " + config_cte() + f"""
SELECT config_id, {lit(header)} || CASE WHEN n > 0 THEN chr(10) || array_to_string(ls, chr(10)) ELSE '' END
       || chr(10) || {lit(footer)} AS default_prompt FROM cfg"""
    out["output_prefixes"] = "WITH " + config_cte() + """
SELECT config_id, coalesce(NULLIF(lower(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'config')
       || '_' || config_id AS output_prefix FROM cfg"""
    out["generate_sample"] = _with(generator_ctes()) + """
SELECT service_id, vehicle_id, CAST(technician_id AS INTEGER) AS technician_id, service_date, service_type,
       service_performed, flagged_keys, ground_truth FROM gsvc
UNION ALL SELECT service_id, vehicle_id, technician_id, service_date, service_type, service_performed, flagged_keys, ground_truth FROM demo"""
    pad = "CASE WHEN length(CAST({0} AS VARCHAR)) < {1} THEN lpad(CAST({0} AS VARCHAR), {1}, '0') ELSE CAST({0} AS VARCHAR) END"
    out["generate_linked"] = _with(generator_ctes()) + f"""
SELECT s.service_id, s.vehicle_id, v.customer_id, '1HGBH41JX' || {pad.format('s.vehicle_id', 8)} AS vin,
       '555-' || {pad.format('v.customer_id', 7)} AS phone
FROM (SELECT service_id, vehicle_id FROM gsvc UNION ALL SELECT service_id, vehicle_id FROM demo) s
LEFT JOIN gveh v ON s.vehicle_id = v.vehicle_id"""
    out["confusion"] = _q("""
SELECT component_key,
       coalesce(json_extract_string(ground_truth, '$.' || component_key), 'Good') AS truth,
       classification AS predicted, CAST(count(*) AS BIGINT) AS n
FROM a GROUP BY 1, 2, 3""", ("a", ALL, STRICT))
    return out
