"""DuckDB SQL for the correctness check.

Each query of the registry has an independent SQL formulation here that
derives the same funnel tables from ``lineitem``, ``orders`` and ``part``
and recomputes the operator.  The SQL is written from the operator
definitions, not generated from the Spark plans; only fixed values (alias
lists, thresholds, text templates) are shared.
"""

from __future__ import annotations

from .. import config as C
from ..functions.text import template_parts
from ..sources.fixtures import FIXTURE_CONFIG

START = FIXTURE_CONFIG.date_start
END = FIXTURE_CONFIG.date_end
WS = C.WHITESPACE_CLASS


# ---- scalar helpers ---------------------------------------------------------

def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def key(x: str) -> str:
    return f"lower({strip(x)})"


def sd(n: str, d: str) -> str:
    return f"(CASE WHEN CAST({d} AS DOUBLE) IS NULL OR CAST({d} AS DOUBLE) = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"


def r2(x: str) -> str:
    return f"(round_even(CAST({x} AS DOUBLE) * 100, 0) / 100)"


def big(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


def _cents(x: str) -> str:
    return f"CAST(round_even(CAST({x} AS DOUBLE) * 100, 0) AS BIGINT)"


def fmt2(x: str) -> str:
    k = _cents(x)
    return f"concat(CAST(CAST(floor({k} / 100) AS BIGINT) AS VARCHAR), '.', lpad(CAST({k} % 100 AS VARCHAR), 2, '0'))"


def fmt1(x: str) -> str:
    k = _cents(x)
    q = f"CAST(floor({k} / 10) AS BIGINT)"
    t = f"({q} + CASE WHEN {k} % 10 > 5 OR ({k} % 10 = 5 AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"concat(CAST(CAST(floor({t} / 10) AS BIGINT) AS VARCHAR), '.', CAST({t} % 10 AS VARCHAR))"


def fmt0(x: str) -> str:
    return f"CAST(CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT) AS VARCHAR)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render(template: str, fields: dict[str, str]) -> str:
    out = []
    for kind, value, digits in template_parts(template):
        if kind == "lit":
            out.append(lit(value))
        elif digits is None:
            out.append(f"CAST({fields[value]} AS VARCHAR)")
        else:
            out.append({0: fmt0, 1: fmt1, 2: fmt2}[digits](fields[value]))
    return "concat(" + ", ".join(out) + ")"


def score_cols(alias: str = "s") -> str:
    """performance_score / score_band from the pool stats joined as ``alias``."""
    total = "CAST(0.0 AS DOUBLE)"
    for metric, weight, invert in C.SCORE_WEIGHTS:
        mn, mx = f"{alias}.mn_{metric}", f"{alias}.mx_{metric}"
        norm = f"(t.{metric} - {mn}) / ({mx} - {mn})"
        if invert:
            norm = f"(1 - {norm})"
        norm = f"(CASE WHEN {mx} = {mn} THEN CAST(0.5 AS DOUBLE) ELSE {norm} END)"
        term = f"(CASE WHEN {mx} > 0 THEN {norm} * CAST({weight!r} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)"
        total = f"({total} + {term})"
    s = f"least(greatest(CAST(round_even({total} * 100, 0) AS INTEGER), 0), 100)"
    bands = " ".join(f"WHEN {s} >= {lo} THEN {lit(name)}" for lo, name in C.SCORE_BANDS)
    return f"{s} AS performance_score, CASE {bands} ELSE {lit(C.SCORE_BAND_FLOOR)} END AS score_band"


def scored(rel: str, pool: list[str] | None = None) -> str:
    """SELECT of ``rel`` with a score over the pool (global if no pool)."""
    stats = ", ".join(f"min({m}) AS mn_{m}, max({m}) AS mx_{m}" for m, _, _ in C.SCORE_WEIGHTS)
    if pool:
        cols = ", ".join(pool)
        cond = " AND ".join(f"t.{p} = s.{p}" for p in pool)
        return f"SELECT t.*, {score_cols()} FROM ({rel}) t JOIN (SELECT {cols}, {stats} FROM ({rel}) x GROUP BY {cols}) s ON {cond}"
    return f"SELECT t.*, {score_cols()} FROM ({rel}) t CROSS JOIN (SELECT {stats} FROM ({rel}) x) s"


TS_START = f"TIMESTAMP '{START} 00:00:00'"
TS_END = f"TIMESTAMP '{END} 00:00:00'"
TS_END_EXCL = f"(CAST(DATE '{END}' + INTERVAL 1 DAY AS TIMESTAMP))"
DAY_RANGE = f"date >= {TS_START} AND date < {TS_END_EXCL}"
MONEY = "DECIMAL(38,6)"


def _tree_select(src: str) -> str:
    return f"""SELECT level, concat_ws('|', campaign_key, adset_key, creative_key) AS id, campaign_key, adset_key, creative_key,
      name, campaign_name, adset_name,
      {r2('spend_d')} AS spend, {big('impressions')} AS impressions, {big('clicks')} AS clicks,
      CAST(leads AS BIGINT) AS leads, CAST(appointments AS BIGINT) AS appointments, CAST(sales AS BIGINT) AS sales,
      {r2('revenue_d')} AS revenue,
      {r2(sd('clicks', 'impressions') + ' * 100')} AS ctr,
      {r2(sd('spend_d', 'leads'))} AS cpl,
      {r2(sd('spend_d', 'sales'))} AS cac,
      {r2(sd('revenue_d', 'spend_d'))} AS roas,
      {r2(sd('leads', 'clicks') + ' * 100')} AS conversion_rate,
      {r2(sd('appointments', 'leads') + ' * 100')} AS appointment_rate,
      {r2(sd('sales', 'appointments') + ' * 100')} AS close_rate
    FROM {src}"""


def _consolidation(root: str) -> str:
    levels = {"campaign": ["campaign", "adset", "creative"], "adset": ["adset", "creative"], "creative": ["creative"]}[root]
    path_names = {
        "campaign": {"campaign": ["name"], "adset": ["campaign_name", "name"], "creative": ["campaign_name", "adset_name", "name"]},
        "adset": {"adset": ["name"], "creative": ["adset_name", "name"]},
        "creative": {"creative": ["name"]},
    }[root]
    parts = []
    for depth, level in enumerate(levels):
        ks = [key(n) for n in path_names[level]] + ["CAST(NULL AS VARCHAR)"] * (3 - len(path_names[level]))
        parts.append(
            f"SELECT '{level}' AS level, {depth} AS depth, {ks[0]} AS key0, {ks[1]} AS key1, {ks[2]} AS key2, name, "
            f"campaign_key, adset_key, creative_key, spend, impressions, clicks, leads, appointments, sales, revenue "
            f"FROM tree WHERE level = '{level}'"
        )
    rows = " UNION ALL ".join(parts)
    g = f"""SELECT level, depth, key0, key1, key2, coalesce(key2, key1, key0) AS id,
        arg_min(name, struct_pack(c := campaign_key, a := adset_key, r := creative_key)) AS name,
        min(struct_pack(c := campaign_key, a := adset_key, r := creative_key)) AS f,
        sum(CAST(spend AS DECIMAL(38,2))) AS s_spend, sum(impressions) AS impressions, sum(clicks) AS clicks,
        sum(leads) AS leads, sum(appointments) AS appointments, sum(sales) AS sales,
        sum(CAST(revenue AS DECIMAL(38,2))) AS s_revenue
      FROM ({rows}) GROUP BY level, depth, key0, key1, key2"""
    m = f"""SELECT level, depth, key0, key1, key2, id, name,
        {r2('CAST(s_spend AS DOUBLE)')} AS spend, CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks,
        CAST(leads AS BIGINT) AS leads, CAST(appointments AS BIGINT) AS appointments, CAST(sales AS BIGINT) AS sales,
        {r2('CAST(s_revenue AS DOUBLE)')} AS revenue,
        f.c AS first_campaign_key, f.a AS first_adset_key, f.r AS first_creative_key
      FROM ({g})"""
    mr = f"""SELECT *,
        {r2(sd('clicks', 'impressions') + ' * 100')} AS ctr,
        {r2(sd('spend', 'leads'))} AS cpl,
        {r2(sd('spend', 'sales'))} AS cac,
        {r2(sd('revenue', 'spend'))} AS roas,
        {r2(sd('leads', 'clicks') + ' * 100')} AS conversion_rate,
        {r2(sd('appointments', 'leads') + ' * 100')} AS appointment_rate,
        {r2(sd('sales', 'appointments') + ' * 100')} AS close_rate
      FROM ({m})"""
    pieces = [scored(f"SELECT * FROM ({mr}) WHERE depth = 0")]
    if len(levels) > 1:
        pieces.append(scored(f"SELECT * FROM ({mr}) WHERE depth = 1", ["key0"]))
    if len(levels) > 2:
        pieces.append(scored(f"SELECT * FROM ({mr}) WHERE depth = 2", ["key0", "key1"]))
    cols = (
        "level, depth, key0, key1, key2, id, name, spend, impressions, clicks, leads, appointments, sales, revenue, "
        "ctr, cpl, cac, roas, conversion_rate, appointment_rate, close_rate, performance_score, score_band, "
        "first_campaign_key, first_adset_key, first_creative_key"
    )
    return " UNION ALL ".join(f"SELECT {cols} FROM ({p})" for p in pieces)


def prelude() -> str:
    """CTEs shared by every oracle query."""
    campaign = "p_type || CASE WHEN p_type LIKE '%PROMO%' THEN ' BRAND PRO' WHEN p_type LIKE '%SMALL%' THEN ' LEADS' ELSE ' LEADS PRO' END"
    email = "'lead' || CAST(l_orderkey AS VARCHAR)"
    economy = "p_type LIKE '%ECONOMY%'"
    ordinal = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
    keys = "campaign, p_brand AS adset, p_name AS creative"
    d2 = lambda c: f"CAST({c} AS DECIMAL(18,2))"
    ctes = {
        "base": f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
              l_returnflag, l_linestatus, l_shipdate, o_orderdate, o_orderpriority, o_orderstatus, p_type, p_brand, p_name,
              {campaign} AS campaign
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
        "f_ads": f"""SELECT {ordinal}, l_orderkey * 8 + l_linenumber AS row_order, l_shipdate AS date, {keys},
              CAST({d2('l_extendedprice')} * {d2('l_discount')} AS {MONEY}) AS spend,
              l_quantity * 100 AS impressions, CAST(l_linenumber * 10 AS DOUBLE) AS clicks, l_quantity * 60 AS reach
            FROM base""",
        "f_leads": f"""SELECT {ordinal}, o_orderdate AS date, {email} AS email, {keys} FROM base
            WHERE l_returnflag IN ('A', 'R') AND (p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') OR l_linenumber = 1)""",
        "f_appts": f"""SELECT {ordinal}, l_shipdate AS date, {email} AS email, {keys} FROM base
            WHERE l_returnflag = 'R' AND o_orderpriority <> '5-LOW' AND (NOT {economy} OR o_orderpriority = '1-URGENT')""",
        "f_sales": f"""SELECT {ordinal}, l_shipdate AS date, {email} AS email,
              CAST({d2('l_extendedprice')} * (1 - {d2('l_discount')}) AS {MONEY}) AS revenue, {keys},
              CASE WHEN o_orderstatus = 'P' THEN 'Mentoria Basic' WHEN l_linenumber = 2 THEN ' mentoria optical pro '
                   ELSE 'Mentoria Optical PRO' END AS product,
              CASE WHEN o_orderpriority = '2-HIGH' AND l_linenumber = 1 THEN 'Orgânico' ELSE 'Tráfego Pago' END AS origin
            FROM base
            WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 2
              AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (NOT {economy} OR o_orderpriority = '1-URGENT')""",
        "ads_f": f"""SELECT * FROM f_ads WHERE coalesce(contains(upper(campaign), '{FIXTURE_CONFIG.ads_keyword}'), false)
              AND date >= {TS_START} AND date <= {TS_END}""",
        "leads_f": f"""SELECT * FROM f_leads WHERE coalesce(contains(upper(campaign), '{FIXTURE_CONFIG.leads_keyword}'), false) AND {DAY_RANGE}""",
        "appts_f": f"""SELECT * FROM f_appts WHERE coalesce({strip('campaign')} <> '', false) AND {DAY_RANGE}""",
        "sales_f": f"""SELECT * FROM f_sales WHERE upper({strip('product')}) = {lit(FIXTURE_CONFIG.sales_product)}
              AND upper({strip('origin')}) = {lit(FIXTURE_CONFIG.sales_origin)} AND {DAY_RANGE}""",
        "ads_k": f"""SELECT row_order,
              {strip('campaign')} AS c_name, lower({strip('campaign')}) AS campaign_key,
              {strip('adset')} AS a_name, lower({strip('adset')}) AS adset_key,
              {strip('creative')} AS r_name, lower({strip('creative')}) AS creative_key,
              spend, impressions, clicks, reach FROM ads_f""",
        "rollup_g": """SELECT campaign_key, adset_key, creative_key, sum(spend) AS spend_sum, sum(impressions) AS impressions,
              sum(clicks) AS clicks, sum(reach) AS reach,
              arg_min(c_name, struct_pack(o := row_order, n := c_name)) AS c_first,
              arg_min(a_name, struct_pack(o := row_order, n := a_name)) AS a_first,
              arg_min(r_name, struct_pack(o := row_order, n := r_name)) AS r_first,
              GROUPING(campaign_key, adset_key, creative_key) AS g
            FROM ads_k GROUP BY GROUPING SETS ((campaign_key), (campaign_key, adset_key), (campaign_key, adset_key, creative_key))""",
        "rollup": """SELECT CASE g WHEN 3 THEN 'campaign' WHEN 1 THEN 'adset' ELSE 'creative' END AS level, campaign_key,
              CASE WHEN g <= 1 THEN adset_key END AS adset_key, CASE WHEN g = 0 THEN creative_key END AS creative_key,
              CASE g WHEN 3 THEN c_first WHEN 1 THEN a_first ELSE r_first END AS name, spend_sum, impressions, clicks, reach
            FROM rollup_g
            WHERE campaign_key IS NOT NULL AND (g = 3 OR adset_key IS NOT NULL) AND (g <> 0 OR creative_key IS NOT NULL)""",
        "lvl": f"""SELECT DISTINCT level, campaign_key, adset_key, creative_key, email FROM (
              SELECT {key('email')} AS email, 'campaign' AS level, {key('campaign')} AS campaign_key,
                     CAST(NULL AS VARCHAR) AS adset_key, CAST(NULL AS VARCHAR) AS creative_key FROM leads_f
              UNION ALL SELECT {key('email')}, 'adset', {key('campaign')}, {key('adset')}, CAST(NULL AS VARCHAR) FROM leads_f
              UNION ALL SELECT {key('email')}, 'creative', {key('campaign')}, {key('adset')}, {key('creative')} FROM leads_f)
            WHERE email IS NOT NULL AND coalesce(campaign_key <> '', false)
              AND (level = 'campaign' OR coalesce(adset_key <> '', false))
              AND (level <> 'creative' OR coalesce(creative_key <> '', false))""",
        "outcomes": f"""SELECT email, max(has_appt) AS has_appt, max(has_sale) AS has_sale, sum(revenue) AS revenue FROM (
              SELECT {key('email')} AS email, 1 AS has_appt, 0 AS has_sale, CAST(0 AS {MONEY}) AS revenue FROM appts_f
              UNION ALL SELECT {key('email')}, 0, 1, revenue FROM sales_f) WHERE email IS NOT NULL GROUP BY email""",
        "lead_facts": f"""SELECT level, campaign_key, adset_key, creative_key, count(*) AS leads,
              CAST(sum(coalesce(has_appt, 0)) AS BIGINT) AS appointments, CAST(sum(coalesce(has_sale, 0)) AS BIGINT) AS sales,
              coalesce(sum(CASE WHEN has_sale = 1 THEN o.revenue END), CAST(0 AS {MONEY})) AS revenue
            FROM lvl LEFT JOIN outcomes o USING (email) GROUP BY level, campaign_key, adset_key, creative_key""",
        "appts_c": f"""SELECT {key('campaign')} AS campaign_key, count(DISTINCT {key('email')}) AS appointments
            FROM appts_f WHERE {key('campaign')} IS NOT NULL GROUP BY 1""",
        "sales_c": f"""SELECT campaign_key, count(DISTINCT email) AS sales, sum(revenue) AS revenue FROM (
              SELECT {key('campaign')} AS campaign_key, {key('email')} AS email, revenue FROM sales_f)
            WHERE coalesce(campaign_key <> '', false) GROUP BY campaign_key""",
        "camp_facts": f"""SELECT 'campaign' AS level, campaign_key, CAST(NULL AS VARCHAR) AS adset_key, CAST(NULL AS VARCHAR) AS creative_key,
              CAST(sum(leads) AS BIGINT) AS leads, CAST(sum(appointments) AS BIGINT) AS appointments,
              CAST(sum(sales) AS BIGINT) AS sales, sum(revenue) AS revenue FROM (
              SELECT campaign_key, leads, 0 AS appointments, 0 AS sales, CAST(0 AS {MONEY}) AS revenue FROM lead_facts WHERE level = 'campaign'
              UNION ALL SELECT campaign_key, 0, appointments, 0, CAST(0 AS {MONEY}) FROM appts_c
              UNION ALL SELECT campaign_key, 0, 0, sales, revenue FROM sales_c) GROUP BY campaign_key""",
        "facts_all": """SELECT * FROM camp_facts UNION ALL
            SELECT level, campaign_key, adset_key, creative_key, leads, appointments, sales, revenue FROM lead_facts WHERE level <> 'campaign'""",
        "tj": f"""SELECT r.level, r.campaign_key, r.adset_key, r.creative_key, r.name, CAST(r.spend_sum AS DOUBLE) AS spend_d,
              r.impressions, r.clicks, coalesce(f.leads, 0) AS leads, coalesce(f.appointments, 0) AS appointments,
              coalesce(f.sales, 0) AS sales, CAST(coalesce(f.revenue, CAST(0 AS {MONEY})) AS DOUBLE) AS revenue_d
            FROM rollup r LEFT JOIN facts_all f ON r.level = f.level AND r.campaign_key = f.campaign_key
              AND r.adset_key IS NOT DISTINCT FROM f.adset_key AND r.creative_key IS NOT DISTINCT FROM f.creative_key""",
        "tn": """SELECT tj.*, cn.cname AS campaign_name, an.aname AS adset_name FROM tj
            LEFT JOIN (SELECT campaign_key AS ck, name AS cname FROM rollup WHERE level = 'campaign') cn
              ON tj.campaign_key = cn.ck AND tj.level <> 'campaign'
            LEFT JOIN (SELECT campaign_key AS ck2, adset_key AS ak2, name AS aname FROM rollup WHERE level = 'adset') an
              ON tj.campaign_key = an.ck2 AND tj.adset_key = an.ak2 AND tj.level = 'creative'""",
        "tree0": _tree_select("tn"),
        "tree": f"""SELECT * FROM ({scored("SELECT * FROM tree0 WHERE level = 'campaign'")})
            UNION ALL SELECT *, CAST(NULL AS INTEGER) AS performance_score, CAST(NULL AS VARCHAR) AS score_band FROM tree0 WHERE level = 'adset'
            UNION ALL SELECT * FROM ({scored("SELECT * FROM tree0 WHERE level = 'creative'")})""",
        "cons_campaign": _consolidation("campaign"),
        "cons_adset": _consolidation("adset"),
        "cons_creative": _consolidation("creative"),
        "ads_tot": f"""SELECT coalesce(sum(spend_sum), CAST(0 AS {MONEY})) AS spend, coalesce(sum(impressions), 0.0) AS impressions,
              coalesce(sum(clicks), 0.0) AS clicks, coalesce(sum(reach), 0.0) AS reach FROM rollup WHERE level = 'campaign'""",
        "fun_tot": f"""SELECT (SELECT count(DISTINCT {key('email')}) FROM leads_f) AS total_leads,
              (SELECT count(DISTINCT {key('email')}) FROM appts_f) AS total_appointments,
              (SELECT count(DISTINCT {key('email')}) FROM sales_f) AS total_sales,
              (SELECT coalesce(sum(revenue), CAST(0 AS {MONEY})) FROM sales_f) AS revenue""",
        "kpis": f"""SELECT {r2('CAST(spend AS DOUBLE)')} AS total_spend, {r2('CAST(revenue AS DOUBLE)')} AS total_revenue,
              {r2(sd('CAST(revenue AS DOUBLE)', 'CAST(spend AS DOUBLE)'))} AS overall_roas,
              {r2(sd('CAST(spend AS DOUBLE)', 'total_leads'))} AS overall_cpl,
              {r2(sd('clicks', 'impressions') + ' * 100')} AS overall_ctr,
              CAST(total_leads AS BIGINT) AS total_leads, CAST(total_appointments AS BIGINT) AS total_appointments,
              CAST(total_sales AS BIGINT) AS total_sales,
              {r2(sd('CAST(spend AS DOUBLE)', 'total_sales'))} AS overall_cac,
              {r2(sd('total_appointments', 'total_leads') + ' * 100')} AS lead_to_appt_rate,
              {r2(sd('total_sales', 'total_appointments') + ' * 100')} AS appt_to_sale_rate,
              {r2(sd('CAST(spend AS DOUBLE)', 'impressions') + ' * 1000')} AS overall_cpm,
              {big('reach')} AS total_reach,
              {r2(sd('impressions', 'reach'))} AS overall_frequency,
              {r2(sd('clicks', 'reach') + ' * 100')} AS overall_connect_rate,
              {r2(sd('total_leads', 'clicks') + ' * 100')} AS overall_page_cvr
            FROM ads_tot CROSS JOIN fun_tot""",
    }
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())
