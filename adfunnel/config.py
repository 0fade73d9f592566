"""Run configuration and the fixed values the funnel semantics depend on.

Everything a user may want to change lives in :class:`FunnelConfig`; the
module-level constants below are fixed values that must stay exactly as
written for results to agree with the dashboard being re-implemented.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the original dashboard's behaviour; keep verbatim)
# ---------------------------------------------------------------------------

# Header aliases per canonical column, in priority order (first present wins).
# Headers are compared after strip + lower + " " -> "_".
ADS_ALIASES: dict[str, list[str]] = {
    "date": ["date", "data"],
    "campaign": ["campaign_name", "campaign", "campanha", "nome_da_campanha"],
    "adset": ["ad_set_name", "adset_name", "adset", "conjunto_de_anuncios", "nome_do_conjunto_de_anuncios"],
    "creative": ["ad_name", "creative", "criativo", "nome_do_anuncio", "nome_do_criativo"],
    "spend": ["spend", "amount_spent", "valor_gasto", "gasto", "spend_(cost,_amount_spent)"],
    "impressions": ["impressions", "impressoes"],
    "clicks": ["clicks", "cliques", "action_link_clicks"],
    "reach": ["reach_(estimated)", "reach", "alcance"],
}
LEADS_ALIASES: dict[str, list[str]] = {
    "date": ["data_padrão", "submitted_at", "date", "data"],
    "email": ["qual_é_o_e-mail_você_mais_utiliza?", "email"],
    "campaign": ["utm_campaign", "campaign", "campaign_name", "campanha"],
    "adset": ["utm_medium", "ad_set_name", "adset", "conjunto_de_anuncios"],
    "creative": ["utm_content", "ad_name", "creative", "criativo", "anuncio"],
}
APPOINTMENTS_ALIASES: dict[str, list[str]] = {
    "date": ["data_entrada_agendamento", "date", "data"],
    "email": ["email"],
    "campaign": ["utm_campaign", "campaign", "campanha"],
    "adset": ["utm_medium", "adset"],
    "creative": ["utm_content", "creative", "criativo"],
}
SALES_ALIASES: dict[str, list[str]] = {
    "date": ["data_compra", "date", "data"],
    "email": ["e-mail_lead", "email"],
    "revenue": ["valor_total_da_venda_(ticket)", "revenue", "receita", "valor", "sale_value"],
    "campaign": ["utm_campaign", "campaign", "campanha"],
    "adset": ["utm_medium", "adset"],
    "creative": ["utm_content", "creative", "criativo"],
    "product": ["produto"],
    "origin": ["origem_macro", "origem", "origin"],
}
ALIASES = {
    "ads": ADS_ALIASES,
    "leads": LEADS_ALIASES,
    "appointments": APPOINTMENTS_ALIASES,
    "sales": SALES_ALIASES,
}
# Columns without which the ads table cannot be processed at all.
ADS_REQUIRED = ["date", "spend", "impressions", "clicks"]

# Date formats tried in order (Spark pattern, DuckDB strptime pattern).
# The first five are the original cascade; the last two replace its
# row-order-dependent "guess" step with explicit ISO date-times.
DATE_FORMATS: list[tuple[str, str]] = [
    ("yyyy-M-d", "%Y-%m-%d"),
    ("d/M/yyyy", "%d/%m/%Y"),
    ("d/M/yyyy H:m:s", "%d/%m/%Y %H:%M:%S"),
    ("d-M-yyyy", "%d-%m-%Y"),
    ("d-M-yyyy H:m:s", "%d-%m-%Y %H:%M:%S"),
    ("yyyy-M-d H:m:s", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-M-d'T'H:m:s", "%Y-%m-%dT%H:%M:%S"),
]

# Formats that a column may vote for where the cascade fails (same pair), in
# the order that decides a tie; the day comes first unless the column says so.
GUESS_FORMATS: list[tuple[str, str]] = [
    ("d.M.yyyy", "%d.%m.%Y"),
    ("yyyy/M/d", "%Y/%m/%d"),
    ("M/d/yyyy", "%m/%d/%Y"),
    ("M-d-yyyy", "%m-%d-%Y"),
    ("d MMM yyyy", "%d %b %Y"),
    ("MMM d, yyyy", "%b %d, %Y"),
]

# Characters Python's str.strip() removes (str.isspace()), as one regex class
# usable by both Java regex and RE2.
WHITESPACE_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same set as a string of characters, built from the rule itself
# (every code point Python's str.isspace() accepts; all lie below U+3001).
WHITESPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Performance score: (metric, weight, lower_is_better), added in this order.
SCORE_WEIGHTS: list[tuple[str, float, bool]] = [
    ("roas", 0.45, False),
    ("cpl", 0.35, True),
    ("ctr", 0.20, False),
]
# Score bands: lowest score of each band, best first; below the last -> "critical".
SCORE_BANDS: list[tuple[int, str]] = [
    (80, "excellent"),
    (60, "good"),
    (40, "average"),
    (20, "poor"),
]
SCORE_BAND_FLOOR = "critical"

RANKING_SIZE = 5
ALERT_CAP = 20
RECOMMENDATION_CAP = 15
DIGEST_CAMPAIGNS = 10
DEFAULT_MISSING_SCORE = 50  # rows without a score (tree ad sets) count as 50

# Rule alerts: (rule_no, type, icon, metric, action).
ALERT_RULES: list[tuple[int, str, str, str, str]] = [
    (1, "warning", "📉", "CTR", "Testar novos criativos"),
    (2, "warning", "🔎", "Conversão", "Auditar landing page"),
    (3, "danger", "🚨", "CPL", "Pausar"),
    (4, "info", "📞", "Taxa de Agendamento", "Revisar processo comercial"),
    (5, "success", "🚀", "Score", "Escalar"),
    (6, "danger", "💸", "ROAS", "Pausar / Revisar"),
]
# Alert thresholds.
LOW_CTR = 1.0  # rule 1: 0 < ctr < 1
LP_CTR = 2.0  # rule 2: ctr > 2 and 0 < cvr < 3
LP_CVR = 3.0
CPL_FACTOR = 1.5  # rule 3: cpl > 1.5 x overall cpl
APPT_MIN_LEADS = 10  # rule 4: leads > 10 and appointment rate < 15
APPT_RATE = 15.0
SCALE_SCORE = 80  # rule 5: creative score >= 80
BREAKEVEN_ROAS = 1.0  # rule 6: 0 < roas < 1

# Recommendations: (action, colour) for score >= 80, <= 30, otherwise.
RECOMMEND_SCALE = (80, "Escalar", "success")
RECOMMEND_PAUSE = (30, "Pausar", "danger")
RECOMMEND_TEST = ("Testar Variações", "warning")

# Display classes of the table cells and the KPI card.
CPL_GOOD_FACTOR = 0.8
CPL_BAD_FACTOR = 1.3
CTR_GOOD = 2.0
CTR_BAD = 0.8
ROAS_GOOD = 4.0
ROAS_BAD = 1.5
KPI_ROAS_GOOD = 3.0
KPI_ROAS_BAD = 1.0
# Chart bar classes by campaign score (missing score counts as 50).
CHART_BANDS: list[tuple[int, str]] = [(80, "green"), (60, "blue"), (40, "amber")]
CHART_BAND_FLOOR = "red"
CHART_METRICS = ["cpl", "roas", "leads", "ctr", "spend"]
SORTABLE_COLUMNS = [
    "name", "spend", "leads", "cpl", "ctr", "conversion_rate",
    "appointments", "sales", "roas", "cac", "performance_score",
]

# Refresh cadence (seconds).
DATA_REFRESH_SECONDS = 60
INSIGHTS_REFRESH_SECONDS = 300

# Default first day of the reporting window.
DEFAULT_DATE_START = "2025-12-01"


def today_utc() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d")


@dataclass(frozen=True)
class FunnelConfig:
    """Parameters of one funnel run.

    ``date_end`` defaults to today's UTC date, captured once when the config
    is resolved (so every table of one run sees the same end day).
    """

    date_start: str | None = None
    date_end: str | None = None
    ads_keyword: str = "LEADS"
    leads_keyword: str = "PRO"
    sales_product: str = "MENTORIA OPTICAL PRO"
    sales_origin: str = "TRÁFEGO PAGO"
    campaign_filter: str | None = None
    weights: tuple = field(default_factory=lambda: tuple(SCORE_WEIGHTS))

    def resolved(self) -> "FunnelConfig":
        return replace(
            self,
            date_start=self.date_start or DEFAULT_DATE_START,
            date_end=self.date_end or today_utc(),
        )


# Output text (Portuguese, as shown by the dashboard).  Placeholders:
# {field} -> integer / text, {field:.Nf} -> fixed-point with N decimals.
ALERT_VALUE_TEMPLATES: dict[int, str] = {
    1: "{ctr:.2f}%",
    2: "CTR {ctr:.1f}% / CVR {conversion_rate:.1f}%",
    3: "R$ {cpl:.2f}",
    4: "{appointment_rate:.1f}%",
    5: "{score}/100",
    6: "{roas:.2f}x",
}
ALERT_MESSAGE_TEMPLATES: dict[int, str] = {
    1: "CTR baixo ({ctr:.2f}%) em {level} '{name}' — revisar criativos ou segmentação.",
    2: "CTR alto com baixa conversão em '{name}' — possível problema na landing page.",
    3: "CPL de R$ {cpl:.2f} em '{name}' está {cpl_excess_pct:.0f}% acima da média — considerar pausar.",
    4: "Campanha '{name}' tem muitos leads mas baixa taxa de agendamento ({appointment_rate:.1f}%) — possível gargalo no time comercial.",
    5: "Criativo '{name}' com score {score}/100 — candidato para escalar budget.",
    6: "ROAS de {roas:.2f}x em '{name}' está abaixo do ponto de equilíbrio — revisar urgente.",
}
RECOMMEND_REASON_TEMPLATES: dict[str, str] = {
    "Escalar": "Score {score}/100 — performance acima da média",
    "Pausar": "Score {score}/100 — CPL R${cpl:.2f}, ineficiente",
    "Testar Variações": "Score {score}/100 — potencial de melhoria identificado",
}
DIGEST_SUMMARY_TEMPLATES: list[str] = [
    "- Gasto total: R$ {total_spend:.2f}",
    "- Receita: R$ {total_revenue:.2f}",
    "- ROAS geral: {overall_roas:.2f}x",
    "- CPL médio: R$ {overall_cpl:.2f}",
    "- CTR médio: {overall_ctr:.2f}%",
    "- Total leads: {total_leads}",
    "- Agendamentos: {total_appointments} (taxa: {lead_to_appt_rate:.1f}%)",
    "- Vendas: {total_sales} (taxa de fechamento: {appt_to_sale_rate:.1f}%)",
    "- CAC: R$ {overall_cac:.2f}",
]
DIGEST_CAMPAIGN_TEMPLATE = (
    "  • {name}: gasto R${spend:.0f}, leads={leads}, CPL=R${cpl:.2f}, "
    "CTR={ctr:.2f}%, ROAS={roas:.2f}x, vendas={sales}, score={score}"
)
DIGEST_TOP_TEMPLATE = "{name} (score {score})"
DIGEST_BOTTOM_TEMPLATE = "{name} (CPL R${cpl:.2f})"
DIGEST_NO_CAMPAIGNS = "Sem dados de campanhas."
DIGEST_NONE = "N/A"
