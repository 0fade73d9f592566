"""Spreadsheet exports (CSV, messy headers) through ingest and the funnel."""

from adfunnel import Funnel, FunnelConfig
from adfunnel.sources.ingest import load_raw, to_silver


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_funnel(spark, tmp_path):
    paths = {
        "ads": write(tmp_path / "ads.csv",
                     "Date,Campaign Name,Ad Set Name,Ad Name,Spend,Impressions,Clicks,Reach (Estimated)\n"
                     "01/12/2025,Promo LEADS PRO,Set 1,Video,\"R$ 1.000,00\",10000,100,5000\n"
                     "02/12/2025,Promo LEADS PRO,Set 1,Video,500.00,5000,50,2500\n"
                     "02/12/2025,Brand,Set 9,Img,900.00,1000,10,900\n"),
        "leads": write(tmp_path / "leads.csv",
                       "Data Padrão,Qual é o e-mail você mais utiliza?,utm_campaign,utm_medium,utm_content\n"
                       "01/12/2025, A@x.com ,promo leads pro,set 1,video\n"
                       "03/12/2025,b@x.com,Promo LEADS PRO,Set 1,Video\n"),
        "appointments": write(tmp_path / "appts.csv",
                              "Data Entrada Agendamento,Email,utm_campaign\n"
                              "04/12/2025,a@x.com,Promo LEADS PRO\n"
                              "04/12/2025,z@x.com,\n"),
        "sales": write(tmp_path / "sales.csv",
                       "Data Compra,E-mail Lead,Valor Total da Venda (Ticket),utm_campaign,Produto,Origem Macro\n"
                       "05/12/2025,a@x.com,\"2.000,00\",Promo LEADS PRO,Mentoria Optical PRO,Tráfego Pago\n"
                       "05/12/2025,b@x.com,\"9.999,00\",Promo LEADS PRO,Outro,Tráfego Pago\n"),
    }
    tables, res = to_silver(load_raw(spark, paths))
    f = Funnel(tables, FunnelConfig(date_start="2025-12-01", date_end="2025-12-31"), res)
    k = f.kpis.collect()[0]
    assert (k["total_spend"], k["total_leads"], k["total_appointments"], k["total_sales"]) == (1500.0, 2, 1, 1)
    assert (k["total_revenue"], k["overall_roas"], k["overall_cpl"], k["total_reach"]) == (2000.0, 1.33, 750.0, 7500)
    camp = [r for r in f.tree.collect() if r["level"] == "campaign"][0]
    assert (camp["name"], camp["leads"], camp["appointments"], camp["sales"], camp["revenue"]) == ("Promo LEADS PRO", 2, 1, 1, 2000.0)
    cre = [r for r in f.tree.collect() if r["level"] == "creative"][0]
    assert (cre["leads"], cre["appointments"], cre["sales"], cre["cpl"]) == (2, 1, 1, 750.0)
