"""Hand-written funnel tables for the quirk tests."""

import datetime as dt
from decimal import Decimal

from adfunnel import FunnelConfig
from adfunnel.sources.fixtures import FunnelTables

ADS = "row_order long, date timestamp_ntz, campaign string, adset string, creative string, spend decimal(38,6), impressions double, clicks double, reach double"
LEADS = "date timestamp_ntz, email string, campaign string, adset string, creative string"
APPTS = "date timestamp_ntz, email string, campaign string"
SALES = "date timestamp_ntz, email string, revenue decimal(38,6), campaign string"

CFG = FunnelConfig(date_start="2025-12-01", date_end="2025-12-31")
D = dt.datetime(2025, 12, 10)


def ad(i, campaign, adset, creative, spend, imp=1000.0, clicks=20.0, reach=500.0, date=D):
    return (i, date, campaign, adset, creative, Decimal(str(spend)), imp, clicks, reach)


def lead(email, campaign, adset, creative, date=D):
    return (date, email, campaign, adset, creative)


def appt(email, campaign, date=D):
    return (date, email, campaign)


def sale(email, revenue, campaign, date=D):
    return (date, email, Decimal(str(revenue)), campaign)


def tables(spark, ads, leads=(), appts=(), sales=(), ads_schema=ADS):
    return FunnelTables(
        spark.createDataFrame(list(ads), ads_schema),
        spark.createDataFrame(list(leads), LEADS),
        spark.createDataFrame(list(appts), APPTS),
        spark.createDataFrame(list(sales), SALES),
    )


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
