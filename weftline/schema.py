"""Names and numbers that several modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEASON = 52
#: Region names by group, in menu order.
GROUPS = ("서울특별시", "강북14개구", "강남11개구")
NORTH = ("강북구", "광진구", "노원구", "도봉구", "동대문구", "마포구", "서대문구", "성동구", "성북구", "용산구", "은평구", "종로구", "중구", "중랑구")
SOUTH = ("강남구", "강동구", "강서구", "관악구", "구로구", "금천구", "동작구", "서초구", "송파구", "양천구", "영등포구")
STOPS = ("6개광역시", "부산광역시", "대구광역시")
#: Model order and labels.
MODEL_LABELS = {
    "Naive": "Naive",
    "SeasonalNaive52": "Seasonal Naive 52주",
    "Drift": "Drift",
    "HoltLog": "Holt 로그 추세",
    "ARIMA(1,1,0)-log": "ARIMA(1,1,0) 로그",
    "ARIMA(0,1,1)-log": "ARIMA(0,1,1) 로그",
    "ML-HGBR": "Lag ML(HGBR)",
}
#: Sheet keywords with weights, and header hints.
KEYWORDS = {"구분": 2.4, "전국": 1.5, "서울": 1.2, "매매": 1.0, "지수": 1.0}


def region_dim(spark: SparkSession) -> DataFrame:
    """region, region_group, ord of the known regions: a fixed table of 28 rows."""
    heads = dict(zip(GROUPS, ("서울 전체", "강북권", "강남권"), strict=True))
    rows = [(r, heads.get(r) or ("강북권" if r in NORTH else "강남권"), k) for k, r in enumerate((*GROUPS, *NORTH, *SOUTH))]
    return spark.createDataFrame(rows, "region string, region_group string, ord int")


def monday(date: Column) -> Column:
    """The Monday of a date's week."""
    return F.to_date(F.date_trunc("week", date))


def rounded(x: Column, digits: int) -> Column:
    """By floor: the same in any engine, unlike round. A hair more than half keeps exact ties, at which sums differ in their last bit, off the edge."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5003).cast("double") / scale
