"""Aliases of POI types: lines of words, the first of each is the type's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The types that users choose from, with their other names.
POI_TYPE_LINES = """
金融 财经
其他旅游景点 旅游景点 景点 其他景点
体育场馆 体育场 体育馆 运动场 运动场馆
极限运动场所 极限运动
高等院校 高校 大学
收费站
酒店 宾馆 旅店
游乐园 游乐场 游乐中心 游乐
写字楼
加油加气站 加油站 加油
公交车站 公交站 车站
港口
飞机场 机场
海滨浴场
政府机构 政府 政府机关
风景区 景区
健身中心 健身馆 健身 健身场所
大型购物 大型商场 大商场
桥 桥梁
公司
住宅区
农林园艺 园艺
厂矿 矿
停车场 停车
其他
文化传媒 传媒
地铁站 轨道交通 地铁
休闲娱乐 娱乐 休闲
其他教育
火车站 动车站
服务区 服务中心
长途汽车站 长途汽车
医疗 医院 诊所
小型购物
美食
园区
宿舍 寝室
""".strip().splitlines()


def _split(lines: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    rows = lines.select(words.alias("w")).where("size(w) > 0")
    # An alias on several lines belongs to the smallest type, so that a lookup never multiplies.
    return rows.select(F.explode("w").alias("alias"), F.element_at("w", 1).alias("poitype")).groupBy("alias").agg(F.min("poitype").alias("poitype"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, poitype from a text file."""
    return _split(spark.read.text(path))


def aliases(spark: SparkSession, lines: list[str] | None = None) -> DataFrame:
    return _split(spark.createDataFrame([(x,) for x in (POI_TYPE_LINES if lines is None else lines)], "value string"))
