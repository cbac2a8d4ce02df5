"""The test tables, projected to the shape the operators read (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.calendar import Campaign, Weeks, dayno_of
from footfall.sources.readers import lookup

SNAPSHOT = 20240131
AD_DAYS = (19950101, 20021231)
USE_DAYS = (20240101, 20240131)
CAMPAIGN = Campaign.from_days((20240101, 20240111, 20240121, 20240131))
WEEKS = Weeks(20240101, 4)
WEEKLY_TIME = 300.0
MIN_EXPOSURE = 10000
DAYS = list(range(20240101, 20240131))
CATEGORIES = [f"cat{i}" for i in range(1, 37)]
LDA_PARTITIONS = 8
LOST_APP = "Brand#3"
SEED_WORDS = ("thble", "thtion", "attion", "nicht")
ANY_WORDS = ("thble", "attion", "nicht")
PAIR_WORDS = (
    "thble", "thtion", "thing", "attion", "erble", "ertion", "ering", "thanea", "eriner", "oning", "antion", "ontion",
    "retion", "thanedble", "onble", "aning", "reing", "heble", "nicht", "ining", "anble", "ention", "inble", "edtion",
    "hation",
)
CHINESE = {"ation": "招聘", "tion": "岗位", "ung": "薪"}
CJK_STOP_WORDS = ["岗位", "the", "位"]
CITY_LEVELS = [
    ("AUTOMOBILE", "1"),
    ("BUILDING", "new1"),
    ("FURNITURE", "2"),
    ("HOUSEHOLD", "3"),
    ("MACHINERY", "other"),
]


def _text(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


class Views:
    """Views over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("imei"),
            "event_type",
            "value",
            dayno_of(F.col("ts")).alias("dayno"),
            F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
        )

    def _of_type(self, *types: str) -> DataFrame:
        app = _text("Brand#", F.floor(F.col("k") / 4) + 1)
        return self.events.where(F.col("event_type").isin(*types)).withColumn("appname", app)

    @property
    def app_use(self) -> DataFrame:
        return self._of_type("error", "view").select(
            "imei", "appname", _text("pkg_", F.col("k")).alias("pack_name"), F.col("value").alias("duration"), "dayno"
        )

    @property
    def all_use(self) -> DataFrame:
        return self.events.select(
            "imei", _text("pkg_", F.col("k")).alias("pack_name"), F.col("value").alias("duration"), "dayno"
        )

    @property
    def clicks(self) -> DataFrame:
        return self._of_type("click").select("imei", "appname", "dayno", F.lit(1).alias("click_nums"))

    @property
    def installs(self) -> DataFrame:
        upgrade = (F.col("value") >= 70).cast("int")
        return self._of_type("signup").select("imei", "appname", "dayno", upgrade.alias("is_upgrade_install"))

    @property
    def pay(self) -> DataFrame:
        ends = F.array(*(F.lit(p.hi) for p in CAMPAIGN.periods))
        paid = self._of_type("purchase").select("imei", "appname", F.col("dayno").alias("paid"))
        snapshots = paid.withColumn("dayno", F.explode(F.filter(ends, lambda d: d > F.col("paid"))))
        return snapshots.groupBy("imei", "appname", "dayno").agg(F.max("paid").alias("recent_pay_dayno"))

    @property
    def searches(self) -> DataFrame:
        text = F.concat(F.lit("get "), F.col("appname"), F.lit(" free"))
        return self._of_type("signup", "click").select("imei", text.alias("query"), "dayno")

    @property
    def browsers(self) -> DataFrame:
        return self.events.select("imei")

    @property
    def customers(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("imei"))

    @property
    def city_level(self) -> DataFrame:
        return lookup(self.spark, CITY_LEVELS, ["model", "city_level"])

    @property
    def people(self) -> DataFrame:
        key = F.col("c_custkey")
        customers = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return customers.select(
            key.alias("imei"),
            F.col("n_name").alias("city"),
            F.when(key % 3 != 2, (key % 3).cast("int")).alias("base_gender"),
            (F.col("c_nationkey") % 7).alias("base_age"),
            F.when(key % 11 != 0, F.floor("c_acctbal").cast("string")).alias("on_price"),
            F.col("c_mktsegment").alias("model"),
            F.lit(SNAPSHOT).alias("dayno"),
        )

    @property
    def ads(self) -> DataFrame:
        brand = F.substring("p_brand", 7, 3).cast("int")
        package = _text("pkg_", (brand - 1) * 4 + F.col("p_size") % 4)
        return self.table("part").select(
            F.col("p_partkey").alias("ad_id"),
            F.col("p_brand").alias("brand_name"),
            F.col("p_brand").alias("app_name"),
            F.col("p_type").alias("app_cat2_name"),
            package.alias("package_name"),
            F.lit(SNAPSHOT).alias("dayno"),
        )

    @property
    def ad_counts(self) -> DataFrame:
        """Exposures without their user, which the summary does not read."""
        return self.table("lineitem").select(
            F.col("l_partkey").alias("ad_id"),
            F.col("l_quantity").cast("long").alias("expose_cnt"),
            dayno_of(F.col("l_shipdate")).alias("dayno"),
            "l_orderkey",
        )

    @property
    def exposures(self) -> DataFrame:
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("imei"))
        return self.ad_counts.join(orders, "l_orderkey").drop("l_orderkey")

    @property
    def app_cat(self) -> DataFrame:
        kind = F.col("p_type")
        group = (
            F.when(kind.isin("PROMO", "SMALL"), "G").when(kind.isin("ECONOMY", "LARGE"), "H").otherwise("L")
        )
        return self.table("part").select(kind.alias("x"), group.alias("y")).distinct()

    @property
    def game_cat(self) -> DataFrame:
        games = self.table("part").where(F.col("p_type").isin("PROMO", "SMALL"))
        heavy = F.when(F.length("p_brand") == 8, "是").otherwise("否")
        return games.select(F.col("p_brand").alias("x"), F.col("p_type").alias("y"), heavy.alias("z")).distinct()

    @property
    def app_group(self) -> DataFrame:
        """One group per app, from the number in its name."""
        n = F.substring("p_brand", 7, 3).cast("int")
        group = F.when(n <= 6, "GH").when(n <= 12, "GL").when(n <= 18, "H").otherwise("L")
        return self.table("part").select(F.col("p_brand").alias("appname"), group.alias("hl")).distinct()

    @property
    def categories(self) -> DataFrame:
        k = F.col("k")
        return self.events.select(
            _text("pkg_", k).alias("pack_name"), _text("cat", F.floor(k * 36 / 100) + 1).alias("newcat")
        ).distinct()

    @property
    def places(self) -> DataFrame:
        k = F.col("k")
        return self.events.where(F.col("event_type").isin("click", "signup")).select(
            "imei",
            _text("poi_", k).alias("poi_name"),
            _text("l1_", F.floor(k / 20)).alias("level_1"),
            _text("l2_", F.floor(k / 10)).alias("level_2"),
            _text("l3_", F.floor(k / 5)).alias("level_3"),
            "dayno",
        )

    @property
    def ad_text(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), "text")

    @property
    def labelled_text(self) -> DataFrame:
        labels = self.table("labels").select(F.col("doc_id").alias("id"), "quality")
        return self.ad_text.join(labels, "id")
