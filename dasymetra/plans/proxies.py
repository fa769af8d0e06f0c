"""The concepts of the engine played by the star-schema tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dasymetra.operators import od as times
from dasymetra.operators import weights as wt
from dasymetra.plans.common import table


def zones(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("name"))


def sources(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_nationkey", "s_acctbal")


def minutes():
    z, k = F.col("zone_id"), F.col("source_id")
    t = F.abs(z - F.col("s_nationkey")) * 3 + k % 7 + 1
    return F.when((z * 31 + k * 17) % 11 == 0, F.lit(None)).otherwise(t).cast("double")


def od(s, d):
    pairs = times.dense(zones(s, d), sources(s, d)).select("zone_id", "source_id")
    return pairs.join(sources(s, d), "source_id").select("zone_id", "source_id", minutes().alias("minutes"))


def population(s, d):
    return table(s, d, "customer").groupBy(F.col("c_nationkey").alias("zone_id"), F.col("c_mktsegment").alias("bracket")).agg(F.count(F.lit(1)).alias("pop"))


def voters(s, d):
    lines, orders, customers = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "customer")
    sold = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return sold.groupBy(F.col("l_suppkey").alias("source_id"), F.col("c_mktsegment").alias("bracket")).agg(F.sum("l_quantity").alias("voters"))


def alpha(s, d):
    a = 1 + (F.col("zone_id") % 3) * 0.5 + (F.length("bracket") % 4) * 0.25
    return population(s, d).select("zone_id", "bracket", a.cast("double").alias("alpha"))


def source_weights(s, d):
    """One weight per pair with alpha 2, the same in every bracket."""
    return wt.normalised(od(s, d).filter(F.col("minutes").isNotNull()), ["source_id"], wt.log_kernel(F.col("minutes"), F.lit(2.0))).select("zone_id", "source_id", "w")


def fitted(s, d):
    return source_weights(s, d).join(voters(s, d), "source_id").groupBy("zone_id", "bracket").agg(F.sum(F.col("w") * F.col("voters")).alias("fitted"))


def votes(s, d):
    lines, parts, suppliers = table(s, d, "lineitem"), table(s, d, "part"), table(s, d, "supplier")
    sold = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    return sold.select(
        (F.col("l_partkey") % 97).alias("ballot"), F.col("l_quantity").cast("int").alias("votes"), F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("party"), F.col("p_name").alias("name"),
        F.col("l_returnflag").alias("office"), F.col("l_linestatus").alias("turn"), F.col("l_suppkey").alias("section"), F.col("s_nationkey").alias("place"))


AGES = [
    "16 anos", "17 anos", "18 anos", "19 anos", "20 anos", "21 a 24 anos", "25 a 29 anos", "30 a 34 anos", "35 a 39 anos", "40 a 44 anos", "45 a 49 anos",
    "50 a 54 anos", "55 a 59 anos", "60 a 64 anos", "65 a 69 anos", "70 a 74 anos", "75 a 79 anos", "Superior a 79 anos", "Inválido",
]
SCHOOLS = [
    "ANALFABETO", "LÊ E ESCREVE", "ENSINO FUNDAMENTAL INCOMPLETO", "ENSINO FUNDAMENTAL COMPLETO", "Ensino Médio Incompleto", " ENSINO MÉDIO COMPLETO ", "SUPERIOR INCOMPLETO", "Superior Completo",
    "NÃO INFORMADO", "Pós-graduação: stricto", "SEMI-ANALFABETO",
]


def profile(s, d):
    k = F.col("c_custkey")
    one_of = lambda labels: F.element_at(F.array(*[F.lit(a) for a in labels]), (k % len(labels) + 1).cast("int"))
    return table(s, d, "customer").select(
        F.col("c_nationkey").alias("section"), one_of(AGES).alias("age"),
        F.when(k % 7 == 0, None).when(k % 2 == 0, "MASCULINO").otherwise("FEMININO").alias("gender"), one_of(SCHOOLS).alias("schooling"),
        "c_mktsegment", F.lit(1).alias("n"))


def unit_squares(s, d):
    """A square of side 1 for each nation, five to a row."""
    x, y = (F.col("zone_id") % 5).cast("double"), F.floor(F.col("zone_id") / 5).cast("double")
    corner = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    return zones(s, d).withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).withColumn("rings", F.array("ring"))


ZONES = "zones AS (SELECT n_nationkey AS zone_id, n_name AS name FROM nation)"
OD = """od AS (SELECT n_nationkey AS zone_id, s_suppkey AS source_id, CASE WHEN (n_nationkey * 31 + s_suppkey * 17) % 11 = 0 THEN NULL
  ELSE CAST(abs(n_nationkey - s_nationkey) * 3 + s_suppkey % 7 + 1 AS DOUBLE) END AS minutes FROM nation, supplier)"""
POP = "pop AS (SELECT c_nationkey AS zone_id, c_mktsegment AS bracket, count(*) AS pop FROM customer GROUP BY ALL)"
SRC = """src AS (SELECT l_suppkey AS source_id, c_mktsegment AS bracket, sum(l_quantity) AS voters FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
ALPHA = "alpha AS (SELECT zone_id, bracket, CAST(1 + (zone_id % 3) * 0.5 + (length(bracket) % 4) * 0.25 AS DOUBLE) AS alpha FROM pop)"
W = """w AS (SELECT zone_id, source_id, pow(minutes + 1, -2.0) / sum(pow(minutes + 1, -2.0)) OVER (PARTITION BY source_id) AS w FROM od WHERE minutes IS NOT NULL)"""
FIT = "fit AS (SELECT zone_id, bracket, sum(w * voters) AS fitted FROM w JOIN src USING (source_id) GROUP BY ALL)"
VOTES = """votes AS (SELECT l_partkey % 97 AS ballot, CAST(l_quantity AS INTEGER) AS votes, replace(p_brand, '#', ' ') AS party, p_name AS name, l_returnflag AS office,
  l_linestatus AS turn, l_suppkey AS section, s_nationkey AS place FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
_listed = lambda labels: f"""([{", ".join(f"'{a}'" for a in labels)}])[c_custkey % {len(labels)} + 1]"""
PROFILE = f"""profile AS (SELECT c_nationkey AS section, {_listed(AGES)} AS age,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'MASCULINO' ELSE 'FEMININO' END AS gender, {_listed(SCHOOLS)} AS schooling, c_mktsegment, 1 AS n FROM customer)"""


def sql(query: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)} {query}" if parts else query
