"""Queries of the reference operators that prepare sources: scans, filters, pivots, joins, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dasymetra.functions import text
from dasymetra.operators import labels
from dasymetra.operators import population as pop
from dasymetra.operators import result as res
from dasymetra.operators import votes as vt
from dasymetra.plans import proxies as px
from dasymetra.plans.common import table
from dasymetra.plans.proxies import POP, PROFILE, VOTES, ZONES, sql
from dasymetra.sources import staged, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BALLOTS = [str(b) for b in range(97)]
BRANDS = [f"BRAND_{n}" for n in range(1, 26)]
OFFICE = {"A": 1, "N": 11, "R": 13}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# scans


def _raw_votes(s, d):
    """lineitem in the layout of delivered vote files: everything as text, one column under another name."""
    t = table(s, d, "lineitem")
    return t.select(
        (F.col("l_suppkey") % 40).cast("string").alias("COD_MUN_TSE"), F.lit("1").alias("NR_TURNO"), (F.col("l_linenumber") % 3 * 2 + 1).cast("string").alias("CD_CARGO"),
        F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("QTDE_VOTOS"), (F.col("l_partkey") % 97).cast("string").alias("NR_VOTAVEL"))


@query("""SELECT CD_CARGO, count(*) AS n, CAST(sum(QT_VOTOS) AS BIGINT) AS votes FROM (SELECT lpad(CAST(l_suppkey % 40 AS VARCHAR), 5, '0') AS m, CAST(l_linenumber % 3 * 2 + 1 AS INTEGER) AS CD_CARGO,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS QT_VOTOS FROM lineitem) WHERE m = '00007' AND CD_CARGO IN (1, 5) GROUP BY ALL""")
def votes_scan_filter(s, d):
    return staged.votes(_raw_votes(s, d), "00007", [1, 5], 1).groupBy("CD_CARGO").agg(F.count(F.lit(1)).alias("n"), F.sum("QT_VOTOS").alias("votes"))


@query("SELECT CAST(l_linenumber % 3 AS VARCHAR) AS CD_CARGO, CAST(l_suppkey AS VARCHAR) AS NR_ZONA, count(*) AS n FROM lineitem GROUP BY ALL")
def alias_normalise(s, d):
    """The alias of the office overwrites the usual column; that of the zone counts only where there is no other."""
    raw = table(s, d, "lineitem").select(
        F.lit("old").alias("CD_CARGO"), (F.col("l_linenumber") % 3).cast("string").alias("CODIGO_CARGO"), F.col("l_suppkey").cast("string").alias("NR_ZONA"), F.lit("alias").alias("NUM_ZONA"))
    return staged.with_aliases(raw).groupBy("CD_CARGO", "NR_ZONA").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT office, count(*) AS n FROM (SELECT l_returnflag AS office FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'O') GROUP BY ALL""")
def national_state_union(s, d):
    v = px.votes(s, d)
    state, national = v.filter("turn = 'F'").drop("party"), v.filter("turn = 'O'").drop("name")
    return staged.union_on_common(state, national).groupBy("office").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS CD_MUNICIPIO, CAST(sum(CAST(c_acctbal AS INTEGER)) AS BIGINT) AS turnout FROM (SELECT c_nationkey, CAST(trunc(c_acctbal) AS INTEGER) AS c_acctbal FROM customer) GROUP BY ALL")
def turnout_scan(s, d):
    raw = table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("CD_MUNICIPIO"), F.lit("1").alias("NR_TURNO"), F.col("c_acctbal").cast("int").cast("string").alias("QT_COMPARECIMENTO"))
    return staged.turnout(raw, turn=1).groupBy("CD_MUNICIPIO").agg(F.sum("QT_COMPARECIMENTO").alias("turnout"))


@query("SELECT DISTINCT CAST(p_size AS VARCHAR) AS NR_PARTIDO, p_brand AS SG_PARTIDO FROM part")
def legend_scan(s, d):
    raw = table(s, d, "part").select(F.lpad(F.col("p_size").cast("string"), 4, "0").alias("NR_PARTIDO"), F.concat(F.lit(" "), "p_brand").alias("SG_PARTIDO"))
    return staged.legends(raw)


@query(sql("SELECT age, gender, CAST(sum(n) AS BIGINT) AS n FROM profile WHERE section = 7 GROUP BY ALL", PROFILE))
def profile_scan(s, d):
    """Profiles as they are delivered: all text, labels with spaces around, codes without their zeros."""
    raw = px.profile(s, d).select(F.col("section").cast("string").alias("COD_MUN_TSE"), F.lit("1").alias("NUM_ZONA"), F.lit("1").alias("NUM_SECAO"), F.concat(F.lit(" "), "age", F.lit(" ")).alias("DS_FAIXA_ETARIA"),
                                  F.col("gender").alias("DS_GENERO"), F.concat(F.lit(" "), F.col("n").cast("string")).alias("QT_ELEITORES_PERFIL"))
    return staged.profile(raw, "00007").groupBy(F.col("DS_FAIXA_ETARIA").alias("age"), F.col("DS_GENERO").alias("gender")).agg(F.sum("QT_ELEITORES_PERFIL").alias("n"))


@query("SELECT DISTINCT cod_mun_tse, nr_zona, nr_secao, qt_comparecimento FROM merged WHERE nr_turno = 1 AND ano_eleicao = 2020")
def parquet_turnout_scan(s, d):
    t = table(s, d, "merged").filter("nr_turno = 1 AND ano_eleicao = 2020")
    return t.select("cod_mun_tse", "nr_zona", "nr_secao", "qt_comparecimento").distinct()


@query("""SELECT CAST(try_cast(trim(nr_zona) AS BIGINT) AS VARCHAR) AS nr_zona, CAST(try_cast(trim(nr_local_votacao) AS BIGINT) AS VARCHAR) AS nr_local_votacao,
  CASE WHEN lat <> -1 THEN lat END AS lat, CASE WHEN long <> -1 THEN long END AS lon FROM geocode_locs""")
def user_geocode_scan(s, d):
    return staged.places(table(s, d, "geocode_locs"), "lat", "long", ["nr_zona", "nr_local_votacao"])


@query("SELECT code_tract, pop_18_20, pop_21_24, coalesce(pop_18_20, 0) + coalesce(pop_21_24, 0) AS young, greatest(coalesce(pop_25_29, 0) - coalesce(pop_21_24, 0), 0) AS grown FROM tracts_sf")
def census_projection(s, d):
    """Brackets made of others: missing columns and nulls count 0, differences not below 0."""
    t = staged.projected(table(s, d, "tracts_sf"), "^pop_(18_20|21_24|25_29)$", ["code_tract"])
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return t.select("code_tract", "pop_18_20", "pop_21_24", (z("pop_18_20") + z("pop_21_24")).alias("young"), F.greatest(z("pop_25_29") - z("pop_21_24"), F.lit(0.0)).alias("grown"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS zone_id, s_acctbal AS income FROM supplier WHERE CAST(s_suppkey AS VARCHAR) LIKE '1%'")
def income_scan(s, d):
    raw = table(s, d, "supplier").select("s_suppkey", F.regexp_replace(F.format_string("%.2f", F.col("s_acctbal")), "[.]", ",").alias("v"))
    return staged.income(raw, "s_suppkey", "v", "1")


@query(sql("SELECT z.zone_id, CAST(coalesce(sum(CASE WHEN bracket = 'BUILDING' THEN pop END), 0) AS BIGINT) AS building, CAST(coalesce(sum(pop), 0) AS BIGINT) AS pop_total FROM zones z LEFT JOIN pop USING (zone_id) GROUP BY ALL", ZONES, POP))
def zone_population_join(s, d):
    p = px.population(s, d).groupBy("zone_id").agg(F.sum(F.when(F.col("bracket") == "BUILDING", F.col("pop"))).alias("building"), F.sum("pop").alias("pop_total"))
    return px.zones(s, d).select("zone_id").join(p, "zone_id", "left").fillna(0)


@query("SELECT code_muni, count(*) AS n FROM tracts_sf WHERE substr(code_tract, 1, 7) IN (SELECT code_ibge FROM muni_crosswalk WHERE uf = 'SC') GROUP BY ALL")
def neighbourhood_prefix(s, d):
    towns = table(s, d, "muni_crosswalk").filter("uf = 'SC'").select(F.col("code_ibge").alias("prefix"))
    return staged.within(table(s, d, "tracts_sf"), towns, "code_tract").groupBy("code_muni").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM geocode_locs WHERE long BETWEEN -50.01 AND -45.99 AND lat BETWEEN -20.01 AND -14.99")
def raster_crop(s, d):
    cells = table(s, d, "geocode_locs").select(F.col("long").alias("cell_x"), F.col("lat").alias("cell_y"))
    return staged.cropped(cells, -50, -20, -46, -15).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM geocode_locs WHERE source IS NOT NULL GROUP BY ALL")
def road_nonnull(s, d):
    return staged.roads(table(s, d, "geocode_locs"), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT uf, count(*) AS n FROM muni_crosswalk JOIN (SELECT DISTINCT cod_mun_tse FROM geocode_locs) ON code_tse = cod_mun_tse GROUP BY ALL")
def lookup_tables(s, d):
    seen = table(s, d, "geocode_locs").select(F.col("cod_mun_tse").alias("code_tse")).distinct()
    return table(s, d, "muni_crosswalk").join(seen, "code_tse", "left_semi").groupBy("uf").agg(F.count(F.lit(1)).alias("n"))


# voter profiles

BUCKETS = [f"votantes_{a}" for a in ("18_19", "20", "21_24", "25_29", "30_34", "35_39", "40_44", "45_49", "50_54", "55_59", "60_64", "65_69")]
BUCKET_SQL = """CASE age WHEN '18 anos' THEN 'votantes_18_19' WHEN '19 anos' THEN 'votantes_18_19' WHEN '20 anos' THEN 'votantes_20' WHEN '21 a 24 anos' THEN 'votantes_21_24' WHEN '25 a 29 anos' THEN 'votantes_25_29'
  WHEN '30 a 34 anos' THEN 'votantes_30_34' WHEN '35 a 39 anos' THEN 'votantes_35_39' WHEN '40 a 44 anos' THEN 'votantes_40_44' WHEN '45 a 49 anos' THEN 'votantes_45_49' WHEN '50 a 54 anos' THEN 'votantes_50_54'
  WHEN '55 a 59 anos' THEN 'votantes_55_59' WHEN '60 a 64 anos' THEN 'votantes_60_64' WHEN '65 a 69 anos' THEN 'votantes_65_69' END"""
CROSS = [f"vot_{g}_{a}_{b[9:]}" for g in ("hom", "mul") for a in ("alf", "nalf") for b in BUCKETS]
SEX_SQL = "CASE gender WHEN 'MASCULINO' THEN 'hom' WHEN 'FEMININO' THEN 'mul' END"
ABLE_SQL = "CASE WHEN schooling LIKE '%ANALFABETO%' THEN 'nalf' ELSE 'alf' END"
CROSS_SQL = f"'vot_' || {SEX_SQL} || '_' || {ABLE_SQL} || '_' || substr({BUCKET_SQL}, 10)"


def _pivot_sql(key, name, value, names, source, prefix=""):
    return f"SELECT {key}, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN {name} = '{n}' THEN {value} END), 0) AS BIGINT) AS \"{prefix}{n}\"" for n in names) + f" FROM {source} GROUP BY ALL"


@query(sql(_pivot_sql("section", BUCKET_SQL, "n", BUCKETS, f"(SELECT * FROM profile WHERE {BUCKET_SQL} IS NOT NULL)"), PROFILE))
def age_bucket_pivot(s, d):
    rows = px.profile(s, d).withColumn("bucket", text.age_bucket(F.col("age"))).filter(F.col("bucket").isNotNull())
    return vt.wide(rows, ["section"], F.col("bucket"), F.col("n"), BUCKETS)


def _crosstab(s, d):
    rows = px.profile(s, d).withColumn("bucket", text.age_bucket(F.col("age"))).filter(F.col("bucket").isNotNull() & text.gender(F.col("gender")).isNotNull())
    name = F.concat_ws("_", F.lit("vot"), text.gender(F.col("gender")), text.literacy(F.col("schooling")), F.substr("bucket", F.lit(10)))
    return vt.wide(rows, ["section"], name, F.col("n"), CROSS)


@query(sql(_pivot_sql("section", CROSS_SQL, "n", CROSS, f"(SELECT * FROM profile WHERE {BUCKET_SQL} IS NOT NULL AND gender IS NOT NULL)"), PROFILE))
def gender_literacy_crosstab(s, d):
    return _crosstab(s, d)


LEVEL_SQL = """CASE schooling WHEN 'ANALFABETO' THEN 'ANALFABETO' WHEN 'LÊ E ESCREVE' THEN 'LE_ESCREVE' WHEN 'ENSINO FUNDAMENTAL INCOMPLETO' THEN 'FUND_INCOMP' WHEN 'ENSINO FUNDAMENTAL COMPLETO' THEN 'FUND_COMP'
  WHEN 'Ensino Médio Incompleto' THEN 'MEDIO_INCOMP' WHEN ' ENSINO MÉDIO COMPLETO ' THEN 'MEDIO_COMP' WHEN 'SUPERIOR INCOMPLETO' THEN 'SUP_INCOMP' WHEN 'Superior Completo' THEN 'SUP_COMP'
  WHEN 'NÃO INFORMADO' THEN 'NAO_INFORMADO' WHEN 'Pós-graduação: stricto' THEN 'POS_GRADUACAO__STRICTO' WHEN 'SEMI-ANALFABETO' THEN 'ANALFABETO' END"""
LEVELS = ["ANALFABETO", "LE_ESCREVE", "FUND_INCOMP", "FUND_COMP", "MEDIO_INCOMP", "MEDIO_COMP", "SUP_INCOMP", "SUP_COMP", "NAO_INFORMADO", "POS_GRADUACAO__STRICTO"]


@query(sql(f"SELECT {LEVEL_SQL} AS level, count(*) AS n FROM profile GROUP BY ALL", PROFILE))
def education_normalise(s, d):
    return px.profile(s, d).groupBy(text.education(F.col("schooling")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT section, " + ", ".join(f"CAST(count(*) FILTER (gender = '{g}') AS BIGINT) AS GENERO_{g}" for g in ("MASCULINO", "FEMININO"))
           + ", " + ", ".join(f"CAST(count(*) FILTER ({LEVEL_SQL} = '{e}') AS BIGINT) AS EDUC_{e}" for e in LEVELS) + " FROM profile GROUP BY ALL", PROFILE))
def demographics(s, d):
    return pop.demographics(px.profile(s, d), ["section"], ["MASCULINO", "FEMININO"], LEVELS)


@query(sql("""SELECT a.section, a.men, a.women, b.literate FROM (SELECT section, count(*) FILTER (gender = 'MASCULINO') AS men, count(*) FILTER (gender = 'FEMININO') AS women FROM profile GROUP BY 1) a
  LEFT JOIN (SELECT section, count(*) AS literate FROM profile WHERE schooling NOT LIKE '%ANALFABETO%' GROUP BY 1) b USING (section)""", PROFILE))
def demographics_join(s, d):
    p = px.profile(s, d)
    g = vt.wide(p, ["section"], text.gender(F.col("gender")), F.col("n"), ["hom", "mul"]).select("section", F.col("hom").alias("men"), F.col("mul").alias("women"))
    e = p.filter(text.literacy(F.col("schooling")) == "alf").groupBy("section").agg(F.count(F.lit(1)).alias("literate"))
    return g.join(e, "section", "left")


@query(sql(f"SELECT age, gender, CAST(sum(n) AS BIGINT) AS n FROM (SELECT substr({BUCKET_SQL}, 10) AS age, {SEX_SQL} AS gender, n FROM profile WHERE {BUCKET_SQL} IS NOT NULL AND gender IS NOT NULL) GROUP BY ALL", PROFILE))
def pyramid(s, d):
    """Sex and age read back from the names of the crosstab's columns, folded over literacy."""
    long = _crosstab(s, d).unpivot("section", CROSS, "variable", "n")
    age, sex = F.regexp_extract("variable", "^vot_(?:hom|mul)_n?alf_(.+)$", 1), F.regexp_extract("variable", "^vot_(hom|mul)_", 1)
    return long.groupBy(age.alias("age"), sex.alias("gender")).agg(F.sum("n").alias("n")).filter("n > 0")


# zones: each customer is a person, whose age, sex and literacy follow from the key

PERSON = """person AS (SELECT c_nationkey AS code_tract, c_custkey % 101 AS age, CASE WHEN c_custkey // 101 % 2 = 0 THEN 'hom' ELSE 'mul' END AS sex, CASE WHEN c_custkey % 3 > 0 THEN 'alf' ELSE 'nalf' END AS able FROM customer)"""
GROUPS = {"18_20": (18, 20), "21_24": (21, 24), "25_29": (25, 29), "30_39": (30, 39), "40_49": (40, 49), "50_59": (50, 59), "60_69": (60, 69)}
GROUPS_2022 = {"18_19": (15, 19), "20_24": (20, 24), **{g: GROUPS[g] for g in ("25_29", "30_39", "40_49", "50_59", "60_69")}}


def _census(s, d, names):
    """A census table of one row per nation: a column for each (name, condition) of persons."""
    k = F.col("c_custkey")
    person = table(s, d, "customer").select(
        F.col("c_nationkey").alias("code_tract"), (k % 101).alias("age"), F.when(F.floor(k / 101) % 2 == 0, "hom").otherwise("mul").alias("sex"), F.when(k % 3 > 0, "alf").otherwise("nalf").alias("able"))
    return person.groupBy("code_tract").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in names]).withColumn("code_muni", F.lit("1"))


def _long(df, side="code_tract"):
    columns = [c for c in df.columns if c.startswith(("pop_", "vot_"))]
    return df.select(side, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(side, columns, "bracket", "value").withColumn("value", F.round("value", 4))


def _census_sql(groups, spans):
    total = " UNION ALL ".join(f"SELECT 'pop_{g}' AS bracket, {a} AS a, {b} AS b" for g, (a, b) in spans.items())
    part = " UNION ALL ".join(f"SELECT '{g}' AS g, {a} AS a, {b} AS b" for g, (a, b) in groups.items())
    share = "CASE WHEN g = '18_19' THEN 0.4 ELSE 1 END"
    return f"""SELECT code_tract, bracket, CAST(count(*) FILTER (age BETWEEN a AND b) AS DOUBLE) AS value FROM person CROSS JOIN ({total}) GROUP BY ALL
      UNION ALL SELECT code_tract, 'pop_' || x.sex || '_' || y.able || '_' || g, CAST(round(sum(CASE WHEN age BETWEEN a AND b AND person.sex = x.sex AND person.able = y.able THEN {share} ELSE 0 END), 4) AS DOUBLE)
      FROM person CROSS JOIN ({part}) CROSS JOIN (VALUES ('hom'), ('mul')) x(sex) CROSS JOIN (VALUES ('alf'), ('nalf')) y(able) GROUP BY ALL"""


SPANS_SQL = {"00_04": (0, 4), "05_09": (5, 9), "10_14": (10, 14), "15_17": (15, 17), **GROUPS, "70mais": (70, 100)}


@query(sql(_census_sql(GROUPS, SPANS_SQL), PERSON))
def census_2010(s, d):
    """Single years in all, by sex, and of those that read; the rest do not."""
    names = [(f"pessoa13_V{34 + a:03d}", f"age = {a}") for a in range(101)]
    names += [(f"pessoa{t}_V{34 + a:03d}", f"age = {a} AND sex = '{x}'") for t, x in ((11, "hom"), (12, "mul")) for a in range(1, 101)]
    names += [(f"pessoa02_V{a - 3 if x == 'hom' else a + 82:03d}", f"age = {a} AND sex = '{x}' AND able = 'alf'") for x in ("hom", "mul") for a in range(5, 80)]
    return _long(pop.prepare_population(_census(s, d, names), 2010, "1"))


@query(sql(_census_sql(GROUPS, SPANS_SQL), PERSON))
def census_2000(s, d):
    """Whole groups, of which one takes a single year away; single years by sex and literacy."""
    five = {1448: (0, 4), 1449: (5, 9), 1450: (10, 14), 1452: (20, 24), 1453: (25, 29), 1454: (30, 34), 1455: (35, 39), 1456: (40, 44), 1457: (45, 49), 1458: (50, 54), 1459: (55, 59), 1460: (60, 64),
            1461: (65, 69), 1462: (70, 74), 1463: (75, 79), 1464: (80, 100), **{1347 + a: (a, a) for a in range(15, 21)}}
    names = [(f"pessoa1_V{v}", f"age BETWEEN {a} AND {b}") for v, (a, b) in five.items()]
    firsts = (("instrucao3_V", 2644, "hom", "alf"), ("instrucao3_V", 2736, "hom", "nalf"), ("instrucao5_V", 2929, "mul", "alf"), ("instrucao5_V", 3021, "mul", "nalf"))
    names += [(f"{p}{v + a}", f"age = {a} AND sex = '{x}' AND able = '{l}'") for p, v, x, l in firsts for a in range(18, 70)]
    return _long(pop.prepare_population(_census(s, d, names), 2000))


@query(sql(_census_sql(GROUPS_2022, {"00_04": (0, 4), "05_09": (5, 9), "10_14": (10, 14), "15_19": (15, 19), "20_24": (20, 24), "25_29": (25, 29), "30_39": (30, 39), "40_49": (40, 49), "50_59": (50, 59), "60_69": (60, 69), "70mais": (70, 100)}), PERSON))
def census_2022(s, d):
    """Groups of five and ten years; two in five of those of 15 to 19 count as 18 or 19."""
    tens = [(0, 4), (5, 9), (10, 14), (15, 19), (20, 24), (25, 29), (30, 39), (40, 49), (50, 59), (60, 69), (70, 100)]
    names = [(f"demografia_V{1031 + k:05d}", f"age BETWEEN {a} AND {b}") for k, (a, b) in enumerate(tens)]
    fives = [(15 + 5 * k, 19 + 5 * k) for k in range(11)]
    for first, x, more in ((722, "hom", ""), (735, "mul", ""), (826, "hom", " AND able = 'alf'"), (839, "mul", " AND able = 'alf'")):
        names += [(f"alfabetizacao_V{first + k:05d}", f"age BETWEEN {a} AND {b} AND sex = '{x}'{more}") for k, (a, b) in enumerate(fives)]
    return _long(pop.prepare_population(_census(s, d, names), 2022))


def _pairs_sql(groups, votes):
    sides = " UNION ALL ".join(f"SELECT '{g}' AS g, {a} AS a, {b} AS b, {v} AS v" for (g, (a, b)), v in zip(groups.items(), votes))
    return f"""SELECT 'pop' AS side, code_tract AS id, 'pop_' || x.sex || '_' || g AS bracket, CAST(round(sum(CASE WHEN age BETWEEN a AND b AND person.sex = x.sex THEN CASE WHEN g = '18_19' THEN 0.4 ELSE 1 END ELSE 0 END), 4) AS DOUBLE) AS value
      FROM person CROSS JOIN ({sides}) CROSS JOIN (VALUES ('hom'), ('mul')) x(sex) GROUP BY ALL
      UNION ALL SELECT 'vot', section, 'vot_' || x.sex || '_' || g, CAST(coalesce(sum(CASE WHEN list_contains(v, bucket) AND gender = x.sex THEN n END), 0) AS DOUBLE)
      FROM (SELECT section, substr({BUCKET_SQL}, 10) AS bucket, {SEX_SQL} AS gender, n FROM profile WHERE {BUCKET_SQL} IS NOT NULL AND gender IS NOT NULL) CROSS JOIN ({sides}) CROSS JOIN (VALUES ('hom'), ('mul')) x(sex) GROUP BY ALL"""


def _calibration(s, d, year):
    groups = GROUPS if year == 2010 else {"15_19": (15, 19), **{g: x for g, x in GROUPS_2022.items() if g != "18_19"}}
    names = [(f"pop_{x}_{l}_{g}", f"age BETWEEN {a} AND {b} AND sex = '{x}' AND able = '{l}'") for x in ("hom", "mul") for l in ("alf", "nalf") for g, (a, b) in groups.items()]
    zones, sources, pairs = pop.match_calibration(_census(s, d, names), _crosstab(s, d), year)
    mine = _long(zones.select("code_tract", *[z for z, _ in pairs])).withColumnRenamed("code_tract", "id").withColumn("side", F.lit("pop"))
    theirs = _long(sources.select("section", *[v for _, v in pairs]), "section").withColumnRenamed("section", "id").withColumn("side", F.lit("vot"))
    return mine.unionByName(theirs)


@query(sql(_pairs_sql(GROUPS, ("['18_19', '20']", "['21_24']", "['25_29']", "['30_34', '35_39']", "['40_44', '45_49']", "['50_54', '55_59']", "['60_64', '65_69']")), PERSON, PROFILE))
def calibration_pairs(s, d):
    return _calibration(s, d, 2010)


@query(sql(_pairs_sql(GROUPS_2022, ("['18_19']", "['20', '21_24']", "['25_29']", "['30_34', '35_39']", "['40_44', '45_49']", "['50_54', '55_59']", "['60_64', '65_69']")), PERSON, PROFILE))
def calibration_pairs_2022(s, d):
    return _calibration(s, d, 2022)


@query(sql(f"SELECT id AS zone_id, age, sum(value) AS value FROM (SELECT id, value, replace(substr(bracket, 9), '_', '-') AS age FROM ({_pairs_sql(GROUPS, [chr(91) + chr(93)] * 7).split('UNION ALL SELECT ' + chr(39) + 'vot')[0]})) GROUP BY ALL", PERSON))
def age_fold(s, d):
    """Fourteen brackets folded over sex into seven ages."""
    rows = _calibration(s, d, 2010).filter("side = 'pop'").select(F.col("id").alias("zone_id"), "bracket", "value")
    return pop.fold_ages(rows, "value")


@query("""SELECT t.code_tract, t.code_muni, t.pop_total, CAST(coalesce(c.pop_18_20, 0) AS BIGINT) AS pop_people, c.income FROM tracts_sf t LEFT JOIN (
  SELECT substr(code_tract, 1, 7) AS m, code_tract, length(code_tract) AS pop_18_20, pop_25_29 AS income FROM tracts_sf WHERE CAST(substr(code_tract, length(code_tract), 1) AS INTEGER) % 2 = 0) c ON t.code_tract = c.code_tract
  WHERE t.code_muni IN (SELECT max(code_muni) FROM tracts_sf)""")
def zones_prepared(s, d):
    """The zones of one town with people and income; zones that the census lacks have none."""
    t = table(s, d, "tracts_sf")
    town = t.agg(F.max("code_muni")).first()[0]
    some = t.filter(F.substring("code_tract", -1, 1).cast("int") % 2 == 0)
    out = pop.prepare_zones(t, some.select("code_tract", F.length("code_tract").cast("bigint").alias("pop_people")), town, some.select("code_tract", F.col("pop_25_29").alias("income")))
    return out.select("code_tract", "code_muni", "pop_total", "pop_people", "income")


# votes


@query(sql("SELECT ballot, CAST(sum(votes) AS BIGINT) AS votes FROM votes WHERE ballot IN (13, 22, 95) GROUP BY ALL", VOTES))
def candidate_filter_ids(s, d):
    return vt.candidates(px.votes(s, d), ["13", "22", "95"]).groupBy("ballot").agg(F.sum("votes").alias("votes"))


@query(sql("SELECT name, count(*) AS n FROM votes WHERE contains(upper(name), 'WIDGET') OR ballot = 13 GROUP BY ALL", VOTES))
def candidate_filter_name(s, d):
    return vt.candidates(px.votes(s, d), ["13"], ["wídgêt"], name="name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT party, CAST(sum(votes) AS BIGINT) AS votes FROM votes WHERE party IN ('Brand 2', 'Brand 17') GROUP BY ALL", VOTES))
def party_filter(s, d):
    return vt.parties(px.votes(s, d), [" brand 2", "BRAND 17 "]).groupBy("party").agg(F.sum("votes").alias("votes"))


@query(sql(_pivot_sql("section", "CAST(ballot AS VARCHAR)", "votes", BALLOTS, "votes", "CAND_"), VOTES))
def candidate_pivot(s, d):
    return vt.wide(px.votes(s, d), ["section"], F.col("ballot").cast("string"), F.col("votes"), BALLOTS, "CAND_")


EVERY_OFFICE = [f"{o}_CAND_{b}" for o in ("A", "N", "R") for b in BALLOTS]


@query(sql(_pivot_sql("section", "office || '_CAND_' || CAST(ballot AS VARCHAR)", "votes", EVERY_OFFICE, "votes"), VOTES))
def candidate_pivot_multi_office(s, d):
    """Several offices in one pivot over the rows of all, in place of one outer join for each."""
    return vt.wide(px.votes(s, d), ["section"], F.concat("office", F.lit("_CAND_"), F.col("ballot").cast("string")), F.col("votes"), EVERY_OFFICE)


@query(sql(_pivot_sql("section", "replace(upper(party), ' ', '_')", "votes", BRANDS, "(SELECT * FROM votes WHERE ballot NOT IN (95, 96))", "PARTY_"), VOTES))
def party_pivot(s, d):
    rows = vt.with_party_key(vt.no_blanks(px.votes(s, d)))
    return vt.wide(rows, ["section"], F.col("party_key"), F.col("votes"), BRANDS, "PARTY_")


@query(sql("SELECT key, CAST(sum(votes) AS BIGINT) AS votes FROM (SELECT substr(CAST(ballot AS VARCHAR), 1, 2) AS key, votes FROM votes WHERE ballot NOT IN (95, 96)) GROUP BY ALL", VOTES))
def party_fallback_prefix(s, d):
    """A table in which no vote has an abbreviation: the first two digits of the ballot stand for it."""
    rows = vt.no_blanks(px.votes(s, d)).withColumn("party", F.when(F.col("ballot") % 2 == 0, " "))
    return vt.with_party_key(rows, name="key").groupBy("key").agg(F.sum("votes").alias("votes"))


@query(sql("SELECT section, CAST(sum(votes) AS BIGINT) AS turnout FROM votes WHERE office = (SELECT min(office) FROM votes) GROUP BY ALL", VOTES))
def turnout_first_office(s, d):
    return vt.turnout_of_first_office(px.votes(s, d), ["section"])


@query(sql("SELECT DISTINCT section, place, turn FROM votes", VOTES))
def turnout_extras(s, d):
    return px.votes(s, d).select("section", "place", "turn").distinct()


@query(sql("SELECT p.section, p.n, v.votes, t.turnout FROM (SELECT section, count(*) AS n FROM profile GROUP BY 1) p LEFT JOIN (SELECT place AS section, CAST(sum(votes) AS BIGINT) AS votes FROM votes GROUP BY 1) v USING (section) LEFT JOIN (SELECT place AS section, CAST(sum(votes) AS BIGINT) AS turnout FROM votes WHERE office = 'A' GROUP BY 1) t USING (section)", PROFILE, VOTES))
def section_left_joins(s, d):
    v = px.votes(s, d).withColumn("section", F.col("place"))
    p = px.profile(s, d).groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    return p.join(v.groupBy("section").agg(F.sum("votes").alias("votes")), "section", "left").join(vt.turnout_of_first_office(v, ["section"]), "section", "left")


_WHOLE = "CAST(try_cast(trim({0}) AS BIGINT) AS VARCHAR)"


@query(f"""WITH sections AS (SELECT ano_eleicao, cod_mun_tse AS m, {_WHOLE.format('nr_zona')} AS z, {_WHOLE.format('nr_local_votacao')} AS l, {_WHOLE.format('nr_secao')} AS s, CAST(max(coalesce(qt_aptos, 0)) AS BIGINT) AS aptos FROM merged WHERE nr_turno = 1 GROUP BY ALL),
  places AS (SELECT ano, cod_mun_tse, {_WHOLE.format('nr_zona')} AS zona, {_WHOLE.format('nr_local_votacao')} AS place, min(lat) AS lat FROM geocode_locs WHERE lat <> -1 AND long <> -1 GROUP BY ALL)
  SELECT ano_eleicao, count(*) AS n, count(lat) AS n_placed, CAST(sum(aptos) AS BIGINT) AS aptos FROM sections LEFT JOIN places ON ano = ano_eleicao AND cod_mun_tse = m AND zona = z AND place = l GROUP BY ALL""")
def section_key_join(s, d):
    """Sections with the position of their place: four keys, called otherwise on either side and written as whole numbers first; each side is one row per key before they meet."""
    whole = lambda c: text.unpadded(F.col(c))
    sections = table(s, d, "merged").filter("nr_turno = 1").groupBy("ano_eleicao", F.col("cod_mun_tse").alias("m"), whole("nr_zona").alias("z"), whole("nr_local_votacao").alias("l"), whole("nr_secao").alias("s")).agg(F.max(F.coalesce("qt_aptos", F.lit(0))).alias("aptos"))
    places = table(s, d, "geocode_locs").filter("lat <> -1 AND long <> -1").groupBy("ano", F.col("cod_mun_tse").alias("town"), whole("nr_zona").alias("zona"), whole("nr_local_votacao").alias("place")).agg(F.min("lat").alias("lat"))
    on = (F.col("ano") == F.col("ano_eleicao")) & (F.col("town") == F.col("m")) & (F.col("zona") == F.col("z")) & (F.col("place") == F.col("l"))
    return sections.join(places, on, "left").groupBy("ano_eleicao").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("n_placed"), F.sum("aptos").alias("aptos"))


FIVE = ["town", "code", "zone", "section", "place"]
FIVE_SQL = "'T' || section AS town, lpad(CAST(section AS VARCHAR), 5, '0') AS code, length(age) AS zone, length(schooling) AS section, CASE WHEN c_mktsegment < 'C' THEN 1 ELSE 2 END AS place"


@query(sql(f"""WITH_ROWS SELECT a.*, b.men, b.women FROM (SELECT town, code, zone, section, place, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL) a LEFT JOIN (
  SELECT town, code, zone, section, place, CAST(count(*) FILTER (gender = 'MASCULINO') AS BIGINT) AS men, CAST(count(*) FILTER (gender = 'FEMININO') AS BIGINT) AS women FROM r WHERE gender IS NOT NULL GROUP BY ALL) b USING (town, code, zone, section, place)""",
  PROFILE, f"r AS (SELECT {FIVE_SQL}, gender, n FROM profile)").replace("WITH_ROWS ", ""))
def crosstab_join(s, d):
    """The crosstab joined to all voters on five keys; sections in which no sex is known keep nulls."""
    p = px.profile(s, d)
    rows = p.select(F.concat(F.lit("T"), F.col("section").cast("string")).alias("town"), text.padded(F.col("section")).alias("code"), F.length("age").cast("bigint").alias("zone"), F.length("schooling").cast("bigint").alias("section"),
                    F.when(F.col("c_mktsegment") < "C", 1).otherwise(2).alias("place"), "gender", "n")
    cross = vt.wide(rows.filter(F.col("gender").isNotNull()), FIVE, text.gender(F.col("gender")), F.col("n"), ["hom", "mul"])
    return rows.groupBy(*FIVE).agg(F.sum("n").alias("n")).join(cross.select(*FIVE, F.col("hom").alias("men"), F.col("mul").alias("women")), FIVE, "left")


@query("""WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS lat FROM supplier WHERE s_suppkey % 7 > 0), b AS (SELECT s_suppkey AS k, s_acctbal + 1 AS lat FROM supplier WHERE s_suppkey % 3 > 0)
  SELECT k, lat, lat * 2 AS lon, 'primary' AS source FROM a WHERE lat IS NOT NULL UNION ALL SELECT k, b.lat, b.lat * 2, 'filled' FROM a JOIN b USING (k) WHERE a.lat IS NULL
  UNION ALL SELECT k, lat, lat * 2, 'extra' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def geocode_fallback(s, d):
    k = F.col("k")
    base = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("lat"))
    primary = base.filter(k % 7 > 0).withColumn("lat", F.when(k % 5 > 0, F.col("lat"))).withColumn("lon", F.col("lat") * 2)
    fallback = base.filter(k % 3 > 0).withColumn("lat", F.col("lat") + 1).withColumn("lon", F.col("lat") * 2)
    return vt.with_fallback(primary, fallback, ["k"])


@query("""SELECT id, lat, lon, aptos FROM (SELECT CAST(row_number() OVER (ORDER BY lat NULLS LAST, lon NULLS LAST) AS INTEGER) AS id, lat, lon, aptos FROM (
  SELECT lat, long AS lon, CAST(sum(coalesce(ano, 0)) AS BIGINT) AS aptos FROM geocode_locs GROUP BY ALL)) WHERE lat IS NOT NULL AND lon IS NOT NULL""")
def rollup_to_coordinates(s, d):
    rows = table(s, d, "geocode_locs").select("lat", F.col("long").alias("lon"), F.col("ano").alias("aptos"))
    return vt.rolled_up(rows, ["aptos"]).select("id", "lat", "lon", "aptos")


DICT_SQL = """SELECT 'CAND_' || CAST(ballot AS VARCHAR) AS "column", 'candidate' AS type, 'prefeito' AS cargo, CAST(ballot AS VARCHAR) AS ballot_number,
  CASE ballot WHEN 95 THEN 'Votos em Branco' WHEN 96 THEN 'Votos Nulos' ELSE min(name) END AS candidate_name, CASE WHEN ballot NOT IN (95, 96) THEN min(party) END AS party FROM votes GROUP BY ballot"""
PARTY_SQL = """SELECT DISTINCT 'PARTY_' || replace(upper(party), ' ', '_') AS "column", 'party' AS type, 'prefeito' AS cargo, CAST(NULL AS VARCHAR) AS ballot_number, CAST(NULL AS VARCHAR) AS candidate_name, replace(upper(party), ' ', '_') AS party
  FROM votes WHERE ballot NOT IN (95, 96)"""


@query(sql(DICT_SQL, VOTES))
def candidate_dictionary(s, d):
    return vt.candidate_dictionary(px.votes(s, d), F.lit("prefeito"))


def _dictionary(s, d):
    return vt.candidate_dictionary(px.votes(s, d), F.lit("prefeito")).unionByName(vt.party_dictionary(px.votes(s, d), F.lit("prefeito")))


@query(sql(f"{DICT_SQL} UNION ALL ({PARTY_SQL})", VOTES))
def column_dictionary(s, d):
    return vt.first_by(_dictionary(s, d), ["column"], [F.col("type"), F.col("party")])


@query(sql(f"""WITH dict AS ({DICT_SQL} UNION ALL ({PARTY_SQL})), asked AS (SELECT unnest(['CAND_13', '22', 'brand_17', 'red widget']) AS wanted),
  m AS (SELECT wanted, "column", CASE WHEN "column" = wanted THEN 1 WHEN ballot_number = wanted THEN 2 WHEN upper(party) = upper(wanted) AND type = 'party' THEN 3 WHEN contains(upper(candidate_name), upper(wanted)) THEN 4 END AS priority FROM dict, asked)
  SELECT wanted, "column", CAST(priority AS INTEGER) AS priority FROM m WHERE priority IS NOT NULL QUALIFY priority = min(priority) OVER (PARTITION BY wanted)""").replace("WITH dict", f"WITH {VOTES}, dict"))
def resolve_variable(s, d):
    out = None
    for wanted in ("CAND_13", "22", "brand_17", "red widget"):
        found = res.resolve(_dictionary(s, d), wanted).select(F.lit(wanted).alias("wanted"), "column", "priority")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT l_partkey % 97 AS ballot, p_brand, count(*) AS n FROM lineitem JOIN (SELECT p_size, min(p_brand) AS p_brand FROM part GROUP BY 1) ON CAST(p_size AS VARCHAR) = substr(CAST(l_partkey % 97 AS VARCHAR), 1, 2) GROUP BY ALL")
def party_legend_lookup(s, d):
    legend = table(s, d, "part").groupBy(F.col("p_size").cast("string").alias("key")).agg(F.min("p_brand").alias("p_brand"))
    v = table(s, d, "lineitem").groupBy((F.col("l_partkey") % 97).alias("ballot")).agg(F.count(F.lit(1)).alias("n"))
    return v.join(legend, F.substring(F.col("ballot").cast("string"), 1, 2) == F.col("key")).select("ballot", "p_brand", "n")


@query("SELECT 'office' AS facet, office AS v, count(*) AS n FROM (SELECT l_returnflag AS office FROM lineitem) GROUP BY ALL UNION ALL SELECT 'turn', l_linestatus, count(*) FROM lineitem GROUP BY ALL")
def facet_union(s, d):
    v = table(s, d, "lineitem").select(F.col("l_returnflag").alias("office"), F.col("l_linestatus").alias("turn"))
    return v.unpivot([], ["office", "turn"], "facet", "v").groupBy("facet", "v").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_returnflag AS office FROM lineitem ORDER BY 1")
def distinct_offices(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("office")).distinct().orderBy("office")


@query("SELECT party FROM (VALUES ('BRAND#2'), ('BRAND#17'), ('BRAND#99')) w(party) EXCEPT SELECT upper(p_brand) FROM part")
def unmatched_parties(s, d):
    """Wanted parties that no vote has."""
    wanted = s.createDataFrame([("BRAND#2",), ("BRAND#17",), ("BRAND#99",)], "party string")
    return wanted.subtract(table(s, d, "part").select(F.upper("p_brand").alias("party")))


# lookups and names


@query("SELECT row_id, CAST(CASE WHEN ano_eleicao <= 2004 THEN 2000 WHEN ano_eleicao <= 2016 THEN 2010 ELSE 2022 END AS INTEGER) AS census FROM merged")
def census_year_map(s, d):
    return table(s, d, "merged").select("row_id", text.census_year(F.col("ano_eleicao")).alias("census"))


@query("""SELECT p_size AS code, CASE p_size WHEN 1 THEN 'presidente' WHEN 3 THEN 'governador' WHEN 5 THEN 'senador' WHEN 6 THEN 'deputado_federal' WHEN 7 THEN 'deputado_estadual' WHEN 8 THEN 'deputado_distrital'
  WHEN 11 THEN 'prefeito' WHEN 13 THEN 'vereador' ELSE 'CARGO' || p_size END AS label, count(*) AS n FROM part GROUP BY ALL""")
def office_label(s, d):
    return table(s, d, "part").groupBy(F.col("p_size").alias("code")).agg(F.count(F.lit(1)).alias("n")).select("code", text.office_label(F.col("code")).alias("label"), "n")


UFS = "AC AM AP PA RO RR TO AL BA CE MA PB PE PI RN SE DF GO MS MT ES MG RJ SP PR RS SC XX".split()


@query("""WITH e(uf, region, state) AS (VALUES ('AC', 'north', 'acre'), ('AM', 'north', 'amazonas'), ('AP', 'north', 'amapa'), ('PA', 'north', 'para'), ('RO', 'north', 'rondonia'), ('RR', 'north', 'roraima'), ('TO', 'north', 'tocantins'),
  ('AL', 'northeast', 'alagoas'), ('BA', 'northeast', 'bahia'), ('CE', 'northeast', 'ceara'), ('MA', 'northeast', 'maranhao'), ('PB', 'northeast', 'paraiba'), ('PE', 'northeast', 'pernambuco'), ('PI', 'northeast', 'piaui'),
  ('RN', 'northeast', 'rio-grande-do-norte'), ('SE', 'northeast', 'sergipe'), ('DF', 'central-west', 'distrito-federal'), ('GO', 'central-west', 'goias'), ('MS', 'central-west', 'mato-grosso-do-sul'),
  ('MT', 'central-west', 'mato-grosso'), ('ES', 'southeast', 'espirito-santo'), ('MG', 'southeast', 'minas-gerais'), ('RJ', 'southeast', 'rio-de-janeiro'), ('SP', 'southeast', 'sao-paulo'),
  ('PR', 'south', 'parana'), ('RS', 'south', 'rio-grande-do-sul'), ('SC', 'south', 'santa-catarina'), ('XX', NULL, NULL))
  SELECT uf, region, state, count(*) AS n FROM customer JOIN (SELECT *, row_number() OVER () - 1 AS k FROM e) ON c_custkey % 28 = k GROUP BY ALL""")
def uf_region(s, d):
    """Region and state of every federative unit, and of one that is none."""
    uf = F.element_at(F.array(*[F.lit(u) for u in UFS]), (F.col("c_custkey") % len(UFS) + 1).cast("int"))
    rows = table(s, d, "customer").groupBy(uf.alias("uf")).agg(F.count(F.lit(1)).alias("n")).withColumn("e", text.extract(F.col("uf")))
    return rows.select("uf", "e.region", "e.state", "n")


@query(f"WITH k AS (SELECT code_ibge, upper(strip_accents(trim(nome))) AS key, uf FROM muni_crosswalk WHERE nome IS NOT NULL) SELECT key, count(*) AS n, count(DISTINCT uf) AS n_uf FROM k GROUP BY ALL")
def muni_resolve(s, d):
    """How many towns a name stands for, in all states and by state."""
    return table(s, d, "muni_crosswalk").filter(F.col("nome").isNotNull()).groupBy(text.name_key(F.col("nome")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uf").alias("n_uf"))


@query("""SELECT DISTINCT ano_eleicao AS year, coalesce(CASE ano_eleicao WHEN 2020 THEN DATE '2020-11-15' END, make_date(ano_eleicao, 10, 1) + CAST((7 - dayofweek(make_date(ano_eleicao, 10, 1))) % 7 AS INTEGER)) AS day FROM merged""")
def election_date_fallback(s, d):
    known = s.createDataFrame([(2020, "2020-11-15")], "year int, known string").withColumn("known", F.to_date("known"))
    years = table(s, d, "merged").select(F.col("ano_eleicao").alias("year")).distinct()
    return years.join(F.broadcast(known), "year", "left").select("year", text.election_day(F.col("year"), F.col("known")).alias("day"))


@query("""SELECT code_ibge, array_to_string(list_transform(string_split_regex(lower(trim(nome)), '\\s+'), lambda w: CASE WHEN w IN ('de', 'da', 'do', 'das', 'dos', 'e') THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ') AS name
  FROM muni_crosswalk""")
def title_case(s, d):
    return table(s, d, "muni_crosswalk").select("code_ibge", text.title_case(F.col("nome")).alias("name"))


@query("""SELECT DISTINCT column_name, CASE WHEN regexp_matches(column_name, '(^|_)CAND_[0-9]+$') THEN 'candidate' WHEN regexp_matches(column_name, '(^|_)PARTY_.+$') THEN 'party' WHEN column_name LIKE 'QT\\_%' ESCAPE '\\' THEN 'turnout'
  WHEN regexp_matches(column_name, '^(GENERO|EDUC)_') THEN 'demographics' WHEN regexp_matches(column_name, '^(votantes|vot|pop)_') THEN 'calibration' ELSE 'other' END AS type,
  nullif(regexp_extract(column_name, '(?:^|_)CAND_([0-9]+)$', 1), '') AS ballot_number FROM dictionary WHERE column_name IS NOT NULL""")
def column_name_parse(s, d):
    kind, ballot, _, _ = vt.column_parts(F.col("column_name"))
    return table(s, d, "dictionary").filter(F.col("column_name").isNotNull()).select("column_name", kind, ballot).distinct()


@query("SELECT dict_id, candidate_name || coalesce(' (' || party || ')', '') || ' – ' || CAST(ano_eleicao AS VARCHAR) AS label FROM dictionary WHERE entry_type = 'candidate' AND candidate_name IS NOT NULL AND ano_eleicao IS NOT NULL")
def plot_labels(s, d):
    t = table(s, d, "dictionary").filter("entry_type = 'candidate' AND candidate_name IS NOT NULL AND ano_eleicao IS NOT NULL")
    return t.select("dict_id", F.concat("candidate_name", F.coalesce(F.concat(F.lit(" ("), "party", F.lit(")")), F.lit("")), F.lit(" – "), F.col("ano_eleicao").cast("string")).alias("label"))


_TITLE = """CASE WHEN entry_type = 'candidate' AND candidate_name IS NOT NULL THEN {title} || CASE WHEN party IS NOT NULL AND ballot_number IS NOT NULL THEN ' (' || party || ' — ' || ballot_number || ')'
  WHEN coalesce(party, ballot_number) IS NOT NULL THEN ' (' || coalesce(party, ballot_number) || ')' ELSE '' END
  ELSE coalesce(nullif(CASE WHEN entry_type = 'candidate' THEN coalesce(' (' || party || ')', '') WHEN entry_type = 'party' THEN coalesce(party, '') ELSE entry_type END, ''), column_name) END""".format(
    title="array_to_string(list_transform(string_split_regex(lower(trim(candidate_name)), '\\s+'), lambda w: CASE WHEN w IN ('de', 'da', 'do', 'das', 'dos', 'e') THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')")


@query(f"SELECT dict_id, {_TITLE} AS title FROM dictionary")
def column_titles(s, d):
    """What a map of each column is headed with."""
    return table(s, d, "dictionary").select("dict_id", labels.title(F.col("column_name"), F.col("entry_type"), F.col("candidate_name"), F.col("party"), F.col("ballot_number")).alias("title"))


@query(sql(f"""SELECT "column", type, cargo, ballot_number, candidate_name, party FROM ({DICT_SQL} UNION ALL ({PARTY_SQL})) WHERE "column" IN ('CAND_13', 'CAND_95', 'PARTY_BRAND_17') UNION ALL
  SELECT c, t, NULL, NULL, NULL, NULL FROM (VALUES ('QT_APTOS', 'turnout'), ('GENERO_FEMININO', 'demographics'), ('votantes_20', 'calibration'), ('QT_COMPARECIMENTO', 'calibration')) v(c, t)""", VOTES))
def dictionary_assembly(s, d):
    """The dictionary of a few interpolated columns: what is known of votes first, then calibration, which wins over turnout, and demographics."""
    one = lambda *names: s.createDataFrame([(n,) for n in names], "column string")
    columns = one("CAND_13", "CAND_95", "PARTY_BRAND_17", "QT_APTOS", "QT_COMPARECIMENTO", "GENERO_FEMININO", "votantes_20", "unknown")
    return labels.assemble(_dictionary(s, d), columns, one("votantes_20", "QT_COMPARECIMENTO", "votantes_99"))


@query("SELECT CAST(cod_mun_tse AS VARCHAR) AS cod_mun_tse FROM geocode_locs INTERSECT SELECT CAST(cod_mun_tse AS VARCHAR) FROM locais_votacao")
def common_ids(s, d):
    return labels.common(table(s, d, "geocode_locs"), table(s, d, "locais_votacao"), "cod_mun_tse")


@query("SELECT row_id, coalesce(qt_comparecimento, qt_aptos - qt_abstencoes, 0) AS turnout FROM merged")
def null_coalesce(s, d):
    return table(s, d, "merged").select("row_id", F.coalesce("qt_comparecimento", F.col("qt_aptos") - F.col("qt_abstencoes"), F.lit(0)).alias("turnout"))


@query("SELECT code_ibge, substr(md5(concat_ws('|', code_ibge, code_tse, uf)), 1, 16) AS key FROM muni_crosswalk")
def cache_key(s, d):
    return table(s, d, "muni_crosswalk").select("code_ibge", store.key_column(F.col("code_ibge"), F.col("code_tse"), F.col("uf")).alias("key"))
