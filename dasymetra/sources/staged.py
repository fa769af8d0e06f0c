"""Readers of staged tables: projection and filters reach the scan, text is cast by rule, aliases become one name."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dasymetra.functions.text import decimal_comma, padded, unpadded

#: Other names under which columns are delivered, and the name used here.
ALIASES = {
    "CODIGO_CARGO": "CD_CARGO", "NUM_ZONA": "NR_ZONA", "NUM_SECAO": "NR_SECAO", "NUMERO_CANDIDATO": "NR_VOTAVEL",
    "QTDE_VOTOS": "QT_VOTOS", "NUM_LOCAL_VOTACAO": "NR_LOCAL_VOTACAO", "COD_MUN_TSE": "CD_MUNICIPIO",
}
#: The one alias that counts even where the usual column is there as well.
OVERWRITES = ("CODIGO_CARGO",)


def read_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A staged ;-separated file, all columns as text; compressed files are read as they are."""
    return spark.read.option("sep", ";").option("header", True).option("encoding", encoding).csv(path)


def preferred(files: list[str], suffix: str = "_BRASIL.csv") -> list[str]:
    """Of the files of an archive the one for the whole country, if there is one, else all; case aside."""
    whole = [f for f in files if f.upper().endswith(suffix.upper())]
    return sorted(whole)[:1] if whole else sorted(files)


def read_optional(spark: SparkSession, path: str, read=None) -> DataFrame | None:
    """A staged table, or None where it is not there, empty of columns or not readable: a year that was never delivered is no error."""
    try:
        out = (read or (lambda s, p: s.read.parquet(p)))(spark, path)
    except AnalysisException:
        return None
    except Py4JJavaError as e:
        if "FAILED_READ_FILE" not in str(e):
            raise
        return None
    return out if out.columns else None


def profile(df: DataFrame, municipality: str | None = None) -> DataFrame:
    """Voter profiles: the needed columns checked, labels trimmed, counts cast, codes padded and filtered."""
    out = require(with_aliases(df), ["CD_MUNICIPIO", "NR_ZONA", "NR_SECAO", "DS_FAIXA_ETARIA", "QT_ELEITORES_PERFIL"])
    labels = [c for c in ("DS_FAIXA_ETARIA", "DS_GENERO", "DS_GRAU_ESCOLARIDADE") if c in out.columns]
    out = out.withColumns({c: F.trim(c) for c in labels} | {"QT_ELEITORES_PERFIL": F.trim("QT_ELEITORES_PERFIL").try_cast("int"), "CD_MUNICIPIO": padded(F.col("CD_MUNICIPIO"))})
    return _picked(out, municipality, None, None)


def within(df: DataFrame, towns: DataFrame, key: str, digits: int = 7) -> DataFrame:
    """Boundaries of the given towns (prefix): those whose key begins with the town's code."""
    return df.withColumn("_prefix", F.substring(key, 1, digits)).join(towns.select(F.col("prefix").alias("_prefix")).distinct(), "_prefix", "left_semi").drop("_prefix")


def roads(df: DataFrame, highway: str = "highway") -> DataFrame:
    """Road lines that have a kind; the filter reaches the scan."""
    return df.filter(F.col(highway).isNotNull())


def wkb_rings(data: bytes | None) -> list | None:
    """The rings of a polygon or multipolygon in well-known binary, with or without Z, M and a reference system; None for anything else or what is cut short.

    Rings are made valid as even-odd rings: repeated points go, and rings of fewer than three different points.
    """

    def geometry(at):
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5 + (4 if kind & 0x20000000 else 0)
        width = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0x0FFFFFFF
        width, kind = width + (0, 1, 1, 2)[kind // 1000] if kind >= 1000 else width, kind % 1000
        if kind not in (3, 6):
            raise ValueError(kind)
        (n,) = struct.unpack_from(order + "I", data, at)
        at, rings = at + 4, []
        for _ in range(n):
            if kind == 6:
                more, at = geometry(at)
                rings += more
                continue
            (size,) = struct.unpack_from(order + "I", data, at)
            numbers = struct.unpack_from(f"{order}{size * width}d", data, at + 4)
            at += 4 + 8 * size * width
            points = list(zip(numbers[::width], numbers[1::width]))
            kept = [p for k, p in enumerate(points) if k == 0 or p != points[k - 1]]
            if len(set(kept)) >= 3:
                rings.append([{"x": x, "y": y} for x, y in kept])
        return rings, at

    try:
        return geometry(0)[0] if data else None
    except (struct.error, ValueError, IndexError):
        return None


def with_rings(df: DataFrame, wkb: str = "geometry", name: str = "rings") -> DataFrame:
    """Zones with their rings in place of well-known binary; null where it cannot be read. No shuffle."""
    keep = [c for c in df.columns if c != wkb]
    packed = df.select(F.struct(*keep).alias("kept"), F.col(wkb).alias("wkb"))

    def run(batches):
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([wkb_rings(b) for b in batch.column(1).to_pylist()], kind)], names=["kept", "rings"])

    out = packed.mapInArrow(run, f"kept {packed.schema['kept'].dataType.simpleString()}, rings array<array<struct<x: double, y: double>>>")
    return out.select("kept.*", F.col("rings").alias(name))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def with_aliases(df: DataFrame) -> DataFrame:
    for alias, name in ALIASES.items():
        if alias in df.columns:
            df = df.drop(name).withColumnRenamed(alias, name) if name not in df.columns or alias in OVERWRITES else df.drop(alias)
    return df


def votes(df: DataFrame, municipality: str | None = None, offices: list[int] | None = None, turn: int | None = None) -> DataFrame:
    """Section votes: the five needed columns checked, numbers cast (null where they are none), codes padded, then filtered."""
    out = require(with_aliases(df), ["CD_MUNICIPIO", "NR_TURNO", "CD_CARGO", "NR_VOTAVEL", "QT_VOTOS"])
    out = out.withColumns({c: F.col(c).try_cast("int") for c in ("NR_TURNO", "CD_CARGO", "QT_VOTOS")} | {"CD_MUNICIPIO": padded(F.col("CD_MUNICIPIO"))})
    return _picked(out, municipality, offices, turn)


def turnout(df: DataFrame, municipality: str | None = None, turn: int | None = None, uf: str | None = None) -> DataFrame:
    out = require(with_aliases(df), ["CD_MUNICIPIO", "NR_TURNO", "QT_COMPARECIMENTO"])
    numbers = [c for c in ("NR_TURNO", "QT_COMPARECIMENTO", "QT_APTOS", "QT_ABSTENCOES") if c in out.columns]
    out = out.withColumns({c: F.col(c).try_cast("int") for c in numbers} | {"CD_MUNICIPIO": padded(F.col("CD_MUNICIPIO"))})
    if uf is not None and "SG_UF" in out.columns:
        out = out.filter(F.col("SG_UF") == uf)
    return _picked(out, municipality, None, turn)


def _picked(df: DataFrame, municipality, offices, turn) -> DataFrame:
    if municipality is not None:
        df = df.filter(F.col("CD_MUNICIPIO") == municipality)
    if offices is not None:
        df = df.filter(F.col("CD_CARGO").isin(*offices))
    return df if turn is None else df.filter(F.col("NR_TURNO") == turn)


def legends(df: DataFrame) -> DataFrame:
    return require(df, ["NR_PARTIDO", "SG_PARTIDO"]).select(unpadded(F.col("NR_PARTIDO")).alias("NR_PARTIDO"), F.trim("SG_PARTIDO").alias("SG_PARTIDO")).distinct()


def places(df: DataFrame, lat: str, lon: str, keys: list[str], missing: float = -1.0) -> DataFrame:
    """Polling places: keys as whole numbers, coordinates as numbers with the mark for missing as null."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    known = lambda c: F.when(number(c) != missing, number(c))
    return df.select(*[unpadded(F.col(k)).alias(k) for k in keys], known(lat).alias("lat"), known(lon).alias("lon"))


def projected(df: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    """The key columns and those whose name matches: the scan reads no others."""
    return df.select(*keys, *[c for c in df.columns if re.search(pattern, c) and c not in keys])


def income(df: DataFrame, zone: str, value: str, prefix: str | None = None) -> DataFrame:
    """(zone_id, income) with a decimal comma read; prefix limits the zones."""
    out = df.select(F.col(zone).cast("string").alias("zone_id"), decimal_comma(F.col(value).cast("string")).alias("income"))
    return out if prefix is None else out.filter(F.col("zone_id").startswith(prefix))


def union_on_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both on the columns that both have, in the first one's order."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(common).unionByName(b.select(common))


def is_federal(year: int) -> bool:
    return year % 4 == 2


def cropped(raster: DataFrame, x0: float, y0: float, x1: float, y1: float, margin: float = 0.01) -> DataFrame:
    """Cells of a raster stored as rows within a box and a margin; the range reaches the scan."""
    return raster.filter(F.col("cell_x").between(x0 - margin, x1 + margin) & F.col("cell_y").between(y0 - margin, y1 + margin))
