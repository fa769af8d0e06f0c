"""Loading of delivered delimited lines: valid rows typed, all others kept with the reason."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dasymetra.plans.common import free_name

csv.field_size_limit(2**31 - 1)  # fields of any length
_DECIMAL = re.compile(r"-?[0-9]+(?:\.[0-9]+)?")


@dataclass(frozen=True)
class Field:
    """kind: ``int`` (digits within low..high), ``decimal`` (within low..high) or ``text`` (anything)."""

    name: str
    kind: str = "text"
    low: float = 0
    high: float = 2147483647
    required: bool = True

    def fault(self, value: str) -> str | None:
        if self.kind == "text":
            return None
        value = value.strip(" ")
        if not value:
            return "missing" if self.required else None
        if self.kind == "int":
            if not (value.isascii() and value.isdigit()):
                return "not_a_whole_number"
            digits = value.lstrip("0")
            if len(digits) > 18 or not self.low <= int(digits or 0) <= self.high:
                return "out_of_range"
            return None
        if not _DECIMAL.fullmatch(value):
            return "not_a_decimal"
        return None if self.low <= float(value) <= self.high else "out_of_range"


@dataclass(frozen=True)
class Layout:
    fields: tuple[Field, ...]
    separator: str = ";"


#: The layouts of the two feeds, as TESTDATA.md states them.
FEEDS = {
    "geocode_locs": Layout((
        Field("ano", "int", 1000, 9999), Field("cod_mun_tse", "int", 0, 99999), Field("nr_zona", "int", 1, 9999),
        Field("nr_local_votacao", "int", 1), Field("nm_local"),
        Field("lat", "decimal", -90, 90, required=False), Field("long", "decimal", -180, 180, required=False))),
    "merged": Layout((
        Field("ano_eleicao", "int", 1000, 9999), Field("nr_turno", "int", 1, 2), Field("cod_mun_tse", "int", 0, 99999),
        Field("nr_zona", "int", 1, 9999), Field("nr_secao", "int", 1), Field("nr_local_votacao", "int", 1),
        Field("qt_aptos", "int", required=False), Field("qt_comparecimento", "int", required=False),
        Field("qt_abstencoes", "int", required=False))),
}


def split_record(line: str, separator: str) -> tuple[list[str] | None, str | None]:
    """The fields of one record, or the structural fault.

    The strict csv reader assembles the record: within quotes, separators and line breaks are content. Where
    the line has a quote at all, a second walk over it proves that every quote encloses a field or is
    doubled inside one, which the reader alone does not insist on.
    """
    reader = csv.reader(iter([line]), delimiter=separator, quotechar='"', doublequote=True, strict=True)
    try:
        fields = next(reader, [])
    except csv.Error as e:
        said = str(e)
        if "unexpected end" in said:
            return None, "quote_not_closed"
        if "expected after" in said:
            return None, "text_after_closing_quote"
        if "new-line" in said:
            return None, "line_break_outside_quotes"
        return None, "broken_structure"
    if next(reader, None) is not None:
        return None, "more_than_one_record"
    if '"' not in line and "\n" not in line and "\r" not in line:
        return fields, None
    at = 0
    for n, value in enumerate(fields):
        if n:
            at += 1
        if line.startswith('"', at):
            at += len(value) + value.count('"') + 2
        elif '"' in value:
            return None, "quote_inside_field"
        else:
            at += len(value)
    return (fields, None) if at == len(line) else (None, "line_break_outside_quotes")


def check_line(line: str | None, layout: Layout | None) -> tuple[list[str] | None, str | None, str | None]:
    """(fields, reason, name of the field at fault): either fields or a reason."""
    if layout is None:
        return None, "unknown_feed", None
    if line is None:
        return None, "null_line", None
    if not line.strip(" "):
        return None, "blank_line", None
    fields, reason = split_record(line, layout.separator)
    if reason:
        return None, reason, None
    if len(fields) != len(layout.fields):
        return None, "too_few_fields" if len(fields) < len(layout.fields) else "too_many_fields", None
    for field, value in zip(layout.fields, fields):
        if reason := field.fault(value):
            return None, reason, field.name
    return fields, None, None


def parse_lines(lines: DataFrame, layouts: dict[str, Layout] = FEEDS, line: str = "line", feed: str = "feed", keep: list[str] | None = None) -> DataFrame:
    """Every input row once, with ``fields`` (array of text) of a valid line or the ``reason`` and ``at_field`` of a rejected one.

    lines: one record a row; ``feed`` names the layout. keep: the columns carried along (all by default);
    where one is called fields, reason or at_field, the new column's name gets a trailing underscore.
    Defined results: a null line is rejected as null_line, an empty or blank one as blank_line, a null or
    unknown feed as unknown_feed; repeated rows are judged alike and all kept; an empty table gives an
    empty result; lines may be of any length. There is no shuffle: each partition is parsed where it is.
    """
    keep = list(lines.columns if keep is None else keep)
    names: list[str] = []
    for wanted in ("fields", "reason", "at_field"):
        names.append(free_name([*keep, *names], wanted))
    packed = lines.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept") if keep else F.struct(F.lit(True).alias("kept")).alias("kept"),
        F.col(f"`{feed}`").cast("string").alias("feed"), F.col(f"`{line}`").cast("string").alias("line"))

    def parse(batches):
        for batch in batches:
            judged = [check_line(text, layouts.get(name)) for name, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in judged], pa.list_(pa.string())),
                 pa.array([x[1] for x in judged], pa.string()), pa.array([x[2] for x in judged], pa.string())],
                names=["kept", "fields", "reason", "at_field"])

    text = T.StringType()
    schema = T.StructType([packed.schema["kept"], T.StructField("fields", T.ArrayType(text)), T.StructField("reason", text), T.StructField("at_field", text)])
    out = packed.mapInArrow(parse, schema)
    carried = [F.col(f"kept.`{c}`").alias(c) for c in keep]
    return out.select(*carried, *[F.col(a).alias(b) for a, b in zip(("fields", "reason", "at_field"), names)])


def loaded_rows(parsed: DataFrame, layout: Layout, keep: list[str], fields: str = "fields") -> DataFrame:
    """The typed rows of the valid lines of one layout; ``parsed`` comes from parse_lines."""
    kinds = {"int": "int", "decimal": "double"}
    typed = [
        F.col(fields)[i].alias(f.name) if f.kind == "text"
        else F.trim(F.col(fields)[i]).try_cast(kinds[f.kind]).alias(f.name)
        for i, f in enumerate(layout.fields)
    ]
    return parsed.filter(F.col(fields).isNotNull()).select(*keep, *typed)
