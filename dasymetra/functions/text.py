"""Column functions on codes, labels and names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _marked() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they stand for, by the canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, UNMARKED = _marked()
PARTICLES = ("de", "da", "do", "das", "dos", "e")

#: Office codes and their names.
OFFICES = {1: "presidente", 3: "governador", 5: "senador", 6: "deputado_federal", 7: "deputado_estadual", 8: "deputado_distrital", 11: "prefeito", 13: "vereador"}

#: The label of an age group in a voter profile, and the bucket it belongs to. Younger and older groups have none.
AGE_BUCKETS = {
    "18 anos": "votantes_18_19", "19 anos": "votantes_18_19", "20 anos": "votantes_20", "21 a 24 anos": "votantes_21_24", "25 a 29 anos": "votantes_25_29",
    "30 a 34 anos": "votantes_30_34", "35 a 39 anos": "votantes_35_39", "40 a 44 anos": "votantes_40_44", "45 a 49 anos": "votantes_45_49",
    "50 a 54 anos": "votantes_50_54", "55 a 59 anos": "votantes_55_59", "60 a 64 anos": "votantes_60_64", "65 a 69 anos": "votantes_65_69",
}

#: The region of each federative unit and its name in addresses of road extracts.
EXTRACTS = {
    "AC": ("north", "acre"), "AM": ("north", "amazonas"), "AP": ("north", "amapa"), "PA": ("north", "para"), "RO": ("north", "rondonia"), "RR": ("north", "roraima"), "TO": ("north", "tocantins"),
    "AL": ("northeast", "alagoas"), "BA": ("northeast", "bahia"), "CE": ("northeast", "ceara"), "MA": ("northeast", "maranhao"), "PB": ("northeast", "paraiba"),
    "PE": ("northeast", "pernambuco"), "PI": ("northeast", "piaui"), "RN": ("northeast", "rio-grande-do-norte"), "SE": ("northeast", "sergipe"),
    "DF": ("central-west", "distrito-federal"), "GO": ("central-west", "goias"), "MS": ("central-west", "mato-grosso-do-sul"), "MT": ("central-west", "mato-grosso"),
    "ES": ("southeast", "espirito-santo"), "MG": ("southeast", "minas-gerais"), "RJ": ("southeast", "rio-de-janeiro"), "SP": ("southeast", "sao-paulo"),
    "PR": ("south", "parana"), "RS": ("south", "rio-grande-do-sul"), "SC": ("south", "santa-catarina"),
}

#: Schooling, by the words that the label must hold in order, each tried after those above it.
SCHOOLING = (
    ("ANALFABETO", "ANALFABETO"), ("LE E ESCREVE", "LE_ESCREVE"), ("FUNDAMENTAL.+INCOMPLETO", "FUND_INCOMP"), ("FUNDAMENTAL.+COMPLETO", "FUND_COMP"), ("MEDIO.+INCOMPLETO", "MEDIO_INCOMP"),
    ("MEDIO.+COMPLETO", "MEDIO_COMP"), ("SUPERIOR.+INCOMPLETO", "SUP_INCOMP"), ("SUPERIOR.+COMPLETO", "SUP_COMP"), ("NAO.+INFORMADO", "NAO_INFORMADO"),
)


def plain(c: Column) -> Column:
    """Marks on Latin letters left out, also those that stand behind their letter; anything else stays."""
    return F.regexp_replace(F.translate(c, MARKED, UNMARKED), "[\u0300-\u036f]+", "")


def name_key(c: Column) -> Column:
    """How names are compared: without marks, case and surrounding spaces."""
    return F.upper(plain(F.trim(c)))


def title_case(c: Column) -> Column:
    """Portuguese title case: each word capitalised, particles in lower case."""
    words = F.split(F.lower(F.trim(c)), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(*PARTICLES), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def padded(c: Column, width: int = 5) -> Column:
    """A code with leading zeros; longer codes stay as they are."""
    t = F.trim(c.cast("string"))
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def unpadded(c: Column) -> Column:
    """A code as a whole number in text; null where it is none."""
    return F.trim(c.cast("string")).try_cast("bigint").cast("string")


def decimal_comma(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def lookup(c: Column, values: dict) -> Column:
    """The value of a key by a small fixed table; null for others."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[c]


def age_bucket(label: Column) -> Column:
    return lookup(F.trim(label), AGE_BUCKETS)


def gender(label: Column) -> Column:
    t = F.upper(label)
    return F.when(t.contains("MASCULINO"), "hom").when(t.contains("FEMININO"), "mul")


def literacy(label: Column) -> Column:
    """nalf where the label says illiterate anywhere, else alf, also for a null."""
    return F.when(F.upper(F.trim(label)).contains("ANALFABETO"), "nalf").otherwise("alf")


def education(label: Column) -> Column:
    """One name for each level; a label of none becomes a name, each sign in it an underscore."""
    t = name_key(label)
    out = F.when(t.isNull(), None)
    for pattern, level in SCHOOLING:
        out = out.when(t.rlike(pattern), level)
    return out.otherwise(F.regexp_replace(t, "[^A-Z0-9]", "_"))


def office_label(code: Column) -> Column:
    """The office's name; codes without one become CARGO and the code."""
    return F.coalesce(lookup(code.cast("int"), OFFICES), F.concat(F.lit("CARGO"), code.cast("string")))


def office_code(name: str | int) -> int:
    """The code of an office given by name or code; an unknown name is an error."""
    if isinstance(name, int):
        return name
    by_name = {v: k for k, v in OFFICES.items()}
    if name.lower() not in by_name:
        raise ValueError(f"unknown office {name!r}; known: {', '.join(by_name)}")
    return by_name[name.lower()]


def extract(uf: Column) -> Column:
    """(region, state) of a federative unit as road extracts call them; null for none of them."""
    code = F.upper(F.trim(uf))
    parts = [lookup(code, {u: e[k] for u, e in EXTRACTS.items()}) for k in (0, 1)]
    return F.when(parts[0].isNotNull(), F.struct(parts[0].alias("region"), parts[1].alias("state")))


def bracket_label(c: Column) -> Column:
    """Readable name of a bracket column: the prefix gone, sex first, the age span with a dash, an open end with a plus."""
    t = F.regexp_replace(c, "^(pop|vot|votantes)_", "")
    for pattern, by in (("^hom_", "Male "), ("^mul_", "Female "), ("_mais$", "+"), ("_", "-")):
        t = F.regexp_replace(t, pattern, by)
    return t


def census_year(year: Column) -> Column:
    return F.when(year <= 2004, 2000).when(year <= 2016, 2010).otherwise(2022)


def election_day(year: Column, known: Column) -> Column:
    """The known date, or else the first Sunday of October."""
    return F.coalesce(known, F.next_day(F.date_sub(F.make_date(year, F.lit(10), F.lit(1)), 1), "Sun"))
