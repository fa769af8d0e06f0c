"""SQL that states the results of data_queries independently of the operators."""

_FIELD = r'("([^"]|"")*"|[^";]*)'


def _valid_lines() -> str:
    """raw_lines with the list ``f`` of unquoted fields of structurally valid lines, else null."""
    shape = {n: f"{_FIELD}(;{_FIELD}){{{{{n - 1}}}}}".replace("{{", "{").replace("}}", "}") for n in (7, 9)}
    return f"""
    shaped AS (
      SELECT *, CASE WHEN (feed = 'geocode_locs' AND regexp_full_match(line, '{shape[7]}', 's'))
                       OR (feed = 'merged' AND regexp_full_match(line, '{shape[9]}', 's'))
                THEN list_transform(regexp_extract_all(';' || line, ';{_FIELD}', 0, 's'), lambda x: substr(x, 2)) END AS raw
      FROM raw_lines),
    plain AS (
      SELECT *, list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f
      FROM shaped),
    judged AS (
      SELECT *, coalesce(CASE feed
        WHEN 'merged' THEN {" AND ".join([_whole(1, 1000, 9999), _whole(2, 1, 2), _whole(3, 0, 99999), _whole(4, 1, 9999), _whole(5, 1), _whole(6, 1), _whole(7, 0, empty=True), _whole(8, 0, empty=True), _whole(9, 0, empty=True)])}
        WHEN 'geocode_locs' THEN {" AND ".join([_whole(1, 1000, 9999), _whole(2, 0, 99999), _whole(3, 1, 9999), _whole(4, 1), _decimal(6, 90), _decimal(7, 180)])}
      END, false) AS ok
      FROM plain)"""


def _whole(i: int, low: int, high: int = 2147483647, empty: bool = False) -> str:
    t = f"trim(f[{i}], ' ')"
    ok = f"(regexp_full_match({t}, '[0-9]+') AND coalesce(try_cast({t} AS HUGEINT), -1) BETWEEN {low} AND {high})"
    return f"({t} = '' OR {ok})" if empty else ok


def _decimal(i: int, most: int) -> str:
    t = f"trim(f[{i}], ' ')"
    return f"({t} = '' OR (regexp_full_match({t}, '-?[0-9]+([.][0-9]+)?') AND abs(coalesce(try_cast({t} AS DOUBLE), 999)) <= {most}))"


def _typed(names: str, kinds: str) -> str:
    return ", ".join(
        f"f[{i}] AS {n}" if k == "t" else f"try_cast(nullif(trim(f[{i}], ' '), '') AS {'INTEGER' if k == 'i' else 'DOUBLE'}) AS {n}"
        for i, (n, k) in enumerate(zip(names.split(), kinds), 1))


def _key(c: str) -> str:
    t = f"trim({c}, ' ')"
    return f"(CASE WHEN regexp_full_match({t}, '[0-9]+') THEN coalesce(nullif(ltrim({t}, '0'), ''), '0') ELSE {t} END)"


_ORPHANS = f"""
    register AS (SELECT cod_mun_tse AS m, {_key("nr_zona")} AS z, {_key("nr_local_votacao")} AS l, loaded_at, deleted_at FROM locais_votacao),
    referring AS (
      SELECT 'merged' AS tab_name, row_id AS rec_id, cod_mun_tse AS m, {_key("nr_zona")} AS z, {_key("nr_local_votacao")} AS l, loaded_at AS t, CAST(ano_eleicao AS VARCHAR) AS period FROM merged
      UNION ALL
      SELECT 'geocode_locs', loc_id, cod_mun_tse, {_key("nr_zona")}, {_key("nr_local_votacao")}, loaded_at, CAST(ano AS VARCHAR) FROM geocode_locs),
    met AS (
      SELECT r.tab_name, r.rec_id, r.period, r.m, r.z, r.l, r.t, count(g.z) AS n,
             count(*) FILTER (g.loaded_at <= r.t AND (g.deleted_at IS NULL OR g.deleted_at > r.t)) AS lasting,
             count(*) FILTER (g.loaded_at <= r.t) AS begun
      FROM (SELECT DISTINCT * FROM referring WHERE z IS NOT NULL AND l IS NOT NULL) r LEFT JOIN register g ON r.m = g.m AND r.z = g.z AND r.l = g.l
      GROUP BY ALL),
    orphans AS (
      SELECT DISTINCT tab_name, rec_id, period, CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS state
      FROM met WHERE lasting = 0)"""

_PLAIN = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_CELLS = f"""
    last AS (
      SELECT s.ent_id, d.attr_name, d.attr_type, trim(arg_max_null(s.attr_value, s.loaded_at), ' ') AS v
      FROM secao_attrs s JOIN attr_defs d ON {_PLAIN.format("s.attr_name")} = {_PLAIN.format("d.attr_name")}
      WHERE s.ent_id IS NOT NULL GROUP BY ALL),
    cells AS (
      SELECT *, coalesce(CASE attr_type
        WHEN 'int' THEN regexp_full_match(v, '[0-9]+|[0-9]{{1,3}}([.][0-9]{{3}})+')
        WHEN 'decimal' THEN regexp_full_match(v, '[0-9]+([.,][0-9]+)?')
        WHEN 'boolean' THEN lower(v) IN ('s', 'n', 'sim', 'não', 'true', 'false', '1', '0', 'yes', 'no')
        WHEN 'date' THEN CASE
          WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(v AS DATE) IS NOT NULL
          WHEN regexp_full_match(v, '[0-9]{{2}}([/.])[0-9]{{2}}[/.][0-9]{{4}}') AND substr(v, 3, 1) = substr(v, 6, 1)
            THEN try_cast(substr(v, 7, 4) || '-' || substr(v, 4, 2) || '-' || substr(v, 1, 2) AS DATE) IS NOT NULL
          WHEN regexp_full_match(v, '[0-9]{{8}}') THEN try_cast(substr(v, 1, 4) || '-' || substr(v, 5, 2) || '-' || substr(v, 7, 2) AS DATE) IS NOT NULL
          ELSE false END
        ELSE v <> '' END, false) AS ok
      FROM last)"""

#: The rows of attr_defs, which are fixed, by type.
_ATTRIBUTES = {
    "int": [f"cand_{n}" for n in (11, 1107, 11070, 14, 17, 21, 21345, 26, 2601, 32, 3233, 38, 41, 41200, 47, 4720, 53, 5312, 53999, 58, 62, 62021, 74, 7404, 81, 81818, 95, 96)]
    + ["genero_feminino", "genero_masculino", "qt_abstencoes", "qt_aptos", "qt_comparecimento", "qt_urnas", "votantes_18_19", "votantes_20", "votantes_21_24", "votantes_25_29"],
    "decimal": ["area_sala_m2", "pct_biometria"], "boolean": ["in_acessivel", "in_secao_agregada"], "date": ["dt_instalacao", "dt_vistoria"], "string": ["ds_observacao", "nm_local"],
}
_READ = {
    "int": "try_cast(replace(v, '.', '') AS DECIMAL(38,0))", "decimal": "try_cast(replace(v, ',', '.') AS DOUBLE)", "boolean": "lower(v) IN ('s', 'sim', 'true', '1', 'yes')", "string": "v",
    "date": """CASE WHEN length(v) = 8 THEN try_cast(substr(v, 1, 4) || '-' || substr(v, 5, 2) || '-' || substr(v, 7, 2) AS DATE) WHEN substr(v, 5, 1) = '-' THEN try_cast(v AS DATE)
      ELSE try_cast(substr(v, 7, 4) || '-' || substr(v, 4, 2) || '-' || substr(v, 1, 2) AS DATE) END""",
}
_WIDE = ", ".join(f"max(CASE WHEN ok AND attr_name = '{n}' THEN {_READ[k]} END) AS {n}" for k, names in _ATTRIBUTES.items() for n in names)

_USABLE = "lat IS NOT NULL AND long IS NOT NULL AND lat <> -1 AND long <> -1 AND loc_id IS NOT NULL"

_HELD = f"""WITH pts AS (SELECT loc_id, min(lat) AS y, min(long) AS x FROM geocode_locs WHERE {_USABLE} GROUP BY 1),
        banded AS (SELECT *, CAST(floor(y / 0.00091) AS BIGINT) AS band FROM pts),
        edges AS (
          SELECT code_tract, unnest(list_transform(range(1, len(r) + 1), lambda i: {{'a': r[i], 'b': r[CASE WHEN i = len(r) THEN 1 ELSE i + 1 END]}})) AS e
          FROM (SELECT code_tract, unnest(rings) AS r FROM tracts_sf)),
        boxed AS (
          SELECT code_tract, min(least(e.a.x, e.b.x)) AS x0, max(greatest(e.a.x, e.b.x)) AS x1, min(least(e.a.y, e.b.y)) AS y0, max(greatest(e.a.y, e.b.y)) AS y1
          FROM edges GROUP BY 1),
        held AS (
          SELECT p.loc_id, b.code_tract
          FROM pts p JOIN boxed b ON p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1 JOIN edges ON edges.code_tract = b.code_tract
          WHERE (e.a.y > p.y) <> (e.b.y > p.y) AND p.x < (e.b.x - e.a.x) * (p.y - e.a.y) / (e.b.y - e.a.y) + e.a.x
          GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""

ORACLES = {
    "p1_found": f"WITH {_valid_lines()} SELECT line_id FROM judged WHERE NOT ok",
    "p1_report": f"""WITH {_valid_lines()}
        SELECT feed, file_name, count(*) AS n_lines, count(*) FILTER (ok) AS n_loaded, count(*) FILTER (NOT ok) AS n_rejected FROM judged GROUP BY ALL""",
    "p1_loaded_geocode": f"""WITH {_valid_lines()} SELECT line_id, {_typed("ano cod_mun_tse nr_zona nr_local_votacao nm_local lat long", "iiiitdd")}
        FROM judged WHERE ok AND feed = 'geocode_locs'""",
    "p1_loaded_merged": f"""WITH {_valid_lines()}
        SELECT line_id, {_typed("ano_eleicao nr_turno cod_mun_tse nr_zona nr_secao nr_local_votacao qt_aptos qt_comparecimento qt_abstencoes", "iiiiiiiii")}
        FROM judged WHERE ok AND feed = 'merged'""",
    "p2_found": f"""{_HELD}
        SELECT a.loc_id, 'near' AS kind, CAST(b.loc_id AS VARCHAR) AS other_key
        FROM banded a JOIN (SELECT *, unnest([band - 1, band, band + 1]) AS near_band FROM banded) b ON a.band = b.near_band AND a.loc_id < b.loc_id AND abs(a.x - b.x) < 0.01
        WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) <= 100
        UNION ALL SELECT loc_id, 'in', code_tract FROM held""",
    "p2_tract_counts": f"{_HELD} SELECT code_tract, count(*) AS n_locations FROM held GROUP BY 1",
    "p4_found": f"WITH {_ORPHANS} SELECT DISTINCT tab_name, rec_id, state FROM orphans",
    "p4_report": f"WITH {_ORPHANS} SELECT 'locais_votacao' AS parent_table, tab_name, period, state, count(*) AS n_rows FROM orphans GROUP BY ALL",
    "p5_found": f"WITH {_CELLS} SELECT ent_id, attr_name FROM cells WHERE ok",
    "p5_wide": f"""WITH {_CELLS}, raw AS (
          SELECT s.ent_id, d.attr_name, arg_max_null(s.attr_value, s.loaded_at) AS attr_value
          FROM secao_attrs s JOIN attr_defs d ON {_PLAIN.format("s.attr_name")} = {_PLAIN.format("d.attr_name")} WHERE s.ent_id IS NOT NULL GROUP BY ALL)
        SELECT ent_id, {_WIDE}, 
          '{{' || coalesce(string_agg(CAST(to_json(attr_name) AS VARCHAR) || ':' || coalesce(CAST(to_json(attr_value) AS VARCHAR), 'null'), ',' ORDER BY attr_name) FILTER (NOT ok), '') || '}}' AS failures
        FROM cells JOIN raw USING (ent_id, attr_name) GROUP BY ent_id""",
    "p5_failures": f"""WITH {_CELLS}, latest AS (
          SELECT s.ent_id, d.attr_name, arg_max_null(s.attr_value, s.loaded_at) AS attr_value
          FROM secao_attrs s JOIN attr_defs d ON {_PLAIN.format("s.attr_name")} = {_PLAIN.format("d.attr_name")} WHERE s.ent_id IS NOT NULL GROUP BY ALL)
        SELECT c.ent_id, c.attr_name, l.attr_value FROM cells c JOIN latest l ON c.ent_id = l.ent_id AND c.attr_name = l.attr_name WHERE NOT ok""",
}
