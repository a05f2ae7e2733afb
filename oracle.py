"""DuckDB SQL with the same results as the registered queries, written out independently of the library.

Column names, category texts, codes, component names and the listed address words are fixed values.
"""

from __future__ import annotations

PERSONS = """
persons AS (
  SELECT
    CAST(c_custkey AS VARCHAR) AS k,
    CASE c_custkey % 5 WHEN 0 THEN 'rural' WHEN 4 THEN NULL ELSE 'urbana' END AS situ,
    CASE c_custkey % 11 WHEN 0 THEN 'particular improvisado' WHEN 1 THEN 'coletivo' WHEN 2 THEN NULL
      ELSE 'particular permanente' END AS dwelling,
    CASE c_custkey % 9 WHEN 0 THEN 'taipa nao revestida' WHEN 1 THEN 'madeira aproveitada'
      WHEN 2 THEN 'palha' WHEN 3 THEN 'outro material' WHEN 4 THEN 'alvenaria/tijolo sem revestimento'
      WHEN 5 THEN 'alvenaria/tijolo com revestimento' WHEN 6 THEN 'madeira aparelhada'
      WHEN 7 THEN 'taipa revestida' END AS walls,
    CASE c_custkey % 8 WHEN 0 THEN 'ceramica lajota ou pedra' WHEN 1 THEN 'cimento'
      WHEN 2 THEN 'madeira aparelhada' WHEN 3 THEN 'carpete' WHEN 4 THEN 'outro material'
      WHEN 5 THEN 'terra' WHEN 6 THEN 'madeira aproveitada' END AS floor,
    CASE (c_custkey % 61) % 7 WHEN 0 THEN 'rede coletora de esgoto ou pluvial' WHEN 1 THEN 'fossa septica'
      WHEN 2 THEN 'fossa rudimentar' WHEN 3 THEN 'vala a ceu aberto'
      WHEN 4 THEN 'direto para um rio lago ou mar' WHEN 5 THEN 'outra forma' END AS sewage,
    CASE (c_custkey % 23) % 5 WHEN 0 THEN 'rede geral de distribuicao' WHEN 1 THEN 'poco ou nascente'
      WHEN 2 THEN 'cisterna' WHEN 3 THEN 'outra forma' END AS supply,
    CASE (c_custkey % 29) % 7 WHEN 0 THEN 'eletrica com medidor proprio'
      WHEN 1 THEN 'eletrica com medidor comunitario' WHEN 2 THEN 'eletrica sem medidor'
      WHEN 3 THEN 'oleo querosene ou gas' WHEN 4 THEN 'vela' WHEN 5 THEN 'outra forma' END AS light,
    CASE (c_custkey % 31) % 7 WHEN 0 THEN 'coletado diretamente' WHEN 1 THEN 'coletado indiretamente'
      WHEN 2 THEN 'queimado ou enterrado na propriedade'
      WHEN 3 THEN 'jogado em terreno baldio ou logradouro' WHEN 4 THEN 'jogado em rio ou mar'
      WHEN 5 THEN 'outro destino' END AS refuse,
    CASE c_custkey % 13 WHEN 0 THEN 'nao' WHEN 1 THEN NULL ELSE 'sim' END AS bath,
    CASE c_custkey % 17 WHEN 0 THEN 'nao' WHEN 1 THEN NULL ELSE 'sim' END AS piped,
    CAST(c_custkey % 10 AS DOUBLE) AS pers,
    CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_custkey % 4 AS DOUBLE) END AS bedrooms,
    CASE WHEN c_custkey % 6 <> 5 THEN CAST(c_custkey % 6 AS DOUBLE) END AS rooms,
    CASE WHEN (c_custkey % 53) % 7 <> 6 THEN CAST((c_custkey % 53) % 7 AS DOUBLE) END AS fams,
    CASE WHEN c_custkey % 41 <> 0 THEN CAST((c_custkey % 37) * 25 AS DOUBLE) END AS rent,
    CAST((c_custkey % 43) * 50 AS DOUBLE) AS income,
    CASE WHEN o_orderkey % 101 <> 0 THEN
      CASE c_custkey % 7 WHEN 0 THEN 'AP 12' WHEN 1 THEN 'CASA' WHEN 2 THEN 'FUNDOS' WHEN 3 THEN 'casa ap'
        WHEN 4 THEN 'RUA REDONDO' WHEN 6 THEN 'LOTE 3' END END AS compl,
    CASE o_orderkey % 97 WHEN 0 THEN 'Sim' WHEN 1 THEN NULL ELSE 'Nao' END AS street
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

ATTRIBUTES = [
    "situ", "dwelling", "walls", "floor", "sewage", "supply", "light", "refuse", "bath", "piped",
    "pers", "bedrooms", "rooms", "fams", "rent", "income", "compl",
]

HEADERS = {
    "k": "Codigo familiar",
    "situ": "Situacao do domicilio",
    "dwelling": "Especie do domicilio",
    "walls": "Material predominante nas paredes externas do domicilio",
    "floor": "Material predominante no piso do domicilio",
    "sewage": "Forma de escoamento sanitario",
    "supply": "Forma de abastecimento de agua",
    "light": "Tipo de iluminacao",
    "refuse": "Forma de coleta do lixo",
    "bath": "Existencia de banheiro",
    "piped": "Agua canalizada no domicilio",
    "pers": "Quantidade de pessoas no domicilio",
    "bedrooms": "Comodo servindo como dormitorio do domicilio",
    "rooms": "Quantidade de comodos do domicilio",
    "fams": "Quantidade de familias no domicilio",
    "rent": "Valor de despesas com aluguel",
    "income": "Valor da renda total da familia",
    "compl": "Complemento",
    "street": "Situacao de Rua",
    "kind": "Familias novas",
    "textid": "ID",
}

FAMILIES = f"""
fam AS (SELECT DISTINCT k, {", ".join(ATTRIBUTES)} FROM persons),
street_keys AS (SELECT DISTINCT k FROM persons WHERE street = 'Sim')"""


def _wide_persons(further: int) -> str:
    """The stand-in with family columns that no rule knows."""
    extras = "".join(f',\n    CAST(o_orderkey % {i + 1} AS VARCHAR) AS "outra {i}"' for i in range(1, further + 1))
    return PERSONS.replace("\n  FROM orders", f"{extras}\n  FROM orders")


# Orders the rows of one key; any fixed order would do.
_DIGEST = "md5(concat_ws('|', " + ", ".join(f"COALESCE(CAST({a} AS VARCHAR), '?')" for a in ATTRIBUTES) + "))"

_NULLS = ", ".join(f"NULL AS {a}" for a in ATTRIBUTES)


def _base(homeless: bool) -> str:
    """Five-way stack (four-way without homeless rows)."""
    seven = f"UNION ALL SELECT 2, 'ID7', k, {_NULLS} FROM street_keys" if homeless else ""
    return f"""
base AS (
  SELECT 1 AS pos, 'ID0' AS kind, k, {", ".join(ATTRIBUTES)} FROM fam
  {seven}
  UNION ALL SELECT 3, 'ID1', k, {_NULLS} FROM fam WHERE fams > 1
  UNION ALL SELECT 4, 'ID2', k, {_NULLS} FROM fam WHERE fams > 2
  UNION ALL SELECT 5, 'ID3', k, {_NULLS} FROM fam WHERE fams > 3
),
numbered AS (
  SELECT row_number() OVER (ORDER BY pos, k NULLS FIRST, {_DIGEST}) AS id, *
  FROM base
)"""


# x/0 is an infinity with the sign of x; 0/0 is unknown.
def _ratio(a: str, b: str) -> str:
    return f"""CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN CAST('Infinity' AS DOUBLE)
      WHEN {a} < 0 THEN CAST('-Infinity' AS DOUBLE) END ELSE {a} / {b} END"""


_COMPLEMENT = (
    "regexp_matches(compl, 'AP|ANDAR|PAVIMENTO|BL|TORRE|PREDIO|FUNDO|FUNDOS|FRENTE|FRT|CIMA|BAIXO|SUPERIOR"
    "|INFERIOR|TERREA|DIREITA|ESQUERDA|MEIO|EDICULA|PRINCIPAL|PORAO|BAR|GARAGEM|TRAILER|BARRACO|CDHU|BLOCO"
    "|TOR|TORR|APART|APT|APARTAMENTO|APTO|ED|EDIF|EDIFICIO')"
)

RULES = {
    "D01": """CASE WHEN dwelling = 'particular improvisado' THEN 'Inadequado'
      WHEN dwelling IN ('particular permanente', 'coletivo') THEN 'Adequado' END""",
    "D02": """CASE WHEN walls IN ('taipa nao revestida', 'madeira aproveitada', 'palha', 'outro material')
        THEN 'Inadequado'
      WHEN walls IN ('alvenaria/tijolo sem revestimento', 'alvenaria/tijolo com revestimento',
        'madeira aparelhada', 'taipa revestida') THEN 'Adequado' END""",
    "D03": f"""CASE WHEN dens >= 3 AND {_COMPLEMENT} THEN 'Inadequado'
      WHEN dens >= 3 AND NOT {_COMPLEMENT} THEN 'Adequado' END""",
    "D04": "CASE WHEN fams > 1 THEN 'Inadequado' WHEN fams <= 1 THEN 'Adequado' END",
    "D05": """CASE WHEN rent > 0 AND (dens >= 3 OR bath = 'nao' OR floor IN ('terra', 'madeira aproveitada')
        OR (piped = 'nao' AND situ = 'urbana')) THEN 'Inadequado'
      WHEN rent > 0 AND dens < 3 AND bath = 'sim' AND floor IN ('ceramica lajota ou pedra', 'cimento',
        'madeira aparelhada', 'carpete', 'outro material') AND piped = 'sim' AND situ = 'urbana'
        THEN 'Adequado' END""",
    "D06": "CASE WHEN rooms <= 1 THEN 'Inadequado' WHEN rooms > 1 THEN 'Adequado' END",
    "D07": """CASE WHEN EXISTS (SELECT 1 FROM street_keys s WHERE s.k IS NOT DISTINCT FROM m.k)
      THEN 'Inadequado' ELSE 'Adequado' END""",
    "I01": "CASE WHEN dens < 3 THEN 'Adequado' WHEN dens >= 3 THEN 'Inadequado' END",
    "I02": "CASE bath WHEN 'sim' THEN 'Adequado' WHEN 'nao' THEN 'Inadequado' END",
    "I03": """CASE WHEN floor IN ('ceramica lajota ou pedra', 'cimento', 'madeira aparelhada', 'carpete',
        'outro material') THEN 'Adequado'
      WHEN floor IN ('terra', 'madeira aproveitada') THEN 'Inadequado' END""",
    "I04": """CASE WHEN piped = 'sim' AND situ = 'urbana' THEN 'Adequado'
      WHEN piped = 'nao' AND situ = 'urbana' THEN 'Inadequado' END""",
    "I05": """CASE WHEN sewage IN ('rede coletora de esgoto ou pluvial', 'fossa septica') THEN 'Adequado'
      WHEN sewage IN ('fossa rudimentar', 'vala a ceu aberto', 'direto para um rio lago ou mar',
        'outra forma') THEN 'Inadequado' END""",
    "I06": """CASE WHEN supply = 'rede geral de distribuicao' AND situ = 'urbana' THEN 'Adequado'
      WHEN supply IN ('poco ou nascente', 'cisterna', 'outra forma') AND situ = 'urbana'
        THEN 'Inadequado' END""",
    "I07": """CASE WHEN light IN ('eletrica com medidor proprio', 'eletrica com medidor comunitario')
        THEN 'Adequado'
      WHEN light IN ('eletrica sem medidor', 'oleo querosene ou gas', 'vela', 'outra forma')
        THEN 'Inadequado' END""",
    "I08": """CASE WHEN refuse IN ('coletado diretamente', 'coletado indiretamente') AND situ = 'urbana'
        THEN 'Adequado'
      WHEN refuse IN ('queimado ou enterrado na propriedade', 'jogado em terreno baldio ou logradouro',
        'jogado em rio ou mar', 'outro destino') AND situ = 'urbana' THEN 'Inadequado' END""",
    "I09": "CASE WHEN burden < 0.3::DOUBLE THEN 'Adequado' WHEN burden >= 0.3::DOUBLE THEN 'Inadequado' END",
}

D04_CORRECTED = """CASE WHEN kind IN ('ID1', 'ID2', 'ID3') OR fams > 1 THEN 'Inadequado'
      WHEN fams <= 1 THEN 'Adequado' END"""

DEFICIT = ["D01", "D02", "D03", "D04", "D05", "D06"]
INADEQUACY = ["I01", "I02", "I03", "I04", "I05", "I06", "I07", "I08", "I09"]
NO_DATA = "Sem Dados ou Não Aplicável"

NAMES = """
names(code, label) AS (VALUES
  ('Déficit', 'Total Déficit'), ('Inadequação', 'Total Inadequação'),
  ('D01', 'Domicílio Improvisado'), ('D02', 'Material de Parede Inadequado'),
  ('D03', 'Densidade Excessiva em Apartamento ou Lote Condominial'), ('D04', 'Coabitação'),
  ('D05', 'Aluguel com Inadequações'), ('D06', 'Moradia em Cômodo'),
  ('D07', 'Famílias em Situação de Rua'), ('I01', 'Densidade Excessiva'),
  ('I02', 'Ausência de Banheiro'), ('I03', 'Material do Piso'), ('I04', 'Água Canalizada (Urbano)'),
  ('I05', 'Esgotamento Sanitário'), ('I06', 'Abastecimento de Água por Rede Pública (Urbano)'),
  ('I07', 'Energia Elétrica'), ('I08', 'Coleta de Lixo (Urbano)'), ('I09', 'Ônus Excessivo com Aluguel')
)"""


def _codes(homeless: bool) -> list[str]:
    return DEFICIT + (["D07"] if homeless else []) + INADEQUACY


def _measured(source: str) -> str:
    return f"""
measured AS (
  SELECT *, {_ratio("pers", "bedrooms")} AS dens, {_ratio("rent", "income")} AS burden FROM {source}
)"""


def _classified(homeless: bool, corrected: bool = False, source: str = "numbered") -> str:
    rules = {**RULES, "D04": D04_CORRECTED} if corrected else RULES
    codes = _codes(homeless)
    conds = ",\n    ".join(f"COALESCE({rules[c]}, '{NO_DATA}') AS {c}" for c in codes)
    bad_d = " OR ".join(f"{c} = 'Inadequado'" for c in codes if c[0] == "D")
    bad_i = " OR ".join(f"{c} = 'Inadequado'" for c in INADEQUACY)
    ident = "id, kind, k" if source == "numbered" else "kind, k"
    return f"""{_measured(source)},
filled AS (
  SELECT {ident}, COALESCE(situ, '{NO_DATA}') AS situ,
    {conds}
  FROM measured m
),
comp AS (
  SELECT *,
    CASE WHEN {bad_d} THEN 'Inadequado' ELSE 'Adequado' END AS deficit,
    CASE WHEN {bad_i} THEN 'Inadequado' ELSE 'Adequado' END AS inadequacy,
    CASE WHEN {bad_d} THEN 'Déficit' WHEN {bad_i} THEN 'Inadequação' ELSE 'Adequado' END AS class
  FROM filled
)"""


def _chain(homeless: bool, corrected: bool = False) -> str:
    return f"WITH {PERSONS},{FAMILIES},{_base(homeless)},{_classified(homeless, corrected)}"


def _identity() -> str:
    return 'k AS "Codigo familiar", kind AS "Familias novas", situ AS "Situacao do domicilio"'


def _components(homeless: bool, corrected: bool = False) -> str:
    return f"""{_chain(homeless, corrected)}
SELECT id AS "ID", {_identity()}, {", ".join(_codes(homeless))},
  deficit AS "Déficit", inadequacy AS "Inadequação", class AS "Déficit ou Inadequação"
FROM comp"""


def _long(homeless: bool, where: str = "") -> str:
    """One SELECT per code, stacked."""
    columns = [(c, c) for c in _codes(homeless)] + [("Déficit", "deficit"), ("Inadequação", "inadequacy")]
    parts = [
        f"SELECT kind, k, situ, class, '{code}' AS code, {column} AS condition FROM comp {where}"
        for code, column in columns
    ]
    return "\n  UNION ALL ".join(parts)


def _counts(homeless: bool, corrected: bool = False) -> str:
    kept = "(code LIKE 'D%' OR class <> 'Déficit')" if corrected else "TRUE"
    return f"""{_chain(homeless, corrected)},
long AS ({_long(homeless)}),
counts AS (
  SELECT code,
    CAST(COUNT(*) FILTER (WHERE condition = 'Adequado') AS BIGINT) AS ok,
    CAST(COUNT(*) FILTER (WHERE condition = 'Inadequado') AS BIGINT) AS bad,
    CAST(COUNT(*) FILTER (WHERE condition = '{NO_DATA}') AS BIGINT) AS nodata
  FROM long WHERE {kept} GROUP BY code
)"""


def _share(total: str) -> str:
    """bad / total; x/0 is an infinity, 0/0 unknown."""
    return f"CASE WHEN {total} <> 0 THEN CAST(bad AS DOUBLE) / {total} WHEN bad > 0 THEN CAST('inf' AS DOUBLE) END"


def _summary(homeless: bool, corrected: bool = False, totals: tuple[str, str] | None = None) -> str:
    d = counted = "(SELECT bad FROM counts WHERE code = 'Déficit')"
    i = "(SELECT bad FROM counts WHERE code = 'Inadequação')"
    if totals or not corrected:
        d, i = totals or (("6917", "22891") if homeless else ("6020", "22890"))
    return f"""{_counts(homeless, corrected)},
summary AS (
  SELECT code, ok, bad, nodata, {_share(d)} AS share FROM counts
  WHERE code LIKE 'D%'
  UNION ALL
  SELECT code, ok, bad, CAST(nodata + {counted if corrected else d} AS BIGINT), {_share(i)} FROM counts
  WHERE code LIKE 'I%'
)"""


_COUNT_COLUMNS = f'code AS "Codigo", ok AS "Adequado", bad AS "Inadequado", nodata AS "{NO_DATA}"'


def _report(homeless: bool, corrected: bool = False, totals: tuple[str, str] | None = None) -> str:
    return f"""{_summary(homeless, corrected, totals)},{NAMES}
SELECT s.code AS "Codigo", label AS "Componente", bad AS "Inadequado", round_even(share, 3) AS "%",
  ok AS "Adequado", nodata AS "{NO_DATA}"
FROM summary s LEFT JOIN names n ON n.code = s.code ORDER BY s.code"""


def _columns(*names: str) -> str:
    return ", ".join(f'{n} AS "{HEADERS[n]}"' for n in names)


def oracle_sql() -> dict[str, str]:
    families = f"WITH {PERSONS},{FAMILIES}"
    stacked = f"{families},{_base(True)}"
    on_families = f"{families},{_measured('fam')}"
    sql = {
        "standin_persons": f'WITH {PERSONS} SELECT {_columns("k", *ATTRIBUTES, "street")} FROM persons',
        "header_aliases": f'WITH {PERSONS} SELECT {_columns("k", "walls", "refuse", "bath")} FROM persons',
        "safe_ratio": f'{on_families} SELECT {_columns("k", "pers", "bedrooms", "rent", "income")}, '
        "dens AS density, burden AS burden FROM measured",
        "family_distinct": f'{families} SELECT {_columns("k", *ATTRIBUTES)}, \'ID0\' AS "Familias novas", '
        'k AS "ID" FROM fam',
        "positional_slice": f'WITH {PERSONS} SELECT DISTINCT {_columns("k", "situ", "dwelling", "walls")} '
        "FROM persons",
        "homeless_persons": f'WITH {PERSONS} SELECT {_columns("k", "compl", "street")} FROM persons '
        "WHERE street = 'Sim'",
        "cohab_fanout": f"""{families}
SELECT k AS "Codigo familiar", 'Inadequado' AS "D04", kind AS "Familias novas",
  concat(COALESCE(k, 'NA'), ' ', kind) AS "ID"
FROM fam JOIN (VALUES (1, 'ID1'), (2, 'ID2'), (3, 'ID3')) v(n, kind) ON fams > n""",
        "homeless_semi_join": f"""{families}
SELECT {_columns("k", "compl", "fams")} FROM fam f
WHERE EXISTS (SELECT 1 FROM persons p WHERE p.street = 'Sim' AND p.k IS NOT DISTINCT FROM f.k)""",
        "source_csv2": f"""WITH {PERSONS}
SELECT * REPLACE ("{HEADERS['rent']}" + 0.5 AS "{HEADERS['rent']}")
FROM (SELECT {_columns("k", *ATTRIBUTES, "street")} FROM persons)""",
        "family_distinct_wide": f"""WITH {_wide_persons(20)}
SELECT DISTINCT {_columns("k", *ATTRIBUTES)}, {", ".join(f'"outra {i}"' for i in range(1, 21))},
  'ID0' AS "Familias novas", k AS "ID" FROM persons""",
        "homeless_family_count": f"{families} SELECT COUNT(*) AS homeless_families FROM street_keys",
        "homeless_flag_skewed": f"""WITH {PERSONS},
third AS (SELECT * REPLACE (CASE WHEN CAST(k AS BIGINT) % 3 <> 0 THEN k END AS k) FROM persons),
fam AS (SELECT DISTINCT k, {", ".join(ATTRIBUTES)} FROM third),
street_keys AS (SELECT DISTINCT k FROM third WHERE street = 'Sim')
SELECT {_columns("k", "compl", "fams")},
  EXISTS (SELECT 1 FROM street_keys s WHERE s.k IS NOT DISTINCT FROM f.k) AS homeless
FROM fam f""",
        "homeless_distinct": f"""{families}
SELECT k AS "Codigo familiar", 'Inadequado' AS "D07", 'ID7' AS "Familias novas",
  concat(COALESCE(k, 'NA'), ' ID7') AS "ID" FROM street_keys""",
        "homeless_flag": f"""{families}
SELECT {_columns("k", "compl", "fams")},
  EXISTS (SELECT 1 FROM street_keys s WHERE s.k IS NOT DISTINCT FROM f.k) AS homeless
FROM fam f""",
        "union_missing_columns": f"""{stacked}
SELECT {_columns("k", "situ", "fams", "kind")},
  CASE WHEN kind = 'ID0' THEN k ELSE concat(COALESCE(k, 'NA'), ' ', kind) END AS "ID",
  CASE WHEN kind IN ('ID1', 'ID2', 'ID3') THEN 'Inadequado' END AS "D04",
  CASE WHEN kind = 'ID7' THEN 'Inadequado' END AS "D07"
FROM base""",
        "sequential_id": f'{stacked} SELECT id AS "ID", {_columns("k", "kind", *ATTRIBUTES)} FROM numbered',
        "rule_d07": f'{stacked} SELECT {_columns("k", "kind")}, {RULES["D07"]} AS "D07" FROM base m',
        "unpivot_conditions": f"""{_chain(False)}
SELECT {_identity()}, class AS "Déficit ou Inadequação", code AS "Codigo", condition AS "Condicao"
FROM ({_long(False)})""",
        "pivot_counts": f"{_counts(False)} SELECT {_COUNT_COLUMNS} FROM counts",
        "condition_counts": f"{_counts(True)} SELECT {_COUNT_COLUMNS} FROM counts",
        "class_filter": f"""{_chain(True)}
SELECT {_identity()}, class AS "Déficit ou Inadequação" FROM comp WHERE class <> 'Déficit'""",
        "summary_deficit": f"{_summary(False)} SELECT {_COUNT_COLUMNS}, share AS \"%\" FROM summary "
        "WHERE code IN ('D01', 'D02', 'D03', 'D04', 'D05', 'D06', 'Déficit')",
        "summary_inadequacy": f"{_summary(False)} SELECT {_COUNT_COLUMNS}, share AS \"%\" FROM summary "
        "WHERE code IN ('I01', 'I02', 'I03', 'I04', 'I05', 'I06', 'I07', 'I08', 'I09', 'Inadequação')",
        "share_of_total": f'{_summary(True)} SELECT code AS "Codigo", bad AS "Inadequado", share AS "%" '
        "FROM summary",
        "report_union": f'{_summary(True)} SELECT {_COUNT_COLUMNS}, share AS "%" FROM summary',
        "report_lookup": f"""{_counts(True)},{NAMES}
SELECT c.code AS "Codigo", label AS "Componente", ok AS "Adequado", bad AS "Inadequado",
  nodata AS "{NO_DATA}" FROM counts c LEFT JOIN names n ON n.code = c.code""",
        "components_v1": _components(False),
        "components_v2": _components(True),
        "components_corrected": _components(True, corrected=True),
        "report_v1": _report(False),
        "report_v2": _report(True),
        "report_v1_corrected": _report(False, corrected=True),
        "report_corrected": _report(True, corrected=True),
        "report_corrected_totals": _report(True, corrected=True, totals=("6917", "22891")),
        "export_components_parquet": _components(True),
        "export_components_csv": _components(False),
        "export_report_csv": _report(True),
    }
    sql["source_parquet"] = sql["source_csv"] = sql["standin_persons"]
    for code in _codes(False):
        sql[f"rule_{code.lower()}"] = (
            f'{on_families} SELECT {_columns("k", "compl")}, {RULES[code]} AS "{code}" FROM measured m'
        )
    conds = ", ".join(_codes(False))
    sql["fill_missing"] = f"""{families},{_base(False)},{_classified(False, source="base")}
SELECT {_identity()}, {conds} FROM comp"""
    flags = {"deficit": "Déficit", "inadequacy": "Inadequação", "class": "Déficit ou Inadequação"}
    flag_queries = {"flag_deficit": "deficit", "flag_inadequacy": "inadequacy", "deficit_class": "class"}
    for query, column in flag_queries.items():
        sql[query] = f'{_chain(True)} SELECT {_identity()}, {column} AS "{flags[column]}" FROM comp'
    return sql
