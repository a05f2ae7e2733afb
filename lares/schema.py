"""Column names, vocabularies and lookups of the household registry.

Everything here is a fixed value: the input headers, the category texts, the component codes and names
are what registry extracts contain and what the report must show.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Input columns (fixed values) -------------------------------------------------------------------

KEY = "Codigo familiar"
SITUATION = "Situacao do domicilio"
DWELLING = "Especie do domicilio"
WALLS = "Material predominante nas paredes externas do domicilio"
FLOOR = "Material predominante no piso do domicilio"
SEWAGE = "Forma de escoamento sanitario"
WATER_SUPPLY = "Forma de abastecimento de agua"
LIGHTING = "Tipo de iluminacao"
REFUSE = "Forma de coleta do lixo"
BATHROOM = "Existencia de banheiro"
PIPED_WATER = "Agua canalizada no domicilio"
PERSONS = "Quantidade de pessoas no domicilio"
BEDROOMS = "Comodo servindo como dormitorio do domicilio"
ROOMS = "Quantidade de comodos do domicilio"
FAMILIES = "Quantidade de familias no domicilio"
RENT = "Valor de despesas com aluguel"
INCOME = "Valor da renda total da familia"
COMPLEMENT = "Complemento"
HOMELESS = "Situacao de Rua"

NUMERIC = (PERSONS, BEDROOMS, ROOMS, FAMILIES, RENT, INCOME)

FAMILY_COLUMNS = (
    KEY, SITUATION, DWELLING, WALLS, FLOOR, SEWAGE, WATER_SUPPLY, LIGHTING, REFUSE, BATHROOM,
    PIPED_WATER, PERSONS, BEDROOMS, ROOMS, FAMILIES, RENT, INCOME, COMPLEMENT,
)

# Headers as some extracts spell them (the letter "x" is lost) -> header used here.
HEADER_VARIANTS = {
    "Material predominante nas paredes eternas do domicilio": WALLS,
    "Forma de coleta do lio": REFUSE,
    "Eistencia de banheiro": BATHROOM,
}


def _field(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType() if name in NUMERIC else T.StringType(), True)


FAMILY_SCHEMA = T.StructType([_field(c) for c in FAMILY_COLUMNS])
PERSON_SCHEMA = T.StructType([*FAMILY_SCHEMA.fields, _field(HOMELESS)])

# --- Conditions and row kinds (fixed values) --------------------------------------------------------

BAD = "Inadequado"
OK = "Adequado"
MISSING = "Sem Dados ou Não Aplicável"

ROW_ID = "ID"
ROW_KIND = "Familias novas"
FAMILY_ROW = "ID0"
COHABITING_ROWS = ("ID1", "ID2", "ID3")
HOMELESS_ROW = "ID7"
STACKING_ORDER = (FAMILY_ROW, HOMELESS_ROW, *COHABITING_ROWS)

DEFICIT = "Déficit"
INADEQUACY = "Inadequação"
CLASS = "Déficit ou Inadequação"

DEFICIT_CODES = ("D01", "D02", "D03", "D04", "D05", "D06")
HOMELESS_CODE = "D07"
INADEQUACY_CODES = ("I01", "I02", "I03", "I04", "I05", "I06", "I07", "I08", "I09")

CODE = "Codigo"
CONDITION = "Condicao"
COMPONENT = "Componente"
SHARE = "%"

COMPONENT_NAMES = {
    "Déficit": "Total Déficit",
    "Inadequação": "Total Inadequação",
    "D01": "Domicílio Improvisado",
    "D02": "Material de Parede Inadequado",
    "D03": "Densidade Excessiva em Apartamento ou Lote Condominial",
    "D04": "Coabitação",
    "D05": "Aluguel com Inadequações",
    "D06": "Moradia em Cômodo",
    "D07": "Famílias em Situação de Rua",
    "I01": "Densidade Excessiva",
    "I02": "Ausência de Banheiro",
    "I03": "Material do Piso",
    "I04": "Água Canalizada (Urbano)",
    "I05": "Esgotamento Sanitário",
    "I06": "Abastecimento de Água por Rede Pública (Urbano)",
    "I07": "Energia Elétrica",
    "I08": "Coleta de Lixo (Urbano)",
    "I09": "Ônus Excessivo com Aluguel",
}

# --- Category texts (fixed values) ------------------------------------------------------------------

URBAN = "urbana"
YES = "sim"
NO = "nao"
HOMELESS_YES = "Sim"

CATEGORIES = {
    DWELLING: {
        BAD: ["particular improvisado"],
        OK: ["particular permanente", "coletivo"],
    },
    WALLS: {
        BAD: ["taipa nao revestida", "madeira aproveitada", "palha", "outro material"],
        OK: [
            "alvenaria/tijolo sem revestimento",
            "alvenaria/tijolo com revestimento",
            "madeira aparelhada",
            "taipa revestida",
        ],
    },
    FLOOR: {
        BAD: ["terra", "madeira aproveitada"],
        OK: ["ceramica lajota ou pedra", "cimento", "madeira aparelhada", "carpete", "outro material"],
    },
    SEWAGE: {
        BAD: [
            "fossa rudimentar",
            "vala a ceu aberto",
            "direto para um rio lago ou mar",
            "outra forma",
        ],
        OK: ["rede coletora de esgoto ou pluvial", "fossa septica"],
    },
    WATER_SUPPLY: {
        BAD: ["poco ou nascente", "cisterna", "outra forma"],
        OK: ["rede geral de distribuicao"],
    },
    LIGHTING: {
        BAD: ["eletrica sem medidor", "oleo querosene ou gas", "vela", "outra forma"],
        OK: ["eletrica com medidor proprio", "eletrica com medidor comunitario"],
    },
    REFUSE: {
        BAD: [
            "queimado ou enterrado na propriedade",
            "jogado em terreno baldio ou logradouro",
            "jogado em rio ou mar",
            "outro destino",
        ],
        OK: ["coletado diretamente", "coletado indiretamente"],
    },
    BATHROOM: {BAD: [NO], OK: [YES]},
    PIPED_WATER: {BAD: [NO], OK: [YES]},
}

# Words in the address complement that tell an apartment or a shared lot (substring match, upper case).
SHARED_LOT_WORDS = [
    "AP", "ANDAR", "PAVIMENTO", "BL", "TORRE", "PREDIO", "FUNDO", "FUNDOS", "FRENTE", "FRT", "CIMA",
    "BAIXO", "SUPERIOR", "INFERIOR", "TERREA", "DIREITA", "ESQUERDA", "MEIO", "EDICULA", "PRINCIPAL",
    "PORAO", "BAR", "GARAGEM", "TRAILER", "BARRACO", "CDHU", "BLOCO", "TOR", "TORR", "APART", "APT",
    "APARTAMENTO", "APTO", "ED", "EDIF", "EDIFICIO",
]

CROWDED = 3.0
EXCESSIVE_BURDEN = 0.3
