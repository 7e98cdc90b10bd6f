"""Names, word lists and labels the input files and reports prescribe.

Everything in this module is data, not logic.  The spellings have to stay as they are,
because files in the field carry exactly these headers, names and words.
"""

from __future__ import annotations

# --- fixed values: areas -----------------------------------------------------------
CANONICAL_AREAS = (
    "Ústřední knihovna",
    "Jih",
    "Sklad",
    "Jihozápad",
    "Jihovýchod",
    "Středozápad",
    "Severovýchod",
)
STORAGE_AREA = "Sklad"
UNASSIGNED_AREA = "Neurčeno"

# --- fixed values: branch override (name to look for, number, name, area) ------------
BRANCH_OVERRIDES = (("jenštejn", 92, "Jeneč", "Sklad"),)

# --- fixed values: headers of the Parquet inputs -------------------------------------
BRANCH_HEADERS = {
    "branch_id": ("Pobočka č.",),
    "branch_name": ("Pobočka",),
}
CAPACITY_HEADERS = {
    "branch_id": ("Pobočka č.",),
    "branch_name": ("Pobočka",),
    "area": ("Oblast",),
    "code": ("Lokace - systémové označení (Koniáš)",),
    "category": ("Typ",),
    "marking": ("Označení", "Oznaceni"),
    "capacity_physical": ("Kapacita svazky",),
    "stock_on_shelf": ("Kapacita - současný stav",),
}
STOCK_HEADERS = {
    "location_id": ("LOKACE_KEY",),
    "branch_id": ("KNODDEL_cisloknih",),
    "branch_name": ("KNODDEL_nazev",),
    "code": ("LOKACE_SHORT",),
    "stock_total": ("POČET (kj)",),
    "as_of": ("Datum",),
}

# --- fixed values: header aliases of hand-made capacity tables, in priority order -----
# First pass, applied to every capacity table and part.
PART_ALIASES = {
    "branch_id": (
        "pobocka_cislo",
        "kapacita_cisloknih",
        "číslo_knihovny",
        "cislo_knihovny",
        "knoddel_cisloknih",
    ),
    "code": ("lokace_short", "kapacita_lokace_short"),
    "category": ("och", "kapacita_och"),
    "capacity_physical": ("kapacita_fyzicka", "kapacita_plan"),
    "stock_on_shelf": ("stav_na_regalu", "kapacita_stav"),
    "area": ("oblast", "kapacita_oblast"),
    "marking": ("oznaceni", "označení"),
}
# Second pass, for whatever the first one has not found.
CAPACITY_ALIASES = {
    "branch_id": (
        "pobocka_cislo",
        "knoddel_cisloknih",
        "kapacita_cisloknih",
        "cislo_knihovny",
        "číslo_knihovny",
        "cisloknih",
        "cislo_knih",
        "cislo_pobocky",
        "c_knihovny",
        "cisloknihovny",
    ),
    "code": (
        "lokace_short",
        "kapacita_lokace_short",
        "lokace",
        "kod_lokace",
        "lokace_kod",
        "short",
    ),
    "capacity_physical": (
        "kapacita_fyzicka",
        "kapacita_plan",
        "plan",
        "planovana_kapacita",
        "kapacita",
        "mist",
        "mista",
    ),
    "stock_on_shelf": (
        "stav_na_regalu",
        "kapacita_stav",
        "stav",
        "obsazeno",
        "pocet_svazku",
        "pocet",
        "svazky",
    ),
    "category": ("och", "kapacita_och", "typ_fondu", "typ_och"),
    "area": ("oblast", "kapacita_oblast", "region", "kraj"),
    "type": ("typ",),
    "descriptor": ("kapacita_deskriptor",),
}
# The reallocation CSV.
REALLOC_CSV_ALIASES = {
    "branch_id": ("pobocka_cislo",),
    "branch_name": ("pobocka_nazev",),
    "code": ("lokace_short", "lokace"),
    "category": ("och",),
    "capacity_realloc": ("kapacita_realokace",),
}
# The area map and the code map.
AREA_MAP_ALIASES = {
    "branch_id": ("pobocka_cislo",),
    "branch_name": ("pobocka_nazev",),
    "area": ("oblast",),
}
CODE_MAP_ALIASES = {
    "branch_id": ("pobocka_cislo",),
    "source_code": ("lokace_short_zdroj",),
    "target_code": ("lokace_short_cil",),
}

# --- fixed values: file names ---------------------------------------------------------
STOCK_EXPORT_FILE = "lokace-vsechny-nazev.csv"
STOCK_FALLBACK_FILES = ("lokace-vsechny.csv", "lokace-neprazdne.csv")
REALLOC_FILE = "realokace.csv"
CAPACITY_FILE = "kapacita.csv"
AREA_MAP_FILE = "oblast_map.csv"
CODE_MAP_FILE = "lokace_map_prepocet.csv"

# --- fixed values: words in Parquet file names ----------------------------------------
REALLOC_WORD = "realok"
BRANCHES_PREFIX = "pobo"
BRANCH_STOCK_WORD = "stavy"
STOCK_WORDS = ("skuteč", "skutec")
WAREHOUSE_WORD = "sklady"

# --- fixed values: stock export of the SQL client --------------------------------------
EXPORT_BANNERS = ("Records", "Affected", "eSQL")
EXPORT_NULL_WORDS = ("<null>", "null")

# --- fixed values: words that stand for a missing value in CSV files ---------------------
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: words and labels shown to readers -----------------------------------
BLANK_OPTION = "(prázdné)"
YES, NO, UNKNOWN = "Ano", "Ne", "—"
LOCATION_LABELS = {
    "code": "LOKACE_SHORT",
    "branch_name": "Pobočka",
    "area": "Oblast",
    "capacity_total": "Přepočítaný kapacitní plán",
    "stock_total": "Skutečný stav (počet svazků)",
    "fill_pct": "Naplněná kapacita (%)",
    "free": "Zbývající kapacita (počet svazků)",
    "diff": "Rozdíl (stav − kapacita)",
    "overloaded": "Přetížená",
    "at_risk": "Riziková",
    "is_realloc": "Realokační lokace",
}
AREA_LABELS = {
    "area": "Oblast",
    "locations": "Počet lokací",
    "covered_locations": "Počet lokací s kapacitou",
    "stock_total": "Skutečný stav (počet svazků)",
    "capacity_total": "Přepočítaný kapacitní plán",
    "covered_stock": "Skutečný stav (pokryté lokace)",
    "fill_pct": "Naplněná kapacita (%)",
}
CATEGORY_LABELS = {
    "code": "LOKACE_SHORT",
    "branch_name": "Pobočka",
    "area": "Oblast",
    "category": "OCH (oborový charakter)",
    "capacity_physical": "Přepočítaný kapacitní plán (fyzický)",
    "capacity_realloc": "Aktuální kapacitní plán",
    "capacity_effective": "Kapacita efektivní",
    "stock_category": "Skutečný stav (počet svazků)",
    "is_realloc": "Realokační lokace",
}
