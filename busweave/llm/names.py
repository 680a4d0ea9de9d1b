"""What is known of countries and fuels besides the canonical list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .canon import Names

# Names of fuels in use that lists tend to leave out.
FUEL_NAMES = {
    "bio": ("biomasse", "bioenergy", "bioenergie", "solid biomass", "wood pellets", "wood chips", "forest residues", "biogas", "holz"),
    "lignite": ("lignite raw", "raw lignite", "soft brown coal", "braunkohle"),
    "hard_coal": ("steinkohle", "anthracite", "steam coal", "bituminous coal", "black coal"),
    "gas": ("erdgas", "fossil gas", "pipeline gas", "gas ccgt", "gas ocgt", "ccgt", "gaz naturel", "methane"),
    "oil": ("heizöl", "heavy fuel oil", "diesel oil", "diesel", "light heating oil", "heavy oil", "light oil", "mazut", "kerosene"),
    "oil_shale": ("ölschiefer", "kukersite", "shale oil"),
    "nuclear": ("kernenergie", "atomic", "nuclear fission", "kernkraft", "atomkraft"),
    "waste": ("siedlungsabfall", "household refuse", "msw incineration", "msw", "refuse", "müll", "abfall"),
    "geothermal": ("erdwärme", "deep geothermal", "geothermie"),
    "hydrogen": ("wasserstoff", "green hydrogen", "hydrogène"),
}
# Energy sources and carriers that are no fuel of the list.
OTHER_SOURCES = (
    "run-of-river", "run of river", "pumped storage", "reservoir", "hydro", "water", "solar PV", "solar", "photovoltaic", "solar thermal", "offshore wind", "onshore wind", "wind", "tidal stream", "tidal", "wave", "marine", "battery", "battery storage", "storage", "demand response", "peat", "heat pump", "ocean thermal",
    "compressed air", "flywheel", "waste heat",
)
# What people type when they have nothing to say.
PLACEHOLDERS = ("n/a", "#N/A", "na", "nan", "none", "null", "nil", "tbc", "tbd", "t.b.d.", "t.b.c.", "unknown", "various", "misc", "other", "others", "mixed", "total", "all", "see sheet 2", "see annex", "see remark", "not specified", "unspecified", "any", "test", "xx", "xxx")
# Codes and parts by which countries are named besides their code and name.
COUNTRY_NAMES = {"United Kingdom": ("uk", "britain", "england", "scotland", "wales"), "Greece": ("el", "ellas"), "North Macedonia": ("macedonia", "fyrom"), "Bosnia and Herzegovina": ("bosnia",)}
# Languages in which countries are named, by their tags.
LANGUAGES = ("bg", "bs", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "ga", "hr", "hu", "it", "lb", "lt", "lv", "mk", "nb", "nl", "nn", "pl", "pt", "rm", "ro", "sk", "sl", "sq", "sr-Latn", "sv", "tr", "uk")
# Regions, past states and groups of countries, some with names near those of countries.
REGIONS = (
    "Austrasia", "Slavonia", "Moravia", "Bohemia", "Galicia", "Iberia", "Silesia", "Pomerania", "Prussia", "Saxony", "Bavaria", "Swabia", "Franconia", "Lorraine", "Burgundy", "Normandy", "Brittany", "Catalonia", "Castile", "Lombardy", "Sardinia", "Sicily", "Transylvania", "Wallachia", "Dalmatia", "Thrace", "Livonia", "Courland", "Lapland", "Lusatia",
    "Nordic countries", "Nordics", "Baltic states", "Baltics", "Balkans", "Benelux", "Scandinavia", "Central Europe", "Eastern Europe", "Western Europe", "rest of Europe", "Europe", "European Union", "EU", "EU27", "EU28", "EU-27", "CORE region", "Visegrad", "Alps", "offshore hub", "North Sea", "Baltic Sea", "Yugoslavia", "Czechoslovakia", "Soviet Union",
)
#: Entries of a canonical list beyond this are refused: their codes are looked up on the driver.
MAX_ENTRIES = 100_000


def country_names(canon: DataFrame, field_name: str = "country", languages: tuple[str, ...] = LANGUAGES) -> tuple[dict[str, tuple[str, ...]], tuple[str, ...]]:
    """(names of each entry, names of all other countries in English, German and French) from the locale data of the Java runtime, by the
    two-letter codes among the entries' other names."""
    locale = canon.sparkSession._jvm.java.util.Locale
    codes = canon.where((F.col("field_name") == field_name) & F.col("canon_value").isNotNull()).select("canon_value", F.explode(F.split("other_names", r"\|")).alias("code"))
    found = codes.where(F.length("code") == 2).distinct().limit(MAX_ENTRIES + 1).collect()
    if len(found) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries of {field_name}")
    known = set(locale.getISOCountries())
    entries = {r["code"].upper(): r["canon_value"] for r in found if r["code"].upper() in known}
    tags = {tag: locale.forLanguageTag(tag) for tag in languages}
    named = lambda code, tag: locale("", code).getDisplayCountry(tags.get(tag) or locale.forLanguageTag(tag))
    return {value: tuple(sorted({named(code, tag) for tag in languages})) for code, value in sorted(entries.items())}, tuple(sorted({named(code, tag) for code in known - set(entries) for tag in ("en", "de", "fr")}))


def known_of(canon: DataFrame) -> dict[str, Names]:
    """What is known of the two fields of the canonical list."""
    own, others = country_names(canon)
    country = Names(
        {value: (*own.get(value, ()), *COUNTRY_NAMES.get(value, ())) for value in {**own, **COUNTRY_NAMES}},
        (*others, *REGIONS, *PLACEHOLDERS),
        ("republic", "kingdom", "state", "rep", "of", "the", "mainland", "zone", "bidding", "national", "total", "sum", "area", "market", "node", "only"),
        r"^([a-z]{2})[_-]?(?:[0-9]{1,2}|[a-z][0-9]|zone|mainland|total|national)$",
    )
    fuel = Names(FUEL_NAMES, (*OTHER_SOURCES, *PLACEHOLDERS), ("total", "sum", "all", "fired", "plant", "plants", "unit", "units"), r"^(b[0-9]{2,3})$")
    return {"country": country, "fuel_group": fuel}
