"""What is known of countries besides a reference list: other names of them, formal words, words written short."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Everyday names that no locale table has.
EVERYDAY = {
    "GB": "uk, u k, gb, britain, great britain, england, scotland, wales, gran bretana, grossbritannien, groot brittannie, verenigd koninkrijk, inglaterra, reino unido",
    "US": "usa, us, america, states, united states of america, ee uu, eeuu, eua, etats unis, vereinigte staaten, verenigde staten, estados unidos",
    "DE": "brd, ger, bundesrepublik deutschland, allemagne, duitsland, alemania",
    "NL": "holland, ned, hol, neth, pays bas, paises bajos, niederlande, nederland",
    "ES": "spa, reino de espana, espagne, spanje, spanien", "ZA": "rsa, s africa, south africa", "NZ": "aotearoa, new zealand, n z", "AU": "aussie, oz",
    "IE": "eire, ireland republic", "FR": "republique francaise", "GR": "hellas, gre", "IN": "bharat", "EG": "misr", "NG": "naija", "JP": "nippon, nihon",
    "CH": "sui, schweiz, suisse", "PT": "por, port", "DK": "den", "HR": "cro", "BG": "bul", "LV": "lat", "CL": "chi", "PH": "phi, pilipinas", "CN": "prc, pr china", "CZ": "czech republic, czech rep",
    "TR": "turkiye", "VN": "viet nam", "KE": "kenia", "MA": "maroc", "MX": "mejico", "ID": "ri",
}
#: Adjectives of official names.
ADJECTIVES = {
    "FR": "french", "DE": "german", "BE": "belgian", "CH": "swiss, helvetic", "AT": "austrian", "IT": "italian", "PT": "portuguese", "DK": "danish", "SE": "swedish", "NO": "norwegian",
    "FI": "finnish", "IS": "icelandic", "PL": "polish", "CZ": "czech", "SK": "slovak", "SI": "slovene, slovenian", "HU": "hungarian", "GR": "hellenic, greek", "HR": "croatian",
    "RO": "romanian", "BG": "bulgarian", "EE": "estonian", "LV": "latvian", "LT": "lithuanian", "MX": "mexican, united mexican, united mexican states", "BR": "brazilian", "AR": "argentine, argentinian", "CL": "chilean",
    "CO": "colombian", "PE": "peruvian", "JP": "japanese", "CN": "chinese", "IN": "indian", "TH": "thai", "VN": "vietnamese", "PH": "philippine, phillipines", "NG": "nigerian", "KE": "kenyan",
    "EG": "egyptian", "MA": "moroccan", "TR": "turkish", "MT": "maltese", "ES": "spanish", "NL": "dutch", "IE": "irish", "AU": "australian", "CA": "canadian", "ZA": "south african", "ID": "indonesian",
}
#: Words of official names that do not tell countries apart, and words written short.
FORMAL = frozenset("the dominion union confederation confederacion democratic socialist arab ta tal van von der den dem y und en and country nation land repubblika republique republikken republiken rzeczpospolita cooperative plurinational grand duchy principality island islands islamic sultanate oriental bolivarian republic rep republica republik republiek repubblica of de da do la le el kingdom reino federal fed federation peoples people s commonwealth state".split())
SHORT = {"utd": "united", "unit": "united", "gr": "great", "gt": "great", "n": "new", "nw": "new", "s": "south", "sth": "south", "kgdm": "kingdom", "sts": "states"}


def locale_names(spark: SparkSession, codes: list[str], languages: tuple[str, ...]) -> dict[str, set[str]]:
    """Names of countries by rule: in the given languages, in each country's own languages, and the three-letter code."""
    locale = spark.sparkContext._jvm.java.util.Locale
    own: dict[str, set[str]] = {c: set() for c in codes}
    for tag in [str(x.toLanguageTag()) for x in locale.getAvailableLocales()]:
        if (m := re.fullmatch(r"([a-z]{2,3})(?:-[A-Z][a-z]{3})?-([A-Z]{2})", tag)) and m[2] in own:
            own[m[2]].add(tag)
    out: dict[str, set[str]] = {}
    for code in codes:
        place = locale("", code)
        names = {place.getDisplayCountry(locale.forLanguageTag(tag)) for tag in [*languages, *own[code]]}
        out[code] = {x for x in names if x and x != code} | {place.getISO3Country()}
    return out


def country_names(spark: SparkSession, codes: list[str]) -> dict[str, set[str]]:
    """Further names of the countries among two-letter codes; codes of anything else have none."""
    known = set(spark.sparkContext._jvm.java.util.Locale.getISOCountries())
    codes = [c for c in codes if c in known]
    out = locale_names(spark, codes, ("en", "de", "es", "nl", "fr", "it", "pt"))
    for c, words in [*EVERYDAY.items(), *ADJECTIVES.items()]:
        if c in out:
            out[c] |= set(words.split(", "))
    return out
