"""Language, script and region codes for hreflang.

The lists come from the tables of the Java runtime Spark runs on; only what they lack is written here.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

# Script codes in use for written languages, macro regions, and reserved country codes.
SCRIPTS = frozenset(
    "adlm arab armn beng bopo brai cakm cans cher copt cyrl deva ethi geor goth grek gujr guru hang hani hans hant hebr hira "
    "hmng java jpan kana khmr knda kore laoo latn limb lisu mand mlym mong mtei mymr nkoo olck orya osma rohg sinh sund syrc "
    "tale talu taml telu tfng thaa thai tibt vaii yiii".split()
)
MACRO_REGIONS = frozenset("001 002 003 005 009 011 013 014 015 017 018 019 021 029 030 034 035 039 053 054 057 061 142 143 145 150 151 154 155 202 419".split())
MORE_REGIONS = frozenset("ac cp dg ea ic ta xk".split())


@lru_cache(maxsize=4)
def _runtime_codes(spark: SparkSession) -> tuple[frozenset[str], frozenset[str]]:
    locale = spark.sparkContext._jvm.java.util.Locale
    two = {str(c) for c in locale.getISOLanguages()}
    localized = {str(tag.toString()).split("_")[0] for tag in locale.getAvailableLocales()}
    three = {language for language in localized if len(language) == 3}
    return frozenset(two | three), frozenset(str(c).lower() for c in locale.getISOCountries())


def hreflang_codes(spark: SparkSession) -> dict[str, frozenset[str]]:
    languages, countries = _runtime_codes(spark)
    return {"languages": languages, "scripts": SCRIPTS, "regions": countries | MACRO_REGIONS | MORE_REGIONS}
