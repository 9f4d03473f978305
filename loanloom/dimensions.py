"""The two lookup tables every portfolio query joins to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Industry sectors by two-digit code (code|sector|subsector).
NAICS_TEXT = """
11|Agriculture, Forestry, Fishing and Hunting|General
21|Mining, Quarrying, and Oil and Gas Extraction|General
22|Utilities|General
23|Construction|General
31|Manufacturing|Food, Beverage, Textile
32|Manufacturing|Wood, Paper, Chemical
33|Manufacturing|Metal, Machinery, Electronics
42|Wholesale Trade|General
44|Retail Trade|Motor Vehicle, Furniture, Electronics
45|Retail Trade|General Merchandise, Miscellaneous
48|Transportation and Warehousing|Transportation
49|Transportation and Warehousing|Warehousing, Postal
51|Information|General
52|Finance and Insurance|General
53|Real Estate and Rental and Leasing|General
54|Professional, Scientific, and Technical Services|General
55|Management of Companies and Enterprises|General
56|Administrative and Support Services|General
61|Educational Services|General
62|Health Care and Social Assistance|General
71|Arts, Entertainment, and Recreation|General
72|Accommodation and Food Services|General
81|Other Services (except Public Administration)|General
92|Public Administration|General
"""

# States with their census region and division.
STATES_TEXT = """
AL|Alabama|South|East South Central
AK|Alaska|West|Pacific
AZ|Arizona|West|Mountain
AR|Arkansas|South|West South Central
CA|California|West|Pacific
CO|Colorado|West|Mountain
CT|Connecticut|Northeast|New England
DE|Delaware|South|South Atlantic
FL|Florida|South|South Atlantic
GA|Georgia|South|South Atlantic
HI|Hawaii|West|Pacific
ID|Idaho|West|Mountain
IL|Illinois|Midwest|East North Central
IN|Indiana|Midwest|East North Central
IA|Iowa|Midwest|West North Central
KS|Kansas|Midwest|West North Central
KY|Kentucky|South|East South Central
LA|Louisiana|South|West South Central
ME|Maine|Northeast|New England
MD|Maryland|South|South Atlantic
MA|Massachusetts|Northeast|New England
MI|Michigan|Midwest|East North Central
MN|Minnesota|Midwest|West North Central
MS|Mississippi|South|East South Central
MO|Missouri|Midwest|West North Central
MT|Montana|West|Mountain
NE|Nebraska|Midwest|West North Central
NV|Nevada|West|Mountain
NH|New Hampshire|Northeast|New England
NJ|New Jersey|Northeast|Middle Atlantic
NM|New Mexico|West|Mountain
NY|New York|Northeast|Middle Atlantic
NC|North Carolina|South|South Atlantic
ND|North Dakota|Midwest|West North Central
OH|Ohio|Midwest|East North Central
OK|Oklahoma|South|West South Central
OR|Oregon|West|Pacific
PA|Pennsylvania|Northeast|Middle Atlantic
RI|Rhode Island|Northeast|New England
SC|South Carolina|South|South Atlantic
SD|South Dakota|Midwest|West North Central
TN|Tennessee|South|East South Central
TX|Texas|South|West South Central
UT|Utah|West|Mountain
VT|Vermont|Northeast|New England
VA|Virginia|South|South Atlantic
WA|Washington|West|Pacific
WV|West Virginia|South|South Atlantic
WI|Wisconsin|Midwest|East North Central
WY|Wyoming|West|Mountain
DC|District of Columbia|South|South Atlantic
PR|Puerto Rico|South|Caribbean
GU|Guam|West|Pacific
VI|Virgin Islands|South|Caribbean
"""

NAICS_ROWS = [tuple(line.split("|")) for line in NAICS_TEXT.strip().splitlines()]
STATE_ROWS = [tuple(line.split("|")) for line in STATES_TEXT.strip().splitlines()]
SECTOR_CODES = [code for code, _, _ in NAICS_ROWS]


def _literal_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Rows as SQL literals: part of the plan, with a known size, and no job to read them."""
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def naics_codes(spark: SparkSession) -> DataFrame:
    """24 sector rows: naics_code, sector_code, sector_name, subsector_name, description."""
    table = _literal_table(spark, NAICS_ROWS, "naics_code, sector_name, subsector_name")
    return table.selectExpr(
        "naics_code", "naics_code AS sector_code", "sector_name", "subsector_name",
        "CAST(NULL AS STRING) AS description",
    )


def state_regions(spark: SparkSession) -> DataFrame:
    """54 state rows: state_code, state_name, region, division."""
    return _literal_table(spark, STATE_ROWS, "state_code, state_name, region, division")
