"""Reference data: identities, word lists and patterns, and the packaged lookup tables.

Everything here is data that fixes results. Other tables of the same shape can be given to the
operators that use them.
"""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from supplymesh.functions.names import canonical_variants

# Canonical names with the aliases that stand for them, in the order of lookups.
IDENTITIES = """
Taiwan Semiconductor Manufacturing Company = TSMC | Taiwan Semiconductor | Taiwan Semiconductor Manufacturing Co | Taiwan Semiconductor Manufacturing Co. | TSMC Semiconductor Manufacturing Company Limited | Taiwan Semiconductor Manufacturing Company | Taiwan Semiconductor Manufacturing Company Limited
Hon Hai Precision Industry Co., Ltd. = Foxconn | Foxconn Technology Group | Hon Hai | Hon Hai Precision | Hon Hai Precision Industry | Hon Hai Precision Industry Co | Hon Hai Precision Industry Co Ltd | Hon Hai Precision Industry Co., Ltd. | Hon Hai Technology Group
Alphabet Inc. = Google | Alphabet
Meta Platforms Inc. = Facebook | Meta
Apple Inc. = Apple | Apple Inc
Tesla = Tesla | Tesla Inc
NVIDIA = Nvidia | NVIDIA Corporation
Intel = Intel | Intel Corporation
Samsung Electronics = Samsung | Samsung Electronics | Samsung Electronics Co | Samsung Electronics Co. | Samsung Electronics Co Ltd | Samsung Electronics Co., Ltd.
Contemporary Amperex Technology Co. Limited = CATL | Contemporary Amperex Technology | Contemporary Amperex Technology Co
LG Energy Solution = LG Energy | LGES
Samsung SDI = Samsung SDI Co
SK hynix = SK Hynix | SK hynix | Hynix
Micron Technology = Micron | Micron Technology Inc
Pegatron Corporation = Pegatron | Pegatron Corporation
Murata Manufacturing = Murata | Murata Manufacturing Co | Murata Manufacturing Co.
Corning Inc. = Corning | Corning Inc | Corning Inc.
Broadcom Inc. = Broadcom | Broadcom Inc | Broadcom Inc.
Panasonic = Panasonic Holdings | Panasonic Energy
ASML = ASML Holding | ASML Holding NV
Applied Materials = Applied Materials Inc
Lam Research = Lam Research Corporation
Tokyo Electron = Tokyo Electron Limited
KLA = KLA Corporation | KLA Corp
Carl Zeiss SMT = Carl Zeiss SMT | Zeiss
Qualcomm = Qualcomm Inc | Qualcomm Incorporated
AMD = Advanced Micro Devices | Advanced Micro Devices Inc | AMD
GlobalFoundries = GlobalFoundries Inc | GlobalFoundries
ASE Technology = ASE Technology | ASE | ASE Technology Holding | ASE Technology Holding Co
Amkor Technology = Amkor | Amkor Technology
Compal Electronics = Compal | Compal Electronics | Compal Electronics Inc
Quanta Computer = Quanta | Quanta Computer | Quanta Computer Inc
Wistron = Wistron | Wistron Corporation
Inventec = Inventec | Inventec Corporation
Marvell Technology, Inc. = Marvell | Marvell Technology | Marvell Technology Group | Marvell Technology Inc | Marvell Technology, Inc.
Sony Semiconductor Solutions = Sony Semiconductor | Sony Semiconductor Solutions | Sony Semiconductor Solutions Corporation
Dell Technologies = Dell | Dell Inc | Dell Technologies
"""
# Short names shown for canonical ones.
DISPLAY = """
Taiwan Semiconductor Manufacturing Company = TSMC
Hon Hai Precision Industry Co., Ltd. = Hon Hai Precision Industry
Pegatron Corporation = Pegatron
Samsung Electronics = Samsung Electronics
SK hynix = SK hynix
Broadcom Inc. = Broadcom
Compal Electronics = Compal Electronics
Marvell Technology, Inc. = Marvell Technology
Corning Inc. = Corning
Murata Manufacturing = Murata Manufacturing
Sony Semiconductor Solutions = Sony Semiconductor Solutions
"""
# Companies that compete with a target.
COMPETITORS = """
AMD = Intel | NVIDIA | Qualcomm
Intel = AMD | NVIDIA | Qualcomm
NVIDIA = AMD | Intel | Qualcomm
Qualcomm = AMD | Intel | NVIDIA
"""
# Words that name no organisation, by kind.
GENERIC = "advanced business company component components contract contracts consumer customer customers electronics fabless group international manufacturing partner partners supplier suppliers technology vendor vendors".split()
INVALID = [x.strip() for x in "annette clayton, board, booting, contract, five other, byron, cristiano amon, fair trade commission, foundry, graphics, integrated, international rights advocates, jerry sanders, mac, oem, original, ati, athlon, tech corporation, chinese company that, taiwanese company that, hdds, usb flash drives, nand flash, integrated circuit, semiconductor manufacturing corporation, manufacturing international corporation, world is flat".split(",")]
PERSONS = [x.strip() for x in "jack elam, byron, cristiano amon, jerry sanders, annette clayton, mac".split(",")]
PRODUCTS = [x.strip() for x in "hdd, hdds, usb flash drive, usb flash drives, nand flash, nand, dram, memory, google nexus, integrated circuit, lfp batteries, graphics card, graphics cards, laptop, laptops, smartphone, smartphones, display, displays, psu, power supply, power supplies, battery, batteries, dell inspiron, dell xps, thinkpad, thinkpads, macbook, iphone, ipad".split(",")]
LOCATIONS = [x.strip() for x in "asia, american, australian, california, china, chinese, cluster, cupertino, east asia, economic zone, europe, industrial park, innovation district, israel, japanese, korean, middle east, north america, region, south korea, southeast asia, taiwan, taiwanese, technology hub, united states".split(",")]
PLACEHOLDERS = "this it they the company group supplier partner contract contracts customer customers suppliers partners".split()
CUSTOMER_BRANDS = ["apple inc", "apple"]
FRAGMENTS = ["became a supplier to", "became a major supplier to", "including", "is a business unit of", "supplier to", "manufacturing including"]
CORPORATE = r"Inc\.?|Ltd\.?|Corp\.?|Group|Co\.?|PLC|Corporation|Limited|LLC|Holdings|Technologies|Semiconductor|Electronics|Industries|S\.A\.?|A\.G\.?|N\.V\.?|B\.V\.?"
# Patterns of generic phrases and of places, on lower-cased names.
GENERIC_PATTERNS = (
    r"^(?:tech|technology|industrial|manufacturing|semiconductor|electronics)\s+(?:corporation|corp|company|co|limited|ltd)$",
    r"^company\s+(?:limited|ltd|inc|corp|corporation)$", r"^(?:company|corporation|inc|ltd|limited|group)$",
    r"\bcompany\s+that\b", r"\bnotable\s+for\s+using\b", r"\bcurrently\b", r"\bwhile\b", r"\bfive\s+other\b",
)
PLACE_PATTERNS = (
    r"\bsilicon\s+(?:valley|wadi)\b", r"\btechnology\s+hub\b", r"\bindustrial\s+park\b", r"\beconomic\s+zone\b", r"\bspecial\s+economic\s+zone\b", r"\bscience\s+park\b",
    r"\binnovation\s+(?:hub|district|cluster|corridor)\b", r"\b(?:manufacturing|semiconductor|technology)\s+ecosystem\b", r"\b(?:industrial|technology|semiconductor)\s+cluster\b",
    r"\b(?:business|technology|industrial)\s+district\b", r"\b(?:supply\s+chain|manufacturing)\s+region\b", r"\b(?:valley|wadi|park|zone|corridor|region|hub|ecosystem)\b$",
    r"^(?:region|cluster|technology\s+hub|industrial\s+park|economic\s+zone|innovation\s+district)$",
)
# Signals of supply in a snippet, by weight, and signals against it.
STRONG = (
    r"\bsupplier\b", r"\bsupplies\b", r"\bsupplied\s+by\b", r"\bvendor\b", r"\boem\b", r"\bcontract\s+manufacturer\b", r"\bmanufacturing\s+partner\b", r"\bcomponent\s+supplier\b",
    r"\bassembly\s+partner\b", r"\bpackaging\s+partner\b", r"\bfabrication\s+partner\b", r"\bfoundry\s+partner\b", r"\bsemiconductor\s+manufacturing\s+partner\b",
    r"\boutsourced\s+(?:its\s+)?manufacturing\b", r"\boutsourced\s+semiconductor\s+assembly\s+and\s+test\b", r"\bosat\b", r"\bchip\s+packaging\b", r"\bwafer\s+fabrication\b",
    r"\bcontract\s+chipmaker\b", r"\bfoundries\s+including\b", r"\bproduction\s+with\s+(?:other\s+)?foundries\b", r"\boriginal\s+design\s+manufacturer\b",
    r"\bmanufactures?(?:\s+\w+){0,8}\s+for\b", r"\bfabricat(?:es|ed|ing)(?:\s+\w+){0,8}\s+for\b",
    r"\b(?:manufactured|assembled|fabricated|built|produced|packaged)\s+(?:[^.;]{0,80}\s+)?by\b", r"\bfoundry\s+for\b", r"\bserves?\s+as\s+(?:the\s+)?main\s+supplier\s+for\b",
    r"\bprovides?\s+(?:components?|parts?|chips?|displays?|memory|services?|materials?|equipment|systems?)\s+to\b",
    r"\bprovides?\b.{0,80}\b(?:components?|parts?|chips?|displays?|memory|services?|materials?|equipment|systems?)\b.{0,40}\b(?:to|for)\b",
    r"\bsupplies\s+(?:components?|parts?|chips?|displays?|memory|materials?|equipment|systems?)\b",
    r"\bsupplies\b.{0,80}\b(?:components?|parts?|chips?|displays?|memory|materials?|equipment|systems?)\b",
)
MEDIUM = (
    r"\bstrategic\s+partner\b", r"\bprocurement\s+partner\b", r"\bsupply\s+agreement\b", r"\bsourcing\s+agreement\b", r"\bsources?(?:\s+\w+){0,8}\s+from\b", r"\bsourced\s+from\b",
    r"\becosystem\s+partner\b", r"\bmanufacturing\s+ecosystem\b", r"\bsemiconductor\s+ecosystem\b", r"\bcontract\s+manufacturing\b", r"\boutsourced\s+manufacturing\b",
    r"\bwafer\s+(?:production|manufacturing)\b", r"\bsemiconductor\s+assembly\s+and\s+test\b", r"\bsemiconductor\s+partner\b",
)
WEAK = (
    r"\bsupplier\s+list\b", r"\bsupply[-\s]+chain\s+report\b", r"\bmanufacturing\s+context\b", r"\bsemiconductor\s+(?:manufacturing|foundry|fabrication|supply\s+chain|industry)\b",
    r"\bfoundry\s+(?:business|industry|ecosystem|manufacturing)\b", r"\bfoundries\b", r"\bfab(?:rication)?\s+(?:partner|plant|facility|ecosystem|manufacturing)\b",
)
AGAINST = (
    r"\bshareholder\b", r"\binvestor\b", r"\bacquired\b", r"\bsubsidiary\b", r"\bowned\s+by\b", r"\bbusiness\s+unit\b", r"\bchairman\b", r"\bceo\b", r"\bfounder\b", r"\bpartnered\s+with\b", r"\bjoint\s+venture\b",
    r"\bcustomer\b", r"\bcustomers\b", r"\bclient\b", r"\bclients\b", r"\bbuyer\b", r"\bbuyers\b", r"\bbrand\b", r"\bbrands\b", r"\bproduct\s+line\b", r"\bdevice\s+model\b", r"\bcompetitor\b", r"\bagainst\b",
    r"\banti-competitive\b", r"\bdefendants?\b", r"\blawsuit\b", r"\bnot\s+using\b", r"\bovertook\b", r"\btechnology-sharing\b", r"\bindustry\s+peer\b", r"\brival\b",
)
# What tells that a text is about making things; search queries for a company.
MANUFACTURING = "supplier, suppliers, foundry, foundries, wafer fabrication, fabrication, chip packaging, osat, outsourced manufacturing, outsourced semiconductor assembly, semiconductor manufacturing partner, manufacturing partner, contract manufacturer, contract manufacturers, original design manufacturer, odm".split(", ")
QUERIES = ["suppliers", "supply chain", "foundry suppliers", "manufacturing partners", "chip packaging suppliers", "contract manufacturers", "ODM suppliers", "original design manufacturers", "outsourced manufacturing", "wafer fabrication suppliers", "OSAT suppliers"]
OWN_QUERIES = {
    "qualcomm": ["foundry supplier", "chip manufacturing partner", "semiconductor supply chain", "TSMC Samsung foundry", "ASE Amkor packaging supplier", "outsourced semiconductor assembly and test"],
    "dell technologies": ["ODM suppliers", "contract manufacturers", "laptop manufacturing Compal Quanta Wistron", "supply chain suppliers", "component suppliers Broadcom Marvell"],
}
SEARCH_KEYWORDS = "supplies supplier provides manufactures vendor contractor component parts partnership subsidiary client customer foundry foundries wafer fabrication packaging osat outsourced odm".split()
UNKNOWN_LOCATION = "Unknown (Verified by Research)"


def _pairs(text: str) -> list[tuple[str, list[str]]]:
    return [(k.strip(), [x.strip() for x in v.split("|")]) for k, v in (line.split(" = ", 1) for line in text.strip().splitlines())]


def identities() -> list[tuple[str, str]]:
    """(alias, canonical) in order."""
    return [(alias, canonical) for canonical, aliases in _pairs(IDENTITIES) for alias in aliases]


def display_names() -> dict[str, str]:
    return {k: v[0] for k, v in _pairs(DISPLAY)}


def competitors() -> list[tuple[str, str]]:
    return [(target, other) for target, others in _pairs(COMPETITORS) for other in others]


@lru_cache(maxsize=None)
def packaged(name: str) -> tuple[tuple[str, ...], ...]:
    """Rows of a packaged lookup table, the header first."""
    with (Path(__file__).parent / f"{name}.tsv").open(encoding="utf-8", newline="") as f:
        return tuple(tuple(r) for r in csv.reader(f, delimiter="\t", quoting=csv.QUOTE_NONE))


def curated_edges(spark: SparkSession) -> DataFrame:
    """Seeded relationships: source, seq, name, location, products, confidence, criticality, evidence."""
    rows = []
    for i, (source, name, location, products, confidence, criticality, snippet) in enumerate(packaged("curated_edges")[1:]):
        slug = lambda x: "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split())
        evidence = [(f"{source} supplier benchmark evidence", f"curated://supplier-benchmark/{slug(source)}/{slug(name)}", snippet)]
        rows.append((source, i, name, location, products.split("; "), float(confidence), criticality, evidence))
    return spark.createDataFrame(rows, "source string, seq long, name string, location string, products array<string>, confidence double, criticality string, evidence array<struct<title:string,link:string,snippet:string>>")


def expected_tier1(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in packaged("expected_tier1")[1:]], "company string, supplier string")


def company_aliases() -> dict[str, str]:
    return dict(packaged("company_aliases")[1:])


def variants(canonical: str) -> list[str]:
    """Other names of a canonical one: aliases, its short name, other spellings."""
    out = [canonical, display_names().get(canonical, ""), *(a for a, c in identities() if c == canonical), *canonical_variants(canonical)]
    return list(dict.fromkeys(x for x in out if x))
