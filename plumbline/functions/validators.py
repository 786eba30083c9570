"""Format validators as column expressions: null for null, false for what is invalid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Validator = Callable[[Column], Column]


def _weighted(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + F.substring(digits, i, 1).try_cast("int") * w
    return total


def is_luhn(column: Column) -> Column:
    """Digits only, with a valid Luhn check digit."""
    return F.when(column.isNotNull(), column.rlike(r"^[0-9]+$") & F.coalesce(F.call_function("luhn_check", column), F.lit(False)))


def is_mod97(column: Column) -> Column:
    """Letters as 10 to 35, the whole leaves 1 modulo 97 (the text is taken as it is, check digits last)."""
    text = F.upper(column)
    step = lambda acc, c: F.when(
        c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97
    ).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(text, ""), F.lit(0), step)
    return F.when(column.isNotNull(), F.when(text.rlike(r"^[0-9A-Z]+$"), rest == 1).otherwise(False))


def is_iban(column: Column) -> Column:
    """An IBAN: the first four characters go last, then modulo 97."""
    plain = F.upper(F.regexp_replace(column, " ", ""))
    return F.when(column.isNotNull(), plain.rlike(r"^[A-Z]{2}[0-9]{2}[0-9A-Z]{8,30}$") & F.coalesce(is_mod97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))), F.lit(False)))


def is_email(column: Column) -> Column:
    """A plausible address: at most 254 bytes, at most 64 before the at sign."""
    atom = r"[\w!#$%&'*+/=?^`{|}~-]+"
    label = r"(?:[^\W_](?:[^\W_]|-){0,61})"
    shape = rf"^{atom}(?:\.{atom})*@(?:{label}(?<!-)\.)+[A-Za-z]{{2,63}}$"
    local = F.substring_index(column, "@", 1)
    return F.when(column.isNotNull(), column.rlike(shape) & (F.octet_length(column) <= 254) & (F.octet_length(local) <= 64))


def is_url(column: Column, require_scheme: bool = True) -> Column:
    """An http or https URL: host name, IPv4 or bracketed IPv6, optional port, valid percent-encoding, no spaces."""
    scheme = r"(?i:https?)://" if require_scheme else r"(?:(?i:https?)://)?"
    label = r"[A-Za-z0-9\x{A1}-\x{10FFFF}](?:[A-Za-z0-9\x{A1}-\x{10FFFF}-]{0,61}[A-Za-z0-9\x{A1}-\x{10FFFF}])?"
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    host = rf"(?:\[[0-9A-Fa-f:.]{{2,45}}\]|(?:{octet}\.){{3}}{octet}|(?!(?:[0-9]+\.)*[0-9]+(?:[:/?#]|$))(?:{label}\.)*{label})"
    port = r"(?::(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[1-9][0-9]{0,3}|0))?"
    rest = r"(?:[/?#](?:[^\s%<>\"{}|\\^`]|%[0-9A-Fa-f]{2})*)?"
    return F.when(column.isNotNull(), column.rlike(rf"^{scheme}{host}{port}{rest}$"))


def is_ci_uy(column: Column) -> Column:
    """A Uruguayan identity number: 7 or 8 digits besides dots, hyphens and spaces, weighted check digit."""
    digits = F.lpad(F.regexp_replace(column, r"[.\- ]", ""), 8, "0")
    check = (10 - _weighted(digits, [2, 9, 8, 7, 6, 3, 4]) % 10) % 10
    shape = F.regexp_replace(column, r"[.\- ]", "").rlike(r"^[0-9]{7,8}$")
    return F.when(column.isNotNull(), F.when(shape, check == F.substring(digits, 8, 1).try_cast("int")).otherwise(False))


def is_rut_uy(column: Column) -> Column:
    """A Uruguayan tax number: 12 digits, prefix 01 to 22, 001 before the check digit, modulo 11."""
    digits = F.regexp_replace(column, r"[.\- ]", "")
    rest = 11 - _weighted(digits, [4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    check = F.when(rest == 11, 0).otherwise(rest)
    shape = digits.rlike(r"^(?:0[1-9]|1[0-9]|2[0-2])[0-9]{6}001[0-9]$")
    return F.when(column.isNotNull(), F.when(shape, check == F.substring(digits, 12, 1).try_cast("int")).otherwise(False))


# ISO 3166-1: alpha-2, alpha-3 and number of each country
_COUNTRIES = """AF AFG 004,AX ALA 248,AL ALB 008,DZ DZA 012,AS ASM 016,AD AND 020,AO AGO 024,AI AIA 660,AQ ATA 010,AG ATG 028,AR ARG 032,AM ARM 051,AW ABW 533,AU AUS 036,AT AUT 040,AZ AZE 031,BS BHS 044,BH BHR 048,BD BGD 050,BB BRB 052,BY BLR 112,BE BEL 056,BZ BLZ 084,BJ BEN 204,BM BMU 060,BT BTN 064,BO BOL 068,BQ BES 535,BA BIH 070,BW BWA 072,BV BVT 074,BR BRA 076,IO IOT 086,BN BRN 096,BG BGR 100,BF BFA 854,BI BDI 108,CV CPV 132,KH KHM 116,CM CMR 120,CA CAN 124,KY CYM 136,CF CAF 140,TD TCD 148,CL CHL 152,CN CHN 156,CX CXR 162,CC CCK 166,CO COL 170,KM COM 174,CG COG 178,CD COD 180,CK COK 184,CR CRI 188,CI CIV 384,HR HRV 191,CU CUB 192,CW CUW 531,CY CYP 196,CZ CZE 203,DK DNK 208,DJ DJI 262,DM DMA 212,DO DOM 214,EC ECU 218,EG EGY 818,SV SLV 222,GQ GNQ 226,ER ERI 232,EE EST 233,SZ SWZ 748,ET ETH 231,FK FLK 238,FO FRO 234,FJ FJI 242,FI FIN 246,FR FRA 250,GF GUF 254,PF PYF 258,TF ATF 260,GA GAB 266,GM GMB 270,GE GEO 268,DE DEU 276,GH GHA 288,GI GIB 292,GR GRC 300,GL GRL 304,GD GRD 308,GP GLP 312,GU GUM 316,GT GTM 320,GG GGY 831,GN GIN 324,GW GNB 624,GY GUY 328,HT HTI 332,HM HMD 334,VA VAT 336,HN HND 340,HK HKG 344,HU HUN 348,IS ISL 352,IN IND 356,ID IDN 360,IR IRN 364,IQ IRQ 368,IE IRL 372,IM IMN 833,IL ISR 376,IT ITA 380,JM JAM 388,JP JPN 392,JE JEY 832,JO JOR 400,KZ KAZ 398,KE KEN 404,KI KIR 296,KP PRK 408,KR KOR 410,KW KWT 414,KG KGZ 417,LA LAO 418,LV LVA 428,LB LBN 422,LS LSO 426,LR LBR 430,LY LBY 434,LI LIE 438,LT LTU 440,LU LUX 442,MO MAC 446,MG MDG 450,MW MWI 454,MY MYS 458,MV MDV 462,ML MLI 466,MT MLT 470,MH MHL 584,MQ MTQ 474,MR MRT 478,MU MUS 480,YT MYT 175,MX MEX 484,FM FSM 583,MD MDA 498,MC MCO 492,MN MNG 496,ME MNE 499,MS MSR 500,MA MAR 504,MZ MOZ 508,MM MMR 104,NA NAM 516,NR NRU 520,NP NPL 524,NL NLD 528,NC NCL 540,NZ NZL 554,NI NIC 558,NE NER 562,NG NGA 566,NU NIU 570,NF NFK 574,MK MKD 807,MP MNP 580,NO NOR 578,OM OMN 512,PK PAK 586,PW PLW 585,PS PSE 275,PA PAN 591,PG PNG 598,PY PRY 600,PE PER 604,PH PHL 608,PN PCN 612,PL POL 616,PT PRT 620,PR PRI 630,QA QAT 634,RE REU 638,RO ROU 642,RU RUS 643,RW RWA 646,BL BLM 652,SH SHN 654,KN KNA 659,LC LCA 662,MF MAF 663,PM SPM 666,VC VCT 670,WS WSM 882,SM SMR 674,ST STP 678,SA SAU 682,SN SEN 686,RS SRB 688,SC SYC 690,SL SLE 694,SG SGP 702,SX SXM 534,SK SVK 703,SI SVN 705,SB SLB 090,SO SOM 706,ZA ZAF 710,GS SGS 239,SS SSD 728,ES ESP 724,LK LKA 144,SD SDN 729,SR SUR 740,SJ SJM 744,SE SWE 752,CH CHE 756,SY SYR 760,TW TWN 158,TJ TJK 762,TZ TZA 834,TH THA 764,TL TLS 626,TG TGO 768,TK TKL 772,TO TON 776,TT TTO 780,TN TUN 788,TR TUR 792,TM TKM 795,TC TCA 796,TV TUV 798,UG UGA 800,UA UKR 804,AE ARE 784,GB GBR 826,US USA 840,UM UMI 581,UY URY 858,UZ UZB 860,VU VUT 548,VE VEN 862,VN VNM 704,VG VGB 092,VI VIR 850,WF WLF 876,EH ESH 732,YE YEM 887,ZM ZMB 894,ZW ZWE 716"""
COUNTRIES = {kind: tuple(c.split()[k] for c in _COUNTRIES.split(",")) for k, kind in enumerate(("alpha2", "alpha3", "numeric"))}
#: ISO 4217, by last letter.
CURRENCIES = tuple(
    start + last
    for last, starts in {
        "A": "AO MG XB XU",
        "B": "BO ET PA RU TH XB",
        "C": "CR SV XB",
        "D": "AE AM AU BB BH BM BN BS BZ CA DZ FJ GM GY HK IQ JM JO KW KY LR LY MA MK NA NZ RS SB SG SR TN TT TW US VE VN XB XC XP",
        "E": "CH CV SL",
        "F": "BI CD CH CL DJ GN HU KM RW XA XO XP",
        "G": "AN AW HT PY SD XA",
        "H": "UA",
        "I": "UY",
        "K": "CZ DK IS LA MM MW NO PG SE",
        "L": "AL BR GE HN LS MD SZ ZW",
        "M": "BA",
        "N": "AF AZ BG BT BY ER MX MZ NG PE PL RO ST US",
        "O": "NI",
        "P": "BW CL CO CU DO EG FK GB GI LB MO PH SH SS SY TO",
        "Q": "GT",
        "R": "EU ID IN IR KH LK MU MV MY NP OM PK QA SA SC XD YE ZA",
        "S": "AR GH IL KE KG SO TJ TZ UZ VE XT",
        "T": "BD KZ MN TM WS XP",
        "U": "CO MR UY XA XS",
        "V": "BO MX VU",
        "W": "CH KP KR UY ZM",
        "X": "UG XX",
        "Y": "CN JP TR",
    }.items()
    for start in starts.split()
)


def is_iso3166(column: Column, kind: str = "alpha2") -> Column:
    """A country code; numbers are padded with zeros to three digits."""
    value = F.lpad(column.cast("string"), 3, "0") if kind == "numeric" else F.upper(column)
    return F.when(column.isNotNull(), value.isin(*COUNTRIES[kind]))


def is_iso4217(column: Column) -> Column:
    """A currency code."""
    return F.when(column.isNotNull(), F.upper(column).isin(*CURRENCIES))


@dataclass(frozen=True)
class ValidatorPack:
    """A named set of validators."""

    name: str
    validators: dict[str, Validator] = field(default_factory=dict)
    country: str | None = None
    description: str | None = None


def validator_pack(name: str, validators: dict[str, Validator], country: str | None = None, description: str | None = None) -> ValidatorPack:
    """A checked pack: every validator is callable and named."""
    if not name or not validators or not all(k and callable(v) for k, v in validators.items()):
        raise ValueError("a pack needs a name and named callable validators")
    return ValidatorPack(name, dict(validators), country, description)


def international_validators() -> ValidatorPack:
    """Validators that hold anywhere."""
    return validator_pack("international", {"email": is_email, "url": is_url, "luhn": is_luhn, "mod97": is_mod97, "iban": is_iban, "iso3166": is_iso3166, "iso4217": is_iso4217})


def uruguay_validators() -> ValidatorPack:
    """Uruguayan document numbers."""
    return validator_pack("uruguay", {"ci_uy": is_ci_uy, "rut_uy": is_rut_uy}, country="UY")
