"""E-mail, URL, phone and Base64 columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

EMAIL = r"^([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+)@([A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)$"
URL = r"^(https?|ftp)://[^\s/?#.]+\.[^\s/?#]+([/?#]\S*)?$"
# Regions by ISO 3166 code, country calling code (ITU-T E.164) and English name. A parameter adds others.
_REGIONS = """
AE 971 United Arab Emirates
AR 54 Argentina
AT 43 Austria
AU 61 Australia
BD 880 Bangladesh
BE 32 Belgium
BG 359 Bulgaria
BO 591 Bolivia
BR 55 Brazil
BY 375 Belarus
CA 1 Canada
CH 41 Switzerland
CL 56 Chile
CN 86 China
CO 57 Colombia
CR 506 Costa Rica
CU 53 Cuba
CY 357 Cyprus
CZ 420 Czech Republic
DE 49 Germany
DK 45 Denmark
DO 1 Dominican Republic
DZ 213 Algeria
EC 593 Ecuador
EE 372 Estonia
EG 20 Egypt
ES 34 Spain
ET 251 Ethiopia
FI 358 Finland
FR 33 France
GB 44 United Kingdom
GE 995 Georgia
GH 233 Ghana
GR 30 Greece
GT 502 Guatemala
HK 852 Hong Kong
HN 504 Honduras
HR 385 Croatia
HU 36 Hungary
ID 62 Indonesia
IE 353 Ireland
IL 972 Israel
IN 91 India
IQ 964 Iraq
IR 98 Iran
IS 354 Iceland
IT 39 Italy
JM 1 Jamaica
JO 962 Jordan
JP 81 Japan
KE 254 Kenya
KR 82 South Korea
KW 965 Kuwait
KZ 7 Kazakhstan
LB 961 Lebanon
LK 94 Sri Lanka
LT 370 Lithuania
LU 352 Luxembourg
LV 371 Latvia
MA 212 Morocco
MT 356 Malta
MX 52 Mexico
MY 60 Malaysia
NG 234 Nigeria
NL 31 Netherlands
NO 47 Norway
NP 977 Nepal
NZ 64 New Zealand
OM 968 Oman
PA 507 Panama
PE 51 Peru
PH 63 Philippines
PK 92 Pakistan
PL 48 Poland
PR 1 Puerto Rico
PT 351 Portugal
PY 595 Paraguay
QA 974 Qatar
RO 40 Romania
RS 381 Serbia
RU 7 Russia
SA 966 Saudi Arabia
SE 46 Sweden
SG 65 Singapore
SI 386 Slovenia
SK 421 Slovakia
SN 221 Senegal
SV 503 El Salvador
TH 66 Thailand
TN 216 Tunisia
TR 90 Turkey
TW 886 Taiwan
TZ 255 Tanzania
UA 380 Ukraine
UG 256 Uganda
US 1 United States
UY 598 Uruguay
VE 58 Venezuela
VN 84 Vietnam
ZA 27 South Africa
"""
REGIONS = {code: (number, name) for code, number, name in (line.split(" ", 2) for line in _REGIONS.strip().splitlines())}
_PAIRS = {k: sorted({n.upper()[i : i + 2] for i in range(len(n) - 1)}) for k, (_, n) in REGIONS.items()}
#: Names of regions that no other has the letter pairs of: a text that is such a name is nearest to it.
_NAMED = {k: n.upper() for k, (_, n) in REGIONS.items() if list(_PAIRS.values()).count(_PAIRS[k]) == 1}
#: Country calling codes; a phone in international form is valid when it starts with one and has a fitting length.
CALLING_CODES = {k: number for k, (number, _) in REGIONS.items()}
# First bytes of file formats.
MAGIC = [
    ("25504446", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383", "image/gif"),
    ("504B0304", "application/zip"),
    ("1F8B", "application/gzip"),
    ("424D", "image/bmp"),
    ("494433", "audio/mpeg"),
    ("3C3F786D6C", "application/xml"),
    ("7B5C727466", "application/rtf"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("526172211A07", "application/x-rar-compressed"),
    ("425A68", "application/x-bzip2"),
    ("FD377A585A00", "application/x-xz"),
    ("28B52FFD", "application/zstd"),
    ("D0CF11E0A1B11AE1", "application/x-ole-storage"),
    ("25215053", "application/postscript"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("00000100", "image/x-icon"),
    ("4F676753", "audio/ogg"),
    ("664C6143", "audio/flac"),
    ("7F454C46", "application/x-elf"),
    ("CAFEBABE", "application/java-vm"),
    ("50415231", "application/x-parquet"),
    ("53514C69746520666F726D6174203300", "application/x-sqlite3"),
    ("3C21444F4354595045", "text/html"),
    ("3C68746D6C", "text/html"),
]
#: RIFF containers say what they hold in bytes 9 to 12, and MP4 files what they are in bytes 5 to 8.
RIFF = {"57415645": "audio/wav", "41564920": "video/x-msvideo", "57454250": "image/webp"}


def email_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, EMAIL, 1), F.lit(""))


def email_domain(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, EMAIL, 2), F.lit(""))


def is_valid_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def url_is_valid(c: Column) -> Column:
    return c.rlike(URL)


def url_domain(c: Column) -> Column:
    return F.when(url_is_valid(c), F.try_parse_url(c, F.lit("HOST")))


def url_protocol(c: Column) -> Column:
    return F.when(url_is_valid(c), F.try_parse_url(c, F.lit("PROTOCOL")))


def email_map_domains(c: Column) -> Column:
    return F.transform_values(c, lambda k, v: email_domain(v))


def url_map_domains(c: Column) -> Column:
    return F.transform_values(F.map_filter(c, lambda k, v: url_is_valid(v)), lambda k, v: url_domain(v))


def region_of(c: Column, default: str = "US") -> Column:
    """The region that a text names: a code as it is, otherwise the region whose name shares the largest part of its pairs of
    letters with the text (Jaccard; ties by code); the default for nulls and for texts that share none."""
    code = F.upper(F.trim(c))
    # the names' pairs are literals, so that a row has to make only those of its own text
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, p)).alias("p"), F.lit(len(p)).alias("n")) for k, p in sorted(_PAIRS.items())])

    def nearest(own: Column) -> Column:
        def near(r: Column) -> Column:
            return let(F.size(F.array_intersect(own, r["p"])), lambda both: F.struct((-both / (F.size(own) + r["n"] - both)).alias("d"), r["k"].alias("k")))

        return let(F.array_min(F.transform(names, near)), lambda best: F.when(best["d"] < 0, best["k"]).otherwise(F.lit(default)))

    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(code) - 1, F.lit(1))), lambda i: F.substring(code, i, F.lit(2))))
    named = F.element_at(F.create_map(*[F.lit(x) for k, n in _NAMED.items() for x in (n, k)]), code)
    return F.when(code.isNull(), F.lit(default)).when(code.isin(*REGIONS), code).when(code.isin(*_NAMED.values()), named).otherwise(let(own, nearest))


def _calling_code(region: str | Column) -> Column:
    if isinstance(region, str):
        return F.lit(CALLING_CODES[region])
    return F.element_at(F.create_map(*[F.lit(x) for kv in CALLING_CODES.items() for x in kv]), region_of(region))


def parse_phone(c: Column, region: str | Column = "US", strict: bool = False) -> Column:
    """International form +<code><number>, or null. Without a leading + the region's code is taken, a region being a code or a
    column of codes or names; North American numbers have ten digits and begin with 2 to 9, others 7 to 12."""
    others = "|".join(sorted(set(CALLING_CODES.values()) - {"1"}))

    def completed(c: Column, code: Column) -> Column:
        digits = F.regexp_replace(c, "[^0-9]", "")
        return F.when(F.ltrim(c).startswith("+"), digits).when((code == "1") & (F.length(digits) == 11) & digits.startswith("1"), digits).otherwise(F.concat(code, digits))

    def checked(c: Column, full: Column) -> Column:
        fits = full.rlike(rf"^(?:1[2-9]\d{{2}}[2-9]\d{{6}}|(?:{others})\d{{7,12}})$")
        clean = c.rlike(r"^[\s+()./\d-]+$") if strict else F.lit(True)
        return F.when((F.length(c) >= 2) & clean & fits, F.concat(F.lit("+"), full))

    code = _calling_code(region)
    if isinstance(region, str):
        return checked(c, completed(c, code))
    # a region that is looked up is named several times, and is looked up once
    return let(F.struct(c.alias("c"), code.alias("code")), lambda x: let(completed(x["c"], x["code"]), lambda full: checked(x["c"], full)))


def is_valid_phone(c: Column, region: str | Column = "US", strict: bool = False) -> Column:
    """Null for null and for texts of less than two characters."""
    return F.when(F.length(c) >= 2, parse_phone(c, region, strict).isNotNull())


def phone_map_valid(c: Column, region: str = "US") -> Column:
    return F.map_filter(F.transform_values(c, lambda k, v: is_valid_phone(v, region)), lambda k, v: v.isNotNull())


def base64_text(c: Column) -> Column:
    return F.try_to_binary(c, F.lit("base64")).cast("string")


def mime_type(c: Column) -> Column:
    """MIME type by the first bytes of Base64 content; text if they are printable."""
    raw = F.try_to_binary(F.substring(c, 1, 1368), F.lit("base64"))
    head = F.hex(raw)
    out = F.when(F.length(raw) == 0, F.lit(None).cast("string"))
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), kind)
    for held, kind in RIFF.items():
        out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == held), kind)
    out = out.when(F.substring(head, 9, 8) == "66747970", "video/mp4")
    return out.when(head.rlike("^((09|0A|0D|[2-7][0-9A-F])|(C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4])([89AB][0-9A-F]){1,3})*$"), "text/plain").when(raw.isNotNull(), "application/octet-stream")


def mime_types(c: Column) -> Column:
    return F.transform_values(c, lambda k, v: mime_type(v))
