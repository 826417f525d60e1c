"""Word lists and patterns that results depend on."""

# Abbreviations in business names.
NAME_ABBREVIATIONS = {
    "corp": "corporation", "intl": "international", "mfg": "manufacturing", "co": "company",
    "bros": "brothers", "svc": "services", "svcs": "services", "mgmt": "management",
    "assoc": "associates", "dept": "department", "natl": "national", "ent": "enterprises",
    "pvt": "private", "ltd": "limited", "inc": "incorporated", "mfrs": "manufacturers",
    "engg": "engineering", "eng": "engineering", "cons": "consultants", "govt": "government",
    "hosp": "hospital", "univ": "university", "inst": "institute", "assn": "association",
    "ctr": "center", "centre": "center", "grp": "group", "hldgs": "holdings", "ind": "industries",
    "inds": "industries", "st": "saint", "ste": "sainte", "cie": "compagnie",
    "soc": "societe", "tech": "technologies",
}

# Legal forms of several words, in the order in which they are tried.
LEGAL_PHRASES = [
    ("private limited", "PVT"), ("pvt limited", "PVT"), ("pvt ltd", "PVT"), ("p ltd", "PVT"),
    ("pte ltd", "PVT"), ("et compagnie", "ETCIE"), ("et cie", "ETCIE"), ("and company", "CO"),
    ("and fils", "ETFILS"), ("et fils", "ETFILS"), ("limited liability company", "LLC"),
    ("professional corporation", "PC"),
]

# Legal forms of one word.
LEGAL_WORDS = {
    "inc": "INC", "incorporated": "INC", "corp": "CORP", "corporation": "CORP", "llc": "LLC",
    "ltd": "LTD", "limited": "LTD", "pvt": "PVT", "private": "PVT", "llp": "LLP", "plc": "PLC",
    "lp": "LP", "pllc": "PLLC", "pc": "PC", "pa": "PA", "co": "CO", "company": "CO",
    "sarl": "SARL", "sas": "SAS", "sasu": "SASU", "sa": "SA", "eurl": "EURL", "snc": "SNC",
    "sci": "SCI", "scop": "SCOP", "ei": "EI", "eirl": "EI", "selarl": "SELARL", "selas": "SELAS",
    "gie": "GIE", "sca": "SCA", "scs": "SCS", "scm": "SCM", "scp": "SCP", "gmbh": "GMBH", "opc": "OPC",
}

# Words that a name's core leaves out.
NAME_STOP_WORDS = ["the", "of", "and", "et", "de", "du", "des", "la", "le", "les", "l", "d", "a", "an", "dr", "ms"]

# Patterns of names (Java and Python regular expressions alike).
ALIAS_SPLIT = r"\b(?:d\s*/\s*b\s*/\s*a|d\.b\.a\.?|dba|t\s*/\s*a|trading as|aka|a\.k\.a\.?)\b"
BRACKETED = r"[\(\[\{]([^\)\]\}]*)[\)\]\}]"
WEBSITE = r"^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|net|org|in|co\.in|fr|biz|info|co|us|io)\b"

# Abbreviations in addresses.
ADDRESS_ABBREVIATIONS = {
    "rd": "road", "st": "st", "str": "st", "street": "st", "saint": "st", "sainte": "ste", "suite": "ste",
    "r": "rue", "che": "chemin", "rn": "route", "qt": "quartier", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "bd": "boulevard", "bld": "boulevard", "ln": "lane", "dr": "drive", "hwy": "highway", "ste": "ste",
    "fl": "floor", "flr": "floor", "apt": "apartment", "bldg": "building", "nr": "near",
    "opp": "opposite", "sec": "sector", "ph": "phase", "chem": "chemin", "pl": "place",
    "fg": "faubourg", "ct": "court", "cir": "circle", "pkwy": "parkway", "ter": "terrace",
    "sq": "square", "trl": "trail", "pt": "point", "mt": "mount", "ft": "flat", "hno": "house",
    "no": "number", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast",
    "nw": "northwest", "se": "southeast", "sw": "southwest", "crs": "cross", "ngr": "nagar",
    "clny": "colony", "mkt": "market", "stn": "station", "dist": "district", "tq": "taluk",
    "po": "post", "pkg": "parking", "imp": "impasse", "all": "allee", "rte": "route", "qu": "quai",
    "unit": "unit", "bldng": "building", "cplx": "complex", "comp": "complex", "hsg": "housing",
    "soc": "society", "ind": "industrial", "estt": "estate", "est": "estate", "bazar": "bazaar",
}

# Ordinals as numbers.
ORDINAL_WORDS = {
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6",
    "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10", "eleventh": "11", "twelfth": "12",
    "premier": "1", "premiere": "1", "deuxieme": "2", "troisieme": "3",
}

# Words that an address's core leaves out.
ADDRESS_DROP_WORDS = ["null", "none", "na", "nan", "unit", "suite", "apartment", "number", "house", "box", "post", "office", "of", "the", "and", "de", "du", "des", "la", "le", "les", "d", "l"]

# States and regions by code or former name.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado",
    "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho",
    "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana",
    "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota",
    "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada",
    "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina",
    "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas",
    "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia",
    "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
    "ap": "andhra pradesh", "arp": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh",
    "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand",
    "ka": "karnataka", "kl": "kerala", "keralam": "kerala", "mp": "madhya pradesh", "mh": "maharashtra",
    "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "od": "odisha",
    "orissa": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim",
    "tg": "telangana", "ts": "telangana", "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand",
    "uttaranchal": "uttarakhand", "wb": "west bengal", "dl": "delhi", "jk": "jammu and kashmir",
    "ch": "chandigarh", "py": "puducherry", "pondicherry": "puducherry",
}
# Full names reached only by keys that no token can spell.
STATES_BY_NAME_ONLY = ["manipur", "tamil nadu", "goa"]

# Patterns of addresses.
ORDINAL_SUFFIX = r"\b(\d+)(?:st|nd|rd|th|er|e|eme|ere)\b"
POSTCODE_6 = r"\b\d{6}\b"
POSTCODE_5 = r"\b\d{5}(?:-\d{4})?\b"
LANDMARK = r"\b(?:near|nr|opposite|opp|behind|beside|next to|a cote de|pres de|en face de)\b\.?\s*([^,]*)"
NUMBER_SIGN = r"\b[Nn]\s*[°º]\s*"
TEXT_JUNK = r"""[#\[\]<>{}|*_~^"]+|--+"""
