"""Tables that results depend on, stated in full and in natural order."""

# Diplomatic substitutions by tradition.
FRENCH_MEDIEVAL = {"ſ": "s", "u": "v", "i": "j", "y": "i", "æ": "ae", "œ": "oe", "ꝑ": "per", "ꝓ": "pro", "&": "et"}
FRENCH_EARLY_MODERN = {"ſ": "s", "æ": "ae", "œ": "oe", "&": "et", "ỹ": "yn"}
LATIN_MEDIEVAL = {"ſ": "s", "u": "v", "i": "j", "y": "i", "æ": "ae", "œ": "oe", "ꝑ": "per", "ꝓ": "pro", "ꝗ": "que", "&": "et"}
LONG_S = {"ſ": "s"}
REJOINED = {"—\n": "", "¬\n": "", "_": " ", "aͤ": "ä", "oͤ": "ö", "uͤ": "ü"}
CONFORMITY = {**REJOINED, "ß": "ss", "ꝛ": "r", "œ": "oe", "æ": "ae"}
PUNCTUATION = ".,;:!?'’\"-–—()[]«»…"

# Archaic characters, and code points of medieval glyphs.
ARCHAIC_CORE = "ſꝛ⁊ꝑꝓꝗꝙꝯꝝꝫꝭþðȝ\u0364"
GLYPH_RANGES = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD), (0xA720, 0xA7FF), (0xFB00, 0xFB06))
GLYPH_LETTERS = "þÞðÐƿǷſæÆœŒøØƀŧđħȝȜ"

# Error classes of word pairs, ligatures and lookalikes.
ERROR_CLASSES = ("segmentation", "case", "diacritic", "ligature", "visual", "lacuna", "insertion", "other")
LIGATURES = (("œ", "oe"), ("æ", "ae"), ("Œ", "OE"), ("Æ", "AE"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"))
LOOKALIKES = (("rn", "m"), ("1", "l"), ("I", "l"), ("|", "l"), ("0", "o"), ("O", "o"), ("ſ", "s"), ("u", "n"))

# Patterns and units of numeric sequences.
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"
FOLIATION = r"\b(?:fol\.?|f\.|pp\.|p\.|n\.°|n°)\s*(\d+(?:\s*-\s*\d+)?)\s*([rvRV])?"
CURRENCY = r"\b(\d+(?:[.,]\d+)?)\s*(livres?|sols?|deniers?|écus?|florins?|francs?|l\.|s\.|d\.|£|€|₣)(?=\b|[\s,;.!?:]|$)"
REGNAL = r"\b(?:l['’]\s*)?an\s+(?:de\s+(?:grâce|la\s+R[eé]publique)\s+)?([IVXLCDM]+|[ivxlcdm]+|\d{1,4})\b"
UNITS = {"livres": "livre", "livre": "livre", "l.": "livre", "sols": "sol", "sol": "sol", "s.": "sol", "deniers": "denier", "denier": "denier", "d.": "denier", "écus": "écu", "écu": "écu", "florins": "florin", "florin": "florin", "francs": "franc", "franc": "franc", "£": "£", "€": "€", "₣": "₣"}
SEQUENCES = ("year", "foliation", "currency", "regnal")

# Roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
NUMERAL = r"\b[IVXLCDMivxlcdmj]+\b"
ROMAN_PAIRS = ("IV", "IX", "XL", "XC", "CD", "CM")
ROMAN_RUNS = ("VV", "LL", "DD", "IIIII", "XXXXX", "CCCCC", "MMMMMM")

# Abbreviation signs with their developments, and marks of early prints.
ABBREVIATIONS = {"ꝑ": ("per", "par"), "ꝓ": ("pro",), "ꝗ": ("qui",), "ꝙ": ("quia",), "ꝯ": ("us", "con"), "⁊": ("et",), "ꝝ": ("rum",), "ꝫ": ("et",), "ꝭ": ("is",), "p̃": ("par", "per"), "q̃": ("que", "qui")}
EARLY_PRINT = {"ligatures": "ﬀﬁﬂﬃﬄﬅﬆ", "long_s": "ſ", "dotless_i": "ı", "ampersand": "&", "nasal_tildes": "ãÃñÑõÕũŨẽẼĩĨ"}

# Abbreviations of modern archives with their developments, by category.
ARCHIVES = {
    "civility_titles": {"Mme": ("Madame",), "Mlle": ("Mademoiselle",), "Mgr": ("Monseigneur",), "Dr": ("Docteur",), "Pr": ("Professeur",), "Me": ("Maître",), "M.": ("Monsieur",), "R.P.": ("Révérend Père",), "S.M.": ("Sa Majesté",), "S.A.R.": ("Son Altesse Royale",), "S.E.": ("Son Excellence",), "S.S.": ("Sa Sainteté",)},
    "ordinals": {"1ᵉʳ": ("1er", "premier"), "1ʳᵉ": ("1re", "première", "premiere"), "2ᵈ": ("2d", "second"), "2ᵈᵉ": ("2de", "seconde"), "2ᵉ": ("2e", "deuxième", "deuxieme"), "3ᵉ": ("3e", "troisième", "troisieme"), "Iᵉʳ": ("Ier", "premier"), "Vᵉ": ("Ve", "cinquième", "cinquieme"), "XIᵉ": ("XIe", "onzième", "onzieme"), "XIIᵉ": ("XIIe", "douzième", "douzieme"), "XVIᵉ": ("XVIe", "seizième", "seizieme"), "XVIIᵉ": ("XVIIe", "dix-septième", "dix-septieme"), "XVIIIᵉ": ("XVIIIe", "dix-huitième", "dix-huitieme"), "XIXᵉ": ("XIXe", "dix-neuvième", "dix-neuvieme"), "XXᵉ": ("XXe", "vingtième", "vingtieme")},
    "currency": {"₶": ("livre tournois", "livres tournois"), "₣": ("franc", "francs"), "ƒ": ("florin", "florins"), "£": ("livre", "livres", "pound", "pounds"), "l.": ("livre", "livres"), "s.": ("sol", "sols", "sou", "sous"), "d.": ("denier", "deniers")},
    "administrative": {"arr.": ("arrondissement",), "dép.": ("département", "departement"), "cant.": ("canton",), "com.": ("commune",), "reg.": ("régiment", "regiment"), "prov.": ("province",)},
    "civil_status": {"°": ("né", "née"), "†": ("mort", "morte", "décédé", "décédée"), "✶": ("naissance",), "⚭": ("marié", "mariée", "épousa", "epousa"), "ép.": ("épouse", "époux", "epouse", "epoux"), "vve": ("veuve",)},
    "typographic_punctuation": {"«": ('"',), "»": ('"',), "—": ("-", "--"), "–": ("-",), "…": ("...",), "’": ("'",), "‘": ("'",)},
    "latin_abbr_modern": {"e.g.": ("for example", "par exemple", "exempli gratia"), "i.e.": ("c'est-à-dire", "id est", "that is"), "etc.": ("et cetera", "et caetera"), "cf.": ("confer", "voir"), "ibid.": ("ibidem",), "op. cit.": ("opere citato", "opus citatum"), "ad lib.": ("ad libitum",), "N.B.": ("nota bene",)},
    "bibliographic": {"vol.": ("volume",), "t.": ("tome",), "p.": ("page",), "pp.": ("pages",), "n°": ("numéro", "numero", "no"), "fasc.": ("fascicule",), "éd.": ("édition", "edition"), "ms.": ("manuscrit",), "f.": ("folio",), "r°": ("recto",), "v°": ("verso",)},
    "address": {"bd": ("boulevard",), "av.": ("avenue",), "r.": ("rue",), "pl.": ("place",), "imp.": ("impasse",), "fbg": ("faubourg",)},
}
BEFORE_DOTTED = "\\s,;:!?([«\"'"
AFTER_DOTTED = "\\s,;:!?)\\]»\"'…"

# Critical values of the studentised range for mean ranks at 0.05 and 0.01, by number of competitors.
RANK_CRITICAL = {2: (1.960, 2.576), 3: (2.343, 2.913), 4: (2.569, 3.113), 5: (2.728, 3.255), 6: (2.850, 3.364), 7: (2.949, 3.452), 8: (3.031, 3.526), 9: (3.102, 3.590), 10: (3.164, 3.646), 11: (3.219, 3.696), 12: (3.268, 3.741), 13: (3.313, 3.781), 14: (3.354, 3.818), 15: (3.391, 3.853), 16: (3.426, 3.886), 17: (3.458, 3.916), 18: (3.489, 3.944), 19: (3.517, 3.970), 20: (3.544, 3.995), 25: (3.658, 4.095), 30: (3.739, 4.167), 40: (3.858, 4.272), 50: (3.945, 4.349)}
