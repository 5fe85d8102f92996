"""Scripts of characters and types of tokens as ordered rules.

The same rule tables give Spark columns here and CASE expressions for SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (script, code-point ranges or Unicode categories), the first that fits wins.
SCRIPT_RULES: tuple[tuple[str, str], ...] = (
    ("LATIN", r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"),
    ("NUMERIC", r"0-9\p{Nd}"),
    ("PUNCTUATION_SPACE", r"\p{P}\p{Z}\p{C}"),
    ("CYRILLIC", r"\x{400}-\x{52F}"),
    ("ARABIC", r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}"),
    ("DEVANAGARI", r"\x{900}-\x{97F}"),
    ("BENGALI", r"\x{980}-\x{9FF}"),
    ("GURMUKHI", r"\x{A00}-\x{A7F}"),
    ("GUJARATI", r"\x{A80}-\x{AFF}"),
    ("ODIA", r"\x{B00}-\x{B7F}"),
    ("TAMIL", r"\x{B80}-\x{BFF}"),
    ("TELUGU", r"\x{C00}-\x{C7F}"),
    ("KANNADA", r"\x{C80}-\x{CFF}"),
    ("MALAYALAM", r"\x{D00}-\x{D7F}"),
    ("CJK_HAN", r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"),
    ("JAPANESE_KANA", r"\x{3040}-\x{30FF}"),
    ("HANGUL", r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"),
    ("THAI", r"\x{E00}-\x{E7F}"),
    ("MYANMAR", r"\x{1000}-\x{109F}"),
    ("KHMER", r"\x{1780}-\x{17FF}"),
    ("LAO", r"\x{E80}-\x{EFF}"),
    ("HEBREW", r"\x{590}-\x{5FF}"),
    ("GREEK", r"\x{370}-\x{3FF}"),
    ("ARMENIAN", r"\x{530}-\x{58F}"),
    ("GEORGIAN", r"\x{10A0}-\x{10FF}"),
    ("ETHIOPIC", r"\x{1200}-\x{137F}"),
    ("EMOJI_SYMBOL", r"\p{S}\x{1F300}-\x{1FAFF}"),
)
#: Scripts that don't count towards the script of a text, and that of a text without others.
NEUTRAL, DEFAULT_SCRIPT = ("PUNCTUATION_SPACE", "NUMERIC", "UNKNOWN"), "LATIN"

#: Words of code, and openings of transliterated words.
CODE_TOKENS = "def|class|function|const|let|var|import|from|return|if|else|elif|while|for|break|continue|try|except|public|private|static|void|int|float|bool|string|dict|list|tuple|async|await|lambda|=>|->|::|==|!=|<=|>=|\\+\\+|--"
POOL_CODE_WORDS = "def|class|function|const|let|var|import|return|if|else|while|for|public|private|int|float|bool|string"
TRANSLITERATION = "aa|ee|oo|kh|gh|ch|jh|th|dh|ph|bh|sh|zh|ng|ny|ts|shk"
CURRENCY = r"[$€£¥₹₽₩₪₫₴₺฿]"
SPACE = r"[\p{Z}\x09-\x0d\x{85}]"
NOT_SPACE = r"[^\p{Z}\x09-\x0d\x{85}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
SYMBOL = r"[^\p{L}\p{N}_\p{Z}\x09-\x0d\x{85}]"

#: (type, pattern over the token); patterns hold for Java and RE2. "" stands for rules with a length or a case test.
TOKEN_RULES: tuple[tuple[str, str], ...] = (
    ("SPECIAL_CONTROL", r"^<\|(?s:.*)\|>$"),
    ("WHITESPACE_FACTOR", rf"^{SPACE}+$"),
    ("EMOJI", r"^[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}]*[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}][\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}]*$"),
    ("URL_EMAIL", rf"(?i)^(https?://|www\.)[^\p{{Z}}\x09-\x0d/$.?#].{NOT_SPACE}*$"),
    ("URL_EMAIL", r"^[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+$"),
    ("CURRENCY", rf"^{CURRENCY}{SPACE}*\p{{Nd}}+([.,]\p{{Nd}}+)?$|^\p{{Nd}}+([.,]\p{{Nd}}+)?{SPACE}*{CURRENCY}$"),
    ("DATE_TIME", r"^\p{Nd}{4}[-/.]\p{Nd}{1,2}[-/.]\p{Nd}{1,2}$|^\p{Nd}{1,2}[-/.]\p{Nd}{1,2}[-/.]\p{Nd}{2,4}$"),
    ("NUMBER", r"^\p{Nd}+(\.\p{Nd}+)?$"),
    ("CODE_SYNTAX", rf"^{SPACE}*({CODE_TOKENS}){SPACE}*$"),
    ("PUNCTUATION", rf"^{SYMBOL}+$"),
    ("MULTI_WORD_PHRASE", rf"{WORD_CHAR}{SPACE}+{WORD_CHAR}"),
    ("WHITESPACE_FACTOR", rf"^[ \n\t]{SPACE}*({SYMBOL}*[\p{{L}}\p{{N}}_]|{SYMBOL}+{SPACE})"),
    ("UNICODE_CHAR", r"^(?s:.)$"),
    ("MORPHOLOGY_UNIT", r"^(##|@@)|@@$"),
    ("CASE_FACTOR", r"^\p{Lu}{2,}$"),
    ("TRANSLITERATION_UNIT", rf"(?i)^({TRANSLITERATION})"),
    ("SUBWORD", r"^\p{L}{1,3}$"),
    ("WHOLE_WORD", r"^\p{L}+$"),
)
#: The same for the structural types of pool entries; patterns see the token, those marked with ~ the stripped one.
STRUCTURE_RULES: tuple[tuple[str, str], ...] = (
    ("OTHER", r"^<\|(?s:.*)\|>$"),
    ("CJK", r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"),
    ("INDIC", r"[\x{900}-\x{D7F}]"),
    ("ARABIC", r"[\x{600}-\x{8FF}]"),
    ("CYRILLIC", r"[\x{400}-\x{52F}]"),
    ("NUMBER", rf"^{SPACE}*\p{{Nd}}+(\.\p{{Nd}}+)?{SPACE}*$"),
    ("PUNCTUATION", rf"^{SPACE}*{SYMBOL}+{SPACE}*$"),
    ("CODE", rf"^{SPACE}*({POOL_CODE_WORDS}){SPACE}*$"),
    ("ROMANIZED", rf"(?i)^{SPACE}*({TRANSLITERATION})"),
    ("SPACE_WORD", r"^ \p{L}+$"),
    ("MULTIWORD", rf"{NOT_SPACE} (?s:.*){NOT_SPACE}"),
    ("CHARACTER", r"^(?s:.)$"),
    ("SUBWORD", r"^\p{L}{1,3}$"),
    ("WORD", r"^\p{L}+$"),
)
#: Character classes of vocabulary pruning; the loose CJK class is what a truncated escape covers.
RANGES = {
    "indic": r"\x{900}-\x{D7F}",
    "cjk_strict": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}",
    "cjk_loose": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{2001}-\x{2A6D}",
    "cyrillic": r"\x{400}-\x{52F}",
    "arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}",
    "european": r"\x{C0}-\x{24F}",
}


def _first_match(value: Column, rules, otherwise: str, wrap=lambda p: p) -> Column:
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(value.rlike(wrap(pattern)), name).otherwise(out)
    return out


def char_script(character: Column) -> Column:
    """Script of a one-character string."""
    return _first_match(character, SCRIPT_RULES, "UNKNOWN", lambda p: f"[{p}]")


def token_type(token: Column) -> Column:
    """Type of a token; one byte is RAW_BYTE, whatever it is."""
    return F.when(F.octet_length(token) == 1, "RAW_BYTE").otherwise(_first_match(token, TOKEN_RULES, "SUBWORD"))


def structural_type(token: Column) -> Column:
    """Structural type of a pool entry; one byte is BYTE."""
    return F.when(F.octet_length(token) == 1, "BYTE").otherwise(_first_match(token, STRUCTURE_RULES, "SUBWORD"))


def has_any(token: Column, kind: str) -> Column:
    """Whether any character of the token is in a class of RANGES."""
    return token.rlike(f"[{RANGES[kind]}]")


def sql_case(value: str, rules, otherwise: str, wrap=lambda p: p) -> str:
    """The rules as a CASE over regexp_matches."""
    quoted = lambda p: wrap(p).replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{quoted(p)}') THEN '{n}'" for n, p in rules) + f" ELSE '{otherwise}' END"

#: Scalars whose class differs between Unicode versions, as ranges of code points.
TABLE_RISK = (
    (0x295, 0x295), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x1ACF, 0x1ADD), (0x1AE0, 0x1AEB), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7F1, 0xA7F1), (0xFBC3, 0xFBD2), (0xFD90, 0xFD91), (0xFDC8, 0xFDCE), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED0, 0x10ED8),
    (0x10EFA, 0x10EFB), (0x11B60, 0x11B67), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18D09, 0x18D1E), (0x18D80, 0x18DF2), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6F5), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
)
TABLE_RISK_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in TABLE_RISK) + "]"


def table_risk(text: Column) -> Column:
    """Whether a text has a scalar that encoders with other Unicode tables may cut differently; false for null."""
    return F.coalesce(text.rlike(TABLE_RISK_CLASS), F.lit(False))
