"""Character classes, word lists and rewriting rules.

Everything here is a fixed value: results depend on it exactly.  Patterns are
written so that Java's regular expressions and RE2 read them alike (no nested
classes, no ``\\s`` or ``\\d``, which are ASCII there and Unicode elsewhere).
"""

from __future__ import annotations

# White space by Unicode, and the same without the newline.
_BLANKS = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[\t-\r\x1c- {_BLANKS}]"
SPACE_NO_NEWLINE = f"[\t\x0b-\r\x1c- {_BLANKS}]"
NOT_SPACE = f"[^\t-\r\x1c- {_BLANKS}]"

SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())  # the same, spelled out

ZERO_WIDTH = "\u200c\u200d\ufeff\u061c"
WIDE_SPACES = "\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

BENGALI = "\u0980-\u09ff"
CONSONANT = "\u0995-\u09b9\u09bc\u09ce"  # with nukta and khanda ta
VOWEL_SIGN = "\u09bf\u09c0\u09c1\u09c2\u09c3\u09c7\u09c8\u09cb\u09cc"  # without aa
HASANTA = "\u09cd"
ENTITY = "\u0985-\u09f1"
BENGALI_DIGIT = "\u09e6-\u09ef"

# (pattern, replacement) in order; $n is a group.
REJOIN_OBSERVED = [
    (f"{HASANTA}({SPACE}+)([{CONSONANT}])", f"{HASANTA}$2"),
    (f"([{CONSONANT}])({SPACE}+)([{VOWEL_SIGN}])", "$1$3"),
    (f"([{CONSONANT}\\[{VOWEL_SIGN}]\\])({SPACE}+)([\u0982\u0983])", "$1$3"),
    (f"([{CONSONANT}\\[{VOWEL_SIGN}]\\])({SPACE}+)(\u0981)", "$1$3"),
]
REJOIN_INTENDED = [
    *REJOIN_OBSERVED[:2],
    (f"([{CONSONANT}{VOWEL_SIGN}])({SPACE}+)([\u0982\u0983])", "$1$3"),
    (f"([{CONSONANT}{VOWEL_SIGN}])({SPACE}+)(\u0981)", "$1$3"),
]
SCRIPT_BOUNDARY = [
    (f"([{BENGALI_DIGIT}])([a-zA-Z])", "$1 $2"),
    (f"([a-zA-Z])([{BENGALI_DIGIT}])", "$1 $2"),
    (f"([0-9])([{CONSONANT}])", "$1 $2"),
    (f"([{CONSONANT}])([0-9])", "$1 $2"),
]
TRIM = [(f"\\A{SPACE}+|{SPACE}+\\z", "")]
WHITESPACE = [
    (f"\n{SPACE}*\n{SPACE}*\n+", "\n\n"),
    (" +", " "),
    ("\t", " "),
    ("\n +", "\n"),
    (" +\n", "\n"),
    (f"{SPACE_NO_NEWLINE}{{2,}}", " "),
    *TRIM,
]
OCR = [
    (f"\n{SPACE}*\n{SPACE}*\n", "\n\n"),
    (" {3,}", " "),
    *((f"{c} ", c) for c in ("\u0987", "\u09be", "\u09c7", "\u09cb", "\u09bc", "\u0982", "\u09c3")),
    *TRIM,
]
# After the first rule a space is the only white space.
CLEAN = [
    (f"{SPACE}+", " "),
    ("\u0964\u0964", "\u0964"),
    ("\\?\\?", "?"),
    ("!!", "!"),
    (" +([\u0964!?,.;:])", "$1"),
    ("([\u0964!?]) *", "$1 "),
    (" *\\( *", " ("),
    (" *\\) *", ") "),
    ("\\A +| +\\z", ""),
]

ISSUES = {
    "has_zero_width_chars": "[\u200c\u200d\ufeff]",
    "has_unicode_spaces": "[\xa0\u2000-\u200a\u202f\u205f\u3000]",
    "has_separated_diacritics": f"{HASANTA}{SPACE}+[{CONSONANT}]",
    "has_separated_vowels": f"[{CONSONANT}]{SPACE}+[{VOWEL_SIGN}]",
    "has_mixed_digits": f"[{BENGALI_DIGIT}][a-zA-Z]|[a-zA-Z][{BENGALI_DIGIT}]",
    "excessive_whitespace": f"{SPACE}{{3,}}",
}
FLAGS = {
    "has_mcq": "[\u0995-\u09b9]\\)|[a-d]\\)|\\([\u0995-\u09b9]\\)|\\([a-d]\\)|[A-D]\\.|[\u09e7-\u09ea]\\.",
    "has_bangla": f"[{BENGALI}]",
    "has_english": "[a-zA-Z]",
    "has_numbers": f"[{BENGALI_DIGIT}0-9+\\-\xd7\xf7=<>\u2264\u2265\u2211\u220f\u222b]",
    "has_equations": "\\$[^\n]*?\\$|\\\\[a-zA-Z]+|[=\u2260\u2248<>\u2264\u2265]",
}

ANSWER_WORDS = ["উত্তর", "answer", "ans:", "উঃ", "সঠিক উত্তর"]
MCQ = (
    "[\u0995-\u09b9]\\)|[a-d]\\)|\\([\u0995-\u09b9]\\)|\\([a-d]\\)|[\u09e7-\u09ea]\\."
    f"|প্রশ্ন{SPACE}*[:\\-]|Question{SPACE}*[:\\-]"
    f"|[কখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহ\u09dc\u09dd\u09dfa-dA-D\u09e7-\u09ea1-4][).\x20]{SPACE}*[^\n]"
)
HEADING = "\\A(?:\\p{Nd}+\\.\\p{Nd}+|[অআইঈউঊএঐওঔ]|অধ্যা\u09af\u09bc|পরিচ্ছেদ|বিষ\u09af\u09bc)"
LIST = f"(?:\\A|\n){SPACE}*[\u2022\\-*]{SPACE}"
EQUATION = "[=\u2260\u2248<>\u2264\u2265+\\-\xd7\xf7\u2211\u220f\u222b]"
DEFINITION_WORDS = ["সংজ্ঞা", "definition", "অর্থ", "meaning"]

QUERY_BENGALI = ["কি", "কী", "কে", "কোথা\u09af\u09bc", "কেন", "কিভাবে", "কখন", "বাংলা", "বাংলাদেশ", "ঢাকা", "এর", "এবং", "তার", "যে"]
QUERY_ENGLISH = ["what", "who", "where", "when", "why", "how", "is", "are", "the", "and"]
QUESTION_TYPES = [
    ("who_questions", ["কে", "who"]),
    ("what_questions", ["কী", "কি", "what"]),
    ("why_questions", ["কেন", "why"]),
    ("when_questions", ["কখন", "when"]),
    ("where_questions", ["কোথা\u09af\u09bc", "where"]),
    ("how_questions", ["কীভাবে", "how"]),
]

STOP_WORDS = [
    "এই", "সেই", "এটি", "যে", "তার", "হ\u09af\u09bc", "করে", "থেকে", "দি\u09af\u09bcে", "সাথে",
    "the", "is", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
]
QUESTION_WORDS = [
    "কী", "কি", "কে", "কার", "কোথা\u09af\u09bc", "কখন", "কেন", "কীভাবে",
    "what", "who", "where", "when", "why", "how", "which", "whose",
]
COMMON_WORDS = ["এর", "এই", "সেই", "তার", "যে", "হ\u09af\u09bc", "করে", "একটি", "একজন", "বছর", "year", "years"]
ANSWER_MARKS = ["উত্তর", "answer", "because", "কারণ"]
NUMBER_WORDS = f"[{BENGALI_DIGIT}]+|[0-9]+|সাতাশ|আঠাশ|তিরিশ|চল্লিশ|পঞ্চাশ|পনেরো|ষোল|সতেরো|আঠারো|উনিশ|বিশ"
GENERIC_PHRASES = ["আমি জানি না", "নিশ্চিত নই", "তথ্য নেই", "i don't know", "not sure", "no information"]
ANSWER_PREFIX = "উত্তর:"
QUESTION_PREFIX = "প্রশ্ন:"
