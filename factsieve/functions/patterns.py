"""Every regular expression of the package, in one place.

The same text runs in two engines: Java (Spark columns, with the ``(?U)`` flag
that makes ``\\b \\d \\s`` Unicode aware) and the Python ``regex`` module (the
stateful stream function, Unicode aware by default).

A leading lookahead such as ``(?=\\d)`` never changes what matches; it lets the
engine reject most start positions with one character test.
"""

# The ASCII letters plus the two characters that case-fold to one.
LETTERS = "A-Za-zſK"

# What counts as an email, phone, social security or card number.
EMAIL = rf"\b[{LETTERS}0-9._%+\-]++@[{LETTERS}0-9.\-]+\.[{LETTERS}]{{2,}}\b"
# The same in parts, for a search from each ``@``: one character of the local part, the
# domain after the sign, and the local part at the end of a run with the character before it.
EMAIL_RUN = rf"[{LETTERS}0-9._%+\-]"
EMAIL_DOMAIN_RUN = rf"[{LETTERS}0-9.\-]*+"
EMAIL_DOMAIN_END = rf"\.[{LETTERS}]{{2,}}\b"
EMAIL_DOMAIN = rf"[{LETTERS}0-9.\-]+{EMAIL_DOMAIN_END}"
EMAIL_LOCAL_END = rf"^[^{LETTERS}0-9._%+\-]?{EMAIL_RUN}*?\b({EMAIL_RUN}+)\z"
PHONE = (
    r"(?=[+(\d])(?:"
    r"\+\s*1[\s.\-]*\(\s*\d{3}\s*\)[\s.\-]*\d{3}[\s.\-]*\d{4}"
    r"|\+\s*7[\s.\-]*\d{3}[\s.\-]*\d{3}[\s.\-]*\d{2}[\s.\-]*\d{2}"
    r"|\b\d{3}[.\-]\d{3}[.\-]\d{4}\b"
    r"|\b\(\d{3}\)\s*\d{3}[\s.\-]*\d{4}\b"
    r")"
)
SSN = r"(?=\d)\b\d{3}-\d{2}-\d{4}\b"
CREDIT_CARD = r"(?=\d)\b(?:\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}|\d{16})\b"

# The four types in the order verdicts list them.
PII_PATTERNS = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "credit_card": CREDIT_CARD}

DIGIT = r"\d"
OTHER_DIGIT = r"[\d&&[^0-9]]"
DIGIT_PII = rf"(?=[+(\d])(?:{PHONE}|{SSN}|{CREDIT_CARD})"

# The multiplier words, as spelled alternatives in order of preference.
MULTIPLIER_WORDS = (
    r"млн|миллион(?:а|ов)?|million|тыс\.?|тысяч[аи]?|thousand|млрд|миллиард(?:а|ов)?|billion"
)
# Word beginnings and the factor they stand for.
MULTIPLIER_FACTORS = {
    1e9: ("млрд", "миллиард", "billion"),
    1e6: ("млн", "миллион", "million"),
    1e3: ("тыс", "thousand"),
}

# Further characters that fold to a letter of the multiplier words.
_FOLDS = {
    "s": "ſ",
    "в": "ᲀ",
    "д": "ᲁ",
    "о": "ᲂ",
    "с": "ᲃ",
    "т": "ᲄᲅ",
}


def _any_case(pattern: str) -> str:
    """Spell out both cases of each letter outside and inside classes.

    An explicit class keeps the two engines alike; their case-insensitive flags
    disagree on a few letters.
    """
    out, in_class = [], False
    for ch in pattern:
        if ch in "[]":
            in_class = ch == "["
        if ch.isalpha():
            both = ch + ch.upper() + _FOLDS.get(ch, "")
            ch = both if in_class else f"[{both}]"
        out.append(ch)
    return "".join(out)


# The number grammar (US groups, EU groups, plain; sign and percent).
NUMBER = (
    r"(?=[±+\-\d])[±+\-]?(?:"
    r"\d{1,3}(?:,\d{3})+(?:\.\d+)?"
    r"|\d{1,3}(?:\.\d{3})+(?:,\d+)?"
    r"|\d+(?:[.,]\d+)?"
    r")(?:\s*%)?"
)
# A multiplier word holds no digit and no sign, so taking it into the match
# leaves every later match where it was.
NUMBER_WITH_MULTIPLIER = rf"{NUMBER}(?:\s*(?:{_any_case(MULTIPLIER_WORDS)})\b)?"
NUMBER_CORE = r"[\d.,]+"
# Numbers that a cast reads as they stand.
PLAIN_NUMBER = r"^[+\-]?[0-9]+(?:\.[0-9]+)?$"

# No match of PII_PATTERNS goes across such a position: the character before it
# belongs to no pattern, or it parts a blank from a letter (addresses hold no
# blank, digit patterns hold no letter). The group is all text before the last one.
UP_TO_LAST_CUT = (
    rf"(?s)^(.*)(?:(?<=[^{LETTERS}0-9._%+\-@()\s\d])"
    rf"|(?<=\s)(?=[{LETTERS}])|(?<=[{LETTERS}])(?=\s))"
)


def java(pattern: str) -> str:
    """The pattern as Spark's regex functions need it."""
    return "(?U)" + pattern
