"""Pattern tables and category names."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """A category and what it accepts. Patterns are tried in order; a match that overlaps an earlier one is passed over."""

    category: str
    regex: str


# The accepted shapes, in the order in which they claim text.
BUILT_IN: tuple[Pattern, ...] = (
    Pattern("EMAIL", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    Pattern("SSN", r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b"),
    Pattern("CREDIT_CARD", r"(?<!\d)(?:(?:4\d{3}|5[1-5]\d{2}|6011|65\d{2})([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?!\d)"),
    Pattern("IBAN", r"\b[A-Z]{2}\d{2}(?:[\s]?[\dA-Z]{4}){2,7}(?:[\s]?[\dA-Z]{1,4})?\b"),
    Pattern("PHONE", r"(?<!\d)(?:(?:\+\d{1,3}[-.\s])?(?:\(\d{2,4}\)[-.\s]?|\d{2,4}[-.\s])?\d{3,4}[-.\s]?\d{3,4}|\d{2}(?:[-.\s]\d{2}){3,4})(?!\d)"),
    Pattern("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b|(?<![\w:])(?:(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}|(?:[A-Fa-f0-9]{1,4}:){1,7}:|(?:[A-Fa-f0-9]{1,4}:){1,6}:[A-Fa-f0-9]{1,4}|(?:[A-Fa-f0-9]{1,4}:){1,5}(?::[A-Fa-f0-9]{1,4}){1,2}|(?:[A-Fa-f0-9]{1,4}:){1,4}(?::[A-Fa-f0-9]{1,4}){1,3}|(?:[A-Fa-f0-9]{1,4}:){1,3}(?::[A-Fa-f0-9]{1,4}){1,4}|(?:[A-Fa-f0-9]{1,4}:){1,2}(?::[A-Fa-f0-9]{1,4}){1,5}|[A-Fa-f0-9]{1,4}:(?::[A-Fa-f0-9]{1,4}){1,6}|:(?::[A-Fa-f0-9]{1,4}){1,7})(?![\w:])"),
    Pattern("API_KEY", r"\b(?:sk|pk|api|key|token|secret|bearer)[-_]?[a-zA-Z0-9_-]{20,512}\b"),
    Pattern("AWS_KEY", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    Pattern("JWT", r"\beyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b"),
    Pattern("IL_ID", r"\b\d{9}\b"),
)

#: Defined, but never on unless asked for by name.
OFF = frozenset({"IL_ID"})

# The accepted shapes of each locale. They claim text before the built-in ones.
LOCALES: dict[str, tuple[Pattern, ...]] = {
    "de": (
        Pattern("PHONE_DE", r"(?:\+49\s?|0)[1][5-7]\d[\s\-]?\d{3,4}[\s\-]?\d{4}"),
        Pattern("PHONE_DE_LAND", r"(?:\+49\s?|0)[2-9]\d{1,4}[\s\-\/]?\d{3,8}"),
        Pattern("VAT_DE", r"\bDE\d{9}\b"),
    ),
    "fr": (
        Pattern("PHONE_FR", r"(?:\+33\s?|0)[1-9](?:[\s\.\-]?\d{2}){4}"),
        Pattern("NIR_FR", r"\b[12]\s?\d{2}\s?(?:0[1-9]|1[0-2])\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}\s?\d{2}\b"),
    ),
    "es": (
        Pattern("PHONE_ES", r"(?:\+34\s?)?[6-9]\d{2}[\s\-]?\d{2,3}[\s\-]?\d{2,3}[\s\-]?\d{2,3}"),
        Pattern("DNI_ES", r"\b\d{8}[A-HJ-NP-TV-Z]\b"),
        Pattern("NIE_ES", r"\b[XYZ]\d{7}[A-HJ-NP-TV-Z]\b"),
    ),
    "nl": (
        Pattern("PHONE_NL", r"(?:\+31\s?[1-9]\d|06)[\s\-]?\d{4}[\s\-]?\d{4}"),
        Pattern("POSTAL_NL", r"\b\d{4}\s?[A-Z]{2}\b"),
        Pattern("BSN_NL", r"(?i)(?:bsn|burgerservicenummer|sofi)[\s:]*(\d{9})\b"),
    ),
    "he": (
        Pattern("PHONE_IL", r"(?:\+972[\s\-]?|0)5[0-9][\s\-]?\d{3}[\s\-]?\d{4}"),
        Pattern("PHONE_IL_LAND", r"(?:\+972[\s\-]?|0)[2-489][\s\-]?\d{7}"),
    ),
    "zh": (
        Pattern("NATIONAL_ID_CN", r"\b\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"),
        Pattern("PHONE_CN", r"(?:\+86\s?)?1[3-9]\d[\s\-]?\d{4}[\s\-]?\d{4}"),
    ),
    "ja": (
        Pattern("PHONE_JP", r"(?:\+81\s?|0)[789]0[\s\-]?\d{4}[\s\-]?\d{4}"),
        Pattern("PHONE_JP_LAND", r"(?:\+81\s?|0)[1-9]\d{0,3}[\s\-]?\d{2,4}[\s\-]?\d{4}"),
        Pattern("MY_NUMBER_JP", r"(?i)(?:マイナンバー|my\s?number)[\s:]*(\d{12})\b"),
    ),
    "ru": (
        Pattern("PHONE_RU", r"(?:\+7|8)[\s\-]?\(?9\d{2}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"),
        Pattern("PHONE_RU_LAND", r"(?:\+7|8)[\s\-]?\(?[3-8]\d{2}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"),
        Pattern("SNILS_RU", r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b"),
        Pattern("INN_RU", r"(?i)(?:инн|inn)[\s:]*(\d{10}(?:\d{2})?)\b"),
    ),
    "ko": (
        Pattern("PHONE_KR", r"(?:\+82[\s\-]?)?0?1[016789][\s\-]?\d{3,4}[\s\-]?\d{4}"),
        Pattern("PHONE_KR_LAND", r"(?:\+82[\s\-]?)?0[2-6]\d?[\s\-]?\d{3,4}[\s\-]?\d{4}"),
        Pattern("RRN_KR", r"\b\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\s\-]\d{7}\b"),
    ),
    "it": (
        Pattern("PHONE_IT", r"(?:\+39[\s\-]?)?3\d{2}[\s\-]?\d{6,7}"),
        Pattern("PHONE_IT_LAND", r"(?:\+39[\s\-]?)?0\d{1,3}[\s\-]?\d{4,8}"),
        Pattern("CODICE_FISCALE_IT", r"\b[A-Z]{6}\d{2}[ABCDEHLMPRST](?:[0-4]\d|[5-7][01])[A-Z]\d{3}[A-Z]\b"),
    ),
    "pl": (
        Pattern("PHONE_PL", r"(?:\+48[\s\-]?)?\d{3}[\s\-]?\d{3}[\s\-]?\d{3}"),
        Pattern("PESEL_PL", r"(?i)(?:pesel)[\s:]*(\d{2}(?:[02468][1-9]|[13579][012])(?:0[1-9]|[12]\d|3[01])\d{5})\b"),
        Pattern("NIP_PL", r"(?i)(?:nip)[\s:]*(\d{3}-?\d{3}-?\d{2}-?\d{2})\b"),
    ),
    "pt": (
        Pattern("PHONE_PT", r"(?:\+351[\s\-]?)?9[1236]\d[\s\-]?\d{3}[\s\-]?\d{3}"),
        Pattern("PHONE_BR", r"(?:\+55[\s\-]?)?\(?[1-9]\d\)?[\s\-]?9?\d{4}[\s\-]?\d{4}"),
        Pattern("CPF_BR", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"),
    ),
    "hi": (
        Pattern("PHONE_IN", r"(?:\+91[\s\-]?)?[6-9]\d{4}[\s\-]?\d{5}"),
        Pattern("PAN_IN", r"\b[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]\b"),
        Pattern("AADHAAR_IN", r"(?i)(?:aadhaar|आधार|uidai)[\s:]*([2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4})\b"),
    ),
}

# The names that custom patterns may not take.
REGEX_CATEGORIES = frozenset(p.category for p in BUILT_IN)
NER_CATEGORIES = frozenset({"PERSON", "ORG", "GPE", "FAC", "NORP", "MISC"})
LLM_CATEGORIES = frozenset({"ADDRESS", "DATE_OF_BIRTH", "MEDICAL", "FINANCIAL", "NATIONAL_ID", "BIOMETRIC", "USERNAME", "PASSWORD", "VEHICLE"})
SPECIAL_CATEGORIES = frozenset({"RACE", "ETHNICITY", "RELIGION", "POLITICAL_OPINION", "HEALTH_BIOMETRIC", "SEXUAL_ORIENTATION", "TRADE_UNION", "GENETIC"})
LOCALE_CATEGORIES = frozenset(p.category for ps in LOCALES.values() for p in ps)
RESERVED = REGEX_CATEGORIES | NER_CATEGORIES | LLM_CATEGORIES | SPECIAL_CATEGORIES | LOCALE_CATEGORIES

# Labels of named-entity models and the categories they stand for.
NER_LABELS = {
    "PERSON": "PERSON", "ORG": "ORG", "GPE": "GPE", "FAC": "FAC", "NORP": "NORP", "LOC": "GPE", "PER": "PERSON", "MISC": "MISC",
    "PS": "PERSON", "LC": "GPE", "OG": "ORG", "persName": "PERSON", "placeName": "GPE", "geogName": "GPE", "orgName": "ORG",
}


def registry() -> list[tuple[str, str]]:
    """(category, family) of every built-in category."""
    families = {"regex": REGEX_CATEGORIES, "ner": NER_CATEGORIES, "llm": LLM_CATEGORIES, "special": SPECIAL_CATEGORIES, "locale": LOCALE_CATEGORIES}
    return sorted((c, f) for f, cs in families.items() for c in cs)
