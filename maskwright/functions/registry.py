"""The catalog of detectors: patterns, priors, gates, mask functions, column-name categories."""

from __future__ import annotations

from dataclasses import dataclass

# Type, pattern source (JavaScript syntax), case-insensitive or not. The order is the claim priority.
PATTERNS: tuple[tuple[str, str, bool], ...] = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", False),
    ("phone", r"\b(?:\+?(\d{1,3}))?[-\.\s]?\(?(\d{2,4})\)?[-\.\s]?(\d{3,4})[-\.\s]?(\d{4})\b", False),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", False),
    ("dateOfBirth", r"\b(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4}|\d{2}[-/.\s](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[-/.\s]\d{4})\b", True),
    ("australianPassport", r"\b[A-Z]\d{7}\b", False),
    ("australianDriversLicense", r"\b(?:Lic|License|Licence)[#:\s-]*([A-Z0-9]{6,10})\b", True),
    ("usPassport", r"\b(?:[A-Z]\d{8}|\d{9})\b", False),
    ("usDriversLicense", r"\b(?:DL|License)[#:\s-]*([A-Z0-9]{6,12})\b", True),
    ("ukPassport", r"\b\d{9}\b", False),
    ("ukDriversLicense", r"\b[A-Z]{5}\d{6}[A-Z]{2}\d[A-Z]{2}\b", False),
    ("ukNationalInsurance", r"\b[A-Z]{2}\d{6}[A-Z]\b", False),
    ("euPassport", r"\b[A-Z0-9]{8,9}\b", False),
    ("passportNumber", r"\b(?:Passport|Pass)[#:\s-]*([A-Z0-9]{6,12})\b", True),
    ("nationalID", r"\b(?:ID|National\s*ID|Identity)[#:\s-]*([A-Z0-9]{6,15})\b", True),
    ("driversLicense", r"\b(?:DL|Driver|Licence|License)[#:\s-]*([A-Z0-9]{6,15})\b", True),
    ("australianBSB", r"\b\d{3}[-\s]?\d{3}\b", False),
    ("australianAccountNumber", r"\b(?:Account|Acc|A\/C)[#:\s-]*(\d{6,9})\b", True),
    ("creditCardVisa", r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", False),
    ("creditCardMastercard", r"\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", False),
    ("creditCardAmex", r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b", False),
    ("creditCardGeneric", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", False),
    ("australianTFN", r"\b\d{3}\s?\d{3}\s?\d{3}\b", False),
    ("australianABN", r"\b\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b", False),
    ("australianMedicare", r"\b\d{4}\s?\d{5}\s?\d\b", False),
    ("australianPhone", r"\b(?:\+?61|0)[2-478](?:[\s-]?\d){8}\b", False),
    ("accountNumber", r"\b(?:ACC|ACCT|Account|A\/C)[#:\s-]*(\d{6,12})\b", True),
    ("clientNumber", r"\b(?:Client|Customer|Cust|Member)[#:\s-]*(?:No|Number|Num|ID)[#:\s-]*(\d{4,12})\b", True),
    ("referenceNumber", r"\b(?:Ref|Reference|Invoice)[#:\s-]*(?:No|Number|Num)?[#:\s-]*([A-Z0-9]{6,15})\b", True),
    ("policyNumber", r"\b(?:Policy|POL)[#:\s-]*(?:No|Number)?[#:\s-]*([A-Z0-9]{6,15})\b", True),
    ("transactionID", r"\b(?:TXN|Transaction|Trans)[#:\s-]*(?:ID|No|Number)?[#:\s-]*([A-Z0-9]{8,20})\b", True),
    ("nmi", r"\b[A-Z0-9]{10,11}\b", False),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b", False),
    ("swift", r"\b[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\b", False),
    ("routingNumber", r"\b\d{9}\b", False),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", False),
    ("ipv6", r"\b(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}\b", True),
    ("address", r"\b\d+\s+(?:[A-Z][a-z]+\s*){1,4}(?:STREET|ST|ROAD|RD|AVENUE|AVE|LANE|LN|DRIVE|DR|BUILDING|UNIT|SUITE|APT)\b", True),
)

# Prior probability by type; every other type has DEFAULT_PRIOR.
PRIORS: dict[str, float] = {
    "email": 0.85, "creditCard": 0.90, "creditCardVisa": 0.90, "creditCardMastercard": 0.90, "creditCardAmex": 0.90,
    "creditCardGeneric": 0.90, "australianMedicare": 0.95, "ssn": 0.90, "iban": 0.92, "australianTFN": 0.85,
    "australianABN": 0.85, "phone": 0.70, "australianPhone": 0.70, "australianBSB": 0.80, "australianAccountNumber": 0.75,
    "passportNumber": 0.70, "driversLicense": 0.70, "nationalID": 0.70, "accountNumber": 0.70, "address": 0.65, "nmi": 0.75,
    "swift": 0.80, "referenceNumber": 0.40, "transactionID": 0.45, "policyNumber": 0.50, "dateOfBirth": 0.60,
    "clientNumber": 0.55, "ipAddress": 0.50, "ipv4": 0.50, "ipv6": 0.50, "routingNumber": 0.55,
}
DEFAULT_PRIOR = 0.5

# The configuration key that switches a type, where it isn't the type itself.
GATES: dict[str, str] = {
    "creditCardVisa": "creditCard", "creditCardMastercard": "creditCard", "creditCardAmex": "creditCard",
    "creditCardGeneric": "creditCard", "australianPassport": "passportNumber", "usPassport": "passportNumber",
    "ukPassport": "passportNumber", "euPassport": "passportNumber", "australianDriversLicense": "driversLicense",
    "usDriversLicense": "driversLicense", "ukDriversLicense": "driversLicense", "ukNationalInsurance": "nationalID",
    "australianAccountNumber": "accountNumber", "australianPhone": "phone", "ipv4": "ipAddress", "ipv6": "ipAddress",
}

# Types that need a higher threshold, and types whose digits may run in sequence.
HIGH_RISK = ("referenceNumber", "transactionID", "policyNumber", "clientNumber")
SEQUENCES_ALLOWED = ("australianBSB", "routingNumber", "swift", "iban", "nmi", "referenceNumber", "transactionID", "policyNumber", "clientNumber", "accountNumber")

# Words that raise or lower confidence, words of birth fields, words of business dates.
POSITIVE_WORDS = ("user", "customer", "client", "member", "contact", "personal", "private")
NEGATIVE_WORDS = ("example", "sample", "test", "demo", "dummy", "placeholder")
FIELD_WORDS = ("email", "phone", "ssn", "account", "card", "passport", "license")
BIRTH_WORDS = ("birth", "dob", "dateofbirth", "born", "bday", "birthday")
BUSINESS_DATE_WORDS = (
    "eligible", "service", "start", "end", "expiry", "expire", "effective", "transaction", "created", "modified", "updated",
    "deleted", "issued", "commence", "completion", "payment", "settlement", "process", "registration", "enrollment", "join",
    "leave", "termination", "cancellation", "renewal", "anniversary", "due", "maturity", "valuation", "assessment", "review",
    "audit", "report", "statement", "financial", "debit", "lapse", "premium", "reinstate", "pay",
)

# The mask function of each type; every other type has the generic one.
MASKS: dict[str, str] = {
    "email": "email", "phone": "phone", "australianPhone": "phone", "ssn": "ssn", "dateOfBirth": "dob",
    "passportNumber": "passport", "driversLicense": "license", "nationalID": "national_id", "australianPassport": "passport",
    "australianDriversLicense": "license", "usPassport": "passport", "usDriversLicense": "license", "ukPassport": "passport",
    "ukDriversLicense": "license", "ukNationalInsurance": "national_id", "euPassport": "passport", "creditCardVisa": "card",
    "creditCardMastercard": "card", "creditCardAmex": "card", "creditCardGeneric": "card", "accountNumber": "account",
    "australianAccountNumber": "account", "ipv4": "ip", "ipv6": "ip", "address": "address", "australianBSB": "bsb",
    "australianTFN": "tfn", "australianABN": "abn", "clientNumber": "account",
}

# Column-name categories in order, each with the words that reveal it (compared without blanks, _ and -).
COLUMN_CATEGORIES: dict[str, tuple[str, ...]] = {
    "email": ("email", "e-mail", "emailaddress", "mail", "email_address"),
    "address": ("address", "street", "streetaddress", "addr", "suburb", "city", "postcode", "postal", "zip"),
    "name": ("name", "firstname", "lastname", "fullname", "addressee", "salutation"),
    "phone": ("phone", "mobile", "telephone", "phonenumber", "tel"),
    "dateOfBirth": ("dob", "dateofbirth", "date of birth", "birthdate", "birth date", "birthday", "dateborn"),
    "passport": ("passport", "passportno", "passportnumber", "passport number", "passport no", "passportid"),
    "driversLicense": ("driverslicense", "drivers license", "driverlicense", "driver license", "driverlicence", "drivers licence", "dl", "dlno", "licenceno", "licenseno", "licence number", "license number"),
    "nationalID": ("nationalid", "national id", "identitycard", "identity card", "idcard", "id card", "idnumber", "id number", "identitynumber", "identity number", "citizenid"),
    "bsb": ("bsb", "bank state branch", "bankstatebranch", "sortcode", "sort code"),
    "accountNumber": ("account", "accountno", "accountnumber", "acctno", "accno", "bankaccount", "bank account", "a/c", "acc"),
    "clientNumber": ("client", "clientno", "clientnumber", "clientid", "customer", "customerno", "customernumber", "customerid", "custno", "member", "memberno", "membernumber", "memberid", "consumerno", "consumer_number"),
    "creditCard": ("creditcard", "credit card", "cardno", "cardnumber", "cc", "ccnumber", "pan", "card"),
    "tfn": ("tfn", "taxfile", "taxfilenumber", "tax file number"),
    "abn": ("abn", "australianbusinessnumber", "business number", "abn number"),
    "reference": ("reference", "refno", "referenceno", "referencenumber", "invoice", "invoiceno", "invoicenumber"),
    "policy": ("policy", "policyno", "policynumber", "policy number"),
    "transaction": ("transaction", "transactionid", "txn", "txnid", "transno", "trans id", "transaction number"),
    "iban": ("iban", "international account", "internationalaccountnumber"),
    "swift": ("swift", "swiftcode", "bic", "biccode", "swift code", "bic code"),
    "routing": ("routing", "routingnumber", "aba", "abanumber", "routing number"),
    "identifier": ("nmi", "id", "identifier", "customer_id", "user_id", "uuid", "mirn"),
}

# The type a category stands for; categories not listed stand for "custom".
CATEGORY_TYPES: dict[str, str] = {
    "email": "email", "phone": "phone", "address": "address", "dateOfBirth": "dateOfBirth", "passport": "passportNumber",
    "driversLicense": "driversLicense", "nationalID": "nationalID", "bsb": "australianBSB", "accountNumber": "accountNumber",
    "clientNumber": "clientNumber", "creditCard": "creditCardGeneric", "tfn": "australianTFN", "abn": "australianABN",
    "reference": "referenceNumber", "policy": "policyNumber", "transaction": "transactionID", "iban": "iban", "swift": "swift",
    "routing": "routingNumber", "identifier": "accountNumber",
}

#: Conditions on a text t (and its lower case, low) that hold wherever the pattern matches and are cheaper than it.
_HINTS = {
    "email": "instr(t, '@') > 0",
    "australianDriversLicense": "instr(low, 'lic') > 0",
    "usDriversLicense": "instr(low, 'dl') > 0 or instr(low, 'license') > 0",
    "euPassport": "t rlike '[A-Z0-9]{8}'",
    "passportNumber": "instr(low, 'pass') > 0",
    "nationalID": "instr(low, 'id') > 0 or instr(low, 'national') > 0",
    "driversLicense": "instr(low, 'dl') > 0 or instr(low, 'driver') > 0 or instr(low, 'licen') > 0",
    "referenceNumber": "instr(low, 'ref') > 0 or instr(low, 'invoice') > 0",
    "policyNumber": "instr(low, 'pol') > 0",
    "transactionID": "instr(low, 't') > 0 and (instr(low, 'txn') > 0 or instr(low, 'trans') > 0)",
    "nmi": "t rlike '[A-Z0-9]{10}'",
    "swift": "t rlike '[A-Z]{6}'",
    "ipv6": "t rlike '[A-Fa-f0-9]:[A-Fa-f0-9]'",
}
_NEEDS_DIGIT = {
    "phone", "ssn", "dateOfBirth", "australianPassport", "usPassport", "ukPassport", "ukDriversLicense", "ukNationalInsurance",
    "australianBSB", "australianAccountNumber", "creditCardVisa", "creditCardMastercard", "creditCardAmex", "creditCardGeneric",
    "australianTFN", "australianABN", "australianMedicare", "australianPhone", "accountNumber", "clientNumber", "iban",
    "routingNumber", "ipv4", "address",
}
#: Patterns that may begin or end with something else than a word character.
_OPEN_START, _OPEN_END = ("email", "phone", "australianPhone"), ("email",)

_BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def java_regex(source: str, ignore_case: bool = False) -> str:
    """The JavaScript pattern for java.util.regex: ASCII word boundaries, [ escaped within a class."""
    out, in_class, i = [], False, 0
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            if source[i + 1] == "b" and not in_class:
                out.append(_BOUNDARY)
            else:
                out.append(source[i : i + 2])
            i += 2
            continue
        if in_class and c == "[":
            out.append("\\")
        elif c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def re2_regex(source: str, ignore_case: bool = False) -> str:
    """The pattern for RE2, whose \\b is ASCII already."""
    return ("(?i)" if ignore_case else "") + source.replace(r"\/", "/")


@dataclass(frozen=True)
class Detector:
    type: str
    source: str
    ignore_case: bool
    priority: int

    @property
    def java(self) -> str:
        """With the boundaries before and after a word character as plain look-arounds, where the pattern is known."""
        source, known = self.source, self.type in {t for t, _, _ in PATTERNS}
        before = known and self.type not in _OPEN_START
        after = known and self.type not in _OPEN_END
        inner = java_regex(source[2 if before else 0 : -2 if after else None])
        return ("(?i)" if self.ignore_case else "") + ("(?<![0-9A-Za-z_])" if before else "") + inner + ("(?![0-9A-Za-z_])" if after else "")

    @property
    def re2(self) -> str:
        return re2_regex(self.source, self.ignore_case)

    @property
    def gate(self) -> str:
        return GATES.get(self.type, self.type)

    @property
    def prior(self) -> float:
        return PRIORS.get(self.type, DEFAULT_PRIOR)

    @property
    def mask(self) -> str:
        return MASKS.get(self.type, "generic")

    def hint(self, t: str, low: str | None = None, digit: str | None = None) -> str:
        """SQL that is true of every text with a match; empty if there is nothing cheaper than the pattern.

        low, digit: columns with the text in lower case and whether it has a digit, where they are there already.
        """
        if self.type in _NEEDS_DIGIT:
            return digit or f"{t} rlike '[0-9]'"
        condition = _HINTS.get(self.type, "")
        return condition.replace("(t,", f"({t},").replace("t rlike", f"{t} rlike").replace("(low,", f"({low or f'lower({t})'},")


class Registry:
    """The detectors in claim order; further ones may be registered."""

    def __init__(self):
        self._all = {t: Detector(t, s, i, k) for k, (t, s, i) in enumerate(PATTERNS)}

    def get(self, type_: str) -> Detector | None:
        return self._all.get(type_)

    def has(self, type_: str) -> bool:
        return type_ in self._all

    def types(self) -> list[str]:
        return list(self._all)

    def enabled(self, types: dict[str, bool]) -> list[Detector]:
        """By the general key, as the main pass does."""
        return [d for d in self._all.values() if types.get(d.gate)]

    def not_disabled(self, types: dict[str, bool]) -> list[Detector]:
        """By each type's own key, as the CDATA pass does."""
        return [d for d in self._all.values() if types.get(d.type) is not False]

    def register(self, type_: str, source: str, ignore_case: bool = False) -> None:
        self._all[type_] = Detector(type_, source, ignore_case, len(self._all))


REGISTRY = Registry()


def normalized_name(name: str) -> str:
    return "".join(c for c in name.lower() if not (c in "_-" or c.isspace()))


def column_type(name: str) -> str:
    """The type a column or field name stands for; "custom" if none."""
    known = normalized_name(name)
    for category, words in COLUMN_CATEGORIES.items():
        if any(normalized_name(w) in known for w in words):
            return "nmi" if category == "identifier" and "nmi" in known else CATEGORY_TYPES.get(category, "custom")
    return "custom"


def is_sensitive_column(name: str, config) -> bool:
    """Deny list first; a non-empty allow list decides alone; then the categories not switched off."""
    known, types = normalized_name(name), config.effective_types()
    if any(normalized_name(p) in known for p in config.deny_list):
        return True
    if config.allow_list:
        return not any(normalized_name(p) in known for p in config.allow_list)
    return any(normalized_name(w) in known for c, words in COLUMN_CATEGORIES.items() if types.get(c) is not False for w in words)
