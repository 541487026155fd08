"""Configuration records of the masking and rendering operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Which types are on by default.
DEFAULT_TYPES: dict[str, bool] = {
    "email": True, "phone": True, "ssn": True, "dateOfBirth": True, "passportNumber": True, "driversLicense": True,
    "nationalID": True, "creditCard": True, "creditCardVisa": True, "creditCardMastercard": True, "creditCardAmex": True,
    "creditCardGeneric": True, "address": True, "accountNumber": True, "ipAddress": False, "ipv4": False, "ipv6": False,
    "nmi": True, "australianBSB": True, "australianTFN": True, "australianABN": True, "australianMedicare": True,
    "australianPhone": True, "australianAccountNumber": True, "australianPassport": True, "australianDriversLicense": True,
    "usPassport": True, "usDriversLicense": True, "ukPassport": True, "ukDriversLicense": True, "ukNationalInsurance": True,
    "euPassport": True, "clientNumber": True, "referenceNumber": False, "policyNumber": False, "transactionID": False,
    "iban": True, "swift": True, "routingNumber": False, "custom": False,
}

# The types each preset turns on; every other type is off under it.
PRESETS: dict[str, tuple[str, ...]] = {
    "default": ("email", "phone", "creditCard", "ssn", "dateOfBirth", "passportNumber", "driversLicense", "nationalID", "address"),
    "privacy": ("email", "phone", "creditCard", "ssn", "dateOfBirth", "passportNumber", "driversLicense", "nationalID", "address", "ipAddress", "iban", "swift", "accountNumber"),
    "strict": ("email", "phone", "creditCard", "ssn", "dateOfBirth", "passportNumber", "driversLicense", "nationalID", "address", "ipAddress", "iban", "swift", "accountNumber", "custom"),
}

STRATEGIES = ("partial", "full", "structural", "hash", "redact")
MODES = ("auto", "manual", "strict")
OUTPUT_MODES = ("minimal", "smart", "table", "detailed")


@dataclass(frozen=True)
class CustomPattern:
    name: str
    pattern: str
    replacement: str
    enabled: bool = True


@dataclass(frozen=True)
class MaskingConfig:
    """What to mask and how; ``types`` overrides DEFAULT_TYPES key by key."""

    enabled: bool = True
    mode: str = "auto"
    strategy: str = "partial"
    preset: str = "none"
    deny_list: tuple[str, ...] = ()
    allow_list: tuple[str, ...] = ()
    types: dict[str, bool] = field(default_factory=dict)
    confidence_threshold: float = 0.7
    custom_patterns: tuple[CustomPattern, ...] = ()
    include_stats: bool = False
    show_indicator: bool = True
    #: The date that stands for today in age checks (YYYY-MM-DD); None: the session's current date.
    as_of: str | None = None
    #: True: the texts are what a CDATA section holds, so plain surroundings count as xml.
    inside_cdata: bool = False
    #: True restores the original's behaviour of returning dates of birth unmasked under hash and redact.
    strict_compat: bool = False

    def effective_types(self) -> dict[str, bool]:
        merged = {**DEFAULT_TYPES, **self.types}
        chosen = PRESETS.get(self.preset)
        return merged if chosen is None else {k: k in chosen for k in merged}

    def with_types(self, **types: bool) -> MaskingConfig:
        return replace(self, types={**self.types, **types})

    def today(self) -> str:
        return f"date'{self.as_of}'" if self.as_of else "current_date()"


@dataclass(frozen=True)
class RenderConfig:
    show_line_numbers: bool = True
    line_number_padding: bool = False
    show_context_path: bool = True
    output_mode: str = "minimal"
    table_max_rows: int = 20
    table_max_columns: int = 10
    align_numbers: str = "right"
    xml_indexing: str = "local"
    large_line_threshold: int = 2000
    large_char_threshold: int = 5_000_000


def next_output_mode(mode: str) -> str:
    """The mode after this one, around the circle; an unknown mode counts as before the first."""
    at = OUTPUT_MODES.index(mode) if mode in OUTPUT_MODES else -1
    return OUTPUT_MODES[(at + 1) % len(OUTPUT_MODES)]
