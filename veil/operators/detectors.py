"""The detectors: built-in ones, spans that veto them, the catalogue, and users' own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import text as T
from ..functions import validators as V
from ..functions.dialect import B, portable, whole, with_flags

YEAR = 2025


@dataclass(frozen=True)
class Detector:
    """A pattern with the strength of its evidence; ``validate`` makes SQL of SQL and may ask for as_of_year."""

    id: str
    name: str
    strength: str
    pattern: str
    kinds: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    gated: bool = False
    validate: Callable[..., str] | None = None
    dated: bool = False
    catalog: bool = False
    user: bool = False
    synonyms: tuple[str, ...] = field(default=(), compare=False)
    #: A text without which there is no match.
    need: str | None = None

    def valid(self, match: str, as_of_year: int) -> str:
        """SQL: does a match (SQL of it) hold?"""
        if self.validate is None:
            return "true"
        return f"coalesce({self.validate(match, as_of_year) if self.dated else self.validate(match)}, false)"

    @property
    def naming(self) -> str | None:
        """What stands in a normalised label that names what the detector looks for."""
        return T.kind_pattern(list(self.kinds)) if self.kinds else T.phrase_pattern(list(self.labels))

    @property
    def shown_id(self) -> str:
        return f"catalog:{self.id}" if self.catalog else self.id

    @property
    def asked(self) -> bool:
        """Switched on by a user, so not vetoed by look-alikes."""
        return self.catalog or self.user


# The patterns, kinds and strengths of the built-in detectors and of what vetoes them.
_DATE = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
_SPACED_ID = r"[0-9]{2}([- –])[0-9]{2}\1[0-9]{4}"
_PHONE = whole(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_ZIP4 = whole("[0-9]{5}-[0-9]{4}")

BUILTIN = (
    Detector("ssn", "SSN", "high", whole("[0-9]" + _SPACED_ID), ("ssn",), validate=V.valid_ssn),
    Detector("itin", "ITIN", "high", whole("9" + _SPACED_ID), ("ssn", "ein"), validate=V.valid_itin),
    Detector("ssn-raw", "SSN", "low", whole("[0-9]{9}"), ("ssn",), gated=True, validate=lambda s: f"({V.valid_ssn(s)} or {V.valid_itin(s)})"),
    Detector("ein", "EIN", "medium", whole("[0-9]{2}-[0-9]{7}"), ("ein",), validate=V.valid_ein),
    Detector("routing", "Routing", "medium", whole("[0-9]{9}"), ("routing",), validate=V.valid_aba),
    Detector("account", "Account", "low", whole("[A-Za-z0-9]{8,17}"), ("account", "id"), gated=True, validate=V.valid_account),
    Detector("iban", "IBAN", "high", whole("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"), ("account",), validate=V.valid_iban),
    Detector("card", "Card", "high", whole("[0-9](?:[ -]?[0-9]){12,18}"), ("card",), validate=V.valid_card),
    Detector("dob", "Birth date", "low", rf"(?<![A-Za-z0-9_/.-]){_DATE}(?![A-Za-z0-9_/.-])", ("dob",), gated=True, validate=V.valid_dob, dated=True),
    Detector(
        "maskedLast4", "Last 4", "medium",
        r"(?<![A-Za-z0-9_*•-])(?:[*•xX]{3}[- ]?[*•xX]{2}[- ]?|[*•xX]{4,12}[- ]?)[0-9]{4}(?![A-Za-z0-9_-])", ("ssn", "account", "card"),
    ),
)
HIGH_IDS = ("ssn", "itin", "card", "iban", "maskedLast4")

#: Spans that are something else. The last does not veto an IBAN.
NEGATIVES = {
    "phone": _PHONE,
    "zip4": _ZIP4,
    "date": whole("[0-9]{1,2}[-.][0-9]{1,2}[-.][0-9]{2,4}|[0-9]{4}[-.][0-9]{1,2}[-.][0-9]{1,2}"),
    "uuid": "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "hex": whole("(?:0x)?(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}"),
}
EXEMPT = {"hex": ("iban",)}

# Label words and street types, as users of these formats write them.
_DL = ("dl", "dl number", "driver license", "drivers license", "driver licence", "drivers licence", "driving licence", "license number", "licence number", "license no", "lic")
_STREETS = "St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court|Way|Pl|Place|Ter|Terrace|Pkwy|Parkway|Cir|Circle|Hwy|Highway|Sq|Square|Trl|Trail"
_MONTH = f"(?:{V.MONTHS.replace(' ', '|')})[a-z]*"
_LICENCES = {
    "ca": ("california", "[A-Z][0-9]{7}"),
    "tx": ("texas", "[0-9]{8}"),
    "fl": ("florida", "[A-Z](?:[0-9]{12}|[0-9]{3}-[0-9]{3}-[0-9]{2}-[0-9]{3}-[0-9])"),
    "ny": ("new york", "[0-9]{3} ?[0-9]{3} ?[0-9]{3}"),
    "pa": ("pennsylvania", "[0-9]{2} ?[0-9]{3} ?[0-9]{3}"),
    "il": ("illinois", "[A-Z](?:[0-9]{11}|[0-9]{3}-[0-9]{4}-[0-9]{4})"),
    "oh": ("ohio", "[A-Z]{2}[0-9]{6}"),
    "ga": ("georgia", "[0-9]{7,9}"),
    "nc": ("north carolina", "[0-9]{6,12}"),
    "mi": ("michigan", "[A-Z](?: ?[0-9]{3}){4}"),
}


def _entry(id: str, name: str, strength: str, pattern: str, labels: tuple, also: str, validate=None, dated: bool = False, need: str | None = None) -> Detector:
    """A search finds an entry by its labels, its name and what it is ``also`` called, phrases set apart by commas."""
    return Detector(id, name, strength, pattern, labels=labels, gated=strength == "low", validate=validate, dated=dated, catalog=True, synonyms=(*labels, *also.split(", ")), need=need)


# The patterns, strengths and labels of the catalogue.
CATALOG = (
    _entry("phone-us", "American telephone number", "medium", _PHONE, ("phone", "tel", "telephone", "mobile", "cell", "fax", "contact"), "call, handset, landline", V.valid_phone_us),
    _entry(
        "phone-intl", "Telephone number with a country code", "medium", r"(?<![A-Za-z0-9_+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![A-Za-z0-9_-])",
        ("phone", "tel", "telephone", "mobile", "cell", "whatsapp"), "foreign call, overseas, roaming", V.digits_between(8, 15),
    ),
    _entry(
        "email", "Mail address on the internet", "high", r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9_-])",
        ("email", "e mail"), "inbox, mailbox, correspondent", need="@",
    ),
    _entry(
        "dob-any", "Birth date in words or any order", "low",
        r"(?i)(?<![A-Za-z0-9_/.-])(?:[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:[0-9]{4}|[0-9]{2})|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|" + _MONTH + r"\.? [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} " + _MONTH + r"\.? [0-9]{4})(?![A-Za-z0-9_/-])",
        ("date of birth", "dob", "birth date", "birthdate", "birthday", "born", "bday"), "age, nativity, year of life", V.valid_birth_date, True,
    ),
    _entry(
        "address-us", "House and street in America", "low",
        r"(?<![A-Za-z0-9_-])[0-9]{1,6} (?:[NSEW]\.? )?[A-Z][a-z]+(?: [A-Z][a-z]+){0,3} (?:" + _STREETS + ")" + B + r"\.?(?:,? (?:Apt|Suite|Ste|Unit|#) ?[A-Za-z0-9-]{1,6})?",
        ("address", "street", "home address", "mailing address", "residence", "residential address"), "home, house, where someone lives, delivery place",
    ),
    _entry("zip4", "Nine-digit delivery code", "medium", _ZIP4, ("zip", "zip code", "postal", "postcode"), "post office, mail route"),
    _entry("passport-us", "American passport", "low", whole("[A-Z][0-9]{8}|[0-9]{9}"), ("passport", "passport number", "passport no"), "border, travel, visa page"),
    *(_entry(f"dl-{s}", "Permit to drive", "low", whole(p), _DL, f"motorist, driving permit, {n}, {s}") for s, (n, p) in _LICENCES.items()),
    _entry(
        "insurance", "Numbers of an insured person", "low", "(?i)" + whole("[A-Z0-9][A-Z0-9-]{4,18}[A-Z0-9]"),
        ("policy", "policy number", "group number", "group id", "member id", "member number", "subscriber id", "subscriber number", "insurance", "plan id", "certificate number"),
        "cover, insured, underwriter, premium", V.digits_between(3),
    ),
    _entry(
        "mrn", "Number of a patient's file", "low", whole("[A-Z]{0,3}[0-9]{6,10}"),
        ("mrn", "medical record", "medical record number", "patient id", "patient number", "chart number"), "hospital, clinic, doctor",
    ),
    _entry(
        "case", "Numbers of proceedings", "low", "(?i)" + whole("[A-Z0-9][A-Z0-9:/.-]{3,22}[A-Z0-9]"),
        ("case", "case number", "case no", "claim", "claim number", "claim no", "docket", "docket number", "file number"), "lawsuit, tribunal, adjuster", V.digits_between(3),
    ),
    _entry("vin", "Chassis number", "high", "(?i)" + whole("[A-HJ-NPR-Z0-9]{17}"), ("vin", "vehicle identification number", "vehicle"), "automobile, truck, motor", V.valid_vin),
)

#: Catalogue entries that switch built-in detectors: a name, the detectors, and what people look for; all on by default.
BUILTIN_ENTRIES = {
    "ssn": ("Social security and taxpayer numbers", ("ssn", "itin", "ssn-raw"), ("ssn", "itin", "pension", "taxes")),
    "ein": ("Employer numbers", ("ein",), ("ein", "company", "firm taxes")),
    "bank": ("Accounts at a bank", ("routing", "account", "iban"), ("iban", "routing", "deposit", "transfer", "wire")),
    "card": ("Payment card numbers", ("card",), ("plastic", "issuer", "checkout")),
    "dob": ("Birth date by month, day and year", ("dob",), ("dob", "age")),
    "masked": ("What is left of a masked number", ("maskedLast4",), ("ending", "tail of a number")),
}


def custom(id: str, name: str, regex: str, flags: str | None, labels: list[str], strength: str) -> Detector:
    """A user's detector; low ones need a label."""
    return Detector(f"custom:{id}", name, strength, with_flags(portable(regex), flags), labels=tuple(labels), gated=strength == "low", user=True)


def builtin_off(toggles: dict[str, bool]) -> set[str]:
    """Built-in detectors that toggles switch off."""
    return {d for entry, (_, ids, _) in BUILTIN_ENTRIES.items() if toggles.get(entry, True) is False for d in ids}


def catalog_on(toggles: dict[str, bool]) -> list[Detector]:
    """Catalogue detectors that toggles switch on; they are off by default."""
    return [d for d in CATALOG if toggles.get(d.id, False) is True]
