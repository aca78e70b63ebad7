"""Word lists, tokens, symbol folds and detection patterns.

Everything in this module is data that decides what counts as an identifier.
The values have to stay exactly as they are for results to be comparable, so
they are written out plainly, in their natural order, in one place.

Patterns are in the portable part of the Java dialect; ``rules.py`` puts the
flags in front.  Two habits keep them linear on the backtracking matcher that
Spark uses, without changing what they match:

* ``++``, ``*+`` and ``?+`` (possessive) wherever the next item cannot start
  with a character the repetition could give back;
* ``(?=[...])`` in front of ``\\b``, naming the only possible first characters,
  because a class lookup is far cheaper than a Unicode word-boundary test.
"""

from __future__ import annotations

# --- fixed values: replacement tokens, keyed by category ---------------------

TOKENS = {
    "email": "[EMAIL]",
    "phone": "[PHONE]",
    "date": "[DATE]",
    "relative-date": "[REL_DATE]",
    "ssn": "[SSN]",
    "mrn": "[MRN]",
    "address": "[ADDRESS]",
    "person": "[PERSON]",
    "facility": "[FACILITY]",
    "zip": "[ZIP]",
    "coordinate": "[COORD]",
    "url": "[URL]",
    "insurance": "[INSURANCE]",
    "license": "[LICENSE]",
    "vehicle": "[VEHICLE]",
    "device": "[DEVICE]",
    "ip": "[IP]",
}

# --- fixed values: counter fields in output order, and their category ---------

COUNT_FIELDS = {
    "emails": "email",
    "phones": "phone",
    "dates": "date",
    "relative_dates": "relative-date",
    "ssn": "ssn",
    "mrn": "mrn",
    "zip_codes": "zip",
    "persons": "person",
    "facilities": "facility",
    "addresses": "address",
    "coordinates": "coordinate",
    "urls": "url",
    "insurance_ids": "insurance",
    "licenses": "license",
    "vehicles": "vehicle",
    "devices": "device",
    "ip_addresses": "ip",
}

# --- fixed values: report labels in report order (relative dates come last) ---

REPORT_LABELS = {
    "emails": "emails",
    "phones": "phones",
    "dates": "dates",
    "ssn": "ssn",
    "mrn": "mrn",
    "zip_codes": "zip codes",
    "persons": "persons",
    "facilities": "facilities",
    "addresses": "addresses",
    "coordinates": "coordinates",
    "urls": "urls",
    "insurance_ids": "insurance",
    "licenses": "licenses",
    "vehicles": "vehicles",
    "devices": "devices",
    "ip_addresses": "ip addresses",
    "relative_dates": "relative dates",
}

# --- fixed values: categories that only the strict (safe-harbor) mode looks for

SAFE_HARBOR_ONLY = ("url", "insurance", "license", "vehicle", "device", "ip")

# --- fixed values: default length range of a bare record number --------------

MRN_MIN_LENGTH = 6
MRN_MAX_LENGTH = 10

# --- fixed values: surnames ---------------------------------------------------

SURNAMES = (
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller",
    "Davis", "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez",
    "Wilson", "Anderson", "Thomas", "Taylor", "Moore", "Jackson", "Martin",
    "Lee", "Perez", "Thompson", "White", "Harris", "Sanchez", "Clark",
    "Ramirez", "Lewis", "Robinson", "Walker", "Young", "Allen", "King",
    "Wright", "Scott", "Torres", "Nguyen", "Hill", "Flores", "Green", "Adams",
    "Nelson", "Baker", "Hall", "Rivera", "Campbell", "Mitchell", "Carter",
    "Roberts", "Gomez", "Phillips", "Turner", "Parker", "Evans", "Edwards",
    "Collins", "Stewart", "Morris", "Murphy", "Cook", "Rogers",
    "Morgan", "Patel", "Singh", "Khan", "Ali", "Mohammed", "Mohammad",
    "Abdullah", "Hussain", "Kim", "Park", "Chen", "Wang", "Zhang", "Lin",
    "Tran", "Ng", "Chaudhry", "Ahmad", "Iqbal", "Rahman",
)

# --- fixed values: first names ------------------------------------------------

FIRST_NAMES = (
    "James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael",
    "Linda", "William", "Elizabeth", "David", "Barbara", "Richard", "Susan",
    "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Christopher",
    "Nancy", "Daniel", "Lisa", "Matthew", "Betty", "Anthony", "Margaret",
    "Mark", "Sandra", "Donald", "Ashley", "Steven", "Kimberly", "Paul",
    "Emily", "Andrew", "Donna", "Joshua", "Michelle", "Kenneth", "Dorothy",
    "Kevin", "Carol", "Brian", "Amanda", "George", "Melissa", "Timothy",
    "Deborah", "Ronald", "Stephanie", "Edward", "Rebecca", "Jason", "Sharon",
    "Jeffrey", "Laura", "Ryan", "Cynthia", "Jacob", "Kathleen", "Gary", "Amy",
    "Nicholas", "Shirley", "Eric", "Angela", "Jonathan", "Helen", "Stephen",
    "Anna", "Larry", "Brenda", "Justin", "Pamela", "Scott", "Nicole",
    "Brandon", "Samantha", "Frank", "Katherine", "Benjamin", "Emma",
    "Gregory", "Ruth", "Samuel", "Christine", "Patrick", "Catherine",
    "Alexander", "Debra", "Jack", "Rachel", "Dennis", "Carolyn", "Jerry",
    "Janet", "Tyler", "Maria", "Mohammed", "Muhammad", "Ahmed", "Ahmad",
    "Omar", "Hassan", "Hussein", "Abdullah", "Fatima", "Aisha", "Amelia",
    "Priya", "Anjali", "Sofia", "Noor", "Amina", "Li", "Wei", "Min", "Hao",
    "Jin", "Sang", "Hye", "Yuki", "Mei", "Ravi", "Imran", "Farah", "Leila",
    "Zara",
)

# --- fixed values: titles; the short ones also with a full stop ---------------

SHORT_TITLES = (
    "Dr", "Drs", "Prof", "Mr", "Mrs", "Ms", "Mx", "Capt", "Lt", "Sgt", "Rev",
    "Fr",
)

LONG_TITLES = (
    "Captain", "Lieutenant", "Sergeant", "Officer", "Chief", "Judge", "Sir",
    "Dame", "Madam", "Reverend", "Father", "Sister", "Brother", "Pastor",
    "Chaplain", "Rabbi", "Imam",
)

# --- fixed values: facility terms ---------------------------------------------

FACILITY_TERMS = (
    "General Hospital", "Medical Center", "Children's Hospital",
    "Urgent Care", "Cardiology Clinic", "Dialysis Center", "Health System",
    "Cancer Institute", "Family Practice", "Primary Care",
    "Internal Medicine",
)

# --- fixed values: clinical terms that are never a person ---------------------

STOP_TERMS = (
    "CKD", "ESBL", "ICU", "BKA", "IDDM", "MRSA", "ASTHMA", "DIALYSIS",
    "MEROPENEM", "SEPSIS", "HYPERTENSION", "DIABETES", "E COLI", "E. COLI",
    "HGB", "HCT", "POC", "IV",
)

# --- fixed values: symbols folded to a plain character ------------------------

SYMBOL_FOLDS = {
    "'": "‘’‛′",
    '"': "“”″",
    "-": "–—−",
    " ": "•·‧⁃・",
}

# --- fixed values: detection patterns -----------------------------------------

EMAIL = (
    # an earlier start in the same unbroken run has already failed, so a later
    # one is only tried right after a match
    r"\b(?>(?<![\w.+%-])|\G|(?<!\w[.+%-]{0,1000}))"
    r"[\w.+%-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
)

EMAIL_OBFUSCATED = (
    r"\b(?>(?<![\w.+-])|\G|(?<!\w[.+-]{0,1000}))"
    r"[\w.+-]++(?:\s++at\s++|\s*+@\s*+)[\w.-]++"
    # one round = the labels up to and including the next one with a word
    # character in it; the match ends at the last such character
    r"(?:[.-]*+(?:\s++dot\s++[.-]++(?!\w))*+\s++dot\s++(?:[.-]*+\w++)++)++"
)

URL = r"(?=[HW])\b(?:https?://|www\.)\S++"

PHONE = (
    r"(?=[+(\d])\b(?:\+?1[-.\s•·]?)?(?:\(?\d{3}\)?|\d{3})[-.\s•·]?"
    r"\d{3}[-.\s•·]?\d{4}(?:\s*+(?:x|ext\.?|extension)\s*+\d{1,6})?\b"
)

SSN = r"(?=[\dx])\b(?:\d{3}-\d{2}-\d{4}|xxx-xx-\d{4})\b"

MRN_LABEL = (
    r"(?=[MAPC])\b(?:MRN|Acct|Account|Patient\s*+ID|Chart)"
    r"\s*+(?:[:#]\s*+)?+(?:-\s*+)?[A-Za-z0-9-]{4,}\b"
)

MRN_DIGITS = r"(?=\d)\b\d{%d,%d}\b"

ZIP = r"(?=\d)\b\d{5}(?:-\d{4})?\b"

FACILITY_PATTERN = (
    r"(?=[SMUCG])\b(?:St\.|Saint|Mt\.|Mount|Univ\.|University|Memorial"
    r"|Children'?s|General|County)\s++"
    r"[A-Z][\p{L}\p{M}\p{N}’'.-]+(?:\s++[A-Z][\p{L}\p{M}\p{N}’'.-]+){0,4}"
    r"(?:\s++(?:Hospital|Med(?:ical)?\s*+Center|Clinic|Health(?:care)?"
    r"|Infirmary))?\b"
)

ADDRESS = (
    r"(?=\d)\b\d{1,6}\s++(?:[NSEW]\.?\s++)?"
    r"(?:\d++(?:st|nd|rd|th)|[A-Z][\w.-]*+)"
    r"(?:\s++(?:\d++(?:st|nd|rd|th)|[A-Z][\w.-]*+)){0,3}"
    r"\s++(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Drive|Dr\.?|Boulevard"
    r"|Blvd\.?|Lane|Ln\.?|Court|Ct\.?|Place|Pl\.?|Terrace|Ter\.?|Way)"
    r"(?:\s*+(?:,\s*+)?+(?:Apt|Apartment|Unit|Suite|Ste\.?|#)\s*+[-A-Z0-9]+)?"
)

LOCATION = (
    r"(?=[SRUAOB])\b(?:Suite|Ste\.?|Room|Rm\.?|Unit|Apt|Apartment|OR|Bed|Bay)"
    r"\s*+(?:-\s*+)?+#?\d[0-9A-Z-]{0,5}"
)

COORDINATE = (
    r"(?=[-\d])\b-?\d{1,3}\.\d++\s*+(?:[°º]\s*+)?+[NS]\b[,;\s]*+"
    r"-?\d{1,3}\.\d++\s*+(?:[°º]\s*+)?+[EW]\b"
)

INSURANCE = (
    r"(?=[MPSI])\b(?:Member|Policy|Plan|Subscriber|Insurance)"
    r"\s*+(?:(?:ID|No\.?|Number|#)\s*+)?(?:[:#-]\s*+)?+"
    r"[A-Z0-9]{3,}(?:[-\s][A-Z0-9]{2,}){0,3}\b"
)

LICENSE = (
    r"(?=[DLPSI])\b(?:Driver'?s\s++License|DL|License|Lic|Passport"
    r"|State\s++ID|ID\s++Number)"
    r"\s*+(?:(?:No\.?|Number|ID|#)\s*+)?(?:[:#-]\s*+)?+"
    r"[A-Z0-9]{3,}(?:[-\s][A-Z0-9]{2,}){0,3}\b"
)

VEHICLE = (
    r"(?=[VPT])\b(?:VIN|Vehicle\s++Identification\s++Number|Plate|Tag)"
    r"\s*+(?:(?:No\.?|Number|ID|#)\s*+)?(?:[:#-]\s*+)?+"
    r"[A-HJ-NPR-Z0-9]{5,17}\b"
)

DEVICE = (
    r"(?=[DIPGCS])\b(?:Device|Implant|Pump|Pacemaker|Generator|Catheter"
    r"|Serial|S/N)\s*+(?:(?:ID|No\.?|Number|#)\s*+)?(?:[:#-]\s*+)?+"
    r"[A-Z0-9]{3,}(?:[-/][A-Z0-9]{2,}){0,3}\b"
)

IP = r"(?=\d)\b(?:\d{1,3}\.){3}\d{1,3}\b"

# what follows a title or a first name
NAME_TAIL = r"\s++[A-Z][\p{L}’'-]++(?:\s++[A-Z][\p{L}’'-]++)?"

PERSON_CAPITALS = (
    r"(?=[A-Z])\b(?>(?<!['’])|\G|(?<!\b[A-Z][\p{L}’']{0,1000}))"
    r"[A-Z][\p{L}’']++\s++[A-Z][\p{L}’']+(?:\s++[A-Z][\p{L}’']+)?\b"
)

DATE = (
    r"(?=[\dJFMASOND])\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*+"
    r"\s++\d{1,2},?\s++\d{2,4})\b"
)

RELATIVE_DATE = (
    r"(?=[\dYTL])\b(?:yesterday|today|tomorrow"
    r"|last\s++(?:night|week|month|year|Monday|Tuesday|Wednesday|Thursday"
    r"|Friday|Saturday|Sunday)"
    r"|this\s++(?:morning|afternoon|evening|week|month)"
    r"|\d++\s++(?:day|days|week|weeks|month|months|year|years)\s++ago)\b"
)
