"""Word lists and patterns of the rules, as data. Where order matters, the first match wins."""

# Kinds of credits that aren't revenue.
TRANSFER = r"(?i)\btransfer\b|\bxfer\b|online transfer|internal transfer|between accounts"
REVERSAL = r"(?i)reversal|returned deposit|return item|chargeback|redeposit"
FINANCING = r"(?i)advance|funding|capital deposit|loan proceeds"

# Expense categories in order.
CATEGORIES = [
    ("Payroll", r"(?i)payroll|adp |gusto|paychex"),
    ("Rent", r"(?i)\brent\b|lease pmt|property mgmt"),
    ("Utilities", r"(?i)electric|utility|water bill|gas company|pg&e|con ?edison"),
    ("Insurance", r"(?i)insurance|geico|progressive|hartford"),
    ("Taxes", r"(?i)\btax\b|irs |eftps"),
    ("Fees", r"(?i)service charge|monthly fee|overdraft|nsf"),
    ("Financing/MCA", r"(?i)capital|funding|advance|kapitus|ondeck|bluevine|fundbox"),
    ("Transfers", r"(?i)transfer|xfer"),
    ("Cash Withdrawal", r"(?i)atm |cash withdrawal"),
    ("Card Purchase", r"(?i)\bpos\b|debit card purchase"),
]
OTHER_CATEGORY = "Vendor/Other"

# Kinds of overdraft events in order.
EVENT_KINDS = [
    ("nsf", r"(?i)\bnsf\b|non.?sufficient funds|insufficient funds"),
    ("overdraft", r"(?i)overdraft|\bod fee\b|\bodp\b"),
    ("returned", r"(?i)returned item|return.?ach|unauthorized return|check return|bounced"),
]

# Funders and how statements write them, in order.
FUNDERS = [
    ("FundX", ["fundx", "fund x"]),
    ("Forward Financing", ["forward financing", "forward financin", "forwardfinance"]),
    ("Shopify Capital", ["shopify capital", "shopify repay", "shopify repayments"]),
    ("Expansion Capital", ["expansioncap", "expansion capital", "expansion cap"]),
    ("Fintech Capital", ["fintech capital", "fintechcapital"]),
    ("Forest Capital", ["forest capital"]),
    ("Millstone Funding", ["millstone fundin", "millstone funding", "millstone fund"]),
    ("Flow Capital", ["flow capital"]),
    ("Barclays Advance", ["barclays advance"]),
    ("Viking Funding", ["viking funding", "viking funding ii", "viking funding i i"]),
    ("Giggle Finance", ["giggle finance"]),
    ("DoorDash Capital", ["doordash capital", "door dash capital"]),
    ("OnDeck", ["ondeck", "on deck"]),
    ("Rapid Finance", ["rapid finance"]),
    ("Kapitus", ["kapitus"]),
    ("Fora Financial", ["fora financial"]),
    ("Credibly", ["credibly"]),
    ("National Funding", ["national funding"]),
    ("Everest Business Funding", ["everest business funding", "everest funding"]),
    ("QuickBridge", ["quickbridge", "quick bridge"]),
    ("Square Capital", ["square capital"]),
    ("PayPal Working Capital", ["paypal working capital", "paypal wc"]),
    ("Stripe Capital", ["stripe capital"]),
    ("Toast Capital", ["toast capital"]),
    ("BlueVine", ["bluevine"]),
    ("Fundbox", ["fundbox"]),
]
GENERIC_FUNDER = "Unidentified MCA (generic terminology match)"
GENERIC_TERMS = ["merchant cash advance", "cash advance", "future receivables", "receivables purchase", "mca debit", "mca payment"]

# Descriptions that are no advance, tried before the funders.
NOT_ADVANCES = [
    "capital one mobile pmt", "capital one online pmt", "capital one crcardpmt", "credit card", "crcardpmt", "card pmt",
    "cc pmt", "crc ardpmt", "payroll", "adp tax", "adp 401k", "insurance", "utility", "rent", "lease", "service charge",
    "monthly service fee", "square inc", "toast dep", "grubhub", "uber", "doordash, inc.", "dd *doordash", "doordash*",
    "shopify payout", "stripe payout", "paypal transfer", "merchant service merch dep", "advance auto", "cont finance",
    "sig properties",
]
BANK_LOAN_WORDS = r"\b(business loan|funding|capital advance|commercial loan)\b"

# Statement sections; ignored ones first, then credits, then debits.
CONTINUED = r"\s*(?:account\s*#?\s*[\d\s-]*)?(?:[-–]?\s*\(?cont(?:inued)?\.?\)?)?\s*$"
SECTIONS = [
    ("ignore", r"(?i)^(?:daily\s+balance\b|balance\s+summary\b|transaction\s+counts?\b|service\s+charge\s+summary\b|accounts?\s+summary\b|interest\s+summary\b|(?:rate|fee|overdraft)\s+summary\b|statement\s+of\s+account\b|summary\s+of\s+account\b)"),
    ("credit", r"(?i)^(?:(?:\d+\s+)?deposits?\s*(?:&|and|,)\s*(?:other\s+)?credits\b|deposits?\s*,\s*credits\b|deposits?\s+and\s+additions\b|electronic\s+(?:deposits|credits)\b|additions\s+to\s+account\b|money\s+in\b|(?:deposits?|credits)" + CONTINUED + ")"),
    ("debit", r"(?i)^(?:(?:\d+\s+)?withdrawals?\s*(?:&|and|,)\s*(?:other\s+)?debits\b|checks?\s+and\s+other\s+debits\b|other\s+withdrawals\b|electronic\s+(?:withdrawals|payments|debits)\b|checks?\s+paid\b|atm\s+withdrawals?\b|debit\s+card\s+(?:purchases?|withdrawals?)\b|subtractions\s+from\s+account\b|money\s+out\b|(?:withdrawals?|debits)" + CONTINUED + ")"),
]
HEADING_LENGTH = 60
TOTAL_LINE = r"(?i)^\s*(?:total|subtotal|ending|beginning|previous|new)\b"
CREDIT_WORDS = r"(?i)deposit|\bdep\b|transfer in|payroll credit|ach credit|refund|\bcredit\b|hcclaimpmt|claim\s*pmt|merch(?:ant)?\s*(?:dep|deposit|settle)"
DEBIT_WORDS = r"(?i)check|withdrawal|\bdebit\b|payment|\bpmt\b|purchase|\bfee\b|pos |ach debit|bill pay|service charge"

# Words of a company name that don't tell companies apart.
GENERIC_NAME_WORDS = [
    "llc", "inc", "corp", "co", "company", "the", "and", "of", "group", "service", "ltd", "pc", "llp", "lp", "dba",
    "incorporated", "corporation", "limited", "partnership", "enterprise", "holding",
]

# Ranks of processing states, the worst highest.
STATUS_RANKS = {"failed": 5, "needs_review": 4, "stopped": 3, "ocr": 2, "extracting": 2, "validating": 2, "queued": 1, "complete": 0, "skipped": 0}

# Phrases that tell a bank statement; plain substrings.
STATEMENT_PHRASES = [
    "account statement", "beginning balance", "ending balance", "transaction description", "statement period", "account summary",
    "deposits and other credits", "checks and other debits", "daily balance",
]
# Phrases that tell an application; with no letter or digit beside them.
APPLICATION_PHRASES = [
    "legal company name", "business owner information", "company information", "requested financing amount", "requested funding amount",
    "use of funds", "average monthly revenue", "monthly credit card processing", "business start date", "ownership percentage", "% ownership",
    "social security no", "date of birth", "incorporation state", "legal entity", "merchant application", "funding application",
    "existing business loan", "business legal name", "legal business name", "business name", "company name", "legal/corporate name",
    "doing business as", "federal tax id", "tax id", "social security", "birth date", "percent ownership", "% of ownership", "ownership %",
    "credit score", "fico score", "owner information", "owner details", "principal information", "business information", "business details",
    "home address", "state of incorporation", "type of entity", "entity type", "legal structure", "amount requested", "loan amount",
    "funding amount", "gross annual sales", "annual revenue", "monthly sales",
]
MONTH_TO_DATE = r"(?i)month.?to.?date|\bmtd\b|current month activity|period\s+to\s+date"
MIN_SIGNALS, MIN_CHARS, OCR_CHARS = 2, 200, 50
ENVELOPE = r"(?i)docusign|envelope id|certificate of completion|signed by:"
PHONE_LINE = r"^(?:\+?1[\s.\-]?)?\(?[2-9]\d{2}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}$"
EMAIL_LINE = r"(?i)^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"
CONTACT_LABEL = r"(?i)^(?:mobile|cell|residential|landline|home|work|business|phone|phones|email|emails|e-mail|other)$"

# Banks by what their letterheads print; the earliest place wins, the order breaks ties.
LETTERHEADS = [
    ("Truist", ["truist"]), ("Chase", ["jpmorgan chase bank", "chase business", "printed from chase for business"]), ("Regions Bank", ["regions bank"]),
    ("PNC Bank", ["pnc bank"]), ("Bank of America", ["bank of america"]), ("Wells Fargo", ["wells fargo"]), ("TD Bank", ["td bank"]),
    ("U.S. Bank", ["u.s. bank", "us bank"]), ("Citizens Bank", ["citizens bank"]), ("First Citizens Bank", ["first citizens bank"]),
    ("City National Bank", ["city national bank"]), ("M&T Bank", ["m&t bank", "m and t bank"]), ("KeyBank", ["keybank"]),
    ("California Coast Credit Union", ["california coast credit union"]), ("BlueVine", ["bluevine"]), ("Navy Federal Credit Union", ["navy federal credit union"]),
    ("Huntington Bank", ["huntington national bank"]), ("Fifth Third Bank", ["fifth third bank"]), ("Middlesex Federal Savings", ["middlesex federal"]),
    ("Visions Federal Credit Union", ["visions federal credit union"]), ("Old National Bank", ["old national"]), ("KeyPoint Credit Union", ["keypoint"]),
    ("Bluestone Federal Credit Union", ["bluestone federal"]), ("DFCU Financial Credit Union", ["the cash back"]),
]
TABLE_START = r"(?i)(deposits and other credits|other credits|checks and other debits|other debits|withdrawals and other debits|daily balance summary|transaction history|account activity|beginning balance|date\s+description\s+amount)"
# Without a letterhead, in order, the first rule that holds. A rule's alternatives are joined by "or"; in each
# all parts must be found: h the first 120 lines, t the whole text, f the file name, all in lower case, w the file name as a word.
BANK_RULES = [
    ("Truist", ["h truist"]), ("Chase", ["h jpmorgan chase bank", "h chase business", "h printed from chase for business"]),
    ("Regions Bank", ["h regions bank", "t 1-800-regions"]), ("PNC Bank", ["h pnc bank"]), ("Bank of America", ["h bank of america"]),
    ("Wells Fargo", ["h wells fargo", "t wellsfargo.com"]), ("TD Bank", ["h td bank", "t tdbank.com"]), ("U.S. Bank", ["h u.s. bank", "h us bank", "t usbank.com"]),
    ("Citizens Bank", ["h citizens bank", "t citizensbank.com"]), ("First Citizens Bank", ["h first citizens bank", "t firstcitizens.com", "t 1-866-322-4249"]),
    ("City National Bank", ["h city national bank", "t cnb.com"]), ("M&T Bank", ["h m&t bank", "h m and t bank", "t mtb.com"]), ("KeyBank", ["h keybank", "t key.com"]),
    ("California Coast Credit Union", ["h california coast credit union", "t calcoastcu.org", "t bank name: cal coast"]), ("BlueVine", ["h bluevine", "t bluevine.com"]),
    ("Navy Federal Credit Union", ["h navy federal credit union", "t navyfederal.org"]), ("Huntington Bank", ["h huntington national bank", "t huntington.com"]),
    ("Fifth Third Bank", ["h fifth third bank", "t 53.com"]), ("Middlesex Federal Savings", ["h middlesex federal", "t middlesexfederal.com"]),
    ("Thomaston Savings Bank", ["t thomastonsb.com"]), ("HomeTrust Bank", ["t htb.com"]), ("Valliance Bank", ["t vbank.com"]), ("VyStar Credit Union", ["t vystarcu.org"]),
    ("Visions Federal Credit Union", ["h visions federal credit union", "t visionsfcu.org"]), ("Nano Banc", ["h nano + h ban"]), ("Carter Bank", ["t carterbank.com"]),
    ("Southern Bank", ["t bankwithsouthern.com"]), ("CNB", ["w cnb"]), ("Old National Bank", ["h old national", "f old national"]), ("KeyPoint Credit Union", ["h keypoint", "t kpcu.com"]),
    ("Bluestone Federal Credit Union", ["t bluestonefcu", "h bluestone federal"]), ("DFCU Financial Credit Union", ["t dfcu", "h the cash back"]),
    ("Commerce Bank", ["t 800-453-bank", "t mybusiness checking"]), ("Prosperity Bank", ['t nyse symbol "pb"']),
    ("Indiana Members Credit Union", ["t indiana + t members credit union", "t indiana + t imcu.com"]), ("Farmers Bank", ["t farmers + t thefarmersbank", "t farmers + f farmers"]),
]
TOLL_FREE = r"^(1800|1888|1877|1866|1855|1844|1833|844|888|877|866|855|833)"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NAME_SUFFIX = r"\s+(llc|l l c|inc|incorporated|corp|corporation|ltd|limited|llp|pllc|lp|pc|company|co)$"
TOWN = r"([A-Za-z.'\- ]{2,}?),?\s+([A-Za-z]{2})\s+\d{5}(?:-\d{4})?\b"
FOLDER_STAMP = r"[\s_-]*\d{1,2}[_.-]\d{1,2}[_.-]\d{2,4}\s*$"
FILENAME_NOISE = r"(?i)\b(?:use this app|application|statement|bank|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b|\d+"
GENERIC_FILENAME = r"(?i)^(?:app|apps|application|form|img|image|scan|scanned|doc|document|file|copy|signed|final|summary|mtd|new|submission)(?:\s+(?:app|copy|signed|final))*$"
PHONES = r"(?:\+?1[\s.\-]?)?\(?[2-9]\d{2}\)?[\s.\-]?[2-9]\d{2}[\s.\-]?\d{4}"
EMAILS = r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
# Account numbers.
ACCOUNT_ENDING = r"(?i)(?:checking\s+(?:account\s+)?(?:for|ending)|account\s+ending)\s+([Xx*\d-]{5,})"
MEMBER_NUMBER = r"(?i)MEMBER\s*#\s*:?\s*(\d{4,})"
ACCOUNT_LABEL = r"(?i)(?:Primary Account Number|Account number|Account No\.?|Account #)\s*[:#]?\s*([Xx*\- ]*\d[\d Xx*\-]{3,})"
ACCOUNT_MASKED = r"([Xx*]{2,}[\- Xx*]*\d{4,})"
ACCOUNT_ALONE = r"^(account number|account #|account no\. ?|primary account number)$"
NOT_AN_ACCOUNT = r"(?i)page|cycle|enclosures|customer service|chase\.com|800-|1-800|service center|date"
ACCOUNT_NARRATIVE = r"(?i)\$|balance|deposit|withdrawal|credit|debit|transaction|description|january|february|march|april|may|june|july|august|september|october|november|december"
ACCOUNT_DATED = r"\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|\(|\)"
# holders' names and addresses on statements.
HOLDER_LABELS = [rf"(?i){x}\s*[:\-]\s*" for x in (r"account\s*holder\s*(?:name)?", r"business\s*name", r"customer\s*name", r"member\s*name", r"account\s*title", r"prepared\s*for", r"legal\s*company\s*name")]
TRADE_NAME = r"(?i)^\s*(?:d/?b/?a|doing business as)\b[:\s]+(.+)$"
ENTITY_WORDS = r"LLC|L\.L\.C\.|L L C|INC|INC\.|INCORPORATED|CORP|CORP\.|CORPORATION|LTD|LTD\.|LIMITED|LLP|L\.L\.P\.|PLLC|P\.L\.L\.C\.|LP|L\.P\.|PC|P\.C\.|COMPANY|ENTERPRISES|HOLDINGS|PARTNERS"
ENTITY_SUFFIX = rf"(?i)\b({ENTITY_WORDS})\b\.?\s*$"
STATEMENT_FURNITURE = r"(?i)\b(statement|account summary|page \d|balance|deposits|withdrawals|transaction|member fdic|equal housing|customer service|client care|contact information|questions about)\b"
ADDRESS_START = r"(?i)^\s*(?:p\.?\s*o\.?\s*box|c/o\b|suite\b|ste\.?\b|apt\b|floor\b)"
POSTING_DATE = r"(?i)^(?:\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b"
STREET_WORDS = "st|street|ave|avenue|rd|road|dr|drive|blvd|boulevard|ln|lane|way|ct|court|pkwy|parkway|hwy|highway|ter|terrace|pl|place|cir|circle|trl|trail|turnpike|tpke|loop|run|row|sq|square|xing|crossing|pike|expy|expressway"
STREET_TYPE = rf"(?i)\b(?:{STREET_WORDS})\b\.?"
STREET = rf"(?i)^(\d+[A-Za-z]?\s+[A-Za-z0-9.'&#\- ]*?\b(?:{STREET_WORDS})\b\.?(?:\s+(?:N|S|E|W|NE|NW|SE|SW)\b\.?)?(?:\s+(?:ste|suite|apt|unit|rm|room|fl|floor|#)\.?\s*[A-Za-z0-9\-]+)?)"
POST_BOX = r"(?i)^p\.?\s*o\.?\s*box\s+\d+"
TOWN_LINE = r"^([A-Za-z.'\- ]{2,}?),?\s+([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)\b"
TOWN_END = r"\b[A-Z]{2}\s+\d{5}(-\d{4})?\s*$"
NO_ADDRESS = r"(?i)\b(page \d|account number|statement|balance|deposits|withdrawals|member fdic)\b"
SORT_CODE, CONSONANTS, FUSED_CODE = r"^([A-Z]{16,})\s+\S", "[BCDFGHJKLMNPQRSTVWXZ]{4}", r"^([A-Za-z]+\d{3,})\s+\S"
HOLDER_LINES, ADDRESS_REACH = 45, 10
FIGURE = r"\(?\$?\s*(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.\d{2})?|[0-9]{4,}(?:\.\d{2})?|[0-9]{1,3}\.\d{2})\)?"
# Labels of application fields in order; words of labels; states.
FORM_LABELS = {
    "company": ["Legal Company Name", "Legal Business Name", "Business Legal Name", "Company Legal Name", "Legal/Corporate Name", "Corporate Name", "Business Name", "Company Name"],
    "owner": ["Full Name", "Full Legal Name", "Owner Name", "Owner Full Name", "Your Full Name", "Name Printed", "Printed Name", "Print Name", "Applicant Name", "Principal Name", "Guarantor Name"],
    "first": ["First Name"], "last": ["Last Name"], "address": ["Business Address"], "city": ["City"], "state": ["State"], "zip": ["Zip"],
    "dob": ["Date of Birth", "DOB", "Birth Date"], "start_date": ["Business Start Date", "Start Date", "Date Business Started", "Business Established", "Date Established"],
    "app_date": ["date signed", "signature date", "signed on", "date"],
}
LABEL_WORDS = (
    "legal business company corporate name names dba d/b/a doing as mobile cell phone number email e-mail address city state zip code first last middle full owner owners ownership percentage percent % of date birth dob ssn "
    "social security ein tax id federal type entity title start signature home website industry category incorporation structure information details years at est est. month year no no. # financial requested amount principal "
    "applicant primary use funds loan the your print printed contact preferred lp llp llc corp corp. inc inc. partnership sole prop prop. proprietorship non profit other yes corporation"
).split()
STATES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY PR".split()
BOUNDED = r"(?is)^(.*?)(?:\s+(?:City|State|Zip|Full Name|First Name|Last Name|Date of Birth|DOB|Monthly Credit Card Processing|Home Address|Business Telephone|Mobile|Email|Signature|Title)\s*:.*)?$"
COMPANY_BOUNDED = r"(?is)^(.*?)(?:\s+(?:Business Address|Business Start Date|Doing Business As|Legal Entity|Entity Type|Industry|Federal Tax|Tax ID|Business Phone)\b.*)?$"
COMPANY_PREFIX = r"(?i)^(?:legal company name|legal business name|business name|company name|dba)\s*:?\s*"
OWNER_PREFIX = r"(?i)^[-–\s]*owner\s*#?\s*\d*\s*[:\-]?\s*"
PERSON = r"^[A-Za-z][A-Za-z.'\-]*(?: [A-Za-z][A-Za-z.'\-]*){1,4}$"
NOT_A_PERSON = r"(?i)\b(?:name|fico|score|credit|percentage|ownership|date|birth|ssn|social|address|phone|email|title|signature|llc|inc|corp|company)\b"
OWNER_SECTION = r"(?i)\b(?:owner|principal|guarantor|applicant)\b.{0,30}\b(?:information|info|details)\b"
AUTHORISATION = r"(?i)\bauthorizations?\b"
MONTH_DAY = r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}"
OTHER_FIELD = r"(?i)^(?:city|state|zip|phone|email|address|ssn|ein|tax id)\b|\b(?:birth|dob|signature|signed|social security)\b|^[^:]{1,40}:\s*$"
OTHER_DATE = r"(?i)date of birth|\bdob\b|business start date|\bstart date\b|date established|date business started"
YEAR_DATE = r"\b((?:19|20)\d{2})[/-](\d{1,2})[/-](\d{1,2})\b"
DAY_NAME = r"(?i)^(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+"
WHOLE_ADDRESS = r"(?i)Business Address\s*:\s*(.*?)\s+City\s*:\s*(.*?)\s+State\s*:\s*([A-Za-z]{2})\s+Zip(?: Code)?\s*:\s*([0-9-]+)"
ADDRESS_LABEL = r"(?i)\b(?:Business Address|Address|City|State|Zip(?: Code)?)\s*:\s*"
#: One of these stands on every line that holds a label, a section's heading or a word of a date.
FORM_WORDS = ["name", "city", "state", "zip", "dob", "date", "address", "established", "signed on", "owner", "principal", "guarantor", "applicant", "authorization"]
EIN_NEAR, EIN_PLAIN = r"(?i)(?:Tax ID|EIN|Federal Tax ID)[^\d]{0,20}(\d{2})[-\s]?(\d{7})", r"\b(\d{2})[-\s](\d{7})\b"
SSN = r"(?i)(?:Social Security NO|Social Security|SSN)[^\d]{0,20}(\d{3})[-\s]?(\d{2})[-\s]?(\d{4})"
REVENUE = r"\$?\s*(\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\d{4,}(?:\.\d{2})?|\d{1,3}\.\d{2})"
REVENUE_LINE = r"^\(?\$?\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.\d{2})?\)?$"
MONTHLY_LABEL = r"(?i)^(?:average\s+)?(?:gross\s+)?monthly\s+(?:business\s+)?(?:revenue|sales)(?:\s*[:#-])?"
ANNUAL_LABEL = r"(?i)^(?:average\s+)?(?:gross\s+)?(?:annual|yearly)\s+(?:business\s+)?revenue(?:\s*[:#-])?"
# Dates and periods.
NUMBER_DATE = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"
WORD_DATE = r"(?i)\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)[\s/-]+(\d{1,2})[\s/-]+(\d{2,4})\b"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
NUMBER_RANGE = r"(?i)(\d{1,2})/(\d{1,2})/(\d{2,4})\s*(?:-|to|through|thru)\s*(\d{1,2})/(\d{1,2})/(\d{2,4})"
WORD_RANGE = rf"(?i){_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})\s*(?:-|to|through|thru)\s*{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})"
SINGLE_DATE = r"(?i)(?:End\s+Date|Statement\s+Date|Statement\s+Ending|as of)\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
THIS_STATEMENT = r"(?i)THIS\s+STATEMENT\s+(\d{1,2}/\d{1,2}/\d{2,4})"
STATEMENT_FOR = r"(?i)(?:Statement|Stavernent)\s+For\s+(\d{1,2}/\d{1,2}/\d{2,4})\s*[-–]\s*(\d{1,2}/\d{1,2}/\d{2,4})"
FILE_RANGE, FILE_DATE = r"(\d{4})(\d{2})(\d{2})[-_](\d{4})(\d{2})(\d{2})", r"\b(20\d{2}-\d{1,2}-\d{1,2})\b"
FILE_MONTH, FILE_MONTH_NAME = r"\b(20\d{2})[- ](0?[1-9]|1[0-2])\b", r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
# Balances and amounts of statement summaries.
OPENING = r"(?:(?:beginning|starting|previous|prior|opening)\s+(?:statement\s+|ledger\s+|daily\s+)?balance|(?:last|previous)\s+statement)\b"
CLOSING = r"(?:(?:ending|closing|current|new)\s+(?:statement\s+|ledger\s+|posted\s+)?balance|this\s+statement)\b"
CREDIT_NAME = r"(?i)\b(?:deposits?|credits?|additions?|interest|dividends?|refunds?)\b"
DEBIT_NAME = r"(?i)\b(?:withdrawals?|debits?|checks?|fees?|charges?|payments?|deductions?|subtractions?|purchases?)\b"
PRINTED_FIGURE = r"(?:\$\s*)?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.\d{2})?|[0-9]+\.\d{2}|[0-9]+|\.\d{2})"
BALANCE_WORDS = r"(?i)\b(?:beginning|starting|previous|prior|opening|last)\b"
HEADER_BEGINS, HEADER_ENDS = r"(?i)\b(?:beginning|previous|starting)\b", r"(?i)\b(?:ending|closing|new|current)\b"
FIGURE_MARK = "\x01"
# Summaries without an equation: online printouts, dated rows, scans.
ONLINE_HEADS = ["account detail - wells fargo", "printed from chase for business"]
POSTED_CREDIT = r"ach credit|wire credit|zelle credit|account transfer"
DATED_LINE = r"^(?:\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|20\d{2}-\d{2}-\d{2})\s+"
DATED_CREDIT = r"\b(?:deposit|credit)\b"
SUMMARY_LINE = rf"^totals(?: |$)|^current posted balance|^ending collected balance|{POSTED_CREDIT}|present balance|\bending balance\b|{DATED_LINE}"
SUMMARY_EVIDENCE = [
    ("online", 94, "Wells Fargo online activity totals"), ("posted", 88, "Chase online posted-credit activity"), ("dated", 78, "Summed dated deposit/credit transactions"),
]
SCANNED_CREDITS = r"(?i)\b\d+\s+CREDITS\s+([0-9]{1,3}(?:,\s*[0-9]{3})*\.\d{2})"
SCANNED_ENDING = r"(?i)THIS\s+STATEMENT\s+\d{1,2}/\d{1,2}/\d{2,4}\s+([0-9]{1,3}(?:,\s*[0-9]{3})*\.\d{2}|[0-9]{4,}\.\d{2})"
SCANNED_MEMBERS = r"imcu\.com|members credit union|indiana"
SCANNED_DEPOSITS = r"(?i)(?:depo\w*|doposts\w*|deposts\w*)\s*(?:for|or|tor|stor)?\s*[\"'$ ]*([0-9]{1,3}(?:,[0-9]{3})*\.\d{2})"
SCANNED_ACCOUNT = r"(?i)prefer.*b.*(?:check|checs|bins|busnes)|preferred business checking|preferred busnes"
SCANNED_TOTAL = r"(?i)Account\s+Balance\s+Total\s+\$?\s*([0-9]{1,3}(?:,[0-9]{3})*\.\d{2})"
