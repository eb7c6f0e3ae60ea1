"""Fixed values that results depend on (word lists, tables, patterns, limits)."""

# Chunk limits in tokens, and the longest heading in words.
TARGET, MOST, OVERLAP, LEAST, HEADING_BREAK, HEADING_WORDS = 380, 480, 50, 100, 100, 8
# Ranking.
TOP_K, CANDIDATES, RRF_K, PER_COMPANY = 5, 20, 60, 3
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# Fixed value: characters after the signatures that make an appendix.
APPENDIX = 20_000
# How an answer without evidence begins, and the whole of it.
NOT_FOUND = "Not found in the filings"
REFUSAL = f"{NOT_FOUND}."
# Fixed value: how a line begins that tells what the sources lack.
EXEMPT = "not in the excerpts"

# Words dropped from keyword queries.
STOPWORDS = """
a an and are as at be been by can could did do does for from had has have how i in
into is it its me my of on or our over should so than that the their them then there
these they this those to under was we were what when where which who whom whose why
will with would you your about all any each every other some such tell describe
describes say says said mention mentions list lists listed company companies firm firms business businesses
""".split()

# Words that also match another phrase.
EXPANSIONS = {
    "employed": "employees", "employ": "employees", "staff": "employees", "workforce": "employees",
    "headcount": "employees", "workers": "employees", "profit": "net income", "profits": "net income",
    "earnings": "net income", "ceo": "chief executive officer", "cfo": "chief financial officer",
    "coo": "chief operating officer", "cto": "chief technology officer", "ev": "electric vehicle",
    "evs": "electric vehicles", "ai": "artificial intelligence", "r&d": "research and development",
    "capex": "capital expenditures",
}

# The items of an annual report in order, with their titles.
SECTION_TITLES = {
    "1": "Business", "1a": "Risk Factors", "1b": "Unresolved Staff Comments", "1c": "Cybersecurity",
    "2": "Properties", "3": "Legal Proceedings", "4": "Mine Safety Disclosures",
    "4a": "Information About Executive Officers", "5": "Market for Registrant's Common Equity", "6": "[Reserved]",
    "7": "Management's Discussion and Analysis", "7a": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9": "Changes in and Disagreements with Accountants",
    "9a": "Controls and Procedures", "9b": "Other Information",
    "9c": "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "10": "Directors, Executive Officers and Corporate Governance", "11": "Executive Compensation",
    "12": "Security Ownership of Certain Beneficial Owners and Management",
    "13": "Certain Relationships and Related Transactions", "14": "Principal Accountant Fees and Services",
    "15": "Exhibits and Financial Statement Schedules", "16": "Form 10-K Summary",
    "signatures": "(officers and directors who signed the report)",
}
ITEMS = [item for item in SECTION_TITLES if item != "signatures"]

# Tags of the HTML reader.
HIDDEN_TAGS = {"script", "style", "head", "title", "ix:header"}
EMPTY_TAGS = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "wbr"}
BLOCK_TAGS = {"p", "div", "br", "hr", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote"}

# Scales of written numbers.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
MONTHS = "January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()

# Patterns that results depend on.  Citations, and runs of them; written numbers with a unit;
# days of months; sentence ends; items and auditors' reports at the start of a line; amounts; lines that
# every page repeats; questions about all companies; years; sections.
CITED = r"\[S\d+(?:\s*[,;]\s*S\d+)*\]"
CITED_RUN = rf"(?:{CITED}\s*)+"
NUMBER = r"(?<![\w.])(\d(?:[\d,]*\d)?(?:\.\d+)?)(?!-[KQ]\b)(\s*%|\s*(?:thousand|million|billion|trillion)\b)?"
MONTH_DAY = rf"(?:{'|'.join(MONTHS)})\.?\s+\d{{1,2}}(?!\d)"
SENTENCE_END = r"(?:(?<=[.!?])|(?<=[.!?][\"”)]))\s+(?=[A-Z0-9“\"(])"
ITEM = r"item\s+(\d{1,2}[a-c]?)\b"
AUDITOR = "report of independent registered public accounting firm"
AMOUNT = r"(?:\(?[\d.,]+\)?|[—–-])"
NOISE = r"(?i)^(\d{1,3}\.?|part [iv]+\.?|item [\d a-c,]+|item .*\(continued\)|table of contents( \| .*)?|.* \| \d{4} form 10-k \| \d+)$"
ALL_COMPANIES = r"(?i)\b(all|each|every|which|what)\s+(of\s+the\s+)?compan(y|ies)"
YEAR = r"(?i)(?<![\w$,-])(?:FY\s?)?((?:19|20)\d\d)(?![\w-])"
SECTION = r"(?i)\bitem\s+\d{1,2}[a-c]?\b|\bsignature page\b|\bsignatures\b"
