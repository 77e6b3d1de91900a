"""The two taxonomies as data: document types with their rules, and form families."""

from __future__ import annotations

# The document types in catalogue order, with what each covers and what it does not.
CATALOGUE: dict[str, tuple[str, str]] = {
    "income-statement": ("Australian employment income statement from ATO online services, including Single Touch Payroll amounts and tax-ready status.", "PAYG payment summaries, payslips or instructions."),
    "payment-summary": ("PAYG payment summary showing gross payments and withholding for a recipient.", "STP income statements or payslips."),
    "bank-statement": ("Bank transaction or savings account statement showing balances, transactions or interest.", "Loan statements or a letter requesting a bank statement."),
    "loan-statement": ("Loan or mortgage account statement showing principal, interest and repayments.", "Ordinary deposit accounts, loan applications or agreements."),
    "dividend-statement": ("Company dividend payment statement or advice, including franked/unfranked amounts and franking credits.", "Managed fund distributions, trade confirmations or performance reports."),
    "managed-fund-statement": ("Managed fund annual tax statement or AMMA statement with attributed income, distributions, capital gains or AMIT cost base amounts.", "Company dividends or investment performance reports."),
    "share-trade-confirmation": ("Securities contract note or trade confirmation showing a purchase or sale, quantity and settlement.", "Portfolio valuations or dividend statements."),
    "rental-statement": ("Property manager rental or owner statement showing rent collected and property expenses.", "Lease agreements, depreciation schedules or general property advice."),
    "depreciation-schedule": ("Depreciation schedule or report listing decline in value, capital works or plant and equipment deductions.", "Purchase invoices or instructions about depreciation."),
    "business-activity-statement": ("Australian business activity statement with GST reporting labels such as G1, 1A and 1B.", "Instructions, tax invoices or income tax returns."),
    "notice-of-assessment": ("ATO income tax notice of assessment or amended assessment, with taxable income and an assessed payable or refund.", "Tax returns, estimates or general ATO correspondence."),
    "tax-return": ("Australian individual, company, trust, partnership or superannuation income tax return.", "Assessments, instructions, activity statements or foreign returns."),
    "tax-invoice": ("Tax invoice for supplied goods or services, identifying GST and an amount billed.", "Invoice templates, instructions, quotes or payment receipts. A combined invoice and receipt is ambiguous."),
    "receipt": ("Receipt acknowledging payment, with an amount paid and payment details.", "Unpaid invoices or receipt instructions. A combined invoice and receipt is ambiguous."),
    "private-health-statement": ("Australian private health insurance tax statement with rebate, benefit or tax claim codes and premium information.", "Medical invoices, insurance quotes or policy renewal letters."),
}
TAXONOMY_VERSION = "au-1"
TYPES = list(CATALOGUE)
ABSTENTIONS = ["unknown", "ambiguous", "unreadable"]
OUTCOMES = [*TYPES, *ABSTENTIONS]
MODEL_OUTCOMES = [*TYPES, "unknown", "ambiguous"]
METHODS = ["rules", "model", "extraction"]
EXTRACTIONS = ["native", "ocr", "needs_ocr", "failed"]
ENGINES = ["pdf-inspector-pp-ocrv6-small", "paddleocr-3.7.0-pp-ocrv6-small"]
LOW_LINES = "paddle_low_confidence_lines"
FALLBACK_FAILED = "paddle_fallback_failed"
RELIABLE = 0.8
GATE = 0.95
MODEL_CHARS = 20_000
PAGE_CHARS = 200_000
MAX_PAGES = 500
MAX_FILE_BYTES = 50 * 1024 * 1024
HEADING_LINES = 32

# The phrases that head a document of each type, in catalogue order.
HEADINGS: dict[str, str] = {
    "income-statement": r"\bincome statement\b",
    "payment-summary": r"\bpayment summary\b",
    "bank-statement": r"\b(bank statement|statement of account|(?:savings|transaction|bank) account statement)\b",
    "loan-statement": r"\b(?:(?:home )?loan|mortgage)(?: account)? statement\b",
    "dividend-statement": r"\bdividend(?: payment)? (?:statement|advice)\b",
    "managed-fund-statement": r"\b(?:AMMA statement|annual tax statement|attribution managed investment trust member annual statement)\b",
    "share-trade-confirmation": r"\b(?:contract note|trade confirmation)\b",
    "rental-statement": r"\b(?:rental(?: property)? annual statement|owner annual statement|annual rental summary|rental statement)\b",
    "depreciation-schedule": r"\bdepreciation (?:schedule|report)\b",
    "business-activity-statement": r"\b(?:business activity statement|activity statement|BAS)\b",
    "notice-of-assessment": r"\bnotice of (?:amended )?assessment\b",
    "tax-return": r"\b(?:(?:individual|company|trust|partnership|superannuation fund|fund income) tax return|self-managed superannuation fund annual return)\b",
    "tax-invoice": r"\btax invoice\b",
    "receipt": r"\b(?:payment |sales )?receipt\b",
    "private-health-statement": r"\b(?:private health insurance(?: tax)? statement|annual private health statement)\b",
}

# What must support a heading elsewhere in the text; for some types two tokens in order, for one an exclusion.
SUPPORT: dict[str, str] = {
    "income-statement": r"tax ready|salary|gross (?:payments|amount)|single touch payroll",
    "payment-summary": r"PAYG|pay as you go|withheld|gross payments",
    "bank-statement": r"opening balance|closing balance|interest credited|withdrawals|deposits",
    "loan-statement": r"interest|principal|repayment",
    "dividend-statement": r"franking|franked|dividend|shares",
    "managed-fund-statement": r"\b(?:AMIT|managed fund|attribution managed investment trust|distributions|capital gains|foreign income|cost base adjustment)\b",
    "share-trade-confirmation": r"settlement|brokerage|shares|securities",
    "rental-statement": r"\b(?:rent|rental income|letting|management fees)\b",
    "depreciation-schedule": r"capital works|plant and equipment|decline in value|adjustable value",
    "notice-of-assessment": r"taxable income|refund|amount payable|balance of this assessment",
    "tax-return": r"income|deductions|declaration|distribution",
    "receipt": r"\b(?:paid|payment received|payment method)\b",
    "private-health-statement": r"rebate|benefit code|tax claim code",
}
IN_ORDER: dict[str, list[tuple[str, list[str]]]] = {
    "business-activity-statement": [("G1", ["1A"]), ("1A", ["1B"])],
    "tax-invoice": [("GST", ["total", "balance"]), ("total", ["GST"])],
}
EXCLUDED: dict[str, str] = {
    "receipt": r"\b(?:not|never)\s+(?:paid|yet\s+paid|been\s+paid|yet\s+been\s+paid)\b|\bpayment\s+(?:not|never)\s+(?:received|yet\s+received)\b|\bunpaid\b|\bawaiting payment\b",
}

# How a page shows that it only asks for, explains or imitates a document. {name} is any heading or generic
# document noun, {object} one of these with its article or "copy"; line ends are where ^ and $ stand.
NOUNS = r"\b(?:document|form|invoice|statement|assessment|tax return)\b"
OBJECT = r"(?:(?:a|an|the|your|my|our|this|that)\s+)?(?:copy\b|{name})"
CONTEXT: dict[str, str] = {
    "instructions": r"^[ \t]*(?:[#>*-]+\s*)?instructions\s+(?:for|on)\s+(?:(?:completing|preparing|filling(?:\s+(?:in|out))?)\s+)?{object}",
    "subject_line": r"^[ \t]*(?:[#>*-]+\s*)?(?:(?:subject|re|fw|fwd):[ \t]*)*+{name}\s+(?:copy\s+)?(?:request|enquiry|inquiry)[ \t]*[.!?:]?[ \t]*$",
    "please_send": r"\b(?:(?:could|can|would) you (?:please )?|please )(?:send|provide|supply|request)\s+(?:(?:me|us)\s+(?:with\s+)?)?{object}",
    "requesting": r"\brequest(?:ing)?\s+(?:for\s+)?{object}",
    "template": r"{name}\s+template\b|\btemplate\s+(?:for\s+)?{object}",
    "phrases": r"\b(?:example only|dear accountant|ignore (?:all )?previous instructions|classify this document)\b",
}

# The smallest number of labelled cases that each evaluation set must have.
GATE_CASES = {"development": 15, "held-out": 42, "regression": 35, "hardening": 23}
GATE_COMPLETE = ["development", "held-out"]

# Page kinds, families that are asked about in two steps, and the answer for a form outside the list.
KINDS = ["form_page", "instructions", "blank", "cover_sheet", "state_tax_form", "broker_or_bank_statement", "letter_or_other"]
FAMILIES: dict[str, str] = {
    "form-5471": "Form 5471 (Information Return of U.S. Persons With Respect to Certain Foreign Corporations) or any of its Schedules E, G-1, H, I-1, J, M, O, P, Q, R",
    "form-8865": "Form 8865 (Return of U.S. Persons With Respect to Certain Foreign Partnerships) or its Schedules G, H, K-1, K-2, K-3, O, P",
    "form-8933": "Form 8933 (Carbon Oxide Sequestration Credit) or its Schedules A-F",
    "form-1118": "Form 1118 (Foreign Tax Credit — Corporations) or its Schedules I, J, K, L",
    "form-5713": "Form 5713 (International Boycott Report) or its Schedules A, B, C",
}
NOT_LISTED = "not_in_this_list"
NOT_LISTED_WHAT = "The page belongs to a form or schedule that is NOT one of the options above"
NOT_A_MEMBER_WHAT = "The page belongs to a form that is NOT one of the options above"
# What a model is asked about a page, and what the kinds of pages are.
KIND_QUESTION = "What kind of page is this?"
FORM_QUESTION = (
    'Which IRS form (or form family) is this page from? Read the form number and title in the header and the footer line (e.g. "Form 8880 (2025)", "Schedule A (Form 1040)"). '
    "An instructions page belongs to the form it instructs. If the form is not among the options, choose not_in_this_list."
)
MEMBER_QUESTION = (
    "Which specific form or schedule is this page from? All options belong to: {family}. "
    "Read the form number in the header and footer; an instructions page belongs to the form it instructs."
)
KIND_OPTIONS: dict[str, dict] = {
    "form_page": {
        "what": "A page with at least one fillable entry (numbered lines, boxes, name/TIN fields), even if it also carries instruction text",
        "examples": ["1 Wages, tips, other compensation $", "Name(s) shown on return  Your social security number", "Line 7 Subtract line 6 from line 5"],
    },
    "instructions": {
        "what": "Only instruction prose — who must file, definitions, box explanations — with no fillable entry anywhere on the page",
        "examples": ["Instructions for Recipient", "General Instructions", "Purpose of Form", "Future Developments"],
    },
    "blank": {"what": "A blank page or one that says it is intentionally left blank; little or no text"},
    "cover_sheet": {"what": "A cover or notice page (Attention notices, filing warnings, transmittal sheets)"},
    "state_tax_form": {"what": "A STATE or local income tax form or schedule (e.g. California 540, New York IT-201, New Jersey NJ-1040), issued by a state agency, not the IRS"},
    "broker_or_bank_statement": {"what": "A brokerage, bank, payroll or custodian statement: consolidated 1099 summary pages, account summaries, transaction detail, realized gain/loss reports"},
    "letter_or_other": {"what": "Any other page: a cover letter, engagement letter, invoice, filing instructions, e-file authorization, preparer worksheet, or notice"},
}
USD_PER_MILLION_TOKENS = 0.042

# Benchmark file stems and the forms that they hold.
STEM_FORMS = {
    "w2": "form-w-2", "w2g": "form-w-2g", "1040": "form-1040", "1099int": "form-1099-int", "1099b": "form-1099-b", "1099div": "form-1099-div", "1099r": "form-1099-r", "1099misc": "form-1099-misc",
    "1099g": "form-1099-g", "1099nec": "form-1099-nec", "1099k": "form-1099-k", "1099sa": "form-1099-sa", "1098": "form-1098", "1098t": "form-1098-t", "1098e": "form-1098-e",
}


def keyword(type_: str) -> str:
    """A type's name in plain words."""
    return type_.replace("-", " ")
