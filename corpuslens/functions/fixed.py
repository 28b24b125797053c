"""Word lists, forms, patterns and thresholds that results depend on. Stated plainly; nothing here is logic."""

from __future__ import annotations

# Trailing legal forms of company names, and words of target names that tell nothing apart.
LEGAL_SUFFIXES = ("corp", "corporation", "inc", "incorporated", "limited", "llc", "ltd", "plc", "sa")
TARGET_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "plc", "company", "co")
GENERIC_ENTITY_TOKENS = ("company", "group", "holdings", "interactive", "solutions", "software", "systems", "technologies", "technology", "communications")
PROBE_GENERIC_TOKENS = tuple("inc llc ltd corp corporation company co holdings holding group the and of plc sa ag nv gmbh lp limited technologies technology systems solutions software services international global usa new".split())
AI_GENERIC_TOKENS = tuple("ai artificial intelligence data science sciences company corp corporation inc incorporated llc limited ltd plc technology technologies robotic robotics mapping localization localiza lab labs software solutions systems".split())

# Filing forms and document families.
FORM_SCORES = {"8-K": 4, "8-K/A": 4, "S-4": 5, "S-4/A": 5, "424B3": 5, "PREM14A": 5, "PREM14A/A": 5, "DEFM14A": 5, "DEFM14A/A": 5, "SC 14D9": 5, "SC 14D9/A": 5, "SC TO-T": 5, "SC TO-T/A": 5, "SC TO-I": 5, "SC TO-I/A": 5}
TRANSACTION_FORMS = ("S-4", "S-4/A", "424B3", "PREM14A", "PREM14A/A", "DEFM14A", "DEFM14A/A", "SC 14D9", "SC 14D9/A", "SC TO-T", "SC TO-T/A", "SC TO-I", "SC TO-I/A", "425", "DEFA14A", "PREM14C", "PREM14C/A", "DEFM14C", "DEFM14C/A", "SC TO-C", "SC14D9C", "F-4", "F-4/A", "CB")
RELEVANT_TYPE_PREFIXES = ("EX-2.", "EX-10.", "EX-99.")
EXHIBIT_PRIORITY = ("EX-99", "EX-2", "EX-10")
FAMILY_RULES = (
    ("EX-2", "merger_agreement"),
    ("EX-10", "employment_or_plan"),
    ("EX-99", "press_release_exhibit"),
    ("425", "prospectus_communication"),
    ("SC 14D9", "tender_recommendation"),
    ("SC TO", "tender_offer"),
    ("DEFM14A", "proxy_statement"),
    ("PREM14A", "proxy_statement"),
    ("DEF 14A", "proxy_statement"),
    ("8-K", "current_report_body"),
)
LEGAL_FORMS = {
    "merger": "statutory merger",
    "acq. of assets": "asset purchase",
    "acq. cert. asts.": "asset purchase (certain assets)",
    "acq. maj. int.": "majority stock acquisition",
    "acq. rem. int.": "remaining-interest step acquisition",
    "acquisition": "stock/asset acquisition (unspecified)",
    "exchange offer": "exchange offer",
    "recapitalization": "recapitalization",
}
PROBE_RANK = {"agreement_exhibit": 0, "merger_proxy": 1, "announcement_only": 2, "no_transaction_filing": 3, "probe_failed": 4}
REGISTRATION_FORMS, REPORT_FORMS = ("S-4", "S-4/A", "424B3"), ("8-K", "8-K/A")

# Patterns of the passage gate, matched without regard to case.
TRANSACTION_LANGUAGE = r"\b(?:acqui(?:re|red|res|ring|sition)|merger|business combination|tender offer|purchase agreement|transaction)\b"
_EVENT = r"\b(?:acquisition|acquire[ds]?|merger|transaction|closing|effective time)\b"
_PEOPLE_TERMS = r"\b(?:continu(?:ing|ed) employees?|continued (?:employment|service)|remain employed|employee benefits?|retention bonus|transaction bonus|equity awards?|stock options?|restricted stock units?|severance|management team)\b"
EMPLOYEE_ACTION = rf"(?s){_EVENT}.{{0,240}}{_PEOPLE_TERMS}|{_PEOPLE_TERMS}.{{0,240}}{_EVENT}"
ACCOUNTING = r"\b(?:stock[- ]based compensation expense|share[- ]based compensation expense|consolidated statements?|unaudited|three months ended|six months ended|fiscal year|non-gaap|cash flows?|operating expenses?|compensation expense|in millions)\b"
SAFE_HARBOR = r"\b(?:safe harbor|forward-looking statements?|actual results (?:may|could) differ|risks? and uncertainties|cautionary statement|sec filings)\b"
HUMAN = r"\b(?:employment|severance|continued service|remain employed|benefit plans?|pension|labor|labour|union|award holders?|participants?)\b"
GENERIC_PEOPLE = r"\b(?:remain|continue|serve|report(?:ing)? to|appoint(?:ed|ment)?|lead(?:er|ership)?|employ(?:ed|ment)?|terminate)\b"
_LEADERS = r"\b(?:chief executive|chief financial|ceo|cfo|executive|officer|founder|management)\b"
_STAYING = r"\b(?:remain|continue|serve|report(?:ing)? to|appoint(?:ed|ment)?|lead)\b"
LEADERSHIP = rf"{_LEADERS}.{{0,100}}{_STAYING}|{_STAYING}.{{0,100}}{_LEADERS}"
COMPENSATION = (
    r"\b(?:retention|stay|transaction) bonus(?:es)?\b|\b(?:salary|salaries|wages?|payroll|severance|incentive)\b|"
    r"\b(?:employees?|executive|officers?|personnel|management)\b.{0,80}\bcompensation\b|\bcompensation\b.{0,80}\b(?:employees?|executive|officers?|personnel|management)\b"
)
EMPLOYEE_TREATMENT = (
    r"\b(?:continuing employees?|continued employment|continued service|remain employed|post-transaction employment|employee benefits?|benefit plans?|retention bonus|transaction bonus|severance|salary|salaries|wages?|payroll|collective bargaining)\b|"
    r"\b(?:employees?|executive|officers?|personnel|workforce|management)\b.{0,100}\b(?:remain|continue|retain|receive|provide|pay|compensation|bonus|benefits?|severance|terminate|employment|service)\b|"
    r"\b(?:equity awards?|stock options?|restricted stock units?|rsus?)\b.{0,100}\b(?:effective time|convert(?:ed)?|assum(?:e|ed)|cancel(?:led)?|vest(?:ed|ing)?|cash(?:ed)? out|continued service)\b"
)
PROXY_SOLICITATION = r"\b(?:solicit(?:ed|ing|ation)? proxies|proxy solicitation|proxies may be solicited|bear the (?:entire )?cost of soliciting|by mail|telephone|facsimile|messenger)\b"
LITIGATION = r"\b(?:plaintiffs?|defendants?|complaint|alleg(?:e|ed|ation)|wrongful conduct|liable pursuant|violat(?:e|ed|or|ion)|cause of action|individual defendants)\b"
REPRESENTATIVE_DEFINITION = (
    r"\brepresentatives?\b.{0,40}\b(?:shall )?mean\b|"
    r"\b(?:shall )?mean\b.{0,180}\b(?:directors?|officers?|employees?|agents?|advisors?|consultants?)\b.{0,80}\brepresentatives?\b|"
    r"\b(?:directors?|officers?)\b.{0,100}\bemployees?\b.{0,100}\b(?:agents?|advisors?|consultants?|representatives?)\b"
)
NONEMPLOYEE_UNION = r"\b(?:european union|united nations|union security council|eu member state)\b"
LABOR = r"\b(?:employees?|labor|labour|collective bargaining|trade union|workforce|workers?)\b"
PRIVACY_IP = r"\b(?:privacy polic(?:y|ies)|personal information|data protection|source code|intellectual property|trade secrets?|non-disclosure|confidentiality|information security)\b"
AWARD_TREATMENT = r"\b(?:award holders?|participants?|employees?|service|closing|effective time|converted?|cancelled?|assumed?|cashed out|vested|unvested|forfeit(?:ed)?|terminat(?:e|ed|ion))\b"
NAVIGATION = r"\b(?:table of contents|exhibits?)\b"
INDEX_LEADER = r"(?:\.\s*){4,}\s*\d{1,4}(?!\d)|…\s*\d{1,4}(?!\d)"
CAPTION_ACTION = r"\b(?:is|are|was|were|be|been|being|shall|will|may|must|means?|include[ds]?|provide[ds]?|receive[ds]?|convert(?:ed|s)?|assum(?:e|ed|es)|cancel(?:led|s)?|vest(?:ed|ing|s)?|forfeit(?:ed|s)?|terminat(?:e|ed|ion))\b"
STRUCTURAL_HEADING = (
    r"^(?:table of contents|contents|index|toc|page(?:\s*(?:no\.?|number))?\s*[\divxlcdm]*|"
    r"(?:annex|exhibit|appendix|schedule|attachment|article|section|part)\s*[a-z]?[\s\-–—]*[\divxlcdm]*(?:[.\-–—][\divxlcdm]+)*|"
    r"[a-z]?[\s\-–—]*\d+(?:[.\-–—]\d+)*|[ivxlcdm]+[\s\-–—]*\d*|[a-z])$"
)
HEADING_TRIM = " .:-‐–—•​ "

# Screening terms and the sets the passage gate tells apart.
AWARD_TERMS = ("equity award", "stock option", "restricted stock", "restricted stock unit", "rsu", "vesting", "incentive award")
GENERIC_TERMS = ("employee", "employees", "personnel", "workforce", "worker", "workers", "executive officer", "management team", "founder", "compensation", "bonus", "change in control", "retention", "retain", *AWARD_TERMS)
STRONG_TERMS = ("employment", "continued employment", "continued service", "remain employed", "key employee", "stay bonus", "transaction bonus", "salary", "wages", "payroll", "severance", "benefit plan", "employee benefit", "pension", "collective bargaining", "union", "labor", "labour", *AWARD_TERMS)
SCREEN_TERMS = (
    "employee", "employees", "employment", "personnel", "workforce", "worker", "workers", "labor", "labour", "collective bargaining", "union", "executive officer", "management team", "founder", "key person", "key employee", "continued employment", "continued service", "remain employed", "retention", "retain",
    "stay bonus", "transaction bonus", "compensation", "salary", "wages", "payroll", "bonus", "incentive award", "severance", "change in control", "equity award", "stock option", "restricted stock", "restricted stock unit", "rsu", "vesting", "benefit plan", "employee benefit", "pension",
)

# Weighted patterns of the AI screen, and the talent patterns.
AI_PATTERNS = (
    (r"artificial intelligence", 5),
    (r"\bai\s*/\s*ml\b", 5),
    (r"\bai[- ]powered\b", 5),
    (r"\bai\b(?=[\s,-]*(?:platform|model|models|startup|company|software|technology|lab|labs|research|system|systems|capability|capabilities|assistant|agent|agents|product|products))", 5),
    (r"machine learning", 5),
    (r"deep learning", 5),
    (r"neural network", 5),
    (r"generative ai", 5),
    (r"applied ai", 5),
    (r"large language model", 5),
    (r"\bllm(s)?\b", 5),
    (r"foundation model", 5),
    (r"natural language processing", 5),
    (r"computer vision", 5),
    (r"reinforcement learning", 4),
    (r"speech recognition", 3),
    (r"data science", 2),
    (r"cognitive computing", 4),
    (r"conversational ai", 5),
    (r"autonomous driving", 3),
    (r"self-driving", 3),
    (r"robotics", 2),
    (r"intelligent automation", 3),
)
_TALENT = r"(?:team|employees?|founders?|co-founders?|engineers?|researchers?|scientists?|technical talent|workforce)"
TALENT_JOIN = rf"\b{_TALENT}\b[^.!?]{{0,160}}?\b(?:join|joins|joined|joining|will join|become part of|move to|moving to)\b"
JOIN_TALENT = rf"\b(?:join|joins|joined|joining)\b[^.!?]{{0,160}}?\b{_TALENT}\b"
ACQUIHIRE = r"acqui-hire|acquire[- ]to[- ]hire|talent acquisition|hiring rather than|primarily for (?:its )?(?:team|talent|people)"
LICENSE_HIRE = r"licen[sc]e .{0,80}(?:and|plus) .{0,40}(?:hiring|offer[s]?\s+(?:roles|positions)|team)|(?:reverse acqui-hire|license-and-hire)"

# The coded attributes of a deal's architecture.
ATTRIBUTES = ("legal_transaction_form", "scope_and_control", "ip_treatment", "business_product_continuity", "workforce_movement", "talent_motive_explicit", "talent_salience_signal")
EVIDENCE_BASES = ("direct_passage", "inferred_from_legal_form", "unknown")
EVIDENCE_STATUSES = ("direct", "partial", "indirect", "unknown")
EXCERPT_KINDS = ("verbatim", "paraphrase")

# Lexicons of the wording metrics.
LEXICONS = {
    "positive": ("opportunity", "strength", "strengths", "success", "successful", "valuable", "innovation", "innovative", "growth", "support", "enhance", "leading"),
    "negative": ("risk", "risks", "loss", "losses", "failure", "disruption", "uncertainty", "adverse", "difficulty", "attrition", "departure", "departures"),
    "hedging": ("may", "might", "could", "approximately", "generally", "expected", "anticipated", "potential", "subject to"),
    "modality": ("shall", "must", "may", "will"),
    "protection_program": ("change in control", "change-of-control", "severance", "good reason", "protective period", "protected period", "double trigger", "outplacement", "garden leave"),
    "retention": ("retention", "retain", "retained", "remain employed", "continued employment", "continued service", "stay bonus", "transaction bonus", "retention award"),
    "pay_wages": ("salary", "salaries", "wages", "compensation", "bonus", "bonuses", "incentive", "payroll", "base pay"),
    "benefits": ("benefits", "health insurance", "pension", "401(k)", "welfare", "vacation", "severance benefits"),
    "equity_vesting": ("stock option", "stock options", "restricted stock", "restricted stock unit", "rsu", "rsus", "vesting", "vested", "forfeiture", "forfeited", "equity award", "conversion"),
    "termination_severance": ("termination", "terminated", "terminate", "without cause", "for cause", "resignation", "layoff", "layoffs", "reduction in force", "separation"),
    "employee_workforce": ("employee", "employees", "workforce", "personnel", "team members", "staff", "headcount"),
}
TONE_POSITIVE = tuple(
    "accelerate accelerated enhance enhanced favorable improve improved incentive incentives preserve preserved protect protected safeguard safeguarded security strengthen strengthened support supported welfare well-being bonus bonuses benefit benefits opportunity opportunities reward rewards advantage valuable successful continue continued continuity comparable equivalent".split()
)
TONE_NEGATIVE = tuple(
    "terminate terminated termination terminates forfeit forfeited forfeiture forfeits layoff layoffs discharge dismissed dismissal breach breaches violated violation violations liability liabilities loss losses failure fail adverse harm harmed impair impaired impairment risk risks threatened dispute disputes claim claims penalty penalties default divest divestiture discontinue discontinued reduce reduced reduction reductions eliminate eliminated conflict conflicts restrict restricted restriction restrictions prohibit prohibited noncompetition non-compete".split()
)
TONE_HEDGES = ("may", "might", "could", "approximately", "generally", "typically", "subject to", "to the extent", "deemed", "if any", "as applicable", "where appropriate", "reasonable efforts", "commercially reasonable", "best efforts", "material adverse effect")
TONE_NEGATIVE_OUTCOMES = ("termination of employment", "loss of employment", "layoff", "layoffs", "reduction in force", "workforce reduction", "discharge", "dismissal", "separation from employment", "departure", "cease to be employed", "ceases to be employed")
TONE_PROTECTIONS = ("retention", "retention bonus", "stay bonus", "transaction bonus", "severance", "continued employment", "continued service", "continuing employee", "continuing employees", "remain employed", "base salary", "welfare benefits", "employee benefit plan", "401(k)", "pension", "equity award", "restricted stock", "vesting", "acceleration", "outplacement", "transition assistance", "cobra")
