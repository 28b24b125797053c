"""What reports check and print: claim and passage lints, quotations, tables, pictures."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.rules import all_matches, bound

# Patterns of claims that prose must not make, and of a negation before them.
CLAIMS = (
    ("causal", r"\b(?:causes?|caused|causing|drives?|drove|leads? to|led to|results? in|is responsible for)\b"),
    ("predictive", r"\b(?:predicts?|predicted|predictive of|forecasts?|forecasted|reliably maps? to|determines? (?:the )?outcome)\b"),
    ("actual_retention", r"\b(?:actual retention|employees? (?:were|are|will be) retained|workers? (?:stayed|remained)|retention(?: program)? (?:succeeded|worked|failed)|kept (?:its|the|their) employees?)\b"),
    ("unsupported_certainty", r"\b(?:proves?|proved|demonstrates? that)\b"),
)
NEGATION = r"\b(?:no|not|never|cannot|can't|doesn't|does not|do not|did not|without)\b"
# Patterns of the passage lint.
LINT = {
    "language": r"\b(?:employee|employees|employment|worker|workers|retention|retain|retained|bonus|benefit|benefits|severance|equity|stock options?|restricted stock|rsus?|award|awards|vesting|vested|continued service|salary|salaries|wage|wages|incentive|incentives|termination|terminated|key personnel)\b",
    "action": r"\b(?:shall|will|must|receive|eligible|continue|remain|vest|vested|convert|converted|pay|paid|provide|provides|provided|terminate|terminated|assume|assumed|retain|retained|forfeited|accelerate|accelerated|describes?|outlines?|applies?|requires?|excludes?)\b",
    "call": r"\b(?:we lost you|can you hear|conference call|question-and-answer session|good (?:morning|afternoon)|thank you,? operator)\b",
    "accounting": r"\b(?:stock-based compensation|share-based compensation|compensation expense|non-gaap|gaap|in millions|fiscal quarter|q[1-4])\b",
    "accounting_report": r"\b(?:non-gaap|non-cash expenses?|compensation expense|excluding stock-based|valuation methodologies|subjective assumptions|fiscal quarter|income statement|adjusted ebitda|depreciation and amortization|provision for income taxes|effective tax rate|net income before)\b",
    "arrangement_detail": r"\b(?:employee|employment|retention|bonus|benefit|severance|vesting|vested|award|option|rsu|eligible|receive|converted|continued service|termination)\b",
    "title": r"\b(?:name:|title:|address:|chief executive officer|chief financial officer)\b",
    "privacy": r"\b(?:privacy|personal data|intellectual property|confidential information|data retention|records retention|proprietary information|trade secrets?)\b",
    "arrangement": r"\b(?:employment agreement|retention (?:bonus|pool|award)|transaction bonus|severance|salary|salaries|wages?|incentives?|continued service|employee compensation)\b",
    "equity_subject": r"\b(?:stock options?|restricted stock(?: units?)?|rsus?|equity awards?|performance(?:-based)? restricted stock units?|psus?)\b",
    "equity_treatment": r"\b(?:vest|vested|unvested|vesting|convert|converted|exchange|receive|cash|exercise price|withholding|tax(?:es|able)?|responsibilit(?:y|ies)|treatment)\b",
    "benefit": r"(?:\b(?:employee|employees|worker|workers|executive|executives|personnel|you|your)\b.{0,80}\b(?:benefits?|bonuses?|compensation|incentives?)\b|\b(?:benefits?|bonuses?|compensation|incentives?)\b.{0,80}\b(?:employee|employees|worker|workers|executive|executives|personnel|you|your)\b|\bcontinue on .{0,30}\bbenefits?\b)",
    "retain_use": r"(?:\bretain(?:ed|s|ing)?\b.{0,45}\b(?:records?|documents?|data|information|copies|rights?|title|ownership|possession|jurisdiction|counsel|control|players?|customers?|presence|offices?|business|market share|products?|services?)\b|\b(?:records?|documents?|data|information|copies|rights?|title|ownership|possession|jurisdiction|counsel|control|players?|customers?|presence|offices?|business|market share|products?|services?)\b.{0,45}\bretain(?:ed|s|ing)?\b)",
    "human": r"\b(?:employee|employees|worker|workers|executive|executives|founder|founders|personnel)\b",
    "risk": r"\b(?:risk that|adverse (?:effect|changes?)|disruptions?(?: to)?|forward-looking statements?|impact of announcement|announcement and pendency|relationships? with (?:their|our) (?:respective )?(?:customers|partners|suppliers))\b",
    "deal_action": r"\b(?:upon closing|will receive|converted|exercise price|vested|vesting|eligible|severance|retention (?:bonus|pool|award)|continued service)\b",
    "party_list": r"\b(?:limitation on liability|commitment parties|related person|permitted liens|representatives and agents|worker'?s compensation laws|unemployment insurance laws)\b",
    "metric": r"\b(?:net retention rate|quarter revenue|financial results|year-over-year|quarter-over-quarter|adjusted ebitda|effective tax rate)\b",
    "deal_context": r"\b(?:merger|acquisition|transaction|combination|upon closing|at closing|post-closing|prior to (?:the )?close|effective time|continuing employees?|key employees?|converted parent|assumed rsu|change in control)\b",
    "high_signal": r"\b(?:retention (?:bonus|pool|award)|transaction bonus|key employees? (?:receive|must remain))\b",
    "definition": r"\b(?:means any|shall mean|as defined in|representative means|proxy solicitation|solicitation of proxies|proxy card|vote your shares|beneficial owner)\b",
    "litigation": r"\b(?:litigation|lawsuit|legal proceeding|claims? against|civil rights|employment discrimination laws?)\b",
    "counsel": r"\b(?:interests? of .{0,40}(?:directors?|executive officers?)|may be different from,? or in addition to|serves as counsel to|currently serves as counsel|attorney-client privilege|negotiation, preparation, execution)\b",
    "valuation": r"\b(?:shares? of common stock multiplied by|aggregate value|merger consideration of \$?[\d,.]+ per share)\b",
    "number": r"\$?\d[\d,]*(?:\.\d+)?%?|—",
    "word": r"(?U)\b[\w'’-]+\b",
}


def passage_lint(text: Column, heading: Column | None = None) -> Column:
    """Why a passage should not stand for a topic: every reason that holds, in order; empty for a substantive one."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    whole = body if heading is None else F.trim(F.concat_ws(" ", F.coalesce(heading, F.lit("")), body))
    return bound(F.struct(body.alias("body"), whole.alias("whole")), lambda t: _lint(t["body"], t["whole"]))


def _lint(body: Column, whole: Column) -> Column:
    """The reasons of ``passage_lint``; what several of them need is found once, the rest only where its rule comes to it."""
    b, w = (lambda key: body.rlike(f"(?i){LINT[key]}")), (lambda key: whole.rlike(f"(?i){LINT[key]}"))
    words, numbers = F.regexp_count(body, F.lit(LINT["word"])), F.regexp_count(body, F.lit(LINT["number"]))
    arranged = b("arrangement") | b("benefit") | (b("equity_subject") & b("equity_treatment"))
    shared = {"words": words, "numbers": numbers, "signal": w("high_signal"), "acts": b("deal_action"), "arranged": arranged, "human": b("human"), "action": b("action")}

    def reasons(x: Column) -> Column:
        words, numbers, signal, acts, arranged, human, action = (x[k] for k in shared)
        return all_matches(
            [
                ("too_short", (words < 12) & ~signal),
                ("call_transcript_noise", w("call")),
                ("generic_accounting_noise", w("accounting_report") | (w("accounting") & ~b("arrangement_detail"))),
                ("title_or_contact_block", ~action & w("title")),
                ("privacy_or_ip_noise", w("privacy")),
                ("non_human_retain_use", ~human & w("retain_use")),
                ("generic_risk_boilerplate", ~arranged & w("risk")),
                ("generic_legal_boilerplate", ~acts & w("party_list")),
                ("generic_financial_metric", ~acts & w("metric")),
                ("definition_or_proxy_noise", w("definition")),
                ("generic_litigation_language", ~acts & w("litigation")),
                ("proxy_interest_or_counsel_noise", w("counsel")),
                ("aggregate_securities_valuation", ~human & w("valuation")),
                ("no_employee_arrangement_evidence", ~arranged & ~signal),
                ("no_human_capital_subject", ~human & ~arranged),
                ("no_acquisition_employee_context", ~signal & ~w("deal_context")),
                ("numeric_table_noise", (numbers >= 8) & (numbers > words / 3) & ~acts),
                ("no_substantive_employee_language", ~w("language")),
                ("no_substantive_action", ~action & ~signal),
            ]
        )

    return bound(F.struct(*(v.alias(k) for k, v in shared.items())), reasons)


def representatives(assigned: DataFrame, topic: str, ident: str, text: str, weight: str, *, heading: str | None = None, most: int = 3) -> DataFrame:
    """The best primary passages of each topic that no lint holds against: longer ones first (up to 120 words), then heavier, then by id."""
    clean = assigned.where(F.col("primary_topic") & (F.size(passage_lint(F.col(text), None if heading is None else F.col(heading))) == 0))
    length = F.least(F.regexp_count(F.col(text), F.lit(LINT["word"])), F.lit(120))
    order = Window.partitionBy(topic).orderBy(F.desc("_length"), F.desc(weight), ident)
    rows = clean.withColumn("_length", length).dropDuplicates([topic, ident])
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_length")


def claim_issues(text: str) -> list[tuple[str, str, str]]:
    """(category, phrase, sentence) of claims in prose that go beyond description; quoted lines and negated claims are left out."""
    prose = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith(">"))
    found = []
    for sentence in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", prose))):
        for category, pattern in CLAIMS:
            for m in re.finditer(pattern, sentence, re.IGNORECASE):
                if not re.search(NEGATION, sentence[max(0, m.start() - 60) : m.start()], re.IGNORECASE):
                    found.append((category, m[0], sentence))
    return found


def claim_lint(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, category, n): claims by category in each row's prose; ``claim_issues`` at scale."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: ~F.ltrim(line).startswith(">"))
    parts = F.flatten(F.transform(lines, lambda line: F.split(line, r"(?<=[.!?])\s+")))
    per = rows.select(ident, F.explode(parts).alias("s"))
    # a claim counts unless a negation stands in the 60 characters before it; each search begins where the last one ended,
    # so a sentence is read once, and only the last 60 characters of what was read are carried on
    counts = []
    for category, pattern in CLAIMS:
        found = [F.regexp_extract_all("s", F.lit(rf"(?is)\G(.*?)(?:{pattern})"), F.lit(k)) for k in (0, 1)]
        pairs = F.zip_with(*found, lambda whole, gap: F.struct(whole.alias("whole"), gap.alias("gap")))
        none = F.struct(F.lit("").alias("before"), F.lit(0).alias("n"))
        free = lambda seen, p: (~F.right(F.concat(seen["before"], p["gap"]), F.lit(60)).rlike(f"(?i){NEGATION}")).cast("int")
        step = lambda seen, p: F.struct(F.right(F.concat(seen["before"], p["whole"]), F.lit(60)).alias("before"), (seen["n"] + free(seen, p)).alias("n"))  # noqa: E731, B023
        n = F.when(F.col("s").rlike(f"(?i){pattern}"), F.aggregate(pairs, none, step, lambda seen: seen["n"])).otherwise(0)
        counts.append(F.struct(F.lit(category).alias("category"), n.alias("n")))
    return per.select(ident, F.inline(F.filter(F.array(*counts), lambda c: c["n"] > 0))).groupBy(ident, "category").agg(F.sum("n").alias("n"))


def unlinked_claims(markdown: str, deals: Sequence[str], host: str, zero_state: str) -> list[tuple[str, str]]:
    """(deal, line) of lines that name a deal without a link to the host; quoted lines and the zero state are no claims."""
    linked = lambda line: any(re.match(rf"https://(?:[\w-]+\.)*{re.escape(host)}(?:[/?#]|$)", u) for u in re.findall(r"\]\((https://[^)]+)\)", line))
    lines = [line for line in markdown.splitlines() if line.strip() and not line.lstrip().startswith(">") and zero_state not in line and not linked(line)]
    return [(d, line) for line in lines for d in sorted(deals) if d in line]


def plain_number(value: Column) -> Column:
    """Up to ten significant digits without trailing zeros; blank for null."""
    shown = F.format_string("%.10f", value.cast("double"))
    return F.coalesce(F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit(""))


def percent(value: Column, digits: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f%%", value.cast("double") * 100), F.lit(""))


def table_cell(value: Column) -> Column:
    """Text that can't break a Markdown table."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")


def markdown_table(rows: DataFrame, *, most: int = 1000) -> str:
    """A Markdown table of a small frame (``most`` rows are the report's bound)."""
    found = rows.select(*(table_cell(F.col(c)).alias(c) for c in rows.columns)).limit(most).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in found]) + "\n"


def heatmap_svg(cells: Sequence[tuple[str, str, float]], *, size: int = 24) -> str:
    """(row, column, share from 0 to 1) as an SVG grid, darker for more."""
    rows, columns = (sorted({c[k] for c in cells}) for k in (0, 1))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{160 + size * len(columns)}" height="{40 + size * len(rows)}" font-size="11">']
    out += [f'<text x="{160 + size * k}" y="28">{html.escape(c)}</text>' for k, c in enumerate(columns)]
    out += [f'<text x="4" y="{56 + size * k}">{html.escape(r)}</text>' for k, r in enumerate(rows)]
    for r, c, v in sorted(cells):
        shade = 255 - round(200 * min(1.0, max(0.0, v)))
        out.append(f'<rect x="{160 + size * columns.index(c)}" y="{40 + size * rows.index(r)}" width="{size}" height="{size}" fill="rgb({shade},{shade},255)"><title>{html.escape(r)}, {html.escape(c)}: {v:.3f}</title></rect>')
    return "\n".join([*out, "</svg>"])


def cloud_svg(words: Sequence[tuple[str, int]], *, width: int = 640, height: int = 400, palette: Sequence[str] = ("#2b6cb0", "#2f855a", "#b7791f", "#9b2c2c", "#6b46c1", "#2c7a7b", "#d69e2e")) -> str:
    """Words sized by the root of their counts along a spiral, the same for the same words; those without room are left to the table."""
    most = max((n for _, n in words), default=1)
    placed: list[tuple[float, float, float, float]] = []
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" text-anchor="middle">']
    for word, n in sorted(words, key=lambda p: (-p[1], p[0])):
        font = 12 + 36 * math.sqrt(n / most)
        w, h = 0.6 * font * len(word), 1.1 * font
        for step in range(2000):
            x, y = width / 2 + 2 * math.sqrt(step) * math.cos(0.4 * step), height / 2 + 1.4 * math.sqrt(step) * math.sin(0.4 * step)
            box = (x - w / 2, y - h / 2, x + w / 2, y + h / 2)
            if box[0] < 0 or box[1] < 0 or box[2] > width or box[3] > height:
                continue
            if all(box[2] <= p[0] or box[0] >= p[2] or box[3] <= p[1] or box[1] >= p[3] for p in placed):
                placed.append(box)
                color = palette[int(hashlib.sha256(word.encode()).hexdigest(), 16) % len(palette)]
                out.append(f'<text x="{x:.1f}" y="{y + font / 3:.1f}" font-size="{font:.1f}" fill="{color}">{html.escape(word)}</text>')
                break
    return "\n".join([*out, "</svg>"])
