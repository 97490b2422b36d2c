"""Safety and quality gates and the routes that follow from them, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.operators.search import words_of

FAITHFUL, RELEVANT, MAX_RETRIES = 0.50, 0.50, 3
# Cues of the rule-based classifiers, as regular expressions over the lower-cased text.
HARM_CUES = r"\b(kill|bomb|murder|suicide|self-harm|terroris\w+|malware|ransomware|phishing|steal|blackmail|counterfeit|cocaine|heroin)\b"
SMALL_TALK_CUES = r"^\W*(hi|hello|hey|thanks|thank you|good (morning|evening)|how are you)\W*$"
ADVICE_ASK_CUES = r"\b(should i (buy|sell|hold)|best stocks?|what (stock|shares?) (should|to)|price target|guaranteed (profit|returns?)|invest in)\b"
PERSONAL_CUES = r"\b(who (made|built|developed|owns) you|your (developer|source code|system prompt|architecture))\b"
FINANCE_CUES = r"\b(10-k|10-q|filings?|revenue|margin|cash flow|debt|tax|headcount|inventory|risk|guidance|quarters?|expenditure|reserves?|spending|exchange|supply chain|cybersecurity|segments?|turnover|covenants?|q[1-4]|(19|20)\d\d)\b|q[1-4]_"
ADVICE_GIVEN_CUES = r"\b((you should|i recommend|we recommend|i suggest) .{0,40}(buy|sell|hold|short)|strong (buy|sell)|guaranteed (profit|returns?)|buy this stock|sell this stock)\b"
TEXTS = {
    "query_harmful": "This question can't be taken up here: it is unsafe, or it is no question about companies and their filings.",
    "response_harmful": "The answer that was found did not pass our checks and is held back. Asking in other words may help.",
    "no_company": "No company of this name or ticker is among the filings here. Is it spelled as it is listed?",
    "research_fail": "Nothing in the filings matches this question. A company, a period or a section would narrow it down.",
}


def _like(text: Column, cue: str) -> Column:
    return F.coalesce(F.lower(text), F.lit("")).rlike(cue)


def harmful(text: Column) -> Column:
    return _like(text, HARM_CUES)


def input_class(text: Column) -> Column:
    return (
        F.when(_like(text, SMALL_TALK_CUES), "SMALL_TALK")
        .when(_like(text, PERSONAL_CUES), "PERSONAL_INFO")
        .when(_like(text, ADVICE_ASK_CUES), "INVESTMENT_ADVICE_REQUEST")
        .when(_like(text, FINANCE_CUES), "FINANCE_RESEARCH_OK")
        .otherwise("OUT_OF_SCOPE")
    )


def input_fails(text: Column) -> Column:
    return harmful(text) | (input_class(text) != "FINANCE_RESEARCH_OK")


def gives_advice(text: Column) -> Column:
    return _like(text, ADVICE_GIVEN_CUES)


def output_fails(text: Column) -> Column:
    return harmful(text) | gives_advice(text)


def containment(part: Column, whole: Column) -> Column:
    """Share of part's words that whole has; 0 without words. The offline stand-in for a judge."""
    p = words_of(part)
    return F.when(F.size(p) > 0, F.size(F.array_intersect(p, words_of(whole))) / F.size(p)).otherwise(0.0)


def faithfulness(answer: Column, context: Column) -> Column:
    return containment(answer, context)


def relevancy(question: Column, answer: Column) -> Column:
    return containment(question, answer)


def passes(faith: Column, relevant: Column) -> Column:
    """Both at their threshold or above; null scores fail."""
    return F.coalesce((faith >= FAITHFUL) & (relevant >= RELEVANT), F.lit(False))


def needs_refinement(companies: Column, years: Column, quarters: Column) -> Column:
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    return (n(companies) <= 0) | ((n(years) <= 0) & (n(quarters) <= 0))


def sufficient(n_chunks: Column) -> Column:
    return F.coalesce(n_chunks, F.lit(0)) >= 1


def after_research(enough: Column, retries: Column) -> Column:
    return F.when(enough, "exit").when(retries >= MAX_RETRIES, "fail").otherwise("retry")


def after_audit(auditor_fail: Column, ok: Column, retries: Column) -> Column:
    """fail, accept, retry, or exhausted (answers all the same)."""
    return F.when(auditor_fail, "fail").when(ok, "accept").when(F.coalesce(retries, F.lit(0)) < MAX_RETRIES, "retry").otherwise("exhausted")


def retriever(query_type: Column) -> Column:
    t = F.upper(query_type)
    return F.when(t == "SIMPLE", "simple").when(t.isin("BROAD", "COMPARISON"), "multi").when(t == "CHANGE_DETECTION", "path").otherwise("none")


def final_text(query_harmful: Column, response_harmful: Column, auditor_fail: Column, n_companies: Column, research_fail: Column, sec: Column, call: Column) -> Column:
    """The supervisor's answer by priority; null while there is nothing to say."""
    sections = F.concat_ws("\n\n---\n\n", F.when(sec != "", F.concat(F.lit("## From the filings\n\n"), sec)), F.when(call != "", F.concat(F.lit("## From the calls\n\n"), call)))
    return (
        F.when(query_harmful & auditor_fail, TEXTS["query_harmful"])
        .when(response_harmful & auditor_fail, TEXTS["response_harmful"])
        .when(n_companies == 0, TEXTS["no_company"])
        .when(research_fail, TEXTS["research_fail"])
        .otherwise(F.nullif(sections, F.lit("")))
    )
