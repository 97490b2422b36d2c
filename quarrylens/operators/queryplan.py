"""From a question to retrieval jobs, by deterministic column rules.

Every classifier is a column function; a model may take its place by giving another function of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import periods
from quarrylens.functions.dims import SECTION_CUES

MAX_NAME_WORDS = 6
DEFAULT_TONE = "How did management speak about this subject, and what does it look forward to?"
# Cue words of the classifiers, as regular expressions over the lower-cased question.
COMPARISON_CUES = r"\b(compare|compared|versus|vs|vergleich\w*|compar\w*)\b"
CHANGE_CUES = r"\b(trend|trends|changed?|changes|evolution|evolve[ds]?|evolved|since|over \d+ (quarters|years))\b|evolucion|évolué|entwickelt"
BROAD_CUES = r"\b(summari[sz]e|summary|overview|main points|tell me about|everything|fasse|résume|resume)\b"
TRANSCRIPT_CUES = r"\b(call|calls|transcript|management|ceo|cfo|executive|executives|tone|sentiment|analyst|analysts|commentary|q&a|describe[ds]?)\b"
FILING_CUES = r"\b(10-k|10-q|8-k|risk factors?|md&a|filings?|financial statements?|balance sheet)\b"
TONE_CUES = [
    ("GUIDANCE", r"\b(outlook|guidance|forecast|strategy|future|expected|expect)\b", "What did management say about outlook and guidance, and how confident did they sound about the future?"),
    ("RISKS", r"\b(risks?|uncertaint\w+|headwinds?|concerns?|issues?|incidents?)\b", "Did management express concerns about risks or headwinds that could affect the future?"),
    ("METRICS", r"\b(revenue|margins?|growth|volumes?|segments?|profit\w*|cash flow|turnover|spending|headcount|debt|tax rate)\b", "What was management's tone about results, and what drivers did they highlight?"),
]
GENERAL_TONE = "What was management's overall tone about the business and its outlook?"


def words(q: Column) -> Column:
    """Words of a-z and 0-9 in lower case, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(q, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def years(q: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(words(q), lambda w: w.rlike("^(19|20)[0-9]{2}$")), lambda w: w.cast("int"))))


def quarters(q: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(words(q), lambda w: w.rlike("^q[1-4]$")), F.upper)))


def filing_hint(q: Column) -> Column:
    """10-Q if a quarter is meant, else 10-K if a year is, else UNKNOWN."""
    by_quarter = (F.size(quarters(q)) > 0) | F.coalesce(F.lower(q).rlike(r"\bquarter(s|ly)?\b"), F.lit(False))
    by_year = (F.size(years(q)) > 0) | F.coalesce(F.lower(q).rlike(r"\b(fy|annual(ly)?|yearly)\b"), F.lit(False))
    return F.when(by_quarter, "10-Q").when(by_year, "10-K").otherwise("UNKNOWN")


def section_hints(q: Column, most: int = 4) -> Column:
    """Headings that the question's words point to, most telling first; the broadest one where none does."""
    low = F.coalesce(F.lower(q), F.lit(""))
    found = F.filter(F.array(*[F.when(low.rlike(cue), F.lit(heading)) for cue, heading in SECTION_CUES]), lambda h: h.isNotNull())
    found = F.slice(F.array_distinct(found), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("management discussion and analysis of financial condition and results of operations")))


def named(questions: DataFrame, companies: DataFrame, id_col: str = "q_id", q_col: str = "q") -> DataFrame:
    """id, tickers: the companies that a question names, in order of first mention (the longer name first at one place).

    Runs of up to six words are matched to synonyms by an equi-join; no question is compared with every name. Unnamed questions
    are left out. The synonyms are a few for each company and are broadcast only if small, by their own statistics.
    """
    syn = companies.select("ticker", F.explode(F.concat("synonyms", F.array(F.lower("ticker"), "canonical_name", "display_name"))).alias("s"))
    syn = syn.select("ticker", F.array_join(words(F.col("s")), " ").alias("gram")).filter("gram <> ''").distinct()
    w = questions.select(F.col(id_col).alias("_id"), words(F.col(q_col)).alias("w"))
    grams = w.select("_id", F.posexplode("w").alias("at", "_"), "w").select(
        "_id", "at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(MAX_NAME_WORDS)), lambda n: F.when(F.col("at") + n <= F.size("w"), F.array_join(F.slice("w", F.col("at") + 1, n), " ")))).alias("gram")
    )
    hits = grams.filter("gram IS NOT NULL").join(syn, "gram").groupBy("_id", "ticker").agg(F.min("at").alias("at"), F.max(F.length("gram")).alias("n"))
    order = F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("n"), "ticker")))
    return hits.groupBy("_id").agg(F.transform(order, lambda x: x["ticker"]).alias("tickers")).withColumnRenamed("_id", id_col)


def parsed(questions: DataFrame, companies: DataFrame, id_col: str = "q_id", q_col: str = "q") -> DataFrame:
    """questions with tickers, years, quarters, filing_type_hint and section_hints. Ids have to be unique."""
    q = F.col(q_col)
    none = F.array().cast("array<string>")
    p = questions.join(named(questions, companies, id_col, q_col), id_col, "left").withColumn("tickers", F.coalesce("tickers", none))
    return p.withColumns({"years": years(q), "quarters": quarters(q), "filing_type_hint": filing_hint(q), "section_hints": section_hints(q)})


def query_type(q: Column, tickers: Column, years_: Column) -> Column:
    low = F.coalesce(F.lower(q), F.lit(""))
    return (
        F.when((F.size(tickers) == 0) & (F.size(years_) == 0), "GENERAL")
        .when(low.rlike(COMPARISON_CUES) | (F.size(tickers) > 1), "COMPARISON")
        .when(low.rlike(CHANGE_CUES), "CHANGE_DETECTION")
        .when(low.rlike(BROAD_CUES), "BROAD")
        .otherwise("SIMPLE")
    )


def source(q: Column) -> Column:
    low = F.coalesce(F.lower(q), F.lit(""))
    return F.when(low.rlike(TRANSCRIPT_CUES) & ~low.rlike(FILING_CUES), "TRANSCRIPT").otherwise("SEC")


def tone(q: Column) -> tuple[Column, Column]:
    """(focus, one retrieval question about management's tone); a blank question gets the default."""
    low = F.coalesce(F.lower(q), F.lit(""))
    focus, ask = F.lit("GENERAL"), F.lit(GENERAL_TONE)
    for name, cue, text in reversed(TONE_CUES):
        focus, ask = F.when(low.rlike(cue), name).otherwise(focus), F.when(low.rlike(cue), text).otherwise(ask)
    return focus, F.when(F.trim(low) == "", DEFAULT_TONE).otherwise(ask)


def valid_sub_queries(raw: Column, fallback: Column, least: int = 2, most: int = 5) -> Column:
    """White space collapsed; empty ones dropped; the first of those that differ in case only; fewer than two give the fallback;
    at most five."""
    flat = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^ | $", ""))
    flat = F.filter(flat, lambda s: s.isNotNull() & (s != ""))
    once = F.aggregate(flat, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda t: F.lower(t) == F.lower(s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.when(F.size(once) < least, F.array(fallback)).otherwise(F.slice(once, 1, most))


def decomposed(p: DataFrame, q_col: str = "q") -> DataFrame:
    """p (parsed() with query_type) with sub_queries: every company with every period for BROAD and COMPARISON, else the question."""
    topic = F.element_at("section_hints", 1)
    labels = periods.labels(F.col("years"), F.col("quarters"))
    labels = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("")))
    who = F.when(F.size("tickers") > 0, F.col("tickers")).otherwise(F.array(F.lit("")))
    every = F.flatten(F.transform(who, lambda t: F.transform(labels, lambda x: F.concat_ws(" ", F.nullif(t, F.lit("")), F.nullif(x, F.lit("")), topic))))
    wide = F.col("query_type").isin("BROAD", "COMPARISON")
    return p.withColumn("sub_queries", F.when(wide, valid_sub_queries(every, F.col(q_col))).otherwise(F.array(q_col)))


def retrieval_jobs(p: DataFrame, companies: DataFrame, id_col: str = "q_id", q_col: str = "q") -> DataFrame:
    """q_id, job_no, q, ticker, periods, forms, headings: one job for each sub-query. What the sub-query leaves open is taken from
    the question; only the first company counts; an unknown form means both."""
    base = [F.col(c).alias(f"b_{c}") for c in ("tickers", "years", "quarters", "filing_type_hint", "section_hints")]
    subs = decomposed(p, q_col).select(id_col, *base, F.posexplode("sub_queries").alias("job_no", "sub_q")).withColumn("job_no", F.col("job_no") + 1)
    subs = subs.withColumn("_job", F.concat_ws("|", F.col(id_col).cast("string"), F.col("job_no").cast("string")))
    j = parsed(subs, companies, "_job", "sub_q")
    forms = lambda hint, other: F.when(hint == "10-Q", F.array(F.lit("10-Q"))).when(hint == "10-K", F.array(F.lit("10-K"))).otherwise(other)
    both = F.array(F.lit("10-Q"), F.lit("10-K"))
    own, of_base = periods.labels(F.col("years"), F.col("quarters")), periods.labels(F.col("b_years"), F.col("b_quarters"))
    first = lambda a: F.when(F.size(a) > 0, F.element_at(a, 1))
    return j.select(
        id_col, "job_no", F.col("sub_q").alias("q"), F.coalesce(first(F.col("tickers")), first(F.col("b_tickers"))).alias("ticker"), F.when(F.size(own) > 0, own).otherwise(of_base).alias("periods"),
        forms(F.col("filing_type_hint"), forms(F.col("b_filing_type_hint"), both)).alias("forms"), F.when(F.size("section_hints") > 0, F.col("section_hints")).otherwise(F.col("b_section_hints")).alias("headings"),
    )


def filled_from_history(turns: DataFrame, columns: list[str], conversation: str = "conversation_id", turn: str = "turn_id") -> DataFrame:
    """turns whose null columns take the conversation's last value before; a first turn stays as it is."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumns({f"{c}_filled": F.last(c, ignorenulls=True).over(w) for c in columns})


def completed_question(q: Column, tickers: Column, years_: Column, before_ticker: Column, before_period: Column) -> Column:
    """The question with the company and period of the conversation so far, where it names none itself; null stays null."""
    who = F.when((F.size(tickers) == 0) & before_ticker.isNotNull(), F.concat(F.lit("for "), before_ticker))
    when = F.when((F.size(years_) == 0) & before_period.isNotNull(), F.concat(F.lit("in "), before_period))
    return F.when(q.isNotNull(), F.concat_ws(" ", q, who, when))
