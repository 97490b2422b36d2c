"""A question from text to answer: gate, history, parse, reuse or retrieval, context, extractive answer, gate; control flow on the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import periods
from quarrylens.operators import audit, context, graph, memory, queryplan, search

CALL_HITS, CALL_CANDIDATES = 5, 150
TYPES = ("SIMPLE", "BROAD", "COMPARISON", "CHANGE_DETECTION")
# how an answer of each type begins; the companies are put in
LEADS = {
    "SIMPLE": "",
    "BROAD": "Overview of {0}, question by question:\n\n",
    "COMPARISON": "Compared, company by company: {0}\n\n",
    "CHANGE_DETECTION": "From the first period to the last, {0}:\n\n",
}


@dataclass
class Tables:
    """What a session works on; all lazily planned."""

    companies: DataFrame  # ticker, display_name, canonical_name, synonyms
    parents: DataFrame  # graph.sec_parents()
    hierarchy: DataFrame  # graph.sec_hierarchy() with embedding
    chain: DataFrame  # graph.filing_chain()
    embed: Callable[[str], list[float]] | None = None
    transcripts: DataFrame | None = None  # graph.transcript_hierarchy(), with embedding where embed is given
    turns: DataFrame | None = None  # earlier turns, with the columns of conversation_turns
    write: Callable[[str, str, int], str] | None = None  # (question, evidence, failed tries) -> answer; the evidence itself unless given
    parse: Callable[[DataFrame, DataFrame], DataFrame] | None = None  # (questions, companies) -> parsed rows; queryplan.parsed unless given
    judge: Callable[[str, str, str], tuple[float, float]] | None = None  # (question, answer, evidence) -> faithfulness, relevancy; by words unless given
    memory_path: str | None = None  # where finished turns of a conversation are appended


@dataclass
class Turn:
    question: str
    asked: str = ""  # the question with what the conversation adds
    query_type: str = "SIMPLE"
    tickers: list[str] = field(default_factory=list)
    retries: int = 0
    n_hits: int = 0
    n_calls: int = 0
    reuse_id: str | None = None
    analysis_retries: int = 0
    faithful: float | None = None
    relevant: float | None = None
    answer: str = ""
    route: str = ""
    messages: list[str] = field(default_factory=list)


def hits_of(t: Tables, jobs: list, query_type: str, question: str, k: int = 10) -> DataFrame | None:
    """Hits of one question by its type with n, their order; None where nothing is to be retrieved. A change walk is given whole,
    in order of time; the other types have a budget for each job."""
    spark = t.companies.sparkSession
    names = names_of(t, [j.ticker for j in jobs])
    if query_type == "CHANGE_DETECTION":
        j = jobs[0]
        if not j.periods or j.ticker not in names:
            return None
        lo, hi = periods_in_order(spark, list(j.periods))
        walk = search.keep_first(graph.change_walk(t.parents, t.chain, names[j.ticker], lo, hi, list(j.headings)), "parent_id", ["seq", "heading"])
        return walk.withColumn("n", F.struct("seq", "heading", "parent_id"))
    if query_type not in TYPES:
        return None
    budget = k if query_type == "SIMPLE" else 3
    parts = []
    for j in jobs:  # at most five by the validation of sub-queries
        cond = graph.matches(names.get(j.ticker), list(j.periods), list(j.forms), list(j.headings))
        if t.embed is not None:
            near = search.filtered_top_k(t.hierarchy, t.embed(question), k, cond, "post", k * search.CANDIDATES_PER_HIT, "child_id")
        else:
            near = t.hierarchy.filter(cond).withColumn("score", search.lexical_score(F.lit(j.q), F.col("child_text"))).orderBy(F.desc("score"), "child_id").limit(k)
        near = search.keep_first(near.withColumn("id", F.col("child_id")), "id", [F.desc("score")])
        parts.append(search.rerank(near.withColumn("q", F.lit(j.q)), budget).withColumn("job_no", F.lit(j.job_no)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("n", F.struct("job_no", "rerank"))


def periods_in_order(spark, labels: list[str]) -> tuple[str, str]:
    r = spark.range(1).select(*[x.alias(n) for n, x in zip(("lo", "hi"), graph.period_bounds(F.array(*[F.lit(p) for p in labels])))]).first()
    return r.lo, r.hi


def names_of(t: Tables, tickers: list) -> dict[str, str]:
    return {r.ticker: r.display_name for r in t.companies.filter(F.col("ticker").isin([x for x in tickers if x])).select("ticker", "display_name").collect()}


def calls_of(t: Tables, jobs: list, query_type: str, question: str) -> DataFrame | None:
    """Hits in the transcripts with n, their order: five for a simple question or a change, two for each job of the other types,
    by the question about tone. With vectors the 150 nearest children are taken first and filtered then, so there may be fewer."""
    if t.transcripts is None or query_type not in TYPES or (query_type == "CHANGE_DETECTION" and not jobs[0].periods):
        return None
    one = query_type in ("SIMPLE", "CHANGE_DETECTION")
    jobs = jobs[:1] if one else jobs
    names = names_of(t, [j.ticker for j in jobs])
    asked = t.companies.sparkSession.createDataFrame([(j.job_no, question if one else j.q) for j in jobs], "job_no int, q string")
    tones = {r.job_no: r.tone for r in asked.select("job_no", queryplan.tone(F.col("q"))[1].alias("tone")).collect()}
    out = None
    for j in jobs:
        ask, cond = tones[j.job_no], graph.matches(names.get(j.ticker), list(j.periods))
        if t.embed is not None:
            near = search.filtered_top_k(t.transcripts, t.embed(ask), CALL_HITS, cond, "post", CALL_CANDIDATES, "child_id")
        else:
            near = t.transcripts.filter(cond).withColumn("score", search.lexical_score(F.lit(ask), F.col("child_text"))).orderBy(F.desc("score"), "child_id").limit(CALL_HITS)
        near = search.keep_first(near.withColumn("id", F.col("child_id")), "id", [F.desc("score")])
        part = search.rerank(near.withColumn("q", F.lit(ask)), CALL_HITS if one else 2, text="child_text").withColumn("job_no", F.lit(j.job_no))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("n", F.struct("job_no", "rerank"))


def completed(t: Tables, before: DataFrame, p: DataFrame) -> str | None:
    """The question of p with the last company and period of the conversation, where it lacks one."""
    m = F.col("parsed_metadata")
    b = before.select("turn_id", F.try_element_at(m["companies"], F.lit(1))["ticker"].alias("ticker"), F.try_element_at(periods.labels(m["years"], m["quarters"]), F.lit(-1)).alias("period"))
    last = b.agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn_id"))).alias(c) for c in ("ticker", "period")]).first()
    return p.select(queryplan.completed_question(F.col("q"), F.col("tickers"), F.col("years"), F.lit(last.ticker).cast("string"), F.lit(last.period).cast("string")).alias("q")).first().q


def reuse_of(t: Tables, before: DataFrame, p: DataFrame, question: str) -> str | None:
    """The id of the earlier turn whose context serves again."""
    if t.embed is None:
        return None
    me, row = uuid.uuid4().hex, p.select("tickers").first()
    names = names_of(t, row.tickers)
    companies = F.array(*[F.struct(F.lit(x).alias("ticker"), F.lit(names.get(x)).alias("name")) for x in row.tickers])
    meta = F.struct(companies.alias("companies"), "years", "quarters", "filing_type_hint", "section_hints")
    kinds = {c: before.schema[c].dataType for c in ("conversation_id", "turn_id", "parsed_metadata", "embedding")}
    vec = F.array(*[F.lit(float(x)) for x in t.embed(question)])
    now = p.select(F.lit(me).alias("id"), F.lit("").cast(kinds["conversation_id"]).alias("conversation_id"), F.lit(2**31 - 1).cast(kinds["turn_id"]).alias("turn_id"), meta.cast(kinds["parsed_metadata"]).alias("parsed_metadata"), vec.cast(kinds["embedding"]).alias("embedding"))
    both = before.select("id", F.lit("").alias("conversation_id"), "turn_id", "parsed_metadata", "embedding").unionByName(now)
    found = memory.reusable(both).filter(F.col("id") == me).first()
    return found.reuse_id if found else None


def _with_whole(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows by child_id: the children, and the parents under their own id."""
    same = [c for c in children.columns if c in parents.columns and c not in ("child_id", "child_text", "embedding")]
    return children.select("child_id", *same).unionByName(parents.select(F.col("parent_id").alias("child_id"), *same))


def _cited(before: DataFrame, reuse_id: str, column: str, rows: DataFrame) -> DataFrame:
    """The rows that a turn cites, a child or a whole parent, in the turn's order."""
    c = before.filter(F.col("id") == reuse_id).select(F.posexplode(column).alias("pos", "c")).select("pos", F.col("c.child_chunk_id").alias("child_id"))
    return search.keep_first(c.join(rows, "child_id"), "child_id", ["pos"]).withColumn("n", F.struct("pos"))


def _evidence(hits: DataFrame | None, block) -> tuple[int, str, str]:
    """Number of hits, their context, and the texts of their parents."""
    if hits is None:
        return 0, "", ""
    hits = hits.cache()
    try:
        found = context.assemble(hits, block, [], "n").first()
        texts = context.assemble(hits, F.coalesce("parent_text", F.lit("")), [], "n").first()
        return found.n_blocks, found.context, texts.context
    finally:
        hits.unpersist()


def answer(t: Tables, question: str, k: int = 10, conversation_id: str | None = None) -> Turn:
    """Runs the whole turn. Research is tried again up to three times. An analysis below the quality gate is tried again until
    three have failed and is answered then all the same; research is not repeated for it, as it would give the same rows.

    Of a conversation, the last company and period complete a question that lacks one, before it is parsed, and the context of a
    similar turn is used again; where that turn cites nothing that is still there, the question is researched.
    """
    spark = t.companies.sparkSession
    turn = Turn(question, question, messages=[question])
    parser = t.parse or queryplan.parsed
    parse = lambda x: parser(spark.createDataFrame([(1, x)], "q_id int, q string"), t.companies)
    if spark.range(1).select(audit.input_fails(F.lit(question)).alias("x")).first().x:
        return _said(spark, turn, "query_harmful")
    p = parse(question)
    before = memory.conversation(t.turns, conversation_id) if t.turns is not None and conversation_id is not None else None
    if before is not None and p.select(audit.needs_refinement(F.col("tickers"), F.col("years"), F.col("quarters")).alias("x")).first().x:
        turn.asked = completed(t, before, p)
        p = parse(turn.asked)
    p = p.withColumn("query_type", queryplan.query_type(F.col("q"), F.col("tickers"), F.col("years")))
    row = p.select("query_type", "tickers").first()
    turn.query_type, turn.tickers = row.query_type, list(row.tickers)
    if not turn.tickers:
        return _said(spark, turn, "no_company")
    sec = call = texts = ""
    turn.reuse_id = reuse_of(t, before, p, turn.asked) if before is not None else None
    if turn.reuse_id is not None:
        turn.n_hits, sec, texts = _evidence(_cited(before, turn.reuse_id, "sec_context", _with_whole(t.hierarchy, t.parents)), context.sec_block())
        if not turn.n_hits:
            turn.reuse_id = None
        elif t.transcripts is not None:
            turn.n_calls, call, _ = _evidence(_cited(before, turn.reuse_id, "trans_context", _with_whole(t.transcripts, t.transcripts)), context.transcript_block())
    if turn.reuse_id is None:
        jobs = queryplan.retrieval_jobs(p, t.companies).orderBy("job_no").collect()
        while turn.retries <= audit.MAX_RETRIES:
            turn.n_hits, sec, texts = _evidence(hits_of(t, jobs, turn.query_type, turn.asked, k), context.sec_block())
            if turn.n_hits:
                break
            turn.retries += 1
            jobs = [_wider(j, turn.retries) for j in jobs]
        if not turn.n_hits:
            return _said(spark, turn, "research_fail")
        turn.n_calls, call, _ = _evidence(calls_of(t, jobs, turn.query_type, turn.asked), context.transcript_block())
    while True:
        body = sec if t.write is None else t.write(turn.asked, sec, turn.analysis_retries)
        route = _audit(spark, turn, body, texts, t.judge)
        if route != "retry":
            break
    done = _said(spark, turn, "response_harmful" if route == "fail" else route, LEADS[turn.query_type].format(", ".join(turn.tickers)) + body, call)
    if t.memory_path is not None and conversation_id is not None and done.route in ("accept", "exhausted"):
        _remember(t, done, p, before, conversation_id)
    return done


def _remember(t: Tables, turn: Turn, p: DataFrame, before: DataFrame | None, conversation_id: str) -> None:
    """Appends the finished turn to the memory, numbered after the last one there."""
    last = before.agg(F.max("turn_id").alias("n")).first().n if before is not None else None
    n = 0 if last is None else last + 1
    row = p.select(
        F.lit(f"{conversation_id}_{n}").alias("id"), F.lit(conversation_id).alias("conversation_id"), F.lit(n).cast("int").alias("turn_id"), F.lit(turn.asked).alias("modif_query"), F.lit(turn.answer).alias("llm_response_sec"),
        F.lit(turn.query_type).alias("query_type"), F.struct(F.transform("tickers", lambda x: F.struct(x.alias("ticker"))).alias("companies"), "years", "quarters", "filing_type_hint", "section_hints").alias("parsed_metadata"), F.current_timestamp().alias("asked_at"),
    )
    row.write.mode("append").parquet(t.memory_path)


def _audit(spark, turn: Turn, body: str, texts: str, judge=None) -> str:
    """The route after one analysis; its scores and failures are noted in the turn."""
    a = spark.createDataFrame([(turn.asked, body, texts)], "q string, a string, texts string")
    a = a.select(audit.output_fails(F.col("a")).alias("bad"), audit.faithfulness(F.col("a"), F.col("texts")).alias("f"), audit.relevancy(F.col("q"), F.col("a")).alias("r"))
    if judge is not None:
        faith, relevant = judge(turn.asked, body, texts)
        a = a.withColumns({"f": F.lit(float(faith)), "r": F.lit(float(relevant))})
    a = a.withColumn("ok", audit.passes(F.col("f"), F.col("r"))).withColumn("tries", turn.analysis_retries + F.when(F.col("bad") | F.col("ok"), 0).otherwise(1))
    got = a.withColumn("route", audit.after_audit(F.col("bad"), F.col("ok"), F.col("tries"))).first()
    turn.analysis_retries = got.tries
    turn.faithful, turn.relevant = (None, None) if got.bad else (got.f, got.r)
    return got.route


def _said(spark, turn: Turn, route: str, sec: str = "", call: str = "") -> Turn:
    """The turn with its route and final text."""
    is_ = lambda *r: F.lit(route in r)
    text = audit.final_text(is_("query_harmful"), is_("response_harmful"), is_("query_harmful", "response_harmful"), F.lit(0 if route == "no_company" else 1), is_("research_fail"), F.col("sec"), F.col("call"))
    turn.route, turn.answer = route, spark.createDataFrame([(sec, call)], "sec string, call string").select(text.alias("x")).first().x
    if route in ("accept", "exhausted", "response_harmful"):
        turn.messages.append(turn.answer)
    return turn


def _wider(job, step: int):
    """The same job with its headings, then its periods, left open."""
    from pyspark.sql import Row

    d = job.asDict()
    d["headings"] = []
    if step > 1:
        d["periods"] = []
    return Row(**d)
