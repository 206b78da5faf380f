"""Guardrail scans and answer post-processing over documents, chunks and recorded calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.operators import answers, guardrails
from lodestrand.operators.guardrails import INJECTION, PII
from lodestrand.session import spread
from lodestrand.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "source", "text")


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "canary_defended", "call_id", "request", "response").distinct()
    asked = F.array_join(F.transform(F.filter("request.messages", lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return rows.select("call_id", asked.alias("asked"), F.col("response.text").alias("text"), "request", F.col("response.model").alias("model"), F.col("response.usage").alias("usage"))


def pii_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Matches per source of the patterns that need no look-around."""
    count = lambda e: F.coalesce(F.sum(F.regexp_count("text", F.lit(PII[e]))), F.lit(0)).alias(e)
    return _documents(spark, folder).groupBy("source").agg(F.count("*").alias("documents"), count("ein"), count("ip"))


def luhn_candidates(spark: SparkSession, folder: str) -> DataFrame:
    runs = _documents(spark, folder).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{13,19}\b"), F.lit(0))).alias("digits"))
    return runs.withColumn("valid", F.expr("luhn_check(digits)"))


def injection_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded calls whose messages match each category of injection."""
    calls = _calls(spark, folder)
    safe = {c: [p for p in ps if p != guardrails._BASE64] for c, ps in INJECTION.items()}
    runs = F.regexp_extract_all("asked", F.lit(guardrails._BASE64), F.lit(0))
    encoded = F.coalesce(F.exists(runs, lambda r: r.rlike("[0-9]") & r.rlike("[A-Za-z]") & (F.length(F.regexp_replace(r, "[^/]", "")) <= 2)), F.lit(False))
    hit = lambda c: F.array_max(F.array(*[F.col("asked").rlike("(?U)" + p).cast("int") for p in safe[c]], *[encoded.cast("int")] * (c == "encoded_payload")))
    return calls.agg(F.count("*").alias("calls"), *[F.sum(hit(c)).alias(c) for c in INJECTION])


def base64_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = _documents(spark, folder).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z0-9+/]{40,}={0,2}"), F.lit(0))).alias("run"))
    plausible = F.col("run").rlike("[0-9]") & F.col("run").rlike("[A-Za-z]") & (F.length(F.regexp_replace("run", "[^/]", "")) <= 2)
    return runs.withColumn("plausible", plausible)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, id, text) of documents, chunks and recorded calls, spread over the tasks, for a table may be one file."""
    documents = table(spark, folder, "documents", "doc_id", "text").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    chunks = table(spark, folder, "chunks", "chunk_id", "text").distinct().select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text")
    calls = _calls(spark, folder).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("call_id").alias("id"), F.col(c).alias("text")) for k, c in (("asked", "asked"), ("answer", "text"))])).alias("t")).select("t.*")
    return spread(documents.unionByName(chunks).unionByName(calls))


def spans(spark: SparkSession, folder: str) -> DataFrame:
    found = guardrails.scanned(_texts(spark, folder))
    return found.select("kind", "id", F.explode("detections").alias("d")).select("kind", "id", "d.*")


def _digits(number: str, width: int) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


#: Contact lines made of a customer's number, each part with what it is preceded by; every kind of personal data stands in it once.
CONTACT = {
    "phone": ("Phone ", f"concat('(', {_digits('k % 800 + 200', 3)}, ') ', {_digits('k % 900 + 100', 3)}, '-', {_digits('k % 10000', 4)})"),
    "email": ("; mail ", "concat('c', k, '@example.org')"),
    "ssn": ("; number ", f"concat({_digits('k % 900 + 100', 3)}, '-', {_digits('k % 90 + 10', 2)}, '-', {_digits('k % 10000', 4)})"),
    "ein": ("; employer ", f"concat({_digits('k % 90 + 10', 2)}, '-', {_digits('k % 10000000', 7)})"),
    "credit_card": ("; card ", _digits("k * 7919 + 4000000000000000", 16)),
    "ip": ("; host ", "concat('10.', k % 256, '.', k % 199, '.7')"),
}


def _contacts(spark: SparkSession, folder: str) -> DataFrame:
    """(k, text): the contact line of each customer."""
    parts = ", ".join(f"'{before}', {part}" for before, part in CONTACT.values())
    return table(spark, folder, "customer", "c_custkey").selectExpr("cast(c_custkey as bigint) as k").selectExpr("k", f"concat({parts}, '.') as text")


def contact_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = guardrails.scanned(spread(_contacts(spark, folder)))
    return found.select("k", F.explode("detections").alias("d")).select("k", "d.*")


def contact_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Each contact line as question and as answer."""
    lines = spread(_contacts(spark, folder)).withColumn("direction", F.explode(F.array(F.lit("input"), F.lit("output"))))
    acted = guardrails.verdicts(guardrails.with_actions(guardrails.scanned(lines), F.col("direction")))
    return acted.select("k", "direction", "blocked", "reason", guardrails.refusal_text().alias("refusal"), "verdict_text")


def flagged_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """The excerpts of each call, by position, that hold an attempt at injection."""
    given = _calls(spark, folder).select("call_id", F.posexplode(answers.given_excerpts("asked", "text")).alias("at", "text"))
    found = guardrails.scanned(given).where(F.exists("detections", lambda d: d["detector"] == "injection"))
    return found.select("call_id", (F.col("at") + 1).alias("position"))


def guarded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """What is given out for each call: the answer's redactions, its refusal and the reason for it."""
    calls = _calls(spark, folder).where("text is not null").select("call_id", "text", F.ltrim("text").startswith(answers.SENTINEL).alias("refusal"))
    acted = guardrails.with_actions(guardrails.scanned(calls), F.lit("output"))
    given = guardrails.guarded_answer(acted)
    # The text itself where nothing is redacted; what redaction gives is checked on the contact lines.
    shown = F.when(F.col("final_text") == F.col("text"), F.col("text")).otherwise("holds personal data")
    return given.select("call_id", shown.alias("final_text"), "final_refusal", "refusal_reason")


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Each call's question as input, its prompt with the excerpts as retrieved, its answer as output."""
    question = F.try_element_at(F.filter(F.split("asked", "\n"), lambda line: line.startswith("Question: ")), F.lit(-1))
    texts = F.array(*[F.struct(F.lit(d).alias("direction"), t.alias("text")) for d, t in (("input", F.substring(question, 11, 1 << 30)), ("retrieved", F.col("asked")), ("output", F.col("text")))])
    both = _calls(spark, folder).select("call_id", F.explode(texts).alias("t")).select("call_id", "t.*")
    return guardrails.verdicts(guardrails.with_actions(guardrails.scanned(both), F.col("direction")))


def policy_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).select("call_id", "direction", "blocked", "reason", guardrails.refusal_text().alias("refusal"))


def redacted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, chunks and calls with personal data, without it."""
    acted = guardrails.with_actions(guardrails.scanned(_texts(spark, folder)), F.lit("output"))
    return guardrails.verdicts(acted).where("verdict_text <> text").select("kind", "id", "verdict_text")


def verdict_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of each direction are blocked, redacted and flagged: false positives on clean traffic."""
    has = lambda action: F.exists("applied", lambda x: x["action"] == action)
    return _verdicts(spark, folder).groupBy("direction").agg(F.count("*").alias("texts"), F.count_if("blocked").alias("blocked"), F.count_if(has("redact")).alias("redacted"), F.count_if(has("flag")).alias("flagged"))


def audit_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The audit line of each call: hashes instead of texts, detections without spans."""
    seen = _verdicts(spark, folder).where("direction = 'input'").select("call_id", F.to_json(guardrails.privacy_projection()).alias("detections"), "blocked")
    hashes = _calls(spark, folder).select("call_id", F.sha2("asked", 256).alias("query_hash"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("answer_hash"), "model", F.col("usage.input_tokens").alias("input_tokens"))
    return hashes.join(seen, "call_id")


def query_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "v2", "id", "question").distinct().select("id", F.sha2("question", 256).alias("hash"))


def forged_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Excerpts of the recorded prompts: real closing tags against opened ones, and forged ones neutralised."""
    calls = _calls(spark, folder)
    return calls.select("call_id", F.regexp_count("asked", F.lit("<excerpt id=")).alias("opened"), F.regexp_count("asked", F.lit("</excerpt>")).alias("closed"), F.regexp_count("asked", F.lit("(?i)&lt;/?excerpt")).alias("neutralised"), F.regexp_count(answers.neutralised("asked"), F.lit("(?i)</?excerpt")).alias("left"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "chunk_id", "doc_id", "section_id", "heading", "page_start", "text").dropDuplicates(["chunk_id"])
    return chunks.select("chunk_id", answers.excerpt(F.lit("1")).alias("excerpt"))


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Each section's chunks in order, cut at 512 tokens: the first always stays."""
    chunks = table(spark, folder, "chunks", "chunk_id", "doc_id", "section_id", "char_start", "text").dropDuplicates(["chunk_id"])
    rows = chunks.select(F.concat_ws("/", "doc_id", "section_id").alias("query_id"), F.col("chunk_id").alias("doc"), "char_start", answers.count_tokens("text").alias("tokens"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("char_start", "doc"))
    return answers.budgeted(rows.withColumn("rank", order), "tokens", 512).select("query_id", F.col("doc").alias("chunk_id"), "rank", "tokens", "tokens_upto")


def gather_sub_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Golden questions' cited sections as sub-queries, their chunks merged under a shared budget."""
    golden = table(spark, folder, "v2", "id", "source_citations").distinct().select(F.col("id").alias("question_id"), F.posexplode("source_citations").alias("sub_query", "c"))
    chunks = table(spark, folder, "chunks", "chunk_id", "doc_id", "section_id", "text").dropDuplicates(["chunk_id"]).select("doc_id", "section_id", F.col("chunk_id").alias("doc"), answers.count_tokens("text").alias("tokens"))
    rows = golden.join(chunks, (F.col("c.doc") == F.col("doc_id")) & (F.col("c.section") == F.col("section_id")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id", "sub_query").orderBy("doc")))
    return answers.gathered_context(ranked.select("question_id", "sub_query", "rank", "doc", "tokens"), 600).withColumnRenamed("doc", "chunk_id")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    calls = _calls(spark, folder).withColumn("context_size", F.size(answers.given_excerpts("asked"))).where("text is not null")
    out = answers.resolved(calls)
    return out.select("call_id", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"), F.array_join(F.transform("invalid", lambda x: x.cast("string")), ",").alias("invalid"), "resolved_text")


def cited_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """Each valid marker of an answer with the source of the excerpt at its position."""
    calls = _calls(spark, folder).withColumn("given", answers.given_excerpts("asked")).withColumn("context_size", F.size("given")).where("text is not null")
    return answers.resolved(calls).select("call_id", "given", F.explode("cited").alias("marker")).select("call_id", "marker", F.element_at("given", F.col("marker")).alias("source"))


def sentinels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "v2", "id", "reference_answer").distinct().where("reference_answer is not null")
    return answers.scrubbed(rows, "reference_answer").select("id", "refusal", "stray_sentinel", "scrubbed_text")


QUERIES = {
    "guard_pii_counts": pii_counts, "guard_luhn": luhn_candidates, "guard_injection_counts": injection_counts, "guard_base64": base64_runs, "guard_spans": spans, "guard_contact_spans": contact_spans, "guard_contact_verdicts": contact_verdicts,
    "guard_flagged_excerpts": flagged_excerpts, "guard_answers": guarded_answers,
    "guard_policy_verdicts": policy_verdicts, "guard_redacted": redacted_documents, "guard_verdict_rates": verdict_rates, "guard_audit": audit_projection,
    "guard_query_hashes": query_hashes, "guard_forged_tags": forged_tags, "answer_excerpts": excerpts, "answer_context_budget": context_budget,
    "answer_gather": gather_sub_queries, "answer_citations": citations, "answer_cited_excerpts": cited_excerpts, "answer_sentinels": sentinels,
}

_CALLS = """
WITH d AS (SELECT DISTINCT call_id, request.messages AS ms, response.text AS text, response.model AS model, response.usage.input_tokens AS input_tokens FROM canary_defended),
c AS (SELECT call_id, text, model, input_tokens, array_to_string(list_transform(list_filter(ms, lambda m: m.role = 'user'), lambda m: coalesce(m.content, '')), chr(10)) AS asked FROM d)
"""
_TAG = r'''<excerpt id=(\d+) source="([^"\n]*)">\n(?:((?s:.*?))\n)?</excerpt>'''
#: gs(call_id, text, given): the sources of a request's excerpts, in the first unbroken block of them, numbered from 1.
_GIVEN = (
    _CALLS
    + f""", b AS (SELECT call_id, text, regexp_extract(asked, '(?m)^(?:{_TAG}\\n?)+') AS block FROM c),
x AS (SELECT call_id, text, regexp_extract_all(block, '{_TAG}', 1) AS ids, regexp_extract_all(block, '{_TAG}', 2) AS sources, regexp_extract_all(block, '{_TAG}', 3) AS texts FROM b),
gs AS (SELECT call_id, text, list_filter(sources, lambda s, i: ids[i] = i::VARCHAR) AS given, list_filter(texts, lambda s, i: ids[i] = i::VARCHAR) AS given_texts FROM x)
"""
)
_CHUNKS = "WITH k AS (SELECT DISTINCT chunk_id, doc_id, section_id, heading, page_start, char_start, text FROM chunks)\n"
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\p{C}]'))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _luhn_sql(d: str) -> str:
    return (
        f"list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({d}, len({d}) - i + 1, 1)::INT "
        f"WHEN substr({d}, len({d}) - i + 1, 1)::INT > 4 THEN substr({d}, len({d}) - i + 1, 1)::INT * 2 - 9 ELSE substr({d}, len({d}) - i + 1, 1)::INT * 2 END)) % 10 = 0"
    )


#: Whether a text holds an entity, by patterns without look-around: what may not stand beside a match is matched as its neighbour.
_SAME = lambda a, b, c: "(?:" + "|".join(f"{a}{s}{b}{s}{c}" for s in ("-", r"\.", r"\s")) + ")"
_HOLDS = {
    "ssn": r"(?:^|[^0-9./-])" + _SAME(r"\d{3}", r"\d{2}", r"\d{4}") + r"(?:$|[^0-9./-])",
    "ein": PII["ein"],
    "phone": r"(?:\(\d{3}\)[\s.-]?\d{3}[\s.-]\d{4}|(?:^|[^\d.-])(?:\+?1[\s.-])?" + _SAME(r"\d{3}", r"\d{3}", r"\d{4}") + r")(?:$|[^\d-])",
    "email": PII["email"].replace("}+", "}"),
    "ip": PII["ip"],
}


def _holds_sql(entity: str, text: str) -> str:
    if entity == "credit_card":
        runs = f"list_transform(regexp_extract_all({text}, {_quoted(PII[entity])}), lambda r: regexp_replace(r, '\\D', '', 'g'))"
        return f"coalesce(len(list_filter({runs}, lambda d: len(d) BETWEEN 13 AND 19 AND {_luhn_sql('d')})) > 0, false)"
    if entity in PII:
        return f"coalesce(regexp_matches({text}, {_quoted(_HOLDS[entity])}), false)"
    plain = " OR ".join(f"regexp_matches({text}, {_quoted(p)})" for p in INJECTION[entity] if p != guardrails._BASE64)
    runs = f"regexp_extract_all({text}, {_quoted(guardrails._BASE64)})"
    encoded = f" OR len(list_filter({runs}, lambda r: regexp_matches(r, '[0-9]') AND regexp_matches(r, '[A-Za-z]') AND len(regexp_replace(r, '[^/]', '', 'g')) <= 2)) > 0"
    return f"coalesce({plain}{encoded if entity == 'encoded_payload' else ''}, false)"


def _named_sql(entities: tuple[str, ...]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{e}' END" for e in entities) + "], lambda x: x IS NOT NULL))"


#: v(call_id, direction, blocking, injected, redacting, flagging): what each text of a call holds, under the default policy.
_VERDICTS = (
    _CALLS
    + """, qs AS (SELECT *, list_filter(string_split(asked, chr(10)), lambda l: starts_with(l, 'Question: ')) AS qs FROM c),
t AS (SELECT call_id, 'input' AS direction, substr(qs[len(qs)], 11) AS text FROM qs UNION ALL SELECT call_id, 'retrieved', asked FROM qs UNION ALL SELECT call_id, 'output', text FROM qs),
e AS (SELECT call_id, direction, """
    + ", ".join(f"{_holds_sql(e, 'text')} AS {e}" for e in (*PII, *INJECTION))
    + " FROM t), v AS (SELECT call_id, direction, "
    + f"CASE WHEN direction = 'input' THEN {_named_sql(('ssn', 'ein', 'credit_card'))} ELSE [] END AS blocking, CASE WHEN direction = 'input' THEN {_named_sql(tuple(INJECTION))} ELSE [] END AS injected, "
    + "CASE direction WHEN 'input' THEN phone OR email WHEN 'output' THEN ssn OR ein OR credit_card OR phone OR email ELSE false END AS redacting, "
    + f"CASE direction WHEN 'input' THEN ip WHEN 'output' THEN ip OR {' OR '.join(INJECTION)} ELSE {' OR '.join((*PII, *INJECTION))} END AS flagging FROM e)\n"
)
#: p(k, one column for each part): the parts of the contact lines.
_PARTS = "WITH c AS (SELECT c_custkey::BIGINT AS k FROM customer), p AS (SELECT k, " + ", ".join(f"{part} AS {e}" for e, (_, part) in CONTACT.items()) + " FROM c), "


def _contact_text(shown: dict[str, str]) -> str:
    return "concat(" + ", ".join(f"'{before}', {shown.get(e, e)}" for e, (before, _) in CONTACT.items()) + ", '.')"


_HIDDEN = {e: f"'[REDACTED:{e.upper()}]'" for e in CONTACT if e not in ("ip", "credit_card")} | {"credit_card": f"CASE WHEN {_luhn_sql('credit_card')} THEN '[REDACTED:CREDIT_CARD]' ELSE credit_card END"}
_STARTS = {e: " + ".join([f"{sum(len(b) for b, _ in list(CONTACT.values())[: i + 1])}", *[f"len({x})" for x in list(CONTACT)[:i]]]) for i, e in enumerate(CONTACT)}

SQL = {
    "guard_policy_verdicts": _VERDICTS
    + """SELECT call_id, direction, len(blocking) + len(injected) > 0 AS blocked, CASE WHEN len(injected) > 0 THEN 'injection' WHEN len(blocking) > 0 THEN 'pii' END AS reason,
  CASE WHEN len(injected) > 0 THEN 'Blocked by the input guardrail, matching: ' || array_to_string(injected, ', ') WHEN len(blocking) > 0 THEN 'Blocked by the input guardrail, containing: ' || array_to_string(blocking, ', ') END AS refusal FROM v""",
    "guard_verdict_rates": _VERDICTS
    + "SELECT direction, count(*) AS texts, count(*) FILTER (len(blocking) + len(injected) > 0) AS blocked, count(*) FILTER (redacting) AS redacted, count(*) FILTER (flagging) AS flagged FROM v GROUP BY 1",
    "guard_contact_spans": _PARTS
    + "s AS ("
    + " UNION ALL ".join(f"SELECT k, 'regex' AS detector, '{e}' AS entity, ({_STARTS[e]})::INT AS start, ({_STARTS[e]} + len({e}))::INT AS \"end\" FROM p" + (f" WHERE {_luhn_sql('credit_card')}" if e == "credit_card" else "") for e in CONTACT)
    + ") SELECT * FROM s",
    "guard_contact_verdicts": _PARTS
    + f"v AS (SELECT k, 'input' AS direction, true AS blocked, 'pii' AS reason, concat('Blocked by the input guardrail, containing: ', CASE WHEN {_luhn_sql('credit_card')} THEN 'credit_card, ' ELSE '' END, 'ein, ssn') AS refusal, {_contact_text({})} AS verdict_text FROM p "
    + f"UNION ALL SELECT k, 'output', false, NULL, NULL, {_contact_text(_HIDDEN)} FROM p) SELECT * FROM v",
    "guard_answers": _CALLS
    + f"""SELECT call_id, CASE WHEN {' OR '.join(_holds_sql(e, 'text') for e in PII if e != 'ip')} THEN 'holds personal data' ELSE text END AS final_text, starts_with(ltrim(text), '[NO_ANSWER]') AS final_refusal,
  CASE WHEN starts_with(ltrim(text), '[NO_ANSWER]') THEN 'out_of_corpus' END AS refusal_reason FROM c WHERE text IS NOT NULL""",
    "guard_flagged_excerpts": _GIVEN
    + ", o AS (SELECT DISTINCT call_id, unnest(given_texts) AS text, generate_subscripts(given_texts, 1)::INT AS position FROM gs) SELECT call_id, position FROM o WHERE "
    + " OR ".join(_holds_sql(e, "text") for e in INJECTION),
    "guard_pii_counts": "SELECT source, count(*) AS documents, "
    + ", ".join(f"coalesce(sum(len(regexp_extract_all(text, {_quoted(PII[e])}))), 0)::BIGINT AS {e}" for e in ("ein", "ip"))
    + " FROM documents GROUP BY 1",
    "guard_luhn": r"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{13,19}\b')) AS digits FROM documents)
SELECT doc_id, digits, list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(digits, len(digits) - i + 1, 1)::INT
  WHEN substr(digits, len(digits) - i + 1, 1)::INT > 4 THEN substr(digits, len(digits) - i + 1, 1)::INT * 2 - 9 ELSE substr(digits, len(digits) - i + 1, 1)::INT * 2 END)) % 10 = 0 AS valid FROM r""",
    "guard_injection_counts": _CALLS
    + "SELECT count(*) AS calls, "
    + ", ".join("sum((" + " OR ".join(f"regexp_matches(asked, {_quoted(p)})" for p in ps if p != guardrails._BASE64) + f")::INT)::BIGINT AS {c}" for c, ps in INJECTION.items())
    + " FROM c",
    "guard_base64": r"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9+/]{40,}={0,2}')) AS run FROM documents)
SELECT doc_id, run, regexp_matches(run, '[0-9]') AND regexp_matches(run, '[A-Za-z]') AND len(regexp_replace(run, '[^/]', '', 'g')) <= 2 AS plausible FROM r""",
    "guard_query_hashes": "SELECT DISTINCT id, sha256(question) AS hash FROM v2",
    "guard_forged_tags": _CALLS
    + """SELECT call_id, len(regexp_extract_all(asked, '<excerpt id='))::INT AS opened, len(regexp_extract_all(asked, '</excerpt>'))::INT AS closed,
  len(regexp_extract_all(asked, '(?i)&lt;/?excerpt'))::INT AS neutralised, 0::INT AS "left" FROM c""",
    "answer_excerpts": _CHUNKS
    + r"""SELECT chunk_id, concat('<excerpt id=1 source="', replace(doc_id, '"', ''''), ' §', replace(section_id, '"', ''''), ' — ', replace(coalesce(heading, ''), '"', ''''), ' (p.', coalesce(page_start::VARCHAR, ''), ')">', chr(10),
  regexp_replace(text, '(?i)<(/?)(excerpt)', '&lt;\1\2', 'g'), chr(10), '</excerpt>', chr(10)) AS excerpt FROM k""",
    "answer_context_budget": _CHUNKS
    + f"""SELECT * FROM (SELECT query_id, chunk_id, rank, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS tokens_upto FROM (
  SELECT concat_ws('/', doc_id, section_id) AS query_id, chunk_id, {_TOKENS}::INT AS tokens, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY char_start NULLS FIRST, chunk_id)::INT AS rank FROM k))
  WHERE rank = 1 OR tokens_upto <= 512""",
    "answer_citations": _GIVEN
    + r""", m AS (SELECT call_id, text, len(given) AS size, list_transform(regexp_extract_all(text, '\[(\d{1,9})\]', 1), lambda x: x::INT) AS ns FROM gs WHERE text IS NOT NULL),
u AS (SELECT call_id, text, size, list_filter(ns, lambda n, i: list_position(ns, n) = i) AS ns FROM m),
v AS (SELECT call_id, text, list_filter(ns, lambda n: n BETWEEN 1 AND size) AS good, list_sort(list_filter(ns, lambda n: n NOT BETWEEN 1 AND size)) AS bad FROM u)
SELECT call_id, array_to_string(good, ',') AS cited, array_to_string(bad, ',') AS invalid, CASE WHEN len(bad) = 0 THEN text ELSE
  trim(regexp_replace(regexp_replace(regexp_replace(text, '\[0*(' || array_to_string(bad, '|') || ')\]', '', 'g'), ' {2,}', ' ', 'g'), ' ([.!?,;:])', '\1', 'g'), ' ') END AS resolved_text FROM v""",
    "answer_cited_excerpts": _GIVEN
    + r""", m AS (SELECT DISTINCT call_id, given, unnest(regexp_extract_all(text, '\[(\d{1,9})\]', 1))::INT AS marker FROM gs)
SELECT call_id, marker, given[marker] AS source FROM m WHERE marker BETWEEN 1 AND len(given)""",
    "answer_sentinels": r"""
SELECT DISTINCT id, starts_with(ltrim(reference_answer), '[NO_ANSWER]') AS refusal,
  contains(CASE WHEN starts_with(ltrim(reference_answer), '[NO_ANSWER]') THEN substr(ltrim(reference_answer), 12) ELSE reference_answer END, '[NO_ANSWER]') AS stray_sentinel,
  regexp_replace(regexp_replace(CASE WHEN starts_with(ltrim(reference_answer), '[NO_ANSWER]') THEN substr(ltrim(reference_answer), 12) ELSE reference_answer END, '^\s+', ''), '\s+$', '') AS scrubbed_text
FROM v2 WHERE reference_answer IS NOT NULL""",
}
