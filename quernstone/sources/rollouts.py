"""Rollout sessions: turns by running counts, answers that recover unanswered turns by islands, forks by common prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import clean_message, meaningless_exchange, noise
from quernstone.operators.governance import first_reason
from quernstone.session import cut, drop_cut

RECORD = "timestamp string, type string, payload struct<type: string, role: string, phase: string, id: string, timestamp: string, cwd: string, thread_source: string, forked_from_id: string, content: array<struct<type: string, text: string>>>"

#: Messages that a program wrote, and the envelope of answers to a program's questions.
RUNTIME = r"(?i)<(?:model_instruction|user_action)(?:>|\s)"
SKILL = r"(?s)\A<skill>\s*<name>[^<\r\n]+</name>\s*<path>[^<\r\n]+</path>\s*---(?:\r?\n).*?</skill>\s*\z"
INSTRUCTIONS = r"(?s)\A# AGENTS\.md instructions for [^\r\n]+\r?\n\r?\n<INSTRUCTIONS>.*?</INSTRUCTIONS>(?:\s*<environment_context>.*?</environment_context>)?\s*\z"
REPLY = r"(?s)\A<send_user_message_question_reply>\s*(.*?)\s*</send_user_message_question_reply>\s*\z"
TOOL_CALLS = ("custom_tool_call", "function_call", "tool_search_call", "web_search_call")
TOOL_RESULTS = ("custom_tool_call_output", "function_call_output", "tool_search_output")


def joined_text(content: Column, kind: str) -> Column:
    """Texts of the content's blocks of a kind, apart by blank lines."""
    own = F.filter(content, lambda b: (b["type"] == kind) & (F.trim(b["text"]) != ""))
    return F.array_join(F.transform(own, lambda b: b["text"]), "\n\n")


def question_reply(raw: Column) -> Column:
    """Questions and answers of a reply envelope as text, null if it isn't one or lacks a part."""
    replies = F.from_json(F.regexp_extract(raw, REPLY, 1), "array<struct<question: string, answer: string>>")
    clean = F.transform(replies, lambda r: F.struct(clean_message(r["question"]).alias("q"), clean_message(r["answer"]).alias("a")))
    whole = (F.size(clean) > 0) & F.forall(clean, lambda r: (F.coalesce(r["q"], F.lit("")) != "") & (F.coalesce(r["a"], F.lit("")) != ""))
    return F.when(raw.rlike(REPLY) & whole, F.array_join(F.transform(clean, lambda r: F.concat(F.lit("助手问题："), r["q"], F.lit("\n用户回答："), r["a"])), "\n\n"))


def human_text(raw: Column) -> Column:
    """What a person wrote, null for what a program did: envelopes, noise, slash commands, empty messages."""
    cleaned = clean_message(raw)
    typed = (cleaned != "") & ~cleaned.rlike(r"\A/[A-Za-z][\w-]*(?:\s+[^\n]*)?\z")
    return F.when(~raw.rlike(SKILL) & ~noise(raw) & ~raw.rlike(RUNTIME), F.coalesce(question_reply(raw), F.when(typed, cleaned)))


def events(records: DataFrame) -> DataFrame:
    """(path, line, kind, text, instructions): starts, contexts, ends, human messages and final answers, in order.

    instructions marks the envelope that is a program's only before its turn has a context."""
    p, t = F.col("record.payload"), F.col("record.type")
    event, message = (t == "event_msg"), (t == "response_item") & (p["type"] == "message")
    raw = joined_text(p["content"], "input_text")
    user, final = human_text(raw), clean_message(joined_text(p["content"], "output_text"))
    kind = (
        F.when(event & (p["type"] == "task_started"), "start")
        .when(t == "turn_context", "context")
        .when(event & (p["type"] == "task_complete"), "complete")
        .when(event & (p["type"] == "turn_aborted"), "aborted")
        .when(message & (p["role"] == "user") & user.isNotNull(), "user")
        .when(message & (p["role"] == "assistant") & (p["phase"] == "final_answer") & (final != ""), "final")
    )
    return records.select("path", "line", kind.alias("kind"), F.when(kind == "user", user).when(kind == "final", final).alias("text"), ((kind == "user") & raw.rlike(INSTRUCTIONS)).alias("instructions")).where("kind IS NOT NULL")


def turns(found: DataFrame) -> DataFrame:
    """(path, turn, users, finals, terminal): messages between a start and its first end. terminal is complete, aborted,
    superseded (another start came first) or active (the file ends)."""
    w = W.partitionBy("path").orderBy("line")
    begun = found.withColumn("turn", F.sum(F.when(F.col("kind") == "start", 1).otherwise(0)).over(w)).where("turn > 0")
    end = F.col("kind").isin("complete", "aborted")
    closed = F.sum(F.when(end, 1).otherwise(0)).over(W.partitionBy("path", "turn").orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    contexts = F.sum(F.when(F.col("kind") == "context", 1).otherwise(0)).over(W.partitionBy("path", "turn").orderBy("line"))
    inside = begun.withColumn("closed", F.coalesce(closed, F.lit(0))).withColumn("contexts", contexts).where("closed = 0 AND NOT (coalesce(instructions, false) AND contexts = 0)")
    struct = F.struct("line", "text")
    per_turn = inside.groupBy("path", "turn").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "user", struct))).alias("users"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "final", struct))).alias("finals"),
        F.max(F.when(end, F.col("kind"))).alias("ended"),
    )
    last = F.lead("turn").over(W.partitionBy("path").orderBy("turn")).isNull()
    return per_turn.withColumn("terminal", F.coalesce("ended", F.when(last, "active").otherwise("superseded"))).drop("ended")


def exchanges(per_turn: DataFrame) -> DataFrame:
    """(path, turn, first_turn, user_messages, assistant_text, recovered, trivial).

    A turn is answered if it is complete, has messages and one final answer behind them all. Unanswered turns - ended, with
    messages, without an answer - wait for the next turn of another kind, which recovers them if it is answered.
    """
    n_users, n_finals = F.size("users"), F.size("finals")
    waiting = F.col("terminal").isin("complete", "aborted") & (n_users > 0) & (n_finals == 0)
    answered = (F.col("terminal") == "complete") & (n_users > 0) & (n_finals == 1) & F.forall("users", lambda u: u["line"] < F.get("finals", F.lit(0))["line"])
    marked = per_turn.withColumns({"waiting": waiting, "answered": answered})
    before = W.partitionBy("path").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    islands = marked.withColumn("island", F.coalesce(F.sum(F.when(~F.col("waiting"), 1).otherwise(0)).over(before), F.lit(0)))
    closed = islands.groupBy("path", "island").agg(
        F.max(F.when(~F.col("waiting"), F.struct("turn", "answered", "finals"))).alias("end"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "users"))), lambda x: x["users"])).alias("all_users"),
        F.count_if("waiting").alias("waited"),
        F.min("turn").alias("first_turn"),
    )
    users = F.transform("all_users", lambda u: u["text"])
    out = closed.where("end.answered").select("path", F.col("end.turn").alias("turn"), "first_turn", users.alias("user_messages"), F.get("end.finals", F.lit(0))["text"].alias("assistant_text"), (F.col("waited") > 0).alias("recovered"))
    return out.withColumn("trivial", meaningless_exchange(F.array_join("user_messages", "\n\n"), F.col("assistant_text")))


def fork_delta(sessions: DataFrame, forks: DataFrame) -> DataFrame:
    """Exchanges of each session without those that its fork parent begins with. forks: (path, parent)."""
    w = W.partitionBy("path").orderBy("turn")
    digest = F.sha2(F.concat_ws("\x00", F.array_join("user_messages", "\x01"), "assistant_text"), 256)
    numbered = sessions.withColumn("ordinal", F.row_number().over(w)).withColumn("digest", digest)
    theirs = numbered.select(F.col("path").alias("parent"), "ordinal", F.col("digest").alias("parent_digest"))
    met = numbered.join(forks, "path", "left").join(theirs, ["parent", "ordinal"], "left")
    differs = F.max(F.when(F.col("digest").eqNullSafe(F.col("parent_digest")), 0).otherwise(1)).over(w)  # 1 from the first difference on
    return met.withColumn("own", differs == 1).where(F.col("own") | F.col("parent").isNull()).drop("own", "parent_digest", "digest")


def ancestors(forks: DataFrame) -> DataFrame:
    """(path, depth, state): depth of each fork in its chain; state is ok, missing (some forebear isn't there) or cycle. Stored.

    Each round doubles the jump: a path takes over the end, or the forebear, that its present forebear has reached. A round that
    ends no chain leaves only those that never end.
    """
    known = forks.select("path", "parent").distinct()
    there = known.select(F.col("path").alias("at"), F.lit(True).alias("there"))
    first = known.withColumn("at", F.col("parent")).join(there, "at", "left")
    end = F.when(F.col("at").isNull(), "ok").when(F.col("there").isNull(), "missing")
    now = cut(first.select("path", F.when(F.col("there"), F.col("at")).alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("depth"), end.alias("state")), "ancestors")
    left = None
    while (open_ := now.where("state IS NULL").count()) and open_ != left:
        left = open_
        far = now.select(F.col("path").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("state").alias("met"))
        step = now.join(far, "at", "left")
        then = cut(step.select("path", F.when(F.col("state").isNull(), F.col("next")).alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("state", "met").alias("state")), "ancestors")
        drop_cut(now)
        now = then
    return now.select("path", F.when(F.col("state").isNotNull(), F.col("depth")).alias("depth"), F.coalesce("state", F.lit("cycle")).alias("state"))


def thread_kind(thread_source: Column, source: Column) -> Column:
    """subagent, main or unknown; source is the field as JSON, an object or a plain word."""
    spawned = (thread_source == "subagent") | F.get_json_object(source, "$.subagent").isNotNull()
    return F.when(F.coalesce(spawned, F.lit(False)), "subagent").when((thread_source == "user") | source.isin("cli", '"cli"'), "main").otherwise("unknown")


def id_of_path(path: Column) -> Column:
    """The session id at the end of a file's name, else the name without rollout-."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)\z", 1), r"(?<=.)\.[^.]*\z", "")
    hexes = F.regexp_extract(name, r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\z", 1)
    return F.when(hexes != "", hexes).otherwise(F.regexp_replace(name, r"\Arollout-", ""))


def line_counts(records: DataFrame, invalid: DataFrame) -> DataFrame:
    """A row for each file: how many records of each kind a session's page leaves out, and its lines that are no JSON (0 if none).

    records: (path, record) with RECORD; invalid: (path, invalid)."""
    p, t = F.col("record.payload"), F.col("record.type")
    item, event = t == "response_item", t == "event_msg"
    said = item & (p["type"] == "message")
    kinds = {
        "developer": said & (p["role"] == "developer"),
        "commentary": said & (p["role"] == "assistant") & (p["phase"] == "commentary"),
        "unphased": said & (p["role"] == "assistant") & p["phase"].isNull(),
        "tool_calls": item & p["type"].isin(*TOOL_CALLS),
        "tool_results": item & p["type"].isin(*TOOL_RESULTS),
        "reasoning": item & (p["type"] == "reasoning"),
        "compactions": (t == "compacted") | (event & (p["type"] == "context_compacted")),
        "interrupted": event & (p["type"] == "turn_aborted"),
        "runtime_users": said & (p["role"] == "user") & human_text(joined_text(p["content"], "input_text")).isNull(),
    }
    counts = records.groupBy("path").agg(*(F.count_if(holds).alias(name) for name, holds in kinds.items()))
    return counts.join(invalid, "path", "full_outer").na.fill(0, [*kinds, "invalid"])


def turn_counts(per_turn: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each file: turns of each ending, those whose messages don't make one exchange, and the exchanges that came of them.

    per_turn: turns(); found: exchanges()."""
    users, finals = F.size("users"), F.size("finals")
    ends = {"active_open": F.col("terminal") == "active", "superseded": F.col("terminal") == "superseded"}
    shapes = {"ambiguous_finals": finals > 1, "unpaired": (users > 0) & (finals == 0), "multi_user": (users > 1) & (finals == 1)}
    a = per_turn.groupBy("path").agg(F.sum(users).cast("long").alias("users"), *(F.count_if(holds).alias(name) for name, holds in (ends | shapes).items()))
    b = found.groupBy("path").agg(F.count_if(~F.col("trivial")).alias("exchanges"), F.count_if("trivial").alias("trivial"), F.count_if("recovered").alias("recovered"))
    return a.join(b, "path", "left").na.fill(0, ["exchanges", "trivial", "recovered"])


#: Why a session isn't imported, the first reason first, and when.
SKIPS = (
    ("subagent_excluded", "thread_kind = 'subagent'"),
    ("thread_kind_review", "thread_kind <> 'main'"),
    ("review_resolution_mismatch_review", "resolution = 'mismatch'"),
    ("invalid_jsonl_review", "invalid > 0 AND resolution <> 'match'"),
    ("active_session_deferred", "active_open > 0"),
    ("turn_boundary_review", "superseded > 0 AND resolution <> 'match' OR ambiguous_finals > 0"),
    ("no_human_user", "users = 0"),
    ("trivial_session", "exchanges = 0 AND trivial = users"),
    ("no_final_visible", "exchanges = 0"),
)


def with_skip_reason(units: DataFrame) -> DataFrame:
    """units with skip_reason, "" if nothing speaks against them. units has thread_kind, resolution and the counts that SKIPS names."""
    reasons = first_reason(*((code, F.expr(holds)) for code, holds in SKIPS))
    return units.withColumn("skip_reason", F.coalesce(F.get(reasons, F.lit(0)), F.lit("")))
